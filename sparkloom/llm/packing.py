"""Sequence packing: concatenate and cut.

Pass one tokenizes each document once, and notes its place in its partition's run of ids.  The totals
of the partitions (one number each) give every partition's global offset by a prefix sum.  Pass two cuts
the one long run of ids into windows of fixed length; a document that crosses a window's edge is cut
there, and each piece is a boundary record (where it starts in the document and in its window).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, tidy, tune

TOKENS = "doc_id long, part int, at long, n long, ids binary"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_TAIL = ".,;:!?|)*$%&#"
_CHUNK_BYTES = 8 << 20
# letters up to U+00FF: composed already, and each has a lower case of its own
_LATIN = "^[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+$"


class WordTokens:
    """Ids of texts by their distinct space-separated words.

    The tokenizer splits at white space and drops it, and its lower-casing looks at single characters, so
    the ids of a text are those of its words in turn.  Texts that hold a special token's mark are not split.
    Each distinct word of a chunk of texts is encoded once, as a stem of letters and a tail of punctuation,
    which are separate pieces for the tokenizer.  Stems are encoded in one call and told apart by the ids
    that end a word; Latin stems need neither the normalizer nor the pattern, so they go in lower case to
    a copy of the tokenizer without them.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.plain = Tokenizer(self.tokenizer.model)  # the same model: it is held once
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.marks = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocab = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocab.values()) + 1, bool)
        self.ends_word[[i for w, i in vocab.items() if w.endswith("</w>")]] = True

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def letters(self, words: list[str], tokenizer) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of letters alone, and the number of each word's."""
        ids = np.array(tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, dtype="<u4")
        ends = np.flatnonzero(self.ends_word[ids]) + 1
        if len(ends) == len(words) and (not len(ends) or ends[-1] == len(ids)):
            return ids, np.diff(np.concatenate([[0], ends]))
        return self.each(words)

    def each(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [self.whole(w) for w in words]
        return np.concatenate([np.zeros(0, "<u4"), *ids]), np.array([len(x) for x in ids], np.int64)

    def apart(self, stem: str) -> bool:
        """Whether a stem is letters alone for the tokenizer too: the lower case of a capital I with a dot ends in a
        combining mark, which the pattern joins to the punctuation after it."""
        return stem.isalpha() and (self.tokenizer.normalizer is None or self.tokenizer.normalizer.normalize_str(stem).isalpha())

    def pieces(self, words: pa.Array, extra: list[str], end_id: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
        """Of distinct words: all pieces' ids and sizes, each word's stem and tail as pieces, and the number of the
        end id's piece, which the pieces of ``extra`` follow.  The piece before it is empty."""
        stems = pc.ascii_rtrim(words, _TAIL)
        latin = pc.match_substring_regex(stems, _LATIN).to_numpy(zero_copy_only=False)
        coded = pc.if_else(pa.array(latin), pc.utf8_lower(stems), None).dictionary_encode()
        stem = pc.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)
        ids, sizes = self.letters(coded.dictionary.to_pylist(), self.plain)
        rest = np.flatnonzero(~latin)
        names, roots = words.take(pa.array(rest)).to_pylist(), stems.take(pa.array(rest)).to_pylist()
        letters: dict[str, int] = {}
        odd: dict[str, int] = {}
        tails: dict[str, int] = {}
        other = [(0, letters.setdefault(r, len(letters))) if self.apart(r) else (1, odd.setdefault(w, len(odd))) for w, r in zip(names, roots)]
        cut = pc.binary_length(stems).to_numpy(zero_copy_only=False)
        long = np.flatnonzero((cut < pc.binary_length(words).to_numpy(zero_copy_only=False)))
        tail_of = [tails.setdefault(w[len(s) :], len(tails)) for w, s in zip(words.take(pa.array(long)).to_pylist(), stems.take(pa.array(long)).to_pylist())]
        parts = [(ids, sizes), self.letters(list(letters), self.tokenizer), self.each(list(odd)), self.each(list(tails)), (np.array([end_id], "<u4"), np.array([0, 1])), self.each(extra)]
        base = np.cumsum([0, *(len(n) for _, n in parts)])
        tail = np.full(len(words), base[4])
        tail[long] = base[3] + np.array(tail_of, np.int64)
        for k, (kind, i) in zip(rest.tolist(), other):
            stem[k] = base[1 + kind] + i
            if kind:
                tail[k] = base[4]
        return np.concatenate([x for x, _ in parts]), np.concatenate([n for _, n in parts]).astype(np.int64), stem, tail, int(base[4]) + 1

    def encode(self, texts: pa.Array, end_id: int) -> tuple[pa.Array, np.ndarray]:
        """The ids of each text with the end id, as little-endian 32-bit bytes, and their number."""
        texts = pc.fill_null(texts, "")
        marked = np.zeros(len(texts), bool)
        for m in self.marks:
            marked |= pc.match_substring(texts, m).to_numpy(zero_copy_only=False)
        parts = pc.split_pattern(pc.replace_substring(pc.if_else(pa.array(~marked), texts, ""), "\n", " "), " ")
        offsets = parts.offsets.to_numpy().astype(np.int64)
        coded = parts.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
        bounds = offsets - offsets[0]
        whole = np.flatnonzero(marked).tolist()
        ids, sizes, stem, tail, end = self.pieces(coded.dictionary, [texts[k].as_py() for k in whole], end_id)
        index = coded.indices.to_numpy(zero_copy_only=False)
        # 32-bit places throughout: a chunk has far fewer ids
        index = np.stack([stem.astype(np.int32)[index], tail.astype(np.int32)[index]], axis=1).ravel()
        # a marked text was split as one empty word
        index[2 * bounds[whole]] = end + 1 + np.arange(len(whole))
        index = np.insert(index, 2 * bounds[1:], end)
        lengths = sizes.astype(np.int32)[index]
        reach = np.cumsum(lengths, dtype=np.int64)
        stops = reach[2 * bounds[1:] + np.arange(len(texts))]
        first = (np.cumsum(sizes) - sizes)[index]
        first -= reach
        first += lengths
        at = np.repeat(first.astype(np.int32), lengths)
        del index, reach, first, lengths, parts
        at += np.arange(len(at), dtype=np.int32)
        ids = ids[at]
        n = np.diff(np.concatenate([[0], stops]))
        raw = pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer((4 * np.concatenate([[0], stops])).astype(np.int32).tobytes()), pa.py_buffer(ids)])
        return raw, n


_TOKENIZERS: dict[str, WordTokens] = {}


def tokenize(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """TOKENS rows: a document's ids with the end id, its partition, and the ids before it there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer_path not in _TOKENIZERS:
            _TOKENIZERS[tokenizer_path] = WordTokens(tokenizer_path)
        tok = _TOKENIZERS[tokenizer_path]
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
            chunk = np.cumsum(sizes, dtype=np.int64) // _CHUNK_BYTES
            cuts = [0, *(np.flatnonzero(np.diff(chunk)) + 1).tolist(), batch.num_rows] if batch.num_rows else []
            for a, b in zip(cuts, cuts[1:]):
                sub = batch.slice(a, b - a)
                ids, n = tok.encode(sub.column(1), end_id)
                starts = np.cumsum(np.concatenate([[at], n]))
                at = int(starts[-1])
                yield pa.RecordBatch.from_arrays([sub.column(0), pa.array(np.full(b - a, part, np.int32)), pa.array(starts[:-1]), pa.array(n), ids], names=["doc_id", "part", "at", "n", "ids"])
                del sub, ids
        tidy()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, TOKENS)


def pack(docs: DataFrame, tokenizer_path: str, length: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack documents into sequences of ``length`` ids; only the last sequence is shorter.

    A document is its tokens, then ``end_id``; null and empty texts are the end id alone.  Returns a row
    per piece: the id, start (ids of the document before it), length, ids_crc32 (of its little-endian
    32-bit ids), doc_tokens, sequence_id and offset (its place in the sequence).  Each id lies in exactly
    one piece.  Repeated rows are packed each; null ids stay null; an empty table gives no pieces; other
    columns are not read.  The only thing that the driver gathers is one total per partition.
    """
    spark = docs.sparkSession
    tune(spark)
    tokens = stored(tokenize(docs, tokenizer_path, end_id, id_col, text_col), "pack-tokens")
    totals = sorted((r["part"], r["n"]) for r in tokens.groupBy("part").agg(F.sum("n").alias("n")).collect())
    ends = np.cumsum([0, *(n for _, n in totals)]).tolist()
    base = {part: at for (part, _), at in zip(totals, ends)}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in PIECES.split(", ")]
        for batch in batches:
            rows: list[tuple] = []
            for doc, part, at, n, ids in zip(*(batch.column(i).to_pylist() for i in range(5))):
                begin, start = base[part] + at, 0
                while start < n:
                    seq, offset = divmod(begin + start, length)
                    k = min(n - start, length - offset)
                    rows.append((doc, start, k, zlib.crc32(memoryview(ids)[4 * start : 4 * (start + k)]), n, seq, offset))
                    start += k
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=names)

    out = tokens.mapInArrow(cut, PIECES)
    return out.withColumnRenamed("doc_id", id_col) if id_col != "doc_id" else out
