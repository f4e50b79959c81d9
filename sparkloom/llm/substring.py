"""Substring dedup by seed and extend.

Seeds are winnowed anchors: of the ``window - seed + 1`` seed grams in a window of ``window`` words,
the one with the least hash (the leftmost on ties).  Equal windows choose equal anchors at the same
offset, so a window can only repeat if its anchor does.  Blocks of documents join on anchors; anchors
that occur once are dropped.  A repeated anchor is then extended to the left and to the right at once:
each window that chose it is a (left, right) extension, compared by a 128-bit hash of its words.  Runs
of repeated windows are the maximal repeats over the threshold.

No pairs are made: an anchor or window held by a third of all documents is sent once per block.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import REQUEST, counted, covered, distinct, exchange, mix, per_block, request_rows, rolling, shards_for, stored, to_blocks, totals_of, tune, unpack, with_replies, word_hashes

SPANS = "doc_id long, n_words long, n_removed long, spans array<struct<start:long,stop:long>>, kept_sha256 string"


def _words(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """All words, their hashes, the word count of each text, and each word's end of text."""
    split = [t.split() for t in texts]
    counts = np.array([len(w) for w in split], np.int64)
    words = [w for s in split for w in s]
    return words, word_hashes(words), counts, np.repeat(np.cumsum(counts), counts)


def _anchored(hashes: np.ndarray, ends: np.ndarray, window: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of the windows that lie in one text, the place each chose as its anchor, and all seed grams' hashes."""
    grams = rolling(hashes, seed)
    starts = np.flatnonzero(np.arange(len(hashes)) + window <= ends)
    if not len(starts):
        return starts, starts, grams
    choices = sliding_window_view(grams, window - seed + 1)
    at = np.concatenate([choices[a : a + (1 << 17)].argmin(axis=1) for a in range(0, len(choices), 1 << 17)])
    return starts, starts + at[starts], grams


def _pair(hashes: np.ndarray, starts: np.ndarray, window: int) -> np.ndarray:
    """128-bit keys of the windows from ``starts``."""
    return np.stack([rolling(hashes, window, 0)[starts], rolling(mix(hashes ^ np.uint64(0x5851F42D4C957F2D)), window, 1)[starts]], axis=1)


def substring_dedup(docs: DataFrame, window: int = 35, seed: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove every word that a repeated window of ``window`` words covers.

    Words are runs of bytes other than ASCII white space, compared unchanged.  Returns per row: the id,
    n_words, n_removed, spans (maximal removed word runs, [start, stop)) and kept_sha256 of the kept
    words joined by one space.  Windows are judged on the input and never cross rows.

    Null and empty texts have no words, no spans and the digest of the empty string.  Null ids stay
    null.  Repeated rows are rows of their own (their windows repeat each other).  Texts shorter than
    ``window`` words are kept.  An empty table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    tune(spark)
    blocks = stored(to_blocks(docs, id_col, text_col), "substring-blocks", "none")
    size = blocks.agg(F.sum(F.length("payload"))).first()[0] or 0
    shards = shards_for(spark, size)

    def seeds(row):
        _, texts = unpack(row)
        _, hashes, _, ends = _words(texts)
        _, places, grams = _anchored(hashes, ends, window, seed)
        # least hashes are small, and would crowd the first shards
        return request_rows(int(row.block), *counted(mix(grams[np.unique(places)])[:, None]), shards, 1)

    first = exchange(per_block(blocks, seeds, REQUEST), shards, 1, (2,))
    first = stored(first, "substring-anchors")

    def extend(row, replies):
        _, texts = unpack(row)
        _, hashes, _, ends = _words(texts)
        starts = _candidates(hashes, ends, window, seed, replies)
        return request_rows(int(row.block), *counted(_pair(hashes, starts, window)), shards, 2)

    second = stored(exchange(with_replies(blocks, first, extend, REQUEST), shards, 2, (2,)), "substring-windows")

    def finish(row, replies):
        ids, texts = unpack(row)
        words, hashes, counts, ends = _words(texts)
        starts = _candidates(hashes, ends, window, seed, replies[replies["part"] == 1])
        _, inverse = distinct(_pair(hashes, starts, window))
        hit = totals_of(replies[replies["part"] == 2]) > 0
        gone = covered(starts[hit[inverse]] if len(starts) else starts, window, len(words))
        out, at = [], 0
        for i, n in zip(ids, counts.tolist()):
            mask, own = gone[at : at + n], words[at : at + n]
            k = int(mask.sum())
            edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]]))) if k else []
            kept = [w for w, m in zip(own, mask.tolist()) if not m] if k else own
            out.append((i, n, k, [{"start": int(a), "stop": int(b)} for a, b in zip(edges[::2], edges[1::2])], hashlib.sha256(b" ".join(kept)).hexdigest()))
            at += n
        df = pd.DataFrame(out, columns=["doc_id", "n_words", "n_removed", "spans", "kept_sha256"])
        return df.astype({"doc_id": "Int64"})

    out = with_replies(blocks, first.unionByName(second), finish, SPANS)
    return out.withColumnRenamed("doc_id", id_col) if id_col != "doc_id" else out


def _candidates(hashes: np.ndarray, ends: np.ndarray, window: int, seed: int, replies: pd.DataFrame) -> np.ndarray:
    """Starts of the windows whose anchor repeats."""
    starts, places, grams = _anchored(hashes, ends, window, seed)
    if not len(starts):
        return starts
    _, inverse = distinct(mix(grams[places])[:, None])
    return starts[(totals_of(replies) > 0)[inverse]]
