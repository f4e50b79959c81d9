"""Quality classifier by co-training of two views.

The content view sees the text alone: hashed word shares, how many words repeat and how even they are, and
the shares of letters, capitals, digits, marks, spaces and lines.  The page view sees the metadata alone:
language, source and stated length.  Each view is a logistic regression.  In every round each view labels
all unlabelled rows, and of its confident rows of both classes EXCHANGE_ROWS distinct ones, drawn by a hash
of their features, join the *other* view's training set.  At the end each view is calibrated on labelled rows
that it wasn't trained on, and the calibrated log-odds are combined with weights fitted on those rows.

Features are written once for every row (about a kilobyte each); the rounds and the scores read them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import chunks, coded_words, logistic, platt, raw, sigmoid, sums
from .common import mix, stored, tidy, tune
from .toxicity import sampled_ids

SAMPLE_ROWS = 4000  # labelled texts, at most about this many
EXCHANGE_ROWS = 160  # rows of either class that a view hands over in a round
CONFIDENT = 0.1  # how far from 0 or 1 a confident row's probability is at most
ROUNDS = 4
_HASHED = 512
_KINDS = np.full(256, 0, np.uint8)  # other, capital, small or non-ASCII letter, digit, space, line end, mark
_KINDS[65:91], _KINDS[97:123], _KINDS[128:] = 1, 2, 2
_KINDS[48:58], _KINDS[[9, 11, 12, 13, 32]], _KINDS[10] = 3, 4, 5
_KINDS[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 6
_RARE = np.zeros(256, np.uint8)  # marks that sentences have no use for
_RARE[[ord(c) for c in "#$%&*+<=>@[]^_`{|}~\\!"]] = 1


def _slots(words: pa.Array) -> np.ndarray:
    """Hash slot of each distinct word in lower case: its first eight bytes, its last byte and its length."""
    data, at = raw(pc.utf8_lower(words))
    n = np.diff(at)
    h = n.astype(np.uint64)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    for k in range(8):
        h = mix(h * np.uint64(31) + np.where(k < n, padded[at[:-1] + np.minimum(k, 7)], 0).astype(np.uint64))
    h = mix(h + padded[np.maximum(at[1:] - 1, 0)].astype(np.uint64))
    return (h % np.uint64(_HASHED)).astype(np.int64)


def _layout(texts: pa.Array) -> np.ndarray:
    data, bounds = raw(texts)
    kinds = _KINDS[data]
    size = np.maximum(np.diff(bounds), 1)
    share = np.stack([sums((kinds == k).astype(np.float32), bounds) / size for k in range(7)], axis=1)
    letters = np.maximum(share[:, 1] + share[:, 2], 1e-9)
    pair = np.concatenate([[False], (kinds[1:] == 6) & (kinds[:-1] == 6)]) if len(kinds) else np.zeros(0, bool)
    pair[bounds[:-1][bounds[:-1] < len(pair)]] = False  # not across texts
    rare = sums(_RARE[data].astype(np.float32), bounds) / size
    lines = share[:, 5] * size + 1
    return np.stack(
        [
            share[:, 1] / letters, share[:, 3], share[:, 4], share[:, 6], np.sqrt(sums(pair.astype(np.float32), bounds) / size), np.sqrt(rare), np.log1p(lines) / 5, np.log1p(size / lines) / 10,
            np.log1p(size) / 10, (size < 40).astype(float),
        ], axis=1,
    )


def content_view(texts: pa.Array) -> np.ndarray:
    """Features of the content view."""
    texts = pc.fill_null(texts, "")
    words, index, bounds = coded_words(texts)
    n, n_texts = np.diff(bounds), len(bounds) - 1
    text = np.repeat(np.arange(n_texts), n)
    size = np.maximum(n, 1)
    lengths = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(float)
    if len(index):
        key, count = np.unique(text * len(words) + index, return_counts=True)
        owner = key // len(words)
        distinct = np.bincount(owner, minlength=n_texts)
        most = np.zeros(n_texts)
        np.maximum.at(most, owner, count)
        again = np.concatenate([[False], (index[1:] == index[:-1]) & (text[1:] == text[:-1])])
    else:
        distinct, most, again = np.zeros(n_texts), np.zeros(n_texts), np.zeros(0, bool)
    # what chance alone would give falls with the length, so repeats are taken against it
    shape = np.stack(
        [
            distinct / size, np.log1p(size) * (1 - distinct / size) / 8, most / size, np.sqrt(sums(again.astype(float), bounds) / size), sums(np.minimum(lengths[index], 30), bounds) / size / 10,
            (sums((lengths[index] > 20).astype(float), bounds) / size), np.minimum(n, 20) / 20.0, np.log1p(n) / 10,
        ], axis=1,
    )
    bag = np.bincount(text * _HASHED + _slots(words)[index], minlength=n_texts * _HASHED).reshape(n_texts, _HASHED)
    return np.concatenate([shape, _layout(texts), bag / size[:, None] * 8], axis=1).astype(np.float16)


_NAMES, _SIZES = 64, 24


def page_view(lang: list, source: list, n_chars: list) -> np.ndarray:
    """Features of the page view: a slot for the language, one for the source, one for the power of two of the stated length."""
    out = np.zeros((len(lang), 2 * _NAMES + _SIZES + 1), np.float16)
    rows = np.arange(len(lang))
    stated = np.array([-1.0 if c is None else float(c) for c in n_chars])
    out[rows, [_name_slot(x, 0) for x in lang]] = 0.3
    out[rows, [_NAMES + _name_slot(x, 1) for x in source]] = 0.3
    out[rows, 2 * _NAMES + np.where(stated < 0, 0, np.minimum(1 + np.log2(np.maximum(stated, 0) + 1), _SIZES - 1)).astype(int)] = 0.3
    out[:, -1] = np.log1p(np.maximum(stated, 0)) / 10
    return out


def _name_slot(value, salt: int) -> int:
    import zlib

    return zlib.crc32(f"{salt}|{value}".encode()) % _NAMES


def _margins(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return x.astype(np.float64) @ weights[:-1] + weights[-1]


_CONTENT, _PAGE = 8 + 10 + _HASHED, 2 * _NAMES + _SIZES + 1


def _views(pdf) -> tuple[np.ndarray, np.ndarray]:
    """Both views of rows with features (a, b)."""
    return tuple(np.frombuffer(b"".join(x), np.float16).reshape(-1, d) for x, d in zip(pdf, (_CONTENT, _PAGE)))


class CoTraining:
    """The rounds over labelled rows; y: 0 or 1."""

    def __init__(self, content: np.ndarray, page: np.ndarray, y: np.ndarray):
        self.views, self.y = (content.astype(np.float64), page.astype(np.float64)), y.astype(float)
        at = np.arange(len(y))
        self.fit, self.check = at[at % 4 != 0], at[at % 4 == 0]
        if len(np.unique(y[self.check])) < 2 or len(np.unique(y[self.fit])) < 2:
            self.fit = self.check = at
        self.more = [(np.zeros((0, x.shape[1])), np.zeros(0)) for x in self.views]
        self.train()

    def train(self) -> None:
        self.weights = []
        for k, (x, (rows, t)) in enumerate(zip(self.views, self.more)):
            weight = np.concatenate([np.ones(len(self.fit)), np.full(len(t), 0.5)])
            self.weights.append(logistic(np.concatenate([x[self.fit], rows]), np.concatenate([self.y[self.fit], t]), weight, ridge=3e-4 if k else 1e-3))

    def add(self, view: int, rows: np.ndarray, label: np.ndarray) -> None:
        old, t = self.more[view]
        self.more[view] = np.concatenate([old, rows.astype(np.float64)]), np.concatenate([t, label.astype(float)])

    def model(self) -> dict:
        truth = self.y[self.check]
        marks = [_margins(x[self.check], w) for x, w in zip(self.views, self.weights)]
        scales = [platt(m, truth) for m in marks]
        odds = np.stack([a * m + b for m, (a, b) in zip(marks, scales)], axis=1)
        return {"content": self.weights[0], "page": self.weights[1], "scales": scales, "joint": logistic(np.clip(odds, -8, 8), truth, ridge=1e-3)}


_META = ("lang", "source", "n_chars")
FEATURES = "doc_id long, print long, a binary, b binary"


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """FEATURES of every row, written once."""
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, 1):
                a, b = content_view(part.column(1)), page_view(*(part.column(k).to_pylist() for k in (2, 3, 4)))
                a, b = [x.tobytes() for x in a], [x.tobytes() for x in b]
                prints = np.array([xxhash.xxh3_64_intdigest(x) for x in a], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(prints), pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["doc_id", "print", "a", "b"])
        tidy()

    tune(docs.sparkSession)
    meta = [(F.col(c) if c in docs.columns else F.lit(None)).cast("long" if c == "n_chars" else "string").alias(f"_{c}") for c in _META]
    return stored(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *meta).mapInArrow(run, FEATURES), "quality-features")


def _handed(rows: DataFrame, weights: list, taken: set, turn: int) -> pd.DataFrame:
    """Of each view's confident rows of either class, EXCHANGE_ROWS distinct ones: (view, label, a, b)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # a task keeps as many as may be chosen of its rows, whatever their number
        held: list[pd.DataFrame] = [pd.DataFrame(columns=["order", "view", "label", "a", "b"])] * 4
        for pdf in batches:
            if not len(pdf):
                continue
            order = mix(pdf["print"].to_numpy().view(np.uint64) + np.uint64(turn)).view(np.int64)
            fresh = ~pdf["print"].isin(taken).to_numpy()
            for k, (x, w) in enumerate(zip(_views((pdf["a"], pdf["b"])), weights)):
                p = sigmoid(_margins(x, w))
                for label in (0, 1):
                    at = np.flatnonzero(fresh & (np.abs(p - label) < CONFIDENT))
                    new = pd.DataFrame({"order": order[at], "print": pdf["print"].to_numpy()[at], "view": k, "label": label, "a": pdf["a"].to_numpy()[at], "b": pdf["b"].to_numpy()[at]})
                    both = new if not len(held[2 * k + label]) else pd.concat([held[2 * k + label], new])
                    held[2 * k + label] = both.drop_duplicates("print").nsmallest(EXCHANGE_ROWS, "order")
        for h in held:
            if len(h):
                yield h[["order", "print", "view", "label", "a", "b"]]

    schema = "order long, print long, view int, label int, a binary, b binary"
    found = stored(rows.mapInPandas(run, schema), "quality-confident")
    parts = [found.filter((F.col("view") == k) & (F.col("label") == y)).dropDuplicates(["print"]).orderBy("order").limit(EXCHANGE_ROWS) for k in (0, 1) for y in (0, 1)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]).toPandas().sort_values(["view", "label", "order"])


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score every whole text for quality.

    Trains on about SAMPLE_ROWS labelled texts, chosen by a hash of the id, and on the pseudo-labels of the
    rounds, in which all other rows take part.  Returns per row: the id, content_score and page_score
    (calibrated probabilities of the views), score (their combination) and accepted (score >= ``threshold``).
    lang, source and n_chars may be missing columns.

    Null texts count as empty; null metadata is a value of its own.  Ids labelled twice count as good if
    either row says so.  Repeated rows are scored each, and take part in a round once.  Without labels of
    both classes the score is constant: 1/2 without any label.  An empty table gives an empty result; other
    columns are not read.
    """
    rows = features(docs, id_col, text_col)
    out = score_quality(rows, fit_quality(rows, labels, id_col), threshold)
    return out.withColumnRenamed("doc_id", id_col) if id_col != "doc_id" else out


def fit_quality(rows: DataFrame, labels: DataFrame, id_col: str = "doc_id", rounds: int = ROUNDS) -> dict:
    """The model, from the FEATURES of all rows and the labels."""
    known = rows.join(F.broadcast(sampled_ids(labels, "quality", SAMPLE_ROWS, id_col)), F.col("doc_id") == F.col("_id")).select("_id", "_label", "print", "a", "b").toPandas()
    known = known.sort_values(["_id", "_label", "print"], kind="stable").drop_duplicates(["_label", "a", "b"])
    y = known["_label"].to_numpy()
    if len(np.unique(y)) < 2:
        return {"constant": 6.0 if len(y) and y.min() > 0 else (-6.0 if len(y) else 0.0)}
    machine = CoTraining(*_views((known["a"], known["b"])), y)
    taken = set(known["print"].tolist())
    for turn in range(rounds):
        got = _handed(rows, machine.weights, taken, turn)
        if not len(got):
            break
        for k in (0, 1):
            mine = got[got["view"] == k]
            if len(mine):
                machine.add(1 - k, _views((mine["a"], mine["b"]))[1 - k], mine["label"].to_numpy())
        taken |= set(got["print"].tolist())
        machine.train()
    return machine.model()


def _scored(content: np.ndarray, page: np.ndarray, model: dict) -> list[np.ndarray]:
    """The views' calibrated probabilities and their combination."""
    if "constant" in model:
        return [np.full(len(content), sigmoid(np.array(model["constant"])))] * 3
    odds = np.stack([s * _margins(x, model[v]) + c for v, x, (s, c) in zip(("content", "page"), (content, page), model["scales"])], axis=1)
    return [sigmoid(odds[:, 0]), sigmoid(odds[:, 1]), sigmoid(np.clip(odds, -8, 8) @ model["joint"][:-1] + model["joint"][-1])]


def score_quality(rows: DataFrame, model: dict, threshold: float = 0.5) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                each = _scored(*_views((batch.column(1).to_pylist(), batch.column(2).to_pylist())), model)
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x) for x in each), pa.array(each[2] >= threshold)], names=["doc_id", "content_score", "page_score", "score", "accepted"])
        tidy()

    return rows.select("doc_id", "a", "b").mapInArrow(run, "doc_id long, content_score double, page_score double, score double, accepted boolean")


def accepted_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, with their columns."""
    model = fit_quality(features(docs), labels)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = {c: k for k, c in enumerate(names)}
            for part in chunks(batch, place["text"]):
                meta = [part.column(place[c]).to_pylist() if c in place else [None] * part.num_rows for c in _META]
                yield part.filter(pa.array(_scored(content_view(part.column(place["text"])), page_view(*meta), model)[2] >= threshold))
        tidy()

    return docs.mapInArrow(run, docs.schema)
