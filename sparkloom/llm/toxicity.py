"""Toxicity: a support vector machine over a gap-weighted subsequence kernel, with Nystroem landmarks.

Units are a text's words in lower case without punctuation (also inside, so that ``i.d.i.o.t`` is a
word), and runs of single letters joined.  The kernel of two units counts their common subsequences of
three or four bytes that span at most five, each weighted by LAMBDA for every byte skipped, so inserted and
changed letters cost some of the weight, not all.  Landmarks are units of the training sentences; the
Nystroem map sends a unit to K^(-1/2) of its kernel values with them, and a linear SVM separates there.

Labels belong to texts, so training is by witnesses: of each labelled sentence group (text) the unit with
the largest margin stands for it, and the machine is trained again on the witnesses of both classes.
A text's margin is that of its witness; Platt scaling makes it a probability.  As the whole machine is
linear in the subsequences, scoring is a table look-up for each subsequence of each distinct word.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import chunks, coded_words, platt, raw, sigmoid
from .common import tidy, tune

LAMBDA = 0.7
# steps between the bytes of a subsequence: three bytes that span at most five, four that span at most five
_STEPS = [(a, b) for a in (1, 2, 3) for b in (1, 2, 3) if a + b <= 4] + [(1, 1, 1), (2, 1, 1), (1, 2, 1), (1, 1, 2)]
_BITS = 18
_PUNCTUATION = r"[!-/:-@\[-`{-~]+"
SAMPLE_ROWS = 5000  # labelled texts that the machine is trained on, at most about this many
SAMPLE_CHARS = 20_000  # longer texts are scored, but not used for training: the driver holds 100 million characters at most
LANDMARKS = 128


def units_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct units, the unit at each place, and the bounds of each text's places."""
    words, index, bounds = coded_words(texts)
    plain = pc.replace_substring_regex(pc.utf8_lower(words), _PUNCTUATION, "")
    again = plain.dictionary_encode()
    units, index = again.dictionary, again.indices.to_numpy(zero_copy_only=False).astype(np.int64)[index]
    single = (pc.utf8_length(units).to_numpy(zero_copy_only=False) == 1)[index] if len(index) else np.zeros(0, bool)
    if single.any():
        text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        new = single & ~np.concatenate([[False], single[:-1] & (text[1:] == text[:-1])])
        starts = np.flatnonzero(new)
        stops = np.flatnonzero(single & ~np.concatenate([single[1:] & (text[1:] == text[:-1]), [False]])) + 1
        long = stops - starts >= 3
        if long.any():
            letters = units.to_pylist()
            joined = ["".join(letters[i] for i in index[a:b]) for a, b in zip(starts[long], stops[long])]
            units = pa.concat_arrays([units, pa.array(joined, units.type)])
            index = index.copy()
            index[starts[long]] = len(letters) + np.arange(len(joined))
    return units, index, bounds


def subsequences(units: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(unit, subsequence number, weight) of all occurrences; the weights of a unit have norm 1."""
    data, at = raw(units)
    owner = np.repeat(np.arange(len(units)), np.diff(at))
    x = data.astype(np.uint32)
    who, what, weight = [], [], []
    for steps in _STEPS:
        span = sum(steps)
        n = len(x) - span
        if n <= 0:
            continue
        at_ = np.flatnonzero(owner[:n] == owner[span:])
        code, place = np.full(len(at_), len(steps), np.uint32), at_
        for step in (0, *steps):
            place = place + step
            code = (code ^ x[place]) * np.uint32(0x9E3779B1)
            code ^= code >> np.uint32(15)
        who.append(owner[at_])
        what.append((code * np.uint32(0x85EBCA6B) >> np.uint32(32 - _BITS)).astype(np.int64))
        weight.append(np.full(len(at_), LAMBDA ** (span - len(steps))))
    if not who:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    who, what, weight = np.concatenate(who), np.concatenate(what), np.concatenate(weight)
    norm = np.sqrt(np.bincount(who, weights=weight**2, minlength=len(units)))
    return who, what, weight / norm[who]


def kernel(units: pa.Array, landmarks: pa.Array) -> np.ndarray:
    table = np.zeros((len(landmarks), 1 << _BITS), np.float32)
    who, what, weight = subsequences(landmarks)
    np.add.at(table, (who, what), weight)
    used = np.unique(what)
    place = np.full(1 << _BITS, -1)
    place[used] = np.arange(len(used))
    small = np.ascontiguousarray(table[:, used].T)
    out = np.zeros((len(units), len(landmarks)))
    for a in range(0, len(units), 4096):
        who, what, weight = subsequences(units.slice(a, 4096))
        hit = place[what] >= 0
        np.add.at(out, who[hit] + a, small[place[what[hit]]] * weight[hit, None])
    return out


def margins(units: pa.Array, model: dict) -> np.ndarray:
    out = np.empty(len(units))
    for a in range(0, len(units), 1 << 15):
        part = units.slice(a, 1 << 15)
        who, what, weight = subsequences(part)
        out[a : a + (1 << 15)] = np.bincount(who, weights=weight * model["table"][what], minlength=len(part)) + model["bias"]
    return out


def _witnesses(values: np.ndarray, index: np.ndarray, bounds: np.ndarray, floor: float) -> tuple[np.ndarray, np.ndarray]:
    """The largest value of each text, and the unit that has it (-1 for texts without units)."""
    best, unit = np.full(len(bounds) - 1, floor), np.full(len(bounds) - 1, -1)
    full = np.flatnonzero(np.diff(bounds) > 0)
    if len(full):
        own = values[index]
        best[full] = np.maximum.reduceat(own, bounds[full])
        at = np.flatnonzero(own == np.repeat(best, np.diff(bounds)))
        text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[at]
        unit[text[::-1]] = index[at[::-1]]
    return best, unit


def _bent(words: list[str]) -> list[str]:
    """Words with a letter inserted, doubled or left out at each inner place, by a fixed rule."""
    out = []
    for w in words:
        if len(w) >= 5:
            for k in range(1, len(w)):
                letter = "abcdefghijklmnopqrstuvwxyz0123456789"[zlib.crc32(f"{w}{k}".encode()) % 36]
                out += [w[:k] + letter + w[k:], w[:k] + w[k - 1] + w[k:]]
                if len(w) > 6 and k < len(w) - 1:
                    out.append(w[:k] + w[k + 1 :])
    return out


def _svm(z: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 2e-4, steps: int = 300) -> np.ndarray:
    """Squared-hinge linear SVM; the bias is last."""
    zb = np.concatenate([z, np.ones((len(z), 1))], axis=1)
    sample = weight / weight.sum()
    bound = 2 * np.linalg.eigvalsh((zb * sample[:, None]).T @ zb)[-1] + ridge
    w, v, t = np.zeros(zb.shape[1]), np.zeros(zb.shape[1]), 1.0
    for _ in range(steps):
        slack = np.maximum(0, 1 - y * (zb @ v))
        grad = -2 * zb.T @ (sample * y * slack) + ridge * np.concatenate([v[:-1], [0]])
        new = v - grad / bound
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, w, t = new + (t - 1) / t2 * (new - w), new, t2
    return w


def train(texts: pa.Array, labels: np.ndarray) -> dict:
    """A model from labelled texts: four fifths train the machine, the rest calibrate it."""
    fit = np.arange(len(labels)) % 5 != 4
    if len(np.unique(labels[~fit])) < 2 or len(np.unique(labels[fit])) < 2:
        fit = np.ones(len(labels), bool)
    rest = fit if fit.all() else ~fit
    model = _machine(texts.filter(pa.array(fit)), labels[fit])
    if "scale" not in model:
        units, index, bounds = units_of(texts.filter(pa.array(rest)))
        best, _ = _witnesses(margins(units, model), index, bounds, model["bias"])
        model["scale"] = platt(_certain(best), labels[rest].astype(float))
    return model


def _machine(texts: pa.Array, labels: np.ndarray, rounds: int = 3) -> dict:
    """The machine without its scale.  With one class only, a constant model."""
    positive = labels > 0
    if positive.all() or not positive.any():
        return {"table": np.zeros(1 << _BITS, np.float32), "bias": 0.0, "scale": (0.0, 6.0 if len(labels) and positive.all() else -6.0)}
    units, index, bounds = units_of(texts)
    text = np.repeat(np.arange(len(texts)), np.diff(bounds))
    pairs = np.unique(text * len(units) + index)
    doc, unit = pairs // len(units), pairs % len(units)
    df1 = np.bincount(unit[positive[doc]], minlength=len(units)).astype(float)
    df0 = np.bincount(unit[~positive[doc]], minlength=len(units)).astype(float)
    n1, n0 = positive.sum(), (~positive).sum()
    # start: of a unit's subsequences the one that leans most to toxic texts, in deviations from chance
    hot, cold = np.zeros(1 << _BITS), np.zeros(1 << _BITS)
    for a in range(0, len(units), 1 << 15):
        who, what, weight = subsequences(units.slice(a, 1 << 15))
        hot += np.bincount(what, weights=df1[a + who], minlength=1 << _BITS)
        cold += np.bincount(what, weights=df0[a + who], minlength=1 << _BITS)
    chance = (hot + cold) * n1 / (n1 + n0)
    lean = (hot - chance) / np.sqrt(chance + 1)
    first = np.zeros(len(units))
    for a in range(0, len(units), 1 << 15):
        who, what, weight = subsequences(units.slice(a, 1 << 15))
        np.maximum.at(first, a + who, lean[what])
    # a word that clean texts use is no sign of a toxic one, whatever its parts
    first -= 3 * np.log1p(df0)
    value = first
    rng = np.random.default_rng(5)
    for _ in range(rounds):
        best, witness = _witnesses(value, index, bounds, -1e9)
        good = np.unique(witness[positive & (witness >= 0)])
        good = good[df0[good] <= 0.02 * (df1[good] + df0[good])] if (df0[good] == 0).any() else good
        often = np.bincount(witness[positive & (witness >= 0)], minlength=len(units))
        near = np.flatnonzero((df0 > 0))
        hard = near[np.argsort(-value[near])[:4000]]
        easy = rng.choice(near, min(len(near), 6000), replace=False)
        bad = np.unique(np.concatenate([hard, easy, witness[~positive & (witness >= 0)]]))
        bad = np.setdiff1d(bad, good)
        order = good[np.argsort(-often[good], kind="stable")]
        similar = kernel(units.take(pa.array(order[:600])), units.take(pa.array(order[:600])))
        chosen: list[int] = []
        for k in range(len(similar)):
            if len(chosen) < LANDMARKS * 3 // 4 and (not chosen or similar[k, chosen].max() < 0.8):
                chosen.append(k)
        marks = units.take(pa.array(np.concatenate([order[chosen], hard[np.linspace(0, max(0, len(hard) - 1), min(len(hard), LANDMARKS // 4)).astype(int)]])))
        bent = pa.array(_bent(units.take(pa.array(order[:300])).to_pylist()), units.type)
        rows = pa.concat_arrays([units.take(pa.array(good)), bent, units.take(pa.array(bad))])
        y = np.concatenate([np.ones(len(good) + len(bent)), -np.ones(len(bad))])
        k_mm = kernel(marks, marks)
        lam, vec = np.linalg.eigh(k_mm)
        root = vec[:, lam > 1e-4] / np.sqrt(lam[lam > 1e-4])
        half = root @ vec[:, lam > 1e-4].T
        z = kernel(rows, marks) @ half
        heavy = np.concatenate([1.0 + np.log1p(often[good]), np.full(len(bent), 0.5 * len(good) / max(1, len(bent)))])
        sample = np.concatenate([heavy / heavy.sum(), np.full(len(bad), 3.0 / max(1, len(bad)))])
        w = _svm(z, y, sample)
        alpha = half @ w[:-1]
        table = np.zeros(1 << _BITS)
        who, what, weight = subsequences(marks)
        np.add.at(table, what, weight * alpha[who])
        model = {"table": table, "bias": float(w[-1])}
        value = margins(units, model) + 0.05 * np.clip(first, -10, 10)
    return {"table": model["table"].astype(np.float32), "bias": model["bias"]}


def _certain(margin: np.ndarray) -> np.ndarray:
    """Margins for the calibration.  The machine asks for 1; what lies beyond that says no more than that a unit is
    spelt as in training, and would push the spellings with an inserted byte, near 1/2, below the threshold."""
    return np.clip(margin, -3, 1.25)


def score(texts: pa.Array, model: dict) -> np.ndarray:
    units, index, bounds = units_of(texts)
    best, _ = _witnesses(margins(units, model), index, bounds, model["bias"])
    a, b = model["scale"]
    return sigmoid(a * _certain(best) + b)


def sampled_ids(labels: DataFrame, label: str, rows: int, id_col: str) -> DataFrame:
    """(_id, _label) of about ``rows`` labelled ids, as many of either class where there are enough, chosen by a hash."""
    known = labels.select(F.col(id_col).cast("long").alias("_id"), F.col(label).cast("int").alias("_label")).filter("_label in (0, 1) and _id is not null").groupBy("_id").agg(F.max("_label").alias("_label"))
    limit = {r["_label"]: int(min(1.0, rows / 2 / r["n"]) * ((1 << 63) - 1024)) for r in known.groupBy("_label").agg(F.count("*").alias("n")).collect()}
    draw = F.xxhash64(F.col("_id"), F.lit(17)).bitwiseAND(F.lit((1 << 63) - 1))
    return known.filter(draw <= F.when(F.col("_label") == 1, F.lit(limit.get(1, 0))).otherwise(F.lit(limit.get(0, 0))))


def training_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, id_col: str, text_col: str) -> DataFrame:
    """The texts of ``sampled_ids``.  The ids and labels (24 bytes a row, about ``rows`` rows) are broadcast, so that
    no text is shuffled."""
    text = F.coalesce(F.col(text_col), F.lit("")).alias("_text")
    return docs.select(F.col(id_col).cast("long").alias("_id"), text).filter(F.length("_text") <= SAMPLE_CHARS).join(F.broadcast(sampled_ids(labels, label, rows, id_col)), "_id")


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, folds: int = 3, fold: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score every whole text for toxicity.

    Learns from the labelled rows whose crc32(id as text) mod ``folds`` is not ``fold``: about SAMPLE_ROWS of
    them, of SAMPLE_CHARS characters or less each.  Returns per row: the id, held_out (the remainder is
    ``fold``), score (0 to 1, higher: likelier toxic) and predicted (1 if score >= ``threshold``, else 0).

    Null and empty texts score as texts without any unit.  A null id is not held out and never has a label;
    ids labelled twice count as toxic if either row says so.  Repeated rows are scored each.  Without
    labels of both classes the score is constant.  An empty table gives an empty result; other columns
    are not read.
    """
    spark = docs.sparkSession
    tune(spark)
    train_labels = labels.filter(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(folds)) != fold)
    sample = training_sample(docs, train_labels, "toxic", SAMPLE_ROWS, id_col, text_col).toPandas().sort_values(["_id", "_text"]).drop_duplicates("_text")
    model = train(pa.array(sample["_text"].tolist(), pa.string()), sample["_label"].to_numpy())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, 1):
                s = score(part.column(1), model)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])
        tidy()

    out = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, score double, predicted int")
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(False))
    return out.select(F.col("doc_id").alias(id_col), held.alias("held_out"), "score", "predicted")
