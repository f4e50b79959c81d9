"""Language-model scoring with a weighted backoff automaton.

The model is an n-gram model with Dirichlet smoothing: P(w | h) = (c(hw) + m P(w | h')) / (c(h) + m),
where h' drops the oldest word of h and the lowest order is the additive unigram model.  As an automaton:
the states are the contexts seen in training; a seen n-gram is an arc with weight log10 P; a failure arc
leads from h to h' with weight log10(m / (c(h) + m)).  Contexts are words and words are counted, so every
weight follows from counts of n-grams.

The automaton of the whole corpus is never in one place.  Each block of documents asks the shards of the
n-gram space for the counts of the n-grams that it holds (and reports its own training counts), and so
gets the part of the automaton that its documents can reach.  A shard sees an n-gram once per block.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import REQUEST, exchange, mix, per_block, request_rows, shards_for, stored, to_blocks, totals_of, tune, unpack, with_replies, word_hashes

SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
_BLOCK_BYTES = 4 << 20  # larger blocks ask less often for what they share
_START, _END = np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)


def held_out(doc_id: int | None, folds: int, fold: int) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % folds == fold


def _grams(texts: list[bytes], order: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Token counts; for each order the hash of the n-gram that ends at each place; and whether that n-gram exists.

    A text is START, its words, END.  Places of START are kept (they are contexts) but are not tokens.
    """
    split = [t.lower().split() for t in texts]
    counts = np.array([len(w) + 2 for w in split], np.int64)
    hashes = np.empty(int(counts.sum()), np.uint64)
    ends = np.cumsum(counts)
    inner = np.ones(len(hashes), bool)
    inner[ends - counts] = False
    inner[ends - 1] = False
    hashes[ends - counts], hashes[ends - 1] = _START, _END
    hashes[inner] = word_hashes([w for s in split for w in s])
    since = np.arange(len(hashes)) - np.repeat(ends - counts, counts)
    grams = [mix(hashes + np.uint64(1))]
    for k in range(2, order + 1):
        longer = np.zeros_like(hashes)
        longer[1:] = mix(grams[-1][:-1] * np.uint64(0x9E3779B97F4A7C15) + hashes[1:] + np.uint64(k))
        grams.append(longer)
    return counts, grams, since


def _asks(row, order: int, folds: int, fold: int, shards: int) -> list[dict]:
    ids, texts = unpack(row)
    counts, grams, since = _grams(texts, order)
    trained = np.repeat(np.array([not held_out(i, folds, fold) for i in ids]), counts)
    out = []
    for k, g in enumerate(grams, 1):
        real = since >= k - 1
        keys, inverse = np.unique(g[real], return_inverse=True)
        seen = np.bincount(inverse, weights=trained[real], minlength=len(keys)).astype(np.int64)
        out += request_rows(int(row.block), keys[:, None], seen, shards, k)
    return out


def traverse(counts: np.ndarray, seen: np.ndarray, arcs: np.ndarray, fails: np.ndarray) -> np.ndarray:
    """Log-probability of each text of a block, in one pass from left to right.

    seen[k], arcs[k], fails[k]: for each place, whether the n-gram of k + 1 tokens that ends there is an arc,
    its weight, and the weight of the failure arc from the state of length k before it.  The state is the length
    of the context that the automaton remembers; at each token it follows failure arcs until an arc carries
    the token, adds the weights, and moves to the longest context that it knows.  A training n-gram's parts
    are training n-grams, so the arc taken is the longest that ends at the token, and never longer than the
    state that the token before left allows; the pass is therefore a shift by one place and sums.
    """
    order, n = seen.shape
    starts = np.cumsum(counts) - counts
    depth = np.zeros(n, np.int64)  # tokens of the longest arc that ends here
    for k in range(order):
        depth[seen[k] & (depth == k)] = k + 1
    state = np.zeros(n, np.int64)
    state[1:] = np.minimum(depth[:-1], order - 1)
    taken = np.maximum(depth - 1, 0)  # an unknown token is carried by the empty state
    score = arcs[taken, np.arange(n)]
    for k in range(1, order):
        score = score + np.where((taken < k) & (k <= state), fails[k], 0.0)
    score[starts] = 0.0
    return np.add.reduceat(score, starts) if n else np.zeros(0)


def lm_scores(docs: DataFrame, order: int = 2, prior: float = 4.0, folds: int = 10, fold: int = 0, add: float = 0.1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score every text under an n-gram model of the texts whose crc32(id as text) mod ``folds`` is not ``fold``.

    A-Z count as a-z; tokens are the words (runs of bytes other than ASCII white space) and one end token.
    Returns per row: the id, held_out, n_tokens, n_known (tokens seen in training), train_tokens, base_score
    (sum of log10((c + add) / (N + add * (V + 1))) over the tokens) and score (the model's log10 probability).

    Null and empty texts are the end token alone.  A null id counts as trained.  Repeated rows are trained
    on and scored each.  With no training rows N and V are 0.  An empty table gives an empty result; other
    columns are not read.
    """
    spark = docs.sparkSession
    tune(spark)
    blocks = stored(to_blocks(docs, id_col, text_col, _BLOCK_BYTES), "lm-blocks", "none")
    size = blocks.agg(F.sum(F.length("payload"))).first()[0] or 0
    shards = shards_for(spark, 2 * order * size)
    asked = per_block(blocks, lambda row: _asks(row, order, folds, fold, shards), REQUEST)
    replies = stored(exchange(asked, shards, 1, skip=int(mix(np.array([_START + np.uint64(1)]))[0])), "lm-counts", "none")
    tokens, vocabulary = (x or 0 for x in replies.filter("part = 1").agg(F.sum("mass"), F.sum("known")).first())

    def score(row, got):
        ids, texts = unpack(row)
        counts, grams, since = _grams(texts, order)
        totals = []
        for k, g in enumerate(grams, 1):
            real = since >= k - 1
            c = np.zeros(len(g))
            c[real] = totals_of(got[got["part"] == k])[np.unique(g[real], return_inverse=True)[1]]
            totals.append(c)
        base = (totals[0] + add) / (tokens + add * (vocabulary + 1))
        p, arcs, fails = base, [np.log10(base)], [np.zeros(len(base))]
        for k in range(1, order):
            context = np.concatenate([[0.0], totals[k - 1][:-1]])
            p = (totals[k] + prior * p) / (context + prior)
            arcs.append(np.log10(p))
            fails.append(np.log10(prior / (context + prior)))
        scores = traverse(counts, np.stack(totals) > 0, np.stack(arcs), np.stack(fails))
        starts = np.cumsum(counts) - counts
        token = since > 0
        return pd.DataFrame(
            {
                "doc_id": pd.array(ids, dtype="Int64"), "held_out": [held_out(i, folds, fold) for i in ids], "n_tokens": counts - 1, "n_known": np.add.reduceat((token & (totals[0] > 0)).astype(np.int64), starts),
                "train_tokens": int(tokens), "base_score": np.add.reduceat(np.where(token, np.log10(base), 0.0), starts), "score": scores,
            }
        )

    out = with_replies(blocks, replies, score, SCORES)
    return out.withColumnRenamed("doc_id", id_col) if id_col != "doc_id" else out
