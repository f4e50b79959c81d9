"""The training-data operators against plain versions, on small and awkward tables."""

from __future__ import annotations

import hashlib
import os
import random
import sys
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

sys.path.insert(0, os.path.dirname(__file__))
import brute  # noqa: E402

pytest.importorskip("sparkloom.llm")
from sparkloom.llm import common, components, embed, exact, lm, minmax, mixing, packing, quality, substring, suffix, toxicity  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
TABLES = "/root/testdata/sf0.001"


def corpus(seed=0, n=60):
    """Random texts with copies, near copies, a shared passage, short, null and awkward ones."""
    rng = random.Random(seed)
    vocab = ["".join(rng.choices("abcdeé", k=rng.randint(1, 7))) for _ in range(300)]
    text = lambda k: " ".join(rng.choices(vocab, k=k))
    passage, out = text(60), []
    for _ in range(n):
        kind, t = rng.random(), text(rng.randint(1, 120))
        if out and kind < 0.15:
            t = rng.choice(out)
        elif out and kind < 0.35:
            w = rng.choice(out).split(" ")
            w[rng.randrange(len(w))] = "changed"
            t = " ".join(w)
        elif kind < 0.5:
            t = f"{text(5)} {passage}\n{text(8)}"
        elif kind < 0.55:
            t = "ab " * rng.randint(1, 90)
        out.append(t)
    return [*out, None, "", " \t\n", "One", "one", "A b\x0bc  d", "x" * 3000, "naïve café 日本 " * 40]


def frame(spark, texts, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "s%d" % (k % 3) if k % 7 else None, len(t or "")) for k, (i, t) in enumerate(zip(ids, texts))], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def texts():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, texts):
    return frame(spark, texts)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_substring(docs, texts, empty):
    for width, seed in ((35, 24), (12, 8)):
        got = substring.substring_dedup(docs, window=width, seed=seed).collect()
        assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == sorted(brute.substring(list(enumerate(texts)), width))
        assert all(sum(s.stop - s.start for s in r.spans) == r.n_removed for r in got)
    assert substring.substring_dedup(empty).count() == 0


def test_suffix_arrays():
    rng = np.random.default_rng(2)
    for k in range(150):
        d = rng.integers(0, rng.integers(1, 5) + 1, rng.integers(0, 50)).astype(np.uint8)
        d = np.tile(d, 3) if k % 3 == 0 else d
        b = d.tobytes()
        want = sorted(range(len(b)), key=lambda i: b[i:])
        sa = suffix.suffix_array(d)
        assert list(sa) == want
        plcp = suffix.common_prefixes(d, sa)
        for a, c in zip(want, want[1:]):
            n = 0
            while a + n < len(b) and c + n < len(b) and b[a + n] == b[c + n]:
                n += 1
            assert plcp[c] == n


def test_suffix_arrays_of_long_strings():
    rng = np.random.default_rng(5)
    words = [bytes(rng.integers(97, 105, int(k)).astype(np.uint8)) for k in rng.integers(1, 9, 300)]
    text = b" ".join(words[k] for k in rng.integers(0, 300, 12000))
    fibonacci = [b"a", b"ab"]
    while len(fibonacci[-1]) < 30000:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    for x in (text, text[:9000] * 4, b"a" * 40000, b"ab" * 20000, b"a" * 30000 + text, fibonacci[-1], bytes(range(255, -1, -1)) * 150):
        d = np.frombuffer(x, np.uint8)
        sa = suffix.suffix_array(d)
        rank = np.full(len(d) + 1, -1)
        rank[sa] = np.arange(len(d))
        assert (np.sort(sa) == np.arange(len(d))).all()
        a, b = sa[:-1], sa[1:]
        assert ((d[a] < d[b]) | ((d[a] == d[b]) & (rank[a + 1] < rank[b + 1]))).all()


def test_suffix(docs, texts, empty):
    for width in (400, 40):
        got = suffix.suffix_dedup(docs, width=width, report=30).collect()
        assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == sorted(brute.suffix(list(enumerate(texts)), width))
    repeated = {i: sum(m) for i, m in enumerate(brute.covered([(t or "").encode() for t in texts], 30))}
    assert {r.doc_id: r.n_repeated for r in got} == repeated
    assert suffix.suffix_dedup(empty).count() == 0


def test_suffix_arrays_hold_what_repeats():
    """Runs that share an anchor but no window of ``report`` bytes stay out of the arrays; so do the ends of those that do."""
    rng = np.random.default_rng(4)
    text = lambda n: bytes(rng.integers(97, 123, n, dtype=np.uint8))
    passage, longer = text(100), text(300)
    runs = [text(150) + passage + text(150) for _ in range(40)]
    runs += [text(50) + longer + text(50) for _ in range(3)] + [runs[0][:390] + b"?", longer]
    starts = [len(r) - 199 for r in runs]
    cut = suffix._repeating(runs, starts, 200)
    assert {k for k, _, _ in cut} == {0, 40, 41, 42, 43, 44}
    assert sum(len(runs[k][a : b + 400]) for k, a, b in cut) < sum(map(len, runs)) / 5
    want = [[sum(r[p : p + 200] == q[x : x + 200] for q in runs for x in range(len(q) - 199)) > 1 for p in range(len(r) - 199)] for r in runs]
    got = [[False] * n for n in starts]
    for k, a, b in cut:
        got[k][a : b + 1] = [True] * (b + 1 - a)
    assert got == want  # what repeats is in one piece a run here
    sizes = np.array([len(x) for x in want])
    found, n = suffix._ranges(np.concatenate(want), sizes)
    assert n.tolist() == [int(any(x)) for x in want] and found.tolist() == [[a, b] for _, a, b in cut]


def test_suffix_over_many_blocks(spark, docs, texts, monkeypatch):
    # blocks of a document or two: what repeats does so across blocks, and arrays find it
    monkeypatch.setattr(suffix, "BLOCK_BYTES", 500)
    monkeypatch.setattr(common, "FAN", 2)
    want = sorted(brute.suffix(list(enumerate(texts)), 60))
    for hot in (suffix.HOT, 3):  # and with most anchors too frequent for a shard's array
        got = suffix.suffix_dedup(docs, width=60, report=40, hot=hot).collect()
        assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == want


def test_two_level_exchange(spark, docs, texts, monkeypatch):
    monkeypatch.setattr(common, "FAN", 2)
    assert common.shards_for(spark, 0).fan < common.shards_for(spark, 0).n
    got = substring.substring_dedup(docs, window=12, seed=8).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == sorted(brute.substring(list(enumerate(texts)), 12))
    want = brute.bigram_scores(list(enumerate(texts)), 4.0)
    for r in lm.lm_scores(docs).collect():
        n, known, total, base, score = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total) and abs(r.base_score - base) < 1e-8 and abs(r.score - score) < 1e-8


def test_requests_grow_in_proportion():
    keys = np.sort(suffix.mix(np.arange(300, dtype=np.uint64)))[:, None]
    ones = np.ones(300, np.int64)
    for n in (8, 500, 10**4, 10**6, 10**9):
        fan = n if n <= common.FAN else int(np.ceil(np.sqrt(n)))
        rows = common.request_rows(0, keys, ones, common.Shards(n, fan))
        assert len(rows) <= min(300, fan) and sum(r["n"] for r in rows) == 300
        assert np.array_equal(np.concatenate([common.unpack_keys(r["keys"], r["n"], 1) for r in rows]), keys)


def test_counts_beyond_32_bits():
    for most in (0, 255, 65535, 1 << 31, 1 << 33, (1 << 63) - 1):
        x = np.array([0, most, 1, most // 2], np.int64)
        assert np.array_equal(common.unpack_ints(common.pack_ints(x), 4), x)


def test_very_long_texts(spark):
    rng = random.Random(11)
    long = " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(250_000))
    df = frame(spark, [long, "a short one", long, None])
    n = len(long)
    assert sorted((r.doc_id, r.n_words, r.n_removed) for r in substring.substring_dedup(df).collect()) == [(0, 250_000, 250_000), (1, 3, 0), (2, 250_000, 250_000), (3, 0, 0)]
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans) for r in suffix.suffix_dedup(df).collect()) == [(0, n, n, 1), (1, 11, 0, 0), (2, n, n, 1), (3, 0, 0, 0)]
    assert {r.doc_id: r.n_tokens for r in lm.lm_scores(df).collect()} == {0: 250_001, 1: 4, 2: 250_001, 3: 1}
    assert {r.doc_id: r.component_id for r in minmax.near_duplicates(df).collect()} == {0: 0, 1: 1, 2: 0, 3: 3}
    assert {r.doc_id: r.group_size for r in exact.exact_dedup(df).collect()} == {0: 2, 1: 1, 2: 2, 3: 1}


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates(spark, seed, empty):
    texts = corpus(seed, 80)
    base = " ".join(f"w{i}" for i in range(200))
    rng = random.Random(seed)
    for _ in range(25):
        w = base.split()
        for _ in range(4):
            w[rng.randrange(200)] = "edit%d" % rng.randrange(1000)
        texts.append(" ".join(w))
    texts.append(base.upper())
    got = minmax.near_duplicates(frame(spark, texts)).collect()
    want = brute.near(list(enumerate(texts)))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    if seed == 1:
        assert minmax.near_duplicates(empty).count() == 0
        kept = minmax.keep_one(frame(spark, texts))
        assert kept.columns == [x.split()[0] for x in SCHEMA.split(", ")] and sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c in want.values()})


def test_near_duplicates_that_miss_the_pivot(spark):
    # 45 of 128 four-bit signature values of this pair differ, at a similarity of exactly 0.75
    held = [f"w1499x{i}" for i in range(70)], [f"w1499x{i}" for i in range(60)] + [f"w1499y{i}" for i in range(10)]
    sets = [minmax.shingles(" ".join(w).encode(), 1) for w in held]
    sig = minmax.signatures(sets)
    agree = np.repeat((minmax.bands(sig)[0] == minmax.bands(sig)[1]), 2 * minmax.PERMS_PER_BAND)
    assert agree.any()
    # a set of the shared bands' extreme shingles alone is in all their buckets, and links with neither
    ends = set(sig[0][agree].tolist())
    extreme = [w for w in held[0] if ends & set(minmax.signatures([minmax.shingles(w.encode(), 1)])[0][agree].tolist())]
    assert len(extreme) < 45
    texts = [" ".join(extreme), *(" ".join(w) for w in held)]
    got = {r.doc_id: r.component_id for r in minmax.near_duplicates(frame(spark, texts), 75, 1).collect()}
    assert got == {0: 0, 1: 1, 2: 1} == {i: c for i, (_, c) in brute.near(list(enumerate(texts)), 75, 1).items()}


def test_parities_never_exceed_the_difference():
    pool = minmax.mix(np.arange(5000, dtype=np.uint64))
    for n, new in ((3, 1), (60, 20), (63, 4), (1000, 250), (4000, 900)):
        a, b = pool[:n], pool[new : n + 2 * new]
        x, y = sorted((minmax.parities(a), minmax.parities(b)), key=len)
        if len(y) > len(x):
            y = y[: len(x)] ^ y[len(x) :]
        apart = int(np.unpackbits((x ^ y).view(np.uint8)).sum())
        assert 0 < apart <= 3 * new and len(x) * 64 <= 4 * max(16, n)


def test_signatures_are_unbiased():
    rng = np.random.default_rng(3)
    pool = minmax.mix(np.arange(3000, dtype=np.uint64))
    rates = []
    for _ in range(40):
        rng.shuffle(pool)
        a, b = np.sort(pool[:1000]), np.sort(pool[200:1200])
        s = minmax.signatures([a, b])
        rates.append((s[0] == s[1]).mean())
    assert abs(np.mean(rates) - 800 / 1200) < 0.02


def test_components(spark):
    rng = random.Random(4)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 340)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = brute.groups({x for p in links for x in p}, links)
    assert got == {k: v for k, v in want.items() if any(k in p and p[0] != p[1] for p in links)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("keep", ["min", "max"])
def test_exact(spark, texts, docs, keep, empty):
    group = {}
    for i, t in enumerate(texts):
        group.setdefault(t or "", []).append(i)
    edge = frame(spark, ["a"] * 4 + ["b"], [-(1 << 63), -(1 << 63) + 1, 5, (1 << 63) - 1, -(1 << 63)])
    best = -(1 << 63) if keep == "min" else (1 << 63) - 1
    assert sorted((r.doc_id, r.keep_id, r.group_size) for r in exact.exact_dedup(edge, keep).collect()) == sorted([(-(1 << 63), -(1 << 63), 1), *((i, best, 4) for i in (-(1 << 63), -(1 << 63) + 1, 5, (1 << 63) - 1))])
    for r in exact.exact_dedup(docs, keep=keep, fan_in=2).collect():
        g = group[texts[r.doc_id] or ""]
        best = min(g) if keep == "min" else max(g)
        assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (best, len(g), best == r.doc_id, hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest())
    assert exact.exact_dedup(empty).count() == 0
    odd = frame(spark, ["a", "a", "b", "a", "c", "c"], [3, None, None, 3, 5, 4])
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact.exact_dedup(odd, keep).collect()), key=str)
    one = 4 if keep == "min" else 5
    assert got == sorted([(3, 3, 3, True), (3, 3, 3, True), (None, 3, 3, False), (None, None, 1, True), (4, one, 2, one == 4), (5, one, 2, one == 5)], key=str)
    assert sorted((r.doc_id, r.text) for r in exact.keep_one(odd, keep).filter("doc_id is not null").collect()) == [(3, "a"), (one, "c")]


def test_scores(spark, texts, docs, empty):
    want = brute.bigram_scores(list(enumerate(texts)), 4.0)
    for r in lm.lm_scores(docs).collect():
        n, known, total, base, score = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (n, known, total, brute.held_out(r.doc_id))
        assert abs(r.base_score - base) < 1e-8 and abs(r.score - score) < 1e-8
    assert lm.lm_scores(empty).count() == 0
    assert all(r.score <= 0 for r in lm.lm_scores(docs, order=3).collect())


def test_packing(spark, texts, docs, empty):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = str(P.path("word_bpe_49k.json"))
    tok = Tokenizer.from_file(path)
    more = [*texts, "don't IT'S 'll", "x<|endoftext|>y Z", "İstanbul ΣΑΣ ẞ", "BİLGİ.", "TÜRKİYE'NİN YENİ İLİ, SERGİSİ!", "H̱ é É", "tab\there 123 4a ...!!!", "\x00 a\x00b", "Ÿ ÿ Ö ö ß"]
    got = packing.pack(frame(spark, more), path, length=64).toPandas()
    for i, t in enumerate(more):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        g = got[got.doc_id == i].sort_values("start")
        assert (g.doc_tokens == len(ids)).all() and g.length.sum() == len(ids)
        assert all(zlib.crc32(ids[a : a + n].tobytes()) == c for a, n, c in zip(g.start, g.length, g.ids_crc32))
    flat = got.sort_values(["sequence_id", "offset"])
    at = flat.sequence_id * 64 + flat.offset
    assert (at.to_numpy() == np.cumsum([0, *flat.length[:-1]])).all() and (flat.offset + flat.length <= 64).all()
    assert packing.pack(empty, path).count() == 0


def test_tokens_of_every_letter_before_a_mark():
    P = pytest.importorskip("public_tokenizers")
    import unicodedata

    tok = packing.WordTokens(str(P.path("word_bpe_49k.json")))
    letters = [chr(c) for c in range(1, 0x30000) if unicodedata.category(chr(c))[0] in "LM"]
    words = [f"{a}{c}{m}" for c, a, m in zip(letters, "bBé" * len(letters), ".,;!'*-" * len(letters))]
    lines = [" ".join(words[i : i + 100]) for i in range(0, len(words), 100)]
    ids, n = tok.encode(pa.array(lines), 1)
    for line, got in zip(lines, ids.to_pylist()):
        assert np.frombuffer(got, "<u4").tolist() == [*tok.tokenizer.encode(line, add_special_tokens=False).ids, 1]


def test_mixing(spark, empty):
    rng = random.Random(6)
    texts = [" ".join(["w"] * rng.randint(0, 9)) for _ in range(3000)] + [None, ""]
    df = frame(spark, texts)
    a, b = (mixing.mix_sources(x).toPandas().sort_values("doc_id").reset_index(drop=True) for x in (df, df.repartition(7)))
    assert a.equals(b) and len(a) == len(texts) and (a.taken <= 2 * a["size"]).all()
    of = df.toPandas().set_index("doc_id").source
    by = a.assign(source=a.doc_id.map(of)).groupby("source", dropna=False).agg(size=("size", "sum"), target=("target", "first"), taken=("taken", "sum"))
    assert abs(by.target.sum() - min(1.5, 2) * by["size"].sum()) < 1e-6 and (by.target <= 2 * by["size"] + 1e-9).all()
    assert (abs(by.taken - by.target) <= 20).all()
    taken = mixing.mixed_documents(df)
    assert taken.columns == df.columns
    n = taken.toPandas().groupby("doc_id").size()
    assert (n == (a.set_index("doc_id").taken / a.set_index("doc_id")["size"].replace(0, 1)).loc[n.index]).all()
    assert mixing.mix_sources(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0


def test_embeddings(spark):
    rng = np.random.default_rng(7)
    x = rng.standard_normal((150, 16))
    x[50:80] = x[:30] + 0.1 * rng.standard_normal((30, 16))
    x[80:100] = x[0] + 0.25 * rng.standard_normal((20, 16))
    x[100:105] = x[7]
    rows = [(i, [float(v) for v in np.float32(r)], 0) for i, r in enumerate(x)]
    rows += [(200, None, 0), (201, [0.0] * 16, 0), (202, [float("nan")] * 16, 0), (203, [], 0), (204, [1.0, 2.0], 0), (205, [None] * 16, 0), (206, [2.0, 4.0], 1)]
    got = {r.vec_id: r for r in embed.embedding_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)).collect()}
    v = np.float32(x).astype(float)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    links = [(i, j) for i, j in zip(*np.nonzero(v @ v.T >= 0.9)) if i != j] + [(204, 206), (206, 204)]
    comp = brute.groups([r[0] for r in rows], links)
    for i, *_ in rows:
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (sum(a == i for a, _ in links), comp[i], comp[i] == i), i
    assert embed.embedding_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_embeddings_over_many_chunks(spark, monkeypatch):
    """Tiles write nothing but links: scratch tables and shuffles stay a small multiple of the vectors."""
    rng = np.random.default_rng(9)
    x = rng.standard_normal((1200, 64))
    x[300:360] = x[0] + 0.1 * rng.standard_normal((60, 64))  # cells of many near copies
    x[360:500] = x[rng.integers(0, 300, 140)] + 0.3 * rng.standard_normal((140, 64))
    x[500:520] = 3 * x[1]
    x = np.float32(x).astype(float)
    x[520:540] = x[2] * (1 + 1e-12 * np.arange(20)[:, None])  # single precision doesn't hold these
    rows = [(i, r.tolist()) for i, r in enumerate(x)] + [(2000 + i, r.tolist()) for i, r in enumerate(x[:40, :7])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    monkeypatch.setattr(embed, "CHUNK", 100)
    monkeypatch.setattr(embed, "STRIP", 64, raising=False)
    monkeypatch.setattr(embed, "CELL", 8, raising=False)
    plans, size = {}, {}

    def stored(table, tag, *args):
        plans[tag] = table._jdf.queryExecution().executedPlan().toString()
        out = common.stored(table, tag, *args)
        path = out._scratch_path.removeprefix("file:")
        size[tag] = sum(os.path.getsize(os.path.join(path, f)) for f in os.listdir(path))
        return out

    monkeypatch.setattr(embed, "stored", stored)
    got = {r.vec_id: r for r in embed.embedding_duplicates(df).collect()}
    links = []
    for first, v in ((0, x), (2000, x[:40, :7])):
        v = v / np.linalg.norm(v, axis=1, keepdims=True)
        links += [(first + i, first + j) for i, j in zip(*np.nonzero(v @ v.T >= 0.9)) if i != j]
    comp, n = brute.groups([i for i, _ in rows], links), pd.Series([a for a, _ in links]).value_counts()
    for i, _ in rows:
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (n.get(i, 0), comp[i], comp[i] == i), i
    assert "CartesianProduct" in plans["embed-links"] and "Exchange" not in plans["embed-links"]
    assert sum(size.values()) < 3 * 4 * x.size, size


def labelled(n=400):
    rng = random.Random(8)
    syllables = ["ba", "co", "di", "fu", "ge", "li", "mo", "nu", "ra", "te"]
    word = lambda: "".join(rng.choices(syllables, k=rng.randint(1, 4)))
    texts, toxic, good = [], [], []
    for k in range(n):
        w = [word() for _ in range(rng.randint(20, 60))]
        bad, junk = k % 5 == 0, k % 4 == 1
        if bad:
            w[rng.randrange(len(w))] = rng.choice(["wretched", "numskull", "halfwit"])
        t = " ".join(w)
        texts.append((t.upper() + " !!! ") * 2 if junk else t + ".")
        toxic.append(int(bad))
        good.append(int(not junk))
    return texts, toxic, good


def test_toxicity(spark, empty):
    texts, toxic, _ = labelled()
    labels = spark.createDataFrame([(i, 1, t) for i, t in enumerate(toxic)], "doc_id long, quality int, toxic int")
    extra = ["", None, "ba co wret-ched di", "ba co w.r.e.t.c.h.e.d di", "co nums7kull ge", "co halfxwit ge", "h a l f w i t co", "ba co di fu ge li mo"]
    got = {r.doc_id: r for r in toxicity.toxicity(frame(spark, texts + extra), labels).collect()}
    assert all(r.held_out == brute.held_out(i, 3, 1) for i, r in got.items())
    held = [i for i in range(len(texts)) if got[i].held_out]
    assert np.mean([got[i].predicted == toxic[i] for i in held]) > 0.97
    score = [got[len(texts) + k].score for k in range(len(extra))]
    assert max(score[0], score[1], score[7]) < 0.5 and min(score[2:7]) > 0.5, score
    assert toxicity.toxicity(empty, labels).count() == 0
    assert {r.predicted for r in toxicity.toxicity(frame(spark, extra), labels.limit(0)).collect()} == {0}


def test_kernel_and_margins():
    words = ["wretched", "wret7ched", "halfwit", "half", "abc", "ab", "numskull"]
    want = np.array([[brute.kernel(x, y, toxicity.LAMBDA) for y in words] for x in words])
    assert np.allclose(toxicity.kernel(pa.array(words), pa.array(words)), want, atol=1e-5)
    texts, toxic, _ = labelled()
    model = toxicity.train(pa.array(texts), np.array(toxic))
    a, b = model["scale"]
    for t in [*texts[:40], "", "halfxwit co", "h a l f w i t"]:
        units = ["".join(c for c in w.lower() if not c in '!"#$%&\'()*+,-./:;<=>?@[\\]^_`{|}~') for w in t.split()]
        units = ["".join(units)] if units and all(len(u) == 1 for u in units) else units
        margins = [brute.margin(u, model["table"], model["bias"], toxicity.LAMBDA) for u in units] or [model["bias"]]
        want = 1 / (1 + np.exp(-(a * min(max(max(margins), -3), 1.25) + b)))
        assert abs(toxicity.score(pa.array([t]), model)[0] - want) < 1e-5, t


def test_quality_features():
    texts = [*labelled(40)[0], "", "A b\nc  C3!! x", "word word word " * 30, "é日本 ÉÀ ,,, #tag"]
    got = quality.content_view(pa.array(texts))[:, :18].astype(float)
    assert np.allclose(got, [brute.content(t) for t in texts], rtol=2e-3, atol=2e-3)
    page = quality.page_view(["en", None], ["s", "t"], [7, None])
    assert (page[:, :-1] > 0).sum() == 6 and page[0, -1] > 0 == page[1, -1]


def test_quality(spark, empty):
    texts, _, good = labelled()
    labels = spark.createDataFrame([(i, g, 0) for i, g in enumerate(good) if i % 2], "doc_id long, quality int, toxic int")
    df = frame(spark, [*texts, None, ""])
    got = {r.doc_id: r for r in quality.quality_scores(df, labels).collect()}
    assert np.mean([got[i].accepted == bool(g) for i, g in enumerate(good) if i % 2 == 0]) > 0.95
    kept = quality.accepted_documents(df, labels)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.accepted}
    assert quality.quality_scores(empty, labels).count() == 0
    assert {r.score for r in quality.quality_scores(df, labels.limit(0)).collect()} == {0.5}


def test_null_ids_and_repeats(spark):
    t = " ".join(f"w{i}" for i in range(80))
    df = frame(spark, [t, t, t, "x y", None], [4, None, 4, None, 9])
    assert sorted((r.doc_id or -1, r.n_removed) for r in substring.substring_dedup(df).collect()) == [(-1, 0), (-1, 80), (4, 80), (4, 80), (9, 0)]
    assert sorted((r.doc_id or -1, r.n_removed > 0) for r in suffix.suffix_dedup(df, 100).collect()) == [(-1, False), (-1, True), (4, True), (4, True), (9, False)]
    assert sorted(((r.doc_id, r.component_id, r.kept) for r in minmax.near_duplicates(df).collect()), key=str) == sorted([(4, 4, True), (None, 4, False), (4, 4, True), (None, None, False), (9, 9, True)], key=str)
    assert lm.lm_scores(df).count() == 5
    assert mixing.mix_sources(df).count() == 5
    assert toxicity.toxicity(df, spark.createDataFrame([], "doc_id long, toxic int")).count() == 5


def test_clashing_columns(spark):
    from pyspark.sql import functions as F

    texts = ["a b c d e f", "a b c d e f", "x y z", None]
    df, names = frame(spark, texts), ("id", "sha", "size", "rep", "key", "label", "component", "block", "copies", "target", "n", "vec", "shard")
    wide = df.select("*", *(F.lit("clash").alias(c) for c in names))
    labels = spark.createDataFrame([(0, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int").withColumn("text", F.lit("clash")).withColumn("source", F.lit("clash"))
    for run in (substring.substring_dedup, suffix.suffix_dedup, minmax.near_duplicates, exact.exact_dedup, lm.lm_scores, mixing.mix_sources):
        a, b = run(wide), run(df)
        assert a.columns == b.columns and sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    assert quality.quality_scores(wide, labels).count() == toxicity.toxicity(wide, labels).count() == 4
    for kept in (exact.keep_one(wide), minmax.keep_one(wide), mixing.mixed_documents(wide), quality.accepted_documents(wide, labels)):
        assert kept.columns == wide.columns and all(r["size"] == "clash" for r in kept.collect())


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="no test tables")
def test_queries_match_sql(spark):
    import duckdb

    from sparkloom.llm import queries

    con = duckdb.connect()
    for f in os.listdir(TABLES):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{TABLES}/{f}'")
    for name, sql in queries.ORACLES.items():
        got, want = queries.QUERIES[name](spark, TABLES), con.sql(sql)
        assert sorted(got.columns) == sorted(want.columns), name
        cols = sorted(want.columns)
        a = sorted(tuple(r[c] for c in cols) for r in got.collect())
        b = sorted(tuple(r[want.columns.index(c)] for c in cols) for r in want.fetchall())
        assert a == b, name


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="no test tables")
def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{TABLES}/documents.parquet")
    names, sizes = docs.columns, [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.toPandas()
        docs = stage(spark, docs, TABLES)
        after = docs.toPandas()
        sizes.append(len(after))
        if k == 1:
            assert set(after.doc_id) == set(before.groupby("text").doc_id.max())
        if k == 2:
            want = brute.near(list(zip(before.doc_id.tolist(), before.text.tolist())))
            assert set(after.doc_id) == {c for _, c in want.values()}
        if k == 3:
            assert after.groupby("doc_id").size().max() <= 2 and set(after.doc_id) <= set(before.doc_id)
        if k < 4:
            assert docs.columns == names
            docs = spark.createDataFrame(after, docs.schema)
    assert sizes[0] >= sizes[1] >= sizes[2] >= sizes[3] and sizes[5] >= sizes[4]
    assert set(after.doc_id) == set(before.doc_id)
