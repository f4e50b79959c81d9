"""Suffix-array dedup of byte strings: induced sorting over shards of the corpus.

``suffix_array`` classifies suffixes as S or L, sorts the leftmost-S (LMS) substrings by induction, sorts
the reduced string of their names by itself in the same way, until all names differ, and induces the whole
array in two linear passes.  ``common_prefixes`` computes the permuted LCP array from its irreducible values.

Anchors decide what text meets in a shard: of the grams in a window of ``report`` bytes the one with the least
hash.  Equal windows have equal anchors, so a string can only repeat if its anchor is at two places.  A run
is the windows in a row that share such an anchor, with the text that they and the strings of ``width``
bytes from them cover; all runs of an anchor go to one shard.  There equal runs are one from the start, and
the shard's suffix array and permuted LCP tell how far each start's text agrees with another start's; starts
before and after all those of a run whose windows' hashes occur twice repeat nothing, and stay out.  A
block sends a run once, however often it holds it.  The runs of an anchor at HOT places or more would be too
much for one shard: their strings are compared by 128-bit hashes, spread over the shards by the hash.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLOCK_BYTES, REPLY, REQUEST, counted, discard, distinct, exchange, mix, pack_ints, pack_keys, per_block, request_rows, rolling, shard_of, shards_for, slices, stored, tidy, to_blocks, totals_of, tune, unpack, unpack_ints, unpack_keys, with_replies

GRAM_SHARE = 0.25
ARRAY_BYTES = 1 << 20
HOT = 8192
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BYTE2 = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
_SEPARATOR = 255  # no byte of UTF-8

# ---------------------------------------------------------------- suffix arrays


def _types(t: np.ndarray) -> np.ndarray:
    """True where a suffix is of type S.  The last symbol is the only 0."""
    n = len(t)
    step = np.sign(np.diff(t.astype(np.int32)))
    at = np.where(step != 0, np.arange(n - 1), n)
    following = np.minimum.accumulate(at[::-1])[::-1] if n > 1 else at
    out = np.ones(n, bool)
    out[:-1] = step[np.minimum(following, n - 2)] > 0 if n > 1 else []
    return out


def _spread(items: np.ndarray, symbols: np.ndarray, pending: list[list[np.ndarray]]) -> None:
    """Append items to the buckets of their symbols, in order."""
    if not len(items):
        return
    order = np.argsort(symbols, kind="stable")
    items, symbols = items[order], symbols[order]
    cuts = np.flatnonzero(np.diff(symbols)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(items)]):
        pending[symbols[a]].append(items[a:b])


def _join(parts: list[np.ndarray]) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def _induce_in_waves(t: np.ndarray, is_s: np.ndarray, lms: np.ndarray, n_symbols: int) -> np.ndarray:
    """``_induce`` a bucket at a time: all entries of a bucket's front induce at once."""
    of_lms: list[list[np.ndarray]] = [[] for _ in range(n_symbols)]
    _spread(lms, t[lms], of_lms)
    to_l: list[list[np.ndarray]] = [[] for _ in range(n_symbols)]
    of_l: list[np.ndarray] = []
    for c in range(n_symbols):
        wave, got = _join(to_l[c]), []
        while len(wave):
            got.append(wave)
            before = wave[wave > 0] - 1
            before = before[~is_s[before]]
            same = t[before] == c
            _spread(before[~same], t[before[~same]], to_l)
            wave = before[same]
        to_l[c] = []
        of_l.append(_join(got))
        before = _join(of_lms[c])
        before = before[before > 0] - 1
        _spread(before, t[before], to_l)
    to_s: list[list[np.ndarray]] = [[] for _ in range(n_symbols)]
    to_s[0].append(np.array([len(t) - 1]))
    out = []
    for c in range(n_symbols - 1, -1, -1):
        wave, got = _join(to_s[c]), []
        while len(wave):
            got.append(wave)
            if c == 0:
                break
            before = wave[wave > 0] - 1
            before = before[is_s[before]]
            same = t[before] == c
            _spread(before[~same], t[before[~same]], to_s)
            wave = before[same]
        to_s[c] = []
        out.append(_join(got)[::-1])
        back = of_l[c][::-1]
        before = back[back > 0] - 1
        before = before[is_s[before]]
        _spread(before, t[before], to_s)
        out.append(of_l[c])
    return _join(out[::-1])


def _induce(t: np.ndarray, is_s: np.ndarray, lms: np.ndarray, n_symbols: int) -> np.ndarray:
    """The suffix array that follows from LMS suffixes in the order ``lms`` within their buckets, in two linear passes."""
    n = len(t)
    # an operation or so per bucket, and per symbol of the longest run, pays if that is little against a step per place
    if 64 * (n_symbols + np.diff(np.flatnonzero(np.diff(t)), prepend=-1).max()) < n:
        return _induce_in_waves(t, is_s, lms, n_symbols)
    stop = np.cumsum(np.bincount(t, minlength=n_symbols))
    symbols = t[lms]
    order = np.argsort(symbols, kind="stable")
    after = np.cumsum(np.bincount(symbols, minlength=n_symbols))  # LMS suffixes up to each bucket
    bucket = symbols[order]
    sa = np.full(n, n)
    sa[stop[bucket] - after[bucket] + np.arange(len(lms))] = lms[order]
    # the symbol before each place, where the suffix from it is of type L, and of type S; n stands for no suffix
    before = np.concatenate([[0], t[:-1], [0]])
    s_before = np.concatenate([[False], is_s[:-1], [False]])
    none = np.ones(n + 1, bool)
    none[1:n] = False
    sa = sa.tolist()
    symbol, at = np.where(none | s_before, -1, before).tolist(), np.concatenate([[0], stop[:-1]]).tolist()
    for j in sa:  # sees the entries that it adds further on
        c = symbol[j]
        if c >= 0:
            h = at[c]
            sa[h] = j - 1
            at[c] = h + 1
    symbol, at = np.where(none | ~s_before, -1, before).tolist(), stop.tolist()
    for j in reversed(sa):
        c = symbol[j]
        if c >= 0:
            h = at[c] = at[c] - 1
            sa[h] = j - 1
    return np.array(sa)


def _equal_runs(data: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Length of the common prefix of data[a:] and data[b:], up to ``most``, eight bytes at a time."""
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    eights = np.ndarray((len(data) + 8,), "<u8", padded.data, strides=(1,))
    length, active = np.zeros(len(a), np.int64), np.arange(len(a))
    while len(active):
        l = length[active]
        x = eights[a[active] + l] ^ eights[b[active] + l]
        low = x & (np.uint64(0) - x)
        l += np.where(x == 0, 8, np.where(x == 0, 0, np.log2(np.maximum(low, 1).astype(np.float64)).astype(np.int64) >> 3))
        length[active] = l
        active = active[(x == 0) & (l < most[active])]
    return np.minimum(length, most)


def _induced(t: np.ndarray, is_s: np.ndarray, at_lms: np.ndarray, size: np.ndarray, n_symbols: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the LMS substrings in order, by induction, and where one differs from that before it."""
    place = np.zeros(len(t), np.int64)
    place[at_lms] = np.arange(1, len(at_lms) + 1)
    ranked = place[_induce(t, is_s, at_lms, n_symbols)]
    ranked = ranked[ranked > 0] - 1
    size = size[ranked]
    pair = np.flatnonzero(size[1:] == size[:-1])
    spans = size[pair]
    offset = np.cumsum(spans) - spans
    inside = np.arange(spans.sum()) - np.repeat(offset, spans)
    alike = t[np.repeat(at_lms[ranked[pair]], spans) + inside] == t[np.repeat(at_lms[ranked[pair + 1]], spans) + inside]
    new = np.ones(len(ranked), bool)
    if len(pair):
        new[pair + 1] = ~np.logical_and.reduceat(alike, offset)
    return ranked, new


def _refined(t: np.ndarray, at_lms: np.ndarray, size: np.ndarray, n_symbols: int) -> tuple[np.ndarray, np.ndarray]:
    """What ``_induced`` gives, for short substrings of many symbols: those that tie are sorted by a symbol more, in turn.

    Where one is the beginning of another, the longer goes on downwards (or it would end there too) and comes first.
    """
    order, group = np.argsort(t[at_lms], kind="stable"), np.zeros(len(at_lms), np.int64)
    at, key, more = np.arange(len(at_lms)), t[at_lms[order]], np.ones(len(at_lms), bool)
    depth = 1
    while len(at):
        first = np.append(True, key[1:] != key[:-1])
        group[at] = np.maximum.accumulate(np.where(first, at, 0))
        tied = ~(first & np.append(first[1:], True)) & more
        at = at[tied]
        items = order[at]
        more = depth < size[items]
        symbol = np.where(more, t[np.minimum(at_lms[items] + depth, len(t) - 1)], n_symbols)
        key = group[at] * (n_symbols + 1) + symbol
        by = np.argsort(key, kind="stable")
        order[at], key, more = items[by], key[by], more[by]
        depth += 1
    return order, group == np.arange(len(at_lms))


def _sorted_suffixes(t: np.ndarray, n_symbols: int) -> np.ndarray:
    """Suffix array of a string of symbols below ``n_symbols``, all of which occur if there are as many as places.  The last symbol
    is the only 0."""
    if n_symbols == len(t):
        out = np.empty(len(t), np.int64)
        out[t] = np.arange(len(t))
        return out
    is_s = _types(t)
    at_lms = np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1
    size = np.append(np.diff(at_lms) + 1, 1)  # of LMS substrings: each goes up to the next one's start, which it shares
    short = 64 * n_symbols >= len(t) and size.max() <= max(64, len(t) >> 6)  # a pass per symbol of the longest
    ranked, new = _refined(t, at_lms, size, n_symbols) if short else _induced(t, is_s, at_lms, size, n_symbols)
    name = np.empty(len(ranked), np.int64)
    name[ranked] = np.cumsum(new) - 1
    order = _sorted_suffixes(name, int(new.sum()))
    return _induce(t, is_s, at_lms[order], n_symbols)


def suffix_array(data: np.ndarray) -> np.ndarray:
    """Suffix array of uint8 ``data``, without the empty suffix."""
    return _sorted_suffixes(np.append(data.astype(np.int64) + 1, 0), 257)[1:] if len(data) else np.zeros(0, np.int64)


def common_prefixes(data: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """Permuted LCP: for each place, the common prefix of its suffix with the suffix before it in the array."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    phi = np.full(n, -1, np.int64)
    phi[sa[1:]] = sa[:-1]
    has = phi >= 0
    left = np.zeros(n, bool)
    inner = np.arange(n) > 0
    inner &= phi > 0
    at = np.flatnonzero(inner)
    left[at] = (data[at - 1] == data[phi[at] - 1]) & (phi[at - 1] == phi[at] - 1)
    irreducible = np.flatnonzero(has & ~left)
    known = _equal_runs(data, irreducible, phi[irreducible], n - np.maximum(irreducible, phi[irreducible]))
    out = np.zeros(n, np.int64)
    out[irreducible] = known
    last = np.maximum.accumulate(np.where(has & ~left, np.arange(n), -1))
    rest = np.flatnonzero(left)
    out[rest] = out[last[rest]] - (rest - last[rest])
    return out


def agreements(texts: list[bytes], starts: list[int]) -> np.ndarray:
    """For the first starts[k] places of each text k, in turn: the longest prefix of the text from there that also
    starts at another of these places, of this text or another."""
    lengths = np.array([len(t) + 1 for t in texts], np.int64)
    data = np.frombuffer(b"".join(x for t in texts for x in (t, bytes([_SEPARATOR]))), np.uint8)
    ends = np.cumsum(lengths)
    begins = ends - lengths
    left = np.repeat(ends - 1, lengths) - np.arange(len(data))
    real = np.arange(len(data)) - np.repeat(begins, lengths) < np.repeat(np.array(starts, np.int64), lengths)
    sa = suffix_array(data)
    # what two real places in a row of the array agree in: the least of the steps between them
    at = np.flatnonzero(real[sa])
    out = np.zeros(len(data), np.int64)
    if len(at) > 1:
        steps = common_prefixes(data, sa)[sa][: at[-1] + 1]
        between = np.minimum.reduceat(steps, at[:-1] + 1)
        place = sa[at]
        out[place[1:]] = between
        out[place[:-1]] = np.maximum(out[place[:-1]], between)
    return np.minimum(out, left)[real]


# ---------------------------------------------------------------- anchors


def _sliding(x: np.ndarray, w: int, op: np.ufunc, fill: int) -> np.ndarray:
    """op over every run of ``w`` values, in linear time."""
    n = len(x)
    if n < w:
        return x[:0]
    rows = np.concatenate([x, np.full(-n % w, fill, x.dtype)]).reshape(-1, w)
    prefix = op.accumulate(rows, axis=1).ravel()
    suffix = op.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(suffix[: n - w + 1], prefix[w - 1 : n])


def _anchors(data: np.ndarray, ends: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of the windows inside one text, the anchor of every window, and the grams' hashes."""
    gram = max(1, int(window * GRAM_SHARE))
    grams = rolling(_BYTE[data], gram)
    least = _sliding(grams, window - gram + 1, np.minimum, (1 << 64) - 1)
    starts = np.flatnonzero(np.arange(len(least)) + window <= ends[: len(least)])
    return starts, least, grams


def _anchor_keys(starts: np.ndarray, least: np.ndarray, grams: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct anchors of the windows, hashed again (least hashes are small, and would crowd the first shards), and
    the places of each."""
    if not len(starts):
        return np.zeros((0, 1), np.uint64), np.zeros(0, np.int64)
    w = window - max(1, int(window * GRAM_SHARE)) + 1
    valid = np.zeros(len(least), np.uint64)
    valid[starts] = least[starts]
    pad = np.zeros(w - 1, np.uint64)
    highest = _sliding(np.concatenate([pad, valid, pad]), w, np.maximum, 0)[: len(grams)]
    return counted(mix(grams[highest == grams])[:, None])


def _window_keys(data: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """128-bit keys of the strings of ``width`` bytes from sorted ``starts``."""
    if not len(starts):
        return np.zeros((0, 2), np.uint64)
    cuts = np.flatnonzero(np.diff(starts) > 1) + 1
    first, last = starts[np.concatenate([[0], cuts])], starts[np.concatenate([cuts - 1, [len(starts) - 1]])]
    spans = last - first + width
    offset = np.cumsum(spans) - spans
    text = data[np.repeat(first - offset, spans) + np.arange(spans.sum())]
    at = np.repeat(offset - first, last - first + 1) + starts
    return np.stack([rolling(_BYTE[text], width, 0)[at], rolling(_BYTE2[text], width, 1)[at]], axis=1)


def _text(row) -> tuple[list, list[bytes], np.ndarray, np.ndarray]:
    ids, texts = unpack(row)
    sizes = np.array([len(t) for t in texts], np.int64)
    return ids, texts, np.frombuffer(b"".join(texts), np.uint8), np.repeat(np.cumsum(sizes), sizes)


def _ints(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x, dtype="<i4").tobytes()


def _framed(*parts: bytes) -> bytes:
    return b"".join(x for p in parts for x in (len(p).to_bytes(4, "little"), p))


def _unframed(data: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(data):
        n = int.from_bytes(data[at : at + 4], "little")
        out.append(data[at + 4 : at + 4 + n])
        at += 4 + n
    return out


def _run_rows(block: int, anchors: np.ndarray, texts: list[bytes], starts: np.ndarray, twice: np.ndarray, fan: int) -> list[dict]:
    """Rows of REQUEST for a block's distinct runs, in the order of their anchors."""
    import zstandard

    out = []
    for s, a, b in slices(shard_of(anchors, fan)):
        body = zstandard.ZstdCompressor(level=1).compress(b"".join(texts[a:b]))
        sizes = np.array([len(t) for t in texts[a:b]], np.int64)
        out.append({"shard": s, "part": _RUNS, "block": block, "n": b - a, "keys": pack_keys(anchors[a:b, None]), "counts": _framed(pack_ints(sizes), pack_ints(starts[a:b]), pack_ints(twice[a:b]), body)})
    return out


def _judge_runs(pdf: pd.DataFrame, width: int, report: int) -> pd.DataFrame:
    """For each run that a shard was sent, the ranges of starts from which ``width``, and ``report``, bytes repeat."""
    import zstandard

    index: dict[bytes, int] = {}
    anchors, n_starts, twice, places = [], [], [], []
    for n, keys, rest in zip(pdf["n"], pdf["keys"], pdf["counts"]):
        sizes, starts, again, body = _unframed(rest)
        sizes, again = unpack_ints(sizes, n), unpack_ints(again, n)
        body = zstandard.ZstdDecompressor().decompress(body, max_output_size=max(1, int(sizes.sum())))
        ends = np.cumsum(sizes).tolist()
        own = []
        for anchor, a, b, k, more in zip(unpack_keys(keys, n, 1)[:, 0].tolist(), [0, *ends], ends, unpack_ints(starts, n).tolist(), again.tolist()):
            place = index.setdefault(body[a:b], len(index))
            if place == len(anchors):
                anchors.append(anchor)
                n_starts.append(k)
                twice.append(more > 0)
            else:
                twice[place] = True
            own.append(place)
        places.append(own)
    texts = list(index)
    order = np.argsort(np.array(anchors, np.uint64), kind="stable")
    groups = slices(np.array(anchors, np.uint64)[order].view(np.int64))
    ranges = [[np.zeros((0, 2), np.int64)] * len(texts) for _ in (width, report)]
    held: list[int] = []
    size = 0

    def repeat_whole(members: list[int]) -> None:
        for of, w in zip(ranges, (width, report)):
            for k in members:
                n = min(n_starts[k], len(texts[k]) - w + 1)
                of[k] = np.array([[0, n - 1]] if n > 0 else np.zeros((0, 2)), np.int64)

    def sort_held() -> None:
        cut = _repeating([texts[k] for k in held], [n_starts[k] for k in held], report)
        if cut:
            sizes = np.array([b - a + 1 for _, a, b in cut], np.int64)
            # the strings of ``width`` bytes that may repeat, and those of ``report`` bytes
            far = {i: b + width for i, _, b in _repeating([texts[k] for k in held], [max(0, min(n_starts[k], len(texts[k]) - width + 1)) for k in held], width)}
            got = agreements([texts[held[i]][a : max(b + report, far.get(i, 0))] for i, a, b in cut], sizes.tolist())
            for of, w in zip(ranges, (width, report)):
                found, n = _ranges(got >= w, sizes)
                for (i, a, _), x in zip(cut, np.split(found, np.cumsum(n)[:-1])):
                    of[held[i]] = x + a
        repeat_whole([k for k in held if twice[k]])  # a run that is at two places

    for _, a, b in groups:
        members = order[a:b].tolist()
        if all(twice[k] for k in members):
            repeat_whole(members)
            continue
        if held and size + sum(len(texts[k]) for k in members) > ARRAY_BYTES:
            sort_held()
            held, size = [], 0
        held += members
        size += sum(len(texts[k]) for k in members)
    if held:
        sort_held()
    out = []
    for own in places:
        parts = []
        for r in ranges:
            mine = [r[k] for k in own]
            parts += [pack_ints(np.array([len(x) for x in mine], np.int64)), pack_ints(np.concatenate([np.zeros(0, np.int64), *(x.ravel() for x in mine)]))]
        out.append(_framed(*parts))
    tidy()
    return pd.DataFrame({"block": pdf["block"].to_numpy(), "part": _RUNS, "shard": pdf["shard"].to_numpy(), "n": pdf["n"].to_numpy(), "totals": out, "known": 0, "mass": 0})


def _ranges(mask: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, last) of the runs of a mask in parts of these sizes, counted from the part's start, and how many a part has."""
    of, offset = np.repeat(np.arange(len(sizes)), sizes), np.cumsum(sizes) - sizes
    edge = np.zeros(len(mask) + 1, bool)
    edge[offset] = edge[-1] = True
    first = np.flatnonzero(mask & (edge[:-1] | ~np.append(False, mask[:-1])))
    last = np.flatnonzero(mask & (edge[1:] | ~np.append(mask[1:], False)))
    return np.stack([first, last], axis=1) - offset[of[first]][:, None], np.bincount(of[first], minlength=len(sizes))


def _repeating(texts: list[bytes], starts: list[int], width: int) -> list[tuple[int, int, int]]:
    """What an array must hold: (text, first, last) of the starts whose strings of ``width`` bytes may be at two starts.

    Equal strings have equal hashes, so no repeat is missed; the array tells which of these do repeat, and how far."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    lengths, n = np.array([len(t) for t in texts], np.int64), np.array(starts, np.int64)
    of, offset = np.repeat(np.arange(len(texts)), n), np.cumsum(n) - n
    place = np.arange(len(of)) - offset[of]
    hashes = rolling(_BYTE[data], width)[(np.cumsum(lengths) - lengths)[of] + place]
    order = np.argsort(hashes)
    alike = np.diff(hashes[order]) == 0
    again = np.zeros(len(of), bool)
    again[order[1:][alike]] = again[order[:-1][alike]] = True
    at = np.flatnonzero(again)
    return [(k, int(place[at[a]]), int(place[at[b - 1]])) for k, a, b in slices(of[at])]


def _covered(first: np.ndarray, last: np.ndarray, width: int, n: int) -> np.ndarray:
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, first, 1)
    np.subtract.at(edge, last + width, 1)
    return np.cumsum(edge[:-1]) > 0


_STATE, _RUNS, _HOT_WIDTH, _HOT_REPORT = -1, 0, 1, 2
OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_repeated long, spans array<struct<start:long,stop:long>>"


def suffix_dedup(docs: DataFrame, width: int = 400, report: int = 256, hot: int = HOT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove every byte that a repeated string of ``width`` bytes covers.

    Texts are UTF-8 bytes; strings never cross rows, and are judged on the input.  Returns per row: the id,
    n_bytes, n_removed, n_spans, kept_sha256 (of the remaining bytes), n_repeated (bytes that a repeated
    string of ``report`` <= ``width`` bytes covers: those stay in the text) and spans (maximal removed runs,
    [start, stop)).

    Null and empty texts have no bytes and the digest of the empty string; shorter texts than ``width`` are
    kept; repeated rows are rows of their own, so their strings repeat.  Null ids stay null.  An empty table
    gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    tune(spark)
    report = min(report, width)
    blocks = stored(to_blocks(docs, id_col, text_col, 2 * BLOCK_BYTES), "suffix-blocks", "none")
    size = blocks.agg(F.sum(F.length("payload"))).first()[0] or 0
    shards = shards_for(spark, size)
    run_shards = shards_for(spark, 8 * size).n

    def seeds(row):
        _, _, data, ends = _text(row)
        return request_rows(int(row.block), *_anchor_keys(*_anchors(data, ends, report), report), shards)

    anchors = stored(exchange(per_block(blocks, seeds, REQUEST), shards, 1, (2, hot)), "suffix-anchors", "none")

    def send(row, replies):
        _, _, data, ends = _text(row)
        starts, least, _ = _anchors(data, ends, report)
        if not len(starts):
            return []
        # windows in a row with the same anchor are of one kind; the anchors are those that were asked for
        cuts = np.flatnonzero((np.diff(starts) > 1) | (least[starts[1:]] != least[starts[:-1]])) + 1
        first, last = starts[np.concatenate([[0], cuts])], starts[np.concatenate([cuts - 1, [len(starts) - 1]])]
        name = mix(least[first])
        kind = totals_of(replies)[distinct(name[:, None])[1]]
        a, b = first[kind == 2], last[kind == 2]
        many = np.repeat(a - (np.cumsum(b - a + 1) - (b - a + 1)), b - a + 1) + np.arange((b - a + 1).sum())
        first, last, name = first[kind == 1], last[kind == 1], name[kind == 1]
        index: dict[bytes, int] = {}
        run_of, found, n_starts = [], [], []
        raw = data.tobytes()
        for a, b, stop, anchor in zip(first.tolist(), last.tolist(), ends[first].tolist(), name.tolist()):
            text = raw[a : min(b + width, stop)]
            k = index.setdefault(text, len(index))
            if k == len(found):
                found.append(anchor)
                n_starts.append(b - a + 1)
            run_of.append(k)
        texts, found = list(index), np.array(found, np.uint64)
        order = np.argsort(found, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        run_of = np.array(run_of, np.int64)
        twice = (np.bincount(run_of, minlength=len(texts)) > 1).astype(np.int64)
        state = {"shard": -1, "part": _STATE, "block": int(row.block), "n": len(first), "keys": _ints(np.stack([first, rank[run_of]], axis=1)), "counts": _ints(many)}
        out = [state, *_run_rows(int(row.block), found[order], [texts[k] for k in order.tolist()], np.array(n_starts, np.int64)[order], twice[order], run_shards)]
        for part, w in ((_HOT_WIDTH, width), (_HOT_REPORT, report)):
            out += request_rows(int(row.block), *counted(_window_keys(data, many[many + w <= ends[many]], w)), shards, part) if len(many) else []
        return out

    sent = stored(with_replies(blocks, anchors, send, REQUEST), "suffix-runs", "none")
    discard(anchors)
    state = sent.filter(F.col("part") == _STATE).selectExpr("block", "part", "shard", "n", "keys as totals", "0L as known", "0L as mass", "counts as many")
    # the number of tasks goes by the work, which the bytes say little about
    judged = sent.filter(F.col("part") == _RUNS).repartition(run_shards, "shard").groupBy("shard").applyInPandas(lambda pdf: _judge_runs(pdf, width, report), REPLY)
    by_hash = exchange(sent.filter(F.col("part") > _RUNS), shards, 2, (2,))
    answers = stored(judged.unionByName(by_hash).withColumn("many", F.lit(None).cast("binary")), "suffix-judged", "none")

    def finish(row, got):
        ids, texts, data, ends = _text(row)
        marks = [np.zeros((0, 2), np.int64)] * 2
        head = got[got["part"] == _STATE]
        if len(head):
            first, run = np.frombuffer(head["totals"].iloc[0], "<i4").reshape(-1, 2).astype(np.int64).T
            many = np.frombuffer(head["many"].iloc[0], "<i4").astype(np.int64)
            replies = [_unframed(x) for x in got[got["part"] == _RUNS].sort_values("shard")["totals"]]
            ns = got[got["part"] == _RUNS].sort_values("shard")["n"].tolist()
            for i, (w, part) in enumerate(((width, _HOT_WIDTH), (report, _HOT_REPORT))):
                counts = np.concatenate([np.zeros(0, np.int64), *(unpack_ints(r[2 * i], n) for r, n in zip(replies, ns))])
                pairs = [unpack_ints(r[2 * i + 1], 2 * int(unpack_ints(r[2 * i], n).sum())) for r, n in zip(replies, ns)]
                pairs = np.concatenate([np.zeros(0, np.int64), *pairs]).reshape(-1, 2)
                offset = np.cumsum(counts) - counts
                take = counts[run]
                which = np.repeat(offset[run] - (np.cumsum(take) - take), take) + np.arange(take.sum())
                marks[i] = pairs[which] + np.repeat(first, take)[:, None]
                own = many[many + w <= ends[many]] if len(many) else many
                if len(own):
                    hit = own[(totals_of(got[got["part"] == part]) > 0)[distinct(_window_keys(data, own, w))[1]]]
                    marks[i] = np.concatenate([marks[i], np.stack([hit, hit], axis=1)])
        gone, repeated = (_covered(m[:, 0], m[:, 1], w, len(data)) for m, w in zip(marks, (width, report)))
        out, at = [], 0
        for i, t in zip(ids, texts):
            mask = gone[at : at + len(t)]
            k = int(mask.sum())
            edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]]))) if k else np.zeros(0, np.int64)
            kept = data[at : at + len(t)][~mask].tobytes() if k else t
            spans = [{"start": int(a), "stop": int(b)} for a, b in zip(edges[::2], edges[1::2])]
            out.append((i, len(t), k, len(edges) // 2, hashlib.sha256(kept).hexdigest(), int(repeated[at : at + len(t)].sum()), spans))
            at += len(t)
        return pd.DataFrame(out, columns=[x.split()[0] for x in OUT.split(", ")]).astype({"doc_id": "Int64"})

    out = with_replies(blocks, state.unionByName(answers), finish, OUT)
    return out.withColumnRenamed("doc_id", id_col) if id_col != "doc_id" else out
