"""Repeated passages across documents by suffix sorting.

Every 50-byte window has a minimizer, the least hash of its 16-byte strings, and equal windows
have equal ones. Neighbouring windows with one minimizer form a segment. Minimizers that occur in
one document alone cannot repeat and are left out. A segment that an earlier document has as a whole
is settled by 112 bits, those of its minimizer and of its own hash, without its text. The different segments of a
minimizer, one copy of each, are dealt by minimizer, so that all equal windows meet in one shard, and
are sorted by suffix there (see `induced`): windows in one run of common prefixes of 50 bytes or more
are equal. A minimizer with very many different segments is divided: their windows get a second
minimizer by another hash, which equal windows share too. Parts are sized by the bytes of the input.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches
from .induced import sorted_suffixes
from .minhash import mix, powers

#: Bytes of a window, and of the strings whose hashes make the minimizer.
WINDOW, GRAM = 50, 16
#: Segments that a task gathers before it sends their minimizers on.
CHUNK = 1 << 19
#: Rows of packed segments in one Arrow batch: some hundred KB each.
SENT = 8
#: Bytes of text whose segments are computed at once (one text may be longer): arrays of eight bytes for each byte of it.
AT_ONCE = 1 << 19
#: Bytes of a minimizer and of a segment's hash on the way: together they tell segments apart.
KEY_BYTES, HASH_BYTES = 6, 8
#: What is found out about 2^NEIGHBOURS ids next to each other travels in one row per part.
NEIGHBOURS = 6


@dataclass(frozen=True)
class Limits:
    """Bytes of text for each part of an exchange; different segments of a minimizer that is not divided; bytes of
    segments that are sorted together (a minimizer's may be more); suffixes that a sort holds in memory before its queues go to disk."""

    part: int = 1 << 25
    hot: int = 1 << 14
    shard: int = 1 << 21
    queue: int = 1 << 18


_BYTES = mix(np.arange(256, dtype=np.uint64) + np.uint64(77))
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
#: What is known of a segment: an earlier document has it, its minimizer has others too, or very many others.
_SETTLED, _MIXED, _HOT = 0, 1, 2


def segments(texts: list[bytes], again: bool = False) -> tuple[np.ndarray, ...]:
    """(minimizer, text's place in the list, first byte, end, hash of the segment) of every segment, in order.

    `again` takes the minimizers by another hash.
    """
    data = b"".join(texts)
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if len(data) < WINDOW:
        return none
    words = np.ndarray((len(data) - 7,), "<u8", buffer=data, strides=(1,))
    h = words[:-8] * (_B if again else _A) + words[8:] * (_C if again else _B)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    low = h ^ (h >> np.uint64(29))
    width, wanted = 1, WINDOW - GRAM + 1
    while 2 * width <= wanted:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < wanted:
        low = np.minimum(low[:len(low) - (wanted - width)], low[wanted - width:])
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(sizes)
    place = np.repeat(np.arange(len(texts)), sizes)[:len(low)]
    at = np.flatnonzero(np.arange(len(low)) + WINDOW <= ends[place])
    if not len(at):
        return none
    low, place = low[at], place[at]
    new = np.flatnonzero(np.r_[True, (low[1:] != low[:-1]) | (place[1:] != place[:-1])])
    last = np.append(new[1:], len(at)) - 1
    start, a, b = (ends - sizes)[place[new]], at[new], at[last] + WINDOW
    power, inverse = powers(len(data))
    sums = np.cumsum(np.concatenate((np.zeros(1, np.uint64), _BYTES[np.frombuffer(data, np.uint8)] * power)), dtype=np.uint64)
    whole = mix((sums[b] - sums[a]) * inverse[a] + (b - a).astype(np.uint64))
    return low[new], place[new], a - start, b - start, whole


def slices(texts: list[bytes]) -> Iterator[slice]:
    """Neighbouring texts of about AT_ONCE bytes together."""
    first = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > AT_ONCE:
            yield slice(first, i)
            first, size = i, 0
        size += len(t)
    if first < len(texts):
        yield slice(first, len(texts))


def _joined(held: list[np.ndarray]) -> np.ndarray:
    """The arrays as one; the list is emptied, so that they are not held beside it."""
    out = np.concatenate(held)
    held.clear()
    return out


def _bytes(x: np.ndarray) -> bytes:
    return x.tobytes()


def _short(x: np.ndarray, size: int) -> bytes:
    """The low bytes of unsigned 64-bit numbers."""
    return np.ascontiguousarray(x, "<u8").view(np.uint8).reshape(-1, 8)[:, :size].tobytes()


def _long(packed: bytes, size: int) -> np.ndarray:
    raw = np.frombuffer(packed, np.uint8).reshape(-1, size)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :size] = raw
    return out.view("<u8").ravel()


def _rows(names: list[str], types: list[pa.DataType], rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)


def _grouped(keys: np.ndarray) -> Iterator[tuple[int, int]]:
    edges = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True]) if len(keys) else np.zeros(1, int)
    return zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)


def repeated_segments(docs: DataFrame, parts: int, limits: Limits) -> DataFrame:
    """(doc, settled, mixed, hot): packed hashes of a document's segments, one row per document that has any.

    A settled segment occurs in a document with a smaller id. A mixed one is the first of its kind,
    but its minimizer has other segments, in several documents: it may share windows with them. A
    hot one is a mixed one of a minimizer with more than `limits.hot` different segments. A
    task sends each of its segments once, for its smallest document; the other documents' are
    settled at once and go straight to the document's part.
    """

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> Iterator[pa.RecordBatch]:
            key, whole, doc = _joined(keys), _joined(wholes), _joined(owners)
            order = np.lexsort((doc, whole, key))
            key, whole, doc = key[order], whole[order], doc[order]
            del order
            first = np.r_[True, (whole[1:] != whole[:-1]) | (key[1:] != key[:-1])]
            fresh = first | np.r_[True, doc[1:] != doc[:-1]]
            fresh &= first | (doc > np.repeat(doc[first], np.diff(np.append(np.flatnonzero(first), len(doc)))))
            key, whole, doc, first = key[fresh], whole[fresh], doc[fresh], first[fresh]
            part = ((np.where(first, key, doc.astype(np.uint64) * _A) >> np.uint64(20)) % np.uint64(parts)).astype(np.int32)
            order = np.lexsort((doc, first, part))
            key, whole, doc, first, part = key[order], whole[order], doc[order], first[order], part[order].astype(np.int64)
            del order, fresh
            spans = list(_grouped(part * 2 + first))
            for i in range(0, len(spans), SENT):
                rows = [
                    (int(part[a]), bool(first[a]), _short(key[a:b], KEY_BYTES) if first[a] else None, _short(whole[a:b], HASH_BYTES), _bytes(doc[a:b]))
                    for a, b in spans[i:i + SENT]
                ]
                yield _rows(["part", "first", "keys", "wholes", "docs"], [pa.int32(), pa.bool_(), pa.binary(), pa.binary(), pa.binary()], rows)

        keys, wholes, owners, held = [], [], [], 0
        for b in batches:
            ids = np.array(b.column(0).to_pylist(), np.int64)
            texts = [(t or "").encode() for t in b.column(1).to_pylist()]
            for some in slices(texts):
                key, place, _, _, whole = segments(texts[some])
                keys.append(key)
                wholes.append(whole)
                owners.append(ids[some][place])
                held += len(key)
                if held >= CHUNK:
                    yield from flush()
                    held = 0
        if held:
            yield from flush()

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, wholes, docs_ = [], [], []
        ready: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for b in batches:
            for first, k, w, d in zip(*(b.column(i).to_pylist() for i in (1, 2, 3, 4)), strict=True):
                w, d = _long(w, HASH_BYTES), np.frombuffer(d, np.int64)
                if first:
                    keys.append(_long(k, KEY_BYTES))
                    wholes.append(w)
                    docs_.append(d)
                else:
                    ready.append((d, w, np.zeros(len(d), np.uint8)))
        if keys:
            k, w, d = _joined(keys), _joined(wholes), _joined(docs_)
            order = np.lexsort((d, w, k))
            k, w, d = k[order], w[order], d[order]
            del order
            new_key = np.r_[True, k[1:] != k[:-1]]
            new_whole = new_key | np.r_[True, w[1:] != w[:-1]]
            at_key, at_whole = np.flatnonzero(new_key), np.flatnonzero(new_whole)
            late = d > np.repeat(d[at_whole], np.diff(np.append(at_whole, len(d))))
            different = np.add.reduceat(new_whole.astype(np.int64), at_key)
            several = (different > 1) & (np.minimum.reduceat(d, at_key) < np.maximum.reduceat(d, at_key))
            kind = np.where(several, np.where(different > limits.hot, _HOT, _MIXED), _SETTLED).astype(np.uint8)
            kind = np.where(late, np.uint8(_SETTLED), np.repeat(kind, np.diff(np.append(at_key, len(d)))))
            use = late | (kind != _SETTLED)
            ready.append((d[use], w[use], kind[use]))
        if ready:
            d, w, m = map(_joined, map(list, zip(*ready, strict=True)))
            ready.clear()
            order = np.argsort(d, kind="stable")
            d, w, m = d[order], w[order], m[order]
            del order
            spans = list(_grouped(d >> NEIGHBOURS))
            for i in range(0, len(spans), 1024):
                yield _rows(
                    ["near", "docs", "wholes", "mixed"], [pa.int64(), pa.binary(), pa.binary(), pa.binary()],
                    [(int(d[a] >> NEIGHBOURS), _bytes(d[a:b]), _short(w[a:b], HASH_BYTES), _bytes(m[a:b])) for a, b in spans[i:i + 1024]],
                )

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> pa.RecordBatch:
            d, w, m = (np.concatenate([h[i] for h in held]) for i in range(3))
            order = np.argsort(d, kind="stable")
            d, w, m = d[order], w[order], m[order]
            return _rows(
                ["doc", "settled", "mixed", "hot"], [pa.int64(), pa.binary(), pa.binary(), pa.binary()],
                [(int(d[a]), *(_short(w[a:b][m[a:b] == kind], HASH_BYTES) for kind in (_SETTLED, _MIXED, _HOT))) for a, b in _grouped(d)],
            )

        at, held = None, []
        for b in batches:
            for near, d, w, m in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if near != at:
                    if held:
                        yield rows()
                    at, held = near, []
                held.append((np.frombuffer(d, np.int64), _long(w, HASH_BYTES), np.frombuffer(m, np.uint8)))
        if held:
            yield rows()

    sent = docs.select("doc", "text").mapInArrow(gather, "part int, first boolean, keys binary, wholes binary, docs binary")
    replies = sent.repartition(parts, "part").mapInArrow(match, "near long, docs binary, wholes binary, mixed binary")
    dealt = replies.repartition(parts, "near").sortWithinPartitions("near")
    return dealt.mapInArrow(unpack, "doc long, settled binary, mixed binary, hot binary")


def _member(values: np.ndarray, packed: bytes) -> np.ndarray:
    """Which values are among packed hashes, by the bytes that these keep."""
    table = np.sort(_long(packed, HASH_BYTES))
    if not len(table):
        return np.zeros(len(values), bool)
    values = values & np.uint64((1 << 8 * HASH_BYTES) - 1)
    return table[np.minimum(np.searchsorted(table, values), len(table) - 1)] == values


def _cut(joined: DataFrame) -> DataFrame:
    """Of (doc, hash, text, found): the mixed segments with their text, and the settled spans of each row."""
    names = ["key", "doc", "hash", "start", "text", "spans"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, hashes, texts, found = (b.column(i).to_pylist() for i in range(4))
            every = [(t or "").encode() if f else b"" for t, f in zip(texts, found, strict=True)]
            del texts
            for some in slices(every):
                raw = every[some]
                key, place, start, end, whole = segments(raw)
                out = []
                edges = np.searchsorted(place, np.arange(len(raw) + 1))
                for p, wanted in enumerate(found[some]):
                    a, z = edges[p], edges[p + 1]
                    if not wanted or a == z:
                        continue
                    doc, h, data = ids[some.start + p], hashes[some.start + p], raw[p]
                    hit = _member(whole[a:z], wanted["settled"])
                    if hit.any():
                        spans = _merged(np.stack((start[a:z][hit], end[a:z][hit]), 1))
                        out.append((None, doc, h, None, None, spans.astype("<i4").tobytes()))
                    hit = np.flatnonzero(_member(whole[a:z], wanted["hot"])) + a
                    second, which, begin, stop, _ = segments([data[start[i]:end[i]] for i in hit.tolist()], again=True)
                    divided = mix(key[hit][which] ^ second).view(np.int64)
                    for k, s, e in zip(divided.tolist(), (start[hit][which] + begin).tolist(), (start[hit][which] + stop).tolist(), strict=True):
                        out.append((k, doc, h, s, data[s:e], None))
                    hit = np.flatnonzero(_member(whole[a:z], wanted["mixed"])) + a
                    for k, s, e in zip(key[hit].view(np.int64).tolist(), start[hit].tolist(), end[hit].tolist(), strict=True):
                        out.append((k, doc, h, s, data[s:e], None))
                yield _rows(names, types, out)

    # all columns go in, so that no column is pruned and the exchange of the rows can be used again
    first = ("doc", "hash", "text", "found")
    return joined.select(*first, *[c for c in joined.columns if c not in first]).mapInArrow(run, "key long, doc long, hash long, start int, text binary, spans binary")


def _pack_spans(doc: np.ndarray, hashes: np.ndarray, start: np.ndarray, end: np.ndarray) -> Iterator[pa.RecordBatch]:
    order = np.lexsort((start, hashes, doc))
    doc, hashes = doc[order], hashes[order]
    both = np.stack((start[order], end[order]), 1).astype("<i4")
    spans = list(_grouped_pairs(doc, hashes))
    for i in range(0, len(spans), 4096):
        yield _rows(
            ["doc", "hash", "spans"], [pa.int64(), pa.int64(), pa.binary()],
            [(int(doc[a]), int(hashes[a]), both[a:b].tobytes()) for a, b in spans[i:i + 4096]],
        )


def _grouped_pairs(x: np.ndarray, y: np.ndarray) -> Iterator[tuple[int, int]]:
    edges = np.flatnonzero(np.r_[True, (x[1:] != x[:-1]) | (y[1:] != y[:-1]), True]) if len(x) else np.zeros(1, int)
    return zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)


def repeated_windows(texts: list[bytes], owner: np.ndarray, bound: int) -> np.ndarray:
    """For each byte of the joined texts (with a separator after each): the smallest owner of the equal windows
    that start there; the text's own owner where no window fits. The sort holds `bound` suffixes in memory."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    joined = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8).astype(np.uint16) + 2
    ends = np.cumsum(sizes + 1) - 1
    joined[ends] = 1
    owners, rank = np.unique(owner, return_inverse=True)
    least = np.repeat(rank.astype(np.int32), sizes + 1)
    fits = np.append(np.arange(WINDOW, len(joined) + WINDOW, dtype=np.int32) <= np.repeat(ends.astype(np.int32), sizes + 1), False)
    carry: list[np.ndarray] = []
    for positions, prefix in sorted_suffixes(joined, bound=bound):
        # a run of windows goes on into the next chunk while the common prefix reaches over a window
        ok = fits[positions]
        group = np.cumsum(prefix < WINDOW)
        positions, group = positions[ok], group[ok]
        if carry and len(positions) and group[0] == 0 and prefix[0] >= WINDOW:
            head = positions[group == 0]
            carry.append(head)
            if group[-1] == 0:
                continue
            positions, group = positions[len(head):], group[len(head):]
        if carry:
            run = np.concatenate(carry)
            least[run] = least[run].min()
            carry = []
        if not len(positions):
            continue
        first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        low = np.minimum.reduceat(least[positions], first)
        least[positions] = np.repeat(low, np.diff(np.append(first, len(positions))))
        carry = [positions[first[-1]:]]
    if carry:
        run = np.concatenate(carry)
        least[run] = least[run].min()
    return owners[least]


def _sharing(texts: list[bytes]) -> np.ndarray:
    """Which texts have a window whose hash occurs again: the others need no sorting."""
    if not texts:
        return np.zeros(0, bool)
    hashes, owners = [], []
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    cuts = np.searchsorted(np.cumsum(sizes), np.arange(1 << 20, sizes.sum(), 1 << 20))
    for first, last in zip([0, *cuts.tolist()], [*cuts.tolist(), len(texts)], strict=True):  # about 1 MB each
        size = sizes[first:last]
        data = np.frombuffer(b"".join(texts[first:last]), np.uint8)
        power, inverse = powers(len(data))
        sums = np.cumsum(np.concatenate((np.zeros(1, np.uint64), _BYTES[data] * power)), dtype=np.uint64)
        at = np.flatnonzero(np.arange(len(data)) + WINDOW <= np.repeat(np.cumsum(size), size))
        hashes.append((sums[at + WINDOW] - sums[at]) * inverse[at])
        owners.append(np.repeat(np.arange(first, last, dtype=np.int32), size)[at])
    windows, place = np.concatenate(hashes), np.concatenate(owners)
    ordered = np.sort(windows)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    out = np.zeros(len(texts), bool)
    if len(twice):
        out[place[twice[np.minimum(np.searchsorted(twice, windows), len(twice) - 1)] == windows]] = True
    return out


def _shards(order: np.ndarray, group: np.ndarray, size: np.ndarray, shard: int) -> Iterator[np.ndarray]:
    """Cuts `order`, sorted by group, between groups so that a part has about `shard` bytes."""
    if not len(order):
        return
    upto = np.cumsum(size[order])
    ends = np.flatnonzero(np.append(group[order][1:] != group[order][:-1], True)) + 1
    start = done = 0
    for e in ends.tolist():
        if upto[e - 1] - done >= shard or e == len(order):
            yield order[start:e]
            start, done = e, upto[e - 1]


def _settle(found: DataFrame, parts: int, limits: Limits) -> DataFrame:
    """(doc, hash, spans): packed spans of bytes that repeat from a smaller document, in pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: dict[bytes, int] = {}
        segs: list[bytes] = []
        keys: list[int] = []
        which, docs, hashes, starts = [], [], [], []
        for b in batches:
            passed = []
            for k, d, h, s, t, spans in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if t is None:
                    passed.append((d, h, spans))
                    continue
                i = table.setdefault(t, len(segs))
                if i == len(segs):
                    segs.append(t)
                    keys.append(k)
                which.append(i)
                docs.append(d)
                hashes.append(h)
                starts.append(s)
            yield _rows(["doc", "hash", "spans"], [pa.int64(), pa.int64(), pa.binary()], passed)
        table.clear()
        out = [np.zeros((0, 4), np.int64)]
        if segs:
            w, d, h, s = (np.array(x, np.int64) for x in (which, docs, hashes, starts))
            owner = np.full(len(segs), np.iinfo(np.int64).max)
            np.minimum.at(owner, w, d)
            size = np.fromiter(map(len, segs), np.int64, len(segs))
            late = d > owner[w]
            out.append(np.stack((d[late], h[late], s[late], s[late] + size[w[late]]), 1))
            # segments that share their minimizer with another one are compared window by window
            key = np.array(keys, np.int64)
            _, back, count = np.unique(key, return_inverse=True, return_counts=True)
            mixed = np.flatnonzero(count[back] > 1)
            by_segment = np.argsort(w, kind="stable")
            edges = np.searchsorted(w[by_segment], np.arange(len(segs) + 1))
            mixed = mixed[_sharing([segs[i] for i in mixed])]
            for part in _shards(mixed[np.argsort(back[mixed], kind="stable")], back, size, limits.shard):
                least = repeated_windows([segs[i] for i in part], owner[part], limits.queue)
                begin = np.cumsum(size[part] + 1) - size[part] - 1
                for j, a in zip(part.tolist(), begin.tolist(), strict=True):
                    windows = least[a:a + size[j] - WINDOW + 1]
                    if windows.min() >= owner[j]:
                        continue
                    bad = np.flatnonzero(windows < owner[j])
                    cut = np.flatnonzero(np.diff(bad) > 1)
                    lo, hi = bad[np.r_[0, cut + 1]], bad[np.r_[cut, len(bad) - 1]]
                    for i in by_segment[edges[j]:edges[j + 1]].tolist():
                        if d[i] == owner[j]:
                            out.append(np.stack((np.full(len(lo), d[i]), np.full(len(lo), h[i]), s[i] + lo, s[i] + hi + WINDOW), 1))
        every = np.concatenate(out)
        if len(every):
            yield from _pack_spans(every[:, 0], every[:, 1], every[:, 2], every[:, 3])

    dealt = found.repartition(parts, F.coalesce("key", F.xxhash64("doc", "hash")))
    return dealt.mapInArrow(run, "doc long, hash long, spans binary")


def _merged(spans: np.ndarray) -> np.ndarray:
    """Maximal runs of (start, end) rows; touching ones are one run."""
    spans = spans[np.lexsort((spans[:, 1], spans[:, 0]))]
    top = np.maximum.accumulate(spans[:, 1])
    new = np.flatnonzero(np.r_[True, spans[1:, 0] > top[:-1]])
    return np.stack((spans[new, 0], top[np.append(new[1:], len(spans)) - 1]), 1)


def repeated_spans(rows: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(doc, spans): per document with repeats, an array of (hash of the text, packed int32 byte spans).

    `rows` has doc (an integer id) and text; a later left join of the result to the same `rows` by
    doc can use their exchange again.
    """
    spark = rows.sparkSession
    small_batches(spark)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // limits.part))
    found = repeated_segments(rows.filter("doc is not null"), parts, limits).select("doc", F.struct("settled", "mixed", "hot").alias("found"))
    joined = rows.join(found, "doc", "left").withColumn("hash", F.xxhash64("text"))
    return _settle(_cut(joined), parts, limits).groupBy("doc").agg(F.collect_list(F.struct("hash", "spans")).alias("spans"))


def _runs_of(hash_: int, found: list | None) -> np.ndarray:
    own = [np.frombuffer(x["spans"], "<i4").reshape(-1, 2) for x in (() if found is None else found) if x["hash"] == hash_]
    return _merged(np.concatenate(own)) if own else np.zeros((0, 2), np.int64)


def _without(data: bytes, runs: np.ndarray) -> bytes:
    if not len(runs):
        return data
    return b"".join(data[a:z] for a, z in np.r_[0, runs.ravel(), len(data)].reshape(-1, 2).tolist())


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", limits: Limits = Limits()) -> DataFrame:
    """doc, text_bytes, kept_bytes, spans (packed int32 pairs) of every row of `docs`.

    A byte goes if a 50-byte window over it also starts in a document with a smaller id, judged on
    the input. A null text counts as empty. Ids are integers: rows of one id are one document and
    do not repeat each other; a row with a null id is kept whole and removes nothing. Other columns
    are ignored.
    """
    names = ["doc", "text_bytes", "kept_bytes", "spans"]
    types = [pa.int64(), pa.int64(), pa.binary(), pa.binary()]

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc, text, h, found in zip(*(c.to_pylist() for c in b.columns), strict=True):
                data, runs = (text or "").encode(), _runs_of(h, found)
                out.append((doc, len(data), _without(data, runs), runs.astype("<i4").tobytes()))
            yield _rows(names, types, out)

    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    final = rows.join(repeated_spans(rows, limits), "doc", "left").select("doc", "text", F.xxhash64("text").alias("hash"), "spans")
    return final.mapInArrow(keep, "doc long, text_bytes long, kept_bytes binary, spans binary")


def strip_repeats(docs: DataFrame) -> DataFrame:
    """`docs` (doc_id, text, n_chars, ...) with the repeated bytes cut out of its texts; every row stays.

    A character of which a cut leaves a part only goes as a whole. A null text stays null; rows of one
    id are one document and all stay, as does a row with a null id; an empty table stays empty. Other
    columns are passed on.
    """

    @F.pandas_udf("string")
    def cut(text: pd.Series, hash_: pd.Series, found: pd.Series) -> pd.Series:
        out = []
        for t, h, f in zip(text, hash_, found, strict=True):
            runs = _runs_of(h, f)
            out.append(t if not len(runs) else _without(t.encode(), runs).decode("utf-8", "ignore"))
        return pd.Series(out, dtype=object)

    names = {c: f"_{i}" for i, c in enumerate(docs.columns) if c not in ("text", "n_chars")}  # n_chars is counted anew
    rows = docs.select(F.col("doc_id").cast("long").alias("doc"), "text", *[F.col(c).alias(n) for c, n in names.items()])
    joined = rows.join(repeated_spans(rows), "doc", "left")
    text = F.when(F.col("spans").isNull(), F.col("text")).otherwise(cut("text", F.xxhash64("text"), "spans"))
    done = joined.withColumn("text", text)
    size = F.length("text").cast("long")
    return done.select(*[F.col(c) if c == "text" else (size if c == "n_chars" else F.col(names[c])).alias(c) for c in docs.columns])


def repeat_report(docs: DataFrame) -> DataFrame:
    """Digests of `remove_repeats`: doc_id, n_bytes, n_removed, n_spans, kept_sha256, a row for each row of `docs`.

    A null text counts as empty; a row with a null id is kept whole; rows of one id do not repeat each
    other; an empty table gives an empty result.
    """
    return remove_repeats(docs).select(
        F.col("doc").alias("doc_id"), F.col("text_bytes").alias("n_bytes"),
        (F.col("text_bytes") - F.octet_length("kept_bytes")).cast("long").alias("n_removed"),
        (F.octet_length("spans") / 8).cast("long").alias("n_spans"), F.sha2("kept_bytes", 256).alias("kept_sha256"),
    )
