"""Near-duplicate documents by one-permutation MinHash.

Every distinct shingle set gets one hash per bin from a single permutation; empty bins borrow
from other bins by optimal densification. Rows of bins form banded buckets. A bucket is a star:
its members are compared with a hub, not with each other, and only where a bucket still holds
documents of several components are its members compared across them, by blocks inside tasks that
return a spanning forest of the links and no pairs. Every link is confirmed on full shingle sets. Small sets, for which few bins are filled, meet by
exact prefix filtering instead: two sets of the wanted similarity share one of their rarest
shingles.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, forget, materialize, may_be_among, small_batches

#: Similarity in percent, words of a shingle, bins, and rows of a band.
PERCENT, WORDS, BINS, BAND = 75, 5, 256, 6
#: Sets up to this size are found by their prefix; larger ones by bands. Sizes up to SMALL * 100 / PERCENT do both.
SMALL = 64
#: Hubs that the buckets of a document are spread over; members of a block where a bucket is compared by blocks.
HUBS, BLOCK = 4, 2048

_MULT = np.uint64(0x9E3779B97F4A7C15)
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LETTERS = np.arange(256)
_LETTERS[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


#: A random value for each byte, A-Z as a-z; powers of an odd multiplier and of its inverse.
_VALUES = mix(_LETTERS.astype(np.uint64) + np.uint64(11))
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        inverse = np.uint64(pow(int(_MULT), -1, 1 << 64))
        for k, base in enumerate((_MULT, inverse)):
            steps = np.full(n + n // 8, base)
            steps[0] = 1
            _POWERS[k] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS[0][:n], _POWERS[1][:n]


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """Sorted 64-bit hashes of the distinct 5-word shingles of each whole text.

    Words are runs without ASCII white space, A-Z lower-cased. A text of fewer words is one shingle
    of them all; a null text or one without words has none. All texts are hashed together: a word's
    hash is the difference of two prefix sums.
    """
    raw = [(t or "").encode() for t in texts]
    data = np.frombuffer(b"\n".join([b"", *raw, b""]), np.uint8)
    power, inverse = powers(len(data))
    space = _SPACE[data]
    sums = np.cumsum(_VALUES[data] * power, dtype=np.uint64)
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    start, end = edge[::2], edge[1::2]
    words = mix((sums[end - 1] - sums[start - 1]) * inverse[start] + (end - start).astype(np.uint64))
    begins = np.cumsum([1, *(len(r) + 1 for r in raw)])
    first = np.searchsorted(start, begins)
    n = max(0, len(words) - WORDS + 1)
    joined = words[:n].copy()
    for k in range(1, WORDS):
        joined = joined * _MULT + words[k:k + n]
    joined = mix(joined)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= WORDS:
            out.append(np.unique(joined[a:b - WORDS + 1]))
        elif b > a:
            h = np.uint64(b - a)
            for w in words[a:b]:
                h = mix(np.array([h]) * _MULT + w)[0]
            out.append(np.array([h], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def shingles(text: str | None) -> np.ndarray:
    return shingle_sets([text])[0]


@lru_cache(1)
def _donors() -> np.ndarray:
    """For optimal densification: the bins that an empty bin asks in turn, by a universal hash of (bin, try)."""
    b, t = np.meshgrid(np.arange(BINS, dtype=np.uint64), np.arange(4 * BINS, dtype=np.uint64), indexing="ij")
    return (mix(b * _MULT + t * np.uint64(0xD1B54A32D192ED03) + np.uint64(1)) % np.uint64(BINS)).astype(np.int64)


def signature(sets: np.ndarray) -> np.ndarray:
    """One value per bin from a single permutation, empty bins densified."""
    h = mix(sets + np.uint64(0x5851F42D4C957F2D))
    at = (h >> np.uint64(56)).astype(np.int64)
    out = np.full(BINS, _EMPTY, np.uint64)
    np.minimum.at(out, at, h)
    empty = out == _EMPTY
    if empty.any():
        ask = _donors()[empty]
        full = ~empty[ask]
        first = full.argmax(1)
        donor = np.where(full.any(1), ask[np.arange(len(ask)), first], np.flatnonzero(~empty)[0])
        out[empty] = mix(out[donor] + first.astype(np.uint64) * _MULT)
    return out


def bands(sets: np.ndarray) -> np.ndarray:
    """Bucket keys of the bands of a large set."""
    if len(sets) <= SMALL:
        return np.zeros(0, np.uint64)
    rows = signature(sets)[:BINS // BAND * BAND].reshape(-1, BAND)
    key = np.arange(len(rows), dtype=np.uint64) + np.uint64(1)
    for k in range(BAND):
        key = mix(key * _MULT + rows[:, k])
    return key


def is_small(n: int) -> bool:
    """Whether a set of this size can be similar to one of at most SMALL shingles."""
    return 0 < n * PERCENT <= SMALL * 100


def prefix(sets: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Bucket keys of a small set: its rarest shingles, one more than a similar set may lack."""
    rank = common[(sets >> np.uint64(40)).astype(np.int64) % len(common)]
    order = np.lexsort((sets, rank))
    n = len(sets)
    return mix(sets[order[:n - -(-n * PERCENT // 100) + 1]] ^ np.uint64(0xA0761D6478BD642F))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    if min(len(a), len(b)) * 100 < PERCENT * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= PERCENT * (len(a) + len(b) - both)


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    flat = np.concatenate([*arrays, np.zeros(0, np.uint64)]).astype(np.uint64).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, arrays)]), pa.int32()), pa.array(flat))


def _shingled(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, n_shingles, set_key (128 bits of the set), bands (bucket keys), small (the shingles of a small set)."""
    small_batches(docs.sparkSession)
    none = np.zeros(0, np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = shingle_sets(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                    _lists([bands(s) for s in sets]), _lists([s if is_small(len(s)) else none for s in sets]),
                ],
                ["id", "n_shingles", "set_key", "bands", "small"],
            )

    return docs.select(F.col(id_col).cast("long").alias("id"), text_col).mapInArrow(
        run, "id long, n_shingles long, set_key binary, bands array<bigint>, small array<bigint>"
    )


#: Slots that count how common the shingles of small sets are; the counts only order them.
SLOTS = 1 << 18


def _commonness(small: DataFrame) -> np.ndarray:
    """Bit length of the number of small sets per hash slot of a shingle: SLOTS bytes, whatever the input."""
    slot = F.pmod(F.shiftrightunsigned("s", 40), F.lit(SLOTS))
    counts = small.select(F.explode("small").alias("s")).groupBy(slot.cast("int").alias("slot")).count()

    def pack(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        row = np.zeros(4096, np.uint8)
        row[frame["slot"].to_numpy() % 4096] = np.ceil(np.log2(frame["count"].to_numpy() + 1)).astype(np.uint8)
        return pd.DataFrame({"part": [key[0]], "row": [row.tobytes()]})

    out = np.zeros((SLOTS // 4096, 4096), np.uint8)
    parts = counts.groupBy(F.floor(F.col("slot") / 4096).cast("int").alias("part"))
    for r in parts.applyInPandas(pack, "part int, row binary").collect():  # 64 rows
        out[r[0]] = np.frombuffer(bytes(r[1]), np.uint8)
    return out.reshape(-1)


def _prefixes(small: DataFrame) -> DataFrame:
    common = _commonness(small)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = [prefix(np.array(s, np.int64).view(np.uint64), common) for s in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), _lists(keys)], ["id", "keys"])

    return small.select("id", "small").mapInArrow(run, "id long, keys array<bigint>")


def confirm(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough; texts: (id, text), one row per id."""
    left = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    small_batches(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, _, ta, tb = (c.to_pylist() for c in batch.columns)
            hubs = {i: t for i, t in zip(a, ta, strict=True)}  # rows of a hub lie together: its set is built once
            hubs = dict(zip(hubs, shingle_sets(list(hubs.values())), strict=True))
            keep = [similar(hubs[i], s) for i, s in zip(a, shingle_sets(tb), strict=True)]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    joined = pairs.join(right, "b").join(left, "a").select("a", "b", "text_a", "text_b")
    return joined.mapInArrow(run, "a long, b long")


def _stars(members: DataFrame) -> DataFrame:
    """Candidate pairs (hub, member): every bucket's hub is its least member by a hash that differs in HUBS ways."""
    order = F.struct(F.xxhash64("id", F.pmod("bucket", F.lit(HUBS))).alias("h"), "id")
    hubs = members.groupBy("bucket").agg(F.min(order)["id"].alias("hub"))
    return members.join(hubs, "bucket").filter("id <> hub").select(
        F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")
    ).distinct()


def near_links(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(shingled rows, links): links connect all documents that are similar, through representatives.

    Rows of one shingle set are linked to the smallest id among them; representatives are linked by
    confirmed pairs (a < b). Links are enough to give the components of the full similarity graph.
    """
    rows = materialize(_shingled(docs, id_col, text_col))
    sets = rows.filter("n_shingles > 0 and id is not null")
    classes = sets.groupBy("set_key").agg(F.min("id").alias("rep"))
    same = sets.join(classes, "set_key").filter("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b")).distinct()
    reps = sets.join(classes, (sets["set_key"] == classes["set_key"]) & (sets["id"] == classes["rep"]), "left_semi")
    small = reps.filter(F.size("small") > 0)
    spread = reps.select("id", F.explode("bands").alias("bucket")).unionByName(
        _prefixes(small).select("id", F.explode("keys").alias("bucket"))
    ).distinct()
    shared = spread.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1").select("bucket")
    members = materialize(spread.join(shared, "bucket"))
    wanted = members.select("id").distinct()
    may = may_be_among(wanted)  # most texts share no bucket and stay where they are
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    texts = materialize(own.filter(may(F.col("id"))).join(wanted, "id", "left_semi"))
    found = materialize(confirm(_stars(members), texts))
    mixed = _mixed(members, found)
    links = materialize(found.unionByName(_across(mixed, texts)).unionByName(same))
    forget(members, texts, found, mixed)
    return rows, links


def _mixed(members: DataFrame, links: DataFrame) -> DataFrame:
    """(bucket, id, component) of the buckets that hold more than one component."""
    named = members.join(components(links), "id", "left").withColumn("component", F.coalesce("component", "id"))
    several = named.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("bucket")
    return materialize(named.select("bucket", "id", "component").join(several, "bucket"))


def _overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every left with every right set, by products of 0/1 matrices."""
    values, at = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    rows = np.repeat(np.arange(len(left) + len(right)), [len(x) for x in (*left, *right)])
    out = np.zeros((len(left), len(right)), np.float32)
    order = np.argsort(at, kind="stable")
    at, rows = at[order], rows[order]
    for lo in range(0, len(values), 8192):  # columns in slices, so that the matrices stay small
        a, b = np.searchsorted(at, [lo, lo + 8192])
        grid = np.zeros((len(left) + len(right), 8192), np.float32)
        grid[rows[a:b], at[a:b] - lo] = 1
        out += grid[:len(left)] @ grid[len(left):].T
    return out


def _block_links(ids: list[int], owners: np.ndarray, sets: list[np.ndarray], side: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links across components within a block (side is 0 throughout) or between two."""
    groups = [np.flatnonzero(side == k) for k in (0, 1)]
    if not len(groups[1]):
        groups[1] = groups[0]
    size = np.array([len(x) for x in sets], np.int64)
    parent: dict[int, int] = {}

    def find(v: int) -> int:
        while parent.setdefault(v, v) != v:
            parent[v] = v = parent[parent[v]]
        return v

    for i in range(0, len(groups[0]), 128):
        for j in range(0, len(groups[1]), 128):
            x, y = groups[0][i:i + 128], groups[1][j:j + 128]
            both = _overlaps([sets[k] for k in x], [sets[k] for k in y]).astype(np.int64)
            union = size[x][:, None] + size[y][None, :] - both
            for a, b in zip(*np.nonzero((100 * both >= PERCENT * union) & (owners[x][:, None] != owners[y][None, :])), strict=True):
                u, v = find(ids[x[a]]), find(ids[y[b]])
                if u != v:
                    parent[max(u, v)] = min(u, v)
    return [(find(v), v) for v in list(parent) if find(v) != v]


def _across(mixed: DataFrame, texts: DataFrame) -> DataFrame:
    """Links between different components of a bucket.

    Members of a bucket's largest component are connected already, so they meet the bucket's other
    members only; those meet all. Both kinds are cut into blocks of about BLOCK members, and a task
    compares one block with itself or with one other; what leaves it are at most as many links as
    the blocks have members.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([s.tobytes() for s in shingle_sets(b.column(1).to_pylist())], pa.binary())], ["id", "set"]
            )

    sets = texts.select("id", "text").mapInArrow(pack, "id long, set binary")
    sizes = mixed.groupBy("bucket", "component").agg(F.count("*").alias("n"))
    blocks = sizes.groupBy("bucket").agg(F.max(F.struct("n", "component")).alias("top"), F.sum("n").alias("n")).select(
        "bucket", F.col("top.component").alias("largest"), F.ceil(F.col("top.n") / BLOCK).alias("inner"),
        F.ceil((F.col("n") - F.col("top.n")) / BLOCK).alias("outer"),
    )
    own, other, inside, spot = F.col("own"), F.col("other"), F.col("component") == F.col("largest"), F.xxhash64("id")
    place = F.when(inside, F.pmod(spot, F.col("inner"))).otherwise(F.col("inner") + F.pmod(spot, F.col("outer")))
    partners = F.sequence(F.when(inside, F.col("inner")).otherwise(F.lit(0)), F.col("inner") + F.col("outer") - 1)
    rows = (
        mixed.join(blocks, "bucket").withColumn("own", place).withColumn("partners", partners).join(sets, "id")
        .withColumn("other", F.explode("partners"))
        .select("bucket", F.least(own, other).alias("lo"), F.greatest(own, other).alias("hi"), "id", "component", "set", (own > other).cast("int").alias("side"))
    )
    dealt = rows.repartition("bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def links() -> list[tuple[int, int]]:
            if len(held) < 2:
                return []
            sets_ = [np.frombuffer(r[2], np.uint64) for r in held]
            return _block_links([r[0] for r in held], np.array([r[1] for r in held]), sets_, np.array([r[3] for r in held]))

        def emit(found: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])

        for batch in batches:
            out: list[tuple[int, int]] = []
            for bucket, lo, hi, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (bucket, lo, hi) != key:
                    out += links()
                    key, held = (bucket, lo, hi), []
                held.append(row)
            yield emit(out)
        yield emit(links())

    return dealt.mapInArrow(run, "a long, b long")


def dedup_report(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable by links), kept, per row of `docs`.

    Texts that are null or without words have no shingles and stand alone. Ids are integers; a row
    with a null id links with nothing, has a null component and is kept. Other columns are ignored.
    """
    rows, links = near_links(docs, id_col=id_col, text_col=text_col)
    return (
        rows.select("id", "n_shingles").join(components(links), "id", "left")
        .select(
            F.col("id").alias(id_col), "n_shingles", F.coalesce("component", "id").alias("component_id"),
            F.coalesce(F.col("id") == F.coalesce("component", "id"), F.lit(True)).alias("kept"),
        )
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """`docs` (doc_id, text, ...) with the smallest id of each component alone; equal rows stay once.

    Rows without words are kept, and so is one row of each text of rows with a null id. Other
    columns are passed on. Only rows that may go, or whose id may be repeated, are shuffled.
    """
    rows, links = near_links(docs)
    gone = materialize(components(links).filter("id <> component").select("id"))
    again = rows.filter("id is not null").groupBy("id").count().filter("count > 1").select("id")
    doc = F.col("doc_id").cast("long")
    unsure = doc.isNull() | may_be_among(gone)(doc) | may_be_among(again)(doc)
    held = docs.filter(unsure)
    kept = held.join(gone, doc == gone["id"], "left_anti").dropDuplicates(["doc_id", "text"])
    return docs.filter(~unsure).unionByName(kept)
