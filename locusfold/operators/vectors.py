"""Sparse feature vectors of flanks: k-mer counts, GC shares and the motif in one numbered space, built where a row lies."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sequence import _CODES, BASES, SLICE, _counted, _kinds, _sliced


@dataclass(frozen=True)
class FeatureSpace:
    """The features and their slots, by rule: k-mers by k, side, bin and word; then GC by side and bin; then motifs.

    The names are those of `kmer_features`, `gc_features` and `motif_...`. `motifs` is the sorted vocabulary, or empty.
    """

    edges: tuple[tuple[int, int], ...]
    k_values: tuple[int, ...] = (3, 4, 5)
    flank_mode: str = "separate"
    gc: bool = False
    motifs: tuple[str, ...] = ()

    @property
    def groups(self) -> list[str]:
        sides = ("left", "right") if self.flank_mode == "separate" else ("flank",)
        return [f"{s}{f'_bin{b}' if len(self.edges) > 1 else ''}" for s in sides for b in range(len(self.edges))]

    def offset(self, k: int) -> int:
        return len(self.groups) * sum(4**j for j in self.k_values[:self.k_values.index(k)])

    @property
    def gc_offset(self) -> int:
        return len(self.groups) * sum(4**j for j in self.k_values)

    @property
    def motif_offset(self) -> int:
        return self.gc_offset + (len(self.groups) if self.gc else 0)

    @property
    def width(self) -> int:
        return self.motif_offset + len(self.motifs)

    def names(self) -> list[str]:
        words = {k: ["".join(BASES[c >> 2 * j & 3] for j in range(k - 1, -1, -1)) for c in range(4**k)] for k in self.k_values}
        out = [f"{g}_{k}mer_{w}" for k in self.k_values for g in self.groups for w in words[k]]
        return out + [f"{g}_gc" for g in self.groups if self.gc] + [f"motif_{m}" for m in self.motifs]

    def frame(self, spark: SparkSession) -> DataFrame:
        """(slot, feature): one row per feature, as many as the parameters make."""
        names = self.names()
        return spark.createDataFrame(pa.table({"slot": pa.array(range(len(names)), pa.int32()), "feature": names}))


def _flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, first byte and size of each text) of an array of strings; a null is empty."""
    whole = pc.fill_null(texts, "").cast(pa.large_string())
    ends = np.frombuffer(whole.buffers()[1], np.int64, len(whole) + 1, whole.offset * 8)
    data = np.frombuffer(whole.buffers()[2] or b"", np.uint8)
    return data, ends[:-1], np.diff(ends)


def _bases(space: FeatureSpace, left: pa.Array, right: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(code of each base, bases from it to its bin's end, row * number of groups + group) bin by bin and side by side. Left bins count from the repeat outwards."""
    g = len(space.groups)
    sides = _flat(left), _flat(right)
    for b, (lo, hi) in enumerate(space.edges):
        for far, (data, first, size) in enumerate(sides):
            near, end = (np.clip(x, 0, size) for x in ((lo, hi) if far else (size - hi, size - lo)))
            n = np.maximum(end - near, 0)
            row = np.repeat(np.arange(len(n)), n)
            place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            group = len(space.edges) + b if far and space.flank_mode == "separate" else b
            yield _CODES[data[np.repeat(first + near, n) + place]], np.repeat(n, n) - place, row * g + group


def _even(texts: pa.Array) -> bool:
    """Whether all texts have one size."""
    sizes = pc.min_max(pc.fill_null(pc.binary_length(texts), 0))
    return sizes["min"] == sizes["max"]


def _even_keys(space: FeatureSpace, left: pa.Array, right: pa.Array, kind: type) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """(keys row * width + slot of all k-mers, G and C by row and group, known bases so) of flanks of one size a side, as matrices."""
    groups, size = len(space.groups), len(left)
    start = (np.arange(size) * space.width).astype(kind)[:, None]
    keys, gc, valid = [], np.zeros((size, groups), np.int64), np.zeros((size, groups), np.int64)
    for far, (data, first, sizes) in enumerate(map(_flat, (left, right))):
        n = int(sizes[0])
        whole = _CODES[data[int(first[0]):int(first[0]) + size * n].reshape(size, n)]
        known = whole < 4
        clean = known.all()
        for b, (lo, hi) in enumerate(space.edges):
            cut = slice(lo, hi) if far else slice(max(n - hi, 0), max(n - lo, 0))
            codes, group = whole[:, cut], len(space.edges) + b if far and space.flank_mode == "separate" else b
            for k in space.k_values:
                m = codes.shape[1] - k + 1
                if m < 1:
                    continue
                word = np.zeros((size, m), kind)
                for j in range(k):
                    word *= 4
                    word += codes[:, j:j + m]
                word += start + kind(space.offset(k) + group * 4**k)
                keys.append(word.ravel() if clean else word[np.logical_and.reduce([known[:, cut][:, j:j + m] for j in range(k)])])
            if space.gc:
                gc[:, group] += ((codes == 1) | (codes == 2)).sum(1)
                valid[:, group] += known[:, cut].sum(1)
    return keys, gc.ravel(), valid.ravel()


def _uneven_keys(space: FeatureSpace, left: pa.Array, right: pa.Array, kind: type) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """As `_even_keys`, for flanks of any sizes."""
    groups, size = len(space.groups), len(left)
    codes, rest, at = map(np.concatenate, zip(*_bases(space, left, right), strict=True))
    known = codes < 4
    row, group = np.divmod(at, groups)
    keys, start = [], (row * space.width).astype(kind)
    for k in space.k_values:
        n = max(len(codes) - k + 1, 0)
        word, good = np.zeros(n, kind), rest[:n] >= k
        for j in range(k):
            word *= 4
            word += codes[j:n + j]
            good &= known[j:n + j]
        good = np.flatnonzero(good)
        keys.append(start[good] + (space.offset(k) + group[good] * 4**k).astype(kind) + word[good])
    valid = np.bincount(at[known], minlength=size * groups)
    return keys, np.bincount(at[(codes == 1) | (codes == 2)], minlength=size * groups), valid


def _features(space: FeatureSpace, left: pa.Array, right: pa.Array, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, slot, value) by row and slot: one sort of row * width + slot of all k-mers of all rows gives counts in order."""
    groups, width, size = len(space.groups), space.width, len(left)
    kind = np.int32 if size * width < 2**31 else np.int64
    keys, gc, valid = (_even_keys if all(map(_even, (left, right))) else _uneven_keys)(space, left, right, kind)
    if space.gc:
        hit = np.flatnonzero(gc)
        keys.append((hit // groups * width + space.gc_offset + hit % groups).astype(kind))
    has = np.flatnonzero(places >= 0)
    keys.append((has * width + space.motif_offset + places[has]).astype(kind))
    key = np.sort(np.concatenate(keys))
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.intp)
    value = np.diff(np.append(first, len(key))).astype(np.float64)
    row, slot = np.divmod(key[first], width)
    if space.gc:
        value[(slot >= space.gc_offset) & (slot < space.motif_offset)] = gc[hit] / valid[hit]
    return row, slot, value


def _long_features(space: FeatureSpace, left: pa.Array, right: pa.Array, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As `_features`, for one row of long flanks: its k-mers are counted in slices."""
    groups, (a,), (b,) = len(space.groups), *([(t or "").encode() for t in x.to_pylist()] for x in (left, right))
    texts = [t for lo, hi in space.edges for t in (a[max(len(a) - hi, 0):max(len(a) - lo, 0)], b[lo:hi])]
    side = len(space.edges) if space.flank_mode == "separate" else 0
    at = np.array([g for i in range(len(space.edges)) for g in (i, side + i)])
    slot, value = [], []
    for k in space.k_values:
        where, code, n = _counted(texts, at, k)
        slot.append(space.offset(k) + where * 4**k + code)
        value.append(n.astype(np.float64))
    if space.gc:
        gc = np.bincount(at, [len(t) - len(t.translate(None, b"GC")) for t in texts], groups)
        valid = np.bincount(at, [len(t) - len(t.translate(None, BASES.encode())) for t in texts], groups)
        hit = np.flatnonzero(gc)
        slot.append(space.gc_offset + hit)
        value.append(gc[hit] / valid[hit])
    if places[0] >= 0:
        slot.append(space.motif_offset + places)
        value.append(np.ones(1))
    slot, value = np.concatenate(slot), np.concatenate(value)
    order = np.argsort(slot)
    return np.zeros(len(slot), np.int64), slot[order], value[order]


def _places(motifs: dict[str, int], unit: pa.Array, rev_comp: pa.Array) -> np.ndarray:
    """Place of each strand's rotation class among the motifs, -1 if it is none: as `motif_onehot`, each different unit of a batch once."""
    units = unit.dictionary_encode()
    table = []
    for u in units.dictionary.to_pylist():
        table.append([motifs.get(min(w[i:] + w[:i] for i in range(max(len(w), 1))), -1) for w in (u, u.translate(_PAIRS)[::-1])])
    found = np.array([*table, [-1, -1]])
    at = pc.fill_null(units.indices, len(table)).to_numpy(zero_copy_only=False)
    return found[at, pc.fill_null(rev_comp, False).to_numpy(zero_copy_only=False).astype(np.intp)]


_PAIRS = str.maketrans("ACGT", "TGCA")


def _vectors(loci: DataFrame, space: FeatureSpace, keep: Sequence[str], read: Sequence[str], arrays: dict[str, str], pack: Callable[[np.ndarray, np.ndarray], list[np.ndarray]]) -> DataFrame:
    """`keep` and `arrays` (names and types of elements), which `pack` makes of the slots and values of a slice of rows."""
    motifs = {m: i for i, m in enumerate(space.motifs)}
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _sliced(batches, (n, n + 1)):
            left, right = b.column(n), b.column(n + 1)
            places = _places(motifs, b.column(n + 2), b.column(n + 3)) if motifs else np.full(b.num_rows, -1)
            long = b.num_rows == 1 and sum(len(x[0].as_py() or "") for x in (left, right)) > SLICE
            row, slot, value = (_long_features if long else _features)(space, left, right, places)
            ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=b.num_rows))]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*b.columns[:n], *(pa.ListArray.from_arrays(ends, pa.array(x)) for x in pack(slot, value))], [*keep, *arrays])

    rows = loci.select(*keep, *[F.col(c).alias(f"_{i}") for i, c in enumerate(read if motifs else read[:2])])
    return rows.mapInArrow(run, ", ".join([_kinds(loci, keep), *(f"{c} array<{t}>" for c, t in arrays.items())]))


def flank_vectors(loci: DataFrame, space: FeatureSpace, keep: Sequence[str] = ("id",), lf: str = "lf", rf: str = "rf", unit: str = "unit", rev_comp: str = "rev_comp") -> DataFrame:
    """`keep`, slots array<int> and values array<double>: the features of each row that are not zero, by slot.

    Bases other than A, C, G and T make no k-mer and no share; a null flank counts as empty. A motif that the vocabulary
    lacks, or a null one, has no slot. `unit` and `rev_comp` are read only if the space has motifs. Nothing is shuffled:
    rows are counted where they lie, in slices of about SLICE bytes of flanks.
    """
    return _vectors(loci, space, keep, (lf, rf, unit, rev_comp), {"slots": "int", "values": "double"}, lambda slot, value: [slot.astype(np.int32), value])


def packed_counts(loci: DataFrame, space: FeatureSpace, keep: Sequence[str] = ("id",), lf: str = "lf", rf: str = "rf") -> DataFrame:
    """`keep` and counts array<long>: as `flank_vectors`, of a space of k-mers only, a count and its slot as count * 2^32 + slot."""
    return _vectors(loci, space, keep, (lf, rf), {"counts": "bigint"}, lambda slot, value: [value.astype(np.int64) << 32 | slot])


def to_vectors(table: DataFrame, names: DataFrame, key: Sequence[str], feature: str = "feature", value: str = "value") -> DataFrame:
    """Sparse vectors of a long table (key, feature, value) by a dictionary (slot, feature) with one row per feature.

    Features that the dictionary lacks are dropped, repeated ones of a key are added up. The table is shuffled once, by key;
    Spark sends the dictionary to all tasks if its size allows.
    """
    known = table.join(names, table[feature] == names["feature"]).select(*key, "slot", F.col(value).cast("double").alias("_v"))
    sums = known.groupBy(*key, "slot").agg(F.sum("_v").alias("_v"))
    pairs = F.array_sort(F.collect_list(F.struct("slot", "_v")))  # as many as a key has features
    return sums.groupBy(*key).agg(pairs.alias("_p")).select(*key, F.col("_p.slot").alias("slots"), F.col("_p._v").alias("values"))
