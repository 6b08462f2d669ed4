"""Ridge regression on thousands of features: one pass of blocked moments, one decomposition for all penalties.

Each task sums the centred products of its rows; tasks' sums meet block by block, first in lanes, then all, where two of
them merge by the update of means and products of parts. Rows are never gathered; what reaches the driver is
(features + targets)^2 / 2 numbers, whatever the rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .metrics import inverse_transform, target_transform
from .staging import batch_rows

#: Rows and columns of a block of products, partial sums that meet first, and numbers of a dense piece of rows.
BLOCK, LANES, PIECE = 256, 16, 1 << 22
#: Features and targets at most: the driver holds the square of their number.
WIDEST = 16384


def _batch(total: int) -> int:
    """Rows of an Arrow batch: 64, or as many as have a quarter of PIECE numbers where they are dense."""
    return max(64, PIECE // 4 // total)


_SUM = "i int, j int, lane int, n long, mi binary, mj binary, g binary"


def dense(slots: pa.Array | None, values: pa.Array, width: int) -> np.ndarray:
    """Rows of `width` numbers from lists of slots and values; without slots, values stand in order. Null lists are zero, null values NaN."""
    size = pc.fill_null(pc.list_value_length(values), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    row = np.repeat(np.arange(len(size)), size)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size) if slots is None else slots.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(size), width))
    out[row, at] = flat
    return out


def _pieces(batches: Iterator[pa.RecordBatch], width: int, sparse: bool) -> Iterator[np.ndarray]:
    """Dense rows of features, then the other columns, in pieces of at most PIECE numbers and a batch."""
    held, rows = [], 0
    for b in batches:
        x = dense(b.column(1) if sparse else None, b.column(0), width)
        rest = [pc.fill_null(c.cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False)[:, None] for c in b.columns[2 if sparse else 1:]]
        held.append(np.hstack([x, *rest]))
        rows += len(x)
        if rows * held[0].shape[1] >= PIECE:
            yield np.vstack(held)
            held, rows = [], 0
    if held:
        yield np.vstack(held)


def _merge(a: tuple, b: tuple) -> tuple:
    """(n, mean of rows' columns i, of columns j, centred products) of two parts together."""
    n = a[0] + b[0]
    di, dj = b[1] - a[1], b[2] - a[2]
    return n, a[1] + di * (b[0] / n), a[2] + dj * (b[0] / n), a[3] + b[3] + np.outer(di, dj) * (a[0] * b[0] / n)


def _merge_sorted(frames: Iterator[pd.DataFrame], lanes: bool) -> Iterator[pd.DataFrame]:
    """Merges neighbours of the same block, and lane if `lanes`; one block is held at a time."""
    key, state = None, None

    def out() -> pd.DataFrame:
        n, mi, mj, g = state
        return pd.DataFrame({"i": [key[0]], "j": [key[1]], "lane": [key[2]], "n": [n], "mi": [mi.tobytes()], "mj": [mj.tobytes()], "g": [g.tobytes()]})

    for f in frames:
        for i, j, lane, n, mi, mj, g in f.itertuples(index=False):
            mi, mj = np.frombuffer(mi), np.frombuffer(mj)
            part, at = (n, mi, mj, np.frombuffer(g).reshape(len(mi), len(mj))), (i, j, lane if lanes else 0)
            if at == key:
                state = _merge(state, part)
            else:
                if key:
                    yield out()
                key, state = at, part
    if key:
        yield out()


@dataclass(frozen=True)
class Moments:
    """Number of rows, means and centred products of features, then targets."""

    n: int
    mean: np.ndarray
    products: np.ndarray


def moments(rows: DataFrame, width: int, targets: Sequence[str], slots: str | None = "slots", values: str = "values") -> Moments:
    """Moments of the rows whose features and targets are all finite; runs one job.

    With `slots` None, `values` are dense. A slot outside of the width is an error.
    """
    total = width + len(targets)
    if total > WIDEST:
        raise ValueError(f"{total} features and targets; their products are held for {WIDEST} at most")
    spans = [(a, min(a + BLOCK, total)) for a in range(0, total, BLOCK)]

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, shift, sums, g = 0, None, None, None
        for x in _pieces(batches, width, slots is not None):
            x = x[np.isfinite(x).all(1)]
            if not len(x):
                continue
            if shift is None:  # near the mean, so that nothing cancels
                shift, sums, g = x.mean(0), np.zeros(total), [np.zeros((b - a, total - a)) for a, b in spans]
            x -= shift
            n += len(x)
            sums += x.sum(0)
            for (a, b), block in zip(spans, g, strict=True):
                block += x[:, a:b].T @ x[:, a:]
        if n:
            lane = TaskContext.get().partitionId() % LANES
            for i, (a, b) in enumerate(spans):
                for j, (c, d) in enumerate(spans[i:], i):
                    block = g[i][:, c - a:d - a] - np.outer(sums[a:b], sums[c:d]) / n
                    mi, mj = (shift[p:q] + sums[p:q] / n for p, q in ((a, b), (c, d)))
                    row = [i, j, lane, n, mi.tobytes(), mj.tobytes(), block.tobytes()]
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int32(), pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 3), strict=True)], _NAMES)

    with batch_rows(rows.sparkSession, _batch(total)):
        sums = rows.select(values, *([slots] if slots else []), *targets).mapInArrow(part, _SUM)
        lanes = sums.repartition("i", "j", "lane").sortWithinPartitions("i", "j", "lane").mapInPandas(lambda f: _merge_sorted(f, True), _SUM)
        blocks = lanes.repartition("i", "j").sortWithinPartitions("i", "j").mapInPandas(lambda f: _merge_sorted(f, False), _SUM).collect()  # width^2 / 2 numbers
    mean, products, n = np.zeros(total), np.zeros((total, total)), 0
    for r in blocks:
        (a, b), (c, d) = spans[r.i], spans[r.j]
        n, mean[a:b] = r.n, np.frombuffer(bytes(r.mi))
        products[a:b, c:d] = np.frombuffer(bytes(r.g)).reshape(b - a, d - c)
        products[c:d, a:b] = products[a:b, c:d].T
    return Moments(n, mean, products)


_NAMES = ["i", "j", "lane", "n", "mi", "mj", "g"]


@dataclass(frozen=True)
class RidgeFit:
    """Chosen models. `coefs[target]` belong to features over their deviation if scaled; weights and biases to features as they are."""

    features: tuple[str, ...] | None
    transforms: dict[str, str]
    search: list[tuple[str, float, float, bool]]
    coefs: dict[str, np.ndarray]
    intercepts: dict[str, float]
    weights: np.ndarray
    biases: np.ndarray

    def search_frame(self, spark) -> DataFrame:
        return spark.createDataFrame(self.search, "target string, alpha double, val_mse double, chosen boolean")

    def coef_frame(self, spark) -> DataFrame:
        """(target, feature_name, coef) with the intercept: as many rows as the models have numbers."""
        names = self.features or [f"x{i}" for i in range(len(self.weights))]
        rows = [(t, f, float(c)) for t, w in self.coefs.items() for f, c in [*zip(names, w, strict=True), ("intercept", self.intercepts[t])]]
        return spark.createDataFrame(rows, "target string, feature_name string, coef double")


def ridge_paths(m: Moments, width: int, alphas: Sequence[float], scale: bool) -> tuple[np.ndarray, np.ndarray]:
    """(deviations of the features, coefficients by penalty, feature and target) that minimise ||y - Xw - b||^2 + alpha ||w||^2.

    One eigendecomposition serves all penalties. A constant feature has deviation 1 and coefficient 0; directions without
    spread have coefficient 0 also without penalty.
    """
    s = np.sqrt(np.maximum(np.diag(m.products)[:width], 0) / max(m.n, 1)) if scale else np.ones(width)
    s[s <= 1e-12 * np.abs(m.mean[:width])] = 1.0
    s[s == 0] = 1.0
    lam, v = np.linalg.eigh(m.products[:width, :width] / s[:, None] / s)
    flat = lam <= max(lam[-1], 0) * width * np.finfo(float).eps if width else lam < 0
    side = v.T @ (m.products[:width, width:] / s[:, None])
    paths = []
    for a in alphas:
        down = np.where(flat, 0.0, 1 / np.where(flat, 1.0, lam + a)) if a == 0 else 1 / (np.maximum(lam, 0) + a)
        paths.append(v @ (down[:, None] * side))
    return s, np.stack(paths)


def fit_ridge(rows: DataFrame, width: int, targets: Mapping[str, str], alphas: Sequence[float], slots: str | None = "slots", values: str = "values",
              scale: bool = True, split: str = "split", features: Sequence[str] | None = None) -> RidgeFit:
    """Fits each target (column -> transform) for every penalty on `train` and keeps the one with the least error on `val`; the first of equal ones.

    Rows with a missing feature or target are left out. Runs two jobs, which read `rows` once each: write them first where
    they are costly. With no finite row in `train` it is an error; without `val` rows all errors are NaN and the first penalty stays.
    """
    names = [f"_y{i}" for i in range(len(targets))]
    whole = rows.withColumns({n: target_transform(F.col(c).cast("double"), t) for n, (c, t) in zip(names, targets.items(), strict=True)})
    m = moments(whole.filter(F.col(split) == "train"), width, names, slots, values)
    if not m.n:
        raise ValueError("no complete row in train")
    s, paths = ridge_paths(m, width, alphas, scale)
    weights = paths / s[:, None]  # penalty, feature, target
    biases = m.mean[width:] - np.einsum("f,aft->at", m.mean[:width], weights)
    a, t = len(alphas), len(targets)
    shared = rows.sparkSession.sparkContext.broadcast((weights.transpose(1, 0, 2).reshape(width, a * t), biases.reshape(-1)))  # width numbers per penalty

    def errors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, b = shared.value
        n, sums = 0, np.zeros(a * t)
        for x in _pieces(batches, width, slots is not None):
            x = x[np.isfinite(x).all(1)]
            n += len(x)
            sums += ((x[:, :width] @ w + b - np.tile(x[:, width:], a)) ** 2).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(range(a * t), pa.int32()), pa.array([n] * a * t, pa.int64()), pa.array(sums)], ["k", "n", "sse"])

    with batch_rows(rows.sparkSession, _batch(width + t)):
        held = whole.filter(F.col(split) == "val").select(values, *([slots] if slots else []), *names)
        got = {r.k: r.mse for r in held.mapInArrow(errors, "k int, n long, sse double").groupBy("k").agg((F.sum("sse") / F.nullif(F.sum("n"), F.lit(0))).alias("mse")).collect()}
    shared.unpersist()
    mse = np.array([float("nan") if got.get(k) is None else got[k] for k in range(a * t)]).reshape(a, t)
    best = [int(np.argmin(np.where(np.isnan(mse[:, i]), np.inf, mse[:, i]))) for i in range(t)]
    search = [(c, float(alphas[k]), float(mse[k, i]), k == best[i]) for i, c in enumerate(targets) for k in range(a)]
    chosen = np.stack([weights[best[i], :, i] for i in range(t)], axis=1)
    return RidgeFit(
        tuple(features) if features else None, dict(targets), search, {c: paths[best[i], :, i] for i, c in enumerate(targets)},
        {c: float(m.mean[width + i] if scale else biases[best[i], i]) for i, c in enumerate(targets)}, chosen, np.array([biases[best[i], i] for i in range(t)]),
    )


def predict_vectors(rows: DataFrame, fit: RidgeFit, keep: Sequence[str], slots: str | None = "slots", values: str = "values") -> DataFrame:
    """`keep` and pred_<target> in native units, by sparse products where the rows lie. A missing value in a row makes its predictions NaN."""
    shared = rows.sparkSession.sparkContext.broadcast((fit.weights, fit.biases))
    targets = list(fit.transforms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, bias = shared.value
        for b in batches:
            v = b.column(len(keep))
            size = pc.fill_null(pc.list_value_length(v), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = pc.fill_null(v.flatten().cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(size)), size)
            at = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size) if slots is None else b.column(len(keep) + 1).flatten().to_numpy(zero_copy_only=False)
            out = [np.bincount(row, flat * w[at, i], len(size)) + bias[i] for i in range(len(targets))]
            yield pa.RecordBatch.from_arrays([*b.columns[:len(keep)], *map(pa.array, out)], [*keep, *(f"pred_{t}" for t in targets)])

    kinds = ", ".join(f"`{c}` {t}" for c, t in rows.select(*keep).dtypes)
    scored = rows.select(*keep, values, *([slots] if slots else [])).mapInArrow(run, f"{kinds}, " + ", ".join(f"`pred_{t}` double" for t in targets))
    return scored.withColumns({f"pred_{t}": inverse_transform(F.col(f"pred_{t}"), how) for t, how in fit.transforms.items()})
