"""Ward's hierarchy over mergeable summaries: each is a number of rows and their mean, and any two sets of them can be joined and condensed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import batch_rows

#: Summaries that a task keeps; tables of no more rows are clustered exactly.
MOST = 1024
_SUMMARY = "n long, mean array<double>"


def ward_merges(n: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """(first, second, height, rows) of each merge, by height; clusters are numbered leaves first, then merges in order.

    Chains of nearest neighbours: two clusters that are each other's nearest merge. The height of a merge is
    sqrt(2 a b / (a + b)) times the distance of the means, a and b being the numbers of rows.
    """
    leaves = len(n)
    weight, mean, alive = n.astype(np.float64), mean.astype(np.float64).copy(), np.ones(leaves, bool)
    found: list[tuple[float, int, int]] = []
    chain: list[int] = []
    while len(found) < leaves - 1:
        if not chain:
            chain.append(int(alive.argmax()))
        i = chain[-1]
        square = ((mean - mean[i]) ** 2).sum(1) * 2 * weight * weight[i] / (weight + weight[i])
        square[~alive] = square[i] = np.inf
        near = int(square.argmin())
        if len(chain) > 1 and square[chain[-2]] <= square[near]:
            j = chain[-2]
            del chain[-2:]
            found.append((float(np.sqrt(square[j])), i, j))
            mean[i] = (weight[i] * mean[i] + weight[j] * mean[j]) / (weight[i] + weight[j])
            weight[i] += weight[j]
            alive[j] = False
        else:
            chain.append(near)
    # a leaf stands for the cluster that it is in; merges go by height
    top, number, rows = list(range(leaves)), list(range(leaves)), n.astype(np.float64).tolist()

    def find(x: int) -> int:
        while top[x] != x:
            top[x] = x = top[top[x]]
        return x

    out = np.zeros((len(found), 4))
    for m, (height, i, j) in enumerate(sorted(found, key=lambda f: f[0])):
        a, b = find(i), find(j)
        rows[a] += rows[b]
        out[m] = min(number[a], number[b]), max(number[a], number[b]), height, rows[a]
        top[b], number[a] = a, leaves + m
    return out


def cut(merges: np.ndarray, leaves: int, count: int) -> np.ndarray:
    """A cluster number from 0 for each leaf, after the first `count` merges."""
    root = np.arange(leaves + count)
    for m in range(count - 1, -1, -1):
        root[merges[m, :2].astype(int)] = root[leaves + m]
    return np.unique(root[:leaves], return_inverse=True)[1]


def condense(n: np.ndarray, mean: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """At most `most` summaries of these: equal means are one, then Ward's merges are made from the lowest on."""
    mean, back = np.unique(mean, axis=0, return_inverse=True)
    n = np.bincount(back.ravel(), n).astype(np.int64)
    if len(n) <= most:
        return n, mean
    label = cut(ward_merges(n, mean), len(n), len(n) - most)
    total = np.bincount(label, n)
    sums = np.zeros((most, mean.shape[1]))
    np.add.at(sums, label, mean * n[:, None])
    return total.astype(np.int64), sums / total[:, None]


def summaries(df: DataFrame, col: str, most: int = MOST) -> tuple[np.ndarray, np.ndarray]:
    """(rows, means) of at most `most` clusters of the arrays of a column, which have one length; null arrays are left out. Runs one job.

    Each task condenses its rows as they come, then 64 tasks and one task condense the summaries. With at most `most`
    different arrays nothing is condensed; beyond it, the summaries depend on how rows are dealt to tasks.
    """

    def condensed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, mean = np.zeros(0, np.int64), None
        for f in frames:
            if len(f):
                x = np.array(f["mean"].tolist(), np.float64)
                for at in range(0, len(x), most):  # 2 * most at once
                    part, count = x[at:at + most], f["n"].to_numpy()[at:at + most]
                    n, mean = condense(np.concatenate([n, count]), part if mean is None else np.vstack([mean, part]), most)
        if mean is not None:
            yield pd.DataFrame({"n": n, "mean": list(mean)})

    with batch_rows(df.sparkSession, 1024):
        rows = df.filter(F.col(col).isNotNull()).select(F.lit(1).cast("long").alias("n"), F.col(col).cast("array<double>").alias("mean"))
        for parts in (64, 1):
            rows = rows.mapInPandas(condensed, _SUMMARY).repartition(parts)
        found = rows.mapInPandas(condensed, _SUMMARY).collect()  # `most` rows
    if not found:
        return np.zeros(0, np.int64), np.zeros((0, 0))
    return np.array([r.n for r in found]), np.array([r["mean"] for r in found])


def hierarchical_profiles(df: DataFrame, k: int = 3, height: float | None = None, col: str = "unit", most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """(rows with a profile and their cluster, merges): Ward's clusters, `k` of them or those whose merges are no higher than `height`.

    Merges are (step, first, second, height, rows), as `ward_merges` numbers them. Clusters are numbered from 0 by the number
    of their rows, the largest first, then by their mean. A row has the cluster of the nearest summary, which is itself
    where all different profiles are kept.
    """
    spark = df.sparkSession
    n, mean = summaries(df, col, most)
    merges = ward_merges(n, mean)
    count = max(0, len(n) - k) if height is None else int((merges[:, 2] <= height).sum())
    label = cut(merges, len(n), count)
    size = np.bincount(label, n)
    sums = np.zeros((len(size), mean.shape[1]))
    np.add.at(sums, label, mean * n[:, None])
    order = sorted(range(len(size)), key=lambda c: (-size[c], tuple(sums[c] / size[c])))
    shared = spark.sparkContext.broadcast((mean, np.argsort(order)[label] if len(n) else label))  # `most` profiles

    @F.pandas_udf("int")
    def nearest(profiles: pd.Series) -> pd.Series:
        means, labels = shared.value
        out = []
        for at in range(0, len(profiles), 1024):
            x = np.array(profiles.iloc[at:at + 1024].tolist(), np.float64)
            out.append(labels[((x * x).sum(1)[:, None] - 2 * x @ means.T + (means * means).sum(1)).argmin(1)])
        return pd.Series(np.concatenate(out) if out else [], dtype="int32")

    rows = df.filter(F.col(col).isNotNull()).withColumn("cluster", nearest(F.col(col).cast("array<double>")))
    steps = [(i, int(a), int(b), float(h), int(r)) for i, (a, b, h, r) in enumerate(merges)]
    return rows, spark.createDataFrame(steps, "step int, first int, second int, height double, rows long")
