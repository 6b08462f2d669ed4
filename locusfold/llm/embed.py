"""Near-duplicate vectors by product quantisation.

Vectors are scaled to length 1, so cosine >= 0.98 means a distance of at most r = 0.2. Coarse
inverted lists come from k-means on a bounded sample, as many as give lists of about BLOCK rows of
one label, and so do the codes of the residuals by subspace; every vector is indexed. A near vector
can lie in another list only if the border between the two lists is within r of the query, so all
lists with such a border are probed and no pair can be missed. (With `sigmas`, the margin is so many
standard deviations of a random direction's share of r: fewer probes, but pairs can be missed where
vectors lie near a subspace of few dimensions.) Of two lists that may hold a pair, the lower one's vector asks the higher. A
vector's asymmetric distance to a code, from table look-ups, differs from the true one by no more
than the code's error, which is stored; so what is dropped before the exact rerank is not near.

Equal vectors of a label are one class, known by a number of its own. A task compares a block of queries with a block of one list; it
returns counts and a spanning forest of the links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, forget, materialize, small_batches

COSINE = 0.98
#: Rows that train the quantiser (or eight for each list), most lists, subspaces, codes of a subspace, rows of a block and queries of a block.
SAMPLE, LISTS, SUBSPACES, CODES, BLOCK, QUERIES = 20_000, 1 << 15, 8, 32, 1024, 8192


def _kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    k = min(k, len(x))
    centres = x[np.random.default_rng(seed).choice(len(x), k, replace=False)]
    for _ in range(rounds):
        at = _nearest(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, at, x)
        n = np.bincount(at, minlength=k)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def _squared(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1), 0)


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    step = max(1, (1 << 23) // max(len(centres), 1))
    return np.concatenate([_squared(x[i:i + step], centres).argmin(1) for i in range(0, len(x), step)] or [np.zeros(0, np.int64)])


class Quantiser:
    def __init__(self, sample: np.ndarray, lists: int):
        self.centres = _kmeans(sample, lists)
        residual = sample - self.centres[_nearest(sample, self.centres)]
        self.cuts = np.linspace(0, sample.shape[1], min(SUBSPACES, sample.shape[1]) + 1).astype(int)
        self.books = [_kmeans(residual[:, a:b], CODES, seed=7 + a) for a, b in zip(self.cuts, self.cuts[1:], strict=False)]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(list, codes, error of the coded vector)."""
        at = _nearest(x, self.centres)
        residual = x - self.centres[at]
        codes = np.stack([_nearest(residual[:, a:b], book) for (a, b), book in zip(self._parts(), self.books, strict=True)], 1)
        coded = np.concatenate([book[codes[:, i]] for i, book in enumerate(self.books)], 1)
        return at, codes.astype(np.uint8), np.sqrt(((residual - coded) ** 2).sum(1))

    def _parts(self) -> list[tuple[int, int]]:
        return list(zip(self.cuts.tolist(), self.cuts[1:].tolist(), strict=False))

    def probes(self, x: np.ndarray, margin: float) -> np.ndarray:
        """Mask (rows, lists) of a vector's own list and those whose border with it is within `margin`."""
        d = _squared(x, self.centres)
        own = d.argmin(1)
        apart = np.sqrt(_squared(self.centres[own], self.centres))
        return d - d.min(1, keepdims=True) <= 2 * apart * margin + 1e-9

    def approximate(self, x: np.ndarray, at: int, codes: np.ndarray) -> np.ndarray:
        """Asymmetric distances of rows of x to coded vectors of one list."""
        residual = x - self.centres[at]
        total = np.zeros((len(x), len(codes)))
        for i, ((a, b), book) in enumerate(zip(self._parts(), self.books, strict=True)):
            total += _squared(residual[:, a:b], book)[:, codes[:, i]]
        return np.sqrt(total)


def _unit(rows: list) -> np.ndarray:
    x = np.array([np.asarray(r, np.float64) for r in rows]).reshape(len(rows), -1)
    x = x / np.abs(x).max(1)[:, None]  # so that no square over- or underflows
    return x / np.sqrt((x * x).sum(1))[:, None]


def _forest(a: np.ndarray, b: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Edges (smallest id, other id) that connect what the links left[a]-right[b] connect."""
    parent: dict[int, int] = {}

    def find(v: int) -> int:
        while parent.setdefault(v, v) != v:
            parent[v] = v = parent[parent[v]]
        return v

    for u, v in zip(left[a].tolist(), right[b].tolist(), strict=True):
        u, v = find(u), find(v)
        if u != v:
            parent[max(u, v)] = min(u, v)
    return [(find(v), v) for v in list(parent) if find(v) != v]


def link_vectors(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", sigmas: float | None = None) -> DataFrame:
    """id, n_links, component_id, kept of every row.

    Rows are compared only where labels are equal and not null. A vector that is null, empty, zero
    or holds a null or non-finite component links with nothing, and so does a row with a null id
    (null component, kept) or a vector of another length. Rows of one id are vectors of their own, each
    with its own n_links, and one node of a component; other columns are ignored; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    v = F.col(vector_col).cast("array<double>")
    clean = (
        v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    )
    good = clean & F.col(id_col).isNotNull() & F.col(label_col).isNotNull()
    members = materialize(vectors.filter(good).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), v.alias("v")).withColumn("length", F.size("v")))
    classes = members.groupBy("label", "v", "length").agg(F.min("id").alias("rep"), F.count("*").alias("n"))
    classes = materialize(classes.withColumn("class", F.monotonically_increasing_id()))
    others = vectors.filter(~F.coalesce(good, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), F.lit(0).cast("long").alias("n_links"))
    lengths = sorted(r[0] for r in classes.select("length").distinct().collect())  # a row per length of vector
    if not lengths:
        return others.select(F.col("id").alias(id_col), "n_links", F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    found = [_compare(classes.filter(F.col("length") == n), sigmas) for n in lengths]
    links, counts = found[0]
    for more_links, more_counts in found[1:]:
        links, counts = links.unionByName(more_links), counts.unionByName(more_counts)
    counts = classes.select("label", "v", "rep", "n", "class").join(counts.groupBy("class").agg(F.sum("n").alias("linked")), "class", "left")
    named = members.join(counts, ["label", "v"])
    copies = named.filter("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b"))
    each = named.select("id", (F.coalesce("linked", F.lit(0)) + F.col("n") - 1).cast("long").alias("n_links")).unionByName(others)
    own = components(links.unionByName(copies))
    return each.join(own, "id", "left").select(
        F.col("id").alias(id_col), "n_links", F.coalesce("component", "id").alias("component_id"), F.coalesce(F.col("id") == F.coalesce("component", "id"), F.lit(True)).alias("kept"),
    )


def _compare(classes: DataFrame, sigmas: float | None) -> tuple[DataFrame, DataFrame]:
    """(links a, b), (class, n): forest edges between the smallest ids of classes, and linked vectors by class."""
    spark = classes.sparkSession
    radius = float(np.sqrt(2 - 2 * COSINE))
    dice = F.xxhash64("rep", "label", "class")
    total, largest, length = classes.groupBy("label").count().agg(F.sum("count"), F.max("count")).join(classes.limit(1).select("length")).first()
    margin = radius if sigmas is None else min(radius, sigmas * radius / float(np.sqrt(length)))
    lists = min(LISTS, -(-largest // BLOCK))
    share = min(1.0, max(SAMPLE, 8 * lists) / total)
    sample = classes.filter(F.pmod(dice, F.lit(1 << 30)) < int(share * (1 << 30))) if share < 1 else classes
    model = spark.sparkContext.broadcast(Quantiser(_unit([r[0] for r in sample.orderBy(dice).select("v").collect()]), lists))  # about SAMPLE rows

    def index(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if not len(f):
                continue
            q = model.value
            x = _unit(f["v"].tolist())
            at, codes, error = q.encode(x)
            probes = q.probes(x, margin) & (np.arange(len(q.centres)) >= at[:, None])
            yield pd.DataFrame({
                "label": f["label"], "class": f["class"], "rep": f["rep"], "n": f["n"], "v": [r.tobytes() for r in x], "list": at.astype("int32"),
                "codes": [c.tobytes() for c in codes], "error": error, "probes": [np.flatnonzero(m).astype("int32") for m in probes],
            })

    kind = dict(classes.dtypes)["label"]
    coded = materialize(classes.select("label", "class", "rep", "n", "v").mapInPandas(
        index, f"label {kind}, class long, rep long, n long, v binary, list int, codes binary, error double, probes array<int>"
    ))
    sizes = coded.groupBy("label", "list").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    asked = coded.select("label", F.explode("probes").alias("list")).groupBy("label", "list").agg(F.ceil(F.count("*") / QUERIES).alias("q_blocks"))
    sizes = materialize(sizes.join(asked, ["label", "list"]))  # a row per label and list; Spark broadcasts it if its size allows
    data = coded.join(sizes, ["label", "list"]).select(
        "label", "list", F.pmod(F.xxhash64("class"), F.col("blocks")).alias("block"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("q_blocks") - 1)).alias("q_block"),
        F.lit(-1).alias("asks"), "class", "rep", "n", "v", "codes", "error",
    )
    queries = coded.withColumnRenamed("list", "asks").withColumn("list", F.explode("probes")).join(sizes, ["label", "list"]).select(
        "label", "list", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"),
        F.pmod(F.xxhash64("class", F.lit(1)), F.col("q_blocks")).alias("q_block"),
        "asks", "class", "rep", "n", "v", F.lit(None).cast("binary").alias("codes"), F.lit(0.0).alias("error"),
    )

    def match(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        asking = frame["asks"] >= 0
        q, held = frame[asking], frame[~asking]
        if not len(q) or not len(held):
            return pd.DataFrame({"class": [], "n": [], "a": [], "b": []})
        x, y = (np.frombuffer(b"".join(f["v"]), np.float64).reshape(len(f), -1) for f in (q, held))
        codes = np.frombuffer(b"".join(held["codes"]), np.uint8).reshape(len(held), -1)
        bound = radius + held["error"].to_numpy()[None, :] + 1e-9
        ids, others, n, m = q["class"].to_numpy(), held["class"].to_numpy(), held["n"].to_numpy(), q["n"].to_numpy()
        found = []
        for i in range(0, len(q), 1024):
            a, b = np.nonzero(model.value.approximate(x[i:i + 1024], key[1], codes) <= bound)
            a += i
            for j in range(0, len(a), 1 << 16):
                s = slice(j, j + (1 << 16))
                ok = (np.einsum("ij,ij->i", x[a[s]], y[b[s]]) >= COSINE) & (ids[a[s]] != others[b[s]])
                found.append((a[s][ok], b[s][ok]))
        a, b = (np.concatenate([f[k] for f in found] + [np.zeros(0, np.int64)]) for k in (0, 1))
        # a pair of one list is met from both ends, a pair of two lists from the lower one alone
        across = q["asks"].to_numpy()[a] != key[1]
        linked = np.bincount(a, n[b], len(ids)).astype(np.int64)
        back = np.bincount(b[across], m[a[across]], len(others)).astype(np.int64)
        at, of = np.flatnonzero(linked), np.flatnonzero(back)
        edges = _forest(a, b, q["rep"].to_numpy(), held["rep"].to_numpy())
        counted, none = len(at) + len(of), [None] * len(edges)
        return pd.DataFrame({
            "class": pd.array([*ids[at], *others[of], *none], "Int64"), "n": pd.array([*linked[at], *back[of], *none], "Int64"),
            "a": pd.array([None] * counted + [e[0] for e in edges], "Int64"), "b": pd.array([None] * counted + [e[1] for e in edges], "Int64"),
        })

    both = data.unionByName(queries).groupBy("label", "list", "block", "q_block")
    got = materialize(both.applyInPandas(match, "class long, n long, a long, b long"))
    forget(coded)
    return got.filter("b is not null").select("a", "b"), got.filter("b is null").select("class", "n")
