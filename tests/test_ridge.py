"""Feature vectors and ridge paths against the long tables, numpy and closed forms."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from locusfold.operators import ridge, sequence, vectors
from locusfold.operators.metrics import inverse_transform
from locusfold.plans import models


@pytest.fixture(scope="module")
def flanks(spark):
    rng = np.random.default_rng(5)
    text = lambda n: "".join(rng.choice(list("ACGTN"), n, p=[0.24] * 4 + [0.04]))
    rows = [(i, text(60), text(60), text(2).replace("N", "A"), i % 2 == 1) for i in range(300)]
    rows += [(300, "", None, "AC", False), (301, "ACG", "N" * 60, None, True), (302, "acgt" * 15, "GC" * 30, "ACT", False), (302, "GC" * 30, "GC" * 30, "GT", None)]
    return spark.createDataFrame(rows, "id long, lf string, rf string, unit string, rev_comp boolean")


@pytest.mark.parametrize("mode", ["separate", "pooled"])
@pytest.mark.parametrize("edges", [((0, 60),), ((0, 10), (10, 60))])
def test_vectors_equal_the_long_tables(spark, flanks, mode, edges):
    space = vectors.FeatureSpace(edges, (1, 2, 3), mode, gc=True, motifs=("AC", "AG", "AT", "CG", "CT", "GT"))
    names = space.names()
    assert len(names) == len(set(names)) == space.width
    unique = flanks.filter("id < 302")
    got = {}
    for r in vectors.flank_vectors(unique, space).collect():
        assert r.slots == sorted(set(r.slots)) and 0 not in r["values"]
        got |= {(r.id, names[s]): v for s, v in zip(r.slots, r["values"])}
    long = sequence.kmer_features(unique, edges, (1, 2, 3), mode).unionByName(sequence.gc_features(unique, edges, mode).filter("value > 0"))
    motif = sequence.motif_onehot(unique, "unit", "rev_comp", 2).filter("place is not null").select("id", F.concat(F.lit("motif_"), "motif").alias("feature"), F.lit(1.0).alias("value"))
    want = {(r.id, r.feature): r.value for r in long.unionByName(motif).collect()}
    assert got == pytest.approx(want)
    again = vectors.to_vectors(long.unionByName(motif), space.frame(spark), ["id"])
    assert {(r.id, names[s]): v for r in again.collect() for s, v in zip(r.slots, r["values"])} == pytest.approx(want)
    assert vectors.flank_vectors(flanks, space).filter("id = 302").count() == 2 and vectors.flank_vectors(flanks.filter("false"), space).count() == 0


def gc_of(text, lo, hi, left):
    part = text[max(len(text) - hi, 0):max(len(text) - lo, 0)] if left else text[lo:hi]
    valid = [c for c in part if c in "ACGT"]
    return sum(c in "GC" for c in valid), len(valid)


def test_gc_features(flanks):
    rows = [r for r in flanks.collect() if r.id < 302]
    want = {}
    for r in rows:
        for b, (lo, hi) in enumerate([(0, 10), (10, 60)]):
            (a, m), (c, n) = gc_of(r.lf or "", lo, hi, True), gc_of(r.rf or "", lo, hi, False)
            want |= {(r.id, f"left_bin{b}_gc"): a / m if m else 0.0, (r.id, f"right_bin{b}_gc"): c / n if n else 0.0, (r.id, f"flank_bin{b}_gc"): (a + c) / (m + n) if m + n else 0.0}
    got = {}
    for mode in ("separate", "pooled"):
        df = sequence.gc_features(flanks.filter("id < 302"), [(0, 10), (10, 60)], mode)
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
        got |= {(r.id, r.feature): r.value for r in df.collect()}
    assert got == pytest.approx(want)


def plain_ridge(x, y, alpha, scale):
    s = x.std(0) if scale else np.ones(x.shape[1])
    s = np.where(s == 0, 1, s)
    z = (x - x.mean(0)) / s
    w = np.linalg.solve(z.T @ z + alpha * np.eye(x.shape[1]), z.T @ (y - y.mean()))
    return w, lambda q: (q - x.mean(0)) / s @ w + y.mean()


def frame_of(spark, x, ys, split, parts=7):
    rows = [(i, np.flatnonzero(r).tolist(), r[r != 0].tolist(), *(float(y[i]) for y in ys), s) for i, (r, s) in enumerate(zip(x, split))]
    cols = ", ".join(f"y{k} double" for k in range(len(ys)))
    return spark.createDataFrame(rows, f"id long, slots array<int>, values array<double>, {cols}, split string").repartition(parts)


@pytest.mark.parametrize("scale", [True, False])
def test_ridge_on_300_features(spark, scale):
    rng = np.random.default_rng(6)
    x = rng.poisson(0.8, (900, 300)).astype(float)
    x[:, 7] = 3.0  # constant
    x[:, 8] = 1e6 + x[:, 8]  # far from zero
    y = x[:, :5] @ [1, -2, 0.5, 0, 3] + rng.normal(size=900)
    share = 1 / (1 + np.exp(-(x[:, 9] - x[:, 10])))
    split = np.where(np.arange(900) % 5 == 0, "val", np.where(np.arange(900) % 5 == 1, "test", "train"))
    df = frame_of(spark, x, [y, share], split)
    alphas = [1e-2, 1.0, 30.0, 1e3]
    fit = ridge.fit_ridge(df, 300, {"y0": "identity", "y1": "arcsine"}, alphas, scale=scale)
    train, val, test = (split == s for s in ("train", "val", "test"))
    for name, raw in (("y0", y), ("y1", np.arcsin(np.sqrt(share)))):
        errors = [((plain_ridge(x[train], raw[train], a, scale)[1](x[val]) - raw[val]) ** 2).mean() for a in alphas]
        rows = [r for r in fit.search if r[0] == name]
        assert [r[1] for r in rows] == alphas and [r[2] for r in rows] == pytest.approx(errors, rel=1e-6)
        assert [r[3] for r in rows] == [k == int(np.argmin(errors)) for k in range(4)]
        w, f = plain_ridge(x[train], raw[train], alphas[int(np.argmin(errors))], scale)
        assert np.allclose(fit.coefs[name], w, rtol=1e-5, atol=1e-7)
        if name == "y0":
            got = {r.id: r.pred_y0 for r in ridge.predict_vectors(df.filter("split = 'test'"), fit, ["id"]).collect()}
            assert got == pytest.approx(dict(zip(np.flatnonzero(test).tolist(), f(x[test]))), rel=1e-6)
    native = ridge.predict_vectors(df, fit, ["id", "y1"]).select(F.max(F.abs(F.col("pred_y1") - 0.5)).alias("far")).first().far
    assert native <= 0.5
    assert fit.coef_frame(spark).count() == 602


def test_moments_do_not_depend_on_partitions(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(5, 1, (500, 40))
    df = frame_of(spark, x, [x.sum(1)], np.full(500, "train"))
    before = ridge.BLOCK, ridge.PIECE
    want = np.cov(np.c_[x, x.sum(1)].T, bias=True) * 500
    for block, piece, parts in ((256, 1 << 22, 1), (16, 200, 13), (7, 1 << 22, 40)):
        ridge.BLOCK, ridge.PIECE = block, piece
        try:
            m = ridge.moments(df.repartition(parts), 40, ["y0"])
        finally:
            ridge.BLOCK, ridge.PIECE = before
        assert m.n == 500 and np.allclose(m.products, want) and np.allclose(m.mean[:40], x.mean(0))


def test_wider_than_the_normal_solver(spark):
    """5,376 features, more than rows: the width of two sides, two bins and k of 3, 4 and 5."""
    space = vectors.FeatureSpace(((0, 1000), (1000, 5000)))
    assert space.width == 5376
    rng = np.random.default_rng(8)
    rows = []
    for i in range(120):
        rows.append((i, "".join(rng.choice(list("ACGT"), 5000)), "".join(rng.choice(list("ACGT"), 5000)), float(rng.normal()), "val" if i % 6 == 0 else "train"))
    loci = spark.createDataFrame(rows, "id long, lf string, rf string, y double, split string").repartition(4)
    v = vectors.flank_vectors(loci, space, ["id", "y", "split"]).persist()
    x = np.zeros((120, 5376))
    y, train = np.zeros(120), np.zeros(120, bool)
    for r in v.collect():
        x[r.id, r.slots] = r["values"]
        y[r.id], train[r.id] = r.y, r.split == "train"
    assert (x.sum(1) == 2 * sum(5000 - 2 * (k - 1) for k in (3, 4, 5))).all()  # two bins of each side lose k - 1 each
    fit = ridge.fit_ridge(v, space.width, {"y": "identity"}, [1.0, 1e3, 1e5], features=space.names())
    v.unpersist()
    s = x[train].std(0)
    z = (x - x[train].mean(0)) / np.where(s == 0, 1, s)
    k = z[train] @ z[train].T
    mean = y[train].mean()
    for _, a, mse, _ in fit.search:
        dual = np.linalg.solve(k + a * np.eye(len(k)), y[train] - mean)
        assert mse == pytest.approx((((z[~train] @ z[train].T) @ dual + mean - y[~train]) ** 2).mean(), rel=1e-6)


def test_missing_rows_and_errors(spark):
    df = spark.createDataFrame([(1, [0, 1], [1.0, 2.0], 3.0, "train"), (2, [1], [1.0], 1.0, "train"), (3, [0], [2.0], None, "train"), (4, [0], [float("nan")], 1.0, "train"), (5, None, None, 0.0, "train"), (6, [], [], 5.0, None)], "id long, slots array<int>, values array<double>, y double, split string")
    fit = ridge.fit_ridge(df, 2, {"y": "identity"}, [2.0, 1.0])
    w, f = plain_ridge(np.array([[1.0, 2], [0, 1], [0, 0]]), np.array([3.0, 1, 0]), 2.0, True)
    assert np.allclose(fit.coefs["y"], w) and [(r[1], r[3]) for r in fit.search] == [(2.0, True), (1.0, False)] and np.isnan(fit.search[0][2])
    got = {r.id: r.pred_y for r in ridge.predict_vectors(df, fit, ["id"]).collect()}
    assert got[6] == got[5] == pytest.approx(f(np.zeros(2))) and np.isnan(got[4]) and got[3] == pytest.approx(f(np.array([2.0, 0])))
    with pytest.raises(ValueError, match="no complete row"):
        ridge.fit_ridge(df.filter("false"), 2, {"y": "identity"}, [1.0])
    with pytest.raises(ValueError, match="at most"):
        ridge.moments(df, 20000, ["y"])


def test_registered_ridge(spark, sf_dir):
    rows, space = models.ridge_rows(spark, sf_dir)
    data = rows.collect()
    x = np.zeros((len(data), space.width))
    for k, r in enumerate(data):
        x[k, r.slots] = r["values"]
    split = np.array([r.split for r in data])
    raw = np.log1p([r["size"] for r in data])
    train, val = split == "train", split == "val"
    want = [((plain_ridge(x[train], raw[train], a, True)[1](x[val]) - raw[val]) ** 2).mean() for a in models._PENALTIES]
    got = models.ridge_kmer_search(spark, sf_dir).filter("target = 'size'").orderBy("alpha").collect()
    assert [r.val_mse for r in got] == pytest.approx(want, abs=2e-6)
    best = int(np.argmin(want))
    pred = np.expm1(plain_ridge(x[train], raw[train], models._PENALTIES[best], True)[1](x))
    out = models.ridge_kmer_predictions(spark, sf_dir).collect()
    at = {r.id: k for k, r in enumerate(data)}
    assert len(out) == (split == "test").sum() > 0 and all(abs(r.pred_size - pred[at[r.id]]) < 1e-4 for r in out)
    assert models.ridge_kmer_coefficients(spark, sf_dir).count() == 2 * (space.width + 1)
