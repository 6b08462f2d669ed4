"""Ways that only large or odd inputs take, against plain versions."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pandas as pd
import pytest
from pyspark.sql import functions as F

from locusfold import catalog
from locusfold.operators import attribution, importance, metrics, ranks, resampling, sequence, stats, ward
from locusfold.sources import tables


def test_fasta_over_blocks(spark, tmp_path):
    """Records that go on over several blocks of a file, with lines of any length, and records without letters."""
    rng = random.Random(7)
    records = [(f"c{i}", "".join(rng.choice("acgtn") for _ in range(n))) for i, n in enumerate((0, 1, 63, 64, 65, 5000, 0, 640, 3))]
    with open(tmp_path / "x.fa", "w") as f:
        f.write("; no record yet\n")
        for name, seq in records:
            f.write(f">{name} some words\n")
            at = 0
            while at < len(seq):
                n = rng.choice((1, 7, 60, 200))
                f.write(seq[at:at + n] + "\n")
                at += n
            f.write("\n" * rng.randrange(3))
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "300")
    try:
        chunks, lengths = tables.read_fasta(spark, str(tmp_path / "x.fa"), 64)
        assert spark.read.text(str(tmp_path / "x.fa")).rdd.getNumPartitions() > 5
        got = {(r.chrom, r.chunk_idx): r.seq for r in chunks.collect()}
        want = {(name, k): seq[64 * k:64 * k + 64].upper() for name, seq in records for k in range(max(1, -(-len(seq) // 64)))}
        assert got == want
        assert {r.chrom: r.chrom_len for r in lengths.collect()} == {name: len(seq) for name, seq in records}
    finally:
        spark.conf.set(key, before)


def test_long_sequences_are_sliced(spark, monkeypatch):
    monkeypatch.setattr(sequence, "SLICE", 50)
    rng = random.Random(8)
    seqs = ["".join(rng.choice("ACGTN") for _ in range(n)) for n in (0, 2, 3, 49, 50, 51, 52, 53, 400)]
    row, code, n = sequence._counted([s.encode() for s in seqs], np.arange(len(seqs)), 3)
    got = {(int(r), w): int(c) for r, w, c in zip(row, sequence._words(code, 3).to_pylist(), n, strict=True)}
    want = {}
    for i, s in enumerate(seqs):
        for p in range(len(s) - 2):
            if "N" not in s[p:p + 3]:
                want[i, s[p:p + 3]] = want.get((i, s[p:p + 3]), 0) + 1
    assert got == want


def test_ranks_and_quantiles_with_missing_values(spark):
    rng = random.Random(9)
    rows = [(g, rng.choice([1.0, 2.5, -3.0, 7.25, float("nan"), None, float("inf")])) for g in ["a"] * 200 + [None] * 100 + ["b"] * 3]
    df = spark.createDataFrame(rows, "g string, v double")
    known = {g: sorted(v for k, v in rows if k == g and v is not None and not math.isnan(v)) for g in ("a", None, "b")}
    for r in ranks.avg_rank(df, "v", ["g"]).collect():
        if r.v is None or math.isnan(r.v):
            assert r["rank"] is None
        else:
            at = known[r.g]
            assert r["rank"] == at.index(r.v) + (at.count(r.v) + 1) / 2
    finite = df.filter("v < double('inf')")
    got = {r.g: (r.lo, r.q) for r in ranks.exact_quantiles(finite, "v", {"lo": 0.0, "q": 0.3}, ["g"]).collect()}
    for g, v in known.items():
        v = [x for x in v if x < math.inf]
        if v:
            assert got[g] == pytest.approx((v[0], np.quantile(v, 0.3)))


def test_missing_values_in_statistics(spark):
    nan = float("nan")
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 2.0, 4.0), ("b", nan, 1.0), ("b", 3.0, 1.0), ("b", 9.0, None), ("b", 2.0, nan)], "c string, pred_x double, true_x double")
    got = stats.kruskal_wallis(df, "pred_x", "c").first()
    assert got.n == 5 and got.H is not None
    m = metrics.regression_metrics(df.withColumn("run", F.lit("r")), ["run"]).first()
    assert m.n == 3 and m.MSE == pytest.approx((1 + 4 + 4) / 3)


def plain_times(seed, replicate, hashes, parts, drawn):
    """How often each row is drawn, for rows given by their hashes: split among pieces, then within them."""
    piece = np.array([h % parts for h in hashes])
    used, sizes = np.unique(piece, return_counts=True)
    key = np.array([seed, replicate], np.uint64)
    shares = [drawn]
    if len(used) > 1:
        shares = np.random.Generator(np.random.Philox(key=key, counter=np.array([0, 0, 0, 1], np.uint64))).multinomial(drawn, sizes / len(hashes))
    out = np.zeros(len(hashes), int)
    for p, n, c in zip(used, sizes, shares):
        rows = sorted(np.flatnonzero(piece == p), key=lambda i: hashes[i])
        for x in np.random.Philox(key=key, counter=np.array([0, 0, p, 0], np.uint64)).random_raw(int(c)):
            out[rows[int((int(x) >> 11) / 2**53 * n)]] += 1
    return out


@pytest.mark.parametrize("size", [1000, 25])
def test_bootstraps_of_pieces(spark, monkeypatch, size):
    """Groups of one and of several pieces: the same draws by brute force, any partitioning, nulls in keys and values."""
    monkeypatch.setattr(resampling, "PIECE_ROWS", size)
    monkeypatch.setattr(resampling, "WIDTH", 8)
    rng = random.Random(10)
    rows = [(f"i{k}", "g" if k % 3 else None, float(rng.randrange(100)), float(rng.randrange(1, 60))) for k in range(90)]
    rows += [("x", "g", None, 1.0), ("y", "g", float("nan"), 2.0), ("z", "one", 5.0, 4.0)]
    df = spark.createDataFrame(rows, "id string, g string, pred_t double, true_t double")
    hashes = {r.id: r.h for r in df.selectExpr("id", "xxhash64(id) h").collect()}
    known = [r for r in rows if r[2] is not None and r[2] == r[2]]
    groups = {g: [r for r in known if r[1] == g] for g in ("g", None, "one")}
    want = {}
    for g, pool in groups.items():
        h = [hashes[r[0]] for r in pool]
        draws = [plain_times(42, b, h, -(-len(pool) // size), len(pool)) for b in range(20)]
        assert all(w.sum() == len(pool) for w in draws)
        p, t = (np.array([r[i] for r in pool]) for i in (2, 3))
        want[g] = [(np.repeat(p, w), np.repeat(t, w)) for w in draws]
    got = {r.g: r for r in resampling.bootstrap_interval(df.repartition(5), "pred_t", "id", 20, 42, ["g"], 0.9).collect()}
    assert got.keys() == want.keys()
    for g, pairs in want.items():
        assert (got[g].lo, got[g].hi, got[g].n_boot) == pytest.approx((*np.quantile([p.mean() for p, _ in pairs], [0.05, 0.95]), 20))
    found = {(r.g, r.metric): r for r in metrics.bootstrap_metrics(df.repartition(3), ["t"], 20, 0.9, per=["g"]).collect()}
    assert len(found) == 18
    mid = lambda x: (x[:, None] > x).sum(1) + ((x[:, None] == x).sum(1) + 1) / 2
    for g in ("g", None):
        for metric, f in {
            "MSE": lambda p, t: ((p - t) ** 2).mean(), "MAE": lambda p, t: abs(p - t).mean(), "MAPE": lambda p, t: (abs(p - t) / t).mean(), "R2": lambda p, t: 1 - ((p - t) ** 2).mean() / t.var(),
            "Pearson_r": lambda p, t: np.corrcoef(p, t)[0, 1], "Spearman_r": lambda p, t: np.corrcoef(mid(p), mid(t))[0, 1],
        }.items():
            r = found[g, metric]
            assert (r.lo, r.hi, r.n_boot) == pytest.approx((*np.quantile([f(p, t) for p, t in want[g]], [0.05, 0.95]), 20)), (g, metric)
    assert found["one", "MSE"].lo == 1.0 and found["one", "R2"].n_boot == 0 and found["one", "R2"].lo is None


def test_permutations_of_pieces(spark, monkeypatch):
    """Many pieces and vectors, k-mers found by table or by search, any partitioning and nulls: the scores of every permutation add up, and all ways agree."""
    rows = [(i, i % 4 if i % 9 else None, float(i * 7 % 31), f"k{i % 3}" if i % 10 else None, "x" if i % 2 else None) for i in range(120)]
    kmers = spark.createDataFrame(rows, "obs long, distance long, ig_score double, kmer string, part string")
    monkeypatch.setattr(resampling, "PIECE_ROWS", 7)
    monkeypatch.setattr(resampling, "WIDTH", 8)
    seen = []
    for parts, labels in ((1, 1 << 24), (9, 0)):
        monkeypatch.setattr(attribution, "LABELS", labels)
        observed, null = attribution.stratified_permutation(kmers.repartition(parts), 30, use_ranks=False, by=["part"])
        seen.append({(r.part, r.kmer): r.null_means for r in null.collect()})
        n = {(r.part, r.kmer): r.n_occurrences for r in observed.collect()}
    assert seen[0].keys() == seen[1].keys() == n.keys() and len(n) == 6
    assert all(len(seen[0][k]) == 30 and seen[0][k] == pytest.approx(seen[1][k]) for k in n)
    for part in ("x", None):
        total = sum(r[2] for r in rows if r[3] is not None and r[4] == part)
        for p in range(30):
            assert sum(seen[0][k][p] * n[k] for k in n if k[0] == part) == pytest.approx(total)
    ps = attribution.permutation_pvalues(observed, null, min_count=1, by=["part"]).collect()
    means = {(r.part, r.kmer): r.observed_mean for r in observed.collect()}
    for r in ps:
        x = np.array(seen[0][r.part, r.kmer])
        far = np.abs(x - x.mean()) >= abs(means[r.part, r.kmer] - x.mean()) - 1e-12
        assert r.p_value == pytest.approx((far.sum() + 1) / 31) and r.null_mean == pytest.approx(x.mean())
    assert len(ps) == 6


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 6, 97, 1000, 65537])
def test_places_are_permuted_evenly(n):
    """Bijections; each place is hit equally often, and for small n each permutation; parts of a range and of the replicates give the same."""
    m = 6000 if n <= 6 else 400
    all_places = np.array(list(resampling.permuted_places(3, ("d", 1), range(m), np.arange(n), n)))
    assert (np.sort(all_places, axis=1) == np.arange(n)).all()
    part = list(resampling.permuted_places(3, ("d", 1), range(130, 140), np.arange(n // 3, n), n))
    assert (np.array(part) == all_places[130:140, n // 3:]).all()
    if n <= 6:
        for place in all_places.T:
            assert (np.abs(np.bincount(place, minlength=n) / m - 1 / n) < 5 * np.sqrt(1 / n / m)).all()
        kinds = math.factorial(n)
        counts = np.unique(all_places, axis=0, return_counts=True)[1]
        spread = ((counts - m / kinds) ** 2).sum() * kinds / m + (kinds - len(counts)) * m / kinds  # chi-square
        assert abs(spread - (kinds - 1)) <= 5 * np.sqrt(2 * kinds)
    else:  # sums of a third of the places have the mean and spread of draws without replacement
        sums = all_places[:, :n // 3].sum(1)
        k = n // 3
        spread = np.sqrt(k * (n + 1) * (n - k) / 12)
        assert abs(sums.mean() - k * (n - 1) / 2) < 5 * spread / np.sqrt(m) and 0.85 < sums.std() / spread < 1.15
        pairs = (all_places[:, 1:] - all_places[:, :-1] == 1).mean()
        assert abs(pairs - 1 / n) < 5 * np.sqrt(1 / n / (m * n)) + 1e-4


def test_labels_are_dealt_evenly():
    """Few rows: each arrangement equally often; many: mean, spread and covariance of sums without replacement, with one piece and with several, few labels and many."""
    few = pd.Series({"_at": 0, "_sizes": [4]})
    sums = np.array(list(resampling.dealt_sums(1, ("d",), range(6000), np.array([1.0, 2.0, 4.0, 8.0]), few, np.array([2, 1, 1]))))
    kinds, counts = np.unique(sums, axis=0, return_counts=True)
    assert len(kinds) == 12 and ((counts - 500) ** 2).sum() / 500 < 11 + 5 * np.sqrt(22)
    assert (sums.sum(1) == 15).all()
    rng = np.random.default_rng(2)
    m = 500
    for counts, sizes in (([3000, 900, 100], [4000]), ([3000, 900, 100], [1500, 2000, 500]), ([40] * 100, [4000]), ([40] * 100, [2500, 1500])):
        score, counts, total = rng.permutation(4000).astype(float), np.array(counts), np.zeros((m, len(counts)))
        ends = np.cumsum(sizes)
        for at, (size, end) in enumerate(zip(sizes, ends)):
            about = pd.Series({"_at": at, "_sizes": sizes})
            total += np.array(list(resampling.dealt_sums(3, ("d", at * 0), range(m), score[end - size:end], about, counts)))
        assert (total.sum(1) == score.sum()).all()
        spread = np.sqrt(counts * (4000 - counts) / 3999 * score.var())
        far = (total - counts * score.mean()) / spread
        assert (np.abs(far.mean(0)) < 5 / np.sqrt(m)).all() and 0.9 < (far**2).mean() < 1.1
        assert abs(np.corrcoef(far[:, 0], far[:, 1])[0, 1] + np.sqrt(np.prod(counts[:2] / (4000 - counts[:2])))) < 5 / np.sqrt(m)


def test_permutations_of_large_strata(spark, monkeypatch):
    """Dealt and placed k-mers have the same null distribution; the dealt ones depend on no partitioning and need no places."""
    monkeypatch.setattr(attribution, "DIRECT", (1 << 14, 10**9))
    monkeypatch.setattr(resampling, "PIECE_ROWS", 9000)
    kmers = spark.range(40_000).selectExpr("id AS obs", "id % 2 AS distance", "double(hash(id) % 1000) AS ig_score", "concat('k', id % 3) AS kmer")
    seen = []
    for parts, direct in ((1, 1 << 14), (7, 1 << 14), (3, 1 << 20)):
        monkeypatch.setattr(attribution, "DIRECT", (direct, 10**9))
        if direct < 1 << 20:
            monkeypatch.setattr(attribution, "permuted_places", None)
        else:
            monkeypatch.setattr(attribution, "permuted_places", resampling.permuted_places)
        seen.append({r.kmer: np.array(r.null_means) for r in attribution.stratified_permutation(kmers.repartition(parts), 600)[1].collect()})
    for k in ("k0", "k1", "k2"):
        assert (seen[0][k] == seen[1][k]).all()
        assert abs(seen[0][k].mean() - seen[2][k].mean()) < 7 * seen[2][k].std() / np.sqrt(600) and 0.85 < seen[0][k].std() / seen[2][k].std() < 1.15


def test_words_are_counted_in_bounded_slices(monkeypatch):
    """A batch of many texts is cut by their bytes, so what a task holds is bounded; counts are those of plain counting by table and by sorting."""
    monkeypatch.setattr(sequence, "SLICE", 200)
    rng = random.Random(4)
    texts = ["".join(rng.choice("ACGTN") for _ in range(rng.choice([0, 3, 30, 150, 900]))) for _ in range(60)] + [None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(61)), pa.array(texts)], ["id", "s"])
    slices = list(sequence._sliced([batch], [1]))
    assert sum((b.to_pylist() for b in slices), []) == batch.to_pylist()
    sizes = [[len(t or "") for t in b.column(1).to_pylist()] for b in slices]
    assert all(sum(x) - max(x) <= 200 for x in sizes) and len(slices) > 20
    for k in (1, 2, 5):
        want = Counter((i, t[j:j + k]) for i, t in enumerate(texts) if t for j in range(len(t) - k + 1) if "N" not in t[j:j + k])
        row, code, n = sequence._counted([(t or "").encode() for t in texts], np.arange(61), k)
        assert dict(zip(zip(row.tolist(), sequence._words(code, k).to_pylist()), n.tolist(), strict=True)) == want


def test_motifs_are_judged_once(spark):
    """Loci are counted by unit before motifs are compared; classes of windows need no pattern and no rotation by index."""
    df = spark.createDataFrame([("GTAC", "AC/ACGT", 4)] * 3 + [("AAAA", "ACGT", 4), ("AC", "ACGT", 2), (None, "ACGT", 4)], "unit string, motif string, motif_len int")
    got = sequence.motif_integrity(df)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert tuple(got.first()) == (1, 5)  # no variant has two letters; a null unit is checked
    assert plan.count("Aggregate") == 2
    windows = spark.createDataFrame([("XxTT",), ("XGA",), ("N",), ("NA",), ("XX",), ("",), (None,), ("xTX",)], "s string").select("s", sequence.motif_class_from_window(F.col("s"), 0, 4).alias("c"))
    assert {r.s: r.c for r in windows.collect()} == {"XxTT": "A", "XGA": "AG", "N": "N", "NA": "NA", "XX": "unknown", "": "unknown", None: None, "xTX": "A"}
    shown = windows._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp" not in shown.lower() and "lambda" not in shown.lower()


def test_vectors_add_up(spark):
    rows = [(i % 5 if i % 7 else None, "b" if i % 2 else None, [float(i), 1.0, -float(i)]) for i in range(200)]
    df = spark.createDataFrame(rows, "k int, w string, v array<double>").repartition(11)
    want = {}
    for k, w, v in rows:
        want[k, w] = np.add(want.get((k, w), 0), v)
    got = {(r.k, r.w): r.v for r in resampling.sum_vectors(df, ["k", "w"], "v").collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)
    assert resampling.sum_vectors(df.filter("false"), ["k"], "v").count() == 0


def test_correlation_tails(spark):
    """Against Student's density, integrated."""
    df = spark.createDataFrame([(0.3, 20), (-0.05, 200), (0.9, 7), (1.0, 5), (0.5, 2), (None, 9)], "r double, n long")
    for r in stats.correlation_pvalue(df).collect():
        if r.r is None or r.n < 3:
            assert r.p is None
            continue
        if abs(r.r) == 1:
            assert r.p == 0
            continue
        k = r.n - 2
        t = abs(r.r) * math.sqrt(k / (1 - r.r**2))
        c = math.exp(math.lgamma((k + 1) / 2) - math.lgamma(k / 2)) / math.sqrt(k * math.pi)
        x = np.linspace(0, t, 200_001)
        y = c * (1 + x * x / k) ** (-(k + 1) / 2)
        assert r.p == pytest.approx(1 - 2 * float(((y[1:] + y[:-1]) / 2 * np.diff(x)).sum()), abs=1e-8)


def test_pca_is_that_of_the_fitted_rows(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(60, 5)) * [5, 3, 1, 0.5, 0.1]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    for keep, text in ((np.arange(60) >= 0, None), (np.arange(60) < 40, "id < 40")):
        mean = x[keep].mean(0)
        values, vectors = np.linalg.eigh(np.cov((x[keep] - mean).T))
        top = vectors[:, np.argsort(-values)[:2]]
        top = top * np.sign(top[np.abs(top).argmax(0), range(2)])
        want = (x - mean) @ top
        got = {r.id: (r.pc1, r.pc2) for r in stats.pca_projection(df, "v", "id", fit_filter=text).collect()}
        assert all(got[i] == pytest.approx(want[i].tolist(), abs=1e-6) for i in range(60))


def test_clusters_of_planted_profiles(spark):
    rng = np.random.default_rng(12)
    centres = np.eye(3).repeat(4, 1)
    x = np.vstack([centres[i % 3] + rng.uniform(0, 0.1, 12) for i in range(45)])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(99, None)], "id long, unit array<double>")
    for fn in (importance.profile_kmeans, lambda f: ward.hierarchical_profiles(f)[0]):
        got = {r.id: r.cluster for r in fn(df).collect()}
        assert got.pop(99, -2) == -2
        assert len(set(got.values())) == 3 and all(got[i] == got[i % 3] for i in got)
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    label = np.arange(45) % 3
    score = []
    for i in range(45):
        a = d[i][label == label[i]].sum() / (np.sum(label == label[i]) - 1)
        b = min(d[i][label == c].mean() for c in range(3) if c != label[i])
        score.append((b - a) / max(a, b))
    got = {r.k: r.silhouette for r in importance.silhouette_sweep(df, (2, 3)).collect()}
    assert got[3] == pytest.approx(np.mean(score), abs=1e-6) and got[3] > got[2]


def test_intervals_by_flank_and_model_type(spark, tmp_path):
    """The chosen run's interval is that of bootstrap_metrics on the run alone; flank sizes come from run names."""
    rng = random.Random(13)
    rows = [(i, f"str{length}_f{flank}_{name}", rng.random() + i / 20, float(i % 9)) for i in range(30) for length in (3, 4) for flank in (1000, 2500) for name in ("a", "b_resumed")]
    df = spark.createDataFrame(rows, "id long, run string, pred_length double, true_length double")
    length, flank = metrics.flank_of_run(F.col("run"))
    df = df.withColumns({"motif_len": length, "flank": flank})
    assert df.filter("motif_len is null or flank is null").count() == 0
    got = metrics.metric_by_flank(df, ["length"], n_boot=50).collect()
    scores = {(r.motif_len, r.flank, r.run): r for r in metrics.regression_metrics(df, ["motif_len", "flank", "run"]).collect()}
    alone = {(r.run, r.metric): (r.lo, r.hi) for r in metrics.bootstrap_metrics(df, ["length"], 50, per=["run"]).collect()}
    assert len(got) == 4
    for r in got:
        assert r.Spearman_r == pytest.approx(max(s.Spearman_r for k, s in scores.items() if k[:2] == (r.motif_len, r.flank)))
        assert (r.Spearman_r_lo, r.Spearman_r_hi, r.MSE_lo, r.MSE_hi) == pytest.approx((*alone[r.run, "Spearman_r"], *alone[r.run, "MSE"]))
        assert 0 <= r.Spearman_p <= 1
    series = {"str3_f1000_a": "one", "str3_f1000_b_resumed": "one", "str4_f1000_a": "two"}
    typed = {r.run: r for r in metrics.metric_by_model_type(df, ["length"], series, n_boot=50).collect()}
    assert {k: r.series for k, r in typed.items()} == series
    assert all((typed[k].R2_lo, typed[k].R2_hi) == pytest.approx(alone[k, "R2"]) for k in series)


def test_candidates_keep_within_limits(spark):
    rng = random.Random(14)
    rows = [(i, "t", float(rng.randrange(5)), float(rng.randrange(4)), float(rng.randrange(6))) for i in range(50)]
    df = spark.createDataFrame(rows, "id long, task string, error double, delta double, diff double")
    got = {r.id: r.score for r in attribution.rank_candidates(df, n=50, max_delta=2, max_error=3).collect()}
    kept = [r for r in rows if r[4] >= 0.05 and r[3] <= 2 and r[2] <= 3]
    place = lambda col, up: {r[0]: k / (len(kept) - 1) for k, r in enumerate(sorted(kept, key=lambda r: (r[col] if up else -r[col], r[0])))}
    e, d, f = place(2, False), place(3, False), place(4, True)
    assert got == {i: pytest.approx((e[i] + d[i] + 5 * f[i]) / 7) for i in e}


def test_pinned_runs(spark):
    rows = [("a", "length", 2, 0.9), ("b", "length", 2, 0.5), ("a", "length", 3, 0.9), ("linear_x", "length", 2, 0.1)]
    df = spark.createDataFrame(rows, "run string, task string, motif_len long, Spearman_r double")
    got = {r.motif_len: (r.model, r.linear, r["mean"]) for r in metrics.metric_by_length(df, pins={2: "b", 3: "none"}).collect()}
    assert got == {2: (0.5, 0.1, None), 3: (0.9, None, None)}


def test_windows_that_no_chunk_meets(spark):
    chunks = sequence.genome_chunks(spark.createDataFrame([("c", "ACGTACGTAC")], "chrom string, seq string"), 4)[0]
    loci = spark.createDataFrame([(1, "c", 2, 6), (2, "c", 9, 30), (3, "none", 0, 4), (4, "c", 50, 60)], "id long, chrom string, a long, b long")
    got = {r.id: r.w for r in sequence.fetch_window(loci, chunks, {"w": (F.col("a"), F.col("b"))}, chunk_bp=4).collect()}
    assert got == {1: "GTAC", 2: "C", 3: "", 4: ""}


def test_registered_queries_without_sql():
    """Those that SQL cannot express, or not at their size; every other one has SQL."""
    assert set(catalog.queries()) - set(catalog.oracle_sql()) == {
        "bootstrap_metrics", "correlation_pvalue", "enrichment_run", "hierarchical_profiles", "hierarchy_heights", "local_effect_ci", "metric_by_flank_ci", "metric_by_model_type_ci", "pca_projection", "permutation_pvalues",
        "position_profile_ci", "profile_kmeans", "profile_mean_ci", "ridge_kmer_coefficients", "ridge_kmer_predictions", "ridge_kmer_search", "silhouette_sweep", "stratified_permutation",
    }


def test_stored_genome_is_not_shuffled(spark):
    """Windows of a store equal those of chunks; the plan moves loci to the store's files, with no exchange over the chunks."""
    rng = random.Random(14)
    seqs = [(f"c{i}", "".join(rng.choice("ACGT") for _ in range(n))) for i, n in enumerate((0, 5, 64, 1000, 700))]
    chunks, _ = sequence.genome_chunks(spark.createDataFrame(seqs, "chrom string, seq string"), 64)
    loci = spark.createDataFrame([(i, f"c{rng.randrange(6)}", at := rng.randrange(1000), at + rng.randrange(80)) for i in range(200)], "id long, chrom string, str_start long, str_end long")
    windows = {"lf": (F.col("str_start") - 20, F.col("str_start")), "tract": (F.col("str_start"), F.col("str_end"))}
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        store = tables.write_genome_store(chunks, buckets=5)
        got = sequence.fetch_window(loci, store, windows, chunk_bp=64)
        plan = got._jdf.queryExecution().executedPlan().toString()
        got = sorted(map(tuple, got.collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == sorted(map(tuple, sequence.fetch_window(loci, chunks, windows, chunk_bp=64).collect()))
    join = plan[plan.index("SortMergeJoin"):].splitlines()
    deep = lambda line: len(line) - len(line.lstrip(" :+-"))
    right = next(i for i in range(len(join) - 1, 0, -1) if "FileScan" in join[i])
    above, level = [], deep(join[right])
    for line in reversed(join[1:right]):  # the way from the scan of the store up to the join
        if deep(line) < level:
            above.append(line)
            level = deep(line)
    assert "Bucketed: true" in join[right] and not any("Exchange" in x for x in above), plan
    assert "Exchange hashpartitioning(chrom" in plan  # the loci's


def plain_ward(x):
    """(height, sets) of each merge by trying all pairs."""
    sets = [frozenset([i]) for i in range(len(x))]
    out = []
    while len(sets) > 1:
        best = None
        for i in range(len(sets)):
            for j in range(i):
                a, b = (np.array(sorted(sets[q])) for q in (i, j))
                h = np.sqrt(2 * len(a) * len(b) / (len(a) + len(b)) * ((x[a].mean(0) - x[b].mean(0)) ** 2).sum())
                if best is None or h < best[0]:
                    best = (h, i, j)
        h, i, j = best
        both = sets[i] | sets[j]
        sets = [s for q, s in enumerate(sets) if q not in (i, j)] + [both]
        out.append((h, both))
    return out


def test_ward_is_exact_on_small_tables(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(40, 5)) + rng.integers(0, 3, 40)[:, None] * 2
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(99, None)], "id long, unit array<double>").repartition(5)
    want = plain_ward(x)
    for k in (1, 3, 7, 40):
        rows, merges = ward.hierarchical_profiles(df, k)
        got = {}
        for r in rows.collect():
            got.setdefault(r.cluster, set()).add(r.id)
        sets = {frozenset([i]) for i in range(40)}
        for _, both in want[:40 - k]:
            sets = {s for s in sets if not s <= both} | {both}
        assert set(map(frozenset, got.values())) == sets
        assert [len(got[c]) for c in range(k)] == sorted(map(len, sets), reverse=True)
    steps = merges.orderBy("step").collect()
    assert [r.height for r in steps] == pytest.approx([h for h, _ in want]) and [r.rows for r in steps] == [len(s) for _, s in want]
    high = (want[-3][0] + want[-2][0]) / 2
    assert ward.hierarchical_profiles(df, height=high)[0].select("cluster").distinct().count() == 3
    twice = ward.hierarchical_profiles(df.unionByName(df.withColumn("id", F.col("id") + 1000)), 3)
    assert twice[1].count() == 39 and twice[1].agg({"rows": "max"}).first()[0] == 80
    rows, merges = ward.hierarchical_profiles(df.filter("id = 99"))
    assert rows.count() == merges.count() == 0


def test_ward_of_condensed_rows(spark):
    """More rows than summaries: planted clusters are found, all rows are counted."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 6)) * 0.1 + np.arange(3000)[:, None] % 4 * 3
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, unit array<double>").repartition(6)
    rows, merges = ward.hierarchical_profiles(df, 4, most=50)
    got = {r.id: r.cluster for r in rows.collect()}
    assert len(got) == 3000 and len(set(got.values())) == 4 and all(got[i] == got[i % 4] for i in got)
    assert merges.count() == 49 and merges.agg({"rows": "max"}).first()[0] == 3000


def read_rows(df):
    """(rows, bytes read) of a scan: rows that leave the reader, and what it took from the files."""
    files = df.sparkSession._jvm.org.apache.hadoop.fs.FileSystem

    def taken():
        return sum(s.getBytesRead() for s in files.getAllStatistics())

    before = taken()
    df.collect()
    leaf = df._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
    return leaf.metrics().apply("numOutputRows").value(), taken() - before


def test_windows_read_their_part_of_the_files(spark, tmp_path):
    """Files are ordered by distance, also where one has half of the rows; scans shrink with the window."""
    rows = spark.range(400_000).select(
        F.col("id").alias("obs"), F.when(F.col("id") % 2 == 0, 40).otherwise(F.expr("xxhash64(id) % 100 + 100")).cast("int").alias("distance"),
        F.rand(3).alias("ig_score"), F.concat(F.lit("K"), F.col("id") % 7).alias("kmer"), F.lit("A").alias("motif_class"),
    )
    kmers = tables.write_kmers(rows, str(tmp_path / "kmers"), files=8, group_bytes=1 << 18)
    assert dict(kmers.dtypes) == dict(rows.dtypes) | {"distance": "smallint", "ig_score": "float"}
    sizes = [r.n for r in kmers.groupBy(F.col("_metadata.file_path")).agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == 400_000 and len(sizes) > 4 and max(sizes) < 2 * 400_000 / 8  # the hot distance is divided
    assert kmers.agg(F.sum(F.hash("obs", "distance", "kmer").cast("long"))).first() == rows.agg(F.sum(F.hash("obs", F.col("distance").cast("short"), "kmer").cast("long"))).first()

    def part(*windows):
        return attribution.in_windows(kmers, windows).select("obs", "ig_score")

    whole, most = read_rows(part((0, 1000)))  # a window of everything, read by the same kind of scan
    got = [read_rows(part(*w)) for w in ([(5, 9)], [(12, 13), (60, 61)], [(0, 30)], [(100, 200)])]
    want = [part(*w).count() for w in ([(5, 9)], [(12, 13), (60, 61)], [(0, 30)])]
    assert whole == 400_000 and want == [sum(rows.filter(c).count() for c in cs) for cs in (["distance between 5 and 9"], ["distance in (12, 13, 60, 61)"], ["distance <= 30"])]
    assert got[0][0] < whole / 8 and got[1][0] < whole / 4 and got[0][0] <= got[2][0] < whole * 0.6
    assert got[0][1] < most / 8 and got[1][1] < most / 6 and got[2][1] < most / 4 and got[3][1] < most / 2


def test_windows_alone_need_windows(spark):
    with pytest.raises(ValueError):
        attribution.enrichment_scopes(spark.range(1), whole=False)


def test_whole_hulls_are_fetched_without_gathering(spark):
    """Hulls in one chunk, over several and beyond the chromosome; the gathering exchange gets only those over a chunk's end."""
    text = "ACGTTGCAGGATCCATTACGGAC"
    chunks, _ = sequence.genome_chunks(spark.createDataFrame([("c", text)], "chrom string, seq string"), 5)
    loci = spark.createDataFrame([(i, "c" if i != 9 else "x", i, i + 1 + i % 7) for i in range(30)], "id long, chrom string, a long, b long")
    got = sequence.fetch_window(loci, chunks, {"w": (F.col("a"), F.col("b")), "v": (F.col("a") - 1, F.col("a"))}, chunk_bp=5)
    assert {r.id: (r.w, r.v) for r in got.collect()} == {i: (text[i:i + 1 + i % 7], text[i - 1:i] if i else "") if i != 9 else ("", "") for i in range(30)}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" in plan and plan.count("collect_list") == 1
