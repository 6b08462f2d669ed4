"""Queries whose SQL covers less than the whole job, against brute force on small tables."""

import random
import zlib
from collections import Counter, defaultdict
from datetime import datetime

import numpy as np
import pytest

from locusfold import catalog
from locusfold.operators.attribution import enrichment_run
from locusfold.operators.resampling import permuted_places


def generator(*key):
    return np.random.Generator(np.random.Philox(key=np.array(key, np.uint64)))


def some_orders(spark, path, each):
    """Rows of orders with two k-mers of `each` rows over ten distances, written to `path`."""
    rng = random.Random(1)
    keys = [12 * i + j for i in range(each) for j in range(2)]
    rows = [(k, rng.randrange(1, 500), "O", rng.randrange(10**5, 5 * 10**5) / 1.0 + 5000 * (k % 12), datetime(1995, 1, 1), "1-URGENT") for k in keys]
    kind = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string"
    spark.createDataFrame(rows, kind).write.parquet(f"{path}/orders.parquet")
    return rows


@pytest.fixture(scope="module")
def orders(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("orders"))
    return path, some_orders(spark, path, 40)


def test_permutations_take_all_rows(spark, orders):
    path, rows = orders
    strata = defaultdict(list)
    for key, cust, _, price, *_ in rows:
        strata[cust % 10 + 1].append((key, price / 1000 - 150))
    scored = {}
    for pool in strata.values():
        values = sorted(v for _, v in pool)
        scored.update({k: values.index(v) + (values.count(v) + 1) / 2 for k, v in pool})
    observed = [sum(scored[k] for k in scored if k % 12 == j) / 40 for j in range(2)]
    hashes = {r.k: r.h for r in spark.createDataFrame([(r[0],) for r in rows], "k long").selectExpr("k", "xxhash64(k) as h").collect()}
    sums = np.zeros((10_000, 2))
    for stratum, pool in strata.items():
        keys = sorted((k for k, _ in pool), key=hashes.get)
        first = sum(k % 12 == 0 for k in keys)  # K0 has the first places
        for perm, to in enumerate(permuted_places(42, (stratum,), range(10_000), np.arange(len(keys)), len(keys))):
            assert sorted(to) == list(range(len(keys)))
            for k, at in zip(keys, to):
                sums[perm, int(at >= first)] += scored[k]
    null = {(f"K{j}", perm): sums[perm, j] / 40 for j in range(2) for perm in range(10_000)}
    got = {(r.kmer, r.perm): r.null_mean for r in catalog.queries()["stratified_permutation"](spark, path).collect()}
    assert got.keys() == null.keys()
    assert all(abs(got[x] - null[x]) < 2e-5 for x in null)
    ps = {r.kmer: (r.n_occurrences, r.p_value) for r in catalog.queries()["permutation_pvalues"](spark, path).collect()}
    for j in range(2):
        hits = sum(null[f"K{j}", perm] >= observed[j] - 1e-9 for perm in range(10_000))
        n, p = ps[f"K{j}"]
        assert n == 40 and abs(p - (hits + 1) / 10_001) < 1e-3  # equal means may differ in the last bit


def test_enrichment_of_every_scope_and_window(spark, tmp_path):
    """The registered run equals a plain one: scopes and windows of the stored table, each permuted by its own places."""
    path = str(tmp_path)
    rows = some_orders(spark, path, 240)
    hashes = {r.k: r.h for r in spark.createDataFrame([(r[0],) for r in rows], "k long").selectExpr("k", "xxhash64(k) as h").collect()}
    table = [(key, cust % 10 + 1, float(np.float32(price / 1000 - 150)), f"K{key % 12}", f"motif_A{cust % 2}") for key, cust, _, price, *_ in rows]
    want = {}
    for scope in ("all", "motif_A0", "motif_A1"):
        for name, lo, hi in (("1-3", 1, 3), ("3-6", 3, 6)):
            strata = defaultdict(list)
            for r in table:
                if lo <= r[1] <= hi and scope in ("all", r[4]):
                    strata[r[1]].append(r)
            words = sorted({r[3] for pool in strata.values() for r in pool})
            n, seen, raw, pools, null = Counter(), Counter(), Counter(), Counter(), {w: np.zeros(10_000) for w in words}
            for distance, pool in strata.items():
                pool.sort(key=lambda r: hashes[r[0]])
                values = sorted(r[2] for r in pool)
                score = [values.index(r[2]) + (values.count(r[2]) + 1) / 2 for r in pool]
                for r, x in zip(pool, score, strict=True):
                    n[r[3]] += 1
                    seen[r[3]] += x
                    raw[r[3]] += r[2]
                    pools[r[3]] += sum(values) / len(values)
                owner = np.array([words.index(w) for w in sorted(r[3] for r in pool)])  # k-mers take places by name
                for perm, to in enumerate(permuted_places(42, (scope, name, distance), range(10_000), np.arange(len(pool)), len(pool))):
                    for w, x in zip(words, np.bincount(owner[to], score, len(words)), strict=True):
                        null[w][perm] += x
            for w in words:
                if n[w] >= 30:
                    mean, chance = seen[w] / n[w], null[w] / n[w]
                    p = (np.sum(np.abs(chance - chance.mean()) >= abs(mean - chance.mean()) - 1e-9) + 1) / 10_001
                    want[scope, name, w] = (n[w], mean, chance.mean(), p, raw[w] / n[w], pools[w] / n[w])
    got = {(r.scope, r.window, r.kmer): (r.n_occurrences, r.observed_mean, r.null_mean, r.p_value, r.raw_observed, r.raw_expected) for r in catalog.queries()["enrichment_run"](spark, path).collect()}
    assert got.keys() == want.keys() and got
    for k in want:
        assert got[k] == pytest.approx(want[k], abs=1e-3), k  # means that are equal may differ in the last bit


def test_enrichment_of_odd_rows(spark):
    """Rows without a k-mer, a distance, a score or a motif class; too few occurrences; an empty table."""
    rows = [(i, d, None if i == 5 else float(i % 7), None if i % 11 == 3 else f"K{i % 2}", None if i % 5 == 0 else "M") for i, d in enumerate([1, 2, None] * 40)]
    kmers = spark.createDataFrame(rows, "obs long, distance int, ig_score double, kmer string, motif_class string")
    used = [r for r in rows if r[1] and r[3]]
    got = {(r.scope, r.window, r.kmer): r for r in enrichment_run(kmers, True, n_perm=50, min_count=10).collect()}
    assert {k[:2] for k in got} == {("all", "global"), ("motif_M", "global")}
    for (scope, _, w), r in got.items():
        own = [x for x in used if x[3] == w and (scope == "all" or x[4])]
        assert r.n_occurrences == len(own) and 0 < r.p_value <= 1
        assert r.raw_observed == pytest.approx(np.mean([x[2] for x in own if x[2] is not None]))
    assert enrichment_run(kmers, n_perm=50, min_count=1000).count() == enrichment_run(kmers.limit(0), n_perm=50).count() == 0


TO_BASES = str.maketrans("abcdefghijklmnopqrstuvwxyz", ("ACGT" * 7)[:26])


def rc(s):
    return s.translate(str.maketrans("ACGT", "TGCA"))[::-1]


@pytest.fixture(scope="module")
def documents(spark, tmp_path_factory):
    """(path, sequences by chromosome): none, few and many letters, and some that cross chunk borders."""
    rng = random.Random(2)
    path = str(tmp_path_factory.mktemp("documents"))
    texts = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n)) for n in (0, 1, 2, 3, 12, 13, 40, 59, 60, 300, 1500)]
    spark.createDataFrame([(i, f"{t[:5]}, {t[5:]}.", "en", "s", len(t) + 3) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    return path, {f"doc{i}": t.translate(TO_BASES) for i, t in enumerate(texts)}


def test_loci_along_whole_sequences(spark, documents):
    path, genome = documents
    want, read = {}, defaultdict(set)
    for chrom, seq in genome.items():
        n = len(seq)
        for j, a in enumerate(range(n // 2 % 13, n, 24)):
            b = min(a + 2 + j % 4, n)
            want[f"{chrom}_{j}"] = chrom, a, b, 1 + j % 2, seq[max(a - 24, 0):a], seq[a:b], seq[b:b + 24]
            read[chrom].update(range(max(a - 24, 0), min(b + 24, n)))
        assert len(read[chrom]) == n
    assert any(a // 512 != (b + 24) // 512 for _, a, b, *_ in want.values())
    run = lambda name: catalog.queries()[name](spark, path).collect()
    assert {r.id: (r.lf, r.tract, r.rf) for r in run("fetch_window")} == {i: (x[4], x[5], x[6]) for i, x in want.items()}
    ok = {i: x[1] >= 24 and x[2] + 24 <= len(genome[x[0]]) for i, x in want.items()}
    assert {r.id: r.ok for r in run("flank_in_bounds")} == ok and any(ok.values())
    perfect = {i: all(c == t[p % k] for p, c in enumerate(t)) for i, (_, _, _, k, _, t, _) in want.items()}
    assert {r.id: r.perfect for r in run("perfect_repeat")} == perfect
    assert sum(r.n for r in run("locus_qc_funnel")) == len(want)
    inputs = {}
    for i, (_, _, _, k, lf, t, rf) in want.items():
        if ok[i]:
            x, y = lf + (t[:k] * 6)[:6], (t[-k:] * 6)[-6:] + rf
            inputs[i, False], inputs[i, True] = "XX" + x + "XXX" + y + "XXXX", "XX" + rc(y) + "XXX" + rc(x) + "XXXX"
    assert {(r.id, r.rev_comp): r.input for r in run("assemble_input")} == inputs
    gc = {}
    for i, (_, _, _, _, lf, _, rf) in want.items():
        if ok[i]:
            for name, part in (("left_bin0", lf[-8:]), ("left_bin1", lf[:-8]), ("right_bin0", rf[:8]), ("right_bin1", rf[8:])):
                gc[i, f"{name}_gc"] = round(sum(c in "GC" for c in part) / len(part), 6)
    assert {(r.id, r.feature): r.value for r in run("gc_features")} == gc
    counts = defaultdict(int)
    for i, x in want.items():
        if ok[i]:
            for b, parts in enumerate(((x[4][-8:], x[6][:8]), (x[4][:-8], x[6][8:]))):
                for part in parts:
                    for p in range(len(part) - 2):
                        counts[i, f"flank_bin{b}_3mer_{part[p:p + 3]}"] += 1
    assert {(r.id, r.feature): r.value for r in run("kmer_features_pooled")} == counts


def test_words_of_whole_sequences(spark, documents):
    path, genome = documents
    run = lambda name: catalog.queries()[name](spark, path).collect()
    words = Counter((i, seq[p:p + 4]) for i, seq in genome.items() for p in range(len(seq) - 3))
    rotated = lambda w: min(w[p:] + w[:p] for p in range(len(w)))
    both = lambda w: min(rotated(w), rotated(rc(w)))
    kind = lambda w: both(w[1] if w[1] == w[2] else w[1:3])
    assert sorted((r.id, r.rc) for r in run("reverse_complement")) == sorted((i, rc(seq)) for i, seq in genome.items())
    for name, col, fn in (("canonical_kmer", "kmer", lambda w: min(w, rc(w))), ("rotation_canonical", "motif", rotated), ("motif_canonical", "motif", both), ("motif_class_from_window", "motif_class", kind)):
        assert sorted((r.id, r.w, r.n, r[col]) for r in run(name)) == sorted((i, w, n, fn(w)) for (i, w), n in words.items()), name
    vocab = Counter()
    for (_, w), n in words.items():
        vocab[rotated(w)] += n * (w not in (w + w)[1:-1])
    assert {r.motif: r.n for r in run("motif_vocab")} == +vocab
    assert [(r.n_violations, r.n_checked) for r in run("motif_integrity")] == [(sum(both(w) not in ("ACGT", "AACC") for _, w in words), len(words))]
    assert sorted((r.id, r.w, r.n, r.head, r.tail) for r in run("tile_motif")) == sorted((i, w, n, (w * 3)[:10], (w * 3)[-10:]) for (i, w), n in words.items())
    units = [(i, w, n, r, rotated(rc(w[:2]) if r else w[:2])) for (i, w), n in words.items() for r in (False, True)]
    places = {"AC": 0, "AG": 1, "AT": 2, "CG": 3, "CT": 4, "GT": 5}
    assert sorted((r.id, r.w, r.n, r.rev_comp, r.motif, str(r.place)) for r in run("motif_onehot")) == sorted((*u, str(places.get(u[4]))) for u in units)


def test_profiles_of_whole_vectors(spark, tmp_path):
    rng = random.Random(3)
    vectors = {i: [0.0] * 20 + [float(rng.randrange(-8, 9)) for _ in range(44)] for i in range(30)}  # exact as floats
    spark.createDataFrame([(i, v, i % 3) for i, v in vectors.items()], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    run = lambda name: catalog.queries()[name](spark, str(tmp_path)).collect()
    shares = {}
    for i, v in vectors.items():
        w = [max(x, 0.0) for x in v]
        shares[i] = [x / sum(w) for x in w]
    reach = {r.id: r for r in run("reach_metrics")}
    centres = {i: sum(x * (100 * k + 50) for k, x in enumerate(p)) for i, p in shares.items()}
    for i, p in shares.items():
        assert abs(reach[i].center_of_mass - centres[i]) < 2e-5
        assert reach[i].frac_beyond == 1.0 and reach[i].reach_distance > 1950
    got = {(r.id, r.midpoint): r.share for r in run("unit_area")}
    assert len(got) == 30 * 64 and all(abs(got[i, 100.0 * k + 50] - x) < 2e-6 for i, p in shares.items() for k, x in enumerate(p))
    far = max(range(3), key=lambda c: sum(centres[i] for i in centres if i % 3 == c) / 10)
    assert {r.id for r in run("long_range_cluster")} == {i for i in centres if i % 3 == far}
    means = {c: [sum(shares[i][k] for i in shares if i % 3 == c) / 10 for k in range(64)] for c in range(3)}
    dist = {i: sum((x - y) ** 2 for x, y in zip(p, means[i % 3])) ** 0.5 for i, p in shares.items()}
    nearest = {i for c in range(3) for i in sorted((i for i in dist if i % 3 == c), key=lambda i: (dist[i], i))[:5]}
    examples = {r.id: r.distance for r in run("cluster_examples")}
    assert examples.keys() == nearest and all(abs(examples[i] - dist[i]) < 2e-6 for i in nearest)
    for name in ("profile_kmeans", "hierarchical_profiles"):  # without the slice no profile is empty, so none gets -2
        assert {r.id for r in run(name) if r.cluster >= 0} == set(vectors)
    assert len(run("silhouette_sweep")) == 3


def midranks(x):
    x = np.asarray(x)
    return (x[:, None] > x).sum(1) + ((x[:, None] == x).sum(1) + 1) / 2


def draws(n, n_boot):
    raw = [np.random.Philox(key=np.array([42, b], np.uint64)).random_raw(n) for b in range(n_boot)]
    return np.array([[int((int(x) >> 11) / 2**53 * n) for x in r] for r in raw])


def test_bootstraps_are_whole(spark, tmp_path):
    rng = random.Random(4)
    rows = [(k, rng.choice([1, 13, 2, 8, 20]), "O", float(rng.randrange(10**5, 5 * 10**5)), datetime(1995, 1, 1), "1-URGENT") for k in range(96)]
    kind = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string"
    spark.createDataFrame(rows, kind).write.parquet(f"{tmp_path}/orders.parquet")
    vectors = [[float(rng.randrange(-50, 50)) for _ in range(64)] for _ in range(6)]
    spark.createDataFrame([(i, v, 0) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    run = lambda name: catalog.queries()[name](spark, str(tmp_path)).collect()
    ci = lambda v: np.quantile(v, [0.025, 0.975])

    got = {r.pos: (r.lo, r.hi) for r in run("position_profile_ci")}
    one = {r.i: r.h for r in spark.range(100).selectExpr("id as i", "xxhash64(id) as h").collect()}  # hashes order the rows of a group
    both = {(r.i, r.c): r.h for r in spark.range(100).selectExpr("id as i", "explode(array(false, true)) as c").selectExpr("i", "c", "xxhash64(struct(i as id, c as rev_comp)) as h").collect()}
    order = sorted(range(6), key=lambda v: both[v // 2, v % 2 == 1])
    x = np.abs(np.array(vectors))[order][draws(6, 1000)].mean(1)
    assert sorted(got) == list(range(64)) and all(np.allclose(got[i], ci(x[:, i]), atol=2e-5) for i in got)

    groups = defaultdict(list)
    for k, c, _, price, *_ in sorted(rows, key=lambda r: one[r[0] // 2]):
        groups[f"m{c % 4}", c % 6 + 1, k % 2 == 1].append((price / 1000, 0.9 * price / 1000 + c % 17, c % 100 / 100, c % 100 / 200 + k % 7 / 20))
    got = {(r.run, r.motif_len, r.rev_comp, r.task, r.metric): r for r in run("bootstrap_metrics")}
    assert len(got) == len(groups) * 2 * 6
    for g, values in groups.items():
        v, at = np.array(values), draws(len(values), 1000)
        for task, (t, p) in {"length": (v[at, 0], v[at, 1]), "variation": (v[at, 2], v[at, 3])}.items():
            want = {"MSE": ((p - t) ** 2).mean(1), "MAE": np.abs(p - t).mean(1), "MAPE": (np.abs(p - t) / t).mean(1)}
            if task == "length":
                want |= {"R2": 1 - want["MSE"] / t.var(1), "Pearson_r": [np.corrcoef(a, b)[0, 1] for a, b in zip(p, t)]}
                want["Spearman_r"] = [np.corrcoef(midranks(a), midranks(b))[0, 1] for a, b in zip(p, t)]
            for metric, x in want.items():
                r = got[*g, task, metric]
                assert r.n_boot == 1000 and np.allclose((r.lo, r.hi), ci(x), atol=2e-4), (g, task, metric)

    effects = defaultdict(list)
    sides = defaultdict(lambda: defaultdict(list))
    for k, _, _, price, *_ in sorted(rows, key=lambda r: both[r[0] // 8, r[0] // 4 % 2 == 1]):
        e = abs(100 * (price % 100 / 10) / (k // 4 % 50 + 10))
        effects[k % 4].append(e)
        sides["up" if (k % 2 == 0) != (k // 4 % 2 == 1) else "down", k % 4 // 2][k // 8].append(e)
    for name, want in (("local_effect_ci", effects), ("profile_mean_ci", {g: [np.mean(x) for _, x in sorted(v.items(), key=lambda i: one[i[0]])] for g, v in sides.items()})):
        got = {r.region_id if name == "local_effect_ci" else (r.side, r.region_idx): (r.lo, r.hi) for r in run(name)}
        assert got.keys() == want.keys() and len(got) == 4
        for g, v in want.items():
            assert np.allclose(got[g], ci(np.array(v)[draws(len(v), 10_000)].mean(1)), atol=2e-5), (name, g)


def test_no_rows_are_filtered_by_number(spark, tmp_path):
    rng = random.Random(5)
    rows = [(k, rng.randrange(1, 500), "O", float(rng.randrange(10**5, 5 * 10**5)), datetime(1995, 1, 1), "1-URGENT") for k in range(120) if k not in (7, 30)]
    kind = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string"
    spark.createDataFrame(rows, kind).write.parquet(f"{tmp_path}/orders.parquet")
    vectors = [(i, [float(rng.randrange(-50, 50)) for _ in range(64)], i % 3) for i in range(40) if i not in (5, 24)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    lines = [(rng.randrange(10), s, float(rng.randrange(1, 50)), s % 5 + 1) for s in range(60)]
    spark.createDataFrame(lines, "l_partkey long, l_suppkey long, l_quantity double, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    run = lambda name: catalog.queries()[name](spark, str(tmp_path)).collect()

    assert sorted((r.run, r.id, round(r.pred_length, 6)) for r in run("load_runs")) == sorted((f"m{c % 4}", k // 2, round(0.9 * price / 1000 + c % 17, 6)) for k, c, _, price, *_ in rows)
    assert sorted((r.id, r.chrom) for r in run("concat_chromosomes")) == [(r[0], f"chr{r[1] % 22 + 1}") for r in rows]
    meta = {r.id: (r.motif_len, r.split) for r in run("attach_metadata")}
    split = lambda c: {0: "val", 1: "test"}.get(c % 5, "train")
    assert meta == {i: min((c % 6 + 1, split(c)) for k, c, *_ in rows if k // 2 == i) for i in range(60)}
    assert {r.id: r.complete for r in run("strand_completeness")} == {i: i not in (3, 15) for i in range(60)}

    paired = {i: (vectors_by[2 * i], vectors_by[2 * i + 1]) for vectors_by in [{v[0]: v[1] for v in vectors}] for i in range(20) if i not in (2, 12)}
    assert {r.id for r in run("pair_strands")} == paired.keys()
    want = {(i, p + 1): ((f[p] + r[63 - p]) / 2, (f[40 + p] + r[23 - p]) / 2) for i, (f, r) in paired.items() for p in range(24)}
    assert {(r.id, r.i): (r.left_x, r.right_x) for r in run("strand_average")} == want
    counts = defaultdict(int)
    for r in run("kmer_occurrences"):
        counts[r.distance] += r.n
    assert counts == {x: 2 * len(paired) for x in range(1, 21)}
    pred = lambda v: 2.0 + v % 7 / 10
    assert {r.id for r in run("rank_candidates")} == {i for i in paired if min(pred(2 * i), pred(2 * i + 1)) - 1.5 >= 0.55}

    alleles = defaultdict(list)
    for locus, _, a, b in lines:
        alleles[locus] += [int(a), b]
    got = {r.locus: r for r in run("genotype_locus_stats")}
    assert got.keys() == alleles.keys()
    for locus, x in alleles.items():
        assert got[locus].numcalled == len(x) // 2 and abs(got[locus].heterozygosity - (1 - sum((x.count(v) / len(x)) ** 2 for v in set(x)))) < 2e-6
        assert got[locus].mode_allele == min(set(x), key=lambda v: (-x.count(v), v))
    assert {r.sample for r in run("sample_sets")} == set(range(60))
    assert sum(r.n_samples for r in run("sample_set_sizes")) == 60
