"""Value tables of the sequence, interval and statistics operators."""

import math
import random

import pytest
from pyspark.sql import functions as F

from locusfold.operators import attribution, cohort, importance, intervals, metrics, relational, sequence, stats


def one(spark, **cols):
    return spark.createDataFrame([tuple(cols.values())], list(cols))


def test_reverse_complement_and_canonical(spark):
    df = spark.createDataFrame([("ACGT",), ("GATTACA",), ("",), ("TTTT",), ("CGT",)], ["s"])
    got = [tuple(r) for r in df.select(sequence.reverse_complement(F.col("s")), sequence.canonical_kmer(F.col("s"))).collect()]
    assert got == [("ACGT", "ACGT"), ("TGTAATC", "GATTACA"), ("", ""), ("AAAA", "AAAA"), ("ACG", "ACG")]


@pytest.mark.parametrize("unit,n,anchor,want", [("AT", 6, "left", "ATATAT"), ("TA", 6, "right", "TATATA"), ("AT", 5, "left", "ATATA"), ("TA", 5, "right", "ATATA"), ("A", 4, "left", "AAAA"), ("AT", 0, "left", "")])
def test_tile_motif(spark, unit, n, anchor, want):
    assert one(spark, u=unit).select(sequence.tile_motif(F.col("u"), n, anchor)).first()[0] == want


@pytest.mark.parametrize("seq,want", [("XXXX", "unknown"), ("ACAC", "AC"), ("GGGG", "C"), ("XTTT", "A"), ("TCTC", "AG"), ("GCGC", "CG"), ("NNNN", "N")])
def test_motif_class(spark, seq, want):
    assert one(spark, s=seq).select(sequence.motif_class_from_window(F.col("s"), 0, 4)).first()[0] == want


def test_motif_vocab_sizes(spark):
    assert [sequence.motif_vocab(spark, k).count() for k in (1, 2, 3)] == [4, 6, 20]


def test_tiny_genome_input(spark):
    genome = one(spark, chrom="chr1", seq="C" * 20 + "ATATATA" + "G" * 20)
    chunks, lengths = sequence.genome_chunks(genome, 16)
    assert lengths.first()[1] == 47
    loci = spark.createDataFrame([("x", "chr1", 20, 27, 2, rc) for rc in (False, True)], "id string, chrom string, str_start long, str_end long, motif_len int, rev_comp boolean")
    rows = {r.rev_comp: r for r in sequence.assemble_input(loci, chunks, 10, 6, 2, 3, 4, chunk_bp=16).collect()}
    assert rows[False].pre == "C" * 10 + "ATATAT" and rows[False].post == "TATATA" + "G" * 10
    rc = lambda s: s.translate(str.maketrans("ACGT", "TGCA"))[::-1]
    assert rows[True].pre == rc(rows[False].post) and rows[True].post == rc(rows[False].pre)
    assert len(rows[False].input) == 41


def test_distance_edges():
    assert sequence.distance_edges(None, 10) == [(0, 10)]
    assert sequence.distance_edges(3, 10) == [(0, 3), (3, 6), (6, 10)]
    assert sequence.distance_edges([2, 5], 10) == [(0, 2), (2, 5), (5, 10)]
    with pytest.raises(ValueError):
        sequence.distance_edges([5, 2], 10)


def test_merge_keeps_touching_apart(spark):
    rows = spark.createDataFrame([("c", 0, 5), ("c", 5, 9), ("c", 8, 12), ("c", 1, 2), ("d", 0, 1)], "chrom string, start long, end long")
    for width in (2, 1 << 20):
        got = sorted(map(tuple, intervals.merge_intervals(rows, width).collect()))
        assert got == [("c", 0, 5), ("c", 5, 12), ("d", 0, 1)]


def test_merge_of_equal_rows(spark):
    """Repeated, empty and open-ended intervals over the borders of bins, against one pass in order."""
    rng = random.Random(5)
    rows = [(rng.choice("ab"), at := rng.randrange(400), at + rng.choice([0, 0, 1, 2, 9, 40])) for _ in range(60)] * 3 + [("a", 7, None), ("c", 3, None), ("c", 3, 3), ("c", 3, 9), ("c", 3, 9)]
    rng.shuffle(rows)
    want = []
    for chrom in "abc":
        top = None
        for _, at, end in sorted((r for r in rows if r[0] == chrom), key=lambda r: (r[1], -1 if r[2] is None else r[2])):
            if top is None or at >= top:
                want.append([chrom, at, end])
            elif end is not None:
                want[-1][2] = max(want[-1][2], end)
            top = end if top is None else max(top, top if end is None else end)
    df = spark.createDataFrame(rows, "chrom string, start long, end long")
    key = lambda r: (r[0], r[1], -1 if r[2] is None else r[2])
    for width in (4, 64, 1 << 20):
        merged = intervals.merge_intervals(df.repartition(5), width)
        assert sorted(map(tuple, merged.collect()), key=key) == sorted(map(tuple, want), key=key)
    # no window numbers the islands, so no order of equal rows counts
    assert "island" not in merged._jdf.queryExecution().optimizedPlan().toString()


def test_overlaps_of_any_length(spark):
    """Short and long intervals on both sides, over cell borders of all levels, empty ones and other chromosomes: every pair once, few rows each."""
    rng = random.Random(3)

    def some(n):
        out = []
        for i in range(n):
            size = rng.choice([0, 1, 5, 60, 1000, 5000, 70_000, 600_000, 9_000_000])
            at = rng.choice([64, 512, 4096, 32768, 262144]) * rng.randrange(1, 30) - rng.choice([0, 1, size // 2, size]) if rng.random() < 0.6 else rng.randrange(10_000_000)
            out.append((i, rng.choice(["a", "a", "b"]), max(at, 0), max(at, 0) + size))
        return out

    queries, regions = some(400), some(300)
    q = spark.createDataFrame(queries, "id long, chrom string, str_start long, str_end long")
    r = spark.createDataFrame([(c, s, e, str(i)) for i, c, s, e in regions], "chrom string, start long, end long, name string")
    want = sorted((i, str(j)) for i, c, s, e in queries for j, d, a, b in regions if c == d and a < e and b > s)
    for width in (64, 4096):
        assert sorted((x.id, x.r_name) for x in intervals.overlap_pairs(q, r, bin_bp=width).select("id", "r_name").collect()) == want
        # merging turns touching cover into one region; an empty one lies in none or within another
        assert {x.id for x in intervals.overlapping_ids(q, r, bin_bp=width).collect()} == {i for i, _ in want}
        home = intervals._at_home(q, "str_start", "str_end", width).groupBy("id").count().agg({"count": "max"}).first()[0]
        asked = intervals._asking(q, "str_start", "str_end", width, range(intervals.LEVELS), False).groupBy("id").count().agg({"count": "max"}).first()[0]
        assert home <= intervals.CELLS + 2 and asked <= 2 * intervals.CELLS + 2 * intervals.LEVELS
    assert intervals.overlap_pairs(q, r.filter("false")).count() == intervals.overlap_pairs(q.filter("false"), r).count() == 0


def test_overlap_counts_pairs_once(spark):
    q = spark.createDataFrame([(1, "c", 0, 10000)], "id int, chrom string, str_start long, str_end long")
    r = spark.createDataFrame([("c", 5, 9000), ("c", 10000, 10001)], "chrom string, start long, end long")
    assert intervals.overlap_pairs(q, r, bin_bp=64).count() == 1


def test_one_to_one_reports_duplicates(spark):
    a = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], ["k", "x"])
    b = spark.createDataFrame([(1, "p"), (1, "q"), (2, "r"), (9, "s")], ["k", "y"])
    joined, dup, unmatched, counters = relational.one_to_one_join(a, b, ["k"])
    assert [r.k for r in joined.collect()] == [2] and [(r.k, r.side) for r in dup.collect()] == [(1, "right")]
    assert [r.k for r in unmatched.collect()] == [3] and tuple(counters.first()) == (1, 1, 1)


def test_required_columns_are_named(spark):
    with pytest.raises(ValueError, match="b, c"):
        relational.require_columns(one(spark, a=1), ["a", "b", "c"])


def test_trio_children(spark):
    ped = spark.createDataFrame([("a", "0", "0"), ("b", "a", "0"), ("c", "0", "0")], ["SampleID", "FatherID", "MotherID"])
    ids = spark.createDataFrame([("a",), ("b",), ("z",)], ["SampleID"])
    kept, removed = cohort.drop_trio_children(ped, ids)
    assert [r[0] for r in kept.collect()] == ["a"] and sorted(r[0] for r in removed.collect()) == ["b", "z"]


def test_rc_average(spark):
    df = spark.createDataFrame([("A", False, 4.0, 1.0), ("A", True, 6.0, 1.0), ("B", False, 6.0, 2.0), ("B", True, 8.0, 2.0)], ["id", "rev_comp", "pred_t", "true_t"])
    assert {r.id: r.pred_t for r in metrics.rc_average(df, ["t"]).collect()} == {"A": 5.0, "B": 7.0}


def test_transforms_clamp(spark):
    row = one(spark, a=1.5, b=2.0).select(metrics.target_transform(F.col("a"), "arcsine"), metrics.inverse_transform(F.col("b"), "arcsine")).first()
    assert row[0] == pytest.approx(math.pi / 2) and row[1] == pytest.approx(1.0)


def test_empty_variance_is_one(spark):
    empty = one(spark, y=1.0).filter("false")
    assert metrics.target_variance(empty, {"y": "identity"}).first().variance == 1.0


def test_constant_prediction_has_no_correlation(spark):
    df = spark.createDataFrame([(1, 2.0, 1.0), (1, 2.0, 3.0)], ["g", "pred_t", "true_t"])
    assert metrics.regression_metrics(df, ["g"], ["t"]).first().Pearson_r is None


def test_tails():
    assert stats.chi2_tail(5, 4) == pytest.approx(0.2872974951836458)
    assert stats.t_tail(2.1, 20) == pytest.approx(0.048617587, abs=1e-8)
    assert stats.chi2_tail(0, 3) == 1.0


def test_planted_kmer_is_found(spark):
    import random

    rng = random.Random(1)
    rows = [(d * 1000 + k, d, rng.gauss(2.0 if k % 10 == 7 else 0.0, 1.0), f"k{k % 10}") for d in range(4) for k in range(100)]
    df = spark.createDataFrame(rows, "obs long, distance int, ig_score double, kmer string")
    observed, null = attribution.stratified_permutation(df, 50)
    got = {r.kmer: r for r in attribution.permutation_pvalues(observed, null, 30).collect()}
    assert got["k7"].p_value == pytest.approx(1 / 51) and got["k7"].effect_direction == "higher"
    assert all(0 < r.p_value <= 1 for r in got.values())


def test_reach_of_zero_profile(spark):
    df = spark.createDataFrame([(1, 50.0, 0.0), (1, 150.0, -1.0), (2, 50.0, 1.0), (2, 1500.0, 1.0)], ["id", "midpoint", "value"])
    got = {r.id: tuple(r)[1:] for r in importance.reach_metrics(df).collect()}
    assert got[1] == (0.0, 0.0, 0.0) and got[2] == (775.0, 0.5, 1500.0)


def test_scores_of_permuted_inputs(spark, tmp_path):
    """Every input is scored once, the baseline too; the column scorer and the batch scorer agree; the model is loaded once in a worker."""
    rows = [(1, False, "ACGTACGTTGCA"), (2, True, "TTTTGGGGCCCC"), (3, False, None), (4, None, "A")]
    samples = spark.createDataFrame(rows, "id long, rev_comp boolean, input string").coalesce(1)
    regions = spark.createDataFrame([(0, 0, 5), (1, 4, 12), (2, 3, 3)], "region_id long, token_start long, token_end long")
    log = str(tmp_path / "log")

    def load():
        def note(text):
            with open(log, "a") as f:
                f.write(text)

        note("load\n")

        def scorer(f):
            note("score\n" * len(f))
            at = f["input"].str.find("G") + f["input"].str.find("C") * 3.0
            return f[["id"]].assign(a=at, b=-at)

        return scorer

    got = importance.perturbed_scores(samples, regions, 2, load, ["a", "b"], at_once=4)
    found = {(r.id, r.region_id, r.perm, r.task): (r.baseline, r.permuted) for r in got.collect()}
    assert len(found) == 4 * 3 * 2 * 2
    lines = open(log).read().split()
    assert lines.count("load") == 1 and lines.count("score") == 3 * (1 + 3 * 2)
    score = lambda s: (F.instr(s, "G") - 1 + (F.instr(s, "C") - 1) * 3).cast("double")
    for r in importance.perturbed_predictions(samples, regions, 2, score).collect():
        assert found[r.id, r.region_id, r.perm, "a"] == (r.baseline, r.permuted)
        assert found[r.id, r.region_id, r.perm, "b"] == ((-r.baseline, -r.permuted) if r.id != 3 else (None, None))


def test_reports_of_regions(spark):
    rows = [(i, "left" if i % 2 == 0 else "right", i // 2, i // 2 * 10, i // 2 * 10 + 10, x, y) for i, (x, y) in enumerate([(1.0, 0.5), (2.0, None), (3.0, 0.1), (3.0, 0.2), (None, 0.5), (float("nan"), 0.4)])]
    table = spark.createDataFrame(rows, "region_id long, flank string, region_idx long, distance_start long, distance_end long, local_mean double, d_Spearman_r double")
    top = [(r.ranking, r.place, r.region_id) for r in importance.top_regions(table, n=3).orderBy("ranking", "place").collect()]
    assert top == [("d_Spearman_r", 1, 0), ("d_Spearman_r", 2, 4), ("d_Spearman_r", 3, 5), ("local_mean", 1, 2), ("local_mean", 2, 3), ("local_mean", 3, 1)]
    got = {(r.flank, r.value): tuple(r)[2:] for r in importance.flank_summary(table).collect()}
    assert got["left", "local_mean"] == (3, 3.0, 2.0, 1.0, 1, 10, 20) and got["right", "local_mean"] == (3, 3.0, 2.5, 2.0, 1, 10, 20)
    assert got["left", "d_Spearman_r"][:4] == (3, 0.5, pytest.approx(1.1 / 3), 0.1) and got["left", "d_Spearman_r"][4] == 0


def test_effects_in_bins(spark):
    rows = [("s", float(x), x > 8, 0.001 * x, 0.01 * x) for x in range(11)] + [("one", 2.0, False, 0.5, 1.0), ("s", None, False, 0.03, 0.3)]
    df = spark.createDataFrame(rows, "scope string, effect_size double, sig_effect boolean, p_adj_fdr_bh double, p_adj_bonferroni double")
    got = {(r.scope, r.bin): (r.lo, r.hi, r.n, r.n_large) for r in attribution.effect_histogram(df, 5).collect()}
    assert got == {("s", 0): (0, 2, 2, 0), ("s", 1): (2, 4, 2, 0), ("s", 2): (4, 6, 2, 0), ("s", 3): (6, 8, 2, 0), ("s", 4): (8, 10, 3, 2), ("one", 0): (2, 2, 1, 0)}
    counts = {(r.scope, r.alpha): tuple(r)[2:] for r in attribution.significance_counts(df, (0.05, 0.005)).collect()}
    assert counts["s", 0.05] == (12, 12, 5, 2) and counts["s", 0.005] == (12, 5, 1, 0) and counts["one", 0.05] == (1, 0, 0, 0)


def test_kmers_at_every_distance(spark):
    """Against slices of each row; nulls in arrays, short arrays and no sequence; time grows with the flank, not with its square."""
    rng = random.Random(8)
    rows = [("".join(rng.choice("ACGT") for _ in range(26)), [rng.random() for _ in range(12)], [rng.random() for _ in range(10)], "AC") for _ in range(20)]
    rows += [(None, [1.0] * 12, [2.0] * 10, None), ("A" * 26, [None] + [1.0] * 11, [1.0] * 7, "A"), ("C" * 26, None, [float(i) for i in range(10)], "C")]
    df = spark.createDataFrame(rows, "sequence string, left array<double>, right array<double>, motif_class string")
    got = sorted(map(str, (tuple(r) for r in attribution.kmer_occurrences(df, 3, 12, 10, 9).withColumn("ig_score", F.round("ig_score", 9)).collect())))
    want = []
    turn = str.maketrans("ACGT", "TGCA")
    for seq, left, right, motif in rows:
        for d in range(1, 9):
            for part, text in (((left or [])[12 - d - 2:12 - d + 1], seq and seq[12 - d - 2:12 - d + 1]), ((right or [])[d - 1:d + 2], seq and seq[16 + d - 1:16 + d + 2])):
                score = round(sum(part) / 3, 9) if len(part) == 3 and None not in part else None
                want.append(str((d, score, text and min(text, text.translate(turn)[::-1]), motif)))
    assert got == sorted(want)
    with pytest.raises(ValueError):
        attribution.kmer_occurrences(df, 13, 12, 10)


def test_segment_labels(spark):
    got = spark.range(1).select(sequence.segment_labels(3, 2, 1, 4, 2).alias("x")).first().x
    assert got == ["prefix_prompt"] + ["left_flank"] * 3 + ["left_str"] * 2 + ["str_prompt"] * 4 + ["right_str"] * 2 + ["right_flank"] * 3 + ["suffix_prompt"] * 2
