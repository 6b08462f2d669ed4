"""Steps whose cost must not grow faster than their input."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from locusfold.operators import metrics, resampling, ridge, sequence, vectors
from locusfold.operators.sequence import motif_onehot
from locusfold.plans import models


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_vectors_are_built_without_a_join(spark, sf_dir):
    """The motif and the bounds of flanks come from the rows themselves; texts are counted once per scan for the loci."""
    got = models.kmer_vectors(spark, sf_dir)
    assert plan(got).count("Join") == 2 and "chrom_len" not in plan(got)  # the chunks of whole and of cut hulls
    assert ridge._batch(284) == 3692 and ridge._batch(16384) == 64


def test_vectors_of_odd_flanks(spark, monkeypatch):
    rows = [(i, lf, rf, u, c) for i, (lf, rf, u, c) in enumerate([
        ("ACGTTGCA", "GGNCCATT", "CA", False), (None, "AC", "AC", True), ("", "", None, None), ("TTéACG", "ACGTé", "GT", None), ("A", "NNNN", "AA", True), ("ACGTACGTAC" * 9, "TTTT" * 30, "é", True), ("GC", None, "", False),
    ])]
    df = spark.createDataFrame(rows, "id int, lf string, rf string, unit string, rev_comp boolean").repartition(1).sortWithinPartitions("id")
    places = {r.id: r.place for r in motif_onehot(df, "unit", "rev_comp", 2).collect()}
    for mode in ("separate", "pooled"):
        space = vectors.FeatureSpace(((0, 3), (3, 8)), (1, 3), mode, True, ("AC", "AG", "AT", "CG", "CT", "GT"))
        names = space.names()
        for size in (1 << 18, 40):  # with 40, the long row is counted in slices
            monkeypatch.setattr(vectors, "SLICE", size)
            whole = df.select("id", "lf", "rf", "unit", "rev_comp").toArrow().combine_chunks()
            motifs = {m: i for i, m in enumerate(space.motifs)}
            for i, lf, rf, u, c in rows:
                one = whole.slice(i, 1).to_batches()[0]
                place = vectors._places(motifs, one.column(3), one.column(4))
                assert place[0] == (-1 if places[i] is None else places[i])
                want = {}
                for b, (lo, hi) in enumerate(space.edges):
                    a, z = (lf or "").encode(), (rf or "").encode()
                    parts = [("left", a[max(len(a) - hi, 0):max(len(a) - lo, 0)]), ("right", z[lo:hi])]
                    for k in space.k_values:
                        for side, t in parts:
                            for j in range(len(t) - k + 1):
                                if all(x in b"ACGT" for x in t[j:j + k]):
                                    name = f"{side if mode == 'separate' else 'flank'}_bin{b}_{k}mer_{t[j:j + k].decode()}"
                                    want[name] = want.get(name, 0) + 1
                    for group in ([parts[:1], parts[1:]] if mode == "separate" else [parts]):
                        text = b"".join(t for _, t in group)
                        if any(x in b"GC" for x in text):
                            want[f"{group[0][0] if mode == 'separate' else 'flank'}_bin{b}_gc"] = sum(x in b"GC" for x in text) / sum(x in b"ACGT" for x in text)
                if places[i] is not None:
                    want[f"motif_{space.motifs[places[i]]}"] = 1
                for f in (vectors._features, vectors._long_features):
                    _, slot, value = f(space, one.column(1), one.column(2), place)
                    assert list(slot) == sorted(slot) and {names[s]: v for s, v in zip(slot, value)} == want, (mode, i, f)
        got = {r.id: dict(zip(r.slots, r["values"])) for r in vectors.flank_vectors(df, space).collect()}
        assert len(got) == len(rows) and all(
            np.array_equal(sorted(got[i]), vectors._features(space, whole.slice(i, 1).to_batches()[0].column(1), whole.slice(i, 1).to_batches()[0].column(2), np.array([-1 if places[i] is None else places[i]]))[1]) for i in got
        )


def test_long_tables_are_named_after_counting(spark, monkeypatch):
    """A locus leaves Python as one row; its features are named by a small table, except in spaces too large for one. Flanks of any length, in slices too."""
    rows = [(i or None, lf, rf) for i, (lf, rf) in enumerate([
        ("ACGTTGCA", "GGNCCATT"), (None, "ACACAC"), ("", ""), ("TTéACG", "acgtACGé"), ("A", "NNNN"), ("ACGTACGTAC" * 9, "TTTT" * 30), (None, None), ("GC", None), ("ACGTTGCA", "ACGTTGCA"), ("GG", "TTTACA"),
    ])]
    df = spark.createDataFrame(rows, "id int, lf string, rf string").repartition(1)
    for mode, edges in (("separate", ((0, 3), (3, 100))), ("pooled", ((0, 3), (3, 100))), ("separate", ((0, 5),))):
        want = {}
        for i, lf, rf in rows:
            for b, (lo, hi) in enumerate(edges):
                a, z = (lf or "").encode(), (rf or "").encode()
                for side, t in (("left", a[max(len(a) - hi, 0):max(len(a) - lo, 0)]), ("right", z[lo:hi])):
                    for k in (2, 1, 4):
                        for w in (t[j:j + k] for j in range(len(t) - k + 1)):
                            if set(w) <= set(b"ACGT"):
                                key = i, f"{side if mode == 'separate' else 'flank'}{f'_bin{b}' if len(edges) > 1 else ''}_{k}mer_{w.decode()}"
                                want[key] = want.get(key, 0.0) + 1.0
        for named, size in ((1 << 18, 1 << 18), (1 << 18, 40), (0, 40)):
            monkeypatch.setattr(sequence, "NAMED", named)
            for module in (sequence, vectors):
                monkeypatch.setattr(module, "SLICE", size)
            got = sequence.kmer_features(df, edges, (2, 1, 4), mode)
            assert got.dtypes == [("id", "int"), ("feature", "string"), ("value", "double")]
            found = got.collect()
            assert {(r.id, r.feature): r.value for r in found} == want and len(found) == len(want), (mode, named, size)
            assert ("Generate" in plan(got)) == (named > 0)


def test_hulls_are_cut_once(spark):
    """Windows and filters on them do not cut the hull out of the chunk anew: it is cut once in each of the two ways."""
    text = "ACGTTGCAAC" * 13
    chunks, _ = sequence.genome_chunks(spark.createDataFrame([("c", text)], "chrom string, seq string"), 16)
    loci = spark.createDataFrame([(i, "c", i * 3, i * 3 + 2 + i % 4) for i in range(50)] + [(99, "d", 5, 9)], "id int, chrom string, str_start long, str_end long")
    got = sequence.fetch_window(loci, chunks, {"lf": (F.col("str_start") - 5, F.col("str_start")), "rf": (F.col("str_end"), F.col("str_end") + 5)}, chunk_bp=16)
    got = got.filter((F.length("lf") == 5) & (F.length("rf") == 5))
    assert plan(got).count("substring(seq") == 2
    want = {(i, text[i * 3 - 5:i * 3], text[i * 3 + 2 + i % 4:][:5]) for i in range(2, 50)}
    assert {(r.id, r.lf, r.rf) for r in got.collect()} == {x for x in want if len(x[1]) == len(x[2]) == 5}


def test_draws_of_large_pieces_are_made_by_blocks(monkeypatch):
    """Blocks of 2^16 rows take 16 bits a draw, the rest of a piece is scaled; all draws are made, evenly."""
    size = 2 * (1 << 16) + 1000
    about = {"_size": size, "_sizes": [size], "_n": size, "_at": 0, "_piece": 3}
    drawn = np.array([resampling.times(5, about, r, size) for r in range(40)])
    assert (drawn.sum(1) == size).all() and drawn.shape == (40, size)
    bits = np.random.SFC64([5, 7, 3])
    split = np.random.Generator(bits).multinomial(size, np.array([65536, 65536, 1000]) / size)
    assert np.array_equal(drawn[7, :65536], np.bincount(bits.random_raw(-(-int(split[0]) // 4)).view(np.uint16)[:split[0]], minlength=65536))
    means = drawn.mean(0)
    for part in (means[:65536], means[65536:131072], means[131072:]):
        assert abs(part.mean() - 1) < 5 / np.sqrt(40 * len(part)) and abs(part.var() * 40 - 1) < 8 / np.sqrt(len(part))
    assert abs(np.corrcoef(drawn[0], drawn[1])[0, 1]) < 5 / np.sqrt(size)
    small = {**about, "_size": 100, "_sizes": [100], "_n": 100}
    raw = np.random.Philox(key=np.array([5, 0], np.uint64), counter=np.array([0, 0, 3, 0], np.uint64)).random_raw(100)
    assert np.array_equal(resampling.times(5, small, 0, 100), np.bincount([int((int(x) >> 11) / 2**53 * 100) for x in raw], minlength=100))


def test_ranks_of_several_pieces_move_no_drawn_rows(spark, monkeypatch):
    """Spearman's intervals of groups of several pieces are those of the drawn rows themselves, which only groups beyond RANK_ROWS send."""
    monkeypatch.setattr(resampling, "PIECE_ROWS", 20)
    rows = [(i, i % 2, float(i * 7 % 31), float(i * 5 % 23), 1.0 if i % 2 else float(i % 4)) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, g int, pred_a double, true_a double, pred_b double").withColumn("true_b", F.col("true_a"))
    seen = []
    for bound in (1 << 23, 1):
        monkeypatch.setattr(metrics, "RANK_ROWS", bound)
        if bound > 1:
            monkeypatch.setattr(metrics, "_drawn_ranks", None)
        got = metrics.bootstrap_metrics(df.repartition(3), ["a", "b"], 15, 0.9, per=["g"]).filter("metric = 'Spearman_r'").collect()
        seen.append({(r.g, r.task): (r.lo, r.hi, r.n_boot) for r in got})
        monkeypatch.undo()
        monkeypatch.setattr(resampling, "PIECE_ROWS", 20)
    assert seen[0].keys() == seen[1].keys() and len(seen[0]) == 4
    for key, (lo, hi, n) in seen[0].items():
        assert (lo, hi, n) == ((None, None, 0) if key == (1, "b") else (pytest.approx(seen[1][key][0]), pytest.approx(seen[1][key][1]), 15))
