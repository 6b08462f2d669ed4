"""Queries of the sequence operators on the derived genome."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sequence as s
from ..sources import tables as io
from . import derive as d
from .derive import CHUNK, FLANK, sql
from .registry import query, rounded

_RC = "reverse(translate({0}, 'ACGT', 'TGCA'))"
_ROT = "list_min(list_transform(range(1, length({0}) + 1), lambda i: substr({0} || {0}, i, length({0}))))"


def _words(spark, sf):
    """(id, w, n): the words of four letters of every whole sequence."""
    return s.count_kmers(d.genome(spark, sf).withColumnRenamed("chrom", "id"), "seq", 4).withColumnRenamed("kmer", "w")


def _windows(spark, sf, windows, extra=()):
    chunks, lengths = d.chunks(spark, sf)
    return s.fetch_window(d.tracts(spark, sf), chunks, windows, chunk_bp=CHUNK), chunks, lengths


_LF = "substr(w, 1, o)"
_RF = f"substr(w, o + str_end - str_start + 1, {FLANK})"
_TRACT = "substr(w, o + 1, str_end - str_start)"


@query("genome_chunks", sql(f"SELECT chrom, off // {CHUNK} AS chunk_idx, off AS chunk_start, left(piece, {CHUNK}) AS seq FROM pieces WHERE off = 0 OR piece <> ''", "pieces"))
def genome_chunks(spark, sf):
    return d.chunks(spark, sf)[0]


_FETCHED = sql(f"SELECT id, {_LF} AS lf, {_RF} AS rf, {_TRACT} AS tract FROM tracts", "tracts")


@query("fetch_window", _FETCHED)
def fetch_window(spark, sf):
    return _windows(spark, sf, {"lf": (F.col("str_start") - FLANK, F.col("str_start")), "rf": (F.col("str_end"), F.col("str_end") + FLANK), "tract": (F.col("str_start"), F.col("str_end"))})[0].select("id", "lf", "rf", "tract")


@query("fetch_window_stored", _FETCHED)
def fetch_window_stored(spark, sf):
    store = io.write_genome_store(d.chunks(spark, sf)[0])
    windows = {"lf": (F.col("str_start") - FLANK, F.col("str_start")), "rf": (F.col("str_end"), F.col("str_end") + FLANK), "tract": (F.col("str_start"), F.col("str_end"))}
    return s.fetch_window(d.tracts(spark, sf), store, windows, chunk_bp=CHUNK).select("id", "lf", "rf", "tract")


@query("reverse_complement", sql(f"SELECT chrom AS id, {_RC.format('seq')} AS rc FROM genome", "genome"))
def reverse_complement(spark, sf):
    return d.genome(spark, sf).select(F.col("chrom").alias("id"), s.reverse_complement(F.col("seq")).alias("rc"))


@query("canonical_kmer", sql(f"SELECT id, n, w, least(w, {_RC.format('w')}) AS kmer FROM words", "words"))
def canonical_kmer(spark, sf):
    return _words(spark, sf).select("id", "n", "w", s.canonical_kmer(F.col("w")).alias("kmer"))


@query("rotation_canonical", sql(f"SELECT id, n, w, {_ROT.format('w')} AS motif FROM words", "words"))
def rotation_canonical(spark, sf):
    return _words(spark, sf).select("id", "n", "w", s.rotation_canonical(F.col("w")).alias("motif"))


@query("motif_canonical", sql(f"SELECT id, n, w, least({_ROT.format('w')}, {_ROT.format('(' + _RC.format('w') + ')')}) AS motif FROM words", "words"))
def motif_canonical(spark, sf):
    return _words(spark, sf).select("id", "n", "w", s.motif_canonical(F.col("w")).alias("motif"))


_CLASS = "CASE WHEN substr(w, 2, 1) = substr(w, 3, 1) THEN substr(w, 2, 1) ELSE substr(w, 2, 2) END"


@query("motif_class_from_window", sql(f", c AS (SELECT id, n, w, {_CLASS} AS u FROM words) SELECT id, n, w, CASE WHEN u IN ('A', 'T') THEN 'A' WHEN u IN ('C', 'G') THEN 'C' WHEN u IN ('AC', 'CA', 'GT', 'TG') THEN 'AC' WHEN u IN ('AG', 'GA', 'CT', 'TC') THEN 'AG' WHEN u IN ('AT', 'TA') THEN 'AT' ELSE 'CG' END AS motif_class FROM c", "words"))
def motif_class_from_window(spark, sf):
    return _words(spark, sf).select("id", "n", "w", s.motif_class_from_window(F.concat(F.substring("w", 1, 1), F.lit("X"), F.substring("w", 2, 3)), 1, 4).alias("motif_class"))


@query("motif_vocab", sql(", c AS (SELECT w, n FROM words WHERE strpos(substr(w || w, 2, 6), w) = 0), r AS (SELECT " + _ROT.format("w") + " AS motif, sum(n)::BIGINT AS n FROM c GROUP BY 1) SELECT motif, n FROM r", "words"))
def motif_vocab(spark, sf):
    own = _words(spark, sf).groupBy(s.rotation_canonical(F.col("w")).alias("motif")).agg(F.sum("n").alias("n"))
    return s.motif_vocab(spark, 4).join(own, "motif").select("motif", "n")


_PERFECT = f"({_TRACT} = substr(repeat(substr({_TRACT}, 1, motif_len), 10), 1, length({_TRACT})))"


@query("perfect_repeat", sql(f"SELECT id, {_PERFECT} AS perfect FROM tracts", "tracts"))
def perfect_repeat(spark, sf):
    got, _, _ = _windows(spark, sf, {"tract": (F.col("str_start"), F.col("str_end"))})
    return got.select("id", s.perfect_repeat(F.col("tract"), F.col("motif_len")).alias("perfect"))


_NEXT = "substr(w, o + str_end - str_start + 1, 1)"
_PREV = "CASE WHEN o > 0 THEN substr(w, o, 1) ELSE '' END"
_SIDE = f"CASE WHEN {_NEXT} <> '' AND {_NEXT} = substr({_TRACT}, length({_TRACT}) % motif_len + 1, 1) THEN 'right' WHEN {_PREV} <> '' AND {_PREV} = substr({_TRACT}, motif_len, 1) THEN 'left' END"


@query("boundary_truncated", sql(f"SELECT id, {_SIDE} AS side FROM tracts", "tracts"))
def boundary_truncated(spark, sf):
    got, _, _ = _windows(spark, sf, {"tract": (F.col("str_start"), F.col("str_end")), "p": (F.col("str_start") - 1, F.col("str_start")), "n": (F.col("str_end"), F.col("str_end") + 1)})
    return got.select("id", s.boundary_truncated(F.col("tract"), F.col("p"), F.col("n"), F.col("motif_len")).alias("side"))


_BOUNDS = f"(str_start - {FLANK} >= 0 AND str_end + {FLANK} <= chrom_len)"


@query("flank_in_bounds", sql(f"SELECT id, {_BOUNDS} AS ok FROM tracts", "tracts"))
def flank_in_bounds(spark, sf):
    _, lengths = d.chunks(spark, sf)
    return d.tracts(spark, sf).join(lengths, "chrom").select("id", s.flank_in_bounds(F.col("str_start"), F.col("str_end"), FLANK, F.col("chrom_len")).alias("ok"))


_REASON = f", q AS (SELECT *, CASE WHEN NOT {_PERFECT} THEN 'imperfect' WHEN ({_SIDE}) IS NOT NULL THEN 'truncated' WHEN NOT {_BOUNDS} THEN 'out_of_bounds' ELSE 'kept' END AS reason FROM tracts) "


def _funnel(spark, sf):
    chunks, lengths = d.chunks(spark, sf)
    return s.locus_qc_funnel(d.tracts(spark, sf), chunks, lengths, FLANK, chunk_bp=CHUNK)


@query("locus_qc_funnel", sql(_REASON + "SELECT reason, count(*) AS n FROM q GROUP BY reason", "tracts"))
def locus_qc_funnel(spark, sf):
    return _funnel(spark, sf)[1]


@query("locus_qc_kept", sql(_REASON + f"SELECT id, {_TRACT} AS tract FROM q WHERE reason = 'kept'", "tracts"))
def locus_qc_kept(spark, sf):
    return _funnel(spark, sf)[0].select("id", "tract")


@query("locus_qc_examples", sql(_REASON + f"SELECT reason, id, substr(w, greatest(o - 15, 0) + 1, least(o, 15)) AS before, {_TRACT} AS tract, substr(w, o + str_end - str_start + 1, 15) AS after FROM q QUALIFY row_number() OVER (PARTITION BY reason ORDER BY id) <= 10", "tracts"))
def locus_qc_examples(spark, sf):
    return _funnel(spark, sf)[2].select("reason", "id", "before", "tract", "after")


@query("motif_integrity", sql(f", v AS (SELECT id, least({_ROT.format('w')}, {_ROT.format('(' + _RC.format('w') + ')')}) AS a FROM words) SELECT count(*) FILTER (a NOT IN ('ACGT', 'AACC')) AS n_violations, count(*) AS n_checked FROM v", "words"))
def motif_integrity(spark, sf):
    rows = _words(spark, sf).select(F.col("w").alias("unit"), F.lit("GTAC/AC/CCAA").alias("motif"), F.lit(4).alias("motif_len"))
    return s.motif_integrity(rows)


@query("tile_motif", sql("SELECT id, n, w, substr(repeat(w, 3), 1, 10) AS head, right(repeat(w, 3), 10) AS tail FROM words", "words"))
def tile_motif(spark, sf):
    return _words(spark, sf).select("id", "n", "w", s.tile_motif(F.col("w"), 10).alias("head"), s.tile_motif(F.col("w"), 10, "right").alias("tail"))


_FULL = f"FROM tracts, (SELECT unnest([false, true]) AS rev_comp) WHERE {_BOUNDS}"
_FWD = f"{_LF} || substr(repeat(substr(w, o + 1, motif_len), 6), 1, 6) || '~' || right(repeat(substr(w, o + str_end - str_start - motif_len + 1, motif_len), 6), 6) || {_RF}"


@query("assemble_input", sql(f"SELECT id, rev_comp, 'XX' || replace(CASE WHEN rev_comp THEN {_RC.format(_FWD)} ELSE {_FWD} END, '~', 'XXX') || 'XXXX' AS input {_FULL}", "tracts"))
def assemble_input(spark, sf):
    chunks, lengths = d.chunks(spark, sf)
    loci = d.tracts(spark, sf).join(lengths, "chrom").filter(s.flank_in_bounds(F.col("str_start"), F.col("str_end"), FLANK, F.col("chrom_len"))).drop("chrom_len")
    loci = loci.withColumn("rev_comp", F.explode(F.array(F.lit(False), F.lit(True))))
    return s.assemble_input(loci, chunks, FLANK, 6, 2, 3, 4, chunk_bp=CHUNK).select("id", "rev_comp", "input")


@query("edge_window", sql(f"SELECT id, substr(w, 1, o + 3) AS pre, substr(w, greatest(o + str_end - str_start - 2, 1), o + str_end - str_start + {FLANK} - greatest(o + str_end - str_start - 3, 0)) AS post, str_end - str_start >= 3 AS fits, str_end - str_start < 6 AS edges_overlap FROM tracts", "tracts"))
def edge_window(spark, sf):
    chunks, _ = d.chunks(spark, sf)
    return s.edge_window(d.tracts(spark, sf), chunks, FLANK, 3, chunk_bp=CHUNK).select("id", "pre", "post", "fits", "edges_overlap")


@query("count_kmers", sql(f"SELECT id, kmer, count(*) AS n FROM (SELECT chrom AS id, substr(piece, j, 3) AS kmer FROM (SELECT chrom, piece, unnest(range(1, least({CHUNK}, length(piece) - 2) + 1)) AS j FROM pieces)) GROUP BY ALL", "pieces"))
def count_kmers(spark, sf):
    return s.count_kmers(d.genome(spark, sf).withColumnRenamed("chrom", "id"), "seq", 3)


_EDGES = [(0, 8), (8, FLANK)]
_BINS = f", f AS (SELECT id, {_LF} AS lf, {_RF} AS rf FROM tracts), b AS (SELECT id, 'left' AS side, 0 AS bin, right(lf, 8) AS bases FROM f UNION ALL SELECT id, 'left', 1, CASE WHEN length(lf) >= {FLANK} THEN left(lf, 16) ELSE substr(lf, 1, greatest(length(lf) - 8, 0)) END FROM f UNION ALL SELECT id, 'right', 0, left(rf, 8) FROM f UNION ALL SELECT id, 'right', 1, substr(rf, 9) FROM f) "


def _flanks(spark, sf):
    """The loci whose flanks lie within their chromosome: those that are fetched whole, so no length has to be joined."""
    got, _, _ = _windows(spark, sf, {"lf": (F.col("str_start") - FLANK, F.col("str_start")), "rf": (F.col("str_end"), F.col("str_end") + FLANK)})
    return got.filter((F.length("lf") == FLANK) & (F.length("rf") == FLANK))


_IN = f" SEMI JOIN (SELECT id FROM tracts WHERE {_BOUNDS}) USING (id) "


@query("distance_edges", sql(_BINS + "SELECT id, side, bin, bases FROM b" + _IN, "tracts"))
def distance_edges(spark, sf):
    return s.flank_bins(_flanks(spark, sf), s.distance_edges([8], FLANK), ["id"])


@query("kmer_features", sql(_BINS + ", k AS (SELECT id, side, bin, 3 AS k, unnest(list_transform(range(1, greatest(length(bases) - 1, 1)), lambda i: substr(bases, i, 3))) AS w FROM b" + _IN + " UNION ALL SELECT id, side, bin, 4, unnest(list_transform(range(1, greatest(length(bases) - 2, 1)), lambda i: substr(bases, i, 4))) FROM b" + _IN + ") SELECT id, side || '_bin' || bin || '_' || k || 'mer_' || w AS feature, count(*)::DOUBLE AS value FROM k GROUP BY ALL", "tracts"))
def kmer_features(spark, sf):
    return s.kmer_features(_flanks(spark, sf), _EDGES, (3, 4))


@query("kmer_features_pooled", sql(_BINS + ", k AS (SELECT id, bin, unnest(list_transform(range(1, greatest(length(bases) - 1, 1)), lambda i: substr(bases, i, 3))) AS w FROM b" + _IN + ") SELECT id, 'flank_bin' || bin || '_3mer_' || w AS feature, count(*)::DOUBLE AS value FROM k GROUP BY ALL", "tracts"))
def kmer_features_pooled(spark, sf):
    return s.kmer_features(_flanks(spark, sf), _EDGES, (3,), "pooled")


@query("gc_features", sql(_BINS + "SELECT id, side || '_bin' || bin || '_gc' AS feature, round(sum(length(regexp_replace(bases, '[^GC]', '', 'g'))) / sum(length(bases)), 6) AS value FROM b" + _IN + " GROUP BY ALL", "tracts"))
def gc_features(spark, sf):
    return rounded(s.gc_features(_flanks(spark, sf), _EDGES))


@query("motif_onehot", sql(f", m AS (SELECT id, w, n, rev_comp, substr(w, 1, 2) AS u FROM words, (SELECT unnest([false, true]) AS rev_comp)), c AS (SELECT id, w, n, rev_comp, CASE WHEN rev_comp THEN {_RC.format('u')} ELSE u END AS v FROM m), r AS (SELECT id, w, n, rev_comp, {_ROT.format('v')} AS motif FROM c) SELECT id, w, n, rev_comp, motif, CASE motif WHEN 'AC' THEN 0 WHEN 'AG' THEN 1 WHEN 'AT' THEN 2 WHEN 'CG' THEN 3 WHEN 'CT' THEN 4 WHEN 'GT' THEN 5 END AS place FROM r", "words"))
def motif_onehot(spark, sf):
    rows = _words(spark, sf).withColumn("u", F.substring("w", 1, 2)).withColumn("rev_comp", F.explode(F.array(F.lit(False), F.lit(True))))
    return s.motif_onehot(rows, "u", "rev_comp", 2, ("id", "w", "n")).select("id", "w", "n", "rev_comp", "motif", "place")
