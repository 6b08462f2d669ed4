"""Locus data derived from the given tables, in Spark and, for the oracles, as SQL of the same meaning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
BASES = ("ACGT" * 13)[:52]
HEX, HEX_BASES = "0123456789abcdef", "ACGT" * 4
FLANK = 24
CHUNK = 512

SQL = {
    "loci": "SELECT o_orderkey AS id, 'chr' || (o_custkey % 22 + 1) AS chrom, o_orderkey * 40 AS str_start, o_orderkey * 40 + 1 + o_custkey % 50 AS str_end FROM orders",
    "stats": "SELECT o_orderkey AS id, 'chr' || (o_custkey % 24 + 1) AS chrom, o_orderkey * 40 AS \"start\", o_orderkey * 40 + 12 AS \"end\", o_custkey % 6 + 1 AS motif_len, 12.0 / (o_custkey % 6 + 1) AS ref_copy_number, o_custkey * 3 AS numcalled, o_totalprice / 1000 AS mode, (o_custkey % 100) / 100.0 AS het, CASE o_orderkey % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'val' ELSE 'test' END AS split, o_orderkey % 2 = 1 AS rev_comp FROM orders",
    "regions": "SELECT 'chr' || (l_suppkey % 22 + 1) AS chrom, l_orderkey * 40 AS \"start\", l_orderkey * 40 + l_quantity::BIGINT AS \"end\", l_returnflag AS region_class, CASE l_linenumber % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'val' ELSE 'test' END AS split FROM lineitem",
    "segments": "SELECT * FROM (SELECT 'chr' || (user_id % 22 + 1) AS chrom, event_id * 60 AS \"start\", lead(event_id * 60) OVER (PARTITION BY user_id % 22 ORDER BY event_id) AS \"end\", (event_id % 5) || '_' || event_type AS segment_name FROM events) WHERE \"end\" IS NOT NULL",
    "genome": f"SELECT 'doc' || doc_id AS chrom, translate(regexp_replace(text, '[^A-Za-z]', '', 'g'), '{LETTERS}', '{BASES}') AS seq FROM documents",
    # w is the text around the tract with its flanks, o the tract's place there
    "tracts": f"SELECT *, str_start - a AS o, substr(seq, a + 1, str_end + {FLANK} - a) AS w FROM (SELECT *, greatest(str_start - {FLANK}, 0) AS a FROM (SELECT chrom || '_' || j AS id, chrom, seq, n AS chrom_len, (n // 2) % 13 + {FLANK} * j AS str_start, least((n // 2) % 13 + {FLANK} * j + 2 + j % 4, n) AS str_end, (1 + j % 2)::INT AS motif_len FROM (SELECT *, length(seq) AS n, unnest(range(0, CASE WHEN length(seq) = 0 THEN 0 ELSE (length(seq) - 1 - (length(seq) // 2) % 13) // {FLANK} + 1 END)) AS j FROM genome)))",
    "pieces": f"SELECT chrom, i * {CHUNK} AS off, substr(seq, i * {CHUNK} + 1, {CHUNK} + 3) AS piece FROM (SELECT *, unnest(range(0, length(seq) // {CHUNK} + 1)) AS i FROM genome)",
    "words": f"SELECT id, w, count(*) AS n FROM (SELECT chrom AS id, substr(piece, j, 4) AS w FROM (SELECT chrom, piece, unnest(range(1, least({CHUNK}, length(piece) - 3) + 1)) AS j FROM pieces)) GROUP BY ALL",
    "ped": "SELECT n_name AS FamilyID, 'S' || c_custkey AS SampleID, CASE WHEN c_custkey % 7 = 0 THEN 'S' || (c_custkey - 1) ELSE '0' END AS FatherID, CASE WHEN c_custkey % 11 = 0 THEN 'S' || (c_custkey - 2) ELSE '0' END AS MotherID, (c_custkey % 3)::VARCHAR AS Sex, n_name AS Population, r_name AS Superpopulation FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    "calls": "SELECT l_partkey AS locus, l_suppkey AS sample, l_quantity::BIGINT AS allele_1, l_linenumber::BIGINT AS allele_2 FROM lineitem",
    "preds": "SELECT o_orderkey // 2 AS id, o_orderkey % 2 = 1 AS rev_comp, o_custkey % 6 + 1 AS motif_len, 'm' || (o_custkey % 4) AS run, o_totalprice / 1000 AS true_length, 0.9 * o_totalprice / 1000 + o_custkey % 17 AS pred_length, (o_custkey % 100) / 100.0 AS true_variation, (o_custkey % 100) / 200.0 + (o_orderkey % 7) / 20.0 AS pred_variation, CASE o_custkey % 5 WHEN 0 THEN 'val' WHEN 1 THEN 'test' ELSE 'train' END AS split, o_orderpriority AS motif FROM orders",
    "attr": f"SELECT vec_id // 2 AS id, vec_id % 2 = 1 AS rev_comp, 'length' AS task, embedding::DOUBLE[] AS attr, 2.0 + (vec_id % 7) / 10.0 AS pred, 1.5 AS base, (vec_id % 11) / 100.0 AS delta, 'AC' || label AS motif_class, translate(md5('a' || (vec_id // 2)) || md5('b' || (vec_id // 2)), '{HEX}', '{HEX_BASES}') AS sequence FROM embeddings",
    "kmers": "SELECT o_orderkey AS obs, (o_custkey % 10 + 1)::INT AS distance, o_totalprice / 1000 - 150 AS ig_score, 'K' || (o_orderkey % 12) AS kmer, 'A' || (o_custkey % 2) AS motif_class FROM orders",
    "perturbed": "SELECT o_orderkey // 8 AS id, (o_orderkey // 4) % 2 = 1 AS rev_comp, o_orderkey % 4 AS region_id, (o_custkey % 3)::INT AS perm, 'length' AS task, (o_orderkey // 4 % 50 + 10)::DOUBLE AS baseline, (o_orderkey // 4 % 50 + 10) + (o_totalprice % 100) / 10 AS permuted FROM orders",
    "profiles": "SELECT vec_id AS id, (i * 100 + 50)::DOUBLE AS midpoint, embedding[i + 1]::DOUBLE AS value FROM embeddings, (SELECT unnest(range(0, 64)) AS i)",
}
_NEEDS = {"tracts": ["genome"], "pieces": ["genome"], "words": ["genome", "pieces"]}


def sql(body: str, *names: str) -> str:
    """A query over derived tables."""
    wanted: list[str] = []
    for n in names:
        for x in [*_NEEDS.get(n, []), n]:
            if x not in wanted:
                wanted.append(x)
    return "WITH " + ", ".join(f"{n} AS ({SQL[n]})" for n in wanted) + " " + body


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _split3(c: str):
    return F.when(F.col(c) % 3 == 0, "train").when(F.col(c) % 3 == 1, "val").otherwise("test")


def loci(spark: SparkSession, d: str) -> DataFrame:
    start = F.col("o_orderkey") * 40
    return _read(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), F.concat(F.lit("chr"), F.col("o_custkey") % 22 + 1).alias("chrom"), start.alias("str_start"), (start + 1 + F.col("o_custkey") % 50).alias("str_end")
    )


def stats(spark: SparkSession, d: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return _read(spark, d, "orders").select(
        k.alias("id"), F.concat(F.lit("chr"), c % 24 + 1).alias("chrom"), (k * 40).alias("start"), (k * 40 + 12).alias("end"), (c % 6 + 1).alias("motif_len"),
        (F.lit(12.0) / (c % 6 + 1)).alias("ref_copy_number"), (c * 3).alias("numcalled"), (F.col("o_totalprice") / 1000).alias("mode"), (c % 100 / 100.0).alias("het"),
        _split3("o_orderkey").alias("split"), (k % 2 == 1).alias("rev_comp"),
    )


def regions(spark: SparkSession, d: str) -> DataFrame:
    start = F.col("l_orderkey") * 40
    return _read(spark, d, "lineitem").select(
        F.concat(F.lit("chr"), F.col("l_suppkey") % 22 + 1).alias("chrom"), start.alias("start"), (start + F.col("l_quantity").cast("long")).alias("end"),
        F.col("l_returnflag").alias("region_class"), _split3("l_linenumber").alias("split"),
    )


def segments(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy(F.col("user_id") % 22).orderBy("event_id")
    return _read(spark, d, "events").select(
        F.concat(F.lit("chr"), F.col("user_id") % 22 + 1).alias("chrom"), (F.col("event_id") * 60).alias("start"), F.lead(F.col("event_id") * 60).over(w).alias("end"),
        F.concat((F.col("event_id") % 5).cast("string"), F.lit("_"), "event_type").alias("segment_name"),
    ).filter("end is not null")


def genome(spark: SparkSession, d: str) -> DataFrame:
    seq = F.translate(F.regexp_replace("text", "[^A-Za-z]", ""), LETTERS, BASES)
    return _read(spark, d, "documents").select(F.concat(F.lit("doc"), F.col("doc_id")).alias("chrom"), seq.alias("seq"))


def chunks(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    from ..operators.sequence import genome_chunks

    return genome_chunks(genome(spark, d), CHUNK)


def tracts(spark: SparkSession, d: str) -> DataFrame:
    """A locus at every FLANK letters of every text, so that each letter lies in some window."""
    at = F.floor(F.col("n") / 2) % 13
    size = F.length(F.regexp_replace("text", "[^A-Za-z]", "")).cast("long")  # of the sequence, without its translation
    g = _read(spark, d, "documents").select(F.concat(F.lit("doc"), F.col("doc_id")).alias("chrom"), size.alias("n")).withColumn("at", at)
    last = F.floor((F.col("n") - 1 - F.col("at")) / FLANK)
    g = g.withColumn("j", F.explode(F.when(F.col("n") > 0, F.sequence(F.lit(0).cast("long"), last))))  # no filter, which would count the letters a second time
    start = F.col("at") + F.col("j") * FLANK
    return g.select(
        F.concat_ws("_", "chrom", "j").alias("id"), "chrom", start.alias("str_start"), F.least(start + 2 + F.col("j") % 4, F.col("n")).alias("str_end"), (1 + F.col("j") % 2).cast("int").alias("motif_len")
    )


def ped(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    name = lambda x: F.concat(F.lit("S"), x)
    joined = _read(spark, d, "customer").join(_read(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(_read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.select(
        F.col("n_name").alias("FamilyID"), name(k).alias("SampleID"), F.when(k % 7 == 0, name(k - 1)).otherwise("0").alias("FatherID"), F.when(k % 11 == 0, name(k - 2)).otherwise("0").alias("MotherID"),
        (k % 3).cast("string").alias("Sex"), F.col("n_name").alias("Population"), F.col("r_name").alias("Superpopulation"),
    )


def calls(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "lineitem").select(
        F.col("l_partkey").alias("locus"), F.col("l_suppkey").alias("sample"), F.col("l_quantity").cast("long").alias("allele_1"), F.col("l_linenumber").cast("long").alias("allele_2")
    )


def preds(spark: SparkSession, d: str) -> DataFrame:
    k, c, t = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_totalprice")
    return _read(spark, d, "orders").select(
        F.expr("o_orderkey div 2").alias("id"), (k % 2 == 1).alias("rev_comp"), (c % 6 + 1).alias("motif_len"), F.concat(F.lit("m"), c % 4).alias("run"), (t / 1000).alias("true_length"),
        (F.lit(0.9) * t / 1000 + c % 17).alias("pred_length"), (c % 100 / 100.0).alias("true_variation"), (c % 100 / 200.0 + k % 7 / 20.0).alias("pred_variation"),
        F.when(c % 5 == 0, "val").when(c % 5 == 1, "test").otherwise("train").alias("split"), F.col("o_orderpriority").alias("motif"),
    )


def attr(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("vec_id")
    half = F.expr("vec_id div 2")
    seq = F.translate(F.concat(F.md5(F.concat(F.lit("a"), half)), F.md5(F.concat(F.lit("b"), half))), HEX, HEX_BASES)
    return _read(spark, d, "embeddings").select(
        half.alias("id"), (v % 2 == 1).alias("rev_comp"), F.lit("length").alias("task"), F.col("embedding").cast("array<double>").alias("attr"), (2.0 + v % 7 / 10.0).alias("pred"),
        F.lit(1.5).alias("base"), (v % 11 / 100.0).alias("delta"), F.concat(F.lit("AC"), "label").alias("motif_class"), seq.alias("sequence"),
    )


def kmers(spark: SparkSession, d: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return _read(spark, d, "orders").select(
        k.alias("obs"), (c % 10 + 1).cast("int").alias("distance"), (F.col("o_totalprice") / 1000 - 150).alias("ig_score"), F.concat(F.lit("K"), k % 12).alias("kmer"), F.concat(F.lit("A"), c % 2).alias("motif_class")
    )


def perturbed(spark: SparkSession, d: str) -> DataFrame:
    base = F.expr("o_orderkey div 4") % 50 + 10
    return _read(spark, d, "orders").select(
        F.expr("o_orderkey div 8").alias("id"), (F.expr("o_orderkey div 4") % 2 == 1).alias("rev_comp"), (F.col("o_orderkey") % 4).alias("region_id"), (F.col("o_custkey") % 3).cast("int").alias("perm"),
        F.lit("length").alias("task"), base.cast("double").alias("baseline"), (base + F.col("o_totalprice") % 100 / 10).alias("permuted"),
    )


def profiles(spark: SparkSession, d: str) -> DataFrame:
    rows = _read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.posexplode("embedding").alias("i", "value"))
    return rows.select("id", (F.col("i") * 100 + 50).cast("double").alias("midpoint"), F.col("value").cast("double").alias("value"))
