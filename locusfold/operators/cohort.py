"""Cohort filters and locus statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def genotype_locus_stats(calls: DataFrame, samples: DataFrame) -> DataFrame:
    """Per locus over the kept samples: heterozygosity 1 - sum p^2, most frequent allele (the smallest on ties), calls.

    `calls` has locus, sample, allele_1, allele_2; a call without a null allele counts.
    """
    called = calls.join(samples.select("sample").distinct(), "sample", "left_semi").filter("allele_1 is not null and allele_2 is not null")
    alleles = called.select("locus", F.explode(F.array("allele_1", "allele_2")).alias("allele"))
    counts = alleles.groupBy("locus", "allele").agg(F.count("*").alias("n"))
    n = F.sum("n")
    return counts.groupBy("locus").agg(
        (1 - F.sum(F.col("n") * F.col("n")) / (n * n)).alias("heterozygosity"),
        F.max_by("allele", F.struct(F.col("n"), -F.col("allele"))).alias("mode_allele"), (n / 2).cast("long").alias("numcalled"),
    )


def concat_chromosomes(spark: SparkSession, paths: Sequence[str], schema: str) -> DataFrame:
    return spark.read.schema(schema).option("sep", "\t").option("header", True).csv(list(paths))


def drop_trio_children(ped: DataFrame, samples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, removed) sample ids. A child has a parent other than "0"; samples without a pedigree row are dropped too."""
    known = ped.join(samples.select("SampleID").distinct(), "SampleID", "left_semi")
    child = (F.col("FatherID").cast("string") != "0") | (F.col("MotherID").cast("string") != "0")
    kept = known.filter(~child).select("SampleID").distinct()
    return kept, samples.select("SampleID").distinct().join(kept, "SampleID", "left_anti")


def cohort_counts(kept: DataFrame, by: str) -> DataFrame:
    """Members by a column; for Sex, 1 is male, 2 female, anything else unknown."""
    value = F.col(by)
    if by == "Sex":
        text = value.cast("string")
        value = F.when(text == "1", "male").when(text == "2", "female").otherwise("unknown")
    return kept.groupBy(value.alias(by)).agg(F.count("*").alias("n"))


def motif_length_counts(loci: DataFrame) -> DataFrame:
    """Loci per motif length; the row without a length is the total."""
    return loci.rollup("motif_len").agg(F.count("*").alias("n"))


def to_half_open(df: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    return df.withColumn(start, F.col(start) - 1)


def motif_unit_length(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with unit_len, one row that tells whether it is uniform and fits the motif column)."""
    unit = F.rint((F.col("str_end") - F.col("str_start")) / F.nullif(F.col("ref_copy_number"), F.lit(0.0))).cast("long")
    out = df.withColumn("unit_len", unit)
    blank = F.coalesce(F.trim("motif"), F.lit("")) == ""
    check = out.agg(
        F.countDistinct("unit_len").alias("n_lengths"),
        F.count_if(~blank & (F.length("motif") != F.col("unit_len"))).alias("n_mismatch"),
    ).withColumn("uniform", F.col("n_lengths") <= 1)
    return out, check
