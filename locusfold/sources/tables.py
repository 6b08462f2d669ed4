"""Readers and writers of locus tables, interval files, pedigrees, genomes and result folders."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.relational import require_columns
from ..operators.sequence import chunk_lengths, pieces_of
from ..operators.staging import scratch as scratch

REPEAT_CLASSES = "SINE|LINE|LTR|DNA|Satellite|RC|RNA|Retroposon"


def read_table(spark: SparkSession, path: str, schema: str, required: Sequence[str] = (), columns: Sequence[str] | None = None, sep: str = "\t") -> DataFrame:
    """Table with a header; columns are matched by name, so a header without a required one is an error."""
    header = spark.read.option("sep", sep).option("header", True).csv(path)
    require_columns(header, required)
    types = dict(f.split(None, 1) for f in (x.strip() for x in schema.split(",")))
    chosen = [c for c in (columns or header.columns) if c in header.columns]
    return header.select(*[F.expr(f"try_cast(`{c}` as {types.get(c, 'string')})").alias(c) for c in chosen])


def read_bed(spark: SparkSession, path: str, names: Sequence[str] = ("chrom", "start", "end"), split_alias: dict[str, str] | None = None) -> DataFrame:
    """Interval file without a header; split labels are renamed by `split_alias`."""
    schema = ", ".join(f"{n} {'long' if n in ('start', 'end') else 'string'}" for n in names)
    out = spark.read.schema(schema).option("sep", "\t").csv(path)
    if "split" in names:
        split = F.col("split")
        for old, new in (split_alias or {"valid": "val"}).items():
            split = F.when(F.col("split") == old, new).otherwise(split)
        out = out.withColumn("split", split)
    return out


def read_pedigree(spark: SparkSession, path: str, names: Sequence[str] = ("FamilyID", "SampleID", "FatherID", "MotherID", "Sex", "Population", "Superpopulation")) -> DataFrame:
    """White-space table; the header line is the one that starts with the first name."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).filter((F.trim("value") != "") & (F.element_at(parts, 1) != names[0]))
    return rows.select(*[F.get(parts, F.lit(i)).alias(n) for i, n in enumerate(names)])


def read_id_list(spark: SparkSession, path: str, name: str = "SampleID") -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias(name)).filter(F.col(name) != "").distinct().orderBy(name)


def read_fasta(spark: SparkSession, path: str, chunk_bp: int = 32768) -> tuple[DataFrame, DataFrame]:
    """(chunks, lengths) of FASTA files, in upper case; a record without letters has one empty chunk.

    Lines are read in blocks of a file. What a block needs from those before it (the name of the
    record that goes on, and the letters that it has so far) comes from a table with a row a block.
    Lines before the first header are left out.
    """
    head = F.col("value").startswith(">")
    lines = spark.read.text(path).select(
        F.when(head, "").otherwise(F.upper(F.regexp_replace("value", r"\s", ""))).alias("line"), F.when(head, F.regexp_extract("value", r"^>\s*(\S*)", 1)).alias("name"),
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"),
    )
    # record 0 of a block goes on from the block before
    lines = lines.withColumn("record", F.count("name").over(Window.partitionBy("file", "block").orderBy("at")))
    within = Window.partitionBy("file", "block", "record").orderBy("at")
    size = F.length("line").cast("long")
    placed = lines.withColumn("chrom", F.first("name").over(within)).withColumn("off", F.sum(size).over(within) - size)
    ends = placed.groupBy("file", "block", "record").agg(F.first("chrom").alias("chrom"), F.sum(size).alias("n"))
    blocks = ends.groupBy("file", "block").agg(F.max("record").alias("last"), F.max_by("chrom", "record").alias("chrom"), F.max_by("n", "record").alias("n"))
    order = Window.partitionBy("file").orderBy("block")
    blocks = blocks.withColumn("run", F.count_if(F.col("last") > 0).over(order))
    blocks = blocks.withColumn("upto", F.sum("n").over(Window.partitionBy("file", "run").orderBy("block")))
    carried = blocks.select(
        "file", "block", F.last("chrom", True).over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("open"), F.coalesce(F.lag("upto").over(order), F.lit(0)).alias("so_far")
    )
    own = F.col("record") > 0
    rows = placed.join(carried, ["file", "block"]).select(
        F.when(own, F.col("chrom")).otherwise(F.col("open")).alias("chrom"), F.when(own, F.col("off")).otherwise(F.col("off") + F.col("so_far")).alias("off"), "line"
    )
    return _chunked(rows.filter("chrom is not null"), chunk_bp)


def _chunked(lines: DataFrame, chunk_bp: int) -> tuple[DataFrame, DataFrame]:
    """(chunks, lengths) of (chrom, off, line): lines are cut at the borders of chunks and put together there."""
    room = chunk_bp - F.col("off") % chunk_bp
    rest = F.substring("line", (room + 1).cast("int"), F.length("line"))
    parts = F.concat(F.array(F.left("line", room)), F.when(rest == "", F.array().cast("array<string>")).otherwise(pieces_of(rest, chunk_bp)))
    cut = lines.select("chrom", "off", F.posexplode(parts).alias("i", "part")).select(
        "chrom", (F.floor(F.col("off") / chunk_bp) + F.col("i")).alias("chunk_idx"), F.struct(F.when(F.col("i") == 0, F.col("off") % chunk_bp).otherwise(0).alias("at"), "part").alias("p")
    ).filter("chunk_idx = 0 or p.part <> ''")
    chunks = cut.groupBy("chrom", "chunk_idx").agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda x: x["part"]), "").alias("seq"))
    chunks = chunks.select("chrom", "chunk_idx", (F.col("chunk_idx") * chunk_bp).alias("chunk_start"), "seq")
    return chunks, chunk_lengths(chunks)


def write_genome_store(chunks: DataFrame, buckets: int | None = None, name: str | None = None) -> DataFrame:
    """`chunks` written once, dealt into files by (chrom, chunk_idx), and read back: `fetch_window` then shuffles loci alone.

    `buckets` is the number of files' groups, by default that of shuffle partitions; choose it so that one holds some hundred
    MB of bases. `name` is that of a table in the session's catalog (a new one by default); its files lie in the shared folder,
    so that `spark.table(name)` serves later jobs of the application.
    """
    spark = chunks.sparkSession
    name = name or f"genome_{uuid.uuid4().hex}"
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = chunks.repartition(n, "chrom", "chunk_idx")  # each group of files is written by one task
    dealt.write.bucketBy(n, "chrom", "chunk_idx").sortBy("chrom", "chunk_idx").option("path", scratch(spark)).saveAsTable(name)
    return spark.table(name)


def project_region_dump(dump: DataFrame, chrom: str, start: str, end: str, class_col: str | None = None, regex: str | None = REPEAT_CLASSES) -> DataFrame:
    """Region dump to (chrom, start, end[, region_class]); the class must match the pattern anywhere."""
    cols = [F.col(chrom).alias("chrom"), F.col(start).cast("long").alias("start"), F.col(end).cast("long").alias("end")]
    if class_col is None:
        return dump.select(*cols)
    return dump.filter(F.col(class_col).rlike(regex or "")).select(*cols, F.col(class_col).alias("region_class"))


def load_runs(spark: SparkSession, root: str, prefix: str | None = None, filename: str = "predictions_test.tsv") -> DataFrame:
    """One result file per run folder below `root`, tagged with the folder's name; `prefix` keeps it or `prefix_...`."""
    rows = spark.read.option("sep", "\t").option("header", True).option("inferSchema", True).csv(f"{root}/*/{filename}")
    run = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1)
    rows = rows.withColumn("run", run)
    return rows if prefix is None else rows.filter((F.col("run") == prefix) | F.col("run").startswith(f"{prefix}_"))


def write_kmers(df: DataFrame, path: str, files: int | None = None, group_bytes: int = 32 << 20) -> DataFrame:
    """k-mer table with narrow types, written as Parquet in files ordered by distance, and read back.

    A file holds a range of distances, sorted by distance and k-mer, so a filter on distance reads the row groups (of about
    `group_bytes`) and pages that may have one. A distance of many rows is divided among files by a hash of its rows; only
    copies in all columns stay together. `files` is the number of files (by default as many as shuffle partitions, or fewer
    for small tables). Ends of the ranges come from a sample, which reads `df` once more.
    """
    rows = df.withColumn("distance", F.col("distance").cast("short")).withColumn("ig_score", F.col("ig_score").cast("float"))
    ranges = rows.withColumn("_deal", F.xxhash64(*rows.columns)).repartitionByRange(*([files] if files else []), "distance", "_deal")
    ordered = ranges.sortWithinPartitions("distance", "kmer").drop("_deal")
    ordered.write.mode("overwrite").option("parquet.block.size", group_bytes).parquet(path)
    return df.sparkSession.read.schema(ordered.schema).parquet(path)


def general_format(col: Column, digits: int = 6) -> Column:
    """A number with so many significant digits, without trailing zeros."""
    text = F.format_string(f"%.{digits}g", col.cast("double"))
    mantissa, exponent = F.regexp_extract(text, r"^([^e]*)", 1), F.regexp_extract(text, r"(e.*)$", 1)
    stripped = F.when(mantissa.contains("."), F.regexp_replace(mantissa, r"\.?0+$", "")).otherwise(mantissa)
    return F.when(col.isNotNull(), F.concat(stripped, exponent))


def write_tsv(df: DataFrame, path: str, float_digits: int | None = None) -> None:
    if float_digits:
        df = df.withColumns({c: general_format(F.col(c), float_digits) for c, t in df.dtypes if t in ("float", "double")})
    df.write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def write_run_summary(df: DataFrame, aggs: Sequence[Column], path: str) -> DataFrame:
    """One JSON row of run counters, written and returned."""
    out = df.agg(*aggs)
    out.write.mode("overwrite").json(path)
    return out


def normalize_attr_schema(raw: DataFrame, tasks: Sequence[str]) -> DataFrame:
    """Both attribution layouts (suffixed by task with ids, or bare with hipstr_names) as (id, rev_comp, task, attr, pred, base)."""
    key = F.coalesce(*[F.col(c) for c in ("ids", "hipstr_names") if c in raw.columns]).alias("id")
    out = None
    for t in tasks:
        names = {n: f"{n}_{t}" if f"{n}_{t}" in raw.columns else n for n in ("attributions", "predictions", "baseline_predictions")}
        one = raw.select(key, "rev_comp", F.lit(t).alias("task"), F.col(names["attributions"]).alias("attr"), F.col(names["predictions"]).alias("pred"), F.col(names["baseline_predictions"]).alias("base"))
        out = one if out is None else out.unionByName(one)
    return out
