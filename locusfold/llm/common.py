"""Shared pieces of the training-data operators: reading, scratch tables, connected components."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch on the way to Python; texts can be long, so batches stay small.
BATCH_ROWS = 128


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the rows of an Arrow batch, so that a Python worker holds a few MB of text at once."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; where that is unset, a temporary folder of a local session, an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", base)
    return base


def materialize(df: DataFrame) -> DataFrame:
    """Write `df` once to the shared folder and read it back: lineage is cut, nothing is computed twice.

    The files are deleted when the application ends, or by `forget`.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "table")
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def scratch_path(spark: SparkSession, kind: str) -> str:
    """A new path in the shared folder, deleted when the application ends."""
    path = f"{scratch_dir(spark)}/{kind}-{uuid.uuid4().hex}"
    target, files = _file_system(spark, path)
    files.deleteOnExit(target)
    return path


def _file_system(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def forget(*tables: DataFrame) -> None:
    """Deletes the files of materialized tables that nothing reads any more."""
    for df in tables:
        target, files = _file_system(df.sparkSession, df.scratch_path)
        files.delete(target, True)


#: Slots of the bitmaps that tell which rows may have to meet others: 2 MB, whatever the input.
SLOTS = 1 << 24


def slot_bitmap(slots: DataFrame) -> np.ndarray:
    """Bitmap of the distinct values of the one int column of `slots`, each below SLOTS."""
    used = slots.toDF("slot").distinct().withColumn("part", F.shiftright("slot", 14))

    def bits(key, frame: pd.DataFrame) -> pd.DataFrame:
        flags = np.zeros(1 << 14, np.uint8)
        flags[frame["slot"].to_numpy() & 0x3FFF] = 1
        return pd.DataFrame({"part": [key[0]], "bits": [np.packbits(flags).tobytes()]})

    out = np.zeros((SLOTS >> 14, (1 << 14) // 8), np.uint8)
    for r in used.groupBy("part").applyInPandas(bits, "part int, bits binary").collect():  # 1024 rows of 2 KB at most
        out[r[0]] = np.frombuffer(bytes(r[1]), np.uint8)
    return out.reshape(-1)


def may_be_among(ids: DataFrame) -> Callable[[Column], Column]:
    """A test of an id column for membership in the one column of `ids`: never false for a member, false for a null.

    Rows that fail it need no join with `ids`, so that their other columns are not shuffled.
    """

    def slot(col: Column) -> Column:
        return F.pmod(F.xxhash64(col), F.lit(SLOTS)).cast("int")

    name = ids.columns[0]
    known = ids.filter(F.col(name).isNotNull())
    shared = ids.sparkSession.sparkContext.broadcast(slot_bitmap(known.select(slot(F.col(name)))))

    @F.pandas_udf("boolean")
    def marked(at: pd.Series) -> pd.Series:
        at = at.to_numpy(np.int64)
        return pd.Series(shared.value[at >> 3] >> (7 - (at & 7)) & 1 == 1)

    return lambda col: col.isNotNull() & marked(slot(col))


def map_rows(df: DataFrame, schema: str, fn: Callable[[list[dict]], list[dict]] | Callable) -> DataFrame:
    """mapInArrow with `fn(columns: dict[str, list]) -> dict[str, list]` for each batch."""
    from pyspark.sql.types import StructType
    from pyspark.sql.pandas.types import to_arrow_schema

    small_batches(df.sparkSession)
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = fn({name: batch.column(i).to_pylist() for i, name in enumerate(batch.schema.names)})
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


def crc32_of_id(col: Column) -> Column:
    """crc32 of an integer id written as text."""
    return F.crc32(col.cast("string").cast("binary"))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Smallest reachable id of every id that has an edge: (id, component).

    Alternates the large-star and small-star steps until nothing changes; every step is a
    grouped minimum (combined before the shuffle) and a join, so a hub with many neighbours
    never gathers them in one task. Edges with a null end and loops are ignored.
    """
    spark = edges.sparkSession
    e = (
        edges.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v"))
        .filter("u is not null and v is not null and u < v")
        .distinct()
    )
    e = materialize(e)
    state = None
    while True:
        start = e
        # large star: every larger neighbour of x points to the smallest of x and its neighbours
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        e = (
            both.join(least, "u").filter("v > u").select(F.col("m").alias("u"), "v").filter("u < v").distinct()
        )
        # small star: the smaller neighbours of x, and x, point to the smallest of them
        least = e.groupBy(F.col("v").alias("x")).agg(F.min("u").alias("m"))
        e = (
            e.withColumnRenamed("v", "x").join(least, "x")
            .select(F.explode(F.array(F.col("u"), F.col("x"))).alias("v"), F.col("m").alias("u"))
            .filter("u < v").distinct()
        )
        before, e = start, materialize(e.select("u", "v"))
        forget(before)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    return (
        e.groupBy(F.col("v").alias("id")).agg(F.min("u").alias("component"))
        .unionByName(e.select(F.col("u").alias("id"), F.col("u").alias("component")).distinct())
    )
