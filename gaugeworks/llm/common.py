"""Helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from functools import reduce
from operator import and_

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Only a local session without one makes its own."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc._jsc.sc().getCheckpointDir().getOrElse(None)
    if not base:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='gaugeworks-')}"
        sc.setCheckpointDir(base)
    return base.rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage: write `df` as a Parquet table in the shared folder and read it back.

    Lost executors then cost a re-read only. The table goes when the session ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    # the shuffle files of what was cut off go only when the driver's objects do
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return spark.read.schema(df.schema).parquet(path)


def joined_by_hot_keys(rows: DataFrame, counts: DataFrame, on: list[str], row: Column, n: str = "n", other: DataFrame | None = None) -> DataFrame:
    """`rows` joined with `other` (one row a key; `counts` by default), hot keys in many tasks.

    `counts` has one row a key, none of them null; `n` says how many of the rows have it. Keys with more rows than a
    shuffle partition has on average are fewer than the partitions, so they are broadcast. Their rows are dealt over
    twice as many parts as they would fill, by `row`, which must be the same in each attempt.
    """
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = counts.agg(F.sum(n)).first()[0] or 1
    names = [f"__hot{i}" for i in range(len(on))]
    hot = counts.where(F.col(n) > total / partitions).select(*(F.col(c).alias(h) for c, h in zip(on, names)), F.ceil(F.col(n) * (2 * partitions / total)).alias("__parts"))
    # a row of nulls, which meets no key, keeps the plan the same whether or not there are hot keys
    no_key = rows.sparkSession.range(1).select(*(F.lit(None).cast(counts.schema[c].dataType).alias(h) for c, h in zip(on, names)), F.lit(None).cast("long").alias("__parts"))
    hot = F.broadcast(hot.unionByName(no_key))

    def with_parts(df: DataFrame) -> DataFrame:
        return df.join(hot, reduce(and_, (F.col(c).eqNullSafe(F.col(h)) for c, h in zip(on, names))), "left").drop(*names)

    none = F.lit(0).cast("long")
    one = with_parts(rows).withColumn("__part", F.coalesce(F.pmod(F.xxhash64(row), "__parts"), none)).drop("__parts")
    every = with_parts(counts if other is None else other).withColumn("__part", F.explode(F.sequence(none, F.coalesce(F.col("__parts") - 1, none)))).drop("__parts")
    return one.join(every, [*on, "__part"]).drop("__part")


def held_out(doc_id="doc_id"):
    """crc32 of the id as text, mod 4, is 2: rows that no model may learn from. A null id is never held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def released(run):
    """The Arrow function `run`, which at its end gives the memory it held back to the machine: workers outlive tasks."""

    def wrapped(batches):
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # another C library
            pass

    return wrapped
