"""Tables as streams: cut into files that a file source reads in order, those of one part a batch; and streams run to their end."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gaugeworks.sources.usage import shared_folder


def folder(spark: SparkSession) -> str:
    """A new folder that all executors share."""
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def cut(table: DataFrame, part: Column, path: str, rows_a_file: int = 500_000) -> int:
    """The table as files under `path`, appended part by part in the order of `part` (few values); returns how many files each part is.

    Large parts are several files, dealt out evenly and as many for each part, so that no task writes or reads a part alone.
    """
    rows = table.withColumn("__part", part)
    sizes = {r[0]: r[1] for r in rows.groupBy("__part").count().collect()}  # a row a part
    files = max(1, min(sizes.values(), default=0) // rows_a_file)
    for r in sorted(sizes):
        one = rows.where(F.col("__part") == F.lit(r)).drop("__part")
        (one.coalesce(1) if files == 1 else one.repartition(files)).write.mode("append").parquet(path)
    return files


def streamed(session: SparkSession, table: DataFrame, part: Column) -> DataFrame:
    """A stream of the table's rows, one part a batch."""
    path = folder(session)
    files = cut(table, part, path)
    return session.readStream.schema(table.schema).option("maxFilesPerTrigger", files).parquet(path)


def drained(out: DataFrame, path: str, mode: str = "append", **options):
    """Run a stream until its source has no more, into files under `path`/out. Returns the ended query."""
    query = out.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", f"{path}/checkpoint").option("path", f"{path}/out").options(**options).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
