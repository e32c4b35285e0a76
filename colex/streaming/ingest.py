"""Incremental ingest: file streams into snapshots of the lexicon (streaming.deltas keeps it in buckets instead)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.store import upsert
from ..plans.schemas import LEXICON


def read_entries(spark: SparkSession, path: str, files_per_trigger: int = 64) -> DataFrame:
    """New lexicon JSON files of a folder, as a stream under the fixed schema."""
    return spark.readStream.schema(LEXICON).option("maxFilesPerTrigger", files_per_trigger).json(path)


def upsert_into(entries: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Upserts each micro-batch into the snapshots below `target`; snapshot n is complete when
    batch n is, so a batch that is run again rewrites its own snapshot and nothing else."""

    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        last = latest_snapshot(spark, target, before=batch_id)
        store = spark.createDataFrame([], LEXICON) if last is None else last
        placed = batch.withColumn("ord", F.coalesce("ord", F.monotonically_increasing_id()))
        upsert(store, placed).write.mode("overwrite").parquet(f"{target}/snapshot={batch_id}")

    return entries.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_snapshot(spark: SparkSession, target: str, before: int | None = None) -> DataFrame | None:
    """The newest complete snapshot (older than `before`), or None."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(target)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return None
    done = [s.getPath() for s in fs.listStatus(root) if fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    numbers = sorted(int(p.getName().split("=")[1]) for p in done)
    if before is not None:
        numbers = [n for n in numbers if n < before]
    return spark.read.schema(LEXICON).parquet(f"{target}/snapshot={numbers[-1]}") if numbers else None
