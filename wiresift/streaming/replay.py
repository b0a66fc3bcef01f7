"""Replay a table as a stream: time-ordered slices, one per micro-batch, into Parquet or into a batch function."""
from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wiresift.session import ensure_checkpoint_dir, pinned

#: A file's rows, and how many files, read side by side, a micro-batch takes at most.
ROWS_PER_SLICE, FILES_PER_BATCH = 250_000, 16


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder next to the checkpoints, on storage every executor sees."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, position: str, slices: int = 3) -> DataFrame:
    """The table as a streaming DataFrame whose micro-batches are consecutive ranges of `position`.

    One pass over the source sorts it into ranges of about ROWS_PER_SLICE rows, one file each. A micro-batch takes up to FILES_PER_BATCH files that follow each other, so that its
    fixed costs are shared by as many rows as one task a file can read, but never so many that there would be fewer than `slices` micro-batches. The stream takes files by age, so
    their times are set to their order; nothing but those times is done one by one.
    """
    spark = df.sparkSession
    path = scratch(spark, "replay")
    files = max(slices, -(-df.count() // ROWS_PER_SLICE))
    df.repartitionByRange(files, position).sortWithinPartitions(position).write.parquet(path)
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = root.getFileSystem(spark._jsc.hadoopConfiguration())
    parts = sorted(str(x.getPath()) for x in store.listStatus(root) if x.getPath().getName().startswith("part-"))
    for i, part in enumerate(parts):
        store.setTimes(spark._jvm.org.apache.hadoop.fs.Path(part), 1_000_000_000_000 + i * 10_000, -1)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", max(1, min(FILES_PER_BATCH, files // slices))).parquet(path)


def with_last_tick(df: DataFrame, position: str, us: str, ahead_s: int = 14_400) -> DataFrame:
    """Append a copy of the last row far in the future: it closes windows and timers, and stays open itself."""
    last = pinned(df.orderBy(F.col(position).desc()).limit(1))  # found once, not in every pass over the rows
    return df.unionByName(last.withColumns({position: F.col(position) + 1, us: F.col(us) + ahead_s * 1_000_000}))


def run_to_table(stream: DataFrame, checkpoint: str | None = None) -> DataFrame:
    """Run everything available through the query into Parquet and read the result; `checkpoint` names the folder of its state where that is read afterwards."""
    spark = stream.sparkSession
    out = scratch(spark, "out")
    q = (stream.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint or scratch(spark, "state"))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def state_of(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(key, state) of every group that a stopped query with one keyed stage still holds, read by Spark's state reader as of its last batch."""
    return spark.read.format("statestore").load(checkpoint).select("key", F.col("value.groupState").alias("state"))


def run_batches(stream: DataFrame, step: Callable[[DataFrame, int], None]) -> int:
    """Run everything available through `step`; returns the id that the next batch would have."""
    done = [-1]

    def counted(batch: DataFrame, batch_id: int) -> None:
        step(batch, batch_id)
        done.append(batch_id)
    q = stream.writeStream.foreachBatch(counted).option("checkpointLocation", scratch(stream.sparkSession, "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    return done[-1] + 1
