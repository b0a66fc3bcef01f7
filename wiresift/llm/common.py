"""What the operators share: tables in the shared folder, distributed ranks, connected components."""
from __future__ import annotations

import gc
import re
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wiresift.session import ensure_checkpoint_dir


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def quoted(name: str) -> str:
    """A column name as SQL text, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def unused(names: list[str], name: str) -> str:
    """`name`, or a longer one that is not among `names` (letters of either case)."""
    taken = {x.lower() for x in names}
    while name.lower() in taken:
        name += "_"
    return name


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the cluster shares (spark.checkpoint.dir)."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Bytes of an Arrow batch between Spark and Python at most; Spark's own default, 64 MB, is held several times over by each worker.
BATCH = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Keep the session's Arrow batches at `BATCH` bytes or less (a single longer row is a batch of its own)."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not spark.conf.isModifiable(name):
        return
    now = re.fullmatch(r"(\d+)b?", spark.conf.get(name))
    if now is None or int(now[1]) > BATCH:
        spark.conf.set(name, f"{BATCH}b")


def bundles(parts, end: bytes, rows: int, size: int):
    """`parts` (bytes) joined by `end`, at most `rows` of them and about `size` bytes a piece; a longer part is a piece of its own."""
    held, n = [], 0
    for part in parts:
        if held and (len(held) >= rows or n + len(part) + len(end) > size):
            yield end.join(held)
            held, n = [], 0
        held.append(part)
        n += len(part) + len(end)
    if held:
        yield end.join(held)


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` written as a table in the shared folder and read back: lineage ends here, and lost executors cost nothing of it."""
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop shuffle files of finished steps; it only learns of them when both sides of the driver collect garbage."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def with_rank(df: DataFrame, group: Column, order: list[Column], spread: Column, out: str = "rank", per_bucket: int = 2000) -> DataFrame:
    """`df` with a gapless 0-based rank inside each `group` by (bucket of `spread`, *order), without a task that holds a group.

    `spread` is a long over the whole range of 64 bits (a hash) or a fraction below 1 (a double): its leading part cuts each group into
    buckets of about `per_bucket` rows. Buckets are counted first, so that a row's rank is its place in its bucket plus one offset.
    """
    kind = df.select(spread.alias("x")).schema["x"].dataType.simpleString()
    buckets = max(1, -(-df.count() // per_bucket))
    place = F.floor(spread * F.lit(buckets)).cast("long") if kind == "double" else F.floor((F.shiftrightunsigned(spread, 11) / F.lit(float(1 << 53))) * F.lit(buckets)).cast("long")
    keyed = df.withColumns({"__wr_g": group, "__wr_b": F.greatest(F.lit(0), F.least(F.lit(buckets - 1), place))})
    before = Window.partitionBy("__wr_g").orderBy("__wr_b").rowsBetween(Window.unboundedPreceding, -1)
    counts = keyed.groupBy("__wr_g", "__wr_b").agg(F.count(F.lit(1)).alias("__wr_n"))
    starts = counts.select("__wr_g", "__wr_b", F.coalesce(F.sum("__wr_n").over(before), F.lit(0)).alias("__wr_start"))
    inside = keyed.withColumn("__wr_i", F.row_number().over(Window.partitionBy("__wr_g", "__wr_b").orderBy(*order)))
    return (inside.join(starts, ["__wr_g", "__wr_b"]).withColumn(out, (F.col("__wr_start") + F.col("__wr_i") - 1).cast("long")).drop("__wr_g", "__wr_b", "__wr_i", "__wr_start"))


def components(edges: DataFrame, name: str = "labels") -> DataFrame:
    """(node, label) with the smallest node reachable over `edges` (a, b), by least neighbour labels and pointer jumping.

    Every step is a grouped minimum or a join on one node; labels are written between rounds, so no link ever passes through the driver.
    """
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), f"{name}-edges")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")), name)
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        low = labels.join(near, "node", "left").select("node", F.col("label").alias("was"), F.least("label", F.coalesce("near", "label")).alias("low"))
        up = labels.select(F.col("node").alias("low"), F.col("label").alias("upper"))
        jumped = low.join(up, "low", "left").select("node", "was", F.least("low", F.coalesce("upper", "low")).alias("label"))
        step = stored(jumped, name)
        moved = step.where("label <> was").limit(1).count()
        labels = step.select("node", "label")
        if not moved:
            return labels
