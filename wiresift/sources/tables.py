"""Day tables, tables kept by streams, and exports."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def path_exists(spark: SparkSession, path: str) -> bool:
    _, p, fs = _fs(spark, path)
    return fs.exists(p)


def write_small(spark: SparkSession, path: str, text: str) -> None:
    """A marker or manifest file, replaced whole."""
    jvm, p, fs = _fs(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_small(spark: SparkSession, path: str) -> str | None:
    jvm, p, fs = _fs(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


class BatchTable:
    """What a stream keeps from micro-batch to micro-batch, as Parquet partitions that Spark overwrites dynamically.

    A state table holds the rows as of the batch before and as of this one, in two partitions that take turns; a log has one partition for each batch. Either way a batch that runs again
    reads what the first run read and replaces what it wrote, so every batch counts once. Batch ids are those of one query: 0, 1, 2, ...
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        _, folder, fs = _fs(spark, path)
        fs.mkdirs(folder)

    def _save(self, df: DataFrame, batch_id: int, slot: int) -> None:
        named = df.withColumns({"batch_id": F.lit(batch_id).cast("bigint"), "slot": F.lit(slot).cast("bigint")})
        named.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("slot").parquet(self.path)

    def _load(self, schema) -> DataFrame:
        whole = self.spark.createDataFrame([], schema).schema
        return self.spark.read.schema(T.StructType([*whole, T.StructField("batch_id", T.LongType()), T.StructField("slot", T.LongType())])).parquet(self.path)

    def write(self, df: DataFrame, batch_id: int) -> None:
        """`df` is the state from this batch on."""
        self._save(df, batch_id, batch_id % 2)

    def before(self, batch_id: int, schema) -> DataFrame:
        """The state before a batch: what the one before it wrote, nothing if that was no row."""
        return self._load(schema).where((F.col("slot") == (batch_id - 1) % 2) & (F.col("batch_id") == batch_id - 1)).drop("batch_id", "slot")

    def append(self, df: DataFrame, batch_id: int) -> None:
        """`df` is what this batch adds to a log."""
        self._save(df, batch_id, batch_id)

    def all_before(self, batch_id: int, schema) -> DataFrame:
        """A log's rows of all earlier batches."""
        return self._load(schema).where(F.col("slot") < batch_id).drop("batch_id", "slot")


def _drop_folder(spark: SparkSession, path: str) -> None:
    _, p, fs = _fs(spark, path)
    if fs.exists(p):
        fs.delete(p, True)


def write_day_tables(df: DataFrame, path: str, fingerprints: dict[str, str]) -> list[str]:
    """Write the days named in `fingerprints` as zstd Parquet under `day=<day>`, in one pass over `df` (with a column `day`); returns the days written.

    Days that are there with their fingerprint are left alone, and their rows are not read where `df` prunes by day. The others replace their partitions, which takes the old marker away with the old rows; the markers
    are written last, so a day of an interrupted run has none, or the old one, and is rebuilt. A day without rows is an empty folder with a marker.
    """
    spark = df.sparkSession
    stale = [d for d, f in fingerprints.items() if read_small(spark, f"{path}/day={d}/_FINGERPRINT") != f]
    if stale:
        rows = df.where(F.col("day").isin(stale))
        rows.write.mode("overwrite").option("compression", "zstd").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)
    for d in stale:
        if read_small(spark, f"{path}/day={d}/_FINGERPRINT") is not None:  # the old partition still stands: no row replaced it
            _drop_folder(spark, f"{path}/day={d}")
        write_small(spark, f"{path}/day={d}/_FINGERPRINT", fingerprints[d])
    return stale


def write_day_table(df: DataFrame, path: str, day: str, fingerprint: str) -> bool:
    """One day of `write_day_tables`; True when written."""
    return bool(write_day_tables(df.withColumn("day", F.lit(day)), path, {day: fingerprint}))


def is_current(spark: SparkSession, path: str, day: str, fingerprint: str) -> bool:
    return read_small(spark, f"{path}/day={day}/_FINGERPRINT") == fingerprint


def freshness(spark: SparkSession, maps: str, events: str, day: str, map_version: str) -> list[str]:
    """What is wrong with a day's map and events: map of another version, events missing or built from an older map."""
    problems = []
    if not is_current(spark, maps, day, map_version):
        problems.append("map version")
    have = read_small(spark, f"{events}/day={day}/_FINGERPRINT")
    if have is None:
        problems.append("events missing")
    elif have != f"from:{map_version}":
        problems.append("events older than map")
    return problems


def list_days(days: DataFrame, day: str = "day") -> DataFrame:
    """Day names in date order: `Weekday-DD-MM-YYYY` does not sort as text; unreadable names come first."""
    date = F.try_to_timestamp(F.substring_index(day, "-", -3), F.lit("dd-MM-yyyy")).cast("date")
    return days.select(day).distinct().withColumn("date", date).orderBy(F.col("date").asc_nulls_first(), day)


def stage_dataset(df: DataFrame, path: str) -> None:
    """Layout set/portion/day."""
    df.write.mode("overwrite").partitionBy("set", "portion", "day").parquet(path)


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """Days and bytes per (set, portion), from file metadata: one row per file, whatever the file's size."""
    files = spark.read.parquet(path).select("set", "portion", "day", "_metadata.file_path", "_metadata.file_size").distinct()
    return files.groupBy("set", "portion").agg(F.countDistinct("day").alias("days"), F.sum("file_size").alias("bytes"))


def export_window_records(windows: DataFrame, edges: DataFrame, alerts: DataFrame, path: str, label: str | None = None, max_edges: int | None = None, flows: DataFrame | None = None) -> None:
    """One JSON record per window: its features, its graph, its alerts and, where given, its active flows (`operators.flows.active_flows`, already limited per window).

    A record's graph holds all edges of its window, or for a bounded record the `max_edges` that appeared first; that limit
    is applied per task before edges are gathered.
    """
    if max_edges is not None:
        from wiresift.operators.telemetry import cap_by_first_seen
        edges = cap_by_first_seen(edges, max_edges)
    edges = edges.drop("first_frame")
    pack = lambda d, name: d.groupBy("window_index").agg(F.collect_list(F.struct(*[c for c in d.columns if c != "window_index"])).alias(name))
    rec = windows.select("window_index", F.struct(*[c for c in windows.columns if c != "window_index"]).alias("features"))
    out = rec.join(pack(edges, "graph"), "window_index", "left").join(pack(alerts, "alerts"), "window_index", "left")
    if flows is not None:
        out = out.join(pack(flows, "active_flows"), "window_index", "left")
    out.select(F.lit("2.0").alias("schema_version"), "*", F.lit(label).alias("ground_truth")).write.mode("overwrite").json(path)


def append_flow_features(df: DataFrame, path: str) -> None:
    """Append flow features as CSV parts, each with its header."""
    df.write.mode("append").option("header", True).csv(path)


def write_outputs(path: str, **tables: DataFrame) -> DataFrame:
    """Write each table as Parquet under its name and a one-row JSON manifest of row counts; returns the manifest."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    counts = [spark.read.parquet(f"{path}/{n}").agg(F.count(F.lit(1)).alias(n)) for n in tables]
    manifest = counts[0]
    for c in counts[1:]:
        manifest = manifest.join(F.broadcast(c), F.lit(True))
    manifest.coalesce(1).write.mode("overwrite").json(f"{path}/manifest")
    return spark.read.json(f"{path}/manifest")
