"""Typed readers for packet tables, dissector text and flow-meter CSV."""
from __future__ import annotations

from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wiresift.functions.scalars import canonical_flow_key, payload_len, payload_prefix
from wiresift.plans.ordering import dense_id
from wiresift.session import pinned
from wiresift.sources.schemas import FLOW_REQUIRED, FLOW_STATISTICS, PACKETS

# Dissector fields, in the order a line carries them.
FIELDS = ["frame.time_epoch", "ip.src", "ipv6.src", "ip.dst", "ipv6.dst", "tcp.srcport", "udp.srcport", "tcp.dstport", "udp.dstport", "ip.proto", "ipv6.nxt",
          "frame.len", "frame.number", "ip.ttl", "ipv6.hlim", "tcp.window_size", "tcp.flags.syn", "tcp.flags.ack", "tcp.flags.fin", "tcp.flags.reset", "tcp.flags.push",
          "tcp.flags.urg", "ip.flags.df", "ip.flags.mf", "ip.frag_offset", "tcp.analysis.retransmission", "tcp.payload", "udp.payload"]


def read_packets(spark: SparkSession, path: str) -> DataFrame:
    """A packet table with the fixed schema; captures written before payload was kept read as length 0."""
    return with_payload(spark.read.schema(PACKETS).parquet(path))


def with_payload(packets: DataFrame) -> DataFrame:
    return packets.withColumns({"payload_len": F.coalesce("payload_len", F.lit(0)), "payload": F.coalesce("payload", F.lit(b""))})


def packets_from_field_export(lines: DataFrame, value: str = "value", fields: Sequence[str] = FIELDS) -> DataFrame:
    """Typed packets from tab-separated dissector lines.

    A line with another number of fields, or without a usable time, endpoint, length or frame number, is dropped;
    anything else that does not parse takes its default.
    """
    parts = F.split(value, "\t", -1)
    raw = lines.select(parts.alias("p")).where(F.size("p") == len(fields))
    at = {f: F.nullif(F.trim(F.col("p")[i]), F.lit("")) for i, f in enumerate(fields)}
    first = lambda *names: F.coalesce(*[at[n] for n in names])
    number = lambda kind, *names: F.coalesce(first(*names).try_cast(kind), F.lit(0).cast(kind))
    yes = lambda n: F.coalesce(F.lower(at[n]).isin("1", "true"), F.lit(False)).cast("tinyint")
    body = first("tcp.payload", "udp.payload")
    bytes_ = payload_prefix(body)
    bad = bytes_.isNull()
    out = raw.select(
        at["frame.time_epoch"].try_cast("double").alias("timestamp"), first("ip.src", "ipv6.src").alias("src_ip"), first("ip.dst", "ipv6.dst").alias("dst_ip"),
        number("int", "tcp.srcport", "udp.srcport").alias("src_port"), number("int", "tcp.dstport", "udp.dstport").alias("dst_port"), number("int", "ip.proto", "ipv6.nxt").alias("protocol"),
        at["frame.len"].try_cast("int").alias("length"), at["frame.number"].try_cast("bigint").alias("frame_no"), number("int", "ip.ttl", "ipv6.hlim").alias("ttl"),
        at["ipv6.src"].isNotNull().cast("tinyint").alias("is_ipv6"), number("int", "tcp.window_size").alias("tcp_window"),
        *[yes(f"tcp.flags.{f}").alias(f"tcp_flag_{n}") for f, n in (("syn", "syn"), ("ack", "ack"), ("fin", "fin"), ("reset", "rst"), ("push", "psh"), ("urg", "urg"))],
        yes("ip.flags.df").alias("ip_flag_df"), yes("ip.flags.mf").alias("ip_flag_mf"), number("int", "ip.frag_offset").alias("ip_frag_offset"),
        at["tcp.analysis.retransmission"].isNotNull().cast("tinyint").alias("tcp_retransmission"), payload_len(body).alias("payload_len"),
        F.when(bad, F.lit(b"")).otherwise(bytes_).alias("payload"))
    out = out.na.drop(subset=["timestamp", "src_ip", "dst_ip", "length", "frame_no"])
    return out.withColumn("flow_key", canonical_flow_key(F.col("src_ip"), F.col("src_port"), F.col("dst_ip"), F.col("dst_port"), F.col("protocol")))


def frame_rebase(packets: DataFrame, chunks: DataFrame, chunk_size: int) -> DataFrame:
    """Frame numbers restart in every chunk of a split capture: add the chunk's offset. chunks: chunk, chunk_index."""
    return packets.join(chunks, "chunk").withColumn("frame_no", F.col("frame_no") + F.col("chunk_index").cast("bigint") * chunk_size).drop("chunk_index")


def assign_flow_uid(flows: DataFrame, capture: str = "capture", order: Sequence[str] = ("file", "row")) -> DataFrame:
    """`<capture>#<row>`: dense per capture in source order, continuous across its files.

    One global numbering by (capture, source order); a capture's first number is subtracted, so no capture is one task.
    """
    d = dense_id(flows, [capture, *order], "_n")
    first = d.groupBy(capture).agg(F.min("_n").alias("_first"))
    return d.join(first, capture).withColumn("flow_uid", F.concat_ws("#", F.col(capture), (F.col("_n") - F.col("_first")).cast("string"))).drop("_n", "_first")


def clean_flow_numbers(df: DataFrame, columns: Sequence[str] = FLOW_STATISTICS) -> DataFrame:
    """Statistics as doubles: bad text is null, `Infinity` and `NaN` are kept as numbers; rows with no value at all are dropped."""
    have = [c for c in columns if c in df.columns]
    out = df.withColumns({c: F.col(f"`{c}`").try_cast("double") for c in have})
    return out.where(F.coalesce(*[F.nullif(F.trim(F.col(f"`{c}`").cast("string")), F.lit("")) for c in df.columns if c != "file"]).isNotNull())


def flow_headers(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(file, header, missing): the first line that is not blank of every file under `paths`, and the required columns it lacks; an empty file has no header.

    One pass for all files. Where a line stands inside a scan task is its place in the task's files, so the first line of a file is the least place among
    the lines of its first split; each task sends one row a file.
    """
    lines = spark.read.text(list(paths)).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("begin"), "value").withColumn("place", F.monotonically_increasing_id())
    first = lines.groupBy("file").agg(F.min_by("value", F.when((F.col("begin") == 0) & (F.trim("value") != ""), F.col("place"))).alias("line"))
    names = F.transform(F.split(F.regexp_replace("line", "[\uFEFF\r]", ""), ","), lambda x: F.regexp_replace(x, '^"|"$', ""))
    return first.select("file", names.alias("header")).withColumn("missing", F.array_except(F.array(*[F.lit(c) for c in FLOW_REQUIRED]), F.coalesce("header", F.array().cast("array<string>"))))


def read_flow_csv(spark: SparkSession, paths: Sequence[str], day: str) -> tuple[DataFrame, DataFrame]:
    """(flows, skipped files). A file whose header lacks a required column is reported, not fatal; no usable file is.

    `paths` are files or folders. All headers come from one pass (`flow_headers`), the rows from one scan for each distinct header; no job runs for a
    single file. Files without a line hold no flow and are neither read nor reported.
    """
    headers = pinned(flow_headers(spark, paths))
    by_header = headers.where(F.size("missing") == 0).groupBy("header").agg(F.sort_array(F.collect_list("file")).alias("files")).orderBy("header").collect()
    if not by_header:
        raise ValueError("no flow file has the required columns")
    frames = []
    for header, files in by_header:
        names = [c.lower() for c in header]
        # as Spark's own reader names them: a name that comes twice gets its place, an empty one is called by its place
        schema = T.StructType([T.StructField(f"_c{i}" if not c else f"{c}{i}" if names.count(c.lower()) > 1 else c, T.StringType()) for i, c in enumerate(header)])
        # Spark reports file names as URIs and takes them as plain paths
        raw = spark.read.option("header", True).schema(schema).csv([unquote(f) for f in files])
        wide = [c for c in FLOW_STATISTICS if c not in header]
        frames.append(clean_flow_numbers(raw.withColumn("file", F.col("_metadata.file_path"))).withColumns({c: F.lit(None).cast("double") for c in wide}))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    num = lambda c: F.col(f"`{c}`").try_cast("double")
    out = out.withColumns({c: num(c) for c in ("Src Port", "Dst Port", "Protocol")}).withColumns({
        "day": F.lit(day), "flow_key": canonical_flow_key(F.col("`Src IP`"), num("Src Port"), F.col("`Dst IP`"), num("Dst Port"), num("Protocol"))})
    return out, headers.where(F.size("missing") > 0).select("file", F.concat(F.lit("missing "), F.concat_ws(", ", "missing")).alias("reason"))
