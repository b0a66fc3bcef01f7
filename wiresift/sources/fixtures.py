"""Network views over the driver's tables.

No driver table holds network data, so queries run on deterministic projections of `events`: one packet per event,
with addresses, ports, protocol and flags computed from its columns. The 30 days of events are squeezed by 3600 into
twelve minutes, which gives packet rates for which the operators' default windows and gaps make sense.
Every expression is stated once as SQL and used by Spark and, for the oracles, by DuckDB.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BASE_US = 1704067200000000  # 2024-01-01 00:00:00 UTC
SQUEEZE = 3600

# Shared column expressions, in dependency order: each step may use the columns before it.
PACKET_STEPS: list[dict[str, str]] = [
    {
        "frame_no": "event_id",
        "k": "CAST(regexp_extract(props, '([0-9]+)', 1) AS INT)",
        "user_id": "user_id", "event_type": "event_type", "value": "value", "raw_us": "raw_us",
    },
    {
        "us": f"CAST({BASE_US} + FLOOR((raw_us - {BASE_US}) / {SQUEEZE}.0) AS BIGINT)",
        "src_ip": "'10.0.0.' || CAST(user_id % 40 AS VARCHAR(9))",
        "dst_ip": "'10.0.0.' || CAST(k % 40 AS VARCHAR(9))",
        "src_port": "CAST(49152 + (frame_no * 7919) % 16000 AS INT)",
        "dst_port": "CASE k % 6 WHEN 0 THEN 80 WHEN 1 THEN 443 WHEN 2 THEN 53 WHEN 3 THEN 22 WHEN 4 THEN 445 "
                    "ELSE 1000 + k END",
        "length": "CAST(40 + frame_no * 31 % 1460 AS INT)",
        "label": "CASE WHEN event_type = 'error' THEN 'Attack' ELSE 'Benign' END",
        "family": "CASE WHEN event_type <> 'error' THEN 'Benign' WHEN k % 3 = 0 THEN 'Flood' "
                  "WHEN k % 3 = 1 THEN 'Bot' ELSE 'Web' END",
        "score": "value + CASE WHEN event_type = 'error' THEN 20 ELSE 0 END",
        "capture": "'cap' || CAST(user_id % 3 AS VARCHAR(9))",
    },
    {
        "protocol": "CASE WHEN dst_port = 53 THEN 17 WHEN event_type = 'signup' THEN 1 ELSE 6 END",
        "payload_len": "length - 40",
        "ttl": "CAST(32 + frame_no % 97 AS INT)",
        "tcp_window": "CAST(frame_no * 17 % 65536 AS INT)",
        "tcp_seq": "CAST(frame_no % 50 AS BIGINT)",
        "ip_flag_mf": "CASE WHEN frame_no % 29 = 0 THEN 1 ELSE 0 END",
        "ip_frag_offset": "CASE WHEN frame_no % 31 = 0 THEN 8 ELSE 0 END",
        "tcp_retransmission": "CASE WHEN frame_no % 23 = 0 THEN 1 ELSE 0 END",
    },
    {
        "flags": "CASE WHEN protocol = 6 THEN CAST((frame_no * 13) % 64 AS INT) ELSE 0 END",
        "is_icmp_echo": "protocol = 1 AND k % 2 = 0",
        "is_dns": "dst_port = 53",
        "timestamp": "us / 1000000.0D" ,
    },
    {
        "tcp_flag_syn": "flags % 2",
        "tcp_flag_ack": "CAST(FLOOR(flags / 2.0) AS INT) % 2",
        "tcp_flag_fin": "CAST(FLOOR(flags / 4.0) AS INT) % 2",
        "tcp_flag_rst": "CAST(FLOOR(flags / 8.0) AS INT) % 2",
        "tcp_flag_psh": "CAST(FLOOR(flags / 16.0) AS INT) % 2",
        "tcp_flag_urg": "CAST(FLOOR(flags / 32.0) AS INT) % 2",
    },
]

# The same packets as two-sided conversations: ten clients, eight servers, every third packet is a reply.
CONVERSATION_STEPS: list[dict[str, str]] = [
    {
        "client": "'10.0.0.' || CAST(user_id % 10 AS VARCHAR(9))",
        "server": "'10.0.0.' || CAST(20 + k % 8 AS VARCHAR(9))",
        "client_port": "CAST(50000 + user_id % 10 AS INT)",
        "server_port": "CASE k % 6 WHEN 0 THEN 80 WHEN 1 THEN 443 WHEN 2 THEN 53 WHEN 3 THEN 22 WHEN 4 THEN 445 "
                       "ELSE 8080 END",
        "is_reply": "frame_no % 3 = 0",
    },
    {
        "protocol": "CASE WHEN server_port = 53 THEN 17 ELSE 6 END",
        "src_ip": "CASE WHEN is_reply THEN server ELSE client END",
        "dst_ip": "CASE WHEN is_reply THEN client ELSE server END",
        "src_port": "CASE WHEN is_reply THEN server_port ELSE client_port END",
        "dst_port": "CASE WHEN is_reply THEN client_port ELSE server_port END",
    },
    {
        "flags": "CASE WHEN protocol = 6 THEN CAST((frame_no * 13) % 64 AS INT) ELSE 0 END",
        "flow_key": "client || ':' || CAST(client_port AS VARCHAR(9)) || '|' || server || ':' || "
                    "CAST(server_port AS VARCHAR(9)) || '|' || CAST(protocol AS VARCHAR(9))",
        "slot120": f"CAST(FLOOR((us - {BASE_US}) / 120000000.0) AS BIGINT)",
    },
    PACKET_STEPS[4],
]


def _spark_text(sql: str) -> str:
    return sql.replace("VARCHAR(9)", "STRING")


def _duck_text(sql: str) -> str:
    return sql.replace(".0D", ".0::DOUBLE").replace("VARCHAR(9)", "VARCHAR")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _apply(df: DataFrame, steps) -> DataFrame:
    for step in steps:
        df = df.withColumns({n: F.expr(_spark_text(e)) for n, e in step.items()})
    return df


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One packet per event."""
    raw = table(spark, sf_dir, "events").withColumn("raw_us", F.unix_micros(F.col("ts").cast("timestamp")))
    return _apply(raw, PACKET_STEPS).drop("event_id", "ts", "props", "raw_us")


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets arranged as two-sided conversations with a `flow_key`."""
    return _apply(packets(spark, sf_dir), CONVERSATION_STEPS).drop("client", "server", "client_port", "server_port")


def _cte(name: str, source: str, steps) -> list[str]:
    out, prev, known = [], source, []
    for i, step in enumerate(steps):
        last = i + 1 == len(steps)
        label = name if last else f"{name}_{i}"
        if not known:
            cols = "" if source == "raw_events" else f"* EXCLUDE ({', '.join(c for c in step if c in _PACKET_COLS)}), "
            if source != "raw_events" and not any(c in _PACKET_COLS for c in step):
                cols = "*, "
        else:
            hit = [c for c in step if c in known]
            cols = f"* EXCLUDE ({', '.join(hit)}), " if hit else "*, "
        body = ", ".join(f"{_duck_text(e)} AS {n}" for n, e in step.items())
        out.append(f"{label} AS (SELECT {cols}{body} FROM {prev})")
        known = list(known) + list(step) + (_PACKET_COLS if source != "raw_events" else [])
        prev = label
    return out


_PACKET_COLS = [c for step in PACKET_STEPS for c in step]
PACKETS_CTE = ", ".join(["raw_events AS (SELECT *, epoch_us(ts) AS raw_us FROM events)",
                         *_cte("packets", "raw_events", PACKET_STEPS)])
CONVERSATIONS_CTE = ", ".join([PACKETS_CTE, *_cte("convs", "packets", CONVERSATION_STEPS)])

# Flows of the conversations: one per key and 120 s slot. Even slots run 60 s into the next one, and every slot with
# enough span also holds a nested, shorter flow: windows of a key overlap and contain each other on purpose.
FLOWS_SQL = """
  SELECT flow_key, slot120, CAST(0 AS INT) AS nested, min(us) AS start_us,
         max(us) + CASE WHEN slot120 % 2 = 0 THEN 60000000 ELSE 0 END AS end_us,
         count(*) AS n_packets, min(frame_no) AS first_frame
  FROM {src} GROUP BY flow_key, slot120
  UNION ALL
  SELECT flow_key, slot120, CAST(1 AS INT) AS nested,
         CAST(min(us) + FLOOR((max(us) - min(us)) / 4.0) AS BIGINT) AS start_us,
         CAST(min(us) + FLOOR((max(us) - min(us)) / 2.0) AS BIGINT) AS end_us,
         count(*) AS n_packets, min(frame_no) AS first_frame
  FROM {src} GROUP BY flow_key, slot120 HAVING max(us) - min(us) > 4000000
"""


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flow windows over `conversations`, with a `flow_uid` built from key, slot and nesting."""
    c = conversations(spark, sf_dir)
    g = c.groupBy("flow_key", "slot120").agg(
        F.min("us").alias("lo"), F.max("us").alias("hi"), F.count(F.lit(1)).alias("n_packets"),
        F.min("frame_no").alias("first_frame"))
    span = F.col("hi") - F.col("lo")
    outer = F.struct(
        F.lit(0).alias("nested"), F.col("lo").alias("start_us"),
        (F.col("hi") + F.when(F.col("slot120") % 2 == 0, 60000000).otherwise(0)).alias("end_us"))
    inner = F.struct(
        F.lit(1).alias("nested"), (F.col("lo") + F.floor(span / 4.0)).cast("bigint").alias("start_us"),
        (F.col("lo") + F.floor(span / 2.0)).cast("bigint").alias("end_us"))
    both = F.when(span > 4000000, F.array(outer, inner)).otherwise(F.array(outer))
    return g.select("flow_key", "slot120", "n_packets", "first_frame", F.inline(both)).withColumn(
        "flow_uid", F.concat_ws("#", "flow_key", "slot120", "nested"))


FLOWS_CTE = (CONVERSATIONS_CTE + ", flows_0 AS (" + FLOWS_SQL.format(src="convs") + "), flows AS (SELECT *, flow_key || '#' || "
             "CAST(slot120 AS VARCHAR) || '#' || CAST(nested AS VARCHAR) AS flow_uid FROM flows_0)")
