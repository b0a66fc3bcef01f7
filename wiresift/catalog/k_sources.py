"""Readers, writers, exports and table contracts. Everything is written from the given tables and read back."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wiresift.catalog import d_events as de
from wiresift.catalog import g_scores as gs
from wiresift.catalog.registry import ORACLES, query
from wiresift.operators import features as ft
from wiresift.operators import flows as fl
from wiresift.operators import rules as ru
from wiresift.operators import telemetry as te
from wiresift.sources import fixtures as fx
from wiresift.sources import readers as rd
from wiresift.sources import tables as tb
from wiresift.sources.schemas import FLOW_STATISTICS, RECORD_STATISTICS
from wiresift.streaming.replay import scratch

P = "WITH " + fx.PACKETS_CTE + " "


@query("s01_read_packets", P + "SELECT frame_no, timestamp, src_ip, dst_port, length, 0 AS payload_len, protocol = 6 AND tcp_flag_syn = 1 AS syn FROM packets")
def _s01(spark, d):
    path = scratch(spark, "packets")
    p = fx.packets(spark, d)
    p.select("timestamp", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "length", "frame_no", "ttl", "tcp_window", F.col("tcp_flag_syn").cast("tinyint").alias("tcp_flag_syn")).write.parquet(path)
    r = rd.read_packets(spark, path)
    return r.select("frame_no", "timestamp", "src_ip", "dst_port", "length", "payload_len", ((F.col("protocol") == 6) & (F.col("tcp_flag_syn") == 1)).alias("syn"))


def _flow_files(spark, d):
    root = scratch(spark, "flowcsv")
    p = fx.packets(spark, d)
    rate = F.when(F.col("frame_no") % 7 == 0, "bad").when(F.col("frame_no") % 7 == 1, "Infinity").otherwise(F.col("length").cast("string"))
    rows = p.select("capture", F.col("frame_no").cast("string").alias("Flow ID"), F.col("src_ip").alias("Src IP"), F.col("src_port").alias("Src Port"), F.col("dst_ip").alias("Dst IP"), F.col("dst_port").alias("Dst Port"),
                    F.col("protocol").alias("Protocol"), F.lit("01/01/2024 12:00:00 AM").alias("Timestamp"), (F.col("length") * 10).alias("Flow Duration"), rate.alias("Flow Byts/s"))
    paths = []
    for c in ("cap0", "cap1", "cap2"):
        part = rows.where(F.col("capture") == c).drop("capture")
        (part if c != "cap2" else part.drop("Timestamp")).write.option("header", True).csv(f"{root}/{c}")
        paths.append(f"{root}/{c}")
    return rd.read_flow_csv(spark, paths, "Monday-01-01-2024")


@query("s02_read_flow_csv", P + """SELECT frame_no AS row, src_ip AS src, CASE WHEN frame_no % 7 = 0 THEN NULL WHEN frame_no % 7 = 1 THEN 'inf'::DOUBLE ELSE length::DOUBLE END AS rate, (length * 10)::DOUBLE AS duration
FROM packets WHERE capture <> 'cap2'""")
def _s02(spark, d):
    flows, _ = _flow_files(spark, d)
    return flows.select(F.col("`Flow ID`").cast("bigint").alias("row"), F.col("`Src IP`").alias("src"), F.col("`Flow Byts/s`").alias("rate"), F.col("`Flow Duration`").alias("duration"))


@query("s02_skipped_files", P + "SELECT DISTINCT capture, 'missing Timestamp' AS reason FROM packets WHERE capture = 'cap2'")
def _s02k(spark, d):
    _, skipped = _flow_files(spark, d)
    return skipped.select(F.regexp_extract("file", "/(cap[0-9]+)/", 1).alias("capture"), "reason").distinct()


@query("s03_assign_flow_uid", P + "SELECT frame_no, capture || '#' || (row_number() OVER (PARTITION BY capture ORDER BY k, frame_no) - 1) AS flow_uid FROM packets")
def _s03(spark, d):
    p = fx.packets(spark, d).select("frame_no", "capture", F.col("k").alias("file"), F.col("frame_no").alias("row"))
    return rd.assign_flow_uid(p).select("frame_no", "flow_uid")


def _lines(spark, d):
    n = F.col("frame_no")
    v = {f: F.lit("") for f in rd.FIELDS}
    tcp = F.col("protocol") == 6
    s = lambda c: c.cast("string")
    v |= {"frame.time_epoch": F.when(n % 41 == 0, "soon").otherwise(F.format_string("%.6f", F.col("timestamp"))), "ip.src": F.when(n % 10 == 3, "").otherwise(F.col("src_ip")), "ipv6.src": F.when(n % 10 == 3, "fe80::1").otherwise(""),
          "ip.dst": F.col("dst_ip"), "tcp.srcport": F.when(tcp, s(F.col("src_port"))).otherwise(""), "udp.srcport": F.when(~tcp, s(F.col("src_port"))).otherwise(""), "tcp.dstport": F.when(tcp, s(F.col("dst_port"))).otherwise(""),
          "udp.dstport": F.when(~tcp, "x").otherwise(""), "ip.proto": s(F.col("protocol")), "frame.len": s(F.col("length")), "frame.number": s(n), "ip.ttl": s(F.col("ttl")), "tcp.window_size": s(F.col("tcp_window")),
          "tcp.flags.syn": F.when(F.col("tcp_flag_syn") == 1, F.when(n % 2 == 0, "True").otherwise("1")).otherwise("0"), "tcp.analysis.retransmission": F.when(F.col("tcp_retransmission") == 1, "1").otherwise(""),
          "tcp.payload": F.when(n % 3 == 0, F.expr("repeat('4a:', 199) || '4a'")).when(n % 3 == 1, "474554").otherwise("")}
    line = F.concat_ws("\t", *[v[f] for f in rd.FIELDS])
    return fx.packets(spark, d).select(F.when(n % 37 == 0, F.concat(line, F.lit("\textra"))).otherwise(line).alias("value"))


@query("s04_packets_from_field_export", P + """SELECT frame_no, CASE WHEN frame_no % 10 = 3 THEN 'fe80::1' ELSE src_ip END AS src_ip, CASE WHEN frame_no % 10 = 3 THEN 1 ELSE 0 END AS is_ipv6, src_port, CASE WHEN protocol = 6 THEN dst_port ELSE 0 END AS dst_port,
 tcp_flag_syn AS syn, tcp_retransmission AS retrans, CASE frame_no % 3 WHEN 0 THEN 200 WHEN 1 THEN 3 ELSE 0 END AS payload_len, CASE frame_no % 3 WHEN 0 THEN 128 WHEN 1 THEN 3 ELSE 0 END AS kept FROM packets WHERE frame_no % 41 <> 0 AND frame_no % 37 <> 0""")
def _s04(spark, d):
    p = rd.packets_from_field_export(_lines(spark, d))
    return p.select("frame_no", "src_ip", F.col("is_ipv6").cast("int").alias("is_ipv6"), "src_port", "dst_port", F.col("tcp_flag_syn").cast("int").alias("syn"), F.col("tcp_retransmission").cast("int").alias("retrans"),
                    "payload_len", F.length("payload").alias("kept"))


@query("s05_frame_rebase", P + "SELECT frame_no FROM packets")
def _s05(spark, d):
    p = fx.packets(spark, d).select((F.col("frame_no") % 250).alias("frame_no"), F.concat(F.lit("chunk"), F.floor(F.col("frame_no") / 250).cast("string")).alias("chunk"))
    chunks = p.select("chunk").distinct().withColumn("chunk_index", F.substring("chunk", 6, 20).cast("int"))
    return rd.frame_rebase(p, chunks, 250).select("frame_no")


@query("s08_write_day_table", P + "SELECT CAST(1 + user_id % 3 AS VARCHAR) AS day, count(*) AS rows, true AS first_write, false AS same_again, true AS other_rules FROM packets GROUP BY 1")
def _s08(spark, d):
    root = scratch(spark, "days")
    p = fx.packets(spark, d).select((1 + F.col("user_id") % 3).cast("string").alias("day"), "frame_no")
    marks = [tb.write_day_tables(p, root, dict.fromkeys(("1", "2", "3"), f)) for f in ("rules-a", "rules-a", "rules-b")]
    rows = spark.read.schema("frame_no bigint, day string").parquet(root).groupBy("day").agg(F.count(F.lit(1)).alias("rows"))
    return rows.select("day", "rows", *[F.col("day").isin(m).alias(n) if m else F.lit(False).alias(n) for m, n in zip(marks, ("first_write", "same_again", "other_rules"))])


@query("s09_export_window_records", f"""WITH t AS ({ORACLES['a07_window_telemetry']}), e AS (SELECT window_index, count(*) AS n FROM ({ORACLES['a09_host_graph_edges']}) GROUP BY 1), a AS (SELECT window_index, count(*) AS n FROM ({ORACLES['r14_suspicious_flags']}) GROUP BY 1)
SELECT '2.0' AS schema_version, window_index, total_packets AS packets, COALESCE(e.n, 0) AS edges, COALESCE(a.n, 0) AS alerts, 'Benign' AS ground_truth FROM t LEFT JOIN e USING (window_index) LEFT JOIN a USING (window_index)""")
def _s09(spark, d):
    root = scratch(spark, "windows")
    p = fx.packets(spark, d)
    edges = te.host_graph_edges(p).drop("bare_syn_count")
    alerts = ru.suspicious_flags(ru.RuleInput(p)).select("window_index", "type", "flag_combination")
    tb.export_window_records(te.window_telemetry(p), edges, alerts, root, "Benign")
    back = spark.read.json(root)
    return back.select("schema_version", "window_index", F.col("features.total_packets").alias("packets"), F.coalesce(F.size("graph"), F.lit(0)).cast("bigint").alias("edges"), F.coalesce(F.size("alerts"), F.lit(0)).cast("bigint").alias("alerts"), "ground_truth")


@query("s09_active_flows", de.SHORT + de.STATE_SQL + """
, x AS (SELECT p.*, CAST(FLOOR((us - (SELECT min(us) FROM p)) / 10000000.0) AS BIGINT) AS window_index, sum(length) OVER (PARTITION BY flow_key ORDER BY frame_no) AS bytes, first_value(us) OVER (PARTITION BY flow_key ORDER BY frame_no) AS start_us FROM p)
, l AS (SELECT *, row_number() OVER (PARTITION BY window_index, flow_key ORDER BY frame_no DESC) AS back FROM x)
, c AS (SELECT l.*, st.state, row_number() OVER (PARTITION BY window_index ORDER BY us DESC, flow_key) AS place FROM l JOIN st USING (flow_key, rn) WHERE back = 1)
SELECT window_index, flow_key, state, rn AS total_packets, bytes::BIGINT AS total_bytes, start_us, us AS last_us FROM c WHERE place <= 25""")
def _s09f(spark, d):
    """The flows of every window's record, read back from the exported records."""
    root = scratch(spark, "windows-flows")
    p = de._short(spark, d)
    none = p.select(F.lit(0).cast("bigint").alias("window_index"), F.lit("").alias("type")).limit(0)
    tb.export_window_records(te.window_telemetry(p), te.host_graph_edges(p), none, root, flows=fl.active_flows(p, n=25))
    flow = "flow_key string, state string, total_packets bigint, total_bytes bigint, start_us bigint, last_us bigint"
    back = spark.read.schema(f"window_index bigint, active_flows array<struct<{', '.join(x.replace(' ', ':') for x in flow.split(', '))}>>").json(root)
    return back.select("window_index", F.inline("active_flows"))


@query("s10_append_flow_features", P + "SELECT capture, count(*) AS rows FROM packets GROUP BY 1")
def _s10(spark, d):
    root = scratch(spark, "features")
    p = fx.packets(spark, d).select("capture", "frame_no", "length")
    for c in ("cap0", "cap1", "cap2"):
        tb.append_flow_features(p.where(F.col("capture") == c), root)
    back = spark.read.option("header", True).schema("capture string, frame_no bigint, length int").csv(root)
    return back.groupBy("capture").agg(F.count("frame_no").alias("rows"))


@query("s11_list_days", "WITH d AS (SELECT DISTINCT strftime(o_orderdate, '%A-%d-%m-%Y') AS day, CAST(o_orderdate AS DATE) AS date FROM orders) SELECT day, row_number() OVER (ORDER BY date) - 1 AS place FROM d")
def _s11(spark, d):
    days = fx.table(spark, d, "orders").select(F.date_format(F.col("o_orderdate").cast("timestamp"), "EEEE-dd-MM-yyyy").alias("day"))
    from wiresift.plans.ordering import dense_id
    return dense_id(tb.list_days(days), ["date", "day"], "place").select("day", "place")


@query("s12_inventory", P + "SELECT 'events' AS set, capture AS portion, count(DISTINCT k % 4) AS days FROM packets GROUP BY 2")
def _s12(spark, d):
    root = scratch(spark, "staged")
    p = fx.packets(spark, d).select(F.lit("events").alias("set"), F.col("capture").alias("portion"), F.concat(F.lit("day"), (F.col("k") % 4).cast("string")).alias("day"), "frame_no", "length")
    tb.stage_dataset(p, root)
    return tb.inventory(spark, root).where("bytes > 0").select("set", "portion", "days")


@query("s13_write_outputs", gs.P + "SELECT (SELECT count(*) FROM sc WHERE family = 'Flood') AS risk_scores, (SELECT count(DISTINCT position // 10) FROM sc) AS rollout_trajectories, (SELECT count(*) FROM sc WHERE positive) AS attention_weights")
def _s13(spark, d):
    s = gs.scores(spark, d)
    risk = s.where("family = 'Flood'").select("position", "population", F.array(F.struct(F.col("receiver").alias("node_id"), "score")).alias("ranking_scores"))
    roll = s.groupBy(F.floor(F.col("position") / 10).alias("seed_id")).agg(F.min_by(F.struct("sender", "receiver", F.array("score").alias("z")), "position").alias("predicted_event"))
    att = s.where("positive").select("position", F.lit(0).alias("layer"), F.col("sender").alias("source_node"), F.lit(-1).alias("query_index"), F.col("score").alias("weight"))
    return tb.write_outputs(scratch(spark, "model"), risk_scores=risk, rollout_trajectories=roll, attention_weights=att).select("risk_scores", "rollout_trajectories", "attention_weights")


@query("q09_freshness", P + "SELECT 'current' AS case_name, 0 AS problems, count(*) AS rows FROM packets UNION ALL SELECT 'old events', 1, count(*) FROM packets UNION ALL SELECT 'old map', 2, count(*) FROM packets")
def _q09(spark, d):
    maps, events = scratch(spark, "maps"), scratch(spark, "events")
    p = fx.packets(spark, d).select("frame_no")
    tb.write_day_table(p, maps, "d1", "map-2")
    tb.write_day_table(p, events, "d1", "from:map-2")
    good = tb.freshness(spark, maps, events, "d1", "map-2")
    tb.write_day_table(p, events, "d1", "from:map-1")
    stale = tb.freshness(spark, maps, events, "d1", "map-2")
    bad = tb.freshness(spark, maps, events, "d1", "map-3")
    n = spark.read.parquet(f"{events}/day=d1").agg(F.count(F.lit(1)).alias("rows"))
    return reduce(DataFrame.unionByName, [n.select(F.lit(c).alias("case_name"), F.lit(len(x)).alias("problems"), "rows") for c, x in (("current", good), ("old events", stale), ("old map", bad))])


@query("q10_leakage_guard", P + "SELECT count(*) AS rows, true AS clean_passes, true AS leak_refused FROM packets")
def _q10(spark, d):
    p = fx.packets(spark, d).select("frame_no", "length", "ttl", "src_ip", "label")
    ft.check_features(["length", "ttl", *RECORD_STATISTICS])

    def refuses(columns):
        try:
            ft.check_features(columns)
            return False
        except ValueError:
            return True
    clock = [c for c in FLOW_STATISTICS if c not in RECORD_STATISTICS]
    refused = refuses(p.columns) and len(clock) == 8 and all(refuses(["length", c]) for c in clock)
    return p.agg(F.count(F.lit(1)).alias("rows")).select("rows", F.lit(True).alias("clean_passes"), F.lit(refused).alias("leak_refused"))
