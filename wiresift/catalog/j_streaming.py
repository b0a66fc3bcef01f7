"""Streaming operators replayed over the tables; the oracle of each is its batch twin."""
from __future__ import annotations

from pyspark.sql import functions as F

from wiresift.catalog import d_events as de
from wiresift.catalog import f_graph as fg
from wiresift.catalog import g_scores as gs
from wiresift.catalog import h_forecast as hf
from wiresift.catalog.registry import ORACLES, query
from wiresift.operators import graph as gr
from wiresift.operators import rules as ru
from wiresift.sources import fixtures as fx
from wiresift.sources.tables import BatchTable
from wiresift.streaming import replay as rp
from wiresift.streaming import sinks as sk
from wiresift.streaming import stateful as st
from wiresift.streaming import windows as wi

P = "WITH " + fx.PACKETS_CTE + " "
COUNTS = ["total_packets", "total_bytes", "tcp_packets", "syn_count", "syn_ack_count", "ack_count", "rst_count", "fin_count", "udp_packets", "udp_bytes", "dns_packets", "dns_bytes",
          "icmp_packets", "icmp_bytes", "null_scan_packets", "xmas_scan_packets", "fin_scan_packets"]
SLIM = ["frame_no", "us", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "length", "payload_len", "ttl", "tcp_window", "is_dns", "is_icmp_echo", "tcp_flag_syn", "tcp_flag_ack", "tcp_flag_fin", "tcp_flag_rst", "tcp_flag_psh", "tcp_flag_urg"]


def packet_stream(spark, d, conversations=False):
    p = (fx.conversations if conversations else fx.packets)(spark, d).select(*SLIM)
    return rp.staged(rp.with_last_tick(p, "frame_no", "us"), "frame_no")


W = P + ", w AS (SELECT *, us // 10000000 AS window_index, protocol = 6 AND tcp_flag_syn = 1 AND tcp_flag_ack = 0 AS syn_only, protocol = 6 AND tcp_flag_syn = 1 AND tcp_flag_ack = 1 AS syn_ack FROM packets)"
TEL = W + """, tel AS (SELECT window_index, count(*) AS total_packets, sum(length)::BIGINT AS total_bytes, count(CASE WHEN protocol = 6 THEN 1 END) AS tcp_packets, count(CASE WHEN syn_only THEN 1 END) AS syn_count,
 count(CASE WHEN syn_ack THEN 1 END) AS syn_ack_count, count(CASE WHEN tcp_flag_ack = 1 THEN 1 END) AS ack_count, count(CASE WHEN tcp_flag_rst = 1 THEN 1 END) AS rst_count, count(CASE WHEN tcp_flag_fin = 1 THEN 1 END) AS fin_count,
 count(CASE WHEN protocol = 17 THEN 1 END) AS udp_packets, COALESCE(sum(CASE WHEN protocol = 17 THEN length END), 0)::BIGINT AS udp_bytes, count(CASE WHEN is_dns THEN 1 END) AS dns_packets, COALESCE(sum(CASE WHEN is_dns THEN length END), 0)::BIGINT AS dns_bytes,
 count(CASE WHEN protocol = 1 THEN 1 END) AS icmp_packets, COALESCE(sum(CASE WHEN protocol = 1 THEN length END), 0)::BIGINT AS icmp_bytes, count(CASE WHEN protocol = 6 AND flags = 0 THEN 1 END) AS null_scan_packets,
 count(CASE WHEN flags = 52 THEN 1 END) AS xmas_scan_packets, count(CASE WHEN flags = 4 THEN 1 END) AS fin_scan_packets FROM w GROUP BY 1)"""


@query("t01_stream_window_telemetry", TEL + " SELECT * FROM tel")
def _t01(spark, d):
    return rp.run_to_table(wi.stream_window_telemetry(packet_stream(spark, d)).select("window_index", *COUNTS))


@query("t01_stream_window_rules", TEL + " SELECT window_index, 'NULL_SCAN_INDICATOR' AS type FROM tel WHERE null_scan_packets >= 2 UNION ALL SELECT window_index, 'FIN_SCAN_INDICATOR' FROM tel WHERE fin_scan_packets >= 2")
def _t01r(spark, d):
    tel = wi.stream_window_telemetry(packet_stream(spark, d))
    return rp.run_to_table(ru.window_alerts(tel, {"min_packets": 2}, ["null_scan", "fin_scan"]).select("window_index", "type"))


@query("t01_stream_port_scan", W + " SELECT window_index, src_ip, count(DISTINCT dst_port) AS n FROM w GROUP BY 1, 2 HAVING count(DISTINCT dst_port) >= 4")
def _t01p(spark, d):
    return rp.run_to_table(wi.stream_source_fanout(packet_stream(spark, d), "dst_port", 4))


def _moments(c, name, on):
    v = f"CASE WHEN {on} THEN {c}::DOUBLE END"
    var = f"avg(({v}) * ({v})) - avg({v}) * avg({v})"
    return (f"COALESCE(round(avg({v}), 2), 0) AS {name}_mean, CASE WHEN {var} > 0 THEN round(sqrt({var}), 2) ELSE 0 END AS {name}_stddev, "
            f"COALESCE(min(CASE WHEN {on} THEN {c} END), 0)::BIGINT AS {name}_min, COALESCE(max(CASE WHEN {on} THEN {c} END), 0)::BIGINT AS {name}_max")


@query("t01_stream_window_moments", W + " SELECT window_index, " + ", ".join(_moments(*x) for x in (("ttl", "ttl", "true"), ("tcp_window", "tcp_window", "protocol = 6"), ("payload_len", "payload", "true"))) + " FROM w GROUP BY 1")
def _t01m(spark, d):
    t = wi.stream_window_telemetry(packet_stream(spark, d))
    return rp.run_to_table(t.select("window_index", *[f"{n}_{x}" for n in ("ttl", "tcp_window", "payload") for x in ("mean", "stddev", "min", "max")]))


@query("t01_stream_window_gaps", W + """, g AS (SELECT window_index, (us - lag(us) OVER (PARTITION BY window_index ORDER BY frame_no))::DOUBLE AS gap FROM w)
, m AS (SELECT window_index, CASE WHEN gap >= 0 THEN gap END AS gap FROM g), v AS (SELECT window_index, sum(gap) / count(gap) AS mean, sum(gap * gap) / count(gap) - (sum(gap) / count(gap)) * (sum(gap) / count(gap)) AS var, min(gap) AS lo, max(gap) AS hi FROM m GROUP BY 1)
SELECT window_index, COALESCE(round(mean, 2), 0) AS iat_mean_us, CASE WHEN var > 0 THEN round(sqrt(var), 2) ELSE 0 END AS iat_stddev_us, COALESCE(lo, 0) AS iat_min_us, COALESCE(hi, 0) AS iat_max_us FROM v""")
def _t01g(spark, d):
    return rp.run_to_table(wi.stream_window_gaps(packet_stream(spark, d)))


@query("t01_stream_window_retransmissions", W + """, r AS (SELECT window_index, us - first_value(us) OVER (PARTITION BY window_index, src_ip, src_port, dst_ip, dst_port, tcp_seq, payload_len ORDER BY frame_no) AS late
 FROM w WHERE protocol = 6 AND (payload_len > 0 OR tcp_flag_syn = 1 OR tcp_flag_fin = 1)) SELECT window_index, count(CASE WHEN late > 2000 THEN 1 END) AS tcp_retransmissions_count FROM r GROUP BY 1""")
def _t01x(spark, d):
    p = fx.packets(spark, d).select(*SLIM, "tcp_seq")
    return rp.run_to_table(wi.stream_window_retransmissions(rp.staged(rp.with_last_tick(p, "frame_no", "us"), "frame_no")))


@query("t01_stream_host_scan", W + " SELECT window_index, src_ip, count(DISTINCT dst_ip) AS n FROM w GROUP BY 1, 2 HAVING count(DISTINCT dst_ip) >= 3")
def _t01h(spark, d):
    return rp.run_to_table(wi.stream_host_scan(packet_stream(spark, d), 3))


@query("t01_stream_ping_sweep", W + " SELECT window_index, src_ip, count(DISTINCT dst_ip) AS n FROM w WHERE is_icmp_echo GROUP BY 1, 2 HAVING count(DISTINCT dst_ip) >= 2")
def _t01s(spark, d):
    return rp.run_to_table(wi.stream_ping_sweep(packet_stream(spark, d), 2))


@query("t01_stream_suspicious_flags", W + """ SELECT window_index, c AS flag_combination, count(*) AS n FROM (SELECT *, CASE WHEN tcp_flag_syn = 1 AND tcp_flag_fin = 1 THEN 'SYN+FIN' WHEN tcp_flag_syn = 1 AND tcp_flag_rst = 1 THEN 'SYN+RST'
 WHEN tcp_flag_fin = 1 AND tcp_flag_rst = 1 THEN 'FIN+RST' END AS c FROM w WHERE protocol = 6) WHERE c IS NOT NULL GROUP BY 1, 2""")
def _t01f(spark, d):
    return rp.run_to_table(wi.stream_suspicious_flags(packet_stream(spark, d)))


@query("t02_stream_flows", ORACLES["a12_segment_flows"])
def _t02(spark, d):
    state = rp.scratch(spark, "flow-state")
    closed = rp.run_to_table(st.stream_flows(rp.staged(fx.conversations(spark, d).select(*SLIM), "frame_no"), 30_000_000), state)
    return closed.unionByName(st.open_flows(rp.state_of(spark, state))).select("segment_key", "packets", "bytes", "start_us", "end_us", "first_frame", "closed_by_fin")


@query("t03_reorder_by_availability", P + "SELECT frame_no AS event_id, us + k * 1000 AS t_obs_us, row_number() OVER (ORDER BY us + k * 1000, frame_no) - 1 AS position FROM packets")
def _t03(spark, d):
    e = fx.packets(spark, d).select(F.col("frame_no").alias("event_id"), (F.col("us") + F.col("k") * 1000).alias("t_obs_us"), F.col("us").alias("now_us"))
    held, released = BatchTable(spark, rp.scratch(spark, "held")), BatchTable(spark, rp.scratch(spark, "released"))
    end = rp.run_batches(rp.staged(e, "event_id"), sk.reorder_by_availability(held, released, 200_000))
    sk.drain(held, released, end, e.schema)
    return released.all_before(end + 1, "event_id bigint, t_obs_us bigint, position bigint")


@query("t04_stream_history", P + """, e AS (SELECT frame_no AS position, us, src_ip AS src, dst_ip AS dst, src_port, dst_port, CASE WHEN frame_no % 4 = 0 THEN 1 ELSE 0 END AS rev FROM packets)
, c AS (SELECT *, CASE WHEN rev = 1 THEN dst ELSE src END AS client, CASE WHEN rev = 1 THEN src_port ELSE dst_port END AS port FROM e)
SELECT position, 'dt_src' AS feature, round(COALESCE((us - lag(us) OVER (PARTITION BY src ORDER BY position)) / 1000000.0::DOUBLE, -1), 6) AS value FROM c
UNION ALL SELECT position, 'dt_dst', round(COALESCE((us - lag(us) OVER (PARTITION BY dst ORDER BY position)) / 1000000.0::DOUBLE, -1), 6) FROM c
UNION ALL SELECT position, 'port_delta', COALESCE(port - lag(port) OVER (PARTITION BY client ORDER BY position), 0)::DOUBLE FROM c
UNION ALL SELECT position, 'dst_port_new', CASE WHEN row_number() OVER (PARTITION BY client, port ORDER BY position) = 1 THEN 1.0 ELSE 0.0 END::DOUBLE FROM c""")
def _t04(spark, d):
    e = fx.packets(spark, d).select(F.col("frame_no").alias("position"), F.col("us").alias("t_us"), F.col("src_ip").alias("src"), F.col("dst_ip").alias("dst"), "src_port", "dst_port",
                                    (F.col("frame_no") % 4 == 0).cast("int").alias("reversed"))
    return rp.run_to_table(st.stream_history(rp.staged(e, "position"))).withColumn("value", F.round("value", 6))


@query("t05_stream_neighbours", ORACLES["w11_distinct_peer_neighbours"])
def _t05(spark, d):
    e = fg.stream(spark, d).select("position", "sender", "receiver")
    halves = rp.run_to_table(st.stream_neighbours(rp.staged(e, "position")))
    return st.merge_neighbours(halves).select("position", F.posexplode("neighbours").alias("slot", "neighbour"))


@query("t06_stable_ids", P + ", x AS (SELECT src_ip AS ip, frame_no AS position FROM packets UNION ALL SELECT dst_ip, frame_no FROM packets), f AS (SELECT ip, min(position) AS p FROM x GROUP BY 1) "
       "SELECT ip, row_number() OVER (ORDER BY p, ip) - 1 AS node_id FROM f")
def _t06(spark, d):
    e = fx.packets(spark, d).select(F.col("frame_no").alias("position"), "src_ip", "dst_ip")
    ids = BatchTable(spark, rp.scratch(spark, "ids"))
    step = sk.stable_ids(ids)
    end = rp.run_batches(rp.staged(e, "position"), lambda b, i: step(b.select("position", F.explode(F.array("src_ip", "dst_ip")).alias("ip")), i))
    return ids.all_before(end, "ip string, node_id bigint")


@query("t07_stream_alerts", gs.RUNS + "SELECT family, sender, opened_position, opened_us, opening_score FROM inc")
def _t07(spark, d):
    s = gs.scores(spark, d).select("family", "sender", "position", "t_us", "score", F.lit(gs.CUT).alias("threshold"))
    return rp.run_to_table(st.stream_alerts(rp.staged(s, "position"), 2, 40.0))


@query("t08_adaptive_threshold", gs.P + """, s AS (SELECT position, score FROM sc WHERE family = 'Flood' AND NOT attack), nw AS (SELECT score FROM s ORDER BY position DESC LIMIT 50000), b AS (SELECT count(*) AS seen, greatest(0.01::DOUBLE, 4.0::DOUBLE / count(*)) AS budget FROM s)
, r AS (SELECT score, row_number() OVER (ORDER BY score) - 1 AS rk, count(*) OVER () AS n FROM (SELECT score FROM s UNION ALL SELECT score FROM nw))
SELECT seen, (SELECT count(*) FROM nw) AS recent, greatest(30.0::DOUBLE, score) AS threshold FROM b JOIN r ON rk = CAST(ceil((n - 1) * (1.0::DOUBLE - budget)) AS BIGINT)""")
def _t08(spark, d):
    s = gs.scores(spark, d).where("family = 'Flood' AND NOT attack").select(F.col("position").alias("event_id"), "score")
    t = BatchTable(spark, rp.scratch(spark, "adaptive"))
    end = rp.run_batches(rp.staged(s, "event_id"), sk.adaptive_threshold(t, 30.0, 0.01))
    return t.before(end, sk.ADAPTIVE).groupBy("seen", "threshold").agg(F.count("event_id").alias("recent"))


@query("t09_live_score_calibration", gs.P + """, l AS (SELECT * FROM sc WHERE t_us >= (SELECT max(t_us) FROM sc) - 300000000), c AS (SELECT family AS name, count(*) AS samples FROM l GROUP BY 1), b AS (SELECT *, greatest(0.01::DOUBLE, 4.0::DOUBLE / samples) AS effective_budget FROM c)
, r AS (SELECT family AS name, score, row_number() OVER (PARTITION BY family ORDER BY score) - 1 AS rk FROM l)
SELECT b.name, samples, true AS ready, round(effective_budget, 9) AS effective_budget, greatest(CASE b.name WHEN 'Flood' THEN 30.0::DOUBLE ELSE 500.0::DOUBLE END, score) AS threshold FROM b JOIN r ON r.name = b.name AND r.rk = least(samples - 1, CAST(ceil((1 - effective_budget) * (samples - 1)) AS BIGINT))""")
def _t09(spark, d):
    s = gs.scores(spark, d).select("position", F.col("family").alias("name"), F.col("position").cast("string").alias("flow"), "t_us", "score")
    log = BatchTable(spark, rp.scratch(spark, "scores"))
    end = rp.run_batches(rp.staged(s, "position"), sk.score_log(log, 300.0))
    t = sk.live_thresholds(log.before(end, "name string, flow string, t_us bigint, score double, start_us bigint"), {"Flood": 30.0, "Bot": 500.0}, {"Flood": 0.01, "Bot": 0.01}, 300.0)
    return t.withColumn("effective_budget", F.round("effective_budget", 9))


@query("t10_incident_ledger", gs.RUNS + "SELECT family, sender, opened_us, opening_score FROM inc WHERE opened_us >= (SELECT max(opened_us) FROM inc) - 300000000")
def _t10(spark, d):
    s = gs.scores(spark, d).select("family", "sender", "position", "t_us", "score", F.lit(gs.CUT).alias("threshold"))
    opened = rp.run_to_table(st.stream_alerts(rp.staged(s, "position"), 2, 40.0)).select("opened_position", "family", "sender", "opened_us", "opening_score")
    ledger = BatchTable(spark, rp.scratch(spark, "ledger"))
    step = sk.incident_ledger(ledger, ["family", "sender", "opened_us"], retention_us=300_000_000)
    end = rp.run_batches(rp.staged(opened, "opened_position"), lambda b, i: step(b.drop("opened_position"), i))
    return ledger.before(end, "family string, sender bigint, opened_us bigint, opening_score double")


@query("t11_alarm_feed", gs.P + "SELECT DISTINCT family, sender FROM sc WHERE score >= 60 EXCEPT SELECT family, sender FROM sc WHERE score >= 60 AND position < 60")
def _t11(spark, d):
    s = gs.scores(spark, d).where("score >= 60").select("family", "sender", "position", "t_us")
    return rp.run_to_table(wi.alarm_feed(rp.staged(s, "position"), ["family", "sender"], s.where("position < 60"))).select("family", "sender")


@query("t12_rolling_window_rebuild", P + ", w AS (SELECT * FROM packets WHERE us >= (SELECT max(us) FROM packets) - 200000000) SELECT src_ip, count(*) AS packets, min(frame_no) AS first_frame FROM w GROUP BY 1")
def _t12(spark, d):
    e = fx.packets(spark, d).select(F.col("frame_no").alias("position"), F.col("us").alias("t_us"), "src_ip")
    window, report = BatchTable(spark, rp.scratch(spark, "window")), BatchTable(spark, rp.scratch(spark, "report"))

    def rebuild(w, batch_id):
        report.write(w.groupBy("src_ip").agg(F.count(F.lit(1)).alias("packets"), F.min("position").alias("first_frame")), batch_id)
    end = rp.run_batches(rp.staged(e, "position"), sk.rolling_window(window, rebuild, 200.0))
    return report.before(end, "src_ip string, packets bigint, first_frame bigint")


@query("t13_packet_rate_evidence", ORACLES["w25_source_rate_peak"])
def _t13(spark, d):
    return wi.peak_rates(rp.run_to_table(wi.stream_source_rates(packet_stream(spark, d, True))))


@query("s06_packet_stream", P + "SELECT 'eth' || (frame_no % 3) AS interface_name, CASE protocol WHEN 6 THEN 'TCP' WHEN 17 THEN 'UDP' ELSE 'ICMP' END AS protocol, count(*) AS packets, sum(length)::BIGINT AS bytes, min(us) AS first_us FROM packets WHERE frame_no % 50 <> 1 GROUP BY 1, 2")
def _s06(spark, d):
    p = fx.packets(spark, d)
    event = F.to_json(F.struct(
        F.col("frame_no").cast("string").alias("id"), F.timestamp_micros("us").alias("timestamp"), F.concat(F.lit("eth"), F.col("frame_no") % 3).alias("interface_name"), "src_ip", "dst_ip", "src_port", "dst_port",
        F.when(F.col("protocol") == 6, "TCP").when(F.col("protocol") == 17, "UDP").otherwise("ICMP").alias("protocol"), "length", "payload_len", F.lit("4242").alias("payload_hex")),
        {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"})
    lines = p.select("frame_no", F.when(F.col("frame_no") % 50 == 1, "{broken").otherwise(event).alias("value"))
    got = rp.run_to_table(wi.packet_events(rp.staged(lines, "frame_no")).select("interface_name", "protocol", "length", "us"))
    return got.groupBy("interface_name", "protocol").agg(F.count(F.lit(1)).alias("packets"), F.sum("length").alias("bytes"), F.min("us").alias("first_us"))
