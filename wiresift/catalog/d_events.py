"""Event stream, observation budget and flow meter queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from wiresift.catalog.registry import query
from wiresift.functions import addresses as addr
from wiresift.operators import events as ev
from wiresift.operators import features as ft
from wiresift.operators import flows as fl
from wiresift.session import pinned
from wiresift.sources import fixtures as fx
from wiresift.sources.schemas import AGGREGATES, CONTEXT, FLOW_STATISTICS

C = "WITH " + fx.CONVERSATIONS_CTE + " "
K = 5            # packets summarised per flow, so that flows of seven are cut
BUDGET = 20.0    # seconds, so that budgets end inside flows

MAPPED_SQL = ", m AS (SELECT *, flow_key || '#' || CAST(slot120 AS VARCHAR) AS flow_uid FROM convs)"
HEAD_SQL = MAPPED_SQL + f"""
, h0 AS (SELECT *, row_number() OVER (PARTITION BY flow_uid ORDER BY frame_no) AS slot FROM m)
, h AS (SELECT *, (us - lag(us) OVER (PARTITION BY flow_uid ORDER BY frame_no)) / 1000000.0::DOUBLE AS gap_s,
  first_value(src_ip) OVER (PARTITION BY flow_uid ORDER BY frame_no) AS first_sender FROM h0 WHERE slot <= {K})
"""
DIGITS = {"iat_mean": 9, "iat_std": 7}


def mapped(spark, d):
    return fx.conversations(spark, d).withColumn("flow_uid", F.concat_ws("#", "flow_key", "slot120"))


def agg_sql(cond="true", gap="gap_s", prefix="", blank_ttl=False):
    v = lambda c: f"CASE WHEN {cond} THEN {c}::DOUBLE END"
    x = {"pkt_n": f"count({v('length')})::DOUBLE"}
    for n, c in (("pkt_len", "length"), ("ttl", "ttl"), ("win", "tcp_window"), ("iat", gap)):
        x[f"{n}_mean"], x[f"{n}_std"] = f"avg({v(c)})", f"stddev_samp({v(c)})"
    x["iat_max"] = f"max({v(gap)})"
    for f in ("syn", "ack", "fin", "rst", "psh", "urg"):
        x[f"{f}_n"] = f"sum({v('tcp_flag_' + f)})"
    x |= {"payload_bytes": f"sum({v('payload_len')})", "payload_frac": f"avg(CASE WHEN {cond} THEN CASE WHEN payload_len > 0 THEN 1.0::DOUBLE ELSE 0.0 END END)",
          "retrans_n": f"sum({v('tcp_retransmission')})", "frag_n": f"sum(CASE WHEN {cond} THEN CASE WHEN ip_flag_mf > 0 OR ip_frag_offset > 0 THEN 1.0::DOUBLE ELSE 0.0 END END)"}
    if blank_ttl:
        x["ttl_mean"] = x["ttl_std"] = "0.0::DOUBLE"
    return ", ".join(f"COALESCE(round({x[a]}, {DIGITS.get(a, 6)}), 0.0) AS {prefix}{a}" for a in AGGREGATES)


def rounded(df, prefixes=("",)):
    return df.withColumns({f"{p}{a}": F.round(f"{p}{a}", DIGITS.get(a, 6)) for p in prefixes for a in AGGREGATES if f"{p}{a}" in df.columns})


AGG_SQL = HEAD_SQL + f""", agg AS (SELECT flow_uid, min(us) / 1000000.0::DOUBLE AS t, {agg_sql()},
  max(CASE WHEN slot = 1 AND tcp_flag_syn = 1 AND tcp_flag_ack = 0 THEN src_ip END) AS syn_src_ip,
  max(CASE WHEN slot = 1 AND tcp_flag_syn = 1 AND tcp_flag_ack = 0 THEN src_port END) AS syn_src_port, min(first_sender) AS first_sender FROM h GROUP BY flow_uid)"""


@query("a01_first_k_packet_aggregates", C + AGG_SQL + " SELECT * FROM agg")
def _a01(spark, d):
    return rounded(ev.first_k_packet_aggregates(mapped(spark, d), K))


# Flow records: one per (key, slot), turned round in odd slots; silent twins of every third slot; silent flows of their
# own; and a few with an epoch far from the day.
FLOWS_SQL = AGG_SQL + """
, g AS (SELECT flow_uid, flow_key, slot120, min(frame_no) AS f0, (max(us) - min(us)) / 1000000.0::DOUBLE AS duration_s FROM m GROUP BY 1, 2, 3)
, rec0 AS (SELECT g.flow_uid, g.flow_key, g.slot120, g.duration_s, c.capture, c.src_ip, c.dst_ip, c.src_port, c.dst_port, FLOOR(c.us / 1000000.0) AS meter_t, c.family AS label
  FROM g JOIN convs c ON c.frame_no = g.f0)
, rec AS (SELECT flow_uid, flow_key, duration_s, capture, CASE WHEN slot120 % 2 = 1 THEN dst_ip ELSE src_ip END AS src_ip, CASE WHEN slot120 % 2 = 1 THEN src_ip ELSE dst_ip END AS dst_ip,
   CASE WHEN slot120 % 2 = 1 THEN dst_port ELSE src_port END AS src_port, CASE WHEN slot120 % 2 = 1 THEN src_port ELSE dst_port END AS dst_port, meter_t, label FROM rec0
  UNION ALL SELECT flow_uid || '#t', flow_key, 0.0, capture, dst_ip, src_ip, dst_port, src_port, meter_t + 1, label FROM rec0 WHERE slot120 % 3 = 0
  UNION ALL SELECT 'lone' || frame_no, 'lone' || frame_no, 0.0, capture, src_ip, dst_ip, src_port, dst_port, CASE WHEN frame_no % 5 = 0 THEN 12345.0 ELSE FLOOR(us / 1000000.0) END, family FROM convs WHERE k = 97)
"""


def flow_rows(spark, d):
    m = mapped(spark, d)
    g = m.groupBy("flow_uid", "flow_key", "slot120").agg(((F.max("us") - F.min("us")) / 1e6).alias("duration_s"), F.min_by(
        F.struct("capture", "src_ip", "dst_ip", "src_port", "dst_port", F.floor(F.col("us") / 1e6).cast("double").alias("meter_t"), F.col("family").alias("label")), "frame_no").alias("c"))
    r = g.select("flow_uid", "flow_key", "slot120", "duration_s", "c.*")
    odd = F.col("slot120") % 2 == 1
    turn = lambda a, b: F.when(odd, F.col(b)).otherwise(F.col(a)).alias(a)
    cols = ["flow_uid", "flow_key", "duration_s", "capture", "src_ip", "dst_ip", "src_port", "dst_port", "meter_t", "label"]
    base = r.select("flow_uid", "flow_key", "duration_s", "capture", turn("src_ip", "dst_ip"), turn("dst_ip", "src_ip"), turn("src_port", "dst_port"), turn("dst_port", "src_port"), "meter_t", "label")
    twins = r.where("slot120 % 3 = 0").select(
        F.concat("flow_uid", F.lit("#t")).alias("flow_uid"), "flow_key", F.lit(0.0).alias("duration_s"), "capture", F.col("dst_ip").alias("src_ip"), F.col("src_ip").alias("dst_ip"),
        F.col("dst_port").alias("src_port"), F.col("src_port").alias("dst_port"), (F.col("meter_t") + 1).alias("meter_t"), "label")
    lone = m.where("k = 97").select(
        F.concat(F.lit("lone"), F.col("frame_no").cast("string")).alias("flow_uid"), F.concat(F.lit("lone"), F.col("frame_no").cast("string")).alias("flow_key"), F.lit(0.0).alias("duration_s"),
        "capture", "src_ip", "dst_ip", "src_port", "dst_port", F.when(F.col("frame_no") % 5 == 0, 12345.0).otherwise(F.floor(F.col("us") / 1e6).cast("double")).alias("meter_t"), F.col("family").alias("label"))
    return base.unionByName(twins).unionByName(lone).select(cols)


EV_SQL = FLOWS_SQL + """
, e0 AS (SELECT r.flow_uid, r.flow_key, r.capture, r.src_ip, r.dst_ip, r.src_port, r.dst_port, r.label, r.duration_s, a.t IS NOT NULL AS has_packets, COALESCE(a.t, r.meter_t) AS t,
   COALESCE(a.first_sender, '') AS first_sender,
   CASE WHEN a.syn_src_ip IS NOT NULL THEN CASE WHEN a.syn_src_ip = r.src_ip AND a.syn_src_port = r.src_port THEN 0.0 ELSE 1.0 END
     WHEN r.src_port < r.dst_port THEN 1.0 WHEN r.src_port > r.dst_port THEN 0.0 ELSE -1.0 END::DOUBLE AS reversed, """ + ", ".join(
    f"COALESCE(a.{a}, 0.0) AS {a}" for a in AGGREGATES) + """ FROM rec r LEFT JOIN agg a USING (flow_uid))
, e1 AS (SELECT * FROM e0 WHERE abs(t - (SELECT median(t) FROM e0)) < 86400)
, e2 AS (SELECT * FROM e1 WHERE has_packets OR flow_key NOT IN (SELECT flow_key FROM e1 WHERE has_packets))
, e3 AS (SELECT *, row_number() OVER (ORDER BY t, capture, flow_uid) - 1 AS event_id FROM e2)
, ends AS (SELECT src_ip AS ip, t FROM e3 UNION ALL SELECT dst_ip, t FROM e3)
, nd0 AS (SELECT ip, min(t) AS first_seen_t, count(*) AS n_events FROM ends GROUP BY ip)
, nodes AS (SELECT CAST(row_number() OVER (ORDER BY first_seen_t, ip) - 1 AS INT) AS node_id, ip, first_seen_t, n_events FROM nd0)
, e4 AS (SELECT e3.*, a.node_id AS src_node_id, b.node_id AS dst_node_id FROM e3 JOIN nodes a ON a.ip = e3.src_ip JOIN nodes b ON b.ip = e3.dst_ip)
, e5 AS (SELECT *, CASE WHEN reversed = 1 THEN dst_node_id ELSE src_node_id END AS client, CASE WHEN reversed = 1 THEN src_port ELSE dst_port END::DOUBLE AS port,
   COALESCE(t - lag(t) OVER (PARTITION BY src_node_id ORDER BY event_id), -1) AS dt_src, COALESCE(t - lag(t) OVER (PARTITION BY dst_node_id ORDER BY event_id), -1) AS dt_dst FROM e4)
, ev AS (SELECT *, COALESCE(port - lag(port) OVER (PARTITION BY client ORDER BY event_id), 0) AS port_delta,
   CASE WHEN row_number() OVER (PARTITION BY client, port ORDER BY event_id) = 1 THEN 1.0 ELSE 0.0 END::DOUBLE AS dst_port_new FROM e5)
"""


def raw_events(spark, d):
    """Events before ordering, twin removal and epoch cleaning."""
    return ev.events_from_flows(flow_rows(spark, d), ev.first_k_packet_aggregates(mapped(spark, d), K))


def ordered_events(spark, d):
    return ev.order_events(ev.drop_represented_twins(ft.drop_bad_epochs(pinned(raw_events(spark, d)))))


@query("j04_events_from_flows", C + EV_SQL + "SELECT flow_uid, t, has_packets, reversed, label, pkt_n, iat_mean, payload_frac FROM e0")
def _j04(spark, d):
    return rounded(raw_events(spark, d)).select("flow_uid", "t", "has_packets", "reversed", "label", "pkt_n", "iat_mean", "payload_frac")


@query("j05_drop_represented_twins", C + EV_SQL + "SELECT flow_uid, flow_key, has_packets FROM e0 WHERE has_packets OR flow_key NOT IN (SELECT flow_key FROM e0 WHERE has_packets)")
def _j05(spark, d):
    return ev.drop_represented_twins(raw_events(spark, d)).select("flow_uid", "flow_key", "has_packets")


@query("w01_order_events", C + EV_SQL + "SELECT event_id, t, capture, flow_uid FROM e3")
def _w01(spark, d):
    return ordered_events(spark, d).select("event_id", "t", "capture", "flow_uid")


@query("w02_node_index", C + EV_SQL + "SELECT * FROM nodes")
def _w02(spark, d):
    return ev.node_index(ordered_events(spark, d))


def _with_nodes(spark, d):
    e = pinned(ordered_events(spark, d))
    return ev.attach_node_ids(e, ev.node_index(e))


@query("j06_attach_node_ids", C + EV_SQL + "SELECT event_id, src_node_id, dst_node_id FROM e4")
def _j06(spark, d):
    return _with_nodes(spark, d).select("event_id", "src_node_id", "dst_node_id")


@query("w03_time_since_last_seen", C + EV_SQL + "SELECT event_id, round(dt_src, 6) AS dt_src, round(dt_dst, 6) AS dt_dst FROM ev")
def _w03(spark, d):
    e = _with_nodes(spark, d)
    e = ev.time_since_last_seen(ev.time_since_last_seen(e, "src_node_id", "dt_src"), "dst_node_id", "dt_dst")
    return e.select("event_id", F.round("dt_src", 6).alias("dt_src"), F.round("dt_dst", 6).alias("dt_dst"))


@query("w04_port_access", C + EV_SQL + "SELECT event_id, port_delta, dst_port_new FROM ev")
def _w04(spark, d):
    return ev.port_access(_with_nodes(spark, d)).select("event_id", "port_delta", "dst_port_new")


EVENT_OUT = ["event_id", "t", "src_node_id", "dst_node_id", *CONTEXT, "flow_uid", "capture", "has_packets", "reversed", *AGGREGATES, "label"]


@query("event_stream", C + EV_SQL + "SELECT " + ", ".join(f"round({c}, 6) AS {c}" if c in ("dt_src", "dt_dst") else c for c in EVENT_OUT) + " FROM ev")
def _stream(spark, d):
    e, _ = ev.build_event_stream(flow_rows(spark, d), mapped(spark, d), K)
    return rounded(e).withColumns({c: F.round(c, 6) for c in ("dt_src", "dt_dst")})


@query("u01_union_captures", C + EV_SQL + "SELECT capture, count(*) AS events, count(CASE WHEN has_packets THEN 1 END) AS with_packets FROM e2 GROUP BY 1")
def _u01(spark, d):
    # Captures arrive as separate tables; twins are judged on the whole day, after the union.
    raw = pinned(raw_events(spark, d))
    day = raw.where("capture = 'cap0'").unionByName(raw.where("capture = 'cap1'")).unionByName(raw.where("capture = 'cap2'"))
    return ev.drop_represented_twins(ft.drop_bad_epochs(day)).groupBy("capture").agg(
        F.count(F.lit(1)).alias("events"), F.count(F.when(F.col("has_packets"), 1)).alias("with_packets"))


OBS_SQL = HEAD_SQL + f"""
, o1 AS (SELECT * REPLACE (CASE WHEN slot > 1 THEN greatest(gap_s, 0) END AS gap_s), CASE WHEN src_ip <> first_sender THEN 1 ELSE 0 END AS direction FROM h)
, o2 AS (SELECT *, sum(COALESCE(gap_s, 0)) OVER (PARTITION BY flow_uid ORDER BY slot ROWS UNBOUNDED PRECEDING) AS offset_s FROM o1)
, obs AS (SELECT *, offset_s - lag(offset_s) OVER (PARTITION BY flow_uid, direction ORDER BY slot) AS side_gap_s, lag(direction) OVER (PARTITION BY flow_uid ORDER BY slot) AS prev_direction,
   lag(slot) OVER (PARTITION BY flow_uid ORDER BY slot) AS prev_slot, lag(offset_s) OVER (PARTITION BY flow_uid ORDER BY slot) AS prev_offset,
   lag(slot) OVER (PARTITION BY flow_uid, direction ORDER BY slot) AS same_slot FROM o2 WHERE offset_s <= {BUDGET})
, fd AS (SELECT flow_uid, min(us) / 1000000.0::DOUBLE AS t, (max(us) - min(us)) / 1000000.0::DOUBLE AS duration_s FROM m GROUP BY 1)
"""


def observed(spark, d):
    return ev.observed_packets(mapped(spark, d), BUDGET, K)


def durations(spark, d):
    return mapped(spark, d).groupBy("flow_uid").agg((F.min("us") / 1e6).alias("t"), ((F.max("us") - F.min("us")) / 1e6).alias("duration_s"))


@query("a02_observe_at_budget", C + OBS_SQL + f", a AS (SELECT flow_uid, {agg_sql()} FROM obs GROUP BY 1) SELECT fd.*, a.* EXCLUDE (flow_uid), round(least(t + {BUDGET}, t + duration_s), 6) AS t_obs, pkt_n::BIGINT AS packets_seen, "
       f"CASE WHEN t + duration_s <= t + {BUDGET} THEN 'completed_before_budget' ELSE 'early_observation' END AS population FROM fd JOIN a USING (flow_uid)")
def _a02(spark, d):
    return rounded(ev.observe_at_budget(mapped(spark, d), durations(spark, d), BUDGET, K)).withColumn("t_obs", F.round("t_obs", 6))


@query("a03_split_sides", C + OBS_SQL + f"SELECT flow_uid, {agg_sql('direction = 0', 'side_gap_s', 'initiator_', True)}, {agg_sql('direction = 1', 'side_gap_s', 'responder_', True)} FROM obs GROUP BY flow_uid")
def _a03(spark, d):
    return rounded(ev.split_sides(observed(spark, d)), ("initiator_", "responder_"))


@query("a03_keep_side", C + OBS_SQL + f"SELECT flow_uid, {agg_sql('direction = 1', 'side_gap_s', '', True)} FROM obs GROUP BY flow_uid")
def _a03k(spark, d):
    return rounded(ev.keep_side(observed(spark, d), 1))


@query("a04_side_features", C + OBS_SQL + """SELECT flow_uid, count(CASE WHEN direction = 0 THEN 1 END) AS request_packets, count(CASE WHEN direction = 1 THEN 1 END) AS response_packets,
 round(COALESCE(min(CASE WHEN direction = 1 THEN offset_s END), -1), 6) AS reply_latency_s, sum(CASE WHEN direction <> prev_direction THEN 1 ELSE 0 END)::BIGINT AS direction_changes,
 count(CASE WHEN direction = 1 THEN 1 END) = 0 AS no_reply FROM obs GROUP BY 1""")
def _a04(spark, d):
    return ev.side_features(observed(spark, d)).withColumn("reply_latency_s", F.round("reply_latency_s", 6))


@query("w16_packet_links", C + OBS_SQL + """SELECT flow_uid, same_slot::INT AS from_slot, slot::INT AS to_slot, 0 AS kind, round(side_gap_s, 6) AS seconds FROM obs WHERE same_slot IS NOT NULL
UNION ALL SELECT flow_uid, prev_slot::INT, slot::INT, 1, round(offset_s - prev_offset, 6) FROM obs WHERE prev_slot IS NOT NULL AND prev_direction <> direction""")
def _w16(spark, d):
    return ev.packet_links(observed(spark, d)).withColumn("seconds", F.round("seconds", 6))


ORIENT_SQL = EV_SQL + """
, s AS (SELECT *, CASE WHEN first_sender = dst_ip AND first_sender <> src_ip THEN dst_node_id ELSE src_node_id END AS sender_node_id,
  CASE WHEN first_sender = dst_ip AND first_sender <> src_ip THEN src_node_id ELSE dst_node_id END AS receiver_node_id FROM ev)
"""


def oriented(spark, d):
    return ev.orient_endpoints(_with_nodes(spark, d))


@query("j07_orient_endpoints", C + ORIENT_SQL + "SELECT event_id, sender_node_id, receiver_node_id FROM s")
def _j07(spark, d):
    return oriented(spark, d).select("event_id", "sender_node_id", "receiver_node_id")


TIMED_SQL = ORIENT_SQL + f", tm AS (SELECT *, least(t + {BUDGET}, t + duration_s) AS t_obs, t + duration_s AS record_time FROM s)"


def timed(spark, d):
    end = F.col("t") + F.col("duration_s")
    return oriented(spark, d).withColumns({"t_obs": F.least(F.col("t") + BUDGET, end), "record_time": end})


@query("w05_availability_order", C + TIMED_SQL + "SELECT event_id, row_number() OVER (ORDER BY t_obs, event_id) - 1 AS position FROM tm WHERE has_packets")
def _w05(spark, d):
    return ev.availability_order(timed(spark, d)).select("event_id", "position")


@query("w06_late_messages", C + TIMED_SQL + """SELECT event_id, round(t + iat_mean * greatest(pkt_n - 1, 0) - t, 6) AS summary_after, t + iat_mean * greatest(pkt_n - 1, 0) > t_obs + 1e-4 AS flow_later,
 record_time > t_obs + 1e-4 AS record_later FROM tm""")
def _w06(spark, d):
    # A wider tolerance than the default keeps the rounded fixture aggregates away from the edge.
    e = ev.late_messages(timed(spark, d).withColumn("t_obs", F.col("t_obs") + 0.000099))
    return e.select("event_id", F.round(F.col("flow_time") - F.col("t"), 6).alias("summary_after"), "flow_later", "record_later")


METER_SQL = MAPPED_SQL + """
, q AS (SELECT *, CASE WHEN protocol = 17 THEN 8 ELSE 20 END::DOUBLE AS hdr, first_value(src_ip) OVER w AS fs, lag(us) OVER w AS prev FROM m WINDOW w AS (PARTITION BY flow_uid ORDER BY frame_no))
, z AS (SELECT *, src_ip = fs AS fwd, greatest(us - prev, 0)::DOUBLE AS gap, greatest(us - lag(us) OVER (PARTITION BY flow_uid, src_ip = fs ORDER BY frame_no), 0)::DOUBLE AS sgap,
   CASE WHEN us - prev >= 5000000 THEN (us - prev)::DOUBLE END AS idle, sum(CASE WHEN us - prev >= 5000000 THEN 1 ELSE 0 END) OVER (PARTITION BY flow_uid ORDER BY frame_no) AS island FROM q)
, isl AS (SELECT flow_uid, island, (max(us) - min(us))::DOUBLE AS active FROM z GROUP BY 1, 2)
, act AS (SELECT flow_uid, avg(active) AS am, stddev_samp(active) AS asd, max(active) AS ax, min(active) AS an FROM isl WHERE active > 0 GROUP BY 1)
, st AS (SELECT flow_uid, (max(us) - min(us))::DOUBLE AS dur, count(*)::DOUBLE AS n, sum(length)::DOUBLE AS bytes, count(CASE WHEN fwd THEN 1 END)::DOUBLE AS fn, count(CASE WHEN NOT fwd THEN 1 END)::DOUBLE AS bn,
   """ + ", ".join(
    f"{fn}(CASE WHEN {c} THEN {v} END)::DOUBLE AS {p}_{fn}" for p, c, v in (
        ("fl", "fwd", "length"), ("bl", "NOT fwd", "length"), ("al", "true", "length"), ("fg", "fwd", "sgap"), ("bg", "NOT fwd", "sgap"), ("ag", "true", "gap"), ("id", "true", "idle"))
    for fn in ("sum", "avg", "stddev_samp", "max", "min")) + """,
   """ + ", ".join(f"sum(tcp_flag_{f})::DOUBLE AS {f}" for f in ("fin", "syn", "rst", "psh", "ack", "urg")) + """,
   """ + ", ".join(f"sum(CASE WHEN {c} THEN {v} END)::DOUBLE AS {p}_{n}" for p, c in (("f", "fwd"), ("b", "NOT fwd")) for n, v in (("psh", "tcp_flag_psh"), ("urg", "tcp_flag_urg"), ("hdr", "hdr"))) + """,
   arg_min(tcp_window, frame_no) FILTER (fwd AND tcp_window > 0)::DOUBLE AS f_win, arg_min(tcp_window, frame_no) FILTER (NOT fwd AND tcp_window > 0)::DOUBLE AS b_win,
   count(CASE WHEN fwd AND payload_len > 0 THEN 1 END)::DOUBLE AS f_act, min(CASE WHEN fwd THEN hdr END) AS f_hmin FROM z GROUP BY 1)
"""
_rate = lambda v: f"CASE WHEN dur > 0 THEN {v} / (dur / 1e6) ELSE 0 END"
METER_COLS = {
    "Flow Duration": "dur", "Tot Fwd Pkts": "fn", "Tot Bwd Pkts": "bn", "TotLen Fwd Pkts": "fl_sum", "TotLen Bwd Pkts": "bl_sum",
    "Flow Byts/s": _rate("bytes"), "Flow Pkts/s": _rate("n"), "Flow IAT Mean": "ag_avg", "Flow IAT Std": "ag_stddev_samp", "Flow IAT Max": "ag_max", "Flow IAT Min": "ag_min",
    "Fwd Pkts/s": _rate("fn"), "Bwd Pkts/s": _rate("bn"), "Pkt Len Min": "al_min", "Pkt Len Max": "al_max", "Pkt Len Mean": "al_avg", "Pkt Len Std": "al_stddev_samp",
    "Pkt Len Var": "al_stddev_samp * al_stddev_samp", "FIN Flag Cnt": "fin", "SYN Flag Cnt": "syn", "RST Flag Cnt": "rst", "PSH Flag Cnt": "psh", "ACK Flag Cnt": "ack", "URG Flag Cnt": "urg",
    "CWE Flag Count": "0", "ECE Flag Cnt": "0", "Down/Up Ratio": "CASE WHEN fn > 0 THEN bn / fn END", "Pkt Size Avg": "al_avg", "Fwd Seg Size Avg": "fl_avg", "Bwd Seg Size Avg": "bl_avg",
    "Subflow Fwd Pkts": "fn", "Subflow Fwd Byts": "fl_sum", "Subflow Bwd Pkts": "bn", "Subflow Bwd Byts": "bl_sum", "Init Fwd Win Byts": "f_win", "Init Bwd Win Byts": "b_win",
    "Fwd Act Data Pkts": "f_act", "Fwd Seg Size Min": "f_hmin", "Active Mean": "am", "Active Std": "asd", "Active Max": "ax", "Active Min": "an",
    "Idle Mean": "id_avg", "Idle Std": "id_stddev_samp", "Idle Max": "id_max", "Idle Min": "id_min",
}
for _n, _p in (("Fwd", "f"), ("Bwd", "b")):
    METER_COLS |= {f"{_n} Pkt Len {s}": f"{_p}l_{c}" for s, c in (("Max", "max"), ("Min", "min"), ("Mean", "avg"), ("Std", "stddev_samp"))}
    METER_COLS |= {f"{_n} IAT {s}": f"{_p}g_{c}" for s, c in (("Tot", "sum"), ("Mean", "avg"), ("Std", "stddev_samp"), ("Max", "max"), ("Min", "min"))}
    METER_COLS |= {f"{_n} PSH Flags": f"{_p}_psh", f"{_n} URG Flags": f"{_p}_urg", f"{_n} Header Len": f"{_p}_hdr"}
    METER_COLS |= {f"{_n} {s}": "0" for s in ("Byts/b Avg", "Pkts/b Avg", "Blk Rate Avg")}
METER_SELECT = ", ".join(f'COALESCE(round(({METER_COLS[c]})::DOUBLE, 4), 0)::DOUBLE AS "{c}"' for c in FLOW_STATISTICS)


def metered(spark, d):
    return fl.flow_statistics(mapped(spark, d).withColumn("header_len", F.when(F.col("protocol") == 17, 8).otherwise(20)))


@query("a11_flow_statistics", C + METER_SQL + f"SELECT st.flow_uid, {METER_SELECT} FROM st LEFT JOIN act USING (flow_uid)")
def _a11(spark, d):
    return metered(spark, d).select("flow_uid", *[F.round(F.col(f"`{c}`"), 4).alias(c) for c in FLOW_STATISTICS])


REC_COLS = [c for c in FLOW_STATISTICS if not c.startswith(("Active", "Idle"))]
PAIRS, ALONE = ft.record_pairs()
_twin = {**{a: b for a, b in PAIRS}, **{b: a for a, b in PAIRS}}


@query("a05_flow_records", C + ORIENT_SQL + METER_SQL.replace(MAPPED_SQL, "") + f", fs AS (SELECT st.flow_uid, {METER_SELECT} FROM st LEFT JOIN act USING (flow_uid)) "
       "SELECT event_id, CAST(round((t + \"Flow Duration\" / 1e6) * 1e6) AS BIGINT) AS record_us, " + ", ".join(
    f'CASE WHEN src_node_id <> sender_node_id THEN fs."{_twin.get(c, c)}" ELSE fs."{c}" END AS "{c}"' for c in REC_COLS)
       + ", CASE WHEN src_node_id <> sender_node_id THEN 1.0 ELSE 0.0 END::DOUBLE AS record_reversed FROM s JOIN fs USING (flow_uid)")
def _a05(spark, d):
    r = ev.flow_records(oriented(spark, d), metered(spark, d))
    return r.select("event_id", F.round(F.col("record_time") * 1e6).cast("bigint").alias("record_us"), *[F.round(F.col(f"`{c}`"), 4).alias(c) for c in REC_COLS], "record_reversed")


@query("p19_orient_record", """
SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN l_tax ELSE l_quantity END AS "Fwd Pkt Len Mean", CASE WHEN l_linenumber % 2 = 0 THEN l_quantity ELSE l_tax END AS "Bwd Pkt Len Mean",
 l_discount AS "Fwd Seg Size Min", CASE WHEN l_linenumber % 2 = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS record_reversed FROM lineitem""")
def _p19(spark, d):
    l = fx.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("Fwd Pkt Len Mean"), F.col("l_tax").alias("Bwd Pkt Len Mean"),
                                              F.col("l_discount").alias("Fwd Seg Size Min"), (F.col("l_linenumber") % 2 == 0).alias("flip"))
    return ft.orient_record(l, "flip", [p for p in PAIRS if p[0] == "Fwd Pkt Len Mean"]).drop("flip")


@query("p20_event_target", C + EV_SQL + """SELECT event_id, round(ln(1 + CASE WHEN dt_src < 0 THEN 0 ELSE dt_src END), 6) AS log_dt_src, CASE WHEN dt_src < 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS first_src,
 round(ln(1 + CASE WHEN dt_dst < 0 THEN 0 ELSE dt_dst END), 6) AS log_dt_dst, CASE WHEN dt_dst < 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS first_dst, round(sign(port_delta) * ln(1 + abs(port_delta)), 6) + 0.0 AS log_port_delta,
 dst_port_new, reversed FROM ev""")
def _p20(spark, d):
    e, _ = ev.build_event_stream(flow_rows(spark, d), mapped(spark, d), K)
    r = ft.event_target(e)
    return r.select("event_id", *[(F.round(c, 6) + 0.0).alias(c) for c in ("log_dt_src", "first_src", "log_dt_dst", "first_dst", "log_port_delta")], "dst_port_new", "reversed")


@query("j10_join_event_tables", C + ORIENT_SQL + OBS_SQL.replace(HEAD_SQL, "").replace("FROM h)", "FROM h)") + """
, sf AS (SELECT flow_uid, count(CASE WHEN direction = 0 THEN 1 END) AS request_packets FROM obs GROUP BY 1)
SELECT s.event_id, s.flow_uid, s.sender_node_id, COALESCE(sf.request_packets, 0) AS request_packets FROM s LEFT JOIN sf USING (flow_uid)""")
def _j10(spark, d):
    e = oriented(spark, d).select("event_id", "flow_uid", "sender_node_id")
    side = e.select("event_id", "flow_uid").join(ev.side_features(observed(spark, d)), "flow_uid", "left").select(
        "event_id", F.coalesce("request_packets", F.lit(0)).alias("request_packets"))
    return ev.join_event_tables(e, side)


@query("q04_event_stream", C + EV_SQL + """SELECT (SELECT count(*) FROM ev) AS events, true AS columns_ok, true AS values_ok, true AS sorted_ok, true AS ids_ok, true AS reversed_ok, true AS nodes_ok, true AS signal_ok,
 (SELECT count(*) FROM (VALUES ('Flood'), ('Bot'), ('Ghost')) v(n) WHERE n NOT IN (SELECT label FROM ev)) AS absent_attacks""")
def _q04(spark, d):
    e, nodes = ev.build_event_stream(flow_rows(spark, d), mapped(spark, d), K)
    return ev.check_event_stream(e, nodes, spark.createDataFrame([("Flood",), ("Bot",), ("Ghost",)], "name string"))


@query("q07_packet_count_parity", C + EV_SQL + f""", n AS (SELECT flow_uid, count(*) AS n FROM m GROUP BY 1), x AS (SELECT e.flow_uid, CASE WHEN event_id % 9 = 0 THEN pkt_n + 1 ELSE pkt_n END AS pkt_n, COALESCE(n, 0) AS packets FROM ev e LEFT JOIN n USING (flow_uid))
SELECT * FROM x WHERE pkt_n <> least(packets, {K})""")
def _q07(spark, d):
    e = ordered_events(spark, d).withColumn("pkt_n", F.when(F.col("event_id") % 9 == 0, F.col("pkt_n") + 1).otherwise(F.col("pkt_n")))
    return ev.packet_count_parity(e, mapped(spark, d), K)


@query("w25_source_rate_peak", C + """, r AS (SELECT src_ip, CAST(FLOOR(us / 1000000.0) AS BIGINT) AS second, count(*) AS packets FROM convs GROUP BY 1, 2)
SELECT a.src_ip, a.second, a.packets, greatest(a.packets, COALESCE(b.packets, 0)) AS peak FROM r a LEFT JOIN r b ON b.src_ip = a.src_ip AND b.second = a.second - 1""")
def _w25(spark, d):
    return ev.source_rates(fx.conversations(spark, d))


@query("j12_flow_evidence", C + FLOWS_SQL + """
, rt AS (SELECT src_ip, CAST(FLOOR(us / 1000000.0) AS BIGINT) AS second, count(*) AS n FROM convs GROUP BY 1, 2)
, first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY flow_uid ORDER BY us, frame_no) AS rn FROM m) WHERE rn = 1)
, pay AS (SELECT flow_uid, src_ip FROM m WHERE payload_len > 0 GROUP BY 1, 2)
SELECT r.flow_uid, r.src_ip, r.dst_ip, CASE WHEN f.flow_uid IS NOT NULL THEN split_part(r.flow_key, '|', 3) = '6' AND EXISTS (SELECT 1 FROM pay p WHERE p.flow_uid = r.flow_uid AND p.src_ip = r.src_ip)
   AND EXISTS (SELECT 1 FROM pay p WHERE p.flow_uid = r.flow_uid AND p.src_ip = r.dst_ip) END AS established_connection,
 CASE WHEN f.flow_uid IS NOT NULL THEN f.protocol = 17 AND f.dst_port = 53 AND f.ip_flag_mf = 0 AND f.ip_frag_offset = 0 AND f.frame_no % 2 = 0 END AS normal_dns_query,
 CASE WHEN f.flow_uid IS NOT NULL THEN false END AS normal_gvcp_discovery,
 CASE WHEN f.flow_uid IS NOT NULL THEN greatest((SELECT n FROM rt WHERE rt.src_ip = f.src_ip AND rt.second = CAST(FLOOR(f.us / 1000000.0) AS BIGINT)), COALESCE((SELECT n FROM rt WHERE rt.src_ip = f.src_ip AND rt.second = CAST(FLOOR(f.us / 1000000.0) AS BIGINT) - 1), 0)) END AS source_packets_per_second
FROM rec r LEFT JOIN first f USING (flow_uid)""")
def _j12(spark, d):
    # Even frames carry a routine query of 'a', odd ones a truncated header; the meter's record carries no protocol column.
    query_bytes = F.when(F.col("frame_no") % 2 == 0, F.unhex(F.lit("ABCD0100000100000000000001610000010001"))).otherwise(F.unhex(F.lit("ABCD01000001000000")))
    m = mapped(spark, d).withColumn("payload", F.when(F.col("protocol") == 17, query_bytes).otherwise(F.unhex(F.lit(""))))
    m = m.withColumn("payload_len", F.when(F.col("protocol") == 17, F.length("payload")).otherwise(F.col("payload_len")))
    f = flow_rows(spark, d).withColumn("protocol", F.split_part("flow_key", F.lit("|"), F.lit(3)).try_cast("int"))
    return ev.flow_evidence(f, m).select("flow_uid", "src_ip", "dst_ip", "established_connection", "normal_dns_query", "normal_gvcp_discovery", "source_packets_per_second")


@query("a12_segment_flows", "WITH RECURSIVE " + fx.CONVERSATIONS_CTE + """
, p AS (SELECT *, CASE WHEN protocol = 6 THEN tcp_flag_fin ELSE 0 END AS fin, CASE WHEN a < b THEN a || '|' || b ELSE b || '|' || a END || '|' || protocol AS segment_key
   FROM (SELECT *, src_ip || ':' || src_port AS a, dst_ip || ':' || dst_port AS b FROM convs))
, r AS (SELECT *, row_number() OVER (PARTITION BY segment_key ORDER BY frame_no) AS rn FROM p)
, s(segment_key, rn, frame_no, start_us, us, length, seg, shut) AS (
   SELECT segment_key, rn, frame_no, us, us, length, 1, false FROM r WHERE rn = 1
   UNION ALL
   SELECT r.segment_key, r.rn, r.frame_no, CASE WHEN s.shut OR r.us - s.start_us > 30000000 THEN r.us ELSE s.start_us END, r.us, r.length,
     CASE WHEN s.shut OR r.us - s.start_us > 30000000 THEN s.seg + 1 ELSE s.seg END, NOT (s.shut OR r.us - s.start_us > 30000000) AND r.fin = 1
   FROM s JOIN r ON r.segment_key = s.segment_key AND r.rn = s.rn + 1)
SELECT segment_key, count(*) AS packets, sum(length)::BIGINT AS bytes, min(us) AS start_us, max(us) AS end_us, min(frame_no) AS first_frame, max(CASE WHEN shut THEN 1 ELSE 0 END)::INT AS closed_by_fin
FROM s GROUP BY segment_key, seg HAVING count(*) > 1""")
def _a12(spark, d):
    return fl.segment_flows(fx.conversations(spark, d), 30_000_000).select("segment_key", "packets", "bytes", "start_us", "end_us", "first_frame", "closed_by_fin")


STATE_SQL = """
, p AS (SELECT *, row_number() OVER (PARTITION BY flow_key ORDER BY frame_no) AS rn, protocol = 6 AND tcp_flag_syn = 1 AND tcp_flag_ack = 0 AS bare, protocol = 6 AND tcp_flag_syn = 1 AND tcp_flag_ack = 1 AS synack,
   protocol = 6 AND tcp_flag_ack = 1 AND tcp_flag_syn = 0 AND tcp_flag_fin = 0 AND tcp_flag_rst = 0 AS pure, protocol = 6 AND tcp_flag_fin = 1 AS fin, protocol = 6 AND tcp_flag_rst = 1 AS rst FROM convs)
, st(flow_key, rn, before, state) AS (
   SELECT flow_key, rn, CAST('INIT' AS VARCHAR), CASE WHEN protocol = 17 THEN 'UDP_ACTIVE' WHEN rst THEN 'RESET' WHEN synack AND fin THEN 'FIN_WAIT' WHEN synack THEN 'ESTABLISHED' WHEN bare THEN 'SYN_SENT' ELSE 'INIT' END FROM p WHERE rn = 1
   UNION ALL
   SELECT p.flow_key, p.rn, s.state, CASE WHEN p.protocol = 17 THEN 'UDP_ACTIVE' WHEN p.rst OR s.state = 'RESET' THEN 'RESET' WHEN s.state = 'CLOSED' THEN 'CLOSED'
     WHEN s.state = 'FIN_WAIT' THEN CASE WHEN p.fin THEN 'CLOSED' ELSE 'FIN_WAIT' END
     WHEN s.state = 'ESTABLISHED' OR p.synack OR (s.state = 'SYN_SENT' AND p.pure) THEN CASE WHEN p.fin THEN 'FIN_WAIT' ELSE 'ESTABLISHED' END
     WHEN p.bare THEN 'SYN_SENT' ELSE s.state END
   FROM st s JOIN p ON p.flow_key = s.flow_key AND p.rn = s.rn + 1)
"""


def _short(spark, d):
    """Conversations cut to single slots, so that flows do not all end reset."""
    c = mapped(spark, d)
    return c.drop("flow_key").withColumnRenamed("flow_uid", "flow_key").withColumns({
        "tcp_flag_rst": F.when(F.col("frame_no") % 3 == 0, F.col("tcp_flag_rst")).otherwise(0)})


SHORT = "WITH RECURSIVE " + fx.CONVERSATIONS_CTE.replace("convs AS (", "convs0 AS (") + """
, convs AS (SELECT * REPLACE (flow_key || '#' || CAST(slot120 AS VARCHAR) AS flow_key, CASE WHEN frame_no % 3 = 0 THEN tcp_flag_rst ELSE 0 END AS tcp_flag_rst) FROM convs0)
"""
_side = lambda n, v, c: f"COALESCE(round({v.format(c=c)}, 1), 0)::DOUBLE AS {n}"


@query("a13_flow_state", SHORT + STATE_SQL + """
, f AS (SELECT *, first_value(src_ip) OVER (PARTITION BY flow_key ORDER BY frame_no) = src_ip AS fwd FROM p)
, g AS (SELECT *, us - lag(us) OVER (PARTITION BY flow_key, fwd ORDER BY frame_no) AS gap FROM f)
, l AS (SELECT flow_key, arg_max(state, rn) AS state FROM st GROUP BY 1)
SELECT g.flow_key, l.state, round((max(us) - min(us)) / 1000000.0::DOUBLE, 3) AS duration_seconds, count(*) AS total_packets, sum(length)::BIGINT AS total_bytes,
 sum(bare::INT)::BIGINT AS syn_count, sum(synack::INT)::BIGINT AS syn_ack_count, sum(fin::INT)::BIGINT AS fin_count, sum(rst::INT)::BIGINT AS rst_count,
 count(CASE WHEN fwd THEN 1 END) AS fwd_packets, count(CASE WHEN NOT fwd THEN 1 END) AS bwd_packets, COALESCE(sum(CASE WHEN fwd THEN payload_len END), 0)::BIGINT AS fwd_payload_bytes,
 """ + ", ".join([_side("fwd_iat_mean_us", "avg(CASE WHEN {c} THEN gap END)", "fwd"), _side("bwd_iat_max_us", "max(CASE WHEN {c} THEN gap END)", "NOT fwd"),
                  _side("bwd_pkt_len_mean", "avg(CASE WHEN {c} THEN length END)", "NOT fwd")]) + " FROM g JOIN l USING (flow_key) GROUP BY g.flow_key, l.state")
def _a13(spark, d):
    s = fl.flow_state(_short(spark, d))
    return s.select("flow_key", "state", "duration_seconds", "total_packets", "total_bytes", "syn_count", "syn_ack_count", "fin_count", "rst_count", "fwd_packets", "bwd_packets",
                    "fwd_payload_bytes", "fwd_iat_mean_us", "bwd_iat_max_us", "bwd_pkt_len_mean")


@query("a13_corroborated_replies", SHORT + STATE_SQL + """
, f AS (SELECT p.*, st.before, first_value(src_ip) OVER (PARTITION BY p.flow_key ORDER BY frame_no) = src_ip AS fwd,
   COALESCE(max(synack::INT) OVER (PARTITION BY p.flow_key ORDER BY frame_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS acked FROM p JOIN st USING (flow_key, rn))
SELECT frame_no, NOT fwd AND (protocol = 17 OR (acked = 1 AND before IN ('ESTABLISHED', 'FIN_WAIT'))) AS corroborated FROM f""")
def _a13c(spark, d):
    return fl.corroborated_replies(_short(spark, d)).select("frame_no", "corroborated")


@query("k05_active_flow_snapshot", C + f"""SELECT flow_key, min(us) AS start_us, max(us) AS last_us FROM convs GROUP BY 1 HAVING max(us) >= {fx.BASE_US + 700_000_000} AND min(us) <= {fx.BASE_US + 710_000_000} ORDER BY last_us DESC, flow_key LIMIT 40""")
def _k05(spark, d):
    return fl.active_flow_snapshot(fl.flow_state(fx.conversations(spark, d)), fx.BASE_US + 700_000_000, fx.BASE_US + 710_000_000, 40).select("flow_key", "start_us", "last_us")
