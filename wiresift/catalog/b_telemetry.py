"""Window telemetry, host graph and rule queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from wiresift.catalog.registry import query
from wiresift.operators import rules as ru
from wiresift.operators import telemetry as te
from wiresift.sources import fixtures as fx

W = ("WITH " + fx.PACKETS_CTE + """
, t0 AS (SELECT min(us) AS t0 FROM packets)
, w AS (SELECT p.*, CAST(FLOOR((us - t0) / 10000000.0) AS BIGINT) AS window_index, t0,
  CASE protocol WHEN 6 THEN 'TCP' WHEN 17 THEN 'UDP' ELSE 'ICMP' END AS proto,
  protocol = 6 AND tcp_flag_syn = 1 AND tcp_flag_ack = 0 AS syn_only,
  protocol = 6 AND tcp_flag_syn = 1 AND tcp_flag_ack = 1 AS syn_ack FROM packets p CROSS JOIN t0)
""")

SD = "CASE WHEN {v} > 0 THEN round(sqrt({v}), 2) ELSE 0 END"


def _stat(col, cond, name, unit=""):
    v = f"(CASE WHEN {cond} THEN {col}::DOUBLE END)"
    var = f"(sum({v} * {v}) / count({v}) - (sum({v}) / count({v})) * (sum({v}) / count({v})))"
    return (f"COALESCE(round(sum({v}) / count({v}), 2), 0) AS {name}_mean{unit}, COALESCE({SD.format(v=var)}, 0) AS {name}_stddev{unit}, "
            f"COALESCE(min(CASE WHEN {cond} THEN {col} END), 0)::BIGINT AS {name}_min{unit}, "
            f"COALESCE(max(CASE WHEN {cond} THEN {col} END), 0)::BIGINT AS {name}_max{unit}")


TEL = W + f"""
, g AS (SELECT window_index, (us - lag(us) OVER (PARTITION BY window_index ORDER BY frame_no))::DOUBLE AS gap FROM w)
, iat AS (SELECT window_index, COALESCE(round(sum(gap) / count(gap), 2), 0) AS iat_mean_us,
  COALESCE({SD.format(v='(sum(gap*gap)/count(gap) - (sum(gap)/count(gap))*(sum(gap)/count(gap)))')}, 0) AS iat_stddev_us,
  COALESCE(round(min(gap), 1), 0) AS iat_min_us, COALESCE(round(max(gap), 1), 0) AS iat_max_us FROM g WHERE gap IS NULL OR gap >= 0 GROUP BY 1)
, r AS (SELECT window_index, us - first_value(us) OVER (PARTITION BY window_index, src_ip, src_port, dst_ip, dst_port, tcp_seq, payload_len
  ORDER BY frame_no) AS late FROM w WHERE protocol = 6 AND (payload_len > 0 OR tcp_flag_syn = 1 OR tcp_flag_fin = 1))
, rr AS (SELECT window_index, count(CASE WHEN late > 2000 THEN 1 END) AS tcp_retransmissions_count FROM r GROUP BY 1)
, b AS (SELECT window_index, count(*) AS total_packets, sum(length)::BIGINT AS total_bytes,
  {_stat('ttl', 'true', 'ttl')}, {_stat('tcp_window', 'protocol = 6', 'tcp_window')}, {_stat('payload_len', 'true', 'payload')},
  count(CASE WHEN ip_flag_mf > 0 OR ip_frag_offset > 0 THEN 1 END) AS fragmented_packets_count,
  count(CASE WHEN payload_len <= 64 THEN 1 END) AS payload_0_64, count(CASE WHEN payload_len BETWEEN 65 AND 512 THEN 1 END) AS payload_65_512,
  count(CASE WHEN payload_len BETWEEN 513 AND 1024 THEN 1 END) AS payload_513_1024,
  count(CASE WHEN payload_len BETWEEN 1025 AND 1500 THEN 1 END) AS payload_1025_1500, count(CASE WHEN payload_len > 1500 THEN 1 END) AS payload_1501_plus,
  count(DISTINCT src_ip) AS unique_source_ips, count(DISTINCT dst_ip) AS unique_destination_ips,
  count(DISTINCT src_port) AS unique_source_ports, count(DISTINCT dst_port) AS unique_destination_ports,
  count(CASE WHEN protocol = 6 THEN 1 END) AS tcp_packets, count(CASE WHEN syn_only THEN 1 END) AS syn_count,
  count(CASE WHEN syn_ack THEN 1 END) AS syn_ack_count,
  {', '.join(f"count(CASE WHEN protocol = 6 AND tcp_flag_{f} = 1 THEN 1 END) AS {f}_count" for f in ('ack', 'rst', 'fin', 'psh', 'urg'))},
  count(CASE WHEN proto = 'UDP' THEN 1 END) AS udp_packets, COALESCE(sum(CASE WHEN proto = 'UDP' THEN length END), 0)::BIGINT AS udp_bytes,
  count(CASE WHEN is_dns THEN 1 END) AS dns_packets, COALESCE(sum(CASE WHEN is_dns THEN length END), 0)::BIGINT AS dns_bytes,
  count(CASE WHEN proto = 'ICMP' THEN 1 END) AS icmp_packets, COALESCE(sum(CASE WHEN proto = 'ICMP' THEN length END), 0)::BIGINT AS icmp_bytes,
  count(CASE WHEN is_icmp_echo THEN 1 END) AS icmp_echo_requests,
  count(CASE WHEN protocol = 6 AND flags = 0 THEN 1 END) AS null_scan_packets, count(CASE WHEN flags = 52 THEN 1 END) AS xmas_scan_packets,
  count(CASE WHEN flags = 4 THEN 1 END) AS fin_scan_packets FROM w GROUP BY window_index)
, grid AS (SELECT unnest(range((SELECT max(window_index) FROM w) + 1)) AS window_index)
, tel AS (SELECT grid.window_index, (t0 + grid.window_index * 10000000) / 1000000.0::DOUBLE AS window_start,
  (t0 + (grid.window_index + 1) * 10000000) / 1000000.0::DOUBLE AS window_end, 10.0::DOUBLE AS duration_seconds,
  COALESCE(total_packets, 0) AS total_packets, COALESCE(total_bytes, 0) AS total_bytes,
  round(COALESCE(total_packets, 0) / 10.0::DOUBLE, 2) AS packets_per_second, round(COALESCE(total_bytes, 0) / 10.0::DOUBLE, 2) AS bytes_per_second,
  {', '.join(f"COALESCE({c}, 0) AS {c}" for n in ('ttl', 'tcp_window', 'payload') for c in (f'{n}_mean', f'{n}_stddev', f'{n}_min', f'{n}_max'))},
  {', '.join(f"COALESCE({c}, 0) AS {c}" for c in ('iat_mean_us', 'iat_stddev_us', 'iat_min_us', 'iat_max_us'))},
  {', '.join(f"COALESCE({c}, 0)::BIGINT AS {c}" for c in ('fragmented_packets_count', *[f'payload_{b}' for b in te.BUCKETS], 'tcp_retransmissions_count', 'unique_source_ips', 'unique_destination_ips', 'unique_source_ports', 'unique_destination_ports', 'tcp_packets', 'syn_count', 'syn_ack_count', 'ack_count', 'rst_count', 'fin_count', 'psh_count', 'urg_count', 'udp_packets', 'udp_bytes', 'dns_packets', 'dns_bytes', 'icmp_packets', 'icmp_bytes', 'icmp_echo_requests', 'null_scan_packets', 'xmas_scan_packets', 'fin_scan_packets'))},
  COALESCE(CASE WHEN total_packets > 0 THEN round(fragmented_packets_count / total_packets::DOUBLE, 4) END, 0) AS fragmented_packets_ratio,
  COALESCE(CASE WHEN tcp_packets > 0 THEN round(COALESCE(tcp_retransmissions_count, 0) / tcp_packets::DOUBLE, 4) END, 0) AS tcp_retransmission_ratio,
  {', '.join(f"round(COALESCE({a}, 0) / 10.0::DOUBLE, 2) AS {b}" for a, b in (('syn_count', 'syn_per_second'), ('ack_count', 'ack_per_second'), ('rst_count', 'rst_per_second'), ('udp_packets', 'udp_packets_per_second'), ('udp_bytes', 'udp_bytes_per_second'), ('dns_packets', 'dns_packets_per_second'), ('dns_bytes', 'dns_bytes_per_second'), ('icmp_packets', 'icmp_packets_per_second')))},
  round(CASE WHEN COALESCE(syn_ack_count, 0) > 0 THEN syn_count / syn_ack_count::DOUBLE ELSE COALESCE(syn_count, 0)::DOUBLE END, 2) AS syn_ack_ratio,
  greatest(0, COALESCE(syn_count, 0) - COALESCE(syn_ack_count, 0))::BIGINT AS approx_incomplete_connections
  FROM grid CROSS JOIN t0 LEFT JOIN b USING (window_index) LEFT JOIN iat USING (window_index) LEFT JOIN rr USING (window_index))
"""


@query("a07_window_telemetry", TEL + "SELECT * FROM tel")
def _a07(spark, d):
    return te.window_telemetry(fx.packets(spark, d))


@query("a08_window_retransmissions", TEL + "SELECT * FROM rr")
def _a08(spark, d):
    return te.window_retransmissions(te.with_window(fx.packets(spark, d)))


EDGES = W + """
, edges AS (SELECT window_index, src_ip, dst_ip, count(*) AS packet_count, sum(length)::BIGINT AS byte_count,
  string_agg(DISTINCT proto, ',' ORDER BY proto) AS protocols, count(DISTINCT dst_port) AS distinct_dst_ports,
  count(CASE WHEN protocol = 6 AND tcp_flag_syn = 1 THEN 1 END) AS syn_count, count(CASE WHEN protocol = 6 AND tcp_flag_ack = 1 THEN 1 END) AS ack_count,
  count(CASE WHEN protocol = 6 AND tcp_flag_rst = 1 THEN 1 END) AS rst_count, count(CASE WHEN syn_only THEN 1 END) AS bare_syn_count
  FROM w GROUP BY 1, 2, 3)
, roles AS (SELECT window_index, src_ip AS ip, 1 AS o, 0 AS i, packet_count AS ps, 0 AS pr, byte_count AS bs, 0 AS br, bare_syn_count AS inc FROM edges
  UNION ALL SELECT window_index, dst_ip, 0, 1, 0, packet_count, 0, byte_count, 0 FROM edges)
, ports AS (SELECT window_index, src_ip AS ip, count(DISTINCT dst_port) AS n FROM w WHERE dst_port > 0 GROUP BY 1, 2)
, nodes AS (SELECT r.window_index, r.ip, sum(o)::BIGINT AS out_degree, sum(i)::BIGINT AS in_degree, sum(ps)::BIGINT AS packets_sent, sum(pr)::BIGINT AS packets_received,
  sum(bs)::BIGINT AS bytes_sent, sum(br)::BIGINT AS bytes_received, sum(inc)::BIGINT AS incomplete_conns_initiated, COALESCE(max(p.n), 0) AS distinct_ports_contacted
  FROM roles r LEFT JOIN ports p ON p.window_index = r.window_index AND p.ip = r.ip GROUP BY 1, 2)
"""


@query("a09_host_graph_edges", EDGES + "SELECT window_index, src_ip, dst_ip, packet_count, byte_count, protocols, distinct_dst_ports, "
       "syn_count, ack_count, rst_count FROM edges")
def _a09e(spark, d):
    return te.host_graph_edges(fx.packets(spark, d)).withColumn("protocols", F.array_join("protocols", ",")).drop("bare_syn_count", "first_frame")


@query("a09_host_graph_nodes", EDGES + "SELECT * FROM nodes")
def _a09n(spark, d):
    return te.host_graph_nodes(fx.packets(spark, d)).drop("first_frame")


@query("a09_graph_density", EDGES + """, n AS (SELECT window_index, count(*) AS total_nodes FROM nodes GROUP BY 1), e AS (SELECT window_index, count(*) AS total_edges FROM edges GROUP BY 1)
SELECT window_index, total_nodes, total_edges, CASE WHEN total_nodes > 1 THEN round(total_edges / (total_nodes * (total_nodes - 1))::DOUBLE, 4) ELSE 0 END AS density
FROM n JOIN e USING (window_index)""")
def _a09d(spark, d):
    return te.graph_density(fx.packets(spark, d))


@query("a10_dns_hostnames", "WITH " + fx.PACKETS_CTE + """
SELECT dst_ip AS ip, string_agg(DISTINCT 'host' || k || '.example', ',' ORDER BY 'host' || k || '.example') AS hostnames
FROM packets WHERE is_dns AND event_type = 'view' AND k % 5 <> 0 GROUP BY 1""")
def _a10(spark, d):
    p = fx.packets(spark, d).where("is_dns AND event_type = 'view'")
    answers = p.select(F.col("dst_ip").alias("ip"), F.when(F.col("k") % 5 == 0, "").otherwise(
        F.concat(F.lit("host"), F.col("k").cast("string"), F.lit(".example"))).alias("hostname"))
    return te.dns_hostnames(answers).withColumn("hostnames", F.array_join("hostnames", ","))


@query("a28_direction_totals", EDGES + "SELECT sum(bytes_received)::BIGINT AS bytes_in, sum(bytes_sent)::BIGINT AS bytes_out, sum(packets_received)::BIGINT AS packets_in, "
       "sum(packets_sent)::BIGINT AS packets_out FROM nodes WHERE ip IN (SELECT src_ip FROM packets WHERE k % 10 = 3 AND user_id % 7 = 0)")
def _a28(spark, d):
    p = fx.packets(spark, d)
    local = p.where("k % 10 = 3 AND user_id % 7 = 0").select(F.col("src_ip").alias("ip")).distinct()
    return te.direction_totals(te.host_graph_nodes(p), local)


@query("k01_top_nodes", EDGES + ", t AS (SELECT ip, sum(packets_sent)::BIGINT AS packets_sent, sum(packets_received)::BIGINT AS packets_received FROM nodes GROUP BY 1) "
       "SELECT ip, packets_sent + packets_received AS packets FROM t ORDER BY packets DESC, ip LIMIT 10")
def _k01n(spark, d):
    n = te.host_graph_nodes(fx.packets(spark, d)).groupBy("ip").agg(F.sum("packets_sent").alias("packets_sent"), F.sum("packets_received").alias("packets_received"))
    return te.top_nodes(n, 10).select("ip", (F.col("packets_sent") + F.col("packets_received")).alias("packets"))


@query("k01_top_edges", EDGES + ", t AS (SELECT src_ip, dst_ip, sum(packet_count)::BIGINT AS packet_count FROM edges GROUP BY 1, 2) "
       "SELECT * FROM t ORDER BY packet_count DESC, src_ip, dst_ip LIMIT 15")
def _k01e(spark, d):
    e = te.host_graph_edges(fx.packets(spark, d)).groupBy("src_ip", "dst_ip").agg(F.sum("packet_count").alias("packet_count"))
    return te.top_edges(e, 15)


@query("k06_bounded_history", TEL + "SELECT window_index, total_packets, syn_ack_ratio FROM tel ORDER BY window_index DESC LIMIT 30")
def _k06(spark, d):
    return te.newest(te.window_telemetry(fx.packets(spark, d)), ["window_index"], 30).select("window_index", "total_packets", "syn_ack_ratio")


# The fixture's traffic is light: limits are lowered so that each rule separates windows.
CFG = {"unique_ports": 4, "unique_hosts": 5, "syn_per_second": 1.7, "syn_ack_ratio": 1.3, "min_syn_count": 18, "ack_per_second": 4.5,
       "rst_per_second": 4.5, "udp_packets_per_second": 2.4, "icmp_per_second": 2.3, "unique_targets": 2,
       "dns_packets_per_second": 2.5, "dns_bytes_per_second": 2000.0, "min_packets": 2, "burst_syn_per_second": 2.5}


def _rules(spark, d):
    return ru.RuleInput(fx.packets(spark, d), 10, CFG)


def _fanout_sql(kind, severity, technique, target, where, limit):
    return W + (f"SELECT window_index, (t0 + window_index * 10000000) / 1000000.0::DOUBLE AS window_start, '{kind}' AS type, '{severity}' AS severity, '{technique}' AS mitre_attack_id, "
                f"src_ip AS source_ip, count(DISTINCT {target}) AS n FROM w WHERE {where} GROUP BY window_index, t0, src_ip HAVING count(DISTINCT {target}) >= {limit}")


def _fanout(alerts, feature):
    return alerts.select("window_index", "window_start", "type", "severity", "mitre_attack_id", "source_ip", F.col("features")[feature].cast("bigint").alias("n"))


@query("r01_port_scan", _fanout_sql("PORT_SCAN_INDICATOR", "HIGH", "T1046", "dst_port", "dst_port > 0", CFG["unique_ports"]))
def _r01(spark, d):
    return _fanout(ru.port_scan(_rules(spark, d)), "unique_destination_ports")


@query("r02_host_scan", _fanout_sql("HOST_SCAN_INDICATOR", "HIGH", "T1018", "dst_ip", "true", CFG["unique_hosts"]))
def _r02(spark, d):
    return _fanout(ru.host_scan(_rules(spark, d)), "unique_destination_hosts")


@query("r08_ping_sweep", _fanout_sql("PING_SWEEP_INDICATOR", "HIGH", "T1595.001", "dst_ip", "is_icmp_echo", CFG["unique_targets"]))
def _r08(spark, d):
    return _fanout(ru.ping_sweep(_rules(spark, d)), "unique_targets")


@query("r14_suspicious_flags", W + """SELECT window_index, 'SUSPICIOUS_TCP_FLAGS' AS type, 'MEDIUM' AS severity, 'T1027' AS mitre_attack_id, c AS flag_combination, count(*) AS n
FROM (SELECT *, CASE WHEN tcp_flag_syn = 1 AND tcp_flag_fin = 1 THEN 'SYN+FIN' WHEN tcp_flag_syn = 1 AND tcp_flag_rst = 1 THEN 'SYN+RST' WHEN tcp_flag_fin = 1 AND tcp_flag_rst = 1 THEN 'FIN+RST' END AS c
FROM w WHERE protocol = 6) WHERE c IS NOT NULL GROUP BY window_index, c""")
def _r14(spark, d):
    return ru.suspicious_flags(_rules(spark, d)).select("window_index", "type", "severity", "mitre_attack_id", "flag_combination",
                                                         F.col("features")["packet_count"].cast("bigint").alias("n"))


WINDOW_TRIGGERS = {
    "r03_syn_flood": ("syn_flood", f"syn_per_second >= {CFG['syn_per_second']} OR (syn_count >= {CFG['min_syn_count']} AND syn_ack_ratio >= {CFG['syn_ack_ratio']})"),
    "r04_ack_flood": ("ack_flood", f"ack_per_second >= {CFG['ack_per_second']}"),
    "r05_rst_flood": ("rst_flood", f"rst_per_second >= {CFG['rst_per_second']}"),
    "r06_udp_flood": ("udp_flood", f"udp_packets_per_second >= {CFG['udp_packets_per_second']}"),
    "r07_icmp_flood": ("icmp_flood", f"icmp_packets_per_second >= {CFG['icmp_per_second']}"),
    "r09_dns_amplification": ("dns_amplification", f"dns_packets_per_second >= {CFG['dns_packets_per_second']} OR dns_bytes_per_second >= {CFG['dns_bytes_per_second']}"),
    "r10_null_scan": ("null_scan", f"null_scan_packets >= {CFG['min_packets']}"),
    "r11_xmas_scan": ("xmas_scan", f"xmas_scan_packets >= {CFG['min_packets']}"),
    "r12_fin_scan": ("fin_scan", f"fin_scan_packets >= {CFG['min_packets']}"),
    "r13_connection_burst": ("connection_burst", f"syn_per_second >= {CFG['burst_syn_per_second']}"),
}


def _register_window_rule(name, rule, trigger):
    kind, severity, technique = ru.META[rule][:3]

    @query(name, TEL + f"SELECT window_index, window_start, window_end, '{kind}' AS type, '{severity}' AS severity, '{technique}' AS mitre_attack_id FROM tel WHERE {trigger}")
    def _run(spark, d):
        return ru.window_alerts(te.window_telemetry(fx.packets(spark, d)), CFG, [rule]).select(
            "window_index", "window_start", "window_end", "type", "severity", "mitre_attack_id")


for _name, (_rule, _trigger) in WINDOW_TRIGGERS.items():
    _register_window_rule(_name, _rule, _trigger)


@query("rule_engine_alert_counts", TEL + ", a AS (" + " UNION ALL ".join(
    [f"SELECT '{ru.META[r][0]}' AS type FROM tel WHERE {t}" for r, t in WINDOW_TRIGGERS.values()]
    + [f"SELECT '{k}' FROM (SELECT 1 FROM w WHERE {wh} GROUP BY window_index, src_ip HAVING count(DISTINCT {c}) >= {n})" for k, c, wh, n in (
        ("PORT_SCAN_INDICATOR", "dst_port", "dst_port > 0", CFG["unique_ports"]), ("HOST_SCAN_INDICATOR", "dst_ip", "true", CFG["unique_hosts"]),
        ("PING_SWEEP_INDICATOR", "dst_ip", "is_icmp_echo", CFG["unique_targets"]))]
    + ["SELECT 'SUSPICIOUS_TCP_FLAGS' FROM (SELECT DISTINCT window_index, CASE WHEN tcp_flag_syn = 1 AND tcp_flag_fin = 1 THEN 1 WHEN tcp_flag_syn = 1 AND tcp_flag_rst = 1 THEN 2 "
       "WHEN tcp_flag_fin = 1 AND tcp_flag_rst = 1 THEN 3 END AS c FROM w WHERE protocol = 6) WHERE c IS NOT NULL"]) + ") SELECT type, count(*) AS alerts FROM a GROUP BY type")
def _engine(spark, d):
    return ru.evaluate(fx.packets(spark, d), 10, CFG).groupBy("type").agg(F.count(F.lit(1)).alias("alerts"))


FLOW_EDGES = "WITH " + fx.FLOWS_CTE + """
, ends AS (SELECT f.flow_uid, c.src_ip, c.dst_ip, c.dst_port, f.start_us / 1000000.0::DOUBLE AS timestamp, (f.end_us - f.start_us)::DOUBLE AS duration,
  f.n_packets::DOUBLE AS fwd_packets, (f.n_packets % 3)::DOUBLE AS bwd_packets, c.family AS label FROM flows f JOIN convs c ON c.frame_no = f.first_frame)
, e AS (SELECT *, FLOOR(timestamp / 10) * 10 AS window_start FROM ends)
, o AS (SELECT window_start, src_ip AS ip, count(*)::DOUBLE AS out_flows, count(DISTINCT dst_ip)::DOUBLE AS out_peers, count(DISTINCT dst_port)::DOUBLE AS out_ports, sum(fwd_packets) AS out_packets,
  avg(duration / 1e6) AS out_mean_dur FROM e GROUP BY 1, 2)
, i AS (SELECT window_start, dst_ip AS ip, count(*)::DOUBLE AS in_flows, count(DISTINCT src_ip)::DOUBLE AS in_peers, count(DISTINCT dst_port)::DOUBLE AS listen_ports, sum(bwd_packets) AS in_packets FROM e GROUP BY 1, 2)
, j AS (SELECT window_start, ip, """ + ", ".join(
    f"COALESCE(round({c}, 9), 0) AS {c}" for c in te.HOST_FEATURES) + """ FROM o FULL OUTER JOIN i USING (window_start, ip))
, l AS (SELECT window_start, ip, min(label) AS label FROM (SELECT window_start, src_ip AS ip, label FROM e WHERE label <> 'Benign' UNION ALL SELECT window_start, dst_ip, label FROM e WHERE label <> 'Benign') GROUP BY 1, 2)
"""


def flow_edges(spark, d):
    """Flow windows as timestamped host-to-host edges."""
    f, c = fx.flows(spark, d), fx.conversations(spark, d).select("frame_no", "src_ip", "dst_ip", "dst_port", "family")
    return f.join(c, f["first_frame"] == c["frame_no"]).select(
        "flow_uid", "src_ip", "dst_ip", "dst_port", (F.col("start_us") / 1e6).alias("timestamp"),
        (F.col("end_us") - F.col("start_us")).cast("double").alias("duration"), F.col("n_packets").cast("double").alias("fwd_packets"),
        (F.col("n_packets") % 3).cast("double").alias("bwd_packets"), F.col("family").alias("label"))


@query("a06_host_windows", FLOW_EDGES + "SELECT j.*, COALESCE(l.label, 'Benign') AS label FROM j LEFT JOIN l USING (window_start, ip)")
def _a06(spark, d):
    return te.host_windows(flow_edges(spark, d)).withColumn("out_mean_dur", F.round("out_mean_dur", 9))


@query("j09_out_in_host_join", FLOW_EDGES + ", x AS (SELECT ip, sum(out_flows) AS out_flows, sum(in_flows) AS in_flows, count(*) AS windows FROM j GROUP BY ip) SELECT * FROM x")
def _j09(spark, d):
    return te.host_windows(flow_edges(spark, d)).groupBy("ip").agg(
        F.sum("out_flows").alias("out_flows"), F.sum("in_flows").alias("in_flows"), F.count(F.lit(1)).alias("windows"))


@query("u02_union_endpoint_roles", FLOW_EDGES + "SELECT ip, min(timestamp) AS first_seen, count(*) AS n FROM (SELECT src_ip AS ip, timestamp FROM e UNION ALL SELECT dst_ip, timestamp FROM e) GROUP BY ip")
def _u02(spark, d):
    e = flow_edges(spark, d)
    both = e.select(F.explode(F.array("src_ip", "dst_ip")).alias("ip"), "timestamp")
    return both.groupBy("ip").agg(F.min("timestamp").alias("first_seen"), F.count(F.lit(1)).alias("n"))
