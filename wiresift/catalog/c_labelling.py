"""Labelling, packet-to-flow mapping and their audits."""
from __future__ import annotations

from pyspark.sql import functions as F

from wiresift.catalog.registry import query
from wiresift.operators import labelling as la
from wiresift.operators import mapping as mp
from wiresift.sources import fixtures as fx
from wiresift.sources.schemas import RULES

C = "WITH " + fx.CONVERSATIONS_CTE + " "
FL = "WITH " + fx.FLOWS_CTE + " "
DAY = "Sunday-31-12-2023"  # 2024-01-01 00:00 UTC on a clock four hours behind
ip = lambda *n: [f"10.0.0.{i}" for i in n]
# name, start, end, attackers, victims, ports, protocols, confidence
RULE_ROWS = [
    ("Sweep", "20:01:00", "20:03:00", ip(1, 2), ip(20, 21), [], [], "time_endpoint"),
    ("Sweep", "20:03:00", "20:04:00", ip(1, 2), ip(20, 21), [], [], "tagged_gap"),
    ("Brute", "20:05:00", "20:07:30", ip(3, 4), ip(22, 23, 24), [22, 445], [], "time_endpoint"),
    ("Burst", "20:06:00", "20:09:00", ip(5, 6, 7), ip(20, 25), [], [6], "time_endpoint"),
    ("Leak", "20:10:00", "20:11:00", ip(8), ip(26, 27), [443], [6], "time_endpoint"),
    ("Probe", "20:08:00", "20:10:30", ip(9), ip(23), [], [], "time_endpoint"),
]


def rules(spark):
    rows = [(n, DAY, s, e, a, v, p, q, c, i) for i, (n, s, e, a, v, p, q, c) in enumerate(RULE_ROWS)]
    return spark.createDataFrame(rows, RULES)


def _sec(t):
    h, m, s = map(int, t.split(":"))
    return fx.BASE_US + ((h - 20) * 3600 + m * 60 + s) * 1_000_000


def _values(rows):
    return "VALUES " + ", ".join("(" + ", ".join(repr(x) for x in r) + ")" for r in rows)


RULES_CTE = (
    ", rules(rule_order, name, start_us, end_us, confidence, port_free, proto_free) AS (" + _values(
        [(i, r[0], _sec(r[1]), _sec(r[2]), r[7], int(not r[5]), int(not r[6])) for i, r in enumerate(RULE_ROWS)]) + ")"
    ", attackers(rule_order, a) AS (" + _values([(i, x) for i, r in enumerate(RULE_ROWS) for x in r[3]]) + ")"
    ", victims(rule_order, v) AS (" + _values([(i, x) for i, r in enumerate(RULE_ROWS) for x in r[4]]) + ")"
    ", rports(rule_order, port) AS (" + _values([(i, x) for i, r in enumerate(RULE_ROWS) for x in r[5]]) + ")"
    ", rprotos(rule_order, proto) AS (" + _values([(i, x) for i, r in enumerate(RULE_ROWS) for x in r[6]]) + ")"
    ", rpairs AS (SELECT rule_order, a AS s, v AS d, 'forward' AS heading FROM attackers JOIN victims USING (rule_order) "
    "UNION ALL SELECT rule_order, v, a, 'reverse' FROM attackers JOIN victims USING (rule_order))")


def label_sql(name, src, key, us="us"):
    """A CTE `name` with `key` and the label columns of `src`, by the rules CTEs."""
    return f"""
, {name}_m AS (SELECT x.{key}, r.name, r.confidence, q.heading, r.rule_order,
   row_number() OVER (PARTITION BY x.{key} ORDER BY r.rule_order, CASE q.heading WHEN 'reverse' THEN 0 ELSE 1 END) AS rn
  FROM {src} x JOIN rpairs q ON q.s = x.src_ip AND q.d = x.dst_ip JOIN rules r ON r.rule_order = q.rule_order AND x.{us} BETWEEN r.start_us AND r.end_us
  WHERE (r.port_free = 1 OR EXISTS (SELECT 1 FROM rports p WHERE p.rule_order = r.rule_order AND p.port = CASE q.heading WHEN 'forward' THEN x.dst_port ELSE x.src_port END))
  AND (r.proto_free = 1 OR EXISTS (SELECT 1 FROM rprotos p WHERE p.rule_order = r.rule_order AND p.proto = x.protocol)))
, {name} AS (SELECT x.{key}, COALESCE(m.name, 'Benign') AS "Label", COALESCE(m.name, '') AS attack_name,
   CASE WHEN m.name IS NULL THEN 'default' ELSE 'attack_timeline' END AS label_source, COALESCE(m.confidence, 'none') AS label_confidence,
   COALESCE(m.heading, '') AS label_direction FROM {src} x LEFT JOIN {name}_m m ON m.{key} = x.{key} AND m.rn = 1)"""


LABELLED = FL + RULES_CTE + label_sql("lab", "convs", "frame_no")


def labelled(spark, d):
    return la.label_by_schedule(fx.conversations(spark, d), rules(spark))


@query("j01_label_by_schedule", LABELLED + ' SELECT * FROM lab')
def _j01(spark, d):
    return labelled(spark, d).select("frame_no", "Label", "attack_name", "label_source", "label_confidence", "label_direction")


@query("j08_resolve_roles", C + RULES_CTE + """
, f AS (SELECT c.frame_no, r.rule_order,
   c.src_ip IN (SELECT a FROM attackers x WHERE x.rule_order = r.rule_order) AS fa, c.dst_ip IN (SELECT v FROM victims x WHERE x.rule_order = r.rule_order) AS tv,
   c.src_ip IN (SELECT v FROM victims x WHERE x.rule_order = r.rule_order) AS fv, c.dst_ip IN (SELECT a FROM attackers x WHERE x.rule_order = r.rule_order) AS ta
  FROM convs c JOIN rules r ON c.us BETWEEN r.start_us AND r.end_us)
, g AS (SELECT frame_no, arg_max(CASE WHEN fv AND ta THEN 2 ELSE 1 END, rule_order) FILTER ((fa AND tv) OR (fv AND ta)) AS strong, bool_or(fa OR tv OR fv OR ta) AS touched FROM f GROUP BY 1)
SELECT c.frame_no, COALESCE(strong, CASE WHEN touched THEN 3 END, 0)::INT AS role FROM convs c LEFT JOIN g USING (frame_no)""")
def _j08(spark, d):
    c = fx.conversations(spark, d)
    return la.resolve_roles(c, rules(spark), sender="src_ip", receiver="dst_ip").select("frame_no", "role")


@query("a16_role_report", LABELLED + """
, f AS (SELECT c.frame_no, r.rule_order,
   c.src_ip IN (SELECT a FROM attackers x WHERE x.rule_order = r.rule_order) AS fa, c.dst_ip IN (SELECT v FROM victims x WHERE x.rule_order = r.rule_order) AS tv,
   c.src_ip IN (SELECT v FROM victims x WHERE x.rule_order = r.rule_order) AS fv, c.dst_ip IN (SELECT a FROM attackers x WHERE x.rule_order = r.rule_order) AS ta
  FROM convs c JOIN rules r ON c.us BETWEEN r.start_us AND r.end_us)
, g AS (SELECT frame_no, arg_max(CASE WHEN fv AND ta THEN 2 ELSE 1 END, rule_order) FILTER ((fa AND tv) OR (fv AND ta)) AS strong, bool_or(fa OR tv OR fv OR ta) AS touched FROM f GROUP BY 1)
SELECT "Label" AS label, COALESCE(strong, CASE WHEN touched THEN 3 END, 0)::INT AS role, count(*) AS events FROM lab LEFT JOIN g USING (frame_no) GROUP BY 1, 2""")
def _a16r(spark, d):
    r = rules(spark)
    x = la.resolve_roles(la.label_by_schedule(fx.conversations(spark, d), r), r, sender="src_ip", receiver="dst_ip")
    return x.groupBy(F.col("Label").alias("label"), "role").agg(F.count(F.lit(1)).alias("events"))


MAP = FL + """
, fl AS (SELECT * REPLACE (CASE WHEN slot120 = 3 THEN 'none|' || flow_key ELSE flow_key END AS flow_key) FROM flows)
, cand AS (SELECT c.frame_no, f.flow_uid, row_number() OVER (PARTITION BY c.frame_no ORDER BY f.start_us DESC, f.end_us DESC, f.flow_uid DESC) AS rn
  FROM convs c JOIN fl f ON f.flow_key = c.flow_key AND c.us BETWEEN f.start_us AND f.end_us + 1000000)
, pmap AS (SELECT c.frame_no, k.flow_uid, c.flow_key FROM convs c LEFT JOIN cand k ON k.frame_no = c.frame_no AND k.rn = 1)
"""


def _flows(spark, d):
    """Flows; those of one slot have a key that no packet has, so that some packets stay unattributed."""
    return fx.flows(spark, d).withColumn("flow_key", F.when(F.col("slot120") == 3, F.concat(F.lit("none|"), "flow_key")).otherwise(F.col("flow_key")))


def packet_map(spark, d):
    return mp.map_packets_to_flows(fx.conversations(spark, d), _flows(spark, d))


@query("j02_map_packets_to_flows", MAP + "SELECT * FROM pmap")
def _j02(spark, d):
    return packet_map(spark, d)


@query("j03_load_joined", MAP + "SELECT m.frame_no, m.flow_uid, c.us, f.slot120 AS slot120_flow, f.n_packets, f.nested FROM pmap m JOIN convs c USING (frame_no) LEFT JOIN flows f ON f.flow_uid = m.flow_uid")
def _j03(spark, d):
    c, f = fx.conversations(spark, d), _flows(spark, d)
    return mp.load_joined(c, mp.map_packets_to_flows(c, f), f).select("frame_no", "flow_uid", "us", "slot120_flow", "n_packets", "nested")


@query("q01_packets_attached", MAP + """, k AS (SELECT * FROM pmap WHERE flow_key IN (SELECT flow_key FROM fl))
SELECT count(*) AS has_flow, count(*) - count(flow_uid) AS lost, round(1 - (count(*) - count(flow_uid)) / count(*)::DOUBLE, 9) AS share,
 1 - (count(*) - count(flow_uid)) / count(*)::DOUBLE >= 0.999 AS passed FROM k""")
def _q01(spark, d):
    return mp.attached_share(packet_map(spark, d), _flows(spark, d))


@query("q02_tcp_flags_parsed", C + """SELECT count(*) AS tcp, count(CASE WHEN tcp_flag_syn = 1 OR tcp_flag_ack = 1 OR tcp_flag_fin = 1 OR tcp_flag_rst = 1 THEN 1 END) AS flagged,
 count(CASE WHEN tcp_flag_syn = 1 OR tcp_flag_ack = 1 OR tcp_flag_fin = 1 OR tcp_flag_rst = 1 THEN 1 END) / count(*)::DOUBLE >= 0.9 AS passed FROM convs WHERE protocol = 6""")
def _q02(spark, d):
    return mp.tcp_flag_share(fx.conversations(spark, d))


DISAGREE = MAP + RULES_CTE + label_sql("plab", "convs", "frame_no") + """
, fend AS (SELECT f.flow_uid, f.start_us, c.src_ip, c.dst_ip, c.src_port, c.dst_port, c.protocol FROM flows f JOIN convs c ON c.frame_no = f.first_frame)
""" + label_sql("flab", "fend", "flow_uid", "start_us") + """
, x AS (SELECT c.us, p."Label" AS pl, e.start_us, g."Label" AS fl,
   COALESCE((SELECT arg_max(name, rule_order) FROM rules r WHERE c.us BETWEEN r.start_us AND r.end_us), '') AS pn,
   COALESCE((SELECT arg_max(name, rule_order) FROM rules r WHERE e.start_us BETWEEN r.start_us AND r.end_us), '') AS fn
  FROM pmap m JOIN convs c USING (frame_no) JOIN plab p USING (frame_no) JOIN fend e ON e.flow_uid = m.flow_uid JOIN flab g ON g.flow_uid = m.flow_uid)
SELECT count(*) AS joined, count(CASE WHEN pl <> fl AND pn <> fn THEN 1 END) AS window_edge, count(CASE WHEN pl <> fl AND pn = fn THEN 1 END) AS unexplained"""


def _mapped_labels(spark, d):
    r, c, f = rules(spark), fx.conversations(spark, d), _flows(spark, d)
    ends = f.join(c.select(F.col("frame_no").alias("first_frame"), "src_ip", "dst_ip", "src_port", "dst_port", "protocol"), "first_frame")
    flow_labels = la.label_by_schedule(ends, r, us="start_us").select("flow_uid", F.col("Label").alias("flow_label"), F.col("start_us").alias("flow_start_us"))
    packets = la.label_by_schedule(c, r).select("frame_no", "us", F.col("Label").alias("packet_label"))
    return mp.map_packets_to_flows(c, f).join(packets, "frame_no").join(flow_labels, "flow_uid", "left")


@query("j16_label_disagreement", DISAGREE + " FROM x")
def _j16(spark, d):
    return la.label_disagreement(_mapped_labels(spark, d), rules(spark))


@query("q03_label_agreement", DISAGREE + ", count(CASE WHEN pl <> fl AND pn = fn THEN 1 END) = 0 AS passed FROM x")
def _q03(spark, d):
    return la.label_disagreement(_mapped_labels(spark, d), rules(spark)).withColumn("passed", F.col("unexplained") == 0)


OFFSETS = C + RULES_CTE + """
, hits AS (SELECT DISTINCT r.name, c.frame_no, c.us FROM convs c JOIN rpairs q ON q.s = c.src_ip AND q.d = c.dst_ip JOIN rules r USING (rule_order))
, hist AS (SELECT name, us // 60000000 AS minute, count(*) AS n FROM hits GROUP BY 1, 2)
, offs AS (SELECT unnest(range(-48, 49)) * 15 AS offset_minutes)
, al AS (SELECT o.offset_minutes, h.n FROM hist h CROSS JOIN offs o WHERE EXISTS (SELECT 1 FROM rules r WHERE r.name = h.name
   AND (h.minute + o.offset_minutes) * 60000000 BETWEEN r.start_us - 14400000000 AND r.end_us - 14400000000))
, s AS (SELECT offset_minutes, COALESCE(sum(n), 0)::BIGINT AS aligned FROM offs LEFT JOIN al USING (offset_minutes) GROUP BY 1)
, b AS (SELECT offset_minutes AS best, aligned AS most FROM s ORDER BY aligned DESC, (offset_minutes = -240) DESC, offset_minutes LIMIT 1)
"""


@query("a14_offset_detection", OFFSETS + "SELECT offset_minutes::INT AS offset_minutes, aligned, offset_minutes = best AND most > 0 AS chosen FROM s CROSS JOIN b")
def _a14(spark, d):
    return la.offset_detection(fx.conversations(spark, d), rules(spark))


@query("q08_offset_check", OFFSETS + "SELECT best::INT AS best, most AS aligned, best = -240 AND most > 0 AS passed FROM b")
def _q08(spark, d):
    o = la.offset_detection(fx.conversations(spark, d), rules(spark)).where("chosen")
    return o.select(F.col("offset_minutes").alias("best"), "aligned", (F.col("offset_minutes") == -240).alias("passed"))


# Every 40th labelled row is moved to another attack's name, so that the audit has something to find.
AUDIT_SQL = LABELLED + """
, a AS (SELECT c.*, CASE WHEN l."Label" <> 'Benign' AND c.frame_no % 40 = 0 THEN 'Leak' ELSE l."Label" END AS lbl, l.label_direction FROM convs c JOIN lab l USING (frame_no))
"""


def _audit_rows(spark, d):
    moved = (F.col("Label") != "Benign") & (F.col("frame_no") % 40 == 0)
    return labelled(spark, d).withColumn("Label", F.when(moved, "Leak").otherwise(F.col("Label")))


@query("a15_label_audit", AUDIT_SQL + """
, hit AS (SELECT lbl AS name, count(*) AS labelled_rows, count(CASE WHEN label_direction = 'forward' THEN 1 END) AS forward_rows, count(CASE WHEN label_direction = 'reverse' THEN 1 END) AS reverse_rows,
   min(us) AS first_us, max(us) AS last_us, count(DISTINCT capture) AS captures,
   count(CASE WHEN NOT EXISTS (SELECT 1 FROM rules r WHERE r.name = a.lbl AND a.us BETWEEN r.start_us AND r.end_us) THEN 1 END) AS outside_rows
  FROM a WHERE lbl <> 'Benign' GROUP BY 1)
, esc AS (SELECT name, count(*) AS escaped_rows FROM (SELECT DISTINCT r.name, a.frame_no FROM a JOIN rpairs q ON q.s = a.src_ip AND q.d = a.dst_ip JOIN rules r USING (rule_order)
   WHERE (r.port_free = 1 OR EXISTS (SELECT 1 FROM rports p WHERE p.rule_order = r.rule_order AND p.port = CASE q.heading WHEN 'forward' THEN a.dst_port ELSE a.src_port END))
   AND (r.proto_free = 1 OR EXISTS (SELECT 1 FROM rprotos p WHERE p.rule_order = r.rule_order AND p.proto = a.protocol))
   AND NOT EXISTS (SELECT 1 FROM rules z WHERE a.us BETWEEN z.start_us - 120000000 AND z.end_us + 120000000)) GROUP BY 1)
SELECT n.name, COALESCE(labelled_rows, 0) AS labelled_rows, COALESCE(forward_rows, 0) AS forward_rows, COALESCE(reverse_rows, 0) AS reverse_rows, first_us, last_us,
 COALESCE(captures, 0) AS captures, COALESCE(outside_rows, 0) AS outside_rows, COALESCE(escaped_rows, 0) AS escaped_rows
FROM (SELECT DISTINCT name FROM rules) n LEFT JOIN hit USING (name) LEFT JOIN esc USING (name)""")
def _a15(spark, d):
    return la.label_audit(_audit_rows(spark, d), rules(spark))


@query("a15_audit_ports", AUDIT_SQL + """
, p AS (SELECT lbl, 'victim' AS side, CASE WHEN label_direction = 'forward' THEN dst_port ELSE src_port END AS port FROM a WHERE lbl <> 'Benign'
  UNION ALL SELECT lbl, 'attacker', CASE WHEN label_direction = 'forward' THEN src_port ELSE dst_port END FROM a WHERE lbl <> 'Benign')
, n AS (SELECT lbl, side, port, count(*) AS n FROM p GROUP BY 1, 2, 3), r AS (SELECT *, row_number() OVER (PARTITION BY lbl, side ORDER BY n DESC, port) AS rank FROM n)
SELECT lbl AS "Label", side, port, n, rank::INT AS rank FROM r WHERE rank <= 4""")
def _a15p(spark, d):
    return la.audit_ports(_audit_rows(spark, d))


@query("j15_align_clock", FL + """
, m AS (SELECT flow_key, min(start_us / 1000000.0::DOUBLE + 7190 + slot120) AS meter FROM flows GROUP BY 1), w AS (SELECT flow_key, min(us / 1000000.0::DOUBLE) AS wire FROM convs GROUP BY 1)
, x AS (SELECT meter - wire AS delta FROM m JOIN w USING (flow_key)), s AS (SELECT round_even(median(delta) / 900, 0) * 900 AS shift FROM x)
, t AS (SELECT max(shift) AS shift, count(*) AS keys, avg(CASE WHEN abs(delta - shift) < 120 THEN 1.0 ELSE 0.0 END) AS share FROM x CROSS JOIN s)
SELECT CASE WHEN keys >= 2 AND abs(shift) >= 900 AND share >= 0.75 THEN shift ELSE 0 END::DOUBLE AS shift_s, keys FROM t""")
def _j15(spark, d):
    f = fx.flows(spark, d).select("flow_key", (F.col("start_us") / 1e6 + 7190 + F.col("slot120")).alias("t"))
    p = fx.conversations(spark, d).select("flow_key", (F.col("us") / 1e6).alias("t"))
    return mp.clock_shift(f, p)


@query("j11_complete_flows", MAP + f""", first AS (SELECT m.flow_uid, min(c.us) / 1000000.0::DOUBLE AS first_t FROM pmap m JOIN convs c USING (frame_no) WHERE m.flow_uid IS NOT NULL GROUP BY 1)
, b AS (SELECT f.flow_uid, COALESCE(first_t, start_us / 1000000.0::DOUBLE) AS began FROM flows f LEFT JOIN first USING (flow_uid))
SELECT * FROM b WHERE began BETWEEN {fx.BASE_US // 1000000 + 120} AND {fx.BASE_US // 1000000 + 600}""")
def _j11(spark, d):
    c, f = fx.conversations(spark, d), _flows(spark, d)
    m = mp.map_packets_to_flows(c, f).join(c.select("frame_no", (F.col("us") / 1e6).alias("t")), "frame_no")
    t0 = fx.BASE_US / 1e6
    return mp.complete_flows(f.select("flow_uid", (F.col("start_us") / 1e6).alias("meter_t")), m, t0, t0 + 720).select("flow_uid", "began")


@query("s07_build_edges", C + """
SELECT frame_no::BIGINT AS flow_key, FLOOR(us / 1000000.0) - CAST(FLOOR(us / 1000000.0) AS BIGINT) % 60 * CASE WHEN frame_no % 2 = 0 THEN 0 ELSE 1 END AS timestamp, src_ip, src_port, dst_ip, dst_port, protocol::SMALLINT AS protocol,
 (length * 10)::DOUBLE AS duration FROM convs WHERE frame_no % 17 <> 0 AND frame_no % 19 <> 0""")
def _s07(spark, d):
    ts = F.timestamp_seconds(F.floor(F.col("us") / 1e6))
    c = fx.conversations(spark, d)
    flows = c.select(
        F.when(F.col("frame_no") % 2 == 0, F.date_format(ts, "dd/MM/yyyy hh:mm:ss a")).otherwise(F.date_format(ts, "dd/MM/yyyy HH:mm")).alias("Timestamp"),
        F.col("frame_no").cast("string").alias("flow_key"), F.when(F.col("frame_no") % 17 != 0, F.col("src_ip")).alias("Src IP"), F.col("dst_ip").alias("Dst IP"),
        F.when(F.col("frame_no") % 19 == 0, "n/a").otherwise(F.col("src_port").cast("string")).alias("Src Port"), F.col("dst_port").alias("Dst Port"), F.col("protocol").alias("Protocol"),
        (F.col("length") * 10).alias("Flow Duration"), F.lit(1).alias("Tot Fwd Pkts"), F.lit(0).alias("Tot Bwd Pkts"),
        *[F.lit("").alias(x) for x in la.LABEL_COLUMNS])
    return mp.build_edges(flows).select(F.col("flow_key").cast("bigint").alias("flow_key"), "timestamp", "src_ip", "src_port", "dst_ip", "dst_port", "protocol", "duration")



@query("q05_schedule_rules", """
SELECT c_custkey AS rule_order, 'rule' AS name, CASE c_custkey % 4 WHEN 1 THEN 'empty endpoint set' WHEN 2 THEN 'start after end' WHEN 3 THEN 'ports or protocols not integers' END AS reason
FROM customer WHERE c_custkey % 4 <> 0""")
def _q05(spark, d):
    k = F.col("c_custkey")
    r = fx.table(spark, d, "customer").select(
        F.lit("rule").alias("name"), F.lit(DAY).alias("day"), F.when(k % 4 == 2, "11:00:00").otherwise("09:00:00").alias("start"), F.lit("10:00:00").alias("end"),
        F.when(k % 4 == 1, F.array(F.lit(" "))).otherwise(F.array(F.lit("10.0.0.1"))).alias("attacker_ips"), F.array(F.lit("10.0.0.2")).alias("victim_ips"),
        F.when(k % 4 == 3, F.array(F.lit(70000))).otherwise(F.array(F.lit(80))).alias("service_ports"), F.array(F.lit(6)).alias("protocols"),
        F.lit("time_endpoint").alias("confidence"), k.alias("rule_order"))
    return la.check_rules(r)


@query("u03_coverage", "WITH " + fx.PACKETS_CTE + """, s AS (SELECT DISTINCT src_ip AS capture FROM packets WHERE user_id % 40 < 35), p AS (SELECT DISTINCT dst_ip AS capture FROM packets WHERE k % 40 > 3)
SELECT capture, 'missing' AS state FROM (SELECT * FROM s EXCEPT SELECT * FROM p) UNION ALL SELECT capture, 'extra' FROM (SELECT * FROM p EXCEPT SELECT * FROM s)""")
def _u03(spark, d):
    p = fx.packets(spark, d)
    return la.coverage(p.where("user_id % 40 < 35").select(F.col("src_ip").alias("capture")).distinct(), p.where("k % 40 > 3").select(F.col("dst_ip").alias("capture")).distinct())
