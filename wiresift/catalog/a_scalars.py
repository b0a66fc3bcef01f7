"""Projections, filters and scalar functions over the packet view."""
from __future__ import annotations

from pyspark.sql import functions as F

from wiresift.catalog.registry import query
from wiresift.functions import addresses as addr
from wiresift.functions import scalars as sc
from wiresift.operators import features as ft
from wiresift.sources import fixtures as fx

P = "WITH " + fx.PACKETS_CTE + " "

V4_NUMBER = ("CAST(split_part({0}, '.', 1) AS BIGINT) * 16777216 + CAST(split_part({0}, '.', 2) AS BIGINT) * 65536 + "
             "CAST(split_part({0}, '.', 3) AS BIGINT) * 256 + CAST(split_part({0}, '.', 4) AS BIGINT)")


@query("p01_canonical_flow_key", P + """
SELECT frame_no, CASE WHEN a <= b THEN a || '|' || b ELSE b || '|' || a END || '|' || CAST(protocol AS VARCHAR) AS flow_key
FROM (SELECT *, src_ip || ':' || CAST(src_port AS VARCHAR) AS a, dst_ip || ':' || CAST(dst_port AS VARCHAR) AS b FROM packets)
""")
def _p01(spark, d):
    p = fx.packets(spark, d)
    return p.select("frame_no", sc.canonical_flow_key(F.col("src_ip"), F.col("src_port"), F.col("dst_ip"),
                                                      F.col("dst_port"), F.col("protocol")).alias("flow_key"))


@query("p02_telemetry_flow_key", P + """
SELECT frame_no, CASE WHEN src_ip < dst_ip OR (src_ip = dst_ip AND src_port <= dst_port)
  THEN src_ip || ':' || CAST(src_port AS VARCHAR) || '<->' || dst_ip || ':' || CAST(dst_port AS VARCHAR)
  ELSE dst_ip || ':' || CAST(dst_port AS VARCHAR) || '<->' || src_ip || ':' || CAST(src_port AS VARCHAR) END
  || '(' || CASE protocol WHEN 6 THEN 'TCP' WHEN 17 THEN 'UDP' ELSE 'ICMP' END || ')' AS flow_key
FROM packets""")
def _p02(spark, d):
    p = fx.packets(spark, d)
    return p.select("frame_no", sc.telemetry_flow_key(F.col("src_ip"), F.col("src_port"), F.col("dst_ip"), F.col("dst_port"),
                                                      sc.protocol_name(F.col("protocol"))).alias("flow_key"))


@query("p03_normalize_ip", P + """SELECT frame_no, CASE k % 7 WHEN 0 THEN '2001:db8::' || CASE WHEN k = 0 THEN '' ELSE printf('%x', k) END WHEN 2 THEN '' ELSE src_ip END AS ip FROM packets""")
def _p03(spark, d):
    text = (F.when(F.col("k") % 7 == 0, F.concat(F.lit("2001:0DB8:0:0::"), F.hex("k")))
            .when(F.col("k") % 7 == 1, F.concat(F.lit("  "), F.col("src_ip"), F.lit(" ")))
            .when(F.col("k") % 7 == 2, F.lit(None)).otherwise(F.col("src_ip")))
    return fx.packets(spark, d).select("frame_no", text.alias("raw")).select(
        "frame_no", addr.normalize_ip(F.col("raw")).alias("ip"))


@query("p04_flow_epoch", """
SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 5 = 0 THEN NULL ELSE CAST(epoch(date_trunc('second', l_shipdate)) AS DOUBLE)
  - CASE WHEN l_linenumber % 5 = 3 THEN second(l_shipdate) ELSE 0 END END AS t
FROM lineitem""")
def _p04(spark, d):
    ship = F.col("l_shipdate").cast("timestamp")
    text = (F.when(F.col("l_linenumber") % 5 == 0, F.lit("not a time"))
            .when(F.col("l_linenumber") % 5 == 1, F.date_format(ship, "dd/MM/yyyy hh:mm:ss a"))
            .when(F.col("l_linenumber") % 5 == 2, F.date_format(ship, "d/M/yyyy H:mm:ss"))
            .when(F.col("l_linenumber") % 5 == 3, F.date_format(ship, "dd/MM/yyyy HH:mm"))
            .otherwise(F.date_format(ship, "yyyy-MM-dd HH:mm:ss")))
    return fx.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", sc.flow_epoch(text).alias("t"))


@query("p05_drop_bad_epochs", P + """
, e AS (SELECT frame_no, us / 1000000.0::DOUBLE + CASE WHEN frame_no % 50 = 0 THEN 90000 ELSE 0 END AS t FROM packets)
SELECT frame_no, t FROM e WHERE abs(t - (SELECT median(t) FROM e)) < 86400""")
def _p05(spark, d):
    p = fx.packets(spark, d).select(
        "frame_no", (F.col("timestamp") + F.when(F.col("frame_no") % 50 == 0, 90000).otherwise(0)).alias("t"))
    return ft.drop_bad_epochs(p, "t")


def _dirty():
    return (F.when(F.col("frame_no") % 11 == 0, F.lit(float("nan"))).when(F.col("frame_no") % 11 == 1, F.lit(float("inf")))
            .when(F.col("frame_no") % 11 == 2, F.lit(float("-inf"))).when(F.col("frame_no") % 11 == 3, F.lit(None))
            .otherwise(F.col("value") - 20))


DIRTY_SQL = ("CASE frame_no % 11 WHEN 0 THEN 'nan'::DOUBLE WHEN 1 THEN 'inf'::DOUBLE WHEN 2 THEN '-inf'::DOUBLE "
             "WHEN 3 THEN NULL ELSE value - 20 END")
CLEAN_SQL = "CASE WHEN x IS NULL OR isnan(x) OR isinf(x) THEN 0.0::DOUBLE ELSE x END"


@query("p06_clean_rate", P + f", r AS (SELECT frame_no, {DIRTY_SQL} AS x FROM packets) "
       f"SELECT frame_no, round({CLEAN_SQL}, 6) AS rate FROM r")
def _p06(spark, d):
    return fx.packets(spark, d).select("frame_no", F.round(sc.clean_rate(_dirty()), 6).alias("rate"))


@query("p07_signed_log", P + f", r AS (SELECT frame_no, {DIRTY_SQL} AS x FROM packets), c AS (SELECT frame_no, {CLEAN_SQL} AS x FROM r) "
       "SELECT frame_no, round(sign(x) * ln(1 + abs(x)), 6) + 0.0 AS logged FROM c")
def _p07(spark, d):
    return fx.packets(spark, d).select("frame_no", (F.round(sc.signed_log(_dirty()), 6) + 0.0).alias("logged"))


def _text_hex():
    return F.hex(F.encode(F.col("text"), "UTF-8"))


@query("p08_payload_prefix", """
SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 0 ELSE CAST(octet_length(encode(text)) AS INT) END AS payload_len,
  CASE WHEN doc_id % 9 = 0 THEN '' ELSE substr(hex(encode(text)), 1, 256) END AS prefix_hex FROM documents""")
def _p08(spark, d):
    hx = F.when(F.col("doc_id") % 9 == 0, F.lit("")).when(
        F.col("doc_id") % 9 == 1, F.regexp_replace(_text_hex(), "(..)(?=.)", "$1:")).otherwise(_text_hex())
    return fx.table(spark, d, "documents").select(
        "doc_id", sc.payload_len(hx).alias("payload_len"), F.hex(sc.payload_prefix(hx)).alias("prefix_hex"))


@query("p09_payload_vector", """
WITH b AS (SELECT doc_id, hex(encode(text)) AS h FROM documents), i AS (SELECT unnest(range(16)) AS i)
SELECT doc_id, CAST(i AS INT) AS pos, CASE WHEN 2 * i + 2 <= length(h) THEN
  CAST((strpos('0123456789ABCDEF', substr(h, CAST(2 * i + 1 AS INT), 1)) - 1) * 16 + strpos('0123456789ABCDEF', substr(h, CAST(2 * i + 2 AS INT), 1)) - 1 AS INT)
  ELSE 0 END AS byte FROM b CROSS JOIN i""")
def _p09(spark, d):
    v = sc.payload_vector(F.encode(F.col("text"), "UTF-8"), 16)
    return fx.table(spark, d, "documents").select("doc_id", F.posexplode(v).alias("pos", "byte"))


@query("p10_is_reversed", P + """
SELECT frame_no, CASE WHEN tcp_flag_syn = 1 AND tcp_flag_ack = 0 THEN CASE WHEN frame_no % 4 = 0 THEN 1.0 ELSE 0.0 END
  WHEN sp < dp THEN 1.0 WHEN sp > dp THEN 0.0 ELSE -1.0 END::DOUBLE AS reversed
FROM (SELECT *, CASE WHEN frame_no % 5 = 0 THEN dst_port ELSE src_port END AS sp, CASE WHEN frame_no % 7 = 0 THEN NULL ELSE
  CASE WHEN frame_no % 3 = 0 THEN src_port ELSE dst_port END END AS dp FROM packets)""")
def _p10(spark, d):
    p = fx.packets(spark, d).withColumns({
        "sp": F.when(F.col("frame_no") % 5 == 0, F.col("dst_port")).otherwise(F.col("src_port")).cast("string"),
        "dp": F.when(F.col("frame_no") % 7 == 0, F.lit("x")).otherwise(
            F.when(F.col("frame_no") % 3 == 0, F.col("src_port")).otherwise(F.col("dst_port")).cast("string")),
        "bare": (F.col("tcp_flag_syn") == 1) & (F.col("tcp_flag_ack") == 0)})
    syn_ip = F.when(F.col("bare"), F.when(F.col("frame_no") % 4 == 0, "10.9.9.9").otherwise(F.col("src_ip")))
    return p.select("frame_no", sc.is_reversed(F.col("src_ip"), F.col("sp"), F.col("dp"), syn_ip, F.when(F.col("bare"), F.col("sp")))
                    .alias("reversed"))


@query("p11_fragment_flag", P + "SELECT frame_no, ip_flag_mf > 0 OR ip_frag_offset > 0 AS fragmented FROM packets")
def _p11(spark, d):
    return fx.packets(spark, d).select("frame_no", sc.fragment_flag(F.col("ip_flag_mf"), F.col("ip_frag_offset")).alias("fragmented"))


FLAGS = ["tcp_flag_syn", "tcp_flag_ack", "tcp_flag_fin", "tcp_flag_rst", "tcp_flag_psh", "tcp_flag_urg"]


@query("p12_tcp_flag_class", P + """
SELECT frame_no, CASE WHEN flags = 0 THEN 'NULL' WHEN flags = 52 THEN 'XMAS' WHEN flags = 4 THEN 'FIN' END AS scan_class,
  CASE WHEN tcp_flag_syn = 1 AND tcp_flag_fin = 1 THEN 'SYN+FIN' WHEN tcp_flag_syn = 1 AND tcp_flag_rst = 1 THEN 'SYN+RST'
  WHEN tcp_flag_fin = 1 AND tcp_flag_rst = 1 THEN 'FIN+RST' END AS illegal FROM packets WHERE protocol = 6""")
def _p12(spark, d):
    syn, ack, fin, rst, psh, urg = map(F.col, FLAGS)
    return fx.packets(spark, d).where("protocol = 6").select(
        "frame_no", sc.tcp_flag_class(syn, ack, fin, rst, psh, urg).alias("scan_class"), sc.illegal_flags(syn, fin, rst).alias("illegal"))


@query("p13_payload_bucket", P + """
SELECT frame_no, CASE WHEN n <= 64 THEN '0_64' WHEN n <= 512 THEN '65_512' WHEN n <= 1024 THEN '513_1024' WHEN n <= 1500 THEN '1025_1500'
  ELSE '1501_plus' END AS bucket FROM (SELECT frame_no, payload_len + CASE WHEN frame_no % 3 = 0 THEN 400 ELSE 0 END AS n FROM packets)""")
def _p13(spark, d):
    n = F.col("payload_len") + F.when(F.col("frame_no") % 3 == 0, 400).otherwise(0)
    return fx.packets(spark, d).select("frame_no", sc.payload_bucket(n).alias("bucket"))


REGISTRY_SQL = "registry(transport, port, tag, service, backend) AS (VALUES " + ", ".join(
    f"('{a}', {b}, '{c}', '{e}', {str(f).lower()})" for a, b, c, e, f in addr.SERVICES) + ")"
# Inputs of the service query: half of the packets are turned round, addresses of one in four are public.
SVC_SQL = """svc AS (SELECT frame_no, CASE protocol WHEN 6 THEN 'TCP' WHEN 17 THEN 'UDP' ELSE 'ICMP' END AS transport,
  CASE WHEN frame_no % 2 = 0 THEN src_ip ELSE dst_ip END AS src_ip,
  CASE WHEN frame_no % 4 = 0 THEN '8.8.8.8' WHEN frame_no % 2 = 0 THEN dst_ip ELSE src_ip END AS dst_ip,
  CASE WHEN frame_no % 2 = 0 THEN src_port ELSE dport END AS src_port, CASE WHEN frame_no % 2 = 0 THEN dport ELSE src_port END AS dst_port,
  frame_no % 3 = 0 AS established FROM (SELECT *, CASE WHEN k = 95 THEN 6379 WHEN k = 89 THEN 3306 ELSE dst_port END AS dport FROM packets))"""


def _svc(spark, d):
    even = F.col("frame_no") % 2 == 0
    dport = F.when(F.col("k") == 95, 6379).when(F.col("k") == 89, 3306).otherwise(F.col("dst_port"))
    pick = lambda a, b: F.when(even, a).otherwise(b)
    return fx.packets(spark, d).select(
        "frame_no", sc.protocol_name(F.col("protocol")).alias("transport"),
        pick(F.col("src_ip"), F.col("dst_ip")).alias("src_ip"),
        F.when(F.col("frame_no") % 4 == 0, "8.8.8.8").otherwise(pick(F.col("dst_ip"), F.col("src_ip"))).alias("dst_ip"),
        pick(F.col("src_port"), dport).alias("src_port"), pick(dport, F.col("src_port")).alias("dst_port"),
        (F.col("frame_no") % 3 == 0).alias("established"), F.lit(False).alias("gvcp_discovery"))


@query("p14_service_tags", P + ", " + REGISTRY_SQL + ", " + SVC_SQL + """
, j AS (SELECT svc.*, dr.tag AS dtag, dr.service AS dsvc, dr.backend AS dback, sr.tag AS stag, sr.service AS ssvc,
  svc.src_ip LIKE '10.%' AND svc.dst_ip LIKE '10.%' AS internal FROM svc
  LEFT JOIN registry dr ON dr.transport = svc.transport AND dr.port = svc.dst_port
  LEFT JOIN registry sr ON sr.transport = svc.transport AND sr.port = svc.src_port)
SELECT frame_no, COALESCE(dtag, stag, CASE WHEN src_port >= 49152 THEN 'EPHEMERAL_CLIENT_PORT' ELSE 'UNKNOWN' END) AS protocol_tag,
  COALESCE(dsvc, ssvc, CASE WHEN src_port >= 49152 THEN 'Ephemeral client port' ELSE 'UNKNOWN' END) AS service,
  CASE WHEN dtag IS NOT NULL THEN CASE WHEN internal AND dback THEN 'INTERNAL_SERVICE' ELSE 'NORMAL_SERVICE' END
    WHEN stag IS NOT NULL THEN CASE WHEN established THEN 'RESPONSE_TRAFFIC' ELSE 'UNKNOWN' END
    WHEN src_port >= 49152 THEN 'EPHEMERAL_CLIENT' ELSE 'UNKNOWN' END AS traffic_class,
  CASE WHEN dtag IS NOT NULL THEN CASE WHEN internal AND dback THEN 'INTERNAL_CLIENT' WHEN dtag = 'DNS' THEN 'CLIENT_TO_DNS' ELSE 'OUTBOUND_CLIENT' END
    WHEN stag IS NOT NULL THEN CASE WHEN established THEN 'SERVER_RESPONSE' ELSE 'UNKNOWN' END
    WHEN src_port >= 49152 THEN 'OUTBOUND_CLIENT' ELSE 'UNKNOWN' END AS connection_role,
  dtag IS NOT NULL OR stag IS NOT NULL AS is_well_known_service,
  (dtag IS NOT NULL OR stag IS NOT NULL) AND internal AS is_internal_service,
  CASE WHEN dtag IS NULL AND stag IS NOT NULL THEN dst_port >= 49152 ELSE src_port >= 49152 END AS is_ephemeral_port
FROM j""")
def _p14(spark, d):
    return addr.service_tags(_svc(spark, d)).select(
        "frame_no", "protocol_tag", "service", "traffic_class", "connection_role", "is_well_known_service",
        "is_internal_service", "is_ephemeral_port")


SCOPED = "CAST(1 + k * 37 % 250 AS VARCHAR(9)) || '.' || CAST(user_id % 256 AS VARCHAR(9)) || '.' || CAST(k % 4 AS VARCHAR(9)) || '.7'"


@query("p15_ip_scope", P + f""", a AS (SELECT frame_no, CASE WHEN frame_no % 13 = 0 THEN 'bad' ELSE {SCOPED} END AS ip FROM packets),
n AS (SELECT *, CASE WHEN ip <> 'bad' THEN {V4_NUMBER.format('ip')} END AS x FROM a),
blocks(lo, hi, kind) AS (VALUES
 (167772160, 184549375, 0), (2886729728, 2887778303, 0), (3232235520, 3232301055, 0),
 (0, 16777215, 1), (1681915904, 1686110207, 1), (2130706432, 2147483647, 1), (2851995648, 2852061183, 1), (3221225472, 3221225727, 1),
 (3221225984, 3221226239, 1), (3323068416, 3323199487, 1), (3325256704, 3325256959, 1), (3405803776, 3405804031, 1), (3758096384, 4294967295, 1)),
s AS (SELECT frame_no, ip, x, min(kind) AS kind FROM n LEFT JOIN blocks ON x BETWEEN lo AND hi GROUP BY frame_no, ip, x)
SELECT frame_no, CASE WHEN x IS NULL THEN 'unverified' WHEN kind = 0 THEN 'private LAN' WHEN kind = 1 THEN 'reserved or non-public'
  ELSE 'public IPv4' END AS scope FROM s""")
def _p15(spark, d):
    ip = F.when(F.col("frame_no") % 13 == 0, "bad").otherwise(F.expr(SCOPED.replace("VARCHAR(9)", "STRING")))
    return fx.packets(spark, d).select("frame_no", addr.ip_scope(ip).alias("scope"))


@query("p16_ip_to_int", P + f"SELECT frame_no, CASE WHEN frame_no % 13 <> 0 THEN {V4_NUMBER.format('dst_ip')} END AS ip_number FROM packets")
def _p16(spark, d):
    ip = F.when(F.col("frame_no") % 13 == 0, F.concat("dst_ip", F.lit(".1"))).otherwise(F.col("dst_ip"))
    return fx.packets(spark, d).select("frame_no", sc.ip_to_int(ip).alias("ip_number"))


def _dns_hex():
    # id, flags, counts, then one label of 1-8 letters, the end byte, type and class; broken in several ways by frame number.
    n = F.col("frame_no")
    width = (n % 8 + 1).cast("int")
    flags = F.when(n % 6 == 0, "8180").otherwise("0100")
    kind = F.when(n % 5 == 0, "0010").when(n % 5 == 1, "001C").otherwise("0001")
    label = F.concat(F.lpad(F.hex(width), 2, "0"), F.expr("repeat('61', int(frame_no % 8 + 1))"))
    whole = F.concat(F.lit("ABCD"), flags, F.lit("0001000000000000"), label, F.lit("00"), kind, F.lit("0001"))
    return F.when(n % 11 == 0, F.expr("substring('ABCD01000001000000000000', 1, int(12 + 2 * (frame_no % 7)))")).otherwise(whole)


@query("p17_flag_routine_dns", P + """
SELECT frame_no, protocol = 17 AND frame_no % 29 <> 0 AND frame_no % 31 <> 0 AND frame_no % 11 <> 0 AND frame_no % 6 <> 0
  AND frame_no % 5 <> 0 AS routine FROM packets""")
def _p17(spark, d):
    p = fx.packets(spark, d).withColumn("payload", F.unhex(_dns_hex()))
    flag = addr.routine_dns_flag(F.col("protocol"), F.col("dst_port"), F.col("ip_flag_mf"), F.col("ip_frag_offset"),
                                 F.col("payload"), F.length("payload"))
    return p.select("frame_no", flag.alias("routine"))


@query("p18_flag_gvcp_discovery", P + """
SELECT frame_no, protocol = 17 AND frame_no % 4 <> 0 AND frame_no % 3 <> 0 AND frame_no % 29 <> 0 AND frame_no % 31 <> 0 AS discovery FROM packets""")
def _p18(spark, d):
    n = F.col("frame_no")
    payload = F.unhex(F.when(n % 4 == 0, "4201000200000000").otherwise("420100020000FFFF"))
    dst = F.when(n % 3 == 0, F.col("dst_ip")).otherwise("255.255.255.255")
    flag = addr.gvcp_discovery_flag(F.col("protocol"), F.col("src_ip"), dst, F.lit(3956), F.col("ip_flag_mf"),
                                    F.col("ip_frag_offset"), payload, F.length(payload))
    return fx.packets(spark, d).select("frame_no", flag.alias("discovery"))


@query("p22_severity", P + "SELECT frame_no, CASE WHEN -score >= -5 THEN 'HIGH' WHEN -score >= -12 THEN 'MEDIUM' ELSE '' END AS severity FROM packets")
def _p22(spark, d):
    return fx.packets(spark, d).select("frame_no", sc.severity(F.col("score"), -1, -5.0, -12.0).alias("severity"))


@query("p25_attack_flag", P + """
SELECT frame_no, family <> 'Benign' AS attack, CASE WHEN family <> 'Benign' THEN family ELSE '' END AS attack_name,
  CASE WHEN family <> 'Benign' THEN 'attack_timeline' ELSE 'default' END AS label_source FROM packets""")
def _p25(spark, d):
    return ft.attack_flag(fx.packets(spark, d), "family").select("frame_no", "attack", "attack_name", "label_source")
