"""Split, normalisation and sampling queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from wiresift.catalog import c_labelling as lab
from wiresift.catalog.registry import query
from wiresift.operators import events as ev
from wiresift.operators import features as ft
from wiresift.operators import splits as sp
from wiresift.sources import fixtures as fx

GAP_S = 5.0
P = "WITH " + fx.PACKETS_CTE + ", e AS (SELECT frame_no, us, CASE WHEN family <> 'Benign' AND user_id % 50 = 7 THEN 'Rare' ELSE family END AS label, src_ip, dst_ip, length, ttl, tcp_window, value, score FROM packets) "


def labelled_events(spark, d):
    p = fx.packets(spark, d)
    rare = (F.col("family") != "Benign") & (F.col("user_id") % 50 == 7)
    return p.select("frame_no", "us", F.when(rare, "Rare").otherwise(F.col("family")).alias("label"), "src_ip", "dst_ip", "length", "ttl", "tcp_window", "value", "score")


def _merge_sql(name, src):
    return f"""
, {name}_a AS (SELECT start_us, end_us, CASE WHEN start_us > max(end_us) OVER (ORDER BY start_us, end_us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 WHEN row_number() OVER (ORDER BY start_us, end_us) = 1 THEN 1 ELSE 0 END AS fresh FROM {src})
, {name}_b AS (SELECT *, sum(fresh) OVER (ORDER BY start_us, end_us ROWS UNBOUNDED PRECEDING) AS isl FROM {name}_a)
, {name} AS (SELECT min(start_us) AS start_us, max(end_us) AS end_us FROM {name}_b GROUP BY isl)"""


WIN = P + lab.RULES_CTE + _merge_sql("aw", "rules")
# Labels only count as observed inside the first 40 seconds of each minute: observed spans are shorter than scheduled ones.
OBS = WIN + """
, ow0 AS (SELECT label, w.start_us AS ws, min(us) AS start_us, max(us) AS end_us FROM e JOIN aw w ON us BETWEEN w.start_us AND w.end_us WHERE label <> 'Benign' AND us // 60000000 % 3 > 0 GROUP BY 1, 2 HAVING max(us) > min(us))""" + _merge_sql("ow", "ow0")
SEG = OBS + """
, edges AS (SELECT greatest(start_us, (SELECT min(us) FROM e)) AS edge_us FROM ow UNION ALL SELECT least(end_us, (SELECT max(us) FROM e)) FROM ow UNION ALL SELECT min(us) FROM e UNION ALL SELECT max(us) FROM e)
, s0 AS (SELECT edge_us AS seg_start, lead(edge_us) OVER (ORDER BY edge_us) AS seg_end FROM edges)
, seg AS (SELECT row_number() OVER (ORDER BY seg_start) - 1 AS segment, seg_start, seg_end, lead(seg_start) OVER (ORDER BY seg_start) IS NULL AS is_last FROM s0 WHERE seg_end > seg_start)
"""


def windows(spark, d):
    e = labelled_events(spark, d).withColumn("label", F.when(F.floor(F.col("us") / 60000000) % 3 > 0, F.col("label")).otherwise("Benign"))
    return sp.observed_windows(e, sp.attack_windows(lab.rules(spark)))


@query("w07_attack_windows", WIN + "SELECT aw.*, count(e.us) AS events FROM aw LEFT JOIN e ON us BETWEEN start_us AND end_us GROUP BY 1, 2")
def _w07a(spark, d):
    e = labelled_events(spark, d).select("us")
    aw = sp.attack_windows(lab.rules(spark))
    return aw.join(e, F.col("us").between(F.col("start_us"), F.col("end_us")), "left").groupBy("start_us", "end_us").agg(F.count("us").alias("events"))


@query("w07_observed_windows", OBS + "SELECT * FROM ow")
def _w07(spark, d):
    return windows(spark, d)


@query("w08_segments", SEG + "SELECT segment::INT AS segment, seg_start, seg_end, is_last FROM seg")
def _w08(spark, d):
    return sp.segments(labelled_events(spark, d), windows(spark, d))


CODE = (f"CASE WHEN (us - a) / 1000000.0::DOUBLE <= (b - a) / 1000000.0::DOUBLE * 0.6 THEN 0 WHEN (us - a) / 1000000.0::DOUBLE > (b - a) / 1000000.0::DOUBLE * 0.6 + {GAP_S} AND (us - a) / 1000000.0::DOUBLE <= (b - a) / 1000000.0::DOUBLE * 0.7 THEN 1 "
        f"WHEN (us - a) / 1000000.0::DOUBLE > (b - a) / 1000000.0::DOUBLE * 0.7 + {GAP_S} THEN 2 ELSE -1 END")


@query("w09_chronological_split", P + f", x AS (SELECT min(us) AS a, max(us) AS b FROM e) SELECT frame_no, {CODE} AS split FROM e CROSS JOIN x")
def _w09c(spark, d):
    return sp.chronological_split(labelled_events(spark, d), gap_s=GAP_S).select("frame_no", "split")


SEGCODE = SEG + f", ss AS (SELECT e.*, segment, {CODE.replace('- a', '- seg_start').replace('(b -', '(seg_end -')} AS split FROM e JOIN seg ON us >= seg_start AND (us < seg_end OR (is_last AND us = seg_end)))"


@query("w09_segment_split", SEGCODE + " SELECT frame_no, split FROM ss")
def _w09(spark, d):
    return sp.segment_split(labelled_events(spark, d), windows(spark, d), gap_s=GAP_S).select("frame_no", "split")


STRAT = SEGCODE + f"""
, f0 AS (SELECT frame_no, us, label, segment, row_number() OVER (PARTITION BY segment, label ORDER BY us, frame_no) - 1 AS rk, count(*) OVER (PARTITION BY segment, label) AS n FROM ss WHERE label <> 'Benign')
, f1 AS (SELECT *, least(greatest(1, CAST(round_even(n * 0.6::DOUBLE, 0) AS BIGINT)), n - 2) AS c1 FROM f0)
, f2 AS (SELECT *, least(greatest(c1 + 1, CAST(round_even(n * 0.7::DOUBLE, 0) AS BIGINT)), n - 1) AS c2 FROM f1)
, f3 AS (SELECT *, CASE WHEN n < 3 OR rk < c1 THEN 0 WHEN rk < c2 THEN 1 ELSE 2 END AS code, max(CASE WHEN rk = c1 - 1 THEN us END) OVER (PARTITION BY segment, label) AS e1, max(CASE WHEN rk = c2 - 1 THEN us END) OVER (PARTITION BY segment, label) AS e2 FROM f2)
, f4 AS (SELECT *, count(CASE WHEN code = 1 AND us > e1 + {int(GAP_S * 1e6)} THEN 1 END) OVER (PARTITION BY segment, label) AS l1, count(CASE WHEN code = 2 AND us > e2 + {int(GAP_S * 1e6)} THEN 1 END) OVER (PARTITION BY segment, label) AS l2 FROM f3)
, strat AS (SELECT frame_no, us, label, CASE WHEN code = 1 AND us <= e1 + {int(GAP_S * 1e6)} AND l1 > 0 THEN -1 WHEN code = 2 AND us <= e2 + {int(GAP_S * 1e6)} AND l2 > 0 THEN -1 ELSE code END AS split FROM f4
  UNION ALL SELECT frame_no, us, label, split FROM ss WHERE label = 'Benign')
"""


def stratified(spark, d):
    return sp.stratified_split(labelled_events(spark, d), windows(spark, d), "frame_no", gap_s=GAP_S)


@query("w10_split_stratified", STRAT + "SELECT frame_no, split FROM strat")
def _w10(spark, d):
    return stratified(spark, d).select("frame_no", "split")


@query("a16_split_report", STRAT + """SELECT label AS family, count(*) AS total, count(CASE WHEN split = 0 THEN 1 END) AS train, count(CASE WHEN split = 1 THEN 1 END) AS val, count(CASE WHEN split = 2 THEN 1 END) AS test,
 count(CASE WHEN split = -1 THEN 1 END) AS gap, label = 'Benign' AS is_benign, count(CASE WHEN split = 0 THEN 1 END) > 0 AND count(CASE WHEN split = 1 THEN 1 END) > 0 AND count(CASE WHEN split = 2 THEN 1 END) > 0 AS complete FROM strat GROUP BY 1""")
def _a16(spark, d):
    return sp.split_report(stratified(spark, d))


@query("a17_band_hours", SEGCODE + """, r AS (SELECT us, split, row_number() OVER (ORDER BY frame_no) - row_number() OVER (PARTITION BY split ORDER BY frame_no) AS run FROM ss)
, s AS (SELECT run, max(us) - min(us) AS span FROM r WHERE split = 2 GROUP BY 1) SELECT round(sum(span) / 3.6e9::DOUBLE, 9) AS hours FROM s""")
def _a17(spark, d):
    return sp.band_hours(sp.segment_split(labelled_events(spark, d), windows(spark, d), gap_s=GAP_S), "frame_no").withColumn("hours", F.round("hours", 9))


@query("a17_gap_hours", P + ", g AS (SELECT us - lag(us) OVER (ORDER BY frame_no) AS gap FROM e) SELECT round(sum(CASE WHEN gap <= 3000000 THEN gap END) / 3.6e9::DOUBLE, 9) AS hours FROM g")
def _a17g(spark, d):
    return sp.gap_hours(labelled_events(spark, d), "frame_no", quiet_s=3.0).withColumn("hours", F.round("hours", 9))


@query("p23_attack_slice", P + """, x AS (SELECT count(*) AS n, min(CASE WHEN label = 'Rare' THEN frame_no END) AS lo, max(CASE WHEN label = 'Rare' THEN frame_no END) AS hi FROM e)
, y AS (SELECT CASE WHEN n <= 300 THEN 0 ELSE greatest(0, least((lo + hi) // 2 - 150, n - 300)) END AS s FROM x) SELECT frame_no, label FROM e CROSS JOIN y WHERE frame_no BETWEEN s AND s + 299""")
def _p23(spark, d):
    return ft.attack_slice(labelled_events(spark, d), "frame_no", "label", 300, "Rare").select("frame_no", "label")


@query("p24_sample_rows", P + "SELECT frame_no FROM e ORDER BY (((frame_no * 2654435761 + 17 * 40503) % 4294967296) * 69069 + 1) % 4294967296, frame_no LIMIT 500")
def _p24(spark, d):
    return ft.sample_rows(labelled_events(spark, d).select("frame_no"), "frame_no", 500, 17)


COLS = ["length", "ttl", "tcp_window"]
MOM = SEGCODE + ", mo AS (SELECT " + ", ".join(
    f"avg(ln(1 + {c})) AS mean_{c}, CASE WHEN COALESCE(stddev_pop(ln(1 + {c})), 0) < 1e-6 THEN 1 ELSE stddev_pop(ln(1 + {c})) END AS sd_{c}" for c in COLS) + " FROM ss WHERE label = 'Benign' AND split = 0)"


def _fit(spark, d):
    e = sp.segment_split(labelled_events(spark, d), windows(spark, d), gap_s=GAP_S)
    return e, ft.moments(e, COLS, (F.col("label") == "Benign") & (F.col("split") == 0))


@query("a18_fit_moments", MOM + "SELECT " + ", ".join(f"round(mean_{c}, 6) AS mean_{c}, round(sd_{c}, 6) AS sd_{c}" for c in COLS) + " FROM mo")
def _a18(spark, d):
    m = _fit(spark, d)[1]
    return m.select(*[F.round(c, 6).alias(c) for c in m.columns])


@query("a18_standardise", MOM + "SELECT frame_no, " + ", ".join(f"round((ln(1 + {c}) - mean_{c}) / sd_{c}, 6) + 0.0 AS {c}" for c in COLS) + " FROM ss CROSS JOIN mo")
def _a18s(spark, d):
    e, m = _fit(spark, d)
    return ft.standardise(e, COLS, m).select("frame_no", *[(F.round(c, 6) + 0.0).alias(c) for c in COLS])


@query("q06_latents_contract", "WITH v AS (SELECT vec_id AS position, label, len(embedding) AS w FROM embeddings) SELECT count(*) AS rows, count(CASE WHEN w <> 64 THEN 1 END) = 0 AS width_ok, true AS order_ok, "
       "count(CASE WHEN label % 7 NOT IN (0, 1, 2) THEN 1 END) = 0 AS split_ok, true AS gaps_ok, count(CASE WHEN position < 0 THEN 1 END) = 0 AS ids_ok FROM v")
def _q06(spark, d):
    e = fx.table(spark, d, "embeddings")
    v = e.select(F.col("vec_id").alias("position"), F.col("vec_id").alias("event_id"), (F.col("vec_id") * 2.0).alias("t_obs"), F.col("vec_id").alias("sender_node_id"), F.lit(1).alias("receiver_node_id"),
                 F.lit(-1.0).alias("dt_src"), F.lit(0.5).alias("dt_dst"), F.col("embedding").alias("z"), (F.col("label") % 7).cast("int").alias("split"))
    return ev.check_latents(v, 64)
