"""Forecast evaluation queries."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wiresift.catalog.registry import ORACLES, query
from wiresift.operators import forecast as fo
from wiresift.operators import graph as gr
from wiresift.session import pinned
from wiresift.sources import fixtures as fx

EVERY, WINDOW, HISTORY, HORIZON = 250, 300, 1000, 20.0
#: Of each list, what the retrieval pool takes; all places are places in whole lists of the hosts seen.
NEAREST, POPULAR = 128, 64
P = "WITH " + fx.PACKETS_CTE + f"""
, e AS (SELECT frame_no AS position, us AS t_us, user_id % 400 AS sender, k::BIGINT AS receiver, CASE WHEN family = 'Flood' THEN 1 WHEN family = 'Bot' THEN 2 ELSE 0 END AS role, family AS label, score FROM packets)
, f AS (SELECT position // {EVERY} AS forecast, max(position) AS position FROM e WHERE role = 1 GROUP BY 1)
, fc AS (SELECT forecast, e.* FROM f JOIN e USING (position))
"""


def stream(spark, d):
    return fx.packets(spark, d).select(
        F.col("frame_no").alias("position"), F.col("us").alias("t_us"), (F.col("user_id") % 400).alias("sender"), F.col("k").cast("bigint").alias("receiver"),
        F.when(F.col("family") == "Flood", 1).when(F.col("family") == "Bot", 2).otherwise(0).alias("role"), F.col("family").alias("label"), "score")


def points(spark, d):
    return pinned(fo.forecast_points(stream(spark, d), EVERY))


NEXT = P + f""", pr AS (SELECT position AS prediction, sender % 40 AS s, receiver % 10 AS r, t_us, label FROM e WHERE role > 0), lk AS (SELECT sender % 40 AS s, receiver % 10 AS r, t_us FROM e)
, nx AS (SELECT p.prediction, p.label, (min(CASE WHEN l.t_us > p.t_us THEN l.t_us END) - p.t_us) / 1000000.0::DOUBLE AS d, bool_or(l.t_us <= p.t_us) AS repeat FROM pr p JOIN lk l ON l.s = p.s AND l.r = p.r GROUP BY p.prediction, p.label, p.t_us)
, no AS (SELECT prediction, label, CASE WHEN d <= {HORIZON} THEN d END AS delay_s, repeat FROM nx)"""


def predictions(spark, d):
    e = stream(spark, d).withColumns({"s": F.col("sender") % 40, "r": F.col("receiver") % 10})
    p = e.where("role > 0").select(F.col("position").alias("prediction"), "s", "r", "t_us")
    n = fo.next_occurrence(p, e.select("s", "r", "t_us"), HORIZON, ("s", "r"))
    return n.join(e.select(F.col("position").alias("prediction"), "label"), "prediction")


@query("j13_next_occurrence", NEXT + " SELECT prediction, round(delay_s, 6) AS delay_s, repeat FROM no")
def _j13(spark, d):
    return predictions(spark, d).select("prediction", F.round("delay_s", 6).alias("delay_s"), "repeat")


@query("m18_ahead_share", NEXT + """ SELECT label, count(*) AS links, round(count(delay_s) / count(*)::DOUBLE, 9) AS happens, round(avg(CASE WHEN repeat THEN 0.0 ELSE 1.0 END), 9) AS new_link_share, round(count(CASE WHEN delay_s > 5 THEN 1 END) / count(delay_s)::DOUBLE, 9) AS ahead_5s,
 round(count(CASE WHEN delay_s > 1 THEN 1 END) / count(delay_s)::DOUBLE, 9) AS ahead_1s, round(median(delay_s), 7) AS median_wait_s FROM no GROUP BY 1""")
def _m18(spark, d):
    r = fo.ahead_share(predictions(spark, d), "label", (5.0, 1.0))
    return r.select("label", "links", *[F.round(c, 9).alias(c) for c in ("happens", "new_link_share", "ahead_5s", "ahead_1s")], F.round("median_wait_s", 7).alias("median_wait_s"))


RANKS = P + f"""
, ends AS (SELECT position AS p, 0 AS side, sender AS host FROM e UNION ALL SELECT position, 1, receiver FROM e)
, rc AS (SELECT forecast, host, max(p * 2 + 1 - side) AS at2 FROM fc JOIN ends ON p BETWEEN fc.position - {WINDOW} AND fc.position WHERE host <> fc.sender GROUP BY 1, 2)
, rec AS (SELECT * FROM (SELECT forecast, host, row_number() OVER (PARTITION BY forecast ORDER BY at2 DESC, host) - 1 AS rank FROM rc) WHERE rank < 64)
, pc AS (SELECT forecast, e.receiver AS host, count(*) AS popularity FROM fc JOIN e ON e.position // {EVERY} BETWEEN fc.forecast - {HISTORY // EVERY} AND fc.forecast - 1 WHERE e.receiver <> fc.sender GROUP BY 1, 2)
, pop AS (SELECT forecast, host, popularity, row_number() OVER (PARTITION BY forecast ORDER BY popularity DESC, host) - 1 AS rank FROM pc)
, hosts AS (SELECT host, 167772160 + host * 37 % 1000 AS ip_number, min(p) AS first_position FROM ends GROUP BY 1)
, seq AS (SELECT *, lag(receiver) OVER (PARTITION BY sender ORDER BY position) AS r1, lag(receiver, 2) OVER (PARTITION BY sender ORDER BY position) AS r2 FROM e)
, tg AS (SELECT forecast, s.position, s.sender, x.t FROM f JOIN seq s USING (position), LATERAL (SELECT unnest([s.receiver, s.r1, s.r2]) AS t) x WHERE x.t IS NOT NULL)
, tn AS (SELECT tg.*, 167772160 + t * 37 % 1000 AS ip FROM tg)
, px0 AS (SELECT forecast, h.host, min(abs(h.ip_number - ip)) AS distance FROM tn JOIN hosts h ON h.first_position <= tn.position AND h.host <> tn.sender GROUP BY 1, 2)
, proxw AS (SELECT forecast, host, distance, row_number() OVER (PARTITION BY forecast ORDER BY distance, host) - 1 AS rank FROM px0)
, prox AS (SELECT * FROM proxw WHERE rank < {NEAREST})
, popw AS (SELECT fc.forecast, h.host, COALESCE(pc.popularity, 0) AS popularity, row_number() OVER (PARTITION BY fc.forecast ORDER BY COALESCE(pc.popularity, 0) DESC, h.host) - 1 AS rank
   FROM fc JOIN hosts h ON h.first_position <= fc.position AND h.host <> fc.sender LEFT JOIN pc ON pc.forecast = fc.forecast AND pc.host = h.host)
, pool AS (SELECT forecast, host FROM rec UNION SELECT forecast, host FROM prox UNION SELECT forecast, host FROM popw WHERE rank < {POPULAR})
, nc0 AS (SELECT fc.forecast, e.receiver AS host, min(e.t_us) AS nxt, fc.t_us AS t0, fc.sender FROM fc JOIN e ON e.sender = fc.sender AND e.t_us > fc.t_us AND e.t_us <= fc.t_us + {int(HORIZON * 1e6)} GROUP BY 1, 2, 4, 5)
, nc1 AS (SELECT *, NOT EXISTS (SELECT 1 FROM e WHERE e.sender = nc0.sender AND e.receiver = nc0.host AND e.t_us <= nc0.t0) AS is_new FROM nc0)
, truth AS (SELECT forecast, host, (nxt - t0) / 1000000.0::DOUBLE AS delay_s, is_new, CASE WHEN is_new AND row_number() OVER (PARTITION BY forecast, is_new ORDER BY nxt, host) <= 6 THEN row_number() OVER (PARTITION BY forecast, is_new ORDER BY nxt, host) END AS ord FROM nc1)
"""


def host_table(e):
    ends = e.select(F.col("position"), F.explode(F.array("sender", "receiver")).alias("host"))
    return ends.groupBy("host").agg(F.min("position").alias("first_position")).withColumn("ip_number", 167772160 + F.col("host") * 37 % 1000)


def inputs(spark, d):
    """The events, the forecasts and the hosts, as the rankings take them, written once."""
    e = pinned(stream(spark, d))
    return e, pinned(fo.forecast_points(e, EVERY)), pinned(host_table(e))


def pool(e, f, hosts):
    """(forecast, host, source, rank): what each list brings to the retrieval pool."""
    parts = (fo.recency_ranking(e, f, WINDOW), fo.proximity_ranking(e, f, hosts, NEAREST), fo.popularity_first(e, f, hosts, POPULAR, HISTORY, EVERY))
    return reduce(DataFrame.union, [l.select("forecast", "host", F.lit(i).alias("source"), F.col("rank").cast("int").alias("rank")) for i, l in enumerate(parts)])


def places(pairs, e, f, hosts, targets=None):
    """Where the whole lists by popularity and by distance put given hosts."""
    return fo.popularity_places(pairs, e, f, hosts, HISTORY, EVERY).select("forecast", "host", "rank"), fo.proximity_places(pairs, e, f, hosts, targets=targets).select("forecast", "host", "rank")


@query("m13_recency_ranking", RANKS + "SELECT forecast, host, rank::INT AS rank FROM rec")
def _m13r(spark, d):
    return fo.recency_ranking(stream(spark, d), points(spark, d), WINDOW)


@query("m13_popularity_ranking", RANKS + "SELECT forecast, host, popularity, rank::INT AS rank FROM pop")
def _m13p(spark, d):
    return fo.popularity_ranking(stream(spark, d), points(spark, d), HISTORY, EVERY)


@query("m13_proximity_ranking", RANKS + "SELECT forecast, host, distance, rank::INT AS rank FROM prox")
def _m13x(spark, d):
    return fo.proximity_ranking(*inputs(spark, d), NEAREST)


FUSED = """, s AS (SELECT forecast, host, sum(1.0::DOUBLE / (60 + rank + 1)) AS score FROM u GROUP BY 1, 2)
SELECT forecast, host, round(score, 9) AS score, row_number() OVER (PARTITION BY forecast ORDER BY round(score, 12) DESC, host)::INT - 1 AS rank FROM s"""
PLACES = "SELECT forecast, host, rank FROM rec UNION ALL SELECT forecast, host, rank FROM popw UNION ALL SELECT forecast, host, rank FROM proxw"


@query("m14_rrf_fuse", RANKS + f", u AS (SELECT l.* FROM ({PLACES}) l JOIN pool USING (forecast, host))" + FUSED)
def _m14(spark, d):
    """The pool's hosts, fused by their places in the three whole lists."""
    e, f, hosts = inputs(spark, d)
    rec = fo.recency_ranking(e, f, WINDOW)
    return fo.rrf_fuse([rec, *places(pinned(pool(e, f, hosts).select("forecast", "host").distinct()), e, f, hosts)]).withColumn("score", F.round("score", 9))


@query("m14_rrf_fuse_whole", RANKS + f", u AS ({PLACES})" + FUSED)
def _m14w(spark, d):
    """All hosts seen, fused; the result has a row for each of them and forecast."""
    e, f, hosts = inputs(spark, d)
    return fo.rrf_fuse([fo.recency_ranking(e, f, WINDOW), *places(pinned(fo.every_host(f, hosts)), e, f, hosts)]).withColumn("score", F.round("score", 9))


@query("m14_prior_fuse", RANKS + """, p AS (SELECT forecast, host, (1 + rank % 7) / 10.0::DOUBLE AS p FROM rec), n AS (SELECT forecast, count(*) AS len FROM proxw GROUP BY 1)
, j AS (SELECT p.*, 1.0::DOUBLE / (1 + COALESCE(x.rank, n.len, 0)) AS q FROM p LEFT JOIN proxw x USING (forecast, host) LEFT JOIN n USING (forecast)), z AS (SELECT *, 0.5 * ln(p) + 0.5 * ln(q / sum(q) OVER (PARTITION BY forecast)) AS fused FROM j)
SELECT forecast, host, round(fused, 6) AS fused FROM z""")
def _m14p(spark, d):
    e, f, hosts = inputs(spark, d)
    scored = pinned(fo.recency_ranking(e, f, WINDOW).select("forecast", "host", ((1 + F.col("rank") % 7) / 10.0).alias("p")))
    return fo.prior_fuse(scored, fo.proximity_places(scored, e, f, hosts), 0.5, fo.hosts_seen(f, hosts)).select("forecast", "host", F.round("fused", 6).alias("fused"))


@query("u06_candidate_pool", RANKS + f""", u AS (SELECT forecast, host, 0 AS source, rank FROM rec UNION ALL SELECT forecast, host, 1, rank FROM prox UNION ALL SELECT forecast, host, 2, rank FROM popw WHERE rank < {POPULAR}), g AS (SELECT forecast || ':' || host AS host, min(source * 1000 + rank) AS best FROM u GROUP BY 1)
SELECT host, (best // 1000)::INT AS source, (best % 1000)::INT AS rank FROM g""")
def _u06(spark, d):
    parts = pinned(pool(*inputs(spark, d)))
    key = lambda i: parts.where(F.col("source") == i).select(F.concat_ws(":", "forecast", "host").alias("host"), "rank")
    return gr.candidate_pool([key(0), key(1), key(2)])


def truth(spark, d):
    return fo.new_contacts(stream(spark, d), points(spark, d), HORIZON)


@query("m15_new_contacts", RANKS + "SELECT forecast, host, round(delay_s, 6) AS delay_s, is_new, ord::INT AS \"order\" FROM truth")
def _m15t(spark, d):
    return truth(spark, d).withColumn("delay_s", F.round("delay_s", 6))


ALL = RANKS + ", lst AS (SELECT 'recent' AS method, forecast, host, rank FROM rec UNION ALL SELECT 'popular', forecast, host, rank FROM popw UNION ALL SELECT 'near', forecast, host, rank FROM proxw), " \
    "fr AS (SELECT m.method, t.forecast, t.host, t.ord, l.rank FROM truth t CROSS JOIN (SELECT DISTINCT method FROM lst) m LEFT JOIN lst l ON l.method = m.method AND l.forecast = t.forecast AND l.host = t.host WHERE ord IS NOT NULL)"


def judged(spark, d, shown=10):
    """Of each list the first `shown` and the places of the true hosts, and what was true."""
    e, f, hosts = inputs(spark, d)
    true, targets = pinned(fo.new_contacts(e, f, HORIZON)), pinned(fo.last_targets(e, f))
    popular, near = places(true.where("`order` IS NOT NULL"), e, f, hosts, targets)
    first = fo.popularity_first(e, f, hosts, shown, HISTORY, EVERY), fo.proximity_first(e, f, hosts, shown, targets=targets)
    both = [("recent", fo.recency_ranking(e, f, WINDOW)), ("popular", popular), ("popular", first[0]), ("near", near), ("near", first[1])]
    return pinned(reduce(DataFrame.union, [l.select(F.lit(n).alias("method"), "forecast", "host", F.col("rank").cast("long").alias("rank")) for n, l in both]).distinct()), true


@query("m15_hit_report", ALL + """
, a AS (SELECT method, count(*) AS forecasts, """ + ", ".join(f"round(avg(CASE WHEN rank < {n} THEN 1.0 ELSE 0.0 END), 6) AS hit_{n}" for n in (1, 3, 5, 10, 20)) + """, round(avg(COALESCE(1.0::DOUBLE / (rank + 1), 0)), 6) AS mrr FROM fr WHERE ord = 1 GROUP BY 1)
, b0 AS (SELECT method, forecast, """ + ", ".join(f"avg(CASE WHEN rank < {n} THEN 1.0::DOUBLE ELSE 0.0 END) AS r{n}" for n in (5, 10, 20)) + """ FROM fr GROUP BY 1, 2), b AS (SELECT method, """ + ", ".join(f"round(avg(r{n}), 6) AS recall_{n}" for n in (5, 10, 20)) + """ FROM b0 GROUP BY 1)
, c0 AS (SELECT l.method, l.forecast, """ + ", ".join(f"avg(CASE WHEN l.rank < {n} THEN CASE WHEN t.host IS NULL THEN 0.0::DOUBLE ELSE 1.0 END END) AS p{n}" for n in (3, 10)) + """ FROM lst l LEFT JOIN truth t ON t.forecast = l.forecast AND t.host = l.host WHERE l.rank < 10 AND l.forecast IN (SELECT forecast FROM truth WHERE ord = 1) GROUP BY 1, 2)
, c AS (SELECT method, """ + ", ".join(f"round(avg(p{n}), 6) AS precision_{n}" for n in (3, 10)) + """ FROM c0 GROUP BY 1) SELECT * FROM a JOIN b USING (method) JOIN c USING (method)""")
def _m15(spark, d):
    r = fo.hit_report(*judged(spark, d))
    return r.select("method", "forecasts", *[F.round(c, 6).alias(c) for c in r.columns if c not in ("method", "forecasts")])


@query("m16_conformal_list_size", ALL + """
, x AS (SELECT method, forecast, COALESCE(rank::DOUBLE, 'inf'::DOUBLE) AS rank, row_number() OVER (PARTITION BY method ORDER BY forecast) - 1 AS i, count(*) OVER (PARTITION BY method) AS n FROM fr WHERE ord = 1)
, h AS (SELECT *, i < n // 2 AS half FROM x), s AS (SELECT method, rank, row_number() OVER (PARTITION BY method ORDER BY rank) - 1 AS rk, count(*) OVER (PARTITION BY method) AS m FROM h WHERE half)
, q AS (SELECT method, level, rank + 1 AS size FROM s CROSS JOIN (VALUES (0.5::DOUBLE), (0.8::DOUBLE)) v(level) WHERE rk = CAST(ceil((m - 1) * level) AS BIGINT))
SELECT method, level, size, round(avg(CASE WHEN rank < size THEN 1.0 ELSE 0.0 END), 6) AS held FROM h JOIN q USING (method) WHERE NOT half GROUP BY 1, 2, 3""")
def _m16(spark, d):
    r = fo.first_ranks(*judged(spark, d)).where("`order` = 1").select("method", "forecast", "rank")
    return fo.conformal_list_size(r, (0.5, 0.8)).withColumn("held", F.round("held", 6))


for _name, _of in (("m14_prior_fuse", _m14p), ("m15_hit_report", _m15), ("m16_conformal_list_size", _m16)):
    query(f"{_name}_whole", ORACLES[_name])(_of)  # older names of the same whole lists


@query("m17_reach_scores", P + """, pth AS (SELECT position // 50 AS forecast, position AS path, -score / 10 AS lp, [receiver, (receiver * 7) % 100, (receiver + position % 3) % 100] AS hs FROM e)
, w AS (SELECT *, exp(lp - max(lp) OVER (PARTITION BY forecast)) AS w FROM pth), n AS (SELECT forecast, w / sum(w) OVER (PARTITION BY forecast) AS w, list_distinct(hs) AS hs FROM w), x AS (SELECT forecast, w, unnest(hs) AS host FROM n), g AS (SELECT forecast, host, sum(w) AS reach FROM x GROUP BY 1, 2)
SELECT forecast, host, round(reach, 6) AS reach FROM g""")
def _m17(spark, d):
    hosts = F.array(F.col("receiver"), F.col("receiver") * 7 % 100, (F.col("receiver") + F.col("position") % 3) % 100)
    p = stream(spark, d).select(F.floor(F.col("position") / 50).alias("forecast"), F.col("position").alias("path"), (-F.col("score") / 10).alias("log_probability"), hosts.alias("hosts"))
    return fo.reach_scores(p).select("forecast", "host", F.round("reach", 6).alias("reach"))


@query("m19_target_and_negatives", P + f""", a AS (SELECT position, sender, CASE WHEN role = 2 THEN sender ELSE receiver END AS target, position // {EVERY} AS block FROM e WHERE role IN (1, 2))
, h AS (SELECT DISTINCT position // {EVERY} + 1 AS block, unnest([sender, receiver]) AS host FROM e), has AS (SELECT DISTINCT block FROM h)
, c AS (SELECT position, host, row_number() OVER (PARTITION BY position ORDER BY (((host * 2654435761 + position * 40503) % 4294967296) * 69069 + 1) % 4294967296, host) AS rn FROM a JOIN h USING (block) WHERE host <> target AND host <> sender)
, n AS (SELECT position, string_agg(host, ',' ORDER BY rn) AS negatives FROM c WHERE rn <= 5 GROUP BY 1)
SELECT position, sender, target, COALESCE(negatives, '') AS negatives FROM a JOIN has USING (block) LEFT JOIN n USING (position)""")
def _m19(spark, d):
    e = stream(spark, d)
    return fo.target_and_negatives(e, fo.active_sets(e, EVERY), EVERY).withColumn("negatives", F.array_join("negatives", ","))
