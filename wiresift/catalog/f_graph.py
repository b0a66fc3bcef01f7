"""Causal neighbourhood, link, campaign and lead-time queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from wiresift.catalog import e_splits as es
from wiresift.catalog.registry import query
from wiresift.operators import graph as gr
from wiresift.operators import splits as sp
from wiresift.sources import fixtures as fx

P = ("WITH " + fx.PACKETS_CTE + ", e AS (SELECT frame_no AS position, us, CAST(user_id % 40 AS INT) AS sender, CAST(k % 40 AS INT) AS receiver, family AS label, score, k, "
     "CASE k % 3 WHEN 0 THEN 'event' WHEN 1 THEN 'summary' ELSE 'record' END AS kind FROM packets) ")


def stream(spark, d):
    kind = F.when(F.col("k") % 3 == 0, "event").when(F.col("k") % 3 == 1, "summary").otherwise("record")
    return fx.packets(spark, d).select(F.col("frame_no").alias("position"), "us", (F.col("user_id") % 40).cast("int").alias("sender"), (F.col("k") % 40).cast("int").alias("receiver"),
                                       F.col("family").alias("label"), "score", "k", kind.alias("kind"))


# An earlier event is a peer's latest one at a query when the pair does not meet again before the query.
W11 = P + """
, r AS (SELECT 0 AS role, sender AS endpoint, receiver AS peer, position FROM e UNION ALL SELECT 1, receiver, sender, position FROM e)
, n AS (SELECT *, lead(position) OVER (PARTITION BY role, endpoint, peer ORDER BY position) AS nxt FROM r)
, c AS (SELECT q.position, q.role, n.position AS other FROM r q JOIN n ON n.role = q.role AND n.endpoint = q.endpoint AND n.position < q.position AND (n.nxt IS NULL OR n.nxt >= q.position) AND n.peer <> q.peer)
, t AS (SELECT *, row_number() OVER (PARTITION BY position ORDER BY other DESC) AS slot FROM c)
"""


@query("w11_distinct_peer_neighbours", W11 + "SELECT position, CAST(slot - 1 AS INT) AS slot, other AS neighbour FROM t WHERE slot <= 20")
def _w11(spark, d):
    return gr.distinct_peer_neighbours(stream(spark, d)).select("position", F.posexplode("neighbours").alias("slot", "neighbour"))


@query("w12_causal_recent", P + """
, h AS (SELECT position, us // 1000000 AS sec, sender AS node, receiver AS peer FROM e UNION ALL SELECT position, us // 1000000, receiver, sender FROM e WHERE sender <> receiver)
, o AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY position) AS rn, min(position) OVER (PARTITION BY node, sec) AS tie FROM h)
, q AS (SELECT o.position, o.node, f.rn AS upto FROM o JOIN e ON e.position = o.position AND e.sender = o.node JOIN o f ON f.node = o.node AND f.position = o.tie)
SELECT q.position, q.node, CAST(q.upto - 1 - o.rn AS INT) AS slot, o.position AS neighbour, o.peer FROM q JOIN o ON o.node = q.node AND o.rn BETWEEN q.upto - 8 AND q.upto - 1""")
def _w12(spark, d):
    # Whole seconds make simultaneous events common.
    e = stream(spark, d).withColumn("us", F.floor(F.col("us") / 1_000_000))
    r = gr.causal_recent(e, size=8)
    return r.select("position", "node", F.posexplode("recent").alias("slot", "_e")).select("position", "node", "slot", F.col("_e.position").alias("neighbour"), F.col("_e.peer").alias("peer"))


@query("w13_recently_active", P + """, m AS (SELECT max(position) // 2 AS last FROM e), x AS (SELECT position AS p, 0 AS role, sender AS node FROM e, m WHERE position BETWEEN last - 400 AND last UNION ALL SELECT position, 1, receiver FROM e, m WHERE position BETWEEN last - 400 AND last)
, g AS (SELECT node, max(p * 2 + 1 - role) AS pr FROM x GROUP BY 1) SELECT node, pr // 2 AS last_position, CAST(row_number() OVER (ORDER BY pr DESC) AS INT) AS recency FROM g ORDER BY pr DESC LIMIT 24""")
def _w13(spark, d):
    e = stream(spark, d)
    last = e.agg(F.max("position")).first()[0] // 2
    return gr.recently_active(e, last, 400, 24)


@query("w14_link_ids", P + ", l AS (SELECT DISTINCT sender, receiver FROM e WHERE k % 4 > 0), i AS (SELECT *, row_number() OVER (ORDER BY sender, receiver) - 1 AS link_id FROM l) "
       "SELECT position, COALESCE(link_id, -1) AS link_id FROM e LEFT JOIN i USING (sender, receiver)")
def _w14(spark, d):
    e = stream(spark, d)
    return gr.attach_link_ids(e, gr.link_ids(e.where("k % 4 > 0"))).select("position", "link_id")


@query("w15_link_state", P + """
, a AS (SELECT *, (us - lag(us) OVER (PARTITION BY sender, receiver ORDER BY position)) / 1000000.0::DOUBLE AS gap_s FROM e)
, b AS (SELECT *, gap_s IS NULL OR gap_s > 90 AS restarted FROM a)
, c AS (SELECT *, sum(CASE WHEN restarted THEN 1 ELSE 0 END) OVER (PARTITION BY sender, receiver ORDER BY position) AS life FROM b)
SELECT position, round(gap_s, 6) AS gap_s, restarted, """ + ", ".join(
    f"CAST(sum(CASE WHEN kind = '{k}' THEN 1 ELSE 0 END) OVER (PARTITION BY sender, receiver, life ORDER BY position) AS BIGINT) AS {k}_count" for k in ("event", "summary", "record")) + " FROM c")
def _w15(spark, d):
    return gr.link_state(stream(spark, d), ttl_s=90.0).select("position", F.round("gap_s", 6).alias("gap_s"), "restarted", "event_count", "summary_count", "record_count")


CAMP = P + """
, a AS (SELECT *, label <> 'Benign' AS attack, sum(CASE WHEN label = 'Benign' THEN 1 ELSE 0 END) OVER (PARTITION BY sender ORDER BY position) AS calm FROM e)
, b AS (SELECT *, calm - lag(calm) OVER (PARTITION BY sender ORDER BY position) AS quiet FROM a WHERE attack)
, c AS (SELECT *, sum(CASE WHEN quiet < 8 THEN 0 ELSE 1 END) OVER (PARTITION BY sender ORDER BY position) AS nth FROM b)
, ids AS (SELECT sender, nth, row_number() OVER (ORDER BY sender, nth) - 1 AS campaign FROM (SELECT DISTINCT sender, nth FROM c))
, w AS (SELECT e.*, e.label <> 'Benign' AS attack, COALESCE(ids.campaign, -1) AS campaign, CASE WHEN e.position % 10 < 6 THEN 0 WHEN e.position % 10 = 6 THEN 1 ELSE 2 END AS split
  FROM e LEFT JOIN c ON c.position = e.position LEFT JOIN ids ON ids.sender = c.sender AND ids.nth = c.nth)
, pts(point, threshold) AS (VALUES ('low', 30.0::DOUBLE), ('mid', 45.0::DOUBLE), ('high', 80.0::DOUBLE))
"""


def with_campaigns(spark, d):
    c = gr.campaigns(stream(spark, d), F.col("label") != "Benign", "sender", quiet=8)
    slot = F.col("position") % 10
    return c.withColumns({"attack": F.col("label") != "Benign", "split": F.when(slot < 6, 0).when(slot == 6, 1).otherwise(2)})


@query("w21_campaigns", CAMP + "SELECT position, campaign FROM w")
def _w21(spark, d):
    return with_campaigns(spark, d).select("position", "campaign")


@query("w22_campaign_coverage", CAMP + """
, per AS (SELECT campaign, count(*) AS size, count(CASE WHEN split = 2 THEN 1 END) AS n, max(CASE WHEN split = 2 THEN score END) AS best FROM w WHERE campaign >= 0 GROUP BY 1 HAVING count(CASE WHEN split = 2 THEN 1 END) > 0)
, cc AS (SELECT point, threshold, count(*) AS campaigns_in_test, count(CASE WHEN best >= threshold THEN 1 END) AS campaigns_covered, count(CASE WHEN best < threshold THEN 1 END) AS campaigns_missed,
   COALESCE(sum(CASE WHEN best < threshold THEN size END), 0)::BIGINT AS missed_events FROM per CROSS JOIN pts GROUP BY 1, 2)
, h AS (SELECT point, count(CASE WHEN attack AND score >= threshold THEN 1 END) / count(CASE WHEN attack THEN 1 END)::DOUBLE AS event_recall, count(CASE WHEN NOT attack AND score >= threshold THEN 1 END) AS false_alarms FROM w CROSS JOIN pts WHERE split = 2 GROUP BY 1)
SELECT point, threshold, round(event_recall, 9) AS event_recall, false_alarms, campaigns_in_test, campaigns_covered, campaigns_missed, missed_events FROM cc JOIN h USING (point)""")
def _w22(spark, d):
    pts = spark.createDataFrame([("low", 30.0), ("mid", 45.0), ("high", 80.0)], "point string, threshold double")
    return gr.campaign_coverage(with_campaigns(spark, d), pts).withColumn("event_recall", F.round("event_recall", 9))


@query("u04_missed_campaigns", CAMP + "SELECT DISTINCT campaign FROM w WHERE campaign >= 0 AND split = 2 AND campaign NOT IN (SELECT campaign FROM w WHERE split = 2 AND campaign >= 0 AND score >= 45)")
def _u04(spark, d):
    return gr.missed_campaigns(with_campaigns(spark, d), 45.0)


FAMS = ["Flood", "Bot", "Web"]


@query("w23_lead_ceilings", P + """
, s AS (SELECT *, CASE WHEN position % 10 < 6 THEN 0 WHEN position % 10 = 6 THEN 1 ELSE 2 END AS split FROM e)
, f AS (SELECT s.*, fam, s.label = fam AS attack FROM s CROSS JOIN (VALUES ('Flood'), ('Bot'), ('Web')) v(fam))
, n AS (SELECT *, min(CASE WHEN attack THEN us END) OVER (PARTITION BY fam, sender ORDER BY position ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM f)
, l AS (SELECT fam, (nxt - us) / 1000000.0::DOUBLE AS lead_s FROM n WHERE NOT attack AND nxt IS NOT NULL)
, la AS (SELECT fam, count(*) AS event_lead_n, max(lead_s) AS event_lead_max_s, count(CASE WHEN lead_s > 60 THEN 1 END) AS event_lead_n_over_60s, median(lead_s) AS event_lead_median_s FROM l GROUP BY 1)
, h AS (SELECT fam, sender, min(us) AS seen, min(CASE WHEN attack THEN us END) AS first, count(CASE WHEN attack THEN 1 END) AS n, arg_min(split, position) FILTER (attack) AS fs FROM f GROUP BY 1, 2 HAVING count(CASE WHEN attack THEN 1 END) > 0)
, g AS (SELECT *, (first - seen) / 1000000.0::DOUBLE AS warm, (first - lag(first) OVER (PARTITION BY fam ORDER BY first)) / 1000000.0::DOUBLE AS gap FROM h)
, ha AS (SELECT fam, sum(n)::BIGINT AS attack_events, count(*) AS attacking_hosts, max(warm) AS campaign_warmup_max_s, median(warm) AS campaign_warmup_median_s, (max(first) - min(first)) / 1000000.0::DOUBLE AS cross_host_total_stagger_s, median(gap) AS cross_host_median_gap_s,
   count(CASE WHEN fs = 0 THEN 1 END) AS first_attacks_in_train, count(CASE WHEN fs = 2 THEN 1 END) AS first_attacks_in_test FROM g GROUP BY 1)
SELECT ha.fam AS family, attack_events, attacking_hosts, first_attacks_in_train, first_attacks_in_test, COALESCE(event_lead_n, 0) AS event_lead_n, COALESCE(event_lead_n_over_60s, 0) AS event_lead_n_over_60s,
 """ + ", ".join(f"round({c}, 7) AS {c}" for c in ("campaign_warmup_max_s", "campaign_warmup_median_s", "cross_host_total_stagger_s", "cross_host_median_gap_s", "event_lead_max_s", "event_lead_median_s"))
       + " FROM ha LEFT JOIN la USING (fam)")
def _w23(spark, d):
    slot = F.col("position") % 10
    e = stream(spark, d).withColumn("split", F.when(slot < 6, 0).when(slot == 6, 1).otherwise(2))
    r = gr.lead_ceilings(e, FAMS, host="sender")
    return r.withColumns({c: F.round(c, 7) for c in r.columns if c.endswith("_s") and c != "event_lead_n_over_60s"})


@query("w24_time_to_new_peer", P + """
, s AS (SELECT *, row_number() OVER (PARTITION BY sender, receiver ORDER BY position) = 1 AS fresh FROM e)
, n AS (SELECT *, min(CASE WHEN fresh THEN us END) OVER (PARTITION BY sender ORDER BY position ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM s)
, w AS (SELECT label, (nxt - us) / 1000000.0::DOUBLE AS wait_s FROM n WHERE label <> 'Benign')
SELECT label, count(*) AS events, round(count(wait_s) / count(*)::DOUBLE, 9) AS share_reaching, round(count(CASE WHEN wait_s > 1 THEN 1 END) / count(wait_s)::DOUBLE, 9) AS ahead_1s,
 round(count(CASE WHEN wait_s > 30 THEN 1 END) / count(wait_s)::DOUBLE, 9) AS ahead_30s, round(median(wait_s), 7) AS median_wait_s FROM w GROUP BY 1""")
def _w24(spark, d):
    w = gr.time_to_new_peer(stream(spark, d)).where("label <> 'Benign'")
    r = gr.new_peer_summary(w, "label", (1.0, 30.0))
    return r.select("label", "events", *[F.round(c, 9).alias(c) for c in ("share_reaching", "ahead_1s", "ahead_30s")], F.round("median_wait_s", 7).alias("median_wait_s"))


@query("w26_dedupe_alarms", P + """, b AS (SELECT DISTINCT sender, label FROM e WHERE position < 50), f AS (SELECT sender, label, min(position) AS position FROM e GROUP BY 1, 2)
SELECT f.sender, f.label, f.position, e.score FROM f JOIN e USING (position) WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.sender = f.sender AND b.label = f.label)""")
def _w26(spark, d):
    e = stream(spark, d)
    return gr.dedupe_alarms(e, ["sender", "label"], "position", e.where("position < 50")).select("sender", "label", "position", "score")


@query("k03_rank_hosts", P + ", s AS (SELECT label, receiver AS host, round(sum(score), 6) AS score FROM e GROUP BY 1, 2) SELECT label, host, score, CAST(row_number() OVER (PARTITION BY label ORDER BY score DESC, host) AS INT) AS rank FROM s")
def _k03(spark, d):
    s = stream(spark, d).groupBy("label", F.col("receiver").alias("host")).agg(F.round(F.sum("score"), 6).alias("score"))
    return gr.rank_hosts(s, "label", "host", "score")


@query("k04_seed_selection", P + ", b AS (SELECT *, row_number() OVER (PARTITION BY sender ORDER BY score DESC, position) AS rn FROM e) SELECT sender, position, score FROM b WHERE rn = 1 ORDER BY score DESC, position LIMIT 12")
def _k04(spark, d):
    return gr.seed_selection(stream(spark, d), "sender", "score", "position", 12)
