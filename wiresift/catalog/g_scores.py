"""Threshold, ranking-metric, run, incident and evidence queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from wiresift.catalog.registry import ORACLES, QUERIES, query
from wiresift.operators import features as ft
from wiresift.operators import incidents as inc
from wiresift.operators import metrics as me
from wiresift.operators import splits as sp
from wiresift.sources import fixtures as fx

P = "WITH " + fx.PACKETS_CTE + """
, sc AS (SELECT frame_no AS position, us AS t_us, user_id % 40 AS sender, k % 40 AS receiver, fam AS family, p.family AS label,
   value + CASE WHEN p.family = fam THEN 20 WHEN p.family <> 'Benign' THEN 5 ELSE 0 END AS score, p.family = fam AS positive, p.family <> 'Benign' AS attack,
   CASE (frame_no // 200) % 5 WHEN 0 THEN 0 WHEN 1 THEN 0 WHEN 2 THEN 1 ELSE 2 END AS split,
   p.family = 'Benign' AND ((frame_no // 200) % 5 = 2 OR ((frame_no // 200) % 5 < 2 AND frame_no % 5 = 0)) AS calib,
   CASE WHEN k % 2 = 0 THEN 'early_observation' ELSE 'completed_before_budget' END AS population, src_ip, dst_ip, src_port, dst_port, protocol, k, 1 + k % 3 AS packets_seen
  FROM packets p CROSS JOIN (VALUES ('Flood'), ('Bot')) v(fam))
"""
FAMILIES = ["Flood", "Bot"]


def scores(spark, d):
    """One row per (packet, scored family)."""
    p = fx.packets(spark, d)
    block = F.floor(F.col("frame_no") / 200) % 5
    p = p.select(
        F.col("frame_no").alias("position"), F.col("us").alias("t_us"), (F.col("user_id") % 40).alias("sender"), (F.col("k") % 40).cast("bigint").alias("receiver"), F.col("family").alias("label"), "value",
        (F.col("family") != "Benign").alias("attack"), F.when(block < 2, 0).when(block == 2, 1).otherwise(2).alias("split"),
        ((F.col("family") == "Benign") & ((block == 2) | ((block < 2) & (F.col("frame_no") % 5 == 0)))).alias("calib"),
        F.when(F.col("k") % 2 == 0, "early_observation").otherwise("completed_before_budget").alias("population"), "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "k",
        (1 + F.col("k") % 3).alias("packets_seen"), F.explode(F.array(*[F.lit(f) for f in FAMILIES])).alias("family"))
    bonus = F.when(F.col("label") == F.col("family"), 20).when(F.col("attack"), 5).otherwise(0)
    return p.withColumns({"score": F.col("value") + bonus, "positive": F.col("label") == F.col("family")}).drop("value")


def rnd(df, *cols, digits=9):
    return df.withColumns({c: F.round(c, digits) for c in cols})


BUD = (0.1, 0.03, 0.01)
BUD_SQL = "b(budget) AS (VALUES " + ", ".join(f"({x}::DOUBLE)" for x in BUD) + ")"
TH = P + ", " + BUD_SQL + """
, cal AS (SELECT family, score, row_number() OVER (PARTITION BY family ORDER BY score) - 1 AS rk, count(*) OVER (PARTITION BY family) AS n FROM sc WHERE calib)
, th AS (SELECT family, budget, score AS threshold FROM cal CROSS JOIN b WHERE rk = CAST(ceil((n - 1) * (1.0::DOUBLE - budget)) AS BIGINT))
"""


@query("m01_budget_threshold", TH + "SELECT * FROM th")
def _m01(spark, d):
    return me.budget_threshold(scores(spark, d).where("calib"), ["family"], BUD)


SWEEP = TH + """
, hr AS (WITH o AS (SELECT DISTINCT position, t_us, split FROM sc), r AS (SELECT t_us, split, row_number() OVER (ORDER BY position) - row_number() OVER (PARTITION BY split ORDER BY position) AS run FROM o)
   SELECT sum(span) / 3.6e9::DOUBLE AS hours FROM (SELECT max(t_us) - min(t_us) AS span FROM r WHERE split = 2 GROUP BY run))
, f AS (SELECT s.*, budget, threshold, score >= threshold AS fires FROM sc s JOIN th USING (family) WHERE split = 2)
, i0 AS (SELECT family, budget, t_us - lag(t_us) OVER (PARTITION BY family, budget, sender ORDER BY position) AS gap FROM f WHERE fires AND NOT attack)
, i1 AS (SELECT family, budget, count(CASE WHEN gap IS NULL OR gap > 20000000 THEN 1 END) AS n FROM i0 GROUP BY 1, 2)
, sw AS (SELECT family, budget, threshold, count(CASE WHEN fires AND positive THEN 1 END) AS true_positives, count(CASE WHEN fires AND NOT attack THEN 1 END) AS false_alarms, count(CASE WHEN positive THEN 1 END) AS positives, count(CASE WHEN NOT attack THEN 1 END) AS benign_test FROM f GROUP BY 1, 2, 3)
, swp AS (SELECT family, budget, threshold, true_positives / positives::DOUBLE AS recall, true_positives / greatest(true_positives + false_alarms, 1)::DOUBLE AS precision, false_alarms / benign_test::DOUBLE AS realised_fpr,
   false_alarms / benign_test::DOUBLE / budget AS overshoot_vs_budget, false_alarms, false_alarms / hours AS fa_per_hour, COALESCE(n, 0) / hours AS false_incidents_per_hour, true_positives, positives, benign_test, hours
  FROM sw LEFT JOIN i1 USING (family, budget) CROSS JOIN hr)
"""
SW_ROUND = ["recall", "precision", "realised_fpr", "overshoot_vs_budget", "fa_per_hour", "false_incidents_per_hour", "hours"]
SW_SELECT = "SELECT family, budget, threshold, " + ", ".join(f"round({c}, 6) AS {c}" for c in SW_ROUND) + ", false_alarms, true_positives, positives, benign_test FROM "


def swept(spark, d):
    s = scores(spark, d)
    hours = sp.band_hours(s.where("family = 'Flood'"), "position", us="t_us")
    return me.sweep(s, hours, BUD, 20.0)


@query("m02_sweep", SWEEP + SW_SELECT + "swp")
def _m02(spark, d):
    return rnd(swept(spark, d), *SW_ROUND, digits=6)


@query("m03_pick_operating_point", SWEEP + ", pk AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY fa_per_hour, budget DESC) AS rn FROM swp WHERE recall >= 0.05) " + SW_SELECT + "pk WHERE rn = 1")
def _m03(spark, d):
    return rnd(me.pick_operating_point(swept(spark, d), 0.05), *SW_ROUND, digits=6)


CURVE = P + """
, d AS (SELECT family, score, count(*) AS n, count(CASE WHEN positive THEN 1 END) AS pos, count(CASE WHEN NOT positive THEN 1 END) AS neg FROM sc WHERE split = 2 AND (positive OR NOT attack) GROUP BY 1, 2)
, c AS (SELECT *, sum(n) OVER w AS seen, sum(pos) OVER w AS tp, sum(pos) OVER (PARTITION BY family) AS total_pos, sum(neg) OVER (PARTITION BY family ORDER BY score) - neg AS below FROM d WINDOW w AS (PARTITION BY family ORDER BY score DESC))
"""


def ranked(spark, d):
    return scores(spark, d).where("split = 2 AND (positive OR NOT attack)")


@query("m04_average_precision_tied", CURVE + "SELECT family, max(total_pos)::BIGINT AS positives, round(sum(pos / total_pos::DOUBLE * (tp / seen::DOUBLE)), 9) AS pr_auc FROM c GROUP BY 1")
def _m04(spark, d):
    return rnd(me.average_precision(ranked(spark, d), ["family"]), "pr_auc")


@query("m05_auroc", CURVE + "SELECT family, round(sum(pos * (below + neg / 2.0::DOUBLE)) / (sum(pos)::DOUBLE * sum(neg)::DOUBLE), 9) AS auroc FROM c GROUP BY 1")
def _m05(spark, d):
    return rnd(me.auroc(ranked(spark, d), ["family"]), "auroc")


@query("m06_pr_threshold_f1", CURVE + ", p AS (SELECT family, score, tp / seen::DOUBLE AS pr, tp / total_pos::DOUBLE AS rc FROM c), q AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0 END DESC, score DESC) AS rn FROM p) "
       "SELECT family, score AS threshold, round(pr, 9) AS precision, round(rc, 9) AS recall FROM q WHERE rn = 1")
def _m06(spark, d):
    return rnd(me.pr_threshold(ranked(spark, d), ["family"]), "precision", "recall")


@query("m06_pr_threshold_floor", CURVE + ", p AS (SELECT family, score, tp / seen::DOUBLE AS pr, tp / total_pos::DOUBLE AS rc FROM c), q AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY CASE WHEN pr >= 0.2 THEN 0 ELSE 1 END, CASE WHEN pr >= 0.2 THEN rc ELSE pr END DESC, score DESC) AS rn FROM p) "
       "SELECT family, score AS threshold, round(pr, 9) AS precision, round(rc, 9) AS recall FROM q WHERE rn = 1")
def _m06b(spark, d):
    return rnd(me.pr_threshold(ranked(spark, d), ["family"], 0.2), "precision", "recall")


@query("m07_cost_of_recall", CURVE + """
, fr AS (SELECT family, score, row_number() OVER (PARTITION BY family ORDER BY score) - 1 AS rk, count(*) OVER (PARTITION BY family) AS n FROM sc WHERE split = 2 AND positive)
, cut AS (SELECT family, score AS cut FROM fr WHERE rk = CAST(floor((n - 1) * (1.0::DOUBLE - 0.9::DOUBLE)) AS BIGINT))
, g AS (SELECT family, count(CASE WHEN score >= cut AND NOT attack THEN 1 END) AS fp, count(CASE WHEN NOT attack THEN 1 END) AS nb, count(CASE WHEN score >= cut AND positive THEN 1 END) / count(CASE WHEN positive THEN 1 END)::DOUBLE AS r
   FROM sc JOIN cut USING (family) WHERE split = 2 AND (positive OR NOT attack) GROUP BY 1)
, a AS (SELECT family, sum(pos / total_pos::DOUBLE * (tp / seen::DOUBLE)) AS pr_auc FROM c GROUP BY 1)
SELECT family, fp AS fp_at_target_oracle, round(fp / nb::DOUBLE, 9) AS fpr_at_target_oracle, r >= 0.9 - 1e-9 AS reached, round(pr_auc, 9) AS pr_auc FROM g JOIN a USING (family)""")
def _m07(spark, d):
    return rnd(me.cost_of_recall(scores(spark, d).where("split = 2"), ["family"], 0.9), "fpr_at_target_oracle", "pr_auc")


CUT = 34.0
RUNS = P + f"""
, z AS (SELECT *, score >= {CUT} AS fires, sum(CASE WHEN score >= {CUT} THEN 0 ELSE 1 END) OVER (PARTITION BY family, sender ORDER BY position) AS isl FROM sc)
, ru AS (SELECT *, CASE WHEN fires THEN sum(CASE WHEN fires THEN 1 ELSE 0 END) OVER (PARTITION BY family, sender, isl ORDER BY position) ELSE 0 END AS run FROM z)
, al AS (SELECT *, t_us - lag(t_us) OVER (PARTITION BY family, sender ORDER BY position) AS gap FROM ru WHERE run >= 2)
, an AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > 40000000 THEN 1 ELSE 0 END) OVER (PARTITION BY family, sender ORDER BY position) AS nth FROM al)
, ic AS (SELECT family, sender, nth, min(position) AS opened_position, arg_min(t_us, position) AS opened_us, max(t_us) AS last_alert_us, arg_min(score, position) AS opening_score, count(*) AS alerts FROM an GROUP BY 1, 2, 3)
, inc AS (SELECT *, row_number() OVER (ORDER BY opened_position, family, sender) AS incident FROM ic)
"""
KEYS = ["family", "sender"]


def runs(spark, d):
    return inc.persist_runs(scores(spark, d).withColumn("threshold", F.lit(CUT)), KEYS, n=2)


def opened(spark, d):
    return inc.incidents_from_alerts(runs(spark, d).where("alert"), KEYS, 40.0)[1]


@query("w17_persist_runs", RUNS + "SELECT position, family, run::BIGINT AS run, run >= 2 AS alert FROM ru")
def _w17(spark, d):
    return runs(spark, d).select("position", "family", "run", "alert")


@query("w18_incidents_from_alerts", RUNS + "SELECT family, sender, incident, opened_us, last_alert_us, opening_score, alerts FROM inc")
def _w18(spark, d):
    return opened(spark, d).select("family", "sender", "incident", "opened_us", "last_alert_us", "opening_score", "alerts")


EVID = RUNS + """
, third AS (SELECT family, sender, isl, nth FROM an WHERE run = 2)
, lk AS (SELECT position, family, sender, run, nth FROM an UNION ALL SELECT r.position, r.family, r.sender, r.run, t.nth FROM ru r JOIN third t ON t.family = r.family AND t.sender = r.sender AND t.isl = r.isl WHERE r.run BETWEEN 1 AND 1)
, ev AS (SELECT lk.position, lk.family, lk.sender, lk.run, inc.incident, inc.opened_us FROM lk JOIN inc USING (family, sender, nth))
"""


def evidence(spark, d):
    return inc.incident_evidence(scores(spark, d).withColumn("threshold", F.lit(CUT)), KEYS, 40.0, 2)


@query("w27_incident_evidence", EVID + "SELECT position, family, sender, run::BIGINT AS run, incident, opened_us FROM ev")
def _w27(spark, d):
    return evidence(spark, d)


NOW = fx.BASE_US + 700_000_000


@query("w28_open_incidents", RUNS + f", l AS (SELECT *, row_number() OVER (PARTITION BY family, sender ORDER BY incident DESC) AS rn FROM inc) SELECT family, sender, incident, opened_us, last_alert_us FROM l WHERE rn = 1 AND last_alert_us + 40000000 >= {NOW}")
def _w28(spark, d):
    return inc.open_incidents(opened(spark, d), KEYS, NOW, 40.0)


@query("k02_recent_incidents", RUNS + f"SELECT * FROM (SELECT incident, family, sender, opened_us FROM inc WHERE opened_us >= {NOW} - 400000000 ORDER BY opened_us DESC, incident DESC LIMIT 50)")
def _k02(spark, d):
    return inc.recent_incidents(opened(spark, d), NOW, 400_000_000, 50).select("incident", "family", "sender", "opened_us")


@query("m08_emission_funnel", RUNS + """, fi AS (SELECT DISTINCT family, sender FROM inc)
SELECT s.family, count(*) AS events, count(CASE WHEN s.fires THEN 1 END) AS above_threshold, count(CASE WHEN s.run >= 2 THEN 1 END) AS after_persist, (SELECT count(*) FROM inc i WHERE i.family = s.family) AS incidents,
 count(CASE WHEN s.positive AND EXISTS (SELECT 1 FROM fi WHERE fi.family = s.family AND fi.sender = s.sender) THEN 1 END) AS attack_events_on_alerting_hosts, count(CASE WHEN s.positive THEN 1 END) AS attack_events,
 (SELECT count(*) FROM fi WHERE fi.family = s.family) AS hosts_alerted FROM ru s GROUP BY s.family""")
def _m08(spark, d):
    r = runs(spark, d)
    hosts = opened(spark, d)
    fired = hosts.groupBy("family", "sender").agg(F.count(F.lit(1)).alias("n"))
    top = fired.groupBy("family").agg(F.sum("n").alias("incidents"), F.count(F.lit(1)).alias("hosts_alerted"))
    base = r.groupBy("family").agg(F.count(F.lit(1)).alias("events"), F.count(F.when(F.col("run") > 0, 1)).alias("above_threshold"), F.count(F.when(F.col("alert"), 1)).alias("after_persist"),
                                   F.count(F.when(F.col("positive"), 1)).alias("attack_events"))
    caught = r.where("positive").join(fired, KEYS, "left_semi").groupBy("family").agg(F.count(F.lit(1)).alias("attack_events_on_alerting_hosts"))
    return base.join(top, "family", "left").join(caught, "family", "left").fillna(0)


@query("m09_population_report", P + """
, d AS (SELECT population, family, score, count(*) AS n, count(CASE WHEN positive THEN 1 END) AS pos FROM sc WHERE split = 2 AND (positive OR NOT attack) GROUP BY 1, 2, 3)
, c AS (SELECT *, sum(n) OVER w AS seen, sum(pos) OVER w AS tp, sum(pos) OVER (PARTITION BY population, family) AS total_pos FROM d WINDOW w AS (PARTITION BY population, family ORDER BY score DESC))
SELECT population, family, max(total_pos)::BIGINT AS positives, round(sum(pos / total_pos::DOUBLE * (tp / seen::DOUBLE)), 9) AS pr_auc FROM c GROUP BY 1, 2""")
def _m09(spark, d):
    return rnd(me.average_precision(ranked(spark, d), ["population", "family"]), "pr_auc")


@query("m10_choose_score_and_tail", P + """
, cand AS (SELECT 'surprise' AS name, position, -score AS score, attack FROM sc WHERE split = 1 AND family = 'Flood' UNION ALL SELECT 'target', position, score, attack FROM sc WHERE split = 1 AND family = 'Bot')
, d AS (SELECT name, score, count(CASE WHEN attack THEN 1 END) AS pos, count(CASE WHEN NOT attack THEN 1 END) AS neg FROM cand GROUP BY 1, 2), c AS (SELECT *, sum(neg) OVER (PARTITION BY name ORDER BY score) - neg AS below FROM d)
, a AS (SELECT name, sum(pos * (below + neg / 2.0::DOUBLE)) / (sum(pos)::DOUBLE * sum(neg)::DOUBLE) AS auroc FROM c GROUP BY 1)
, s AS (SELECT cand.*, auroc, CASE WHEN auroc < 0.5 THEN -1 ELSE 1 END AS direction, score * CASE WHEN auroc < 0.5 THEN -1 ELSE 1 END AS signed FROM cand JOIN a USING (name))
, q AS (SELECT name, quantile_cont(signed, 0.95) AS cut FROM s WHERE NOT attack GROUP BY 1)
, r AS (SELECT name, max(auroc) AS auroc, max(direction) AS direction, avg(CASE WHEN signed >= cut THEN 1.0 ELSE 0.0 END) FILTER (attack) AS val_recall FROM s JOIN q USING (name) GROUP BY 1)
SELECT name, round(auroc, 9) AS auroc, direction, round(val_recall, 9) AS val_recall, round(greatest(auroc, 1 - auroc), 9) AS separation, row_number() OVER (ORDER BY val_recall DESC, greatest(auroc, 1 - auroc) DESC, name DESC) = 1 AS chosen FROM r""")
def _m10(spark, d):
    s = scores(spark, d)
    cand = s.where("family = 'Flood'").select(F.lit("surprise").alias("name"), "position", (-F.col("score")).alias("score"), "attack", "split").unionByName(
        s.where("family = 'Bot'").select(F.lit("target").alias("name"), "position", "score", "attack", "split"))
    return rnd(me.choose_score_and_tail(cand, 0.05), "auroc", "val_recall", "separation")


@query("m11_calibration_table", P + ", " + BUD_SQL + """
, q AS (""" + " UNION ALL ".join(f"SELECT {x}::DOUBLE AS budget, quantile_cont(score, {1 - x}) AS threshold FROM sc WHERE calib AND family = 'Flood'" for x in BUD) + """)
, t AS (SELECT sc.*, budget, threshold, score >= threshold AS fires FROM sc CROSS JOIN q WHERE family = 'Flood' AND split = 2)
, z AS (SELECT *, sum(CASE WHEN fires THEN 0 ELSE 1 END) OVER (PARTITION BY budget, sender ORDER BY position) AS isl FROM t)
, ru AS (SELECT *, CASE WHEN fires THEN sum(CASE WHEN fires THEN 1 ELSE 0 END) OVER (PARTITION BY budget, sender, isl ORDER BY position) ELSE 0 END AS run FROM z)
SELECT budget, round(threshold, 6) AS threshold, count(CASE WHEN fires AND NOT attack THEN 1 END) AS false_alarms, round(count(CASE WHEN fires AND NOT attack THEN 1 END) / count(CASE WHEN NOT attack THEN 1 END)::DOUBLE, 9) AS fpr,
 round(count(CASE WHEN fires AND attack THEN 1 END) / count(CASE WHEN attack THEN 1 END)::DOUBLE, 9) AS recall, count(CASE WHEN run >= 3 AND NOT attack THEN 1 END) AS persist_false_alarms,
 round(count(CASE WHEN run >= 3 AND attack THEN 1 END) / count(CASE WHEN attack THEN 1 END)::DOUBLE, 9) AS persist_recall FROM ru GROUP BY 1, 2""")
def _m11(spark, d):
    from wiresift.operators.calibrate import calibration_table
    t = rnd(calibration_table(scores(spark, d).where("family = 'Flood'"), BUD), "threshold", digits=6)
    return rnd(t, "fpr", "recall", "persist_recall").select(
        "budget", "threshold", "false_alarms", "fpr", "recall", "persist_false_alarms", "persist_recall")


LAT = P + ", er AS (SELECT position, attack, split, score * 0.5 AS e1, score + k AS e2 FROM sc WHERE family = 'Flood')"


def errors(spark, d):
    return scores(spark, d).where("family = 'Flood'").select("position", "attack", "split", (F.col("score") * 0.5).alias("e1"), (F.col("score") + F.col("k")).alias("e2"))


@query("a19_anomaly_score", LAT + """, m AS (SELECT avg(e1) AS m1, stddev_pop(e1) AS s1, avg(e2) AS m2, stddev_pop(e2) AS s2 FROM er WHERE NOT attack AND split = 0)
SELECT position, round(((e1 - m1) / s1 + (e2 - m2) / s2) / 2, 6) + 0.0 AS anomaly_score FROM er CROSS JOIN m""")
def _a19(spark, d):
    a = me.anomaly_score(errors(spark, d), ["e1", "e2"], ~F.col("attack") & (F.col("split") == 0))
    return a.select("position", (F.round("anomaly_score", 6) + 0.0).alias("anomaly_score"))


@query("a20_reconstruction_quality", LAT + """, g AS (SELECT avg(e2) FILTER (NOT attack) AS b, avg(e2) FILTER (attack) AS a, var_samp(e2) FILTER (NOT attack) AS vb, var_samp(e2) FILTER (attack) AS va FROM er)
SELECT round(b, 6) AS benign_error, round(a, 6) AS attack_error, round(a / b, 6) AS ratio, round((a - b) / sqrt(0.5 * (vb + va)), 6) AS separation FROM g""")
def _a20(spark, d):
    return rnd(me.reconstruction_quality(errors(spark, d), "e2"), "benign_error", "attack_error", "ratio", "separation", digits=6)


CONF = TH + """, tt AS (SELECT family, threshold FROM th WHERE budget = 0.1)
, cf AS (SELECT family, population, threshold, count(CASE WHEN score >= threshold AND positive THEN 1 END) AS tp, count(CASE WHEN score >= threshold AND NOT positive THEN 1 END) AS fp, count(CASE WHEN score < threshold AND positive THEN 1 END) AS fn,
   count(CASE WHEN score < threshold AND NOT positive THEN 1 END) AS tn FROM sc JOIN tt USING (family) WHERE split = 2 AND (positive OR NOT attack) GROUP BY 1, 2, 3)
"""


def thresholds10(spark, d):
    return me.budget_threshold(scores(spark, d).where("calib"), ["family"], BUD).where("budget = 0.1").drop("budget")


@query("a22_confusion", CONF + """SELECT family, population, threshold, tp, fp, fn, tn, round(tp / (tp + fn)::DOUBLE, 9) AS recall, round(tp / (tp + fp)::DOUBLE, 9) AS precision, round(fp / (fp + tn)::DOUBLE, 9) AS fpr,
 round(2 * tp / (2 * tp + fp + fn)::DOUBLE, 9) AS f1, round((tp + fn) / (tp + fn + fp)::DOUBLE, 9) AS ideal_precision FROM cf""")
def _a22(spark, d):
    c = me.confusion(scores(spark, d).where("split = 2"), thresholds10(spark, d), ["family", "population"])
    return rnd(c, "recall", "precision", "fpr", "f1", "ideal_precision")


@query("a23_multiclass_matrix", CONF + """, o AS (SELECT sc.position, sc.label, sc.family, sc.score, row_number() OVER (PARTITION BY position ORDER BY score DESC, CASE sc.family WHEN 'Flood' THEN 0 ELSE 1 END) AS rn FROM sc JOIN tt USING (family) WHERE split = 2 AND score >= threshold)
, a AS (SELECT DISTINCT position, label FROM sc WHERE split = 2), n AS (SELECT a.label, COALESCE(o.family, 'none') AS named FROM a LEFT JOIN o ON o.position = a.position AND rn = 1)
SELECT label, count(CASE WHEN named = 'none' THEN 1 END) AS none, count(CASE WHEN named = 'Flood' THEN 1 END) AS "Flood", count(CASE WHEN named = 'Bot' THEN 1 END) AS "Bot" FROM n GROUP BY 1""")
def _a23(spark, d):
    return me.multiclass_matrix(scores(spark, d).where("split = 2"), thresholds10(spark, d), FAMILIES)


PROB = P + ", pr AS (SELECT family, positive, score / (score + 30) AS p FROM sc)"


def probabilities(spark, d):
    return scores(spark, d).select("position", "family", "positive", (F.col("score") / (F.col("score") + 30)).alias("p"))


@query("a24_calibration", PROB + """, b AS (SELECT family, greatest(ceil(p * 15) - 1, 0) AS bin, count(*) AS n, sum(p) AS sp, sum(CASE WHEN positive THEN 1 ELSE 0 END) AS sy, sum((p - CASE WHEN positive THEN 1 ELSE 0 END) ** 2) AS sb FROM pr GROUP BY 1, 2)
SELECT family, round(sum(sb) / sum(n), 9) AS brier, round(sum(abs(sp - sy)) / sum(n), 9) AS ece FROM b GROUP BY 1""")
def _a24(spark, d):
    return rnd(me.calibration(probabilities(spark, d), ["family"], "p", F.col("positive")), "brier", "ece")


@query("a24_calibration_floor_bins", PROB + """, b AS (SELECT family, least(floor(p * 10), 9) AS bin, count(*) AS n, sum(p) AS sp, sum(CASE WHEN positive THEN 1 ELSE 0 END) AS sy, sum((p - CASE WHEN positive THEN 1 ELSE 0 END) ** 2) AS sb FROM pr GROUP BY 1, 2)
SELECT family, round(sum(sb) / sum(n), 9) AS brier, round(sum(abs(sp - sy)) / sum(n), 9) AS ece FROM b GROUP BY 1""")
def _a24f(spark, d):
    return rnd(me.calibration(probabilities(spark, d), ["family"], "p", F.col("positive"), 10, False), "brier", "ece")


@query("a24_reliability_table", PROB + """SELECT family, CASE WHEN p >= 0.7 THEN 5 WHEN p >= 0.4 THEN 4 WHEN p >= 0.2 THEN 3 WHEN p >= 0.1 THEN 2 WHEN p >= 0.05 THEN 1 ELSE 0 END AS bin, count(*) AS n, round(avg(CASE WHEN positive THEN 1.0 ELSE 0.0 END), 9) AS hit_share FROM pr GROUP BY 1, 2""")
def _a24r(spark, d):
    return rnd(me.reliability_table(probabilities(spark, d), ["family"], "p", F.col("positive")), "hit_share")


DRIFT = "WITH " + fx.PACKETS_CTE + ", tr AS (SELECT * FROM packets WHERE family = 'Benign' AND (frame_no // 200) % 5 < 2), lv AS (SELECT * FROM packets WHERE (frame_no // 200) % 5 > 2) "
DCOLS = ["length", "ttl", "tcp_window", "payload_len"]


@query("a27_drift_report", DRIFT + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, round(((SELECT avg(ln(1 + {c})) FROM lv) - (SELECT avg(ln(1 + {c})) FROM tr)) / (SELECT stddev_pop(ln(1 + {c})) FROM tr), 6) AS mean_shift_training_sd, "
    f"round((SELECT stddev_pop(ln(1 + {c})) FROM lv) / (SELECT stddev_pop(ln(1 + {c})) FROM tr), 6) AS live_to_training_sd, round((SELECT avg(ln(1 + {c})) FROM lv), 6) AS live_mean, round((SELECT avg(ln(1 + {c})) FROM tr), 6) AS training_mean" for c in DCOLS))
def _a27(spark, d):
    p = fx.packets(spark, d).withColumn("_b", F.floor(F.col("frame_no") / 200) % 5)
    training = ft.moments(p, DCOLS, (F.col("family") == "Benign") & (F.col("_b") < 2))
    return rnd(me.drift_report(p.where("_b > 2"), training, DCOLS), "mean_shift_training_sd", "live_to_training_sd", "live_mean", "training_mean", digits=6)


@query("a27_reversed_histogram", f"SELECT v AS reversed, count(r.reversed) AS flows FROM (VALUES (-1.0::DOUBLE), (0.0::DOUBLE), (1.0::DOUBLE)) t(v) LEFT JOIN ({ORACLES['p10_is_reversed']}) r ON r.reversed = v GROUP BY 1")
def _a27h(spark, d):
    return me.reversed_histogram(QUERIES["p10_is_reversed"](spark, d))


@query("m15_pairwise_accuracy", P + "SELECT round(avg(CASE WHEN score > k * 2 THEN 1.0::DOUBLE ELSE 0.0 END), 9) AS pairwise, count(*) AS pairs FROM sc")
def _m15w(spark, d):
    from wiresift.operators import forecast as fo
    return rnd(fo.pairwise_accuracy(scores(spark, d).select(F.col("score").alias("positive"), (F.col("k") * 2).alias("negative"))), "pairwise", digits=9)


@query("a29_latency_summary", P + f""", l AS (SELECT t_us + (k - 5) * 10000 AS wall, t_us AS obs, t_us - k * 3000 + 20000 AS first FROM sc WHERE family = 'Flood'), r AS (SELECT * FROM l WHERE wall >= {NOW} - 60000000)
, x AS (SELECT 'after_t_obs' AS stage, greatest((wall - obs) / 1000000.0::DOUBLE, 0) AS s, 0 AS fut FROM r UNION ALL SELECT 'from_first_packet', greatest((wall - first) / 1000000.0::DOUBLE, 0), CASE WHEN first > wall THEN 1 ELSE 0 END FROM r)
SELECT stage, count(*) AS samples, sum(fut)::BIGINT AS future_events, round(quantile_cont(s, 0.5), 6) AS p50, round(quantile_cont(s, 0.9), 6) AS p90, round(quantile_cont(s, 0.99), 6) AS p99 FROM x GROUP BY 1""")
def _a29(spark, d):
    s = scores(spark, d).where("family = 'Flood'").select((F.col("t_us") + (F.col("k") - 5) * 10000).alias("wall_us"), F.col("t_us").alias("observed_us"), (F.col("t_us") - F.col("k") * 3000 + 20000).alias("first_us"))
    return rnd(me.latency_summary(s, NOW), "p50", "p90", "p99", digits=6)


def _poisson_cuts(n: int = 18) -> list[float]:
    """Values of the Poisson(1) distribution function, summed as the operator sums them."""
    p = total = 0.36787944117144233
    out = [total]
    for k in range(1, n):
        p /= k
        total += p
        out.append(total)
    return out


@query("a30_bootstrap_ci", P + f""", s AS (SELECT position, CASE WHEN score >= {CUT} THEN 1 ELSE 0 END AS m FROM sc WHERE family = 'Flood' AND positive)
, u AS (SELECT r, m, (((((position * 2654435761 + (r * 1000003 + 3) * 40503) % 4294967296) * 69069 + 1) % 4294967296) + 0.5::DOUBLE) / 4294967296.0::DOUBLE AS u FROM s CROSS JOIN range(50) g(r))
, w AS (SELECT r, m, len(list_filter({_poisson_cuts()!r}::DOUBLE[], lambda c: u >= c)) AS w FROM u), v AS (SELECT sum(w * m)::DOUBLE / sum(w)::DOUBLE AS v FROM w GROUP BY r)
SELECT round(quantile_cont(v, 0.025), 9) AS low, round(quantile_cont(v, 0.975), 9) AS high FROM v""")
def _a30(spark, d):
    s = scores(spark, d).where("family = 'Flood' AND positive")
    return rnd(me.bootstrap_ci(s, "position", (F.col("score") >= CUT).cast("double"), samples=50, seed=3), "low", "high")


@query("a30_bootstrap_ranking_ci", P + f""", s AS (SELECT position, family, score, positive FROM sc WHERE positive OR NOT attack)
, u AS (SELECT family, score, positive, r, (((((position * 2654435761 + (r * 1000003 + 5) * 40503) % 4294967296) * 69069 + 1) % 4294967296) + 0.5::DOUBLE) / 4294967296.0::DOUBLE AS u FROM s CROSS JOIN range(20) g(r))
, w AS (SELECT family, score, positive, r, len(list_filter({_poisson_cuts()!r}::DOUBLE[], lambda c: u >= c)) AS w FROM u)
, b AS (SELECT family, r, score, COALESCE(sum(w) FILTER (positive), 0) AS pos, COALESCE(sum(w) FILTER (NOT positive), 0) AS neg FROM w WHERE w > 0 GROUP BY 1, 2, 3)
, c AS (SELECT *, COALESCE(sum(neg) OVER (PARTITION BY family, r ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below, sum(pos) OVER (PARTITION BY family, r ORDER BY score DESC) AS tp, sum(pos + neg) OVER (PARTITION BY family, r ORDER BY score DESC) AS seen,
   sum(pos) OVER (PARTITION BY family, r) AS total_pos FROM b)
, v AS (SELECT family, 'auroc' AS metric, sum(pos * (below + neg / 2.0::DOUBLE)) / (sum(pos)::DOUBLE * sum(neg)::DOUBLE) AS v FROM c GROUP BY family, r UNION ALL SELECT family, 'pr_auc', sum(pos / total_pos::DOUBLE * (tp / seen::DOUBLE)) FROM c GROUP BY family, r)
SELECT family, metric, round(quantile_cont(v, 0.025), 9) AS low, round(quantile_cont(v, 0.975), 9) AS high FROM v GROUP BY 1, 2""")
def _a30r(spark, d):
    return rnd(me.bootstrap_ranking_ci(scores(spark, d).where("positive OR NOT attack"), "position", ["family"], samples=20, seed=5), "low", "high")


VALUE = P + ", v AS (SELECT position, t_us, sender % 8 AS sender, receiver % 4 AS receiver, -score AS value, src_ip, dst_ip, k FROM sc WHERE family = 'Flood')"


def valued(spark, d):
    return scores(spark, d).where("family = 'Flood'").select("position", "t_us", (F.col("sender") % 8).alias("sender"), (F.col("receiver") % 4).alias("receiver"), (-F.col("score")).alias("value"), "src_ip", "dst_ip", "k")


@query("w19_link_incidents", VALUE + """
, a AS (SELECT *, -value >= 16 AS x, sum(CASE WHEN -value >= 16 THEN 0 ELSE 1 END) OVER (PARTITION BY sender, receiver ORDER BY position) AS rs FROM v)
, b AS (SELECT *, lag(t_us) OVER w AS pt, lag(rs) OVER w AS pr FROM a WHERE x WINDOW w AS (PARTITION BY sender, receiver ORDER BY position))
, c AS (SELECT *, sum(CASE WHEN pt IS NULL OR pr <> rs OR t_us > pt + 9000000 THEN 1 ELSE 0 END) OVER (PARTITION BY sender, receiver ORDER BY position) AS isl FROM b)
, e AS (SELECT *, row_number() OVER (PARTITION BY sender, receiver, isl ORDER BY position) AS run FROM c)
, h AS (SELECT *, lag(t_us) OVER (PARTITION BY sender, receiver ORDER BY position) AS ps FROM e WHERE run >= 3)
, n AS (SELECT *, sum(CASE WHEN ps IS NULL OR t_us > ps + 9000000 THEN 1 ELSE 0 END) OVER (PARTITION BY sender, receiver ORDER BY position) AS nth FROM h)
, i AS (SELECT sender, receiver, nth, min(t_us) AS opened_us, max(t_us) AS last_seen_us, arg_min(value, position) AS opening_value, sum(CASE WHEN run = 3 THEN 3 ELSE 1 END)::BIGINT AS events, CASE WHEN max(-value) >= 60 THEN 'HIGH' ELSE 'MEDIUM' END AS severity FROM n GROUP BY 1, 2, 3)
SELECT sender, receiver, opened_us, last_seen_us, opening_value, events, severity FROM i WHERE last_seen_us + 9000000 >= (SELECT max(t_us) FROM v) ORDER BY opened_us DESC, sender DESC, receiver DESC LIMIT 30""")
def _w19(spark, d):
    return inc.link_incidents(valued(spark, d), -1, 16.0, 60.0, gap_s=9.0, keep=30)


@query("w20_alert_groups", VALUE + """
, f AS (SELECT *, CASE WHEN -value >= 60 THEN 'HIGH' ELSE 'MEDIUM' END AS sev, k % 5 = 0 AS inci, lag(t_us) OVER (PARTITION BY sender, receiver ORDER BY position) AS pt FROM v WHERE -value >= 30)
, g AS (SELECT *, sum(CASE WHEN pt IS NULL OR t_us > pt + 9000000 THEN 1 ELSE 0 END) OVER (PARTITION BY sender, receiver ORDER BY position) AS burst FROM f)
SELECT sender, receiver, burst::BIGINT AS burst, min(t_us) AS opened_us, max(t_us) AS last_seen_us, arg_min(value, position) AS opening_value, count(*) AS events, CASE WHEN max(-value) >= 60 THEN 'HIGH' ELSE 'MEDIUM' END AS severity, bool_or(inci) AS incident FROM g GROUP BY 1, 2, 3""")
def _w20(spark, d):
    f = valued(spark, d).where("-value >= 30").withColumns({"severity": F.when(-F.col("value") >= 60, "HIGH").otherwise("MEDIUM"), "incident": F.col("k") % 5 == 0})
    return inc.alert_groups(f, 9.0)


@query("a32_link_summary", VALUE + "SELECT sender, receiver, count(*) AS events, min(value) AS value, CASE WHEN -min(value) >= 100 THEN 'HIGH' WHEN -min(value) >= 60 THEN 'MEDIUM' ELSE '' END AS severity FROM v GROUP BY 1, 2")
def _a32(spark, d):
    return inc.link_summary(valued(spark, d), -1, 100.0, 60.0)


@query("a33_forecast_steps", VALUE + "SELECT k % 10 AS step, count(*) AS links, round(avg(CASE WHEN -value >= 40 THEN 1.0 ELSE 0.0 END), 6) AS alert_share, min(value) AS step_value FROM v GROUP BY 1")
def _a33(spark, d):
    return inc.forecast_steps(valued(spark, d).withColumn("step", F.col("k") % 10), -1, 80.0, 40.0)


@query("a33_first_crossing", VALUE + """, r AS (SELECT sender, receiver, k % 10 AS crosses_at_step, value, CASE WHEN -value >= 80 THEN 'HIGH' ELSE 'MEDIUM' END AS severity, row_number() OVER (PARTITION BY sender, receiver ORDER BY k % 10, position) AS rn FROM v WHERE -value >= 40)
SELECT sender, receiver, crosses_at_step, value, severity FROM r WHERE rn = 1""")
def _a33f(spark, d):
    return inc.forecast_first_crossing(valued(spark, d).withColumns({"step": F.col("k") % 10, "row_id": F.col("position")}), -1, 80.0, 40.0)


@query("a31_attention_topk", P + """, a AS (SELECT position // 20 AS event_id, sender AS source_node, receiver % 5 AS query_node, score / 10 AS weight FROM sc), s AS (SELECT event_id, source_node, query_node, sum(weight) AS weight FROM a GROUP BY 1, 2, 3)
, r AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY round(weight, 9) DESC, source_node, query_node) AS rank FROM s) SELECT event_id, source_node, query_node, round(weight, 6) AS weight, rank::INT AS rank FROM r WHERE rank <= 8""")
def _a31(spark, d):
    a = scores(spark, d).select(F.floor(F.col("position") / 20).alias("event_id"), F.col("sender").alias("source_node"), (F.col("receiver") % 5).alias("query_node"), (F.col("score") / 10).alias("weight"))
    return inc.attention_topk(a)


@query("a34_packet_counters", "WITH " + fx.PACKETS_CTE + """, p AS (SELECT frame_no, us - CASE WHEN frame_no % 37 = 0 THEN 5000000 ELSE 0 END AS us, CASE WHEN k % 9 = 0 THEN 'fe80::1' ELSE src_ip END AS src_ip, protocol FROM packets), l AS (SELECT *, lag(us) OVER (ORDER BY frame_no) AS pu FROM p)
SELECT count(*) AS total_ip_packets, count(CASE WHEN src_ip LIKE '%:%' THEN 1 END) AS ipv6_packets_excluded, count(CASE WHEN src_ip NOT LIKE '%:%' AND protocol NOT IN (6, 17) THEN 1 END) AS other_ipv4_protocol_packets_excluded,
 count(CASE WHEN src_ip NOT LIKE '%:%' AND protocol IN (6, 17) THEN 1 END) AS packets, count(CASE WHEN us < pu THEN 1 END) AS packet_timestamp_reversals FROM l""")
def _a34p(spark, d):
    p = fx.packets(spark, d).withColumns({"us": F.col("us") - F.when(F.col("frame_no") % 37 == 0, 5000000).otherwise(0), "src_ip": F.when(F.col("k") % 9 == 0, "fe80::1").otherwise(F.col("src_ip"))})
    return inc.packet_counters(p)


@query("a34_service_counters", RUNS + f""", s AS (SELECT family, count(CASE WHEN score >= {CUT} THEN 1 END) AS detections, count(CASE WHEN packets_seen = 1 THEN 1 END) AS scored_with_one_packet, round(count(CASE WHEN t_us >= {NOW} - 30000000 THEN 1 END) / 30.0::DOUBLE, 3) AS events_per_second FROM sc GROUP BY 1)
, i AS (SELECT family, count(*) AS opened, count(DISTINCT CASE WHEN last_alert_us + 40000000 >= {NOW} THEN sender END) AS active FROM inc GROUP BY 1) SELECT s.*, COALESCE(opened, 0) AS opened, COALESCE(active, 0) AS active FROM s LEFT JOIN i USING (family)""")
def _a34(spark, d):
    return inc.service_counters(scores(spark, d).withColumn("threshold", F.lit(CUT)), opened(spark, d), NOW, 40.0)


@query("a35_rate_per_cycle", P + f""", k AS (SELECT DISTINCT src_ip, dst_port FROM sc WHERE t_us BETWEEN {NOW} - 300000000 AND {NOW} - 10000001), f AS (SELECT DISTINCT src_ip, dst_port FROM sc WHERE t_us > {NOW} - 10000000 EXCEPT SELECT * FROM k)
SELECT count(*) AS fresh, count(*) / 10.0::DOUBLE AS rate FROM f""")
def _a35(spark, d):
    s = scores(spark, d)
    known = s.where(F.col("t_us") < NOW - 10_000_000).withColumn("seen_us", F.col("t_us"))
    return inc.rate_per_cycle(s.where(F.col("t_us") > NOW - 10_000_000), known, ["src_ip", "dst_port"], 10.0, NOW, 300.0)


PATHS = P + """, r AS (SELECT position, score AS a, sender::VARCHAR AS s FROM sc WHERE family = 'Flood'), c AS (SELECT position, CASE WHEN position % 50 = 0 THEN score * 1.00002 ELSE score * 1.000001 END AS a, CASE WHEN position % 400 = 7 THEN 'x' ELSE sender::VARCHAR END AS s
   FROM sc WHERE family = 'Flood' AND position % 10 <> 3)
, j AS (SELECT r.a AS ra, c.a AS ca, r.s AS rs, c.s AS cs FROM r JOIN c USING (position))"""


@query("j14_compare_paths", PATHS + """, x AS (SELECT 0 AS stage_order, 'flows' AS stage, 0.0::DOUBLE AS worst, 0::BIGINT AS out_of_tolerance UNION ALL
  SELECT 1, 'value', round(max(abs(ra - ca)), 6), sum(CASE WHEN abs(ra - ca) > 1e-6 + 1e-5 * abs(ra) THEN 1 ELSE 0 END)::BIGINT FROM j UNION ALL SELECT 2, 'side', CASE WHEN bool_or(rs <> cs) THEN 'inf'::DOUBLE ELSE 0 END, sum(CASE WHEN rs <> cs THEN 1 ELSE 0 END)::BIGINT FROM j)
SELECT stage_order, stage, worst, out_of_tolerance, out_of_tolerance = 0 AS passed, stage_order = (SELECT min(stage_order) FROM x WHERE out_of_tolerance > 0) AS first_failing FROM x""")
def _j14(spark, d):
    s = scores(spark, d).where("family = 'Flood'")
    ref = s.select("position", F.col("score").alias("a"), F.col("sender").cast("string").alias("s"))
    cand = s.where("position % 10 <> 3").select("position", F.when(F.col("position") % 50 == 0, F.col("score") * 1.00002).otherwise(F.col("score") * 1.000001).alias("a"),
                                                F.when(F.col("position") % 400 == 7, "x").otherwise(F.col("sender").cast("string")).alias("s"))
    r = me.compare_paths(ref, cand, [("value", ["a"], "float"), ("side", ["s"], "exact")], "position")
    return r.withColumn("worst", F.round("worst", 6))


@query("u05_multiset_difference", P + ", a AS (SELECT src_ip, dst_port, count(*) AS n FROM sc WHERE positive GROUP BY 1, 2), b AS (SELECT src_ip, dst_port, count(*) AS n FROM sc WHERE positive AND position % 97 <> 0 GROUP BY 1, 2) "
       "SELECT src_ip, dst_port, COALESCE(a.n, 0) AS in_a, COALESCE(b.n, 0) AS in_b FROM a FULL OUTER JOIN b USING (src_ip, dst_port) WHERE COALESCE(a.n, 0) <> COALESCE(b.n, 0)")
def _u05(spark, d):
    s = scores(spark, d).where("positive")
    return me.multiset_difference(s, s.where("position % 97 <> 0"), ["src_ip", "dst_port"])


# --- incident evidence and service rules ----------------------------------------------------------------------------------

# Linked events: twelve per incident over two neighbouring clients; a third of the incidents are single-peer internal SMB.
LINKED = "WITH " + fx.PACKETS_CTE + """
, lk0 AS (SELECT *, CASE WHEN (frame_no // 12) % 7 = 3 AND frame_no % 12 >= 2 THEN 7 * (1000000 + frame_no) + 3 ELSE frame_no // 12 END AS incident, (frame_no // 12) % 7 AS shape FROM packets)
, lk AS (SELECT incident, frame_no AS event_id, us AS t_us, CASE shape WHEN 6 THEN 'DoS-Hulk' WHEN 5 THEN 'Bot' ELSE 'Infiltration' END AS family,
   CASE WHEN shape IN (0, 1, 4) THEN '10.0.1.1' ELSE src_ip END AS src, CASE WHEN shape IN (0, 1, 4) THEN '10.0.2.2' WHEN shape = 6 THEN '10.0.0.9' ELSE dst_ip END AS dst,
   CASE WHEN shape = 6 THEN 443 ELSE src_port END AS src_port, CASE WHEN shape IN (0, 1, 4) THEN 445 WHEN shape = 6 THEN 50000 ELSE dst_port END AS dst_port, CASE WHEN shape IN (0, 1, 4, 6) THEN 6 ELSE protocol END AS protocol,
   shape <> 1 OR k % 4 > 0 AS established_connection, true AS normal_dns_query, CASE WHEN shape = 4 AND k % 8 = 0 THEN 400 ELSE 3 END AS pps, shape FROM lk0)
"""


def linked(spark, d):
    p = fx.packets(spark, d).withColumn("shape", (F.floor(F.col("frame_no") / 12) % 7).cast("int"))
    # small incidents: two events of a dozen in one, the others alone
    alone = (F.col("shape") == 3) & (F.col("frame_no") % 12 >= 2)
    p = p.withColumn("incident", F.when(alone, 7 * (1_000_000 + F.col("frame_no")) + 3).otherwise(F.floor(F.col("frame_no") / 12)).cast("bigint"))
    one = F.col("shape").isin(0, 1, 4)
    web = F.col("shape") == 6
    return p.select(
        "incident", F.col("frame_no").alias("event_id"), F.col("us").alias("t_us"), F.when(web, "DoS-Hulk").when(F.col("shape") == 5, "Bot").otherwise("Infiltration").alias("family"),
        F.when(one, "10.0.1.1").otherwise(F.col("src_ip")).alias("src"), F.when(one, "10.0.2.2").when(web, "10.0.0.9").otherwise(F.col("dst_ip")).alias("dst"),
        F.when(web, 443).otherwise(F.col("src_port")).alias("src_port"), F.when(one, 445).when(web, 50000).otherwise(F.col("dst_port")).alias("dst_port"), F.when(one | web, 6).otherwise(F.col("protocol")).alias("protocol"),
        ((F.col("shape") != 1) | (F.col("k") % 4 > 0)).alias("established_connection"), F.lit(True).alias("normal_dns_query"), F.lit(False).alias("normal_gvcp_discovery"),
        F.when((F.col("shape") == 4) & (F.col("k") % 8 == 0), 400).otherwise(3).alias("source_packets_per_second"), F.lit(1).alias("service_evidence_version"), "k")


def _judge_sql(key, minimum, src="lk"):
    from wiresift.catalog.a_scalars import REGISTRY_SQL
    return f""", {REGISTRY_SQL}
, tg AS (SELECT x.*, dr.tag AS dtag, dr.backend AS dback, sr.tag AS stag, src LIKE '10.%' AND dst LIKE '10.%' AS internal FROM {src} x LEFT JOIN registry dr ON dr.transport = CASE x.protocol WHEN 6 THEN 'TCP' WHEN 17 THEN 'UDP' END AND dr.port = x.dst_port
   LEFT JOIN registry sr ON sr.transport = CASE x.protocol WHEN 6 THEN 'TCP' WHEN 17 THEN 'UDP' END AND sr.port = x.src_port)
, tc AS (SELECT *, COALESCE(dtag, stag, CASE WHEN src_port >= 49152 THEN 'EPHEMERAL_CLIENT_PORT' ELSE 'UNKNOWN' END) AS tag, CASE WHEN dtag IS NOT NULL THEN CASE WHEN internal AND dback THEN 'INTERNAL_SERVICE' ELSE 'NORMAL_SERVICE' END
   WHEN stag IS NOT NULL THEN CASE WHEN established_connection THEN 'RESPONSE_TRAFFIC' ELSE 'UNKNOWN' END WHEN src_port >= 49152 THEN 'EPHEMERAL_CLIENT' ELSE 'UNKNOWN' END AS class,
   (dtag IS NOT NULL OR stag IS NOT NULL) AND internal AS is_int, family = 'DoS-Hulk' AS web FROM tg)
, rs AS (SELECT *, class = 'RESPONSE_TRAFFIC' AND tag = 'HTTPS' AND web AND dst_port >= 49152 AS resp, CASE WHEN class = 'RESPONSE_TRAFFIC' THEN src ELSE dst END AS server, CASE WHEN class = 'RESPONSE_TRAFFIC' THEN dst ELSE src END AS client,
   CASE WHEN class = 'RESPONSE_TRAFFIC' THEN src_port ELSE dst_port END AS port FROM tc)
, fl AS (SELECT *, class IN ('NORMAL_SERVICE', 'INTERNAL_SERVICE', 'RESPONSE_TRAFFIC') AND (resp OR NOT ((web AND tag IN ('HTTP', 'HTTPS')) OR (protocol = 6 AND NOT established_connection) OR (protocol = 17 AND tag NOT IN ('DNS', 'GVCP')))) AS role_ok FROM rs)
, jg AS (SELECT {key}, min(family) AS family, count(*) AS events, bool_or(pps > 250) AS burst, bool_and(role_ok) AS role_ok, bool_and(is_int OR resp) AS inside, count(DISTINCT tag || server || client || port || protocol) = 1 AS one, count(DISTINCT server) AS peers, count(DISTINCT port) AS ports,
   max(t_us) - min(t_us) AS span, arg_min(class, event_id) AS class, arg_min(tag, event_id) AS protocol_tag FROM fl GROUP BY 1)
, jd AS (SELECT *, CASE WHEN family NOT IN ('Infiltration', 'DoS-Hulk') THEN 'none' WHEN events < {minimum} THEN 'few' WHEN burst THEN 'burst' WHEN peers >= 8 OR ports >= 8 THEN 'fanout' WHEN events > 20 AND span < 1000000 THEN 'dense'
   WHEN NOT role_ok THEN 'role' WHEN NOT inside THEN 'external' WHEN NOT one THEN 'mixed' ELSE 'routine' END AS code FROM jg)
, dec AS (SELECT {key}, family, events, protocol_tag, CASE code WHEN 'routine' THEN 'SUPPRESSED' ELSE 'RETAINED' END AS final_decision, CASE WHEN code IN ('burst', 'fanout', 'dense') THEN 'SUSPICIOUS' WHEN code = 'routine' THEN class ELSE 'UNKNOWN' END AS rule_classification,
   CASE code """ + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in inc.REASON.items()) + " END AS rule_reason FROM jd)"


@query("r15_suppress_routine", LINKED + _judge_sql("incident", 3) + " SELECT * FROM dec")
def _r15(spark, d):
    return inc.judge_service(inc.tag_events(linked(spark, d)), "incident")


@query("r17_offline_visible", LINKED + _judge_sql("incident", 3) + " SELECT incident, count(*) AS events, d.final_decision FROM lk JOIN dec d USING (incident) WHERE d.final_decision <> 'SUPPRESSED' GROUP BY 1, 3")
def _r17v(spark, d):
    return _r17(spark, d)[0]


@query("r17_offline_suppressed", LINKED + _judge_sql("incident", 3) + " SELECT incident, count(*) AS events, d.final_decision FROM lk JOIN dec d USING (incident) WHERE d.final_decision = 'SUPPRESSED' GROUP BY 1, 3")
def _r17s(spark, d):
    return _r17(spark, d)[1]


def _r17(spark, d):
    l = linked(spark, d)
    incidents = l.groupBy("incident").agg(F.count(F.lit(1)).alias("events"))
    return [x.select("incident", "events", "final_decision") for x in inc.partition_by_decision(incidents, inc.judge_service(inc.tag_events(l), "incident"))]


R16 = LINKED + """
, fg AS (SELECT CASE WHEN src < dst THEN src || '|' || dst ELSE dst || '|' || src END AS link, event_id, t_us, 'Infiltration' AS family, src, dst, src_port, dst_port, protocol, established_connection, pps FROM lk WHERE shape NOT IN (5, 6))
""" + _judge_sql("link", 1, "fg")


@query("r16_routine_links", R16 + " SELECT link, protocol_tag, rule_classification, events FROM dec WHERE final_decision = 'SUPPRESSED'")
def _r16(spark, d):
    f = linked(spark, d).where("family = 'Infiltration'").withColumns({"sender_ip": F.col("src"), "receiver_ip": F.col("dst")})
    return inc.routine_links(f)


@query("r16_suppress_links", R16 + " SELECT count(CASE WHEN d.link IS NULL THEN 1 END) AS kept, count(d.link) AS set_aside FROM fg LEFT JOIN (SELECT link FROM dec WHERE final_decision = 'SUPPRESSED') d ON d.link = fg.link")
def _r16s(spark, d):
    f = linked(spark, d).where("family = 'Infiltration'").withColumns({"sender_ip": F.col("src"), "receiver_ip": F.col("dst")})
    kept, aside = inc.suppress_links(f, inc.routine_links(f))
    both = kept.select(F.lit(1).alias("k")).unionByName(aside.select(F.lit(0).alias("k")))
    return both.agg(F.count(F.when(F.col("k") == 1, 1)).alias("kept"), F.count(F.when(F.col("k") == 0, 1)).alias("set_aside"))


@query("a25_incident_summary", LINKED + """, l2 AS (SELECT incident // 20 AS incident, src AS sender_ip, src, dst, src_port % 9 AS src_port, dst_port FROM lk), t AS (SELECT incident, count(*) AS total FROM l2 GROUP BY 1)
, p AS (SELECT incident, src_port, count(*) AS n, row_number() OVER (PARTITION BY incident ORDER BY count(*) DESC, src_port) AS rn FROM l2 GROUP BY 1, 2)
, g AS (SELECT incident, sender_ip, src, dst, count(*) AS events, count(DISTINCT dst_port) AS dst_ports FROM l2 GROUP BY 1, 2, 3, 4), r AS (SELECT *, row_number() OVER (PARTITION BY incident ORDER BY events DESC, sender_ip, src, dst) AS rank FROM g)
SELECT r.incident, total, p.src_port AS top_src_port, p.n AS top_src_port_events, rank::INT AS rank, sender_ip, src, dst, events, dst_ports FROM r JOIN t USING (incident) JOIN p ON p.incident = r.incident AND p.rn = 1 WHERE rank <= 16""")
def _a25(spark, d):
    l = linked(spark, d).select(F.floor(F.col("incident") / 20).alias("incident"), F.col("src").alias("sender_ip"), "src", "dst", (F.col("src_port") % 9).alias("src_port"), "dst_port")
    return inc.incident_groups(l)


@query("a25_incident_events", LINKED + """, l2 AS (SELECT CASE WHEN shape = 0 THEN 0 ELSE 1 + incident % 40 END AS incident, event_id FROM lk), t AS (SELECT incident, count(*) AS total FROM l2 GROUP BY 1)
, r AS (SELECT l2.*, total, row_number() OVER (PARTITION BY incident ORDER BY event_id) AS rn FROM l2 JOIN t USING (incident)) SELECT incident, event_id, total, total > 300 AS truncated FROM r WHERE total <= 300 OR rn <= 100""")
def _a25e(spark, d):
    i = F.when(F.col("incident") % 7 == 0, 0).otherwise(1 + F.col("incident") % 40)
    return inc.incident_events(linked(spark, d).select(i.alias("incident"), "event_id"), 300, 100).select("incident", "event_id", "total", "truncated")


SRC = LINKED + """
, x AS (SELECT incident, event_id, CASE WHEN shape IN (0, 1, 4) THEN '10.0.1.1' WHEN shape = 6 THEN '10.0.0.9' WHEN shape = 5 THEN '192.0.2.7' ELSE src END AS sender_ip, CASE WHEN shape = 5 THEN '192.0.2.7' WHEN shape = 6 THEN '10.0.2.2' ELSE src END AS src,
   CASE WHEN shape = 5 THEN '10.0.2.2' ELSE dst END AS dst, src_port, CASE WHEN shape = 6 THEN event_id::INT % 5 + 50000 ELSE dst_port END AS dst_port FROM lk)
, ld AS (SELECT incident, arg_min(sender_ip, event_id) AS lead FROM x GROUP BY 1)
, y AS (SELECT x.*, lead, dst = sender_ip AND src IN ('10.0.2.2', '10.0.0.3') AS reply, CASE WHEN sender_ip = '' OR sender_ip <> lead THEN 1 WHEN src <> '' AND src <> sender_ip AND NOT (dst = sender_ip AND src IN ('10.0.2.2', '10.0.0.3')) THEN 2 END AS stop FROM x JOIN ld USING (incident))
, pp AS (SELECT incident, src_port AS v, count(*) AS n, row_number() OVER (PARTITION BY incident ORDER BY count(*) DESC, src_port DESC) AS rn FROM x GROUP BY 1, 2)
, pe AS (SELECT incident, dst AS v, count(*) AS n, row_number() OVER (PARTITION BY incident ORDER BY count(*) DESC, dst DESC) AS rn FROM x GROUP BY 1, 2)
, g AS (SELECT y.incident, count(*) AS events, min(lead) AS ip, arg_min(stop, event_id) FILTER (stop IS NOT NULL) AS stop, bool_or(reply OR dst IN ('10.0.2.2', '10.0.0.3')) AS ld, bool_or(sender_ip IN ('10.0.2.2', '10.0.0.3')) AS il, count(DISTINCT dst_port) AS ports FROM y GROUP BY 1)
, h AS (SELECT g.*, il AND ports >= 3 AND pp.n * 10 >= events * 9 AND pe.n * 10 >= events * 9 AND pp.v <> 0 AND pe.v <> '' AS served, pp.v AS pv, pe.v AS ev FROM g JOIN pp ON pp.incident = g.incident AND pp.rn = 1 JOIN pe ON pe.incident = g.incident AND pe.rn = 1)
, i AS (SELECT *, CASE WHEN served THEN ev ELSE ip END AS source FROM h)
, r AS (SELECT incident, events, CASE WHEN stop = 1 THEN '' ELSE source END AS source_ip, CASE WHEN served THEN pv ELSE 0 END AS served_port, CASE WHEN stop = 1 THEN 'Linked events do not agree on one source IP.' WHEN stop = 2 THEN 'Linked traffic does not consistently originate from the sender IP.'
   WHEN events < 3 THEN 'At least three linked threshold-crossing events are required for a host block.' WHEN NOT (served OR ld) THEN 'No linked event targets this host; an inbound host block would not contain the observed traffic.'
   WHEN source LIKE '192.0.2.%' THEN 'Source is not a validated public or private IPv4 address; automatic blocking is disabled.' WHEN source IN ('10.0.2.2', '10.0.0.3') THEN 'Source IP belongs to this host; automatic blocking is disabled.' ELSE '' END AS reason FROM i)
SELECT *, reason = '' AS eligible FROM r"""


@query("a26_incident_source_evidence", SRC)
def _a26(spark, d):
    l = linked(spark, d).withColumn("shape", (F.col("incident") % 7).cast("int"))
    one, web, ext = F.col("shape").isin(0, 1, 4), F.col("shape") == 6, F.col("shape") == 5
    x = l.select("incident", "event_id", F.when(one, "10.0.1.1").when(web, "10.0.0.9").when(ext, "192.0.2.7").otherwise(F.col("src")).alias("sender_ip"),
                 F.when(ext, "192.0.2.7").when(web, "10.0.2.2").otherwise(F.col("src")).alias("src"), F.when(ext, "10.0.2.2").otherwise(F.col("dst")).alias("dst"), "src_port",
                 F.when(web, (F.col("event_id") % 5 + 50000).cast("int")).otherwise(F.col("dst_port")).alias("dst_port"))
    return inc.source_evidence(x, spark.createDataFrame([("10.0.2.2",), ("10.0.0.3",)], "ip string"))
