"""The calibration table: a budget plus persistence, as it would be served."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wiresift.operators.incidents import persist_runs, incidents_from_alerts
from wiresift.operators.metrics import BUDGETS, quantiles


def calibration_table(scores: DataFrame, budgets: Sequence[float] = BUDGETS, hours: float = 1.0, persist: int = 3, gap_s: float = 120.0) -> DataFrame:
    """Per budget: threshold from the calibration rows (linear quantile) and its test cost, raw and after persistence on the sender.

    The test stream meets the budgets (a fixed short list) because every budget has its own run state.
    """
    q = quantiles(scores.where("calib"), [], "score", [1.0 - b for b in budgets])
    back = F.create_map(*[x for b in budgets for x in (F.lit(1.0 - b), F.lit(float(b)))])
    th = q.select(back[F.col("q")].alias("budget"), F.col("quantile").alias("threshold"))
    test = scores.where("split = 2").join(F.broadcast(th), F.lit(True))
    runs = persist_runs(test, ["budget", "sender"], n=persist)
    fires, attack, alert = F.col("score") >= F.col("threshold"), F.col("attack"), F.col("alert")
    t = runs.groupBy("budget", "threshold").agg(
        F.count(F.when(fires & ~attack, 1)).alias("false_alarms"), F.count(F.when(fires & attack, 1)).alias("_tp"), F.count(F.when(alert & ~attack, 1)).alias("persist_false_alarms"),
        F.count(F.when(alert & attack, 1)).alias("_ptp"), F.count(F.when(~attack, 1)).alias("test_benign"), F.count(F.when(attack, 1)).alias("test_attack"))
    opening = incidents_from_alerts(runs.where("alert").select("budget", "sender", "position", "t_us", "score", "attack"), ["budget", "sender"], gap_s)[0]
    false_inc = opening.where("opens AND NOT attack").groupBy("budget").agg(F.count(F.lit(1)).alias("false_incidents"))
    j = t.join(false_inc, "budget", "left").fillna(0, ["false_incidents"])
    neg, pos, h = F.greatest("test_benign", F.lit(1)), F.greatest("test_attack", F.lit(1)), max(hours, 1e-9)
    return j.select(
        "budget", "threshold", (F.col("false_alarms") / neg).alias("fpr"), (F.col("false_alarms") / neg / F.col("budget")).alias("overshoot_vs_budget"), (F.col("_tp") / pos).alias("recall"), "false_alarms",
        (F.col("false_alarms") / h).alias("false_alarms_per_hour"), (F.col("_ptp") / pos).alias("persist_recall"), "persist_false_alarms", (F.col("persist_false_alarms") / h).alias("persist_false_alarms_per_hour"),
        (F.col("false_incidents") / h).alias("false_incidents_per_hour"), "test_benign", "test_attack")
