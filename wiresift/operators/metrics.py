"""Thresholds, ranking metrics, confusion, calibration and drift on long-form score tables.

A score table has one row per (event, scored family): position, t_us, sender, family, score, positive, attack, split.
Everything order-related runs on distinct scores with counts, so ties are exact and no family is held in one task.
"""
from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wiresift.functions.scalars import portable_hash
from wiresift.plans.ordering import order_statistic, prefix_sums
from wiresift.session import pinned

# The false-alarm budgets of a sweep.
BUDGETS = (0.01, 0.003, 0.001, 3e-4, 1e-4, 6e-5, 3e-5, 2e-5, 1e-5, 3e-6)


def quantiles(df: DataFrame, groups: Sequence[str], value: str, points: dict[str, float] | Sequence[float], method: str = "linear") -> DataFrame:
    """Exact quantiles per group in long form (groups, `q`, `quantile`); `method` is higher, lower or linear."""
    qs = list(points.values()) if isinstance(points, dict) else list(points)
    groups = list(groups)
    keyed, keys = (df, groups) if groups else (df.withColumn("_all", F.lit(0)), ["_all"])
    n = keyed.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    want = n.withColumn("q", F.explode(F.array(*[F.lit(float(q)) for q in qs])))
    at = (F.col("_n") - 1) * F.col("q")
    lo, hi = F.floor(at).cast("bigint"), F.ceil(at).cast("bigint")
    ends = {"higher": [hi], "lower": [lo], "linear": [lo, hi]}[method]
    want = want.select(*keys, "q", (at - F.floor(at)).alias("_w"), F.explode(F.array_distinct(F.array(*ends))).alias("_at_rank"))
    got = order_statistic(keyed, keys, value, want, "_at_rank")
    low, high = F.min(value), F.max(value)
    mixed = low if method == "lower" else high if method == "higher" else low + (high - low) * F.max("_w")
    return got.groupBy(*keys, "q").agg(mixed.alias("quantile")).select(*groups, "q", "quantile")


def budget_threshold(calib: DataFrame, groups: Sequence[str], budgets: Sequence[float] = BUDGETS, score: str = "score", method: str = "higher") -> DataFrame:
    """Per group and budget the score at quantile 1 - budget of the calibration rows."""
    # The budget is carried as its place in the list, so that 1 - q need not give it back exactly.
    q = quantiles(calib, groups, score, [1.0 - b for b in budgets], method)
    back = F.create_map(*[x for b in budgets for x in (F.lit(1.0 - b), F.lit(float(b)))])
    return q.select(*groups, back[F.col("q")].alias("budget"), F.col("quantile").alias("threshold"))


def incident_count(alerts: DataFrame, keys: Sequence[str], groups: Sequence[str], gap_s: float, position: str = "position") -> DataFrame:
    """Incidents per group: alerts of a key more than `gap_s` apart start a new one."""
    from wiresift.plans.ordering import keyed_scan
    a = keyed_scan(alerts, list(dict.fromkeys([*groups, *keys])), position, lags={"_before": F.col("t_us")})
    opens = F.col("_before").isNull() | (F.col("t_us") - F.col("_before") > int(gap_s * 1e6))
    return a.groupBy(*groups).agg(F.count(F.when(opens, 1)).alias("incidents"))


def sweep(scores: DataFrame, hours: float | DataFrame, budgets: Sequence[float] = BUDGETS, gap_s: float = 60.0, groups: Sequence[str] = ("family",)) -> DataFrame:
    """Every budget's threshold and cost per group.

    A test row is reduced to how many of its group's thresholds it reaches; counts per that number give every budget.
    Only benign rows that alert are expanded per budget, for the incident count.
    """
    groups = list(groups)
    th = budget_threshold(scores.where("split IN (0, 1) AND calib"), groups, budgets)
    ladder = th.groupBy(*groups).agg(F.array_sort(F.collect_list(F.struct("threshold", "budget"))).alias("_ladder"))
    test = scores.where("split = 2").join(F.broadcast(ladder), groups)
    reached = F.filter("_ladder", lambda x: F.col("score") >= x["threshold"])
    counts = test.groupBy(*groups, F.size(reached).alias("_hit"), "positive", "attack").agg(F.count(F.lit(1)).alias("_n"))
    per = counts.join(ladder, groups).select(*groups, "_hit", "positive", "attack", "_n", F.posexplode("_ladder").alias("_i", "_rung")).select(
        *groups, "_rung.*", "positive", "attack", "_n", (F.col("_i") < F.col("_hit")).alias("fires"))
    s = per.groupBy(*groups, "budget", "threshold").agg(
        F.sum(F.when(F.col("fires") & F.col("positive"), F.col("_n")).otherwise(0)).alias("true_positives"),
        F.sum(F.when(F.col("fires") & ~F.col("attack"), F.col("_n")).otherwise(0)).alias("false_alarms"),
        F.sum(F.when(F.col("positive"), F.col("_n")).otherwise(0)).alias("positives"), F.sum(F.when(~F.col("attack"), F.col("_n")).otherwise(0)).alias("benign_test"))
    noisy = test.where(~F.col("attack")).select(*groups, "position", "t_us", "sender", F.explode(F.transform(reached, lambda x: x["budget"])).alias("budget"))
    inc = incident_count(noisy, ["sender"], [*groups, "budget"], gap_s)
    j = s.join(inc, [*groups, "budget"], "left").where("positives > 0 AND benign_test > 0")
    if isinstance(hours, DataFrame):
        j = j.join(F.broadcast(hours.select(F.greatest(F.col("hours"), F.lit(1e-9)).alias("hours"))), F.lit(True))
    else:
        j = j.withColumn("hours", F.lit(max(float(hours), 1e-9)))
    tp, fp = F.col("true_positives"), F.col("false_alarms")
    fpr = fp / F.col("benign_test")
    return j.select(
        *groups, "budget", "threshold", (tp / F.col("positives")).alias("recall"), (tp / F.greatest(tp + fp, F.lit(1))).alias("precision"), fpr.alias("realised_fpr"),
        (fpr / F.col("budget")).alias("overshoot_vs_budget"), "false_alarms", (fp / F.col("hours")).alias("fa_per_hour"),
        (F.coalesce("incidents", F.lit(0)) / F.col("hours")).alias("false_incidents_per_hour"), "true_positives", "positives", "benign_test", "hours")


def pick_operating_point(table: DataFrame, floor: float, groups: Sequence[str] = ("family",)) -> DataFrame:
    """Per group the row with the fewest false alarms among those with enough recall (ties to the larger budget)."""
    cols = [c for c in table.columns if c not in groups]
    best = table.where(F.col("recall") >= floor).groupBy(*groups).agg(
        F.min_by(F.struct(*cols), F.struct("fa_per_hour", (-F.col("budget")).alias("b"))).alias("_r"))
    return best.select(*groups, "_r.*")


def _times(condition: Column, weight: str | None) -> Column:
    """How many rows hold, each counted `weight` times."""
    return F.count(F.when(condition, 1)) if weight is None else F.coalesce(F.sum(F.when(condition, F.col(weight))), F.lit(0))


def pr_curve(df: DataFrame, groups: Sequence[str], score: str = "score", positive: str = "positive", weight: str | None = None) -> DataFrame:
    """One precision/recall point per distinct score, best score first: cumulative `tp` and `seen`, totals alongside. A row with a `weight`, an integer, stands for so many."""
    groups = list(groups)
    by = df.groupBy(*groups, score).agg(_times(F.lit(True), weight).alias("n"), _times(F.col(positive), weight).alias("pos"))
    cum = prefix_sums(by, groups, score, {"seen": F.col("n"), "tp": F.col("pos")}, descending=True)
    total = by.groupBy(*groups).agg(F.sum("n").alias("total"), F.sum("pos").alias("total_pos"))
    j = cum.join(total, groups) if groups else cum.join(F.broadcast(total), F.lit(True))
    return j.withColumns({"precision": F.col("tp") / F.col("seen"), "recall": F.col("tp") / F.greatest("total_pos", F.lit(1))})


def average_precision(df: DataFrame, groups: Sequence[str], score: str = "score", positive: str = "positive", weight: str | None = None) -> DataFrame:
    """Tied average precision per group; null where a class is absent."""
    c = pr_curve(df, groups, score, positive, weight)
    ap = F.sum(F.col("pos") / F.col("total_pos") * F.col("precision"))
    both = (F.max("total_pos") > 0) & (F.max("total_pos") < F.max("total"))
    return c.groupBy(*groups).agg(F.max("total_pos").alias("positives"), F.when(both, ap).alias("pr_auc"))


def auroc(df: DataFrame, groups: Sequence[str], score: str = "score", positive: str = "positive", weight: str | None = None) -> DataFrame:
    """Area under the ROC curve with average ranks for ties; null where a class is absent."""
    groups = list(groups)
    by = df.groupBy(*groups, score).agg(_times(F.col(positive), weight).alias("pos"), _times(~F.col(positive), weight).alias("neg"))
    cum = prefix_sums(by, groups, score, {"below": F.col("neg")})
    wins = F.sum(F.col("pos").cast("double") * (F.col("below") - F.col("neg") + F.col("neg") / 2))
    pairs = F.sum(F.col("pos").cast("double")) * F.sum(F.col("neg").cast("double"))
    return cum.groupBy(*groups).agg(F.when(pairs > 0, wins / pairs).alias("auroc"))


def pr_threshold(df: DataFrame, groups: Sequence[str], min_precision: float | None = None, score: str = "score", positive: str = "positive") -> DataFrame:
    """The best-F1 threshold, or the highest-recall one meeting a precision floor (else the most precise)."""
    c = pr_curve(df, groups, score, positive)
    total = F.col("precision") + F.col("recall")
    f1 = F.when(total > 0, 2 * F.col("precision") * F.col("recall") / total).otherwise(0.0)
    if min_precision is None:
        order = F.struct(f1, F.col(score))
    else:
        ok = (F.col("precision") >= min_precision).cast("int")
        order = F.struct(ok, F.when(ok == 1, F.col("recall")).otherwise(F.col("precision")), F.col(score))
    best = c.groupBy(*groups).agg(F.max_by(F.struct(F.col(score).alias("threshold"), "precision", "recall"), order).alias("_b"))
    return best.select(*groups, "_b.*")


def cost_of_recall(df: DataFrame, groups: Sequence[str], target: float = 0.99) -> DataFrame:
    """False alarms spent to catch `target` of a family. The cut reads labels, so its columns carry `_oracle`."""
    groups = list(groups)
    cut = quantiles(df.where("positive"), groups, "score", [1.0 - target], "lower").withColumnRenamed("quantile", "_cut")
    j = df.where("positive OR NOT attack").join(F.broadcast(cut), groups)
    hit = F.col("score") >= F.col("_cut")
    benign = F.count(F.when(~F.col("attack"), 1))
    g = j.groupBy(*groups).agg(F.count(F.when(hit & ~F.col("attack"), 1)).alias("fp_at_target_oracle"),
                               (F.count(F.when(hit & ~F.col("attack"), 1)) / F.nullif(benign, F.lit(0))).alias("fpr_at_target_oracle"),
                               (F.count(F.when(hit & F.col("positive"), 1)) / F.count(F.when(F.col("positive"), 1)) >= target - 1e-9).alias("reached"))
    ap = average_precision(df.where("positive OR NOT attack"), groups).drop("positives")
    return g.join(ap, groups)


def confusion(df: DataFrame, thresholds: DataFrame, groups: Sequence[str]) -> DataFrame:
    """A family against benign at its threshold, and the ideal precision at the same false positives. Other families are left out."""
    groups = list(groups)
    keys = [g for g in groups if g in thresholds.columns]
    j = df.where("positive OR NOT attack").join(F.broadcast(thresholds), keys)
    alert, pos = F.col("score") >= F.col("threshold"), F.col("positive")
    c = j.groupBy(*groups, "threshold").agg(
        F.count(F.when(alert & pos, 1)).alias("tp"), F.count(F.when(alert & ~pos, 1)).alias("fp"), F.count(F.when(~alert & pos, 1)).alias("fn"), F.count(F.when(~alert & ~pos, 1)).alias("tn"))
    ratio = lambda a, b: F.when(b != 0, a / b)
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return c.withColumns({"recall": ratio(tp, tp + fn), "precision": ratio(tp, tp + fp), "fpr": ratio(fp, fp + tn), "f1": ratio(2 * tp, 2 * tp + fp + fn),
                          "ideal_precision": ratio(tp + fn, tp + fn + fp)})


def multiclass_matrix(df: DataFrame, thresholds: DataFrame, families: Sequence[str]) -> DataFrame:
    """True class against the family named: the highest score among those over their own threshold, else none."""
    j = df.join(F.broadcast(thresholds), "family")
    over = F.col("score") >= F.col("threshold")
    rank = F.create_map(*[x for i, f in enumerate(families) for x in (F.lit(f), F.lit(-i))])
    named = j.groupBy("position", "label").agg(F.max(F.when(over, F.struct("score", rank[F.col("family")].alias("r"), "family"))).alias("_b"))
    named = named.withColumn("named", F.coalesce("_b.family", F.lit("none")))
    return named.groupBy("label").agg(*[F.count(F.when(F.col("named") == f, 1)).alias(f) for f in ("none", *families)])


def calibration(df: DataFrame, groups: Sequence[str], probability: str, truth: Column, bins: int = 15, right_closed: bool = True) -> DataFrame:
    """Brier score and expected calibration error; bins right-closed (the first one both-closed) or by floor."""
    p = F.col(probability)
    b = F.greatest(F.ceil(p * bins) - 1, F.lit(0)) if right_closed else F.least(F.floor(p * bins), F.lit(bins - 1))
    y = truth.cast("double")
    per = df.groupBy(*groups, b.alias("_bin")).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(p).alias("_p"), F.sum(y).alias("_y"), F.sum((p - y) * (p - y)).alias("_b"))
    return per.groupBy(*groups).agg((F.sum("_b") / F.sum("_n")).alias("brier"), (F.sum(F.abs(F.col("_p") - F.col("_y"))) / F.sum("_n")).alias("ece"))


# Edges of the reliability table.
RELIABILITY_EDGES = (0.0, 0.05, 0.1, 0.2, 0.4, 0.7, 1.0001)


def reliability_table(df: DataFrame, groups: Sequence[str], probability: str, truth: Column) -> DataFrame:
    b = sum((F.when(F.col(probability) >= e, 1).otherwise(0) for e in RELIABILITY_EDGES[1:-1]), F.lit(0))
    return df.groupBy(*groups, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(truth.cast("double")).alias("hit_share"))


def choose_score_and_tail(candidates: DataFrame, budget: float) -> DataFrame:
    """Per candidate score (column `name`) the alerting tail and validation recall at the budget; one row is `chosen`.

    Validation rows only: the tail from the AUROC, the score from the recall at the budget, ties by separation.
    """
    val = candidates.where("split = 1")
    auc = auroc(val, ["name"], positive="attack").withColumn("direction", F.when(F.col("auroc") < 0.5, -1).otherwise(1))
    signed = val.join(F.broadcast(auc), "name").withColumn("_signed", F.col("score") * F.col("direction"))
    cut = quantiles(signed.where(~F.col("attack")), ["name"], "_signed", [1.0 - budget]).withColumnRenamed("quantile", "_cut")
    rec = signed.where("attack").join(F.broadcast(cut), "name").groupBy("name").agg(F.avg((F.col("_signed") >= F.col("_cut")).cast("double")).alias("val_recall"))
    j = auc.join(rec, "name").withColumn("separation", F.greatest("auroc", 1 - F.col("auroc")))
    best = j.agg(F.max_by("name", F.struct("val_recall", "separation", "name")).alias("_best"))
    return j.join(F.broadcast(best), F.lit(True)).withColumn("chosen", F.col("name") == F.col("_best")).drop("_best")


def anomaly_score(df: DataFrame, columns: Sequence[str], fit_on: Column) -> DataFrame:
    """Each column's error standardised on benign training rows, then averaged over columns."""
    from wiresift.operators.features import moments, standardise
    z = standardise(df, columns, moments(df, columns, fit_on, logged=False), logged=False)
    return z.withColumn("anomaly_score", sum((F.col(c) for c in columns), F.lit(0.0)) / len(columns))


def reconstruction_quality(df: DataFrame, error: str = "error", attack: str = "attack") -> DataFrame:
    b, a = F.when(~F.col(attack), F.col(error)), F.when(F.col(attack), F.col(error))
    spread = F.greatest(F.sqrt(0.5 * (F.var_samp(b) + F.var_samp(a))), F.lit(1e-12))
    return df.agg(F.avg(b).alias("benign_error"), F.avg(a).alias("attack_error"), (F.avg(a) / F.greatest(F.avg(b), F.lit(1e-12))).alias("ratio"),
                  ((F.avg(a) - F.avg(b)) / spread).alias("separation"))


def _poisson_weight(key: str, replicate: Column | int, seed: int) -> Column:
    """How often a resample draws a row: the inverse Poisson(1) distribution function of a hash of (row, replicate), to where its tail is below the step of the hash."""
    r = replicate if isinstance(replicate, Column) else F.lit(replicate)
    return _poisson_quantile(portable_hash(F.col(key), r * 1_000_003 + seed))


def _poisson_quantile(hashed: Column) -> Column:
    u = (hashed + 0.5) / float(1 << 32)
    p, total, out = 0.36787944117144233, 0.36787944117144233, F.lit(0)
    for k in range(1, 19):
        out = out + F.when(u >= total, 1).otherwise(0)
        p /= k
        total += p
    return out


def _poisson_weights(key: str, samples: int, seed: int) -> Column:
    """The weights of a row in all resamples as one array: each hash is computed once, and compared with the few steps below it alone."""
    steps, p, total = [], 0.36787944117144233, 0.36787944117144233
    for k in range(1, 19):
        steps.append(math.ceil(total * (1 << 32) - 0.5))  # (hash + 0.5) / 2^32 >= total, in whole numbers
        p /= k
        total += p

    def weight(h: Column) -> Column:
        out = F.when(h < steps[0], 0)
        for n, step in enumerate(steps[1:], 1):
            out = out.when(h < step, n)
        return out.otherwise(len(steps))
    hashes = F.transform(F.array(*[F.lit(r * 1_000_003 + seed) for r in range(samples)]), lambda r: portable_hash(F.col(key), r))
    return F.transform(hashes, weight)


def bootstrap_ci(df: DataFrame, key: str, metric: Column, samples: int = 100, seed: int = 0, level: float = 0.95) -> DataFrame:
    """Percentile interval of a weighted-mean metric: Poisson(1) weights from a hash of (row, replicate).

    Weights add up inside one aggregate, so no resample is ever materialised or moved.
    """
    weight = lambda r: _poisson_weight(key, r, seed).cast("double")
    sums = df.agg(*[F.struct(F.sum(weight(r) * metric).alias("s"), F.sum(weight(r)).alias("w")).alias(f"r{r}") for r in range(samples)])
    vals = sums.select(F.explode(F.array(*[F.struct((F.col(f"r{r}.s") / F.col(f"r{r}.w")).alias("v")) for r in range(samples)])).alias("x")).select("x.v")
    return vals.agg(F.percentile("v", (1 - level) / 2).alias("low"), F.percentile("v", (1 + level) / 2).alias("high"))


def bootstrap_ranking_ci(df: DataFrame, key: str, groups: Sequence[str] = (), score: str = "score", positive: str = "positive", samples: int = 100, seed: int = 0, level: float = 0.95) -> DataFrame:
    """(*groups, metric, low, high): percentile intervals of `auroc` and `pr_auc`, by the same weights as `bootstrap_ci`.

    A row adds its weights in all resamples to its distinct score before any shuffle, so what moves is a row a distinct score and task, however many rows share it. All resamples are
    columns of one set of prefix sums, from the best score down. A resample without both classes has no value and counts for nothing.
    """
    groups, every = list(groups), range(samples)
    drawn = df.select(*groups, score, positive, _poisson_weights(key, samples, seed).alias("_w"))
    by = drawn.groupBy(*groups, score, positive).agg(*[F.sum(F.get("_w", F.lit(r))).alias(f"_w{r}") for r in every])
    times = lambda r, condition: F.coalesce(F.sum(F.when(condition, F.col(f"_w{r}"))), F.lit(0))
    kinds = {"n": F.lit(True), "pos": F.col(positive), "neg": ~F.col(positive)}
    by = pinned(by.groupBy(*groups, score).agg(*[times(r, c).alias(f"_{k}{r}") for r in every for k, c in kinds.items()]))
    # own counts beside the inclusive sums over all scores as good or better
    cum = prefix_sums(by, groups, score, {f"_to_{k}{r}": F.col(f"_{k}{r}") for r in every for k in kinds}, descending=True)
    n, pos, neg = ([F.col(f"_{k}{r}") for r in every] for k in kinds)
    seen, tp, to_neg = ([F.col(f"_to_{k}{r}") for r in every] for k in kinds)
    sums = cum.groupBy(*groups).agg(*[c.alias(name) for r in every for name, c in (
        (f"n{r}", F.sum(n[r])), (f"p{r}", F.sum(pos[r].cast("double"))), (f"f{r}", F.sum(neg[r].cast("double"))),
        (f"lost{r}", F.sum(F.when(pos[r] > 0, pos[r].cast("double") * (to_neg[r] - neg[r] / 2)).otherwise(0.0))),
        (f"ap{r}", F.sum(F.when(pos[r] > 0, pos[r] * (tp[r] / seen[r])).otherwise(0.0))))])
    values = []
    for r in every:
        count, p, f = F.col(f"n{r}"), F.col(f"p{r}"), F.col(f"f{r}")
        area = F.when(p * f > 0, 1 - F.col(f"lost{r}") / (p * f))
        precision = F.when((p > 0) & (p < count), F.col(f"ap{r}") / p)
        values += [F.struct(F.lit(m).alias("metric"), v.alias("v"), (count > 0).alias("drawn")) for m, v in (("auroc", area), ("pr_auc", precision))]
    values = sums.select(*groups, F.inline(F.array(*values))).where("drawn")
    return values.groupBy(*groups, "metric").agg(F.percentile("v", (1 - level) / 2).alias("low"), F.percentile("v", (1 + level) / 2).alias("high"))


def drift_report(live: DataFrame, training: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per feature: mean shift in training deviations, deviation ratio, both means; the largest shift first."""
    from wiresift.functions.scalars import signed_log
    x = lambda c: signed_log(F.col(c))
    m = live.agg(*[F.avg(x(c)).alias(f"lm_{c}") for c in columns], *[F.stddev_pop(x(c)).alias(f"ls_{c}") for c in columns])
    j = m.join(F.broadcast(training), F.lit(True))
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), ((F.col(f"lm_{c}") - F.col(f"mean_{c}")) / F.greatest(f"sd_{c}", F.lit(1e-6))).alias("mean_shift_training_sd"),
                              (F.col(f"ls_{c}") / F.greatest(f"sd_{c}", F.lit(1e-6))).alias("live_to_training_sd"), F.col(f"lm_{c}").alias("live_mean"), F.col(f"mean_{c}").alias("training_mean")) for c in columns])
    return j.select(F.inline(rows)).orderBy(F.abs("mean_shift_training_sd").desc(), "feature")


def reversed_histogram(flows: DataFrame, reversed_: str = "reversed") -> DataFrame:
    """Flows by orientation: unknown (-1), as recorded (0), turned (1); every value has a row."""
    counts = flows.agg(*[F.count(F.when(F.col(reversed_) == v, 1)).alias(f"n{i}") for i, v in enumerate((-1.0, 0.0, 1.0))])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(v).alias("reversed"), F.col(f"n{i}").alias("flows")) for i, v in enumerate((-1.0, 0.0, 1.0))])))


def latency_summary(samples: DataFrame, now_us: int, window_s: float = 60.0) -> DataFrame:
    """p50, p90 and p99 of the last minute's durations, clamped at zero, with the count of events from the future.

    samples: wall_us, observed_us, first_us.
    """
    recent = samples.where(F.col("wall_us") >= now_us - int(window_s * 1e6))
    lag = lambda c: F.greatest((F.col("wall_us") - F.col(c)) / F.lit(1e6), F.lit(0.0))
    long = recent.select(F.explode(F.array(F.struct(F.lit("after_t_obs").alias("stage"), lag("observed_us").alias("seconds"), F.lit(0).alias("future")),
                                           F.struct(F.lit("from_first_packet").alias("stage"), lag("first_us").alias("seconds"), (F.col("first_us") > F.col("wall_us")).cast("int").alias("future")))).alias("x")).select("x.*")
    q = quantiles(long, ["stage"], "seconds", [0.5, 0.9, 0.99])
    wide = q.groupBy("stage").agg(*[F.max(F.when(F.col("q") == p, F.col("quantile"))).alias(n) for p, n in ((0.5, "p50"), (0.9, "p90"), (0.99, "p99"))])
    return long.groupBy("stage").agg(F.count(F.lit(1)).alias("samples"), F.sum("future").alias("future_events")).join(wide, "stage")


def compare_paths(ref: DataFrame, cand: DataFrame, stages: Sequence[tuple[str, Sequence[str], str]], key: str = "flow_uid") -> DataFrame:
    """Stage by stage on the flows both have: worst difference, values out of tolerance, verdict; flows first.

    `first_failing` marks the first stage that fails. Candidate-only flows fail the `flows` stage.
    """
    tol = {"exact": (0.0, 0.0), "float": (1e-5, 1e-6), "embedding": (0.0, 1e-4), "stateful": (0.0, 1e-4)}
    r = ref.select(F.col(key), *[F.col(c).alias(f"r_{c}") for _, cs, _ in stages for c in cs], F.lit(1).alias("_r"))
    c = cand.select(F.col(key), *[F.col(x).alias(f"c_{x}") for _, cs, _ in stages for x in cs], F.lit(1).alias("_c"))
    j = r.join(c, key, "full")
    both = F.col("_r").isNotNull() & F.col("_c").isNotNull()
    aggs = [F.count(F.when(F.col("_r").isNull(), 1)).alias("n_extra"), F.count(F.when(both, 1)).alias("n_both")]
    for s, cols, kind in stages:
        rtol, atol = tol[kind]
        diffs, bads = [], []
        for x in cols:
            a, b = F.col(f"r_{x}"), F.col(f"c_{x}")
            if ref.schema[x].dataType.simpleString() in ("string", "boolean"):
                bad = ~a.eqNullSafe(b)
                diff = F.when(bad, F.lit(float("inf"))).otherwise(0.0)
            else:
                nan = lambda v: v.isNull() | F.isnan(v.cast("double"))
                diff = F.when(nan(a) & nan(b), 0.0).otherwise(F.coalesce(F.abs(a.cast("double") - b.cast("double")), F.lit(float("inf"))))
                bad = ~(diff <= atol + rtol * F.abs(F.when(nan(a), 0.0).otherwise(a.cast("double"))))
            diffs.append(F.when(both, diff))
            bads.append(F.when(both & bad, 1).otherwise(0))
        aggs += [F.max(F.greatest(*diffs) if len(diffs) > 1 else diffs[0]).alias(f"w_{s}"), F.sum(sum(bads[1:], bads[0])).alias(f"b_{s}")]
    out = j.agg(*aggs)
    rows = [F.struct(F.lit(0).alias("stage_order"), F.lit("flows").alias("stage"), F.lit(0.0).alias("worst"), F.col("n_extra").alias("out_of_tolerance"),
                     ((F.col("n_extra") == 0) & (F.col("n_both") > 0)).alias("passed"))]
    rows += [F.struct(F.lit(i).alias("stage_order"), F.lit(s).alias("stage"), F.coalesce(F.col(f"w_{s}"), F.lit(0.0)).alias("worst"), F.coalesce(F.col(f"b_{s}"), F.lit(0)).alias("out_of_tolerance"),
                      (F.coalesce(F.col(f"b_{s}"), F.lit(0)) == 0).alias("passed")) for i, (s, _, _) in enumerate(stages, 1)]
    long = out.select(F.array(*rows).alias("_rows"))
    first = F.array_min(F.transform(F.filter("_rows", lambda x: ~x["passed"]), lambda x: x["stage_order"]))
    return long.select(first.alias("_first"), F.inline("_rows")).withColumn("first_failing", F.coalesce(F.col("stage_order") == F.col("_first"), F.lit(False))).drop("_first")


def multiset_difference(a: DataFrame, b: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys whose counts differ between two paths; empty means equal multisets."""
    tag = lambda d, s: d.select(*key, F.lit(s).alias("_s"))
    g = tag(a, 1).unionByName(tag(b, -1)).groupBy(*key).agg(F.count(F.when(F.col("_s") == 1, 1)).alias("in_a"), F.count(F.when(F.col("_s") == -1, 1)).alias("in_b"))
    return g.where("in_a <> in_b")
