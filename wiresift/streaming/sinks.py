"""`foreachBatch` operators over Parquet partitions of their own batch (`sources.tables.BatchTable`).

A batch that is run again after a failure reads the state of the batch before it and replaces its own partition, so every operator here is exactly-once.
"""
from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wiresift.plans.ordering import dense_id, prefix_sums, smallest
from wiresift.session import pinned
from wiresift.sources.tables import BatchTable


def reorder_by_availability(table: BatchTable, released: BatchTable, delay_us: int, clock: str = "now_us") -> Callable[[DataFrame, int], None]:
    """Hold events until `t_obs` is `delay_us` behind the newest clock; release them in (t_obs, id) order, each batch after the last.

    `released` is a log with a dense `position`; `drain` empties what is still held.
    """
    def step(batch: DataFrame, batch_id: int) -> None:
        held = table.before(batch_id, batch.schema)
        pool = held.unionByName(batch)
        newest = pool.agg(F.max(clock).alias("_now"))
        tagged = pool.join(F.broadcast(newest), F.lit(True)).withColumn("_ready", F.col("t_obs_us") <= F.col("_now") - delay_us).drop("_now")
        _release(tagged.where("_ready").drop("_ready"), released, batch_id)
        table.write(tagged.where("NOT _ready").drop("_ready"), batch_id)
    return step


RELEASED = "position bigint"


def _release(ready: DataFrame, released: BatchTable, batch_id: int) -> None:
    start = released.all_before(batch_id, RELEASED).count()  # positions are gapless from 0
    released.append(dense_id(ready, ["t_obs_us", "event_id"], "position", start), batch_id)


def drain(table: BatchTable, released: BatchTable, batch_id: int, schema) -> None:
    """The end of the stream, as the batch after the last one: everything still held is released."""
    _release(table.before(batch_id, schema), released, batch_id)


def stable_ids(table: BatchTable, ip: str = "ip") -> Callable[[DataFrame, int], None]:
    """A persistent address to id map: unknown addresses get the next ids in order of first appearance; ids are never reused.

    Only the batch's new addresses are numbered; the map grows by appending.
    """
    def step(batch: DataFrame, batch_id: int) -> None:
        seen = batch.groupBy(ip).agg(F.min("position").alias("_first"))
        known = table.all_before(batch_id, "ip string, node_id bigint")
        fresh = seen.join(known.select(F.col("ip").alias(ip)), ip, "left_anti")
        ids = dense_id(fresh, ["_first", ip], "node_id", known.count())
        table.append(ids.select(F.col(ip).alias("ip"), "node_id"), batch_id)
    return step


ADAPTIVE = "event_id bigint, score double, n bigint, seen bigint, threshold double"


def adaptive_threshold(table: BatchTable, baseline: float, budget: float, recent: int = 50_000, warmup: int = 128, tail: int = 4) -> Callable[[DataFrame, int], None]:
    """A live threshold that can only rise above the committed one.

    The quantile is that of all scores seen and, once more, of the `recent` newest, at max(budget, tail / seen), once `warmup` were seen. All scores are kept as counts of distinct
    scores (rows without event_id), so none is sampled away; the newest are kept as they are.
    """
    def step(batch: DataFrame, batch_id: int) -> None:
        old, new = table.before(batch_id, ADAPTIVE), batch.select("event_id", "score")
        counts = old.where("event_id IS NULL").select("score", "n").unionByName(new.groupBy("score").agg(F.count(F.lit(1)).alias("n")))
        counts = pinned(counts.groupBy("score").agg(F.sum("n").alias("n")))
        aged = old.where("event_id IS NOT NULL").select("event_id", "score").unionByName(new).withColumn("_age", -F.col("event_id"))
        newest = pinned(smallest(aged, "_age", "event_id", recent, 1 << 10).select("event_id", "score"))
        seen = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        cut = baseline
        if seen >= warmup:
            sample = counts.unionByName(newest.groupBy("score").agg(F.count(F.lit(1)).alias("n"))).groupBy(F.lit("live").alias("family"), "score").agg(F.sum("n").alias("n"))
            at = sample.agg(F.ceil((F.sum("n") - 1) * (1.0 - max(budget, tail / seen))).alias("_at"))
            upto = prefix_sums(sample, ["family"], "score", {"_upto": F.col("n")}).join(F.broadcast(at), F.lit(True))
            got = upto.where((F.col("_at") < F.col("_upto")) & (F.col("_at") >= F.col("_upto") - F.col("n"))).first()
            cut = max(baseline, got["score"]) if got else baseline
        both = counts.select(F.lit(None).cast("bigint").alias("event_id"), "score", "n").unionByName(newest.withColumn("n", F.lit(1).cast("bigint")))
        table.write(both.withColumns({"seen": F.lit(seen).cast("bigint"), "threshold": F.lit(float(cut))}), batch_id)
    return step


def drifted(realised: float, budget: float, tolerance: float = 3.0) -> bool:
    """Whether the realised alert rate has left the tolerated ratio of its budget, either way."""
    return realised > 0 and budget > 0 and not (1.0 / tolerance <= realised / budget <= tolerance)


def score_log(table: BatchTable, duration_s: float = 7200.0, max_gap_s: float = 600.0, signature: str = "") -> Callable[[DataFrame, int], None]:
    """The calibration log: one row per (name, flow), the last `duration_s` seconds, cleared by a silence of `max_gap_s`.

    `start_us` is the first time the log has held since the last clearing. Rows carry the policy they were kept under: a log resumed with another
    duration, gap or model `signature` starts empty.
    """
    schema = "name string, flow string, t_us bigint, score double, start_us bigint, policy string"
    policy = json.dumps([signature, duration_s, max_gap_s])
    gap = int(max_gap_s * 1e6)

    def step(batch: DataFrame, batch_id: int) -> None:
        old = table.before(batch_id, schema).where(F.col("policy") == policy).drop("policy")
        rows = old.select("name", "flow", "t_us", "score", F.lit(0).alias("_new"), "start_us").unionByName(
            batch.where(~F.isnan("score") & (F.abs("score") < float("inf"))).select("name", "flow", "t_us", "score", F.lit(1).alias("_new"), F.lit(None).cast("bigint").alias("start_us")))
        # A longer silence than the gap leaves a stretch of that length, so the first and last time of each stretch tell all of them: a row a stretch.
        tail = old.agg(F.max("t_us").alias("t_us")).where("t_us IS NOT NULL")
        times = batch.select("t_us").unionByName(tail).groupBy(F.floor(F.col("t_us") / max(gap, 1)).alias("_part")).agg(F.min("t_us").alias("t_us"), F.max("t_us").alias("_end"))
        cut = times.withColumn("_gap", F.col("t_us") - F.lag("_end").over(Window.orderBy("_part"))).where(F.col("_gap") > gap).agg(F.max("t_us").alias("_cut"))
        ends = batch.agg(F.max("t_us").alias("_last")).join(F.broadcast(cut), F.lit(True)).join(F.broadcast(old.agg(F.max("t_us").alias("_old_last"))), F.lit(True)).select(
            F.coalesce("_cut", F.lit(-1)).alias("_cut"), (F.greatest("_last", "_old_last") - int(duration_s * 1e6)).alias("_from"))
        alive = rows.join(F.broadcast(ends), F.lit(True)).where((F.col("t_us") >= F.col("_cut")))
        start = alive.agg(F.min(F.least("t_us", F.coalesce("start_us", "t_us"))).alias("_raw"), F.max("_cut").alias("_cut2")).select(F.greatest("_raw", "_cut2").alias("_start"))
        once = alive.where(F.col("t_us") >= F.col("_from")).groupBy("name", "flow").agg(F.min_by(F.struct("t_us", "score"), F.struct("_new", "t_us")).alias("r")).select("name", "flow", "r.*")
        table.write(once.join(F.broadcast(start), F.lit(True)).withColumnRenamed("_start", "start_us").select("name", "flow", "t_us", "score", "start_us", F.lit(policy).alias("policy")), batch_id)
    return step


def live_thresholds(log: DataFrame, baselines: dict[str, float], budgets: dict[str, float], duration_s: float = 7200.0, min_samples: int = 128, tail: int = 4) -> DataFrame:
    """Thresholds of a calibration log: the exact higher quantile, never below the baseline, only after a full window."""
    spark = log.sparkSession
    base = spark.createDataFrame([(n, b, budgets[n]) for n, b in baselines.items()], "name string, baseline double, budget double")
    n = log.groupBy("name").agg(F.count(F.lit(1)).alias("samples"))
    ready = log.agg(F.coalesce((F.max("t_us") - F.min("start_us")) >= int(duration_s * 1e6), F.lit(False)).alias("ready"))
    b = base.join(n, "name", "left").fillna(0, ["samples"]).join(F.broadcast(ready), F.lit(True))
    b = b.withColumn("effective_budget", F.when(F.col("ready") & (F.col("samples") >= min_samples), F.greatest("budget", F.lit(tail) / F.col("samples"))))
    from wiresift.plans.ordering import order_statistic
    want = b.where("effective_budget IS NOT NULL").select("name", F.least(F.col("samples") - 1, F.ceil((1 - F.col("effective_budget")) * (F.col("samples") - 1)).cast("bigint")).alias("_at"))
    got = order_statistic(log, ["name"], "score", want, "_at").select("name", F.col("score").alias("_q"))
    return b.join(got, "name", "left").select("name", "samples", "ready", "effective_budget", F.greatest("baseline", F.coalesce("_q", "baseline")).alias("threshold"))


def incident_ledger(table: BatchTable, key: list[str], time: str = "opened_us", merged: str | None = None, retention_us: int = 10_800_000_000) -> Callable[[DataFrame, int], None]:
    """Idempotent insert by key with a retention window; `merged` names a flag that keeps the larger of old and new."""
    def step(batch: DataFrame, batch_id: int) -> None:
        old = table.before(batch_id, batch.schema)
        rows = old.withColumn("_new", F.lit(0)).unionByName(batch.withColumn("_new", F.lit(1)))
        rest = [c for c in batch.columns if c not in key]
        # An insert keeps the stored row; an upsert takes the newer one, with the larger flag.
        pick = F.max_by if merged else F.min_by
        g = rows.groupBy(*key).agg(pick(F.struct(*rest), "_new").alias("_r"), *([F.max(merged).alias("_flag")] if merged else []))
        out = g.select(*key, "_r.*", *(["_flag"] if merged else []))
        if merged:
            out = out.withColumn(merged, F.col("_flag")).drop("_flag")
        newest = rows.agg((F.max(time) - retention_us).alias("_from"))
        table.write(out.join(F.broadcast(newest), F.lit(True)).where(F.col(time) >= F.col("_from")).select(*batch.columns), batch_id)
    return step


def rolling_window(table: BatchTable, rebuild: Callable[[DataFrame, int], None], seconds: float = 300.0, events: int | None = None, t: str = "t_us", order: str = "position") -> Callable[[DataFrame, int], None]:
    """Keep the trailing window (by time, and by number of events where one is given) and hand it to `rebuild` after every batch."""
    def step(batch: DataFrame, batch_id: int) -> None:
        pool = table.before(batch_id, batch.schema).unionByName(batch)
        newest = pool.agg((F.max(t) - int(seconds * 1e6)).alias("_from"))
        window = pool.join(F.broadcast(newest), F.lit(True)).where(F.col(t) >= F.col("_from")).drop("_from")
        if events is not None:
            window = window.orderBy(F.col(order).desc()).limit(events)
        table.write(window, batch_id)
        rebuild(table.before(batch_id + 1, batch.schema), batch_id)
    return step
