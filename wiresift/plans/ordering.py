"""Ordered computations that stay distributed when one key holds most of the rows.

`dense_id` numbers a whole table in a global order without a one-task window. `keyed_scan` evaluates
lag / running-sum / last-value expressions per key over a dense position; `per_key` runs a chain of them. Keys of
ordinary size use plain windows and share one shuffle. A larger key is cut into chunks of consecutive positions, every
(key, chunk) is an independent window of at most `rows_per_chunk` rows, and one summary row per (key, chunk) carries
the state across the cuts. The result equals the plain per-key window.
"""
from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wiresift.session import pinned

ROWS_PER_CHUNK = 1_000_000
MAX_LISTED = 10_000


def dense_id(df: DataFrame, order: Sequence[str | Column], name: str, start: int = 0) -> DataFrame:
    """Add a gapless id in the order of `order`, which must be a total order for a reproducible result.

    Range-partitioned sort, then one count per partition: only that table (one row per partition) is broadcast.
    """
    width = 33  # monotonically_increasing_id keeps the row number of a partition in its low 33 bits
    laid = (
        df.repartitionByRange(*order).sortWithinPartitions(*order)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_row", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << width) - 1)))
    )
    laid = pinned(laid)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        laid.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
        .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    )
    return (
        laid.join(F.broadcast(offsets), "_part")
        .withColumn(name, (F.col("_row") + F.col("_offset") + F.lit(start)).cast("bigint"))
        .drop("_part", "_row", "_offset")
    )


class Chunks(int):
    """A chunk size that has been decided on: the rows at hand belong to keys too large for one task."""


def per_key(df: DataFrame, keys: Sequence[str], rows_per_chunk: int | Chunks | None, chain: Callable[[DataFrame, Chunks | None], DataFrame]) -> DataFrame:
    """Run a chain of keyed scans, cutting only the keys that need it.

    Rows are counted per key once. Keys of at most `rows_per_chunk` rows go through `chain` with plain windows: the whole
    chain shares one shuffle, as every window in it is clustered by `keys`. The rows of larger keys are written out and go
    through the same chain in chunks. `chain(rows, cut)` hands `cut` to its scans as their `rows_per_chunk`; inside
    another chain the decision already taken is kept.
    """
    if rows_per_chunk is None or isinstance(rows_per_chunk, Chunks):
        return chain(df, rows_per_chunk)
    keys = list(keys)
    if not keys:
        return chain(df, Chunks(rows_per_chunk) if df.count() > rows_per_chunk else None)
    large = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > rows_per_chunk).select(*keys)
    # At most one key in `rows_per_chunk` rows can be large; a short list stays on the driver, a long one is written.
    found = large.limit(MAX_LISTED + 1).collect()
    if not found:
        return chain(df, None)
    hot = F.broadcast(df.sparkSession.createDataFrame(found, large.schema)) if len(found) <= MAX_LISTED else pinned(large)
    cold = chain(df.join(hot, keys, "left_anti"), None)
    return cold.unionByName(chain(pinned(df.join(hot, keys, "left_semi")), Chunks(rows_per_chunk)))


def keyed_scan(
    df: DataFrame,
    keys: Sequence[str],
    position: str,
    *,
    lags: Mapping[str, Column] | None = None,
    sums: Mapping[str, Column] | None = None,
    lasts: Mapping[str, Column] | None = None,
    maxes: Mapping[str, Column] | None = None,
    reverse: bool = False,
    rows_per_chunk: int | Chunks | None = ROWS_PER_CHUNK,
) -> DataFrame:
    """Per-key scans over an integer `position` that is unique within a key.

    lags   value on the key's previous row
    sums   inclusive running sum
    lasts  last non-null value strictly before the row
    maxes  running maximum strictly before the row
    reverse reads the stream backwards, turning "previous" into "next".
    """
    lags, sums, lasts, maxes = dict(lags or {}), dict(sums or {}), dict(lasts or {}), dict(maxes or {})
    step = F.col(position) if not reverse else -F.col(position)

    def scan(rows: DataFrame, cut: Chunks | None) -> DataFrame:
        if cut is None:
            return _plain_scan(rows, keys, step, lags, sums, lasts, maxes)
        return _chunked_scan(pinned(rows), keys, step, lags, sums, lasts, maxes, int(cut))
    return per_key(df, keys, rows_per_chunk, scan)


def _local(w, lags, sums, lasts, maxes) -> dict[str, Column]:
    until = w.rowsBetween(Window.unboundedPreceding, -1)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    return ({k: F.lag(v).over(w) for k, v in lags.items()} | {k: F.sum(v).over(upto) for k, v in sums.items()}
            | {k: F.last(v, ignorenulls=True).over(until) for k, v in lasts.items()} | {k: F.max(v).over(until) for k, v in maxes.items()})


def _plain_scan(df, keys, step, lags, sums, lasts, maxes) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(step)
    out = _local(w, lags, sums, lasts, maxes)
    return df.select(*[c for c in df.columns if c not in out], *[c.alias(n) for n, c in out.items()])


def _chunked_scan(df, keys, step, lags, sums, lasts, maxes, size: int) -> DataFrame:
    """Each (key, chunk) of `size` positions on its own, then the state of earlier chunks from a summary table."""
    base = df.withColumn("_chunk", F.floor(step / F.lit(size)).cast("bigint"))
    base = base.withColumns({f"_in_{k}": v for d in (lags, sums, lasts, maxes) for k, v in d.items()})
    w = Window.partitionBy(*keys, "_chunk").orderBy(step)
    inside = lambda d: {f"_loc_{k}": F.col(f"_in_{k}") for k in d}
    local = _local(w, inside(lags), inside(sums), inside(lasts), inside(maxes))
    if lags:
        local["_first"] = F.lag(F.lit(1)).over(w).isNull()
    scanned = base.select("*", *[c.alias(n) for n, c in local.items()])

    summary = base.groupBy(*keys, "_chunk").agg(
        *[F.max_by(f"_in_{k}", step).alias(f"_sum_{k}") for k in lags],
        *[F.sum(f"_in_{k}").alias(f"_sum_{k}") for k in sums],
        *[F.max_by(f"_in_{k}", F.when(F.col(f"_in_{k}").isNotNull(), step)).alias(f"_sum_{k}") for k in lasts],
        *[F.max(f"_in_{k}").alias(f"_sum_{k}") for k in maxes],
    )
    cw = Window.partitionBy(*keys).orderBy("_chunk")
    cprev = cw.rowsBetween(Window.unboundedPreceding, -1)
    carry = summary.select(
        *keys, "_chunk",
        *[F.lag(f"_sum_{k}").over(cw).alias(f"_car_{k}") for k in lags],
        *[F.sum(f"_sum_{k}").over(cprev).alias(f"_car_{k}") for k in sums],
        *[F.last(f"_sum_{k}", ignorenulls=True).over(cprev).alias(f"_car_{k}") for k in lasts],
        *[F.max(f"_sum_{k}").over(cprev).alias(f"_car_{k}") for k in maxes],
    )
    joined = scanned.join(carry, [*keys, "_chunk"], "left")
    out = {k: F.when(F.col("_first"), F.col(f"_car_{k}")).otherwise(F.col(f"_loc_{k}")) for k in lags}
    out |= {k: F.col(f"_loc_{k}") + F.coalesce(F.col(f"_car_{k}"), F.lit(0)) for k in sums}
    out |= {k: F.coalesce(F.col(f"_loc_{k}"), F.col(f"_car_{k}")) for k in lasts}
    out |= {k: F.greatest(F.col(f"_loc_{k}"), F.col(f"_car_{k}")) for k in maxes}
    return joined.select(*[c for c in df.columns if c not in out], *[c.alias(n) for n, c in out.items()])


def value_bucket(value: Column, per_fold: int = 256) -> Column:
    """An order-preserving bucket of a double, computed from the value alone.

    `per_fold` buckets for every factor of e, counted from zero for small values and from one for values just
    below one, so scores that crowd either end of [0, 1] still spread out. Java's log is semi-monotonic, so a
    larger value never gets a smaller bucket, and a recomputed task always agrees with the first attempt.
    """
    largest = 1e308  # infinities share the outermost bucket, NaN sorts after everything
    fold = lambda x: F.floor(F.log(F.least(x, F.lit(largest))) * per_fold).cast("bigint")
    low, high, top = 746 * per_fold, 747 * per_fold, 800 * per_fold
    return (
        F.when(value.isNull() | (value == 0), F.lit(0).cast("bigint")).when(F.isnan(value), F.lit(2000 * per_fold).cast("bigint"))
        .when(value < 0, -(fold(-value) + F.lit(low)))
        .when(value <= 0.5, fold(value) + F.lit(low))
        .when(value < 1, F.lit(high) - fold(1 - value))
        .otherwise(fold(value) + F.lit(top))
    )


def prefix_sums(df: DataFrame, groups: Sequence[str], value: str, sums: Mapping[str, Column],
                descending: bool = False, bucket: Column | None = None) -> DataFrame:
    """Inclusive running sums over `value` inside each group, one row per (group, value) in `df`.

    The window runs inside value buckets; the totals of earlier buckets are added from a small carry table.
    """
    bucket = value_bucket(F.col(value).cast("double")) if bucket is None else bucket
    laid = df.withColumn("_bucket", -bucket if descending else bucket)
    laid = laid.withColumns({f"_in_{k}": v for k, v in sums.items()})
    order = F.col(value).desc() if descending else F.col(value).asc()
    w = Window.partitionBy(*groups, "_bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    totals = laid.groupBy(*groups, "_bucket").agg(*[F.sum(f"_in_{k}").alias(f"_s_{k}") for k in sums])
    cw = Window.partitionBy(*groups).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(*groups, "_bucket", *[F.sum(f"_s_{k}").over(cw).alias(f"_c_{k}") for k in sums])
    scanned = laid.select("*", *[F.sum(f"_in_{k}").over(w).alias(f"_l_{k}") for k in sums])
    joined = scanned.join(carry, [*groups, "_bucket"])
    kept = [c for c in df.columns if c not in sums]
    return joined.select(
        *kept, *[(F.col(f"_l_{k}") + F.coalesce(F.col(f"_c_{k}"), F.lit(0))).alias(k) for k in sums])


def order_statistic(df: DataFrame, groups: Sequence[str], value: str, ranks: DataFrame, rank: str) -> DataFrame:
    """The exact value at 0-based ranks of each group; `ranks` has the groups and a bigint column `rank`.

    Rows are reduced to (group, value, count) before any ordering, so ties cost nothing.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count(F.lit(1)).alias("_n"))
    cum = prefix_sums(counts, groups, value, {"_upto": F.col("_n")})
    hit = (F.col(rank) >= F.col("_upto") - F.col("_n")) & (F.col(rank) < F.col("_upto"))
    return ranks.join(cum, list(groups)).where(hit).drop("_n", "_upto")


def median_of(df: DataFrame, value: str) -> DataFrame:
    """The exact median of `value` as one row `_median` (mean of the middle two).

    Values are bucketed on their whole part, so equal or near values meet in a bucket and no task sees them all;
    only the one or two buckets that hold the middle ranks are then ordered.
    """
    v = df.select(F.col(value).cast("double").alias("_v")).where(F.col(value).isNotNull())
    counts = v.groupBy("_v").agg(F.count(F.lit(1)).alias("_n")).withColumn("_b", F.floor("_v"))
    per = counts.groupBy("_b").agg(F.sum("_n").alias("_in"))
    ow = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    per = per.select("_b", (F.sum("_in").over(ow) - F.col("_in")).alias("_before"))
    total = counts.agg(F.sum("_n").alias("_total"))
    w = Window.partitionBy("_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    placed = counts.select("_b", "_v", "_n", F.sum("_n").over(w).alias("_upto")).join(per, "_b")
    last = F.col("_upto") + F.col("_before") - 1
    first = last - F.col("_n") + 1
    lo, hi = F.floor((F.col("_total") - 1) / 2), F.floor(F.col("_total") / 2)
    hit = placed.join(F.broadcast(total), F.lit(True))
    return hit.agg(((F.max(F.when((first <= lo) & (last >= lo), F.col("_v")))
                     + F.max(F.when((first <= hi) & (last >= hi), F.col("_v")))) / 2).alias("_median"))


def grouped_median(df: DataFrame, groups: Sequence[str], value: str, name: str) -> DataFrame:
    """The exact median of `value` per group, from distinct values with counts (no group is held whole)."""
    counts = df.groupBy(*groups, value).agg(F.count(F.lit(1)).alias("_n"))
    cum = prefix_sums(counts, groups, value, {"_upto": F.col("_n")})
    total = counts.groupBy(*groups).agg(F.sum("_n").alias("_total"))
    j = cum.join(total, list(groups))
    first, last = F.col("_upto") - F.col("_n"), F.col("_upto") - 1
    lo, hi = F.floor((F.col("_total") - 1) / 2), F.floor(F.col("_total") / 2)
    at = lambda r: F.max(F.when((first <= r) & (last >= r), F.col(value)))
    return j.groupBy(*groups).agg(((at(lo) + at(hi)) / 2).alias(name))


def smallest(df: DataFrame, value: str, tie: str, n: int, width: int) -> DataFrame:
    """The `n` rows with the smallest integer `value` (ties by `tie`), for any `n`.

    Values are counted per bucket of `width`; whole buckets below the cut are kept by a filter, and only the bucket
    that holds the n-th row is ranked. `value` should be spread (a hash), so that a bucket stays small.
    """
    bucket = F.floor(F.col(value) / F.lit(width)).cast("bigint")
    per = df.groupBy(bucket.alias("_b")).agg(F.count(F.lit(1)).alias("_n"))
    upto = F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0))
    cut = per.select("_b", (upto - F.col("_n")).alias("_before")).where(F.col("_before") < n).agg(
        F.max("_b").alias("_cut"), F.max("_before").alias("_kept"))
    laid = df.withColumn("_b", bucket).join(F.broadcast(cut), F.lit(True)).where(F.col("_b") <= F.col("_cut"))
    rank = F.row_number().over(Window.partitionBy("_b").orderBy(value, tie))
    edge = laid.where(F.col("_b") == F.col("_cut")).withColumn("_rank", rank).where(F.col("_rank") + F.col("_kept") <= n).drop("_rank")
    return laid.where(F.col("_b") < F.col("_cut")).unionByName(edge).drop("_b", "_cut", "_kept")
