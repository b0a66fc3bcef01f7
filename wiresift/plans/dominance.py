"""How many points lie below and left of each of many corners, offline, without a point meeting a corner in a row.

Points are cut into blocks of about `rows` by x and by y. A corner's count is that of the whole cells below and left of it (a prefix sum over the grid of cell counts), of
its own column of blocks and of its own row of blocks. Inside one column or row the corners are answered, a batch at a time, by a bitwise sort of the block's points; many corners of one block are dealt to several tasks.
"""
from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wiresift.plans.ordering import dense_id
from wiresift.plans.sizes import broadcast_if_small
from wiresift.session import pinned

ROWS = 1 << 16
CORNERS = 200_000


def dominated(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For each (x, y) how many (a, b) have a < x and b < y: points in order of a, ranked by b, are split bit by bit of the rank, and each corner follows its own bits."""
    order = np.argsort(a, kind="stable")
    inside = np.searchsorted(a[order], x, "left")
    ranked = np.sort(b)
    value, below = np.searchsorted(ranked, b[order], "left"), np.searchsorted(ranked, y, "left")
    low, high, out = np.zeros(len(x), np.int64), inside.astype(np.int64), np.zeros(len(x), np.int64)
    for bit in reversed(range(int(len(b)).bit_length())):
        one = (value >> bit) & 1 == 1
        zeros = np.r_[0, np.cumsum(~one)]
        go = (below >> bit) & 1 == 1
        low0, high0 = zeros[low], zeros[high]
        out += np.where(go, high0 - low0, 0)
        low, high = np.where(go, zeros[-1] + low - low0, low0), np.where(go, zeros[-1] + high - high0, high0)
        value = np.r_[value[~one], value[one]]
    return out


def _bounds(points: DataFrame, c: str, rows: int) -> np.ndarray:
    """The value that begins each block of `rows` points: one number for so many rows."""
    first = dense_id(points.select(c), [c], "_i").where(F.col("_i") % rows == 0).select(c).collect()
    return np.unique(np.array([r[0] for r in first], np.int64))


def _place(bounds: np.ndarray, side: str):
    @F.pandas_udf("long")
    def place(v: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, v.to_numpy(np.int64), side) - 1)
    return place


def counts(points: DataFrame, corners: DataFrame, keys: Sequence[str], rows: int = ROWS, per_task: int = CORNERS) -> DataFrame:
    """(*keys, n): for each key the sum of `sign` times the number of points (x, y) with both numbers smaller than those of a corner (*keys, sign, x, y).

    A key's corners thus add up ranges. All numbers are longs, none null; equal values of one axis stay in one block, so they should be few.
    A key whose corners have no point below them gets 0.
    """
    keys = list(keys)
    points = points.select("x", "y")
    none, size = corners.select(*keys, F.lit(0).cast("long").alias("n")), points.count()
    if not size:
        return none.distinct()
    if size <= rows:  # one block, which every task can hold
        deals = points.sparkSession.sparkContext.defaultParallelism
        asked = corners.select(F.lit(0).alias("axis"), F.lit(0).cast("long").alias("block"), F.col("x").alias("a"), F.col("y").alias("b"), "sign", *keys)
        given = points.select(F.lit(0).alias("axis"), F.lit(0).cast("long").alias("block"), F.col("x").alias("a"), F.col("y").alias("b"))
        return _summed(none, [_answered(asked.withColumn("deals", F.lit(deals)), given.withColumn("deals", F.lit(deals)), keys)], keys)
    points = pinned(points)
    bx, by = _bounds(points, "x", rows), _bounds(points, "y", rows)
    p = points.withColumns({"i": _place(bx, "right")("x"), "j": _place(by, "right")("y")})
    q = pinned(corners.select(*keys, "sign", "x", "y", _place(bx, "left")("x").alias("i"), _place(by, "left")("y").alias("j")))
    met = q.where("i >= 0 and j >= 0")
    # a corner's own column: both numbers count; its own row of blocks: whole columns to the left
    asked = met.select(F.lit(0).alias("axis"), F.col("i").alias("block"), F.col("x").alias("a"), F.col("y").alias("b"), "sign", *keys)
    given = p.select(F.lit(0).alias("axis"), F.col("i").alias("block"), F.col("x").alias("a"), F.col("y").alias("b"))
    parts = []
    if len(bx) > 1:
        asked = asked.union(met.where("i > 0").select(F.lit(1).alias("axis"), F.col("j").alias("block"), F.col("i").alias("a"), F.col("y").alias("b"), "sign", *keys))
        given = given.union(p.select(F.lit(1).alias("axis"), F.col("j").alias("block"), F.col("i").alias("a"), F.col("y").alias("b")))
        if len(by) > 1:
            cells = points.sparkSession.range(len(bx) * len(by)).select(F.floor(F.col("id") / len(by)).cast("long").alias("i"), (F.col("id") % len(by)).alias("j"))
            cells = cells.join(p.groupBy("i", "j").agg(F.count(F.lit(1)).alias("n")), ["i", "j"], "left").fillna(0, ["n"])
            before = lambda part, order: F.coalesce(F.sum("n").over(Window.partitionBy(part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
            cells = cells.withColumn("n", before("i", "j")).withColumn("n", before("j", "i"))
            parts.append(met.join(cells, ["i", "j"]).select(*keys, (F.col("sign") * F.col("n")).alias("n")))
    deals = broadcast_if_small(pinned(asked.groupBy("axis", "block").agg(F.ceil(F.count(F.lit(1)) / per_task).alias("deals"))), 100_000)
    parts.append(_answered(asked.join(deals, ["axis", "block"]), given.join(deals, ["axis", "block"]), keys))
    return _summed(none, parts, keys)


def _answered(asked: DataFrame, given: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, n) of corners, each dealt to one of the `deals` tasks of its block that all hold the block's points."""
    own = asked.withColumn("deal", F.pmod(F.xxhash64(*keys, "a", "b"), F.col("deals")).cast("long")).withColumn("point", F.lit(False))
    far = given.withColumn("deal", F.explode(F.sequence(F.lit(0).cast("long"), F.col("deals").cast("long") - 1))).withColumn("point", F.lit(True))
    kinds = own.select(*keys).schema
    names = ["axis", "block", "deal", "point", "a", "b", "sign", *keys]
    both = own.select(*names).union(far.select(*names[:6], F.lit(None).cast("int").alias("sign"), *(F.lit(None).cast(f.dataType).alias(f.name) for f in kinds)))

    def answer(batches):
        held, points, now = [], None, None
        for batch in batches:  # a block's points come before its corners
            place = batch[["axis", "block", "deal"]].to_numpy()
            cuts = np.r_[0, np.flatnonzero((place[1:] != place[:-1]).any(axis=1)) + 1, len(batch)] if len(batch) else np.zeros(1, np.int64)
            for start, end in zip(cuts[:-1], cuts[1:], strict=True):
                group = batch.iloc[start:end]
                if now != tuple(place[start]):
                    now, held, points = tuple(place[start]), [], None
                at = group["point"].to_numpy()
                point, corner = group[at], group[~at]
                if len(point):
                    held.append((point["a"].to_numpy(np.int64), point["b"].to_numpy(np.int64)))
                if len(corner):
                    if points is None:
                        points = tuple(np.concatenate([h[i] for h in held]) if held else np.zeros(0, np.int64) for i in (0, 1))
                    n = dominated(*points, corner["a"].to_numpy(np.int64), corner["b"].to_numpy(np.int64))
                    yield corner[keys].assign(n=n * corner["sign"].to_numpy(np.int64))
    laid = both.repartition("axis", "block", "deal").sortWithinPartitions("axis", "block", "deal", F.col("point").desc())
    return laid.mapInPandas(answer, T.StructType([*kinds, T.StructField("n", T.LongType())]))


def _summed(none: DataFrame, parts: list[DataFrame], keys: list[str]) -> DataFrame:
    for part in parts:
        none = none.union(part)
    return none.groupBy(*keys).agg(F.sum("n").alias("n"))
