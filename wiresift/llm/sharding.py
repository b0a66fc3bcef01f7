"""Proportional stratified interleaving of documents into shards (operator 1).

Rows are ranked in a seeded order within their source; the fraction (rank + 1/2) / rows of the source orders all rows, so every stretch of that
order holds the sources in the mixture of the whole. Cutting it into equal stretches gives shards whose row counts differ by at most one.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wiresift.llm.common import with_rank


def interleave(docs: DataFrame, shards: int, source: str = "source", key: list[Column] | None = None, seed: int = 1) -> DataFrame:
    """`docs` with shard (0 .. shards - 1) and slot (gapless from 0 in each shard).

    `key` are the columns that identify a row (all columns if not given); rows equal in them are interchangeable. A null source is a stratum of
    its own. Sources of any size are ranked by buckets of a hash, never in one task. Input columns named shard
    or slot are replaced; names that begin with two underscores are reserved. An empty table gives an empty result.
    """
    key = key or [F.col(f"`{c}`") for c in docs.columns]
    stratum = F.coalesce(F.concat(F.lit("="), F.col(f"`{source}`").cast("string")), F.lit(""))
    shuffled = docs.withColumns({"__stratum": stratum, "__hash": F.xxhash64(F.lit(seed), *key)})
    ranked = with_rank(shuffled, F.col("__stratum"), [F.col("__hash"), *key], F.col("__hash"), "__rank")
    sizes = shuffled.groupBy("__stratum").agg(F.count(F.lit(1)).alias("__rows"))
    mixed = ranked.join(sizes, "__stratum").withColumn("__fraction", (F.col("__rank") + 0.5) / F.col("__rows"))
    total = docs.count()
    placed = with_rank(mixed, F.lit(0), [F.col("__fraction"), F.col("__hash"), *key], F.col("__fraction"), "__place")
    short, extra = divmod(total, shards)
    at = F.col("__place")
    cut = F.lit(extra * (short + 1))
    in_long = at < cut
    rest = F.greatest(at - cut, F.lit(0))
    shard = F.when(in_long, F.floor(at / (short + 1))).otherwise(F.lit(extra) + F.floor(rest / max(short, 1)))
    slot = F.when(in_long, at % (short + 1)).otherwise(rest % max(short, 1))
    return placed.withColumns({"shard": shard.cast("int"), "slot": slot.cast("long")}).drop("__stratum", "__hash", "__rank", "__rows", "__fraction", "__place")
