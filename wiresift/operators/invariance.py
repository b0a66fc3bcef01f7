"""Does an operator look ahead? Its rows on a prefix of the stream must be those of the whole stream."""
from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wiresift.session import pinned


def prefix_differences(op: Callable[[DataFrame], DataFrame], events: DataFrame, cut: int, columns: Sequence[str], position: str = "position") -> DataFrame:
    """One row (compared, missing, added): rows of `op` over the prefix before position `cut`, and how they differ from the rows before `cut` of `op` over all events.

    Rows meet as whole rows with their number of copies in one grouped sum, so nulls, repeated rows and arrays compare as they are. `columns` must hold `position`.
    """
    columns = list(columns)
    whole = op(events).where(F.col(position) < cut).select(*columns, F.lit(1).alias("_whole"), F.lit(0).alias("_prefix"))
    part = op(pinned(events.where(F.col(position) < cut))).select(*columns, F.lit(0).alias("_whole"), F.lit(1).alias("_prefix"))
    met = whole.unionByName(part).groupBy(*columns).agg(F.sum("_whole").alias("_whole"), F.sum("_prefix").alias("_prefix"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    return met.agg(total(F.col("_prefix")).alias("compared"), total(F.greatest(F.col("_whole") - F.col("_prefix"), F.lit(0))).alias("missing"), total(F.greatest(F.col("_prefix") - F.col("_whole"), F.lit(0))).alias("added"))
