"""Attack windows, segments, train/val/test cuts and their reports."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wiresift.operators.labelling import utc_rules
from wiresift.plans.ordering import ROWS_PER_CHUNK, keyed_scan, per_key
from wiresift.session import pinned

TRAIN, VAL, TEST, GAP = 0, 1, 2, -1
BENIGN = "Benign"


def merge_spans(spans: DataFrame) -> DataFrame:
    """Merge overlapping or touching (start_us, end_us) rows. Spans come from a schedule: a handful, one sorted task."""
    w = Window.orderBy("start_us", "end_us")
    reach = F.max("end_us").over(w.rowsBetween(Window.unboundedPreceding, -1))
    s = spans.withColumn("_new", F.coalesce((F.col("start_us") > reach).cast("int"), F.lit(1)))
    s = s.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return s.groupBy("_island").agg(F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us")).drop("_island")


def attack_windows(rules: DataFrame) -> DataFrame:
    return merge_spans(utc_rules(rules).select("start_us", "end_us"))


def observed_windows(events: DataFrame, windows: DataFrame, us: str = "us", label: str = "label") -> DataFrame:
    """The span each attack occupies inside each scheduled window (more than one instant), merged again.

    Spans collapse to one row per (label, window) before anything is ordered; windows are a few schedule rows.
    """
    hit = events.where(F.col(label) != BENIGN).join(F.broadcast(windows), F.col(us).between(F.col("start_us"), F.col("end_us")))
    seen = hit.groupBy(label, "start_us", "end_us").agg(F.min(us).alias("lo"), F.max(us).alias("hi")).where("hi > lo")
    return merge_spans(seen.select(F.col("lo").alias("start_us"), F.col("hi").alias("end_us")))


def segments(events: DataFrame, windows: DataFrame, us: str = "us") -> DataFrame:
    """Consecutive spans that cover the stream: attack windows and the stretches between them, numbered from 0."""
    ends = events.agg(F.min(us).alias("first"), F.max(us).alias("last"))
    cut = windows.join(F.broadcast(ends), (F.col("end_us") > F.col("first")) & (F.col("start_us") < F.col("last")))
    edges = cut.select(F.explode(F.array(F.greatest("start_us", "first"), F.least("end_us", "last"))).alias("at"))
    edges = edges.unionByName(ends.select(F.explode(F.array("first", "last")).alias("at")))
    w = Window.orderBy("at")
    s = edges.select(F.col("at").alias("seg_start"), F.lead("at").over(w).alias("seg_end")).where("seg_end > seg_start")
    n = Window.orderBy("seg_start")
    return s.select((F.row_number().over(n) - 1).alias("segment"), "seg_start", "seg_end",
                    F.lead("seg_start").over(n).isNull().alias("is_last"))


def in_segments(events: DataFrame, segs: DataFrame, us: str = "us") -> DataFrame:
    """Each event with its segment; half-open but for the last. The segment list rides along as one array."""
    packed = segs.agg(F.array_sort(F.collect_list(F.struct("segment", "seg_start", "seg_end", "is_last"))).alias("_segs"))
    t = F.col(us)
    hit = F.filter("_segs", lambda s: (t >= s["seg_start"]) & ((t < s["seg_end"]) | (s["is_last"] & (t == s["seg_end"]))))
    return events.join(F.broadcast(packed), F.lit(True)).withColumn("_seg", F.get(hit, F.lit(0))).withColumns({
        "segment": F.col("_seg.segment"), "seg_start": F.col("_seg.seg_start"), "seg_end": F.col("_seg.seg_end")}).drop("_segs", "_seg")


def time_code(us: Column, start: Column, end: Column, train: float = 0.6, val: float = 0.1, gap_s: float = 120.0) -> Column:
    """0 up to the train cut, 1 between the cuts, 2 after, -1 inside the embargo that follows each cut."""
    t, span = (us - start) / F.lit(1e6), (end - start) / F.lit(1e6)
    a, b = span * train, span * (train + val)
    return (F.when(t <= a, TRAIN).when((t > a + gap_s) & (t <= b), VAL).when(t > b + gap_s, TEST).otherwise(GAP))


def chronological_split(events: DataFrame, us: str = "us", train: float = 0.6, val: float = 0.1, gap_s: float = 120.0) -> DataFrame:
    ends = events.agg(F.min(us).alias("_a"), F.max(us).alias("_b"))
    return events.join(F.broadcast(ends), F.lit(True)).withColumn(
        "split", time_code(F.col(us), F.col("_a"), F.col("_b"), train, val, gap_s)).drop("_a", "_b")


def segment_split(events: DataFrame, windows: DataFrame, us: str = "us", train: float = 0.6, val: float = 0.1, gap_s: float = 120.0) -> DataFrame:
    e = in_segments(events, segments(events, windows, us), us)
    return e.withColumn("split", time_code(F.col(us), F.col("seg_start"), F.col("seg_end"), train, val, gap_s)).drop("segment", "seg_start", "seg_end")


def stratified_split(events: DataFrame, windows: DataFrame, position: str, us: str = "us", label: str = "label", train: float = 0.6, val: float = 0.1,
                     gap_s: float = 120.0, rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """Benign rows by the clock, every family by rank inside its segment.

    Fewer than three rows all train; at least one row on each side of both cuts; an embargo that would empty a split
    is skipped. `position` orders equal times. Ranks come from a chunked running count, so a family may hold most of
    the day; its cut points and embargo counts are one small row per (segment, family).
    """
    gap_us = int(gap_s * 1e6)
    e = in_segments(events, segments(events, windows, us), us)
    fam = keyed_scan(e.where(F.col(label) != BENIGN), ["segment", label], position, sums={"_rank": F.lit(1)}, rows_per_chunk=rows_per_chunk)
    fam = pinned(fam.withColumn("_rank", F.col("_rank") - 1))  # attack rows only; their groups are counted three times below
    n = fam.groupBy("segment", label).agg(F.count(F.lit(1)).alias("_n"))
    first = F.least(F.greatest(F.lit(1), F.rint(F.col("_n") * train).cast("bigint")), F.col("_n") - 2)
    second = F.least(F.greatest(F.col("_first") + 1, F.rint(F.col("_n") * (train + val)).cast("bigint")), F.col("_n") - 1)
    n = n.withColumn("_first", first).withColumn("_second", second)
    fam = fam.join(n, ["segment", label]).withColumn(
        "_code", F.when((F.col("_n") < 3) | (F.col("_rank") < F.col("_first")), TRAIN).when(F.col("_rank") < F.col("_second"), VAL).otherwise(TEST))
    cuts = fam.where("_n >= 3").groupBy("segment", label).agg(
        F.max(F.when(F.col("_rank") == F.col("_first") - 1, F.col(us))).alias("_edge1"), F.max(F.when(F.col("_rank") == F.col("_second") - 1, F.col(us))).alias("_edge2"))
    fam = fam.join(cuts, ["segment", label], "left")
    late1 = (F.col("_code") == VAL) & (F.col(us) > F.col("_edge1") + gap_us)
    late2 = (F.col("_code") == TEST) & (F.col(us) > F.col("_edge2") + gap_us)
    alive = fam.groupBy("segment", label).agg(F.count(F.when(late1, 1)).alias("_alive1"), F.count(F.when(late2, 1)).alias("_alive2"))
    fam = fam.join(alive, ["segment", label])
    code = (F.when((F.col("_code") == VAL) & ~late1 & (F.col("_alive1") > 0), GAP).when((F.col("_code") == TEST) & ~late2 & (F.col("_alive2") > 0), GAP)
            .otherwise(F.col("_code")))
    benign = e.where(F.col(label) == BENIGN).withColumn("split", time_code(F.col(us), F.col("seg_start"), F.col("seg_end"), train, val, gap_s))
    cols = [*events.columns, "split"]
    return benign.select(*cols).unionByName(fam.withColumn("split", code).select(*cols))


def band_hours(events: DataFrame, position: str, us: str = "us", split: str = "split", code: int = TEST, rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """Hours covered by one split: the summed span of its unbroken runs in stream order."""
    e = events.select(position, us, split)
    turn = F.coalesce((F.col(split) != F.col("_before")).cast("int"), F.lit(1))

    def chain(x: DataFrame, cut) -> DataFrame:
        x = keyed_scan(x, [], position, lags={"_before": F.col(split)}, rows_per_chunk=cut)
        return keyed_scan(x.withColumn("_turn", turn), [], position, sums={"_run": F.col("_turn")}, rows_per_chunk=cut)
    e = per_key(e, [], rows_per_chunk, chain)
    runs = e.where(F.col(split) == code).groupBy("_run").agg((F.max(us) - F.min(us)).alias("_span"))
    return runs.agg((F.coalesce(F.sum("_span"), F.lit(0)) / F.lit(3.6e9)).alias("hours"))


def gap_hours(events: DataFrame, position: str, us: str = "us", quiet_s: float = 120.0, rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """The fallback where no split codes exist: the sum of gaps no longer than the embargo."""
    e = keyed_scan(events.select(position, us), [], position, lags={"_before": F.col(us)}, rows_per_chunk=rows_per_chunk)
    gap = F.col(us) - F.col("_before")
    return e.agg((F.coalesce(F.sum(F.when(gap <= int(quiet_s * 1e6), gap)), F.lit(0)) / F.lit(3.6e9)).alias("hours"))


def split_report(events: DataFrame, label: str = "label", split: str = "split") -> DataFrame:
    """Rows per family and split, and whether every family reaches train, val and test."""
    names = {TRAIN: "train", VAL: "val", TEST: "test", GAP: "gap"}
    r = events.groupBy(F.col(label).alias("family")).agg(
        F.count(F.lit(1)).alias("total"), *[F.count(F.when(F.col(split) == c, 1)).alias(n) for c, n in names.items()])
    return r.withColumns({"is_benign": F.col("family") == BENIGN, "complete": (F.col("train") > 0) & (F.col("val") > 0) & (F.col("test") > 0)})
