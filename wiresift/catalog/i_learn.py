"""Model queries (rows-only: fitted values depend on the optimiser)."""
from __future__ import annotations

from pyspark.sql import functions as F

from wiresift.catalog import d_events as de
from wiresift.catalog import g_scores as gs
from wiresift.catalog.registry import query
from wiresift.operators import features as ft
from wiresift.operators import learn as le
from wiresift.sources import fixtures as fx
from wiresift.sources.schemas import RECORD_STATISTICS

FEATURES = ["length", "ttl", "tcp_window", "payload_len", "flags", "amount"]


def rows(spark, d):
    block = F.floor(F.col("frame_no") / 200) % 5
    return fx.packets(spark, d).select(
        F.col("frame_no").alias("position"), F.col("family").alias("label"), F.when(block < 2, 0).when(block == 2, 1).otherwise(2).alias("split"),
        *[F.col(c).cast("double").alias(c) for c in FEATURES[:-1]], (F.col("value") + F.when(F.col("family") == "Flood", 60).otherwise(0)).alias("amount"))


def records(spark, d):
    """Flow records (68 statistics and the reversed flag) with the family of the flow, first attack first, and thirds of the frame blocks as splits."""
    m = de.mapped(spark, d)
    attack = F.when(F.col("family") != le.BENIGN, F.col("frame_no"))
    labels = m.groupBy("flow_uid").agg(F.coalesce(F.min_by("family", attack), F.lit(le.BENIGN)).alias("label"), F.min("frame_no").alias("position"))
    block = F.floor(F.col("position") / 200) % 5
    flows = de.metered(spark, d).join(labels, "flow_uid").withColumn("split", F.when(block < 2, 0).when(block == 2, 1).otherwise(2))
    # the larger side counts as the sender's
    return ft.orient_record(flows.withColumn("flipped", F.col("Tot Fwd Pkts") < F.col("Tot Bwd Pkts")), "flipped").drop("flipped")


@query("l01_logistic_baseline")
def _l01(spark, d):
    return le.logistic_baseline(records(spark, d), [*RECORD_STATISTICS, "record_reversed"], "Flood")


@query("l01_packet_baseline")
def _l01p(spark, d):
    return le.logistic_baseline(rows(spark, d), FEATURES, "Flood", budgets=(0.1, 0.01))


@query("l02_family_head")
def _l02(spark, d):
    return le.head_report(le.family_head(le.assemble(rows(spark, d), FEATURES), ["Flood", "Bot", "Web"]), (0.1, 0.03, 0.01))


@query("l03_linear_compressor")
def _l03(spark, d):
    x = le.assemble(fx.table(spark, d, "embeddings"), array="embedding")
    return le.linear_compressor(x, F.col("label") == 0, 16).select("vec_id", "recon_error", F.size("z").alias("width"))


@query("l04_gate_combine")
def _l04(spark, d):
    s = gs.scores(spark, d).where("family = 'Flood'").withColumn("gate", (F.col("k") % 17).cast("double"))
    return le.gate_combine(s, "score", "gate", "positive", F.col("split") == 1).select("position", "combined")


@query("l05_platt_isotonic")
def _l05(spark, d):
    p = gs.probabilities(spark, d).where("family = 'Flood'").select("position", "p", F.col("positive").alias("truth"))
    middle = p.agg(F.percentile("position", 0.5)).first()[0]
    return le.platt_and_isotonic(p, "p", "truth", first_half=F.col("position") < middle)


@query("l06_probe")
def _l06(spark, d):
    x = le.assemble(fx.table(spark, d, "embeddings"), array="embedding").withColumn("y", (F.col("label") % 2).cast("int"))
    return le.probe(x, "y", F.col("vec_id") % 3 > 0)


@query("l07_linear_attribution")
def _l07(spark, d):
    x = le.assemble(rows(spark, d), FEATURES).withColumn("y", (F.col("label") == "Flood").cast("double"))
    return le.linear_attribution(le.fit_binary(x.where("split = 0")), x.where("split = 2"), 4, "position")


@query("a21_representation_quality")
def _a21(spark, d):
    return le.representation_quality(fx.table(spark, d, "embeddings").withColumn("attack", F.col("label") % 2 == 1), "embedding", "attack")
