"""Packets to flows: interval attribution, edges, clock alignment and joins along the map."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wiresift.functions.scalars import flow_epoch
from wiresift.plans.ordering import ROWS_PER_CHUNK, dense_id, keyed_scan
from wiresift.session import pinned

RADIX, TOP_LEVEL = 8, 13  # levels of the containment index: nodes up to 8^13 us, about six days


def build_edges(flows: DataFrame) -> DataFrame:
    """Flows as timestamped host-to-host edges; rows with an endpoint, port or protocol missing or unusable are dropped."""
    num = lambda c: F.col(f"`{c}`").try_cast("double")
    e = flows.select(
        flow_epoch(F.col("Timestamp")).alias("timestamp"), "flow_key", F.col("`Src IP`").alias("src_ip"), num("Src Port").cast("int").alias("src_port"),
        F.col("`Dst IP`").alias("dst_ip"), num("Dst Port").cast("int").alias("dst_port"), num("Protocol").cast("smallint").alias("protocol"),
        num("Flow Duration").alias("duration"), num("Tot Fwd Pkts").alias("fwd_packets"), num("Tot Bwd Pkts").alias("bwd_packets"),
        "Label", "attack_name", "label_source", "label_confidence", "label_direction")
    return e.na.drop(subset=["timestamp", "src_ip", "dst_ip", "src_port", "dst_port", "protocol"])


def radix_cover(df: DataFrame, start: str, end: str) -> DataFrame:
    """Explode each row into the fewest nodes (`level`, `node`) whose union is exactly [start, end].

    A node of level l is RADIX^l wide and aligned. The whole nodes inside the interval are [a, b) at each level; the level
    above takes all of them but a few at either end, and where it holds none, every one stays at this level.
    """
    edge = f"pow({RADIX}D, l)"
    up = f"pow({RADIX}D, l + 1)"
    expr = f"""
    transform(sequence(0, {TOP_LEVEL}), l -> named_struct(
      'l', l, 'a', CAST(ceil({start} / {edge}) AS BIGINT), 'b', CAST(floor(({end} + 1) / {edge}) AS BIGINT),
      'p', CAST(ceil({start} / {up}) AS BIGINT) * {RADIX}, 'q', CAST(floor(({end} + 1) / {up}) AS BIGINT) * {RADIX}))"""
    nodes = """
    flatten(transform(_spans, x -> transform(
      CASE WHEN x.a >= x.b THEN array()
           WHEN x.l = %d OR x.p >= x.q THEN sequence(x.a, x.b - 1)
           ELSE concat(IF(x.a < x.p, sequence(x.a, x.p - 1), array()), IF(x.q < x.b, sequence(x.q, x.b - 1), array())) END,
      n -> named_struct('level', x.l, 'node', n))))""" % TOP_LEVEL
    return df.withColumn("_spans", F.expr(expr)).select(*df.columns, F.inline(F.expr(nodes)))


def map_packets_to_flows(packets: DataFrame, flows: DataFrame, slack_us: int = 1_000_000, rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """The flow each packet belongs to: the latest-starting window of its key that holds it, ties to the widest.

    packets: frame_no, flow_key, us.  flows: flow_uid, flow_key, start_us, end_us (before slack).  Every packet is kept.

    One sorted pass finds the latest window begun by each packet, however many packets or windows share a key. Only
    packets already past that window's end go to a second step, where windows become aligned nodes (one best window per
    node) and each packet looks up its ancestors: equi-joins on unique keys, so no packet meets all windows of its key.
    """
    f = flows.select("flow_key", "flow_uid", "start_us", (F.col("end_us") + slack_us).alias("end_us"))
    none = lambda t: F.lit(None).cast(t)
    both = f.select("flow_key", F.col("start_us").alias("us"), F.lit(0).alias("kind"), "end_us", "flow_uid", none("bigint").alias("frame_no")).unionByName(
        packets.select("flow_key", "us", F.lit(1).alias("kind"), none("bigint").alias("end_us"), none("string").alias("flow_uid"), "frame_no"))
    both = dense_id(both, ["flow_key", "us", "kind", "end_us", "flow_uid", "frame_no"], "_pos")
    window = F.when(F.col("kind") == 0, F.struct(F.col("us").alias("start_us"), "end_us", "flow_uid"))
    found = keyed_scan(both, ["flow_key"], "_pos", lasts={"latest": window}, rows_per_chunk=rows_per_chunk).where("kind = 1").select(
        "frame_no", "flow_key", "us", F.col("latest.flow_uid").alias("uid"), F.col("latest.end_us").alias("until"))
    found = pinned(found)  # read for the packets past their window and for the answer
    past = pinned(found.where(F.col("uid").isNotNull() & (F.col("us") > F.col("until"))))  # few packets, read twice
    nodes = radix_cover(f.join(past.select("flow_key").distinct(), "flow_key", "left_semi"), "start_us", "end_us")
    best = pinned(nodes.groupBy("flow_key", "level", "node").agg(F.max(F.struct("start_us", "end_us", "flow_uid")).alias("w")))
    levels = sorted(r[0] for r in best.select("level").distinct().collect()) or [0]  # at most TOP_LEVEL + 1 numbers
    node = lambda l: F.floor(F.col("us") / F.pow(F.lit(float(RADIX)), l)).cast("bigint")
    up = past.select("frame_no", "flow_key", F.inline(F.array(*[F.struct(F.lit(l).alias("level"), node(F.lit(l)).alias("node")) for l in levels])))
    inner = up.join(best, ["flow_key", "level", "node"]).groupBy("frame_no").agg(F.max("w").alias("w")).select(
        "frame_no", F.col("w.flow_uid").alias("inner_uid"))
    return found.join(inner, "frame_no", "left").select(
        "frame_no", F.when(F.col("us") <= F.col("until"), F.col("uid")).otherwise(F.col("inner_uid")).alias("flow_uid"), "flow_key")


def load_joined(packets: DataFrame, packet_map: DataFrame, flows: DataFrame) -> DataFrame:
    """Packets with their flow's columns, null where unattributed; colliding flow names get `_flow`."""
    p = packets.join(packet_map.select("frame_no", "flow_uid"), "frame_no", "left")
    renamed = flows.select(*[F.col(f"`{c}`").alias(c if c == "flow_uid" or c not in packets.columns else f"{c}_flow") for c in flows.columns])
    return p.join(renamed, "flow_uid", "left")


def clock_shift(flows: DataFrame, packets: DataFrame) -> DataFrame:
    """One row `shift_s`: the meter clock's offset from packet time in whole quarter hours, 0 unless well supported.

    flows: flow_key, t (meter seconds).  packets: flow_key, t (mapped packet seconds).
    """
    from wiresift.plans.ordering import median_of
    a = flows.where(F.col("t").isNotNull()).groupBy("flow_key").agg(F.min("t").alias("meter"))
    b = packets.groupBy("flow_key").agg(F.min("t").alias("wire"))
    deltas = a.join(b, "flow_key").select((F.col("meter") - F.col("wire")).alias("delta"))
    mid = median_of(deltas, "delta").select((F.rint(F.col("_median") / 900.0) * 900.0).alias("shift_s"))
    near = F.abs(F.col("delta") - F.col("shift_s")) < 120
    stats = deltas.join(F.broadcast(mid), F.lit(True)).agg(
        F.max("shift_s").alias("shift_s"), F.count(F.lit(1)).alias("keys"), F.avg(near.cast("double")).alias("share"))
    ok = (F.col("keys") >= 2) & (F.abs("shift_s") >= 900) & (F.col("share") >= 0.75)
    return stats.select(F.when(F.coalesce(ok, F.lit(False)), F.col("shift_s")).otherwise(0.0).alias("shift_s"), "keys")


def complete_flows(flows: DataFrame, mapped: DataFrame, start: float, cutoff: float, hold: float = 120.0) -> DataFrame:
    """Flows that began inside the capture with room on both ends: first packet time, else meter time.

    flows: flow_uid, meter_t.  mapped: flow_uid, t.
    """
    first = mapped.where(F.col("flow_uid").isNotNull()).groupBy("flow_uid").agg(F.min("t").alias("first_t"))
    began = F.coalesce("first_t", "meter_t")
    return flows.join(first, "flow_uid", "left").withColumn("began", began).where(
        F.col("began").between(start + hold, cutoff - hold)).drop("first_t")


def attached_share(packet_map: DataFrame, flows: DataFrame) -> DataFrame:
    """Packets whose key has a flow, how many of them have no uid, and the pass mark of 99.9%."""
    keyed = packet_map.join(flows.select("flow_key").distinct(), "flow_key", "left_semi")
    lost = F.count(F.when(F.col("flow_uid").isNull(), 1))
    share = F.when(F.count(F.lit(1)) > 0, 1 - lost / F.count(F.lit(1))).otherwise(1.0)
    return keyed.agg(F.count(F.lit(1)).alias("has_flow"), lost.alias("lost"), F.round(share, 9).alias("share"), (share >= 0.999).alias("passed"))


def tcp_flag_share(packets: DataFrame) -> DataFrame:
    any_flag = (F.col("tcp_flag_syn") == 1) | (F.col("tcp_flag_ack") == 1) | (F.col("tcp_flag_fin") == 1) | (F.col("tcp_flag_rst") == 1)
    n, k = F.count(F.lit(1)), F.count(F.when(any_flag, 1))
    return packets.where("protocol = 6").agg(n.alias("tcp"), k.alias("flagged"),
                                              F.when(n > 0, k / n >= 0.9).otherwise(True).alias("passed"))
