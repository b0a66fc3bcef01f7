"""Flow meters: per-flow statistics, TCP state and start-anchored segmentation."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wiresift.functions.scalars import half_away
from wiresift.operators import segments
from wiresift.operators.telemetry import with_window
from wiresift.plans.ordering import ROWS_PER_CHUNK, keyed_scan, per_key
from wiresift.session import pinned
from wiresift.sources.schemas import FLOW_STATISTICS

IDLE_US = 5_000_000
TIMEOUT_US = 120_000_000


def _sided(packets: DataFrame) -> DataFrame:
    """Add `side`: which of the two endpoints sent the packet, by text order, so that it needs no look at the first packet."""
    a, b = F.concat_ws(":", "src_ip", "src_port"), F.concat_ws(":", "dst_ip", "dst_port")
    return packets.withColumn("side", (a > b).cast("int"))


def flow_statistics(packets: DataFrame, key: str = "flow_uid", idle_us: int = IDLE_US, rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """The flow meter's 76 statistics per flow; forward is the first packet's orientation.

    Both sides are aggregated under a fixed name and swapped at the end, so direction costs no join. Gaps come from
    chunked scans, everything else is one hash aggregate with map-side combine: a flow of any length is fine.
    `IAT Tot` is the sum of the gaps.
    """
    def chain(p: DataFrame, cut) -> DataFrame:
        p = keyed_scan(p, [key], "frame_no", lags={"_prev": F.col("us")}, rows_per_chunk=cut)
        p = keyed_scan(p, [key, "side"], "frame_no", lags={"_prev_side": F.col("us")}, rows_per_chunk=cut)
        raw = F.col("us") - F.col("_prev")
        p = p.withColumns({
            "_gap": F.greatest(raw, F.lit(0)).cast("double"), "_side_gap": F.greatest(F.col("us") - F.col("_prev_side"), F.lit(0)).cast("double"),
            "_break": F.coalesce((raw >= idle_us).cast("int"), F.lit(0)), "_idle": F.when(raw >= idle_us, raw.cast("double")),
            "_len": F.col("length").cast("double"), "_hdr": F.col("header_len").cast("double")})
        return keyed_scan(p, [key], "frame_no", sums={"_island": F.col("_break")}, rows_per_chunk=cut)
    flags = [c for c in packets.columns if c.startswith("tcp_flag_")]
    used = [key, "frame_no", "us", "length", "header_len", "payload_len", "tcp_window", *flags]
    # read twice below: the scans are done once
    p = pinned(per_key(_sided(packets).select(*dict.fromkeys(used), "side"), [key], rows_per_chunk, chain).drop("_prev", "_prev_side"))
    spans = p.groupBy(key, "_island").agg((F.max_by("us", "frame_no") - F.min_by("us", "frame_no")).cast("double").alias("_active"))
    active = F.when(F.col("_active") > 0, F.col("_active"))
    spans = spans.groupBy(key).agg(F.avg(active).alias("_a_mean"), F.stddev_samp(active).alias("_a_sd"), F.max(active).alias("_a_max"), F.min(active).alias("_a_min"))

    def five(name: str, v: Column) -> list[Column]:
        return [F.count(v).alias(f"{name}_n"), F.sum(v).alias(f"{name}_sum"), F.avg(v).alias(f"{name}_mean"),
                F.stddev_samp(v).alias(f"{name}_sd"), F.max(v).alias(f"{name}_max"), F.min(v).alias(f"{name}_min")]
    flag = lambda f: F.sum(F.col(f"tcp_flag_{f}")).cast("double")
    aggs = [F.min_by("side", "frame_no").alias("_first_side"), F.min_by("us", "frame_no").alias("_start"), F.max("us").alias("_last"),
            *five("all", F.col("_len")), *five("gap", F.col("_gap")), *five("idle", F.col("_idle"))]
    aggs += [flag(f).alias(f"flag_{f}") for f in ("fin", "syn", "rst", "psh", "ack", "urg")]
    aggs += [F.sum(F.coalesce(F.col(c), F.lit(0))).cast("double").alias(c) for c in ("tcp_flag_cwr", "tcp_flag_ece") if c in packets.columns]
    for s in (0, 1):
        mine = F.col("side") == s
        own = lambda c: F.when(mine, c)
        aggs += [*five(f"s{s}_len", own(F.col("_len"))), *five(f"s{s}_gap", own(F.col("_side_gap"))),
                 F.sum(own(F.col("tcp_flag_psh"))).alias(f"s{s}_psh"), F.sum(own(F.col("tcp_flag_urg"))).alias(f"s{s}_urg"),
                 F.sum(own(F.col("_hdr"))).alias(f"s{s}_hdr"), F.min(own(F.col("_hdr"))).alias(f"s{s}_hdr_min"),
                 F.min_by("tcp_window", F.when(mine & (F.col("tcp_window") > 0), F.col("frame_no"))).alias(f"s{s}_win"),
                 F.count(F.when(mine & (F.col("payload_len") > 0), 1)).alias(f"s{s}_act")]
    g = p.groupBy(key).agg(*aggs).join(spans, key)
    z = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    fwd = lambda n: z(F.when(F.col("_first_side") == 0, F.col(f"s0_{n}")).otherwise(F.col(f"s1_{n}")))
    bwd = lambda n: z(F.when(F.col("_first_side") == 0, F.col(f"s1_{n}")).otherwise(F.col(f"s0_{n}")))
    dur = F.greatest(F.col("_last") - F.col("_start"), F.lit(0)).cast("double")
    per_s = lambda v: F.when(dur > 0, v / (dur / 1e6)).otherwise(0.0)
    col = lambda n: z(F.col(n))
    extra = lambda n: col(n) if n in packets.columns else F.lit(0.0)
    out = {
        "Flow Duration": dur, "Tot Fwd Pkts": fwd("len_n"), "Tot Bwd Pkts": bwd("len_n"), "TotLen Fwd Pkts": fwd("len_sum"), "TotLen Bwd Pkts": bwd("len_sum"),
        "Flow Byts/s": per_s(col("all_sum")), "Flow Pkts/s": per_s(col("all_n")),
        "Flow IAT Mean": col("gap_mean"), "Flow IAT Std": col("gap_sd"), "Flow IAT Max": col("gap_max"), "Flow IAT Min": col("gap_min"),
        "Fwd Pkts/s": per_s(fwd("len_n")), "Bwd Pkts/s": per_s(bwd("len_n")),
        "Pkt Len Min": col("all_min"), "Pkt Len Max": col("all_max"), "Pkt Len Mean": col("all_mean"), "Pkt Len Std": col("all_sd"), "Pkt Len Var": col("all_sd") * col("all_sd"),
        "FIN Flag Cnt": col("flag_fin"), "SYN Flag Cnt": col("flag_syn"), "RST Flag Cnt": col("flag_rst"), "PSH Flag Cnt": col("flag_psh"),
        "ACK Flag Cnt": col("flag_ack"), "URG Flag Cnt": col("flag_urg"), "CWE Flag Count": extra("tcp_flag_cwr"), "ECE Flag Cnt": extra("tcp_flag_ece"),
        "Down/Up Ratio": F.when(fwd("len_n") > 0, bwd("len_n") / fwd("len_n")).otherwise(0.0),
        "Pkt Size Avg": col("all_mean"), "Fwd Seg Size Avg": fwd("len_mean"), "Bwd Seg Size Avg": bwd("len_mean"),
        "Subflow Fwd Pkts": fwd("len_n"), "Subflow Fwd Byts": fwd("len_sum"), "Subflow Bwd Pkts": bwd("len_n"), "Subflow Bwd Byts": bwd("len_sum"),
        "Init Fwd Win Byts": fwd("win"), "Init Bwd Win Byts": bwd("win"), "Fwd Act Data Pkts": fwd("act"), "Fwd Seg Size Min": fwd("hdr_min"),
        "Active Mean": col("_a_mean"), "Active Std": col("_a_sd"), "Active Max": col("_a_max"), "Active Min": col("_a_min"),
        "Idle Mean": col("idle_mean"), "Idle Std": col("idle_sd"), "Idle Max": col("idle_max"), "Idle Min": col("idle_min"),
    }
    for name, pick in (("Fwd", fwd), ("Bwd", bwd)):
        out |= {f"{name} Pkt Len {s}": pick(f"len_{k}") for s, k in (("Max", "max"), ("Min", "min"), ("Mean", "mean"), ("Std", "sd"))}
        out |= {f"{name} IAT {s}": pick(f"gap_{k}") for s, k in (("Tot", "sum"), ("Mean", "mean"), ("Std", "sd"), ("Max", "max"), ("Min", "min"))}
        out |= {f"{name} PSH Flags": pick("psh"), f"{name} URG Flags": pick("urg"), f"{name} Header Len": pick("hdr")}
        out |= {f"{name} {s}": F.lit(0.0) for s in ("Byts/b Avg", "Pkts/b Avg", "Blk Rate Avg")}
    return g.select(key, *[out[c].alias(c) for c in FLOW_STATISTICS])


def tcp_progress(packets: DataFrame, key: str = "flow_key", rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """Per packet: how far its flow's TCP handshake and teardown had come before it.

    The state machine only moves forward, so it reduces to running facts: a bare SYN was seen, the connection was
    established (a SYN-ACK, or a pure ACK after a SYN), how many FINs followed, whether a RST was seen.
    """
    return per_key(_sided(packets), [key], rows_per_chunk, lambda p, cut: _progress(p, key, cut))


def _progress(p: DataFrame, key: str, cut) -> DataFrame:
    on = lambda f: F.col(f"tcp_flag_{f}") == 1
    tcp = F.col("protocol") == 6
    p = p.withColumns({
        "_syn": (tcp & on("syn") & ~on("ack")).cast("int"), "_synack": (tcp & on("syn") & on("ack")).cast("int"),
        "_pure": (tcp & on("ack") & ~on("syn") & ~on("fin") & ~on("rst")).cast("int"),
        "_fin": (tcp & on("fin")).cast("int"), "_rst": (tcp & on("rst")).cast("int")})
    p = keyed_scan(p, [key], "frame_no", maxes={"_syn_seen": F.col("_syn"), "_synack_seen": F.col("_synack"), "_rst_seen": F.col("_rst")},
                   lags={"_prev": F.col("us")}, rows_per_chunk=cut)
    p = p.withColumn("_est", F.greatest(F.col("_synack"), F.col("_pure") * F.coalesce("_syn_seen", F.lit(0))))
    p = keyed_scan(p, [key], "frame_no", maxes={"_est_seen": F.col("_est")}, rows_per_chunk=cut)
    p = p.withColumn("_open_fin", F.col("_fin") * F.greatest(F.col("_est"), F.coalesce("_est_seen", F.lit(0))))
    p = keyed_scan(p, [key], "frame_no", sums={"_fins": F.col("_open_fin")}, rows_per_chunk=cut)
    return p.withColumn("fins_before", F.col("_fins") - F.col("_open_fin"))


def _state(protocol: Column, resets: Column, established: Column, fins: Column, syns: Column) -> Column:
    return (F.when(protocol == 17, "UDP_ACTIVE").when(protocol.isin(1, 58), "ICMP_ACTIVE").when(protocol != 6, "INIT").when(resets > 0, "RESET")
            .when((established == 1) & (fins >= 2), "CLOSED").when((established == 1) & (fins == 1), "FIN_WAIT").when(established == 1, "ESTABLISHED")
            .when(syns > 0, "SYN_SENT").otherwise("INIT"))


def flow_state(packets: DataFrame, key: str = "flow_key", rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """Per flow: final state, per-direction volumes and gaps. Forward is the first packet's orientation."""
    p = per_key(_sided(packets), [key], rows_per_chunk, lambda x, cut: keyed_scan(
        _progress(x, key, cut), [key, "side"], "frame_no", lags={"_prev_side": F.col("us")}, rows_per_chunk=cut))
    gap = (F.col("us") - F.col("_prev_side")).cast("double")
    p = p.withColumn("_gap", F.when(gap >= 0, gap))
    aggs = [F.min_by("side", "frame_no").alias("_first_side"), F.min_by("protocol", "frame_no").alias("protocol"),
            F.min_by("us", "frame_no").alias("_start"), F.max_by("us", "frame_no").alias("_last"), F.count(F.lit(1)).alias("total_packets"),
            F.sum("length").alias("total_bytes"), F.sum("_syn").alias("syn_count"), F.sum("_synack").alias("syn_ack_count"),
            F.sum("_fin").alias("fin_count"), F.sum("_rst").alias("rst_count"), F.max("_est").alias("_est"), F.sum("_open_fin").alias("_open_fins")]
    for s in (0, 1):
        own = lambda c: F.when(F.col("side") == s, c)
        aggs += [F.count(own(F.lit(1))).alias(f"s{s}_packets"), F.coalesce(F.sum(own(F.col("length"))), F.lit(0)).alias(f"s{s}_bytes"),
                 F.coalesce(F.sum(own(F.col("payload_len"))), F.lit(0)).alias(f"s{s}_payload_bytes"),
                 F.coalesce(half_away(F.avg(own(F.col("_gap"))), 1), F.lit(0.0)).alias(f"s{s}_iat_mean_us"),
                 F.coalesce(F.max(own(F.col("_gap"))), F.lit(0.0)).alias(f"s{s}_iat_max_us"),
                 F.coalesce(half_away(F.avg(own(F.col("length").cast("double"))), 1), F.lit(0.0)).alias(f"s{s}_pkt_len_mean")]
    g = p.groupBy(key).agg(*aggs)
    state = _state(F.col("protocol"), F.col("rst_count"), F.col("_est"), F.col("_open_fins"), F.col("syn_count"))
    parts = ("packets", "bytes", "payload_bytes", "iat_mean_us", "iat_max_us", "pkt_len_mean")
    pick = lambda n, a, b: F.when(F.col("_first_side") == 0, F.col(f"s{a}_{n}")).otherwise(F.col(f"s{b}_{n}"))
    return g.select(
        key, "protocol", state.alias("state"), half_away((F.col("_last") - F.col("_start")) / 1e6, 3).alias("duration_seconds"),
        F.col("_start").alias("start_us"), F.col("_last").alias("last_us"), "total_packets", "total_bytes",
        "syn_count", "syn_ack_count", "fin_count", "rst_count",
        *[pick(n, 0, 1).alias(f"fwd_{n}") for n in parts], *[pick(n, 1, 0).alias(f"bwd_{n}") for n in parts])


def corroborated_replies(packets: DataFrame, key: str = "flow_key", rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """Per packet: is it a reply its flow's own history corroborates (UDP after a request, TCP inside an established flow)?"""
    first = F.struct((-F.col("frame_no")).alias("order"), F.col("side").alias("side"))
    p = per_key(_sided(packets), [key], rows_per_chunk, lambda x, cut: keyed_scan(
        _progress(x, key, cut), [key], "frame_no", maxes={"_first": first}, rows_per_chunk=cut))
    reply = F.col("_first").isNotNull() & (F.col("side") != F.col("_first.side"))
    live = ((F.coalesce("_synack_seen", F.lit(0)) == 1) & (F.coalesce("_rst_seen", F.lit(0)) == 0) & (F.col("fins_before") < 2))
    return p.withColumn("corroborated", F.coalesce(reply & ((F.col("protocol") == 17) | live), F.lit(False)))


def active_flow_snapshot(state: DataFrame, window_start_us: int, window_end_us: int, n: int = 500) -> DataFrame:
    """Flows alive in a window, newest first."""
    return (state.where((F.col("last_us") >= window_start_us) & (F.col("start_us") <= window_end_us))
            .orderBy(F.col("last_us").desc(), state.columns[0]).limit(n))


def active_flows(packets: DataFrame, seconds: int = 10, n: int = 500, key: str = "flow_key", t0: int | None = None, rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """Per window the flows that had a packet in it, each as its record stood at the window's end; the `n` latest (ties by key).

    A flow meets only the windows it was active in: running facts are read off its last packet of each, and the limit per window works in each task before the shuffle.
    """
    first = F.struct((-F.col("frame_no")).alias("order"), F.col("us").alias("us"))
    p = per_key(_sided(with_window(packets, seconds, t0)), [key], rows_per_chunk, lambda x, cut: keyed_scan(
        _progress(x, key, cut), [key], "frame_no", maxes={"_first": first}, sums={"total_packets": F.lit(1), "total_bytes": F.col("length")}, rows_per_chunk=cut))
    so_far = lambda now, seen: F.greatest(F.col(now), F.coalesce(F.col(seen), F.lit(0)))
    record = F.struct("protocol", _state(F.col("protocol"), so_far("_rst", "_rst_seen"), so_far("_est", "_est_seen"), F.col("_fins"), so_far("_syn", "_syn_seen")).alias("state"),
                      F.coalesce(F.col("_first.us"), F.col("us")).alias("start_us"), F.col("us").alias("last_us"), "total_packets", "total_bytes")
    last = p.groupBy("window_index", key).agg(F.max_by(record, "frame_no").alias("r")).select("window_index", key, "r.*")
    newest = Window.partitionBy("window_index").orderBy(F.col("last_us").desc(), key)
    return last.withColumn("_place", F.row_number().over(newest)).where(F.col("_place") <= n).drop("_place")


def segment_packets(packets: DataFrame, timeout_us: int = TIMEOUT_US, rows_per_chunk: int = segments.ROWS) -> DataFrame:
    """Assign every IPv4 TCP/UDP packet to a flow segment: `segment_key`, `segment` (its first frame), `opens`.

    A segment ends with a FIN (unless the FIN opened it) or when a packet comes more than `timeout_us` after the
    segment's start; that packet opens the next one. Conversations of more than `rows_per_chunk` packets are cut into chunks.
    """
    p = _sided(packets.where(F.col("protocol").isin(6, 17) & ~F.col("src_ip").contains(":")))
    lo, hi = F.concat_ws(":", "src_ip", "src_port"), F.concat_ws(":", "dst_ip", "dst_port")
    key = F.concat_ws("|", F.least(lo, hi), F.greatest(lo, hi), F.col("protocol").cast("string")).alias("segment_key")
    fin = F.when(F.col("protocol") == 6, F.col("tcp_flag_fin")).otherwise(0).cast("int").alias("fin")
    return segments.assign(p.select(key, "frame_no", "us", fin, "side", "length", "src_ip", "dst_ip", "src_port", "dst_port", "protocol"), timeout_us, rows_per_chunk)


def segment_flows(packets: DataFrame, timeout_us: int = TIMEOUT_US, forget_us: int = 3_600_000_000, rows_per_chunk: int = segments.ROWS) -> DataFrame:
    """One row per segment of at least two packets, with its orientation.

    A segment that follows a timeout keeps the orientation before it, as long as it comes within `forget_us`; one that
    follows a FIN, or a longer silence, is oriented by its own first packet.
    """
    s = segment_packets(packets, timeout_us, rows_per_chunk)
    g = s.groupBy("segment_key", "segment").agg(
        F.count(F.lit(1)).alias("packets"), F.sum("length").alias("bytes"), F.min_by("us", "frame_no").alias("start_us"), F.max("us").alias("end_us"),
        F.first("segment").alias("first_frame"), F.max(F.when(F.col("opens") == 0, F.col("fin")).otherwise(0)).alias("closed_by_fin"),
        F.min_by(F.struct("src_ip", "src_port", "dst_ip", "dst_port", "protocol"), "frame_no").alias("ends"))

    def chains(x: DataFrame, cut) -> DataFrame:
        x = keyed_scan(x, ["segment_key"], "first_frame", lags={"_fin_before": F.col("closed_by_fin"), "_start_before": F.col("start_us")}, rows_per_chunk=cut)
        fresh = (F.col("_fin_before") == 1) | (F.col("start_us") - F.col("_start_before") - timeout_us > forget_us)
        return keyed_scan(x.withColumn("_fresh", F.coalesce(fresh.cast("int"), F.lit(0))), ["segment_key"], "first_frame", sums={"_chain": F.col("_fresh")}, rows_per_chunk=cut)
    g = per_key(pinned(g), ["segment_key"], rows_per_chunk, chains)  # one row per segment, read twice below
    lead = g.groupBy("segment_key", "_chain").agg(F.min_by("ends", "first_frame").alias("o"))
    return g.where("packets > 1").join(lead, ["segment_key", "_chain"]).select(
        "segment_key", "segment", "packets", "bytes", "start_us", "end_us", "first_frame", "closed_by_fin", "o.*")
