"""Tumbling-window telemetry, host graphs and host windows."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wiresift.functions.scalars import (fragment_flag, half_away, illegal_flags, payload_bucket, protocol_name,
                                        tcp_flag_class)
from wiresift.plans.ordering import ROWS_PER_CHUNK, keyed_scan, per_key

US = 1_000_000
BUCKETS = ["0_64", "65_512", "513_1024", "1025_1500", "1501_plus"]


def time_range(packets: DataFrame) -> tuple[int | None, int | None]:
    """Times of the first and the last packet, read once: two numbers that every branch of a plan then knows."""
    return tuple(packets.agg(F.min("us"), F.max("us")).first())


def with_window(packets: DataFrame, seconds: int = 10, t0: int | None = None) -> DataFrame:
    """Add `window_index`, counted from the first packet's time (`t0` if it is known already)."""
    begin = F.lit(time_range(packets)[0] if t0 is None else t0).cast("bigint")
    width = seconds * US
    return packets.withColumn("window_index", F.floor((F.col("us") - begin) / F.lit(width)).cast("bigint")).withColumn(
        "window_start_us", begin + F.col("window_index") * width)


def packet_windows(packets: DataFrame, seconds: int = 10, t0: int | None = None) -> DataFrame:
    """Windowed packets with the per-packet flags all window operators share."""
    p = with_window(packets, seconds, t0)
    on = lambda f: F.col(f"tcp_flag_{f}")
    tcp = F.col("protocol") == 6
    return p.withColumns({
        "proto": protocol_name(F.col("protocol")), "is_tcp": tcp,
        "fragmented": fragment_flag(F.col("ip_flag_mf"), F.col("ip_frag_offset")),
        "scan_class": F.when(tcp, tcp_flag_class(*[on(f) for f in ("syn", "ack", "fin", "rst", "psh", "urg")])),
        "illegal": F.when(tcp, illegal_flags(on("syn"), on("fin"), on("rst"))),
        "syn_only": tcp & (on("syn") == 1) & (on("ack") == 0), "syn_ack": tcp & (on("syn") == 1) & (on("ack") == 1),
        "bucket": payload_bucket(F.col("payload_len"))})


def _count(cond: Column) -> Column:
    return F.count(F.when(cond, 1))


def window_gaps(p: DataFrame, rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """Per window: inter-arrival gaps in arrival order; a backward step yields no gap but still moves the clock."""
    g = keyed_scan(p.select("window_index", "frame_no", "us"), ["window_index"], "frame_no",
                   lags={"prev_us": F.col("us")}, rows_per_chunk=rows_per_chunk)
    gap = (F.col("us") - F.col("prev_us")).cast("double")
    gap = F.when(gap >= 0, gap)
    return g.groupBy("window_index").agg(
        F.count(gap).alias("iat_n"), F.sum(gap).alias("iat_s"), F.sum(gap * gap).alias("iat_ss"),
        F.min(gap).alias("iat_lo"), F.max(gap).alias("iat_hi"))


def window_retransmissions(p: DataFrame, rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """Per window: TCP packets seen more than 2 ms after the first packet with the same endpoints, sequence and length."""
    key = ["window_index", "src_ip", "src_port", "dst_ip", "dst_port", "tcp_seq", "payload_len"]
    data = (F.col("protocol") == 6) & ((F.col("payload_len") > 0) | (F.col("tcp_flag_syn") == 1) | (F.col("tcp_flag_fin") == 1))
    q = p.where(data).select(*key, "frame_no", "us")
    first = F.struct((-F.col("frame_no")).alias("order"), F.col("us").alias("us"))
    # Large groups are looked for per source and window: counting the full keys would cost as much as the scan.
    s = per_key(q, ["window_index", "src_ip"], rows_per_chunk, lambda x, cut: keyed_scan(x, key, "frame_no", maxes={"first": first}, rows_per_chunk=cut))
    again = F.col("us") - F.col("first.us") > 2000
    return s.groupBy("window_index").agg(_count(again).alias("tcp_retransmissions_count"))


def window_telemetry(packets: DataFrame, seconds: int = 10, rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """One row per window from the first to the last packet, empty windows included.

    Plain sums and counts are one partial aggregate; distinct counts, gaps and retransmissions are separate
    aggregates on pruned columns, joined on the (small) window index.
    """
    t0, t1 = time_range(packets)
    p = packet_windows(packets, seconds, t0)
    tcp, udp, icmp = F.col("proto") == "TCP", F.col("proto") == "UDP", F.col("proto").isin("ICMP", "ICMPv6")
    dbl = lambda c: F.col(c).cast("double")

    def moments(name, cond):
        v = F.when(cond, dbl(name))
        return [F.count(v).alias(f"{name}_n"), F.sum(v).alias(f"{name}_s"), F.sum(v * v).alias(f"{name}_ss"),
                F.min(F.when(cond, F.col(name))).alias(f"{name}_lo"), F.max(F.when(cond, F.col(name))).alias(f"{name}_hi")]
    flag = lambda f: _count(tcp & (F.col(f"tcp_flag_{f}") == 1)).alias(f"{f}_count")
    base = p.groupBy("window_index").agg(
        F.count(F.lit(1)).alias("total_packets"), F.sum("length").alias("total_bytes"),
        *moments("ttl", F.lit(True)), *moments("tcp_window", tcp), *moments("payload_len", F.lit(True)),
        _count(F.col("fragmented")).alias("fragmented_packets_count"),
        *[_count(F.col("bucket") == b).alias(f"payload_{b}") for b in BUCKETS],
        _count(tcp).alias("tcp_packets"), _count(F.col("syn_only")).alias("syn_count"),
        _count(F.col("syn_ack")).alias("syn_ack_count"), *[flag(f) for f in ("ack", "rst", "fin", "psh", "urg")],
        _count(udp).alias("udp_packets"), F.sum(F.when(udp, F.col("length"))).alias("udp_bytes"),
        _count(F.col("is_dns")).alias("dns_packets"), F.sum(F.when(F.col("is_dns"), F.col("length"))).alias("dns_bytes"),
        _count(icmp).alias("icmp_packets"), F.sum(F.when(icmp, F.col("length"))).alias("icmp_bytes"),
        _count(F.col("is_icmp_echo")).alias("icmp_echo_requests"),
        _count(F.col("scan_class") == "NULL").alias("null_scan_packets"),
        _count(F.col("scan_class") == "XMAS").alias("xmas_scan_packets"),
        _count(F.col("scan_class") == "FIN").alias("fin_scan_packets"))
    port = lambda c: F.when(F.col(c) > 0, F.col(c))
    distinct = p.groupBy("window_index").agg(
        F.countDistinct("src_ip").alias("unique_source_ips"), F.countDistinct("dst_ip").alias("unique_destination_ips"),
        F.countDistinct(port("src_port")).alias("unique_source_ports"),
        F.countDistinct(port("dst_port")).alias("unique_destination_ports"))
    # A capture has few windows against its packets: the grid is one range between two numbers.
    windows = 0 if t0 is None else (t1 - t0) // (seconds * US) + 1
    grid = packets.sparkSession.range(windows).select(F.col("id").alias("window_index"), F.lit(t0).cast("bigint").alias("t0"))
    w = (grid.join(base, "window_index", "left").join(distinct, "window_index", "left")
         .join(window_gaps(p, rows_per_chunk), "window_index", "left")
         .join(window_retransmissions(p, rows_per_chunk), "window_index", "left"))
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    r2 = lambda c: half_away(c, 2)

    def mean_sd(name):
        n, s, ss = F.col(f"{name}_n"), F.col(f"{name}_s"), F.col(f"{name}_ss")
        mean = s / n
        var = ss / n - mean * mean
        zero = F.coalesce(n, F.lit(0)) == 0
        return (F.when(zero, 0.0).otherwise(r2(mean)), F.when(zero | (var <= 0), 0.0).otherwise(r2(F.sqrt(var))))
    span = F.lit(float(seconds))
    rate = lambda c: r2(z(c) / span)
    out = {"window_index": F.col("window_index"),
           "window_start": (F.col("t0") + F.col("window_index") * (seconds * US)) / F.lit(1e6),
           "window_end": (F.col("t0") + (F.col("window_index") + 1) * (seconds * US)) / F.lit(1e6),
           "duration_seconds": span}
    for c in ("total_packets", "total_bytes"):
        out[c] = z(c).cast("bigint")
    out["packets_per_second"], out["bytes_per_second"] = rate("total_packets"), rate("total_bytes")
    for src, name in (("ttl", "ttl"), ("tcp_window", "tcp_window"), ("payload_len", "payload"), ("iat", "iat")):
        unit = "_us" if name == "iat" else ""
        mean, sd = mean_sd(src)
        lo, hi = z(f"{src}_lo"), z(f"{src}_hi")
        if name == "iat":
            lo, hi = half_away(lo.cast("double"), 1), half_away(hi.cast("double"), 1)
        else:
            lo, hi = lo.cast("bigint"), hi.cast("bigint")
        out |= {f"{name}_mean{unit}": mean, f"{name}_stddev{unit}": sd, f"{name}_min{unit}": lo, f"{name}_max{unit}": hi}
    for c in ["fragmented_packets_count", *[f"payload_{b}" for b in BUCKETS], "tcp_retransmissions_count",
              "unique_source_ips", "unique_destination_ips", "unique_source_ports", "unique_destination_ports",
              "tcp_packets", "syn_count", "syn_ack_count", "ack_count", "rst_count", "fin_count", "psh_count", "urg_count",
              "udp_packets", "udp_bytes", "dns_packets", "dns_bytes", "icmp_packets", "icmp_bytes", "icmp_echo_requests",
              "null_scan_packets", "xmas_scan_packets", "fin_scan_packets"]:
        out[c] = z(c).cast("bigint")
    share = lambda a, b: F.when(z(b) > 0, half_away(z(a) / F.col(b), 4)).otherwise(0.0)
    out["fragmented_packets_ratio"] = share("fragmented_packets_count", "total_packets")
    out["tcp_retransmission_ratio"] = share("tcp_retransmissions_count", "tcp_packets")
    for c, n in (("syn_count", "syn_per_second"), ("ack_count", "ack_per_second"), ("rst_count", "rst_per_second"),
                 ("udp_packets", "udp_packets_per_second"), ("udp_bytes", "udp_bytes_per_second"),
                 ("dns_packets", "dns_packets_per_second"), ("dns_bytes", "dns_bytes_per_second"),
                 ("icmp_packets", "icmp_packets_per_second")):
        out[n] = rate(c)
    out["syn_ack_ratio"] = r2(F.when(z("syn_ack_count") > 0, z("syn_count") / F.col("syn_ack_count"))
                              .otherwise(z("syn_count").cast("double")))
    out["approx_incomplete_connections"] = F.greatest(F.lit(0), z("syn_count") - z("syn_ack_count")).cast("bigint")
    return w.select(*[c.alias(n) for n, c in out.items()])


def host_graph_edges(packets: DataFrame, seconds: int = 10, t0: int | None = None) -> DataFrame:
    """Directed host pairs per window with their counts, protocol set and flag counts."""
    p = packet_windows(packets, seconds, t0)
    return p.groupBy("window_index", "src_ip", "dst_ip").agg(
        F.count(F.lit(1)).alias("packet_count"), F.sum("length").alias("byte_count"),
        F.array_sort(F.collect_set("proto")).alias("protocols"),
        F.countDistinct(F.when(F.col("dst_port") > 0, F.col("dst_port"))).alias("distinct_dst_ports"),
        _count(F.col("is_tcp") & (F.col("tcp_flag_syn") == 1)).alias("syn_count"),
        _count(F.col("is_tcp") & (F.col("tcp_flag_ack") == 1)).alias("ack_count"),
        _count(F.col("is_tcp") & (F.col("tcp_flag_rst") == 1)).alias("rst_count"),
        _count(F.col("syn_only")).alias("bare_syn_count"), F.min("frame_no").alias("first_frame"))


def host_graph_nodes(packets: DataFrame, seconds: int = 10) -> DataFrame:
    """Per window and host: degrees, volumes, distinct ports contacted, handshakes begun. Built from the edge table."""
    t0 = time_range(packets)[0]
    e = host_graph_edges(packets, seconds, t0)
    zero = F.lit(0).cast("bigint")
    role = lambda ip, out: F.struct(
        ip.alias("ip"), F.lit(int(out)).alias("out"), F.lit(int(not out)).alias("inn"),
        (F.col("packet_count") if out else zero).alias("ps"), (zero if out else F.col("packet_count")).alias("pr"),
        (F.col("byte_count") if out else zero).alias("bs"), (zero if out else F.col("byte_count")).alias("br"),
        (F.col("bare_syn_count") if out else zero).alias("inc"))
    roles = e.select("window_index", "first_frame", F.inline(F.array(role(F.col("src_ip"), True), role(F.col("dst_ip"), False))))
    nodes = roles.groupBy("window_index", "ip").agg(
        F.sum("out").alias("out_degree"), F.sum("inn").alias("in_degree"), F.sum("ps").alias("packets_sent"),
        F.sum("pr").alias("packets_received"), F.sum("bs").alias("bytes_sent"), F.sum("br").alias("bytes_received"),
        F.sum("inc").alias("incomplete_conns_initiated"), F.min("first_frame").alias("first_frame"))
    ports = with_window(packets, seconds, t0).where("dst_port > 0").groupBy("window_index", F.col("src_ip").alias("ip")).agg(
        F.countDistinct("dst_port").alias("distinct_ports_contacted"))
    return nodes.join(ports, ["window_index", "ip"], "left").withColumn(
        "distinct_ports_contacted", F.coalesce("distinct_ports_contacted", F.lit(0)).cast("bigint"))


def cap_by_first_seen(graph: DataFrame, n: int) -> DataFrame:
    """Optional size limit per window: keep the `n` nodes or edges that appeared first."""
    w = Window.partitionBy("window_index").orderBy("first_frame", *[c for c in ("ip", "src_ip", "dst_ip") if c in graph.columns])
    return graph.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n).drop("_rank")


def graph_density(packets: DataFrame, seconds: int = 10) -> DataFrame:
    e = with_window(packets, seconds).select("window_index", "src_ip", "dst_ip").distinct()
    edges = e.groupBy("window_index").agg(F.count(F.lit(1)).alias("total_edges"))
    hosts = e.select("window_index", F.explode(F.array("src_ip", "dst_ip")).alias("ip")).groupBy("window_index").agg(
        F.countDistinct("ip").alias("total_nodes"))
    n = F.col("total_nodes")
    return hosts.join(edges, "window_index").withColumn(
        "density", F.when(n > 1, half_away(F.col("total_edges") / (n * (n - 1)).cast("double"), 4)).otherwise(0.0))


def dns_hostnames(answers: DataFrame, ip: str = "ip", hostname: str = "hostname") -> DataFrame:
    """Sorted distinct names per address, from answer rows only; empty parts are skipped."""
    return (answers.where((F.col(ip) != "") & (F.col(hostname) != "")).select(ip, hostname).distinct()
            .groupBy(ip).agg(F.array_sort(F.collect_list(hostname)).alias("hostnames")))


def direction_totals(nodes: DataFrame, local_ips: DataFrame) -> DataFrame:
    """In/out bytes and packets of the local host set."""
    return nodes.join(local_ips, "ip", "left_semi").agg(
        F.coalesce(F.sum("bytes_received"), F.lit(0)).alias("bytes_in"), F.coalesce(F.sum("bytes_sent"), F.lit(0)).alias("bytes_out"),
        F.coalesce(F.sum("packets_received"), F.lit(0)).alias("packets_in"),
        F.coalesce(F.sum("packets_sent"), F.lit(0)).alias("packets_out"))


def top_nodes(nodes: DataFrame, n: int) -> DataFrame:
    return nodes.orderBy((F.col("packets_sent") + F.col("packets_received")).desc(), "ip").limit(n)


def top_edges(edges: DataFrame, n: int) -> DataFrame:
    return edges.orderBy(F.col("packet_count").desc(), "src_ip", "dst_ip").limit(n)


def newest(df: DataFrame, order: list, n: int) -> DataFrame:
    """The last `n` rows of an ordering (bounded histories and snapshots)."""
    return df.orderBy(*[F.col(c).desc() for c in order]).limit(n)


HOST_FEATURES = ["out_flows", "out_peers", "out_ports", "out_packets", "out_mean_dur", "in_flows", "in_peers",
                 "listen_ports", "in_packets"]


def host_windows(edges: DataFrame, seconds: int = 10) -> DataFrame:
    """Per window and host: what it dialled and what reached it; a full outer join of the two sides.

    A host's label is that of any attack touching it in the window (the smallest name if several do).
    """
    e = edges.withColumn("window_start", (F.floor(F.col("timestamp") / seconds) * seconds).cast("double"))
    out = e.groupBy("window_start", F.col("src_ip").alias("ip")).agg(
        F.count(F.lit(1)).cast("double").alias("out_flows"), F.countDistinct("dst_ip").cast("double").alias("out_peers"),
        F.countDistinct("dst_port").cast("double").alias("out_ports"), F.sum("fwd_packets").cast("double").alias("out_packets"),
        F.avg(F.col("duration") / 1e6).alias("out_mean_dur"))
    inn = e.groupBy("window_start", F.col("dst_ip").alias("ip")).agg(
        F.count(F.lit(1)).cast("double").alias("in_flows"), F.countDistinct("src_ip").cast("double").alias("in_peers"),
        F.countDistinct("dst_port").cast("double").alias("listen_ports"), F.sum("bwd_packets").cast("double").alias("in_packets"))
    attack = e.where(F.col("label") != "Benign").select(
        "window_start", "label", F.explode(F.array("src_ip", "dst_ip")).alias("ip")).groupBy("window_start", "ip").agg(
        F.min("label").alias("label"))
    return out_in_host_join(out, inn).join(attack, ["window_start", "ip"], "left").fillna({"label": "Benign"})


def out_in_host_join(out: DataFrame, inn: DataFrame) -> DataFrame:
    """Full outer join of the two host sides; a missing side counts as zero."""
    return out.join(inn, ["window_start", "ip"], "full").fillna(0.0, HOST_FEATURES)
