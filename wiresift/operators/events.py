"""The event stream: packet aggregates, observation budget, ids, history features and the joins around them."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wiresift.functions.addresses import gvcp_discovery_flag, routine_dns_flag
from wiresift.functions.scalars import clean_rate, fragment_flag, is_reversed
from wiresift.operators.features import orient_record
from wiresift.plans.ordering import ROWS_PER_CHUNK, dense_id, keyed_scan, per_key
from wiresift.plans.sizes import HOSTS, broadcast_if_small
from wiresift.session import pinned
from wiresift.sources.schemas import AGGREGATES, EVENT_COLUMNS, RECORD_STATISTICS

K = 20
BUDGET_S = 0.010
EARLY, COMPLETED = "early_observation", "completed_before_budget"
FLAGS = ["syn", "ack", "fin", "rst", "psh", "urg"]


def first_k(mapped: DataFrame, k: int = K) -> DataFrame:
    """The first `k` packets of each flow with `slot` and `gap_s` (null on the first).

    The rank filter becomes a per-task group limit before the shuffle, so a flood flow never moves more than k rows
    per map task.
    """
    w = Window.partitionBy("flow_uid").orderBy("frame_no")
    head = mapped.where(F.col("flow_uid").isNotNull()).withColumn("slot", F.row_number().over(w)).where(F.col("slot") <= k)
    return head.withColumns({
        "gap_s": (F.col("us") - F.lag("us").over(w)) / F.lit(1e6), "first_sender": F.first("src_ip").over(w)})


def _aggregates(keep: Column | None = None, gap: str = "gap_s") -> list[Column]:
    """The twenty aggregates over rows where `keep`; sample deviations, nothing null."""
    v = lambda c: F.col(c).cast("double") if keep is None else F.when(keep, F.col(c).cast("double"))
    z = lambda c: F.coalesce(c, F.lit(0.0))
    out = {"pkt_n": F.count(v("length")).cast("double")}
    for name, c in (("pkt_len", "length"), ("ttl", "ttl"), ("win", "tcp_window"), ("iat", gap)):
        out[f"{name}_mean"], out[f"{name}_std"] = z(F.avg(v(c))), z(F.stddev_samp(v(c)))
    out["iat_max"] = z(F.max(v(gap)))
    out |= {f"{f}_n": z(F.sum(v(f"tcp_flag_{f}"))) for f in FLAGS}
    has = (F.col("payload_len") > 0).cast("double")
    frag = fragment_flag(F.col("ip_flag_mf"), F.col("ip_frag_offset")).cast("double")
    masked = lambda c: c if keep is None else F.when(keep, c)
    out |= {"payload_bytes": z(F.sum(v("payload_len"))), "payload_frac": z(F.avg(masked(has))),
            "retrans_n": z(F.sum(v("tcp_retransmission"))), "frag_n": z(F.sum(masked(frag)))}
    return [out[c].alias(c) for c in AGGREGATES]


def first_k_packet_aggregates(mapped: DataFrame, k: int = K) -> DataFrame:
    """Per flow: corrected start, the twenty aggregates of its first packets, and the sender of a bare first SYN."""
    head = first_k(mapped, k)
    bare = (F.col("slot") == 1) & (F.col("tcp_flag_syn") == 1) & (F.col("tcp_flag_ack") == 0)
    return head.groupBy("flow_uid").agg(
        (F.min("us") / F.lit(1e6)).alias("t"), *_aggregates(), F.max(F.when(bare, F.col("src_ip"))).alias("syn_src_ip"),
        F.max(F.when(bare, F.col("src_port"))).alias("syn_src_port"), F.first("first_sender").alias("first_sender"))


def observed_packets(mapped: DataFrame, budget_s: float = BUDGET_S, k: int = K) -> DataFrame:
    """The packets a flow has shown within its budget: gaps clipped at zero, offsets their running sum, first always in."""
    w = Window.partitionBy("flow_uid").orderBy("slot")
    h = first_k(mapped, k).withColumn("gap_s", F.when(F.col("slot") > 1, F.greatest(F.col("gap_s"), F.lit(0.0))))
    h = h.withColumn("offset_s", F.sum(F.coalesce("gap_s", F.lit(0.0))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return h.withColumn("direction", (F.col("src_ip") != F.col("first_sender")).cast("int")).where(F.col("offset_s") <= budget_s)


def observe_at_budget(mapped: DataFrame, flows: DataFrame, budget_s: float = BUDGET_S, k: int = K) -> DataFrame:
    """Aggregates of the observed packets with `t_obs`, `packets_seen` and population. flows: flow_uid, t, duration_s."""
    seen = observed_packets(mapped, budget_s, k).groupBy("flow_uid").agg(*_aggregates())
    end = F.col("t") + clean_rate(F.col("duration_s"))
    return flows.join(seen, "flow_uid").withColumns({
        "t_obs": F.least(F.col("t") + budget_s, end), "packets_seen": F.col("pkt_n").cast("bigint"),
        "population": F.when(end <= F.col("t") + budget_s, COMPLETED).otherwise(EARLY)})


def _kept_side(observed: DataFrame) -> DataFrame:
    """Gaps re-derived between the packets of each side: the span since the side's previous packet."""
    w = Window.partitionBy("flow_uid", "direction").orderBy("slot")
    return observed.withColumn("side_gap_s", F.col("offset_s") - F.lag("offset_s").over(w))


def keep_side(observed: DataFrame, side: int, blank_ttl: bool = True) -> DataFrame:
    """Aggregates of one side's packets (0 initiator, 1 responder); flows without any get zeros."""
    one = _kept_side(observed).groupBy("flow_uid").agg(*_aggregates(F.col("direction") == side, "side_gap_s"))
    return one.withColumns({"ttl_mean": F.lit(0.0), "ttl_std": F.lit(0.0)}) if blank_ttl else one


def split_sides(observed: DataFrame, blank_ttl: bool = True) -> DataFrame:
    """Both sides apart: forty columns per flow from one aggregate pass."""
    cols = []
    for side, name in ((0, "initiator"), (1, "responder")):
        for n, a in zip(AGGREGATES, _aggregates(F.col("direction") == side, "side_gap_s")):
            cols.append((F.lit(0.0) if blank_ttl and n.startswith("ttl_") else a).alias(f"{name}_{n}"))
    return _kept_side(observed).groupBy("flow_uid").agg(*cols)


def side_features(observed: DataFrame) -> DataFrame:
    w = Window.partitionBy("flow_uid").orderBy("slot")
    o = observed.withColumn("_turn", F.coalesce((F.col("direction") != F.lag("direction").over(w)).cast("int"), F.lit(0)))
    reply = F.col("direction") == 1
    return o.groupBy("flow_uid").agg(
        F.count(F.when(~reply, 1)).alias("request_packets"), F.count(F.when(reply, 1)).alias("response_packets"),
        F.coalesce(F.min_by("offset_s", F.when(reply, F.col("slot"))), F.lit(-1.0)).alias("reply_latency_s"),
        F.sum("_turn").alias("direction_changes"), (F.count(F.when(reply, 1)) == 0).alias("no_reply"))


def packet_links(observed: DataFrame) -> DataFrame:
    """Edges between packets of a flow: kind 0 next packet of the same side, kind 1 a reply; seconds never negative."""
    whole, side = Window.partitionBy("flow_uid").orderBy("slot"), Window.partitionBy("flow_uid", "direction").orderBy("slot")
    here = lambda w: F.struct(F.lag("slot").over(w).alias("slot"), F.lag("offset_s").over(w).alias("offset"), F.lag("direction").over(w).alias("direction"))
    o = observed.select("flow_uid", "slot", "offset_s", "direction", here(side).alias("_same"), here(whole).alias("_prev"))
    edge = lambda src, kind: F.struct(src["slot"].alias("from_slot"), F.col("slot").alias("to_slot"), F.lit(kind).alias("kind"),
                                      F.greatest(F.col("offset_s") - src["offset"], F.lit(0.0)).alias("seconds"))
    same = F.when(F.col("_same.slot").isNotNull(), edge(F.col("_same"), 0))
    turn = F.when(F.col("_prev.slot").isNotNull() & (F.col("_prev.direction") != F.col("direction")), edge(F.col("_prev"), 1))
    return o.select("flow_uid", F.inline(F.filter(F.array(same, turn), lambda e: e.isNotNull())))


def events_from_flows(flows: DataFrame, aggregates: DataFrame) -> DataFrame:
    """Every flow as an event: packet aggregates where it has packets, else zeros and the meter's time; no time, no event.

    flows: flow_uid, flow_key, capture, endpoints, ports, meter_t, label.
    """
    j = flows.join(aggregates, "flow_uid", "left")
    has = F.col("t").isNotNull()
    rev = is_reversed(F.col("src_ip"), F.col("src_port").cast("string"), F.col("dst_port").cast("string"), F.col("syn_src_ip"), F.col("syn_src_port").cast("string"))
    j = j.withColumns({"has_packets": has, "reversed": rev, "t": F.coalesce("t", "meter_t"), "first_sender": F.coalesce("first_sender", F.lit(""))})
    return j.fillna(0.0, AGGREGATES).drop("syn_src_ip", "syn_src_port", "meter_t").where(F.col("t").isNotNull())


def drop_represented_twins(events: DataFrame) -> DataFrame:
    """Drop packet-less records whose key has a record with packets: an anti-join on the keys that have them."""
    shown = events.where("has_packets").select("flow_key").distinct()
    silent = events.where(~F.col("has_packets")).join(shown, "flow_key", "left_anti")
    return events.where("has_packets").unionByName(silent)


def order_events(events: DataFrame) -> DataFrame:
    """Dense 0-based `event_id` in (t, capture, flow_uid) order."""
    return dense_id(events, ["t", "capture", "flow_uid"], "event_id")


def node_index(events: DataFrame) -> DataFrame:
    """Hosts with a dense id by first appearance (ties by address), first time and number of endpoint appearances."""
    ends = events.select("t", F.explode(F.array("src_ip", "dst_ip")).alias("ip"))
    hosts = ends.groupBy("ip").agg(F.min("t").alias("first_seen_t"), F.count(F.lit(1)).alias("n_events"))
    return dense_id(hosts, ["first_seen_t", "ip"], "node_id").withColumn("node_id", F.col("node_id").cast("int"))


def attach_node_ids(events: DataFrame, nodes: DataFrame) -> DataFrame:
    """Source and destination node ids. The host table is broadcast when its counted size allows."""
    nodes = broadcast_if_small(nodes.select("ip", "node_id"), HOSTS)
    side = lambda s: nodes.select(F.col("ip").alias(f"{s}_ip"), F.col("node_id").alias(f"{s}_node_id"))
    return events.join(side("src"), "src_ip", "left").join(side("dst"), "dst_ip", "left")


def time_since_last_seen(events: DataFrame, key: str, name: str, rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """Seconds since the host last appeared in this role, -1 on its first appearance."""
    s = keyed_scan(events, [key], "event_id", lags={"_before": F.col("t")}, rows_per_chunk=rows_per_chunk)
    return s.withColumn(name, F.coalesce(F.col("t") - F.col("_before"), F.lit(-1.0))).drop("_before")


def port_access(events: DataFrame, rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """`port_delta` and `dst_port_new` of the dialling client, read from its own earlier events only."""
    rev = F.col("reversed") == 1
    port = F.when(rev, F.col("src_port")).otherwise(F.col("dst_port")).try_cast("double")
    e = events.withColumns({"_client": F.when(rev, F.col("dst_node_id")).otherwise(F.col("src_node_id")), "_port": F.coalesce(port, F.lit(-1.0))})
    e = per_key(e, ["_client"], rows_per_chunk, lambda x, cut: keyed_scan(
        keyed_scan(x, ["_client"], "event_id", lags={"_last_port": F.col("_port")}, rows_per_chunk=cut),
        ["_client", "_port"], "event_id", lags={"_seen": F.lit(1)}, rows_per_chunk=cut))
    return e.withColumns({"port_delta": F.coalesce(F.col("_port") - F.col("_last_port"), F.lit(0.0)),
                          "dst_port_new": F.col("_seen").isNull().cast("double")}).drop("_client", "_port", "_last_port", "_seen")


def build_event_stream(flows: DataFrame, mapped: DataFrame, k: int = K) -> tuple[DataFrame, DataFrame]:
    """Flows and attributed packets to (events, node index): the whole day table, in contract column order."""
    from wiresift.operators.features import drop_bad_epochs
    ev = pinned(events_from_flows(flows, first_k_packet_aggregates(mapped, k)))  # read four times below
    ev = order_events(drop_represented_twins(drop_bad_epochs(ev)))
    nodes = pinned(node_index(ev))
    ev = pinned(attach_node_ids(ev, nodes))  # each scan below first counts its keys
    ev = time_since_last_seen(time_since_last_seen(ev, "src_node_id", "dt_src"), "dst_node_id", "dt_dst")
    return port_access(ev).select(*EVENT_COLUMNS), nodes


def orient_endpoints(events: DataFrame, src_ip: str = "src_ip", dst_ip: str = "dst_ip") -> DataFrame:
    """Sender and receiver nodes: the first packet's sender and the other one; no packets keeps the record's order."""
    first = F.col("first_sender")
    is_src, is_dst = first == F.col(src_ip), first == F.col(dst_ip)
    flip = is_dst & ~is_src
    ok = is_src | is_dst | (first == "")
    guard = lambda c: F.when(ok, c).otherwise(F.raise_error(F.lit("first packet sent by neither endpoint")))
    return events.withColumns({
        "sender_node_id": guard(F.when(flip, F.col("dst_node_id")).otherwise(F.col("src_node_id"))),
        "receiver_node_id": guard(F.when(flip, F.col("src_node_id")).otherwise(F.col("dst_node_id")))})


def flow_records(events: DataFrame, flows: DataFrame) -> DataFrame:
    """One record per event: 68 cleaned statistics oriented to the first sender, and the earliest time they exist.

    events: event_id, t, flow_uid, src_node_id, sender_node_id.  flows: flow_uid and the statistics.
    """
    j = events.select("event_id", "t", "flow_uid", (F.col("src_node_id") != F.col("sender_node_id")).alias("_flip")).join(
        flows.select("flow_uid", *[F.col(f"`{c}`") for c in RECORD_STATISTICS]), "flow_uid")
    j = j.withColumns({c: clean_rate(F.col(f"`{c}`")) for c in RECORD_STATISTICS})
    j = orient_record(j, "_flip")
    return j.select("event_id", (F.col("t") + F.col("`Flow Duration`") / 1e6).alias("record_time"),
                    *[F.col(f"`{c}`") for c in RECORD_STATISTICS], "record_reversed")


def join_event_tables(events: DataFrame, *others: DataFrame) -> DataFrame:
    """Join tables that must hold exactly the same event ids; a missing or an extra id on either side is an error."""
    out = events.withColumn("_l", F.lit(1))
    for o in others:
        j = out.join(o.withColumn("_r", F.lit(1)), "event_id", "full")
        bad = F.col("_l").isNull() | F.col("_r").isNull()
        out = j.withColumn("_l", F.when(bad, F.raise_error(F.lit("event tables do not line up"))).otherwise(F.col("_l"))).drop("_r")
    return out.where(F.col("_l") == 1).drop("_l")


def availability_order(events: DataFrame) -> DataFrame:
    """Dense 0-based position by (t_obs, event_id); events without packets are left out first."""
    return dense_id(events.where("has_packets"), ["t_obs", "event_id"], "position")


def late_messages(events: DataFrame) -> DataFrame:
    """When the flow's summary and record exist, and whether that is after the event was scored."""
    summary = F.col("t") + F.col("iat_mean") * F.greatest(F.col("pkt_n") - 1, F.lit(0.0))
    return events.withColumns({"flow_time": summary, "flow_later": summary > F.col("t_obs") + 1e-6,
                               "record_later": F.col("record_time") > F.col("t_obs") + 1e-6})


def source_rates(packets: DataFrame) -> DataFrame:
    """Packets per (source, whole second), and the peak over that second and the one before."""
    r = packets.groupBy("src_ip", F.floor(F.col("us") / 1_000_000).cast("bigint").alias("second")).agg(F.count(F.lit(1)).alias("packets"))
    w = Window.partitionBy("src_ip").orderBy("second").rangeBetween(-1, 0)
    return r.withColumn("peak", F.max("packets").over(w))


def flow_evidence(flows: DataFrame, mapped: DataFrame, packets: DataFrame | None = None) -> DataFrame:
    """Service evidence per flow from its packets; flows without packets keep their endpoints and nulls.

    flows: flow_uid, src_ip, src_port, dst_ip, dst_port, protocol.  mapped: attributed packets.
    packets: all packets, for the source rates (default: the attributed ones).
    """
    rates = source_rates(mapped if packets is None else packets).select(F.col("src_ip").alias("_src"), F.col("second").alias("_second"), "peak")
    dns = routine_dns_flag(F.col("protocol"), F.col("dst_port"), F.col("ip_flag_mf"), F.col("ip_frag_offset"), F.col("payload"), F.col("payload_len"))
    gvcp = gvcp_discovery_flag(F.col("protocol"), F.col("src_ip"), F.col("dst_ip"), F.col("dst_port"), F.col("ip_flag_mf"), F.col("ip_frag_offset"), F.col("payload"), F.col("payload_len"))
    m = mapped.where(F.col("flow_uid").isNotNull())
    # The first packet's own columns travel with the minimum; its payload is judged once per flow, not per packet.
    head = ["src_ip", "us", "protocol", "dst_ip", "dst_port", "ip_flag_mf", "ip_frag_offset", "payload", "payload_len"]
    first = m.groupBy("flow_uid").agg(F.min_by(F.struct(*head), F.struct("us", "frame_no")).alias("f")).select("flow_uid", "f.*").select(
        "flow_uid", F.col("src_ip").alias("_src"), F.floor(F.col("us") / 1_000_000).cast("bigint").alias("_second"),
        dns.alias("normal_dns_query"), gvcp.alias("normal_gvcp_discovery"))
    sent = m.where("payload_len > 0").groupBy("flow_uid").agg(F.array_sort(F.collect_set("src_ip")).alias("_talkers"))
    # A first packet's own second always has a rate row, so the join is exact.
    j = flows.join(first.join(rates, ["_src", "_second"]), "flow_uid", "left").join(sent, "flow_uid", "left")
    both = F.array_contains("_talkers", F.col("src_ip")) & F.array_contains("_talkers", F.col("dst_ip"))
    known = F.col("peak").isNotNull()
    return j.withColumns({
        "established_connection": F.when(known, (F.col("protocol") == 6) & F.coalesce(both, F.lit(False))),
        "source_packets_per_second": F.col("peak"), "service_evidence_version": F.when(known, 1)}).drop("_src", "_second", "peak", "_talkers")


# --- contracts ------------------------------------------------------------------------------------------------------


def check_event_stream(events: DataFrame, nodes: DataFrame, attacks: DataFrame) -> DataFrame:
    """One row of pass marks over the event table: columns, values, order, ids, ranges, presence of every attack.

    Order is checked on ids, so neighbours are compared by a self equi-join on `event_id`, not by a global window.
    """
    floats = [f.name for f in events.schema.fields if f.dataType.simpleString() in ("double", "float")]
    bad = sum((F.col(c).isNull().cast("int") for c in events.columns), F.lit(0)) + sum(
        ((F.isnan(c) | (F.abs(c) == float("inf"))).cast("int") for c in floats), F.lit(0))
    prev = events.select((F.col("event_id") + 1).alias("event_id"), F.col("t").alias("_t"))
    unsorted = events.join(prev, "event_id").where(F.col("_t") > F.col("t")).agg(F.count(F.lit(1)).alias("_unsorted"))
    main = events.agg(
        F.count(F.lit(1)).alias("events"), F.sum(bad).alias("bad_values"), F.min("event_id").alias("_lo"), F.max("event_id").alias("_hi"),
        F.countDistinct("event_id").alias("_ids"), F.count(F.when(~F.col("reversed").isin(-1.0, 0.0, 1.0), 1)).alias("_rev"),
        F.max(F.greatest("src_node_id", "dst_node_id")).alias("_node"),
        F.max(((F.col("syn_n") + F.col("ack_n") + F.col("fin_n") + F.col("rst_n")) != 0).cast("int")).alias("_flags"), F.max((F.col("payload_bytes") != 0).cast("int")).alias("_pay"))
    n = nodes.agg(F.count(F.lit(1)).alias("_nodes"))
    absent = attacks.select("name").distinct().join(events.select(F.col("label").alias("name")).distinct(), "name", "left_anti").agg(F.count(F.lit(1)).alias("absent_attacks"))
    j = main.join(F.broadcast(unsorted), F.lit(True)).join(F.broadcast(n), F.lit(True)).join(F.broadcast(absent), F.lit(True))
    return j.select("events", F.lit(events.columns == EVENT_COLUMNS).alias("columns_ok"), (F.col("bad_values") == 0).alias("values_ok"), (F.col("_unsorted") == 0).alias("sorted_ok"),
                    ((F.col("_lo") == 0) & (F.col("_hi") == F.col("events") - 1) & (F.col("_ids") == F.col("events"))).alias("ids_ok"),
                    (F.col("_rev") == 0).alias("reversed_ok"), (F.col("_node") < F.col("_nodes")).alias("nodes_ok"),
                    ((F.col("_flags") == 1) & (F.col("_pay") == 1)).alias("signal_ok"), "absent_attacks")


def check_latents(latents: DataFrame, width: int = 32) -> DataFrame:
    """One row of pass marks over an event-latents table. `position` is the row's place in the file's order."""
    prev = latents.select((F.col("position") + 1).alias("position"), F.col("t_obs").alias("_t"))
    back = latents.join(prev, "position").where(F.col("_t") > F.col("t_obs")).agg(F.count(F.lit(1)).alias("_back"))
    dt = lambda c: ~((F.col(c) >= 0) | (F.col(c) == -1))
    main = latents.agg(
        F.count(F.lit(1)).alias("rows"), F.count(F.when(F.coalesce(F.size("z"), F.lit(-1)) != width, 1)).alias("_w"),
        F.count(F.when(~F.col("split").isin(-1, 0, 1, 2), 1)).alias("_s"), F.count(F.when(dt("dt_src") | dt("dt_dst"), 1)).alias("_d"),
        F.count(F.when((F.col("event_id") < 0) | (F.col("sender_node_id") < 0) | (F.col("receiver_node_id") < 0), 1)).alias("_i"))
    return main.join(F.broadcast(back), F.lit(True)).select(
        "rows", (F.col("_w") == 0).alias("width_ok"), (F.col("_back") == 0).alias("order_ok"), (F.col("_s") == 0).alias("split_ok"),
        (F.col("_d") == 0).alias("gaps_ok"), (F.col("_i") == 0).alias("ids_ok"))


def packet_count_parity(events: DataFrame, mapped: DataFrame, k: int = K) -> DataFrame:
    """Events whose stored packet count is not min(packets, k); an empty result passes."""
    n = mapped.where(F.col("flow_uid").isNotNull()).groupBy("flow_uid").agg(F.count(F.lit(1)).alias("_n"))
    return events.join(n, "flow_uid", "left").where(
        F.col("pkt_n") != F.least(F.coalesce("_n", F.lit(0)), F.lit(k))).select("flow_uid", "pkt_n", F.coalesce("_n", F.lit(0)).alias("packets"))
