"""Runs, alerts, incidents, their evidence and the service rules that judge them."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wiresift.functions.addresses import blockable, is_address, service_tags
from wiresift.functions.scalars import severity
from wiresift.plans.ordering import ROWS_PER_CHUNK, dense_id, keyed_scan, per_key
from wiresift.session import pinned

PERSIST, GAP_S = 3, 120.0

# The families service rules may judge.
WEB_FAMILIES = ["dos-hulk", "dos-goldeneye", "dos-slowloris", "dos-slowhttptest", "bruteforce-web", "bruteforce-xss", "sqlinjection"]
INTERNAL_FAMILY = "infiltration"


def persist_runs(scores: DataFrame, keys: Sequence[str], position: str = "position", fires: Column | None = None, n: int = PERSIST,
                 rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """Per key in stream order: `run` consecutive firing rows so far (0 when not firing), `island`, and `alert` once run >= n.

    Any row that does not fire resets the run.
    """
    keys = list(keys)
    fires = F.col("score") >= F.col("threshold") if fires is None else fires

    def chain(s: DataFrame, cut) -> DataFrame:
        s = keyed_scan(s, keys, position, sums={"island": (~F.col("_fires")).cast("int")}, rows_per_chunk=cut)
        return keyed_scan(s, [*keys, "island"], position, sums={"run": F.col("_fires").cast("int")}, rows_per_chunk=cut)
    s = per_key(scores.withColumn("_fires", fires), keys, rows_per_chunk, chain)
    return s.withColumns({"run": F.when(F.col("_fires"), F.col("run")).otherwise(0)}).withColumn("alert", F.col("run") >= n).drop("_fires")


def incidents_from_alerts(alerts: DataFrame, keys: Sequence[str], gap_s: float = GAP_S, position: str = "position", t: str = "t_us",
                          rows_per_chunk: int = ROWS_PER_CHUNK) -> tuple[DataFrame, DataFrame]:
    """(alerts with `nth` incident of their key, one row per incident).

    A new incident when an alert comes strictly more than `gap_s` after the key's previous one. Incident ids run in
    opening order over all keys; each carries its opening score.
    """
    keys = list(keys)
    opens = F.col("_before").isNull() | (F.col(t) > F.col("_before") + int(gap_s * 1e6))

    def chain(a: DataFrame, cut) -> DataFrame:
        a = keyed_scan(a, keys, position, lags={"_before": F.col(t)}, rows_per_chunk=cut)
        return keyed_scan(a.withColumn("opens", opens), keys, position, sums={"nth": F.col("opens").cast("int")}, rows_per_chunk=cut)
    a = per_key(pinned(alerts), keys, rows_per_chunk, chain).drop("_before")  # alerts are few and read more than once
    inc = a.groupBy(*keys, "nth").agg(F.min(position).alias("opened_position"), F.min_by(t, position).alias("opened_us"), F.max(t).alias("last_alert_us"),
                                      F.min_by("score", position).alias("opening_score"), F.count(F.lit(1)).alias("alerts"))
    return a, dense_id(inc, ["opened_position", *keys], "incident", start=1)


def incident_evidence(scored: DataFrame, keys: Sequence[str], gap_s: float = GAP_S, n: int = PERSIST, position: str = "position", rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """Every row linked to an incident: the rows of a qualifying run, including those before its n-th crossing."""
    keys = list(keys)
    runs = pinned(persist_runs(scored, keys, position, n=n, rows_per_chunk=rows_per_chunk).where("run > 0"))
    alerts, inc = incidents_from_alerts(runs.where("alert"), keys, gap_s, position, rows_per_chunk=rows_per_chunk)
    ids = inc.select(*keys, "nth", "incident", "opened_us")
    linked = alerts.select(*keys, "island", position, "run", "nth")
    third = linked.where(F.col("run") == n).select(*keys, "island", F.col("nth").alias("_nth"))
    pending = runs.where(F.col("run") < n).select(*keys, "island", position, "run").join(third, [*keys, "island"]).withColumnRenamed("_nth", "nth")
    rows = linked.unionByName(pending.select(*linked.columns)).join(ids, [*keys, "nth"])
    return rows.select(position, *keys, "run", "incident", "opened_us")


def open_incidents(incidents: DataFrame, keys: Sequence[str], now_us: int, gap_s: float = GAP_S) -> DataFrame:
    """The latest incident of each key, while its last alert is at most `gap_s` old."""
    latest = incidents.groupBy(*keys).agg(F.max_by(F.struct("incident", "opened_us", "last_alert_us"), "incident").alias("_i")).select(*keys, "_i.*")
    return latest.where(F.col("last_alert_us") + int(gap_s * 1e6) >= now_us)


def link_incidents(scored: DataFrame, direction: int, served: float, tight: float, gap_s: float = GAP_S, keep: int | None = None, link: Sequence[str] = ("sender", "receiver"),
                   position: str = "position", t: str = "t_us", value: str = "value", rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """Incidents of the forecast score per directed link: the third consecutive crossing opens one and takes in the two before it.

    A run also starts afresh when a crossing comes more than `gap_s` after the last. Kept: those still open at the
    newest event; with `keep`, the list of the last so many by opening.
    """
    link, gap = list(link), int(gap_s * 1e6)
    v = F.col(value) * direction
    fresh = F.col("_t").isNull() | (F.col("_r") != F.col("_reset")) | (F.col(t) > F.col("_t") + gap)
    new = F.col("_seen").isNull() | (F.col(t) > F.col("_seen") + gap)

    def chain(s: DataFrame, cut) -> DataFrame:
        s = keyed_scan(s, link, position, sums={"_reset": (v < served).cast("int")}, rows_per_chunk=cut)
        c = keyed_scan(s.where(v >= served), link, position, lags={"_t": F.col(t), "_r": F.col("_reset")}, rows_per_chunk=cut)
        c = keyed_scan(c.withColumn("_fresh", fresh.cast("int")), link, position, sums={"_island": F.col("_fresh")}, rows_per_chunk=cut)
        c = keyed_scan(c, [*link, "_island"], position, sums={"run": F.lit(1)}, rows_per_chunk=cut)
        seen = keyed_scan(c.where("run >= 3"), link, position, lags={"_seen": F.col(t)}, rows_per_chunk=cut)
        return keyed_scan(seen.withColumn("_new", new.cast("int")), link, position, sums={"nth": F.col("_new")}, rows_per_chunk=cut)
    hot = per_key(scored, link, rows_per_chunk, chain)
    # A run of three or more brings its first two crossings along.
    hot = hot.withColumn("_brings", F.when(F.col("run") == 3, 3).otherwise(1))
    inc = hot.groupBy(*link, "nth").agg(
        F.min_by(t, position).alias("opened_us"), F.max(t).alias("last_seen_us"), F.min_by(value, position).alias("opening_value"), F.sum("_brings").alias("events"),
        F.max((v >= tight).cast("int")).alias("_high"))
    newest = scored.agg(F.max_by(t, position).alias("_newest"))
    out = inc.join(F.broadcast(newest), F.lit(True)).where(F.col("last_seen_us") + gap >= F.col("_newest"))
    out = out.withColumn("severity", F.when(F.col("_high") == 1, "HIGH").otherwise("MEDIUM"))
    out = out.select(*link, "opened_us", "last_seen_us", "opening_value", "events", "severity")
    return out if keep is None else out.orderBy(F.col("opened_us").desc(), *[F.col(x).desc() for x in link]).limit(keep)


def alert_groups(flags: DataFrame, gap_s: float = GAP_S, link: Sequence[str] = ("sender", "receiver"), position: str = "position", t: str = "t_us",
                 rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """Stored flags as bursts per link; HIGH if any flag is, `incident` if any flag belonged to one."""
    link = list(link)
    new = F.col("_t").isNull() | (F.col(t) > F.col("_t") + int(gap_s * 1e6))

    def chain(f: DataFrame, cut) -> DataFrame:
        f = keyed_scan(f, link, position, lags={"_t": F.col(t)}, rows_per_chunk=cut)
        return keyed_scan(f.withColumn("_new", new.cast("int")), link, position, sums={"burst": F.col("_new")}, rows_per_chunk=cut)
    f = per_key(flags, link, rows_per_chunk, chain)
    return f.groupBy(*link, "burst").agg(
        F.min(t).alias("opened_us"), F.max(t).alias("last_seen_us"), F.min_by("value", position).alias("opening_value"), F.count(F.lit(1)).alias("events"),
        F.when(F.max((F.col("severity") == "HIGH").cast("int")) == 1, "HIGH").otherwise(F.min_by("severity", position)).alias("severity"),
        (F.max(F.col("incident").cast("int")) == 1).alias("incident"))


def recent_incidents(incidents: DataFrame, now_us: int, window_us: int = 3 * 3_600_000_000, n: int = 500) -> DataFrame:
    """The newest `n` of the last three hours, returned oldest first."""
    return incidents.where(F.col("opened_us") >= now_us - window_us).orderBy(F.col("opened_us").desc(), F.col("incident").desc()).limit(n).orderBy("opened_us", "incident")


# --- evidence ---------------------------------------------------------------------------------------------------------


def incident_groups(events: DataFrame, k: int = 16) -> DataFrame:
    """Per incident: linked events, most used source port, and its `k` largest (sender, src, dst) groups, one row each."""
    total = events.groupBy("incident").agg(F.count(F.lit(1)).alias("total"))
    port = events.groupBy("incident", "src_port").agg(F.count(F.lit(1)).alias("n")).groupBy("incident").agg(
        F.max_by(F.struct("src_port", "n"), F.struct("n", (-F.col("src_port")).alias("p"))).alias("_p"))
    groups = events.groupBy("incident", "sender_ip", "src", "dst").agg(F.count(F.lit(1)).alias("events"), F.countDistinct("dst_port").alias("dst_ports"))
    w = Window.partitionBy("incident").orderBy(F.col("events").desc(), "sender_ip", "src", "dst")
    top = groups.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return top.join(total, "incident").join(port, "incident").select(
        "incident", "total", F.col("_p.src_port").alias("top_src_port"), F.col("_p.n").alias("top_src_port_events"), "rank", "sender_ip", "src", "dst", "events", "dst_ports")


def incident_events(events: DataFrame, limit: int | None = None, preview: int = 1_000) -> DataFrame:
    """Every incident's events. For display a `limit` may be given: of an incident with more, the first `preview` by id, flagged `truncated`.

    Decisions are taken over all events, so they read this without a limit.
    """
    total = events.groupBy("incident").agg(F.count(F.lit(1)).alias("total"))
    if limit is None:
        return events.join(total, "incident").withColumn("truncated", F.lit(False))
    big = total.where(F.col("total") > limit)
    whole = events.join(total.where(F.col("total") <= limit), "incident").withColumn("truncated", F.lit(False))
    w = Window.partitionBy("incident").orderBy("event_id")
    head = events.join(big, "incident").withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= preview).drop("_rn").withColumn("truncated", F.lit(True))
    return whole.unionByName(head)


# Why an incident's source could not be contained, by code.
SOURCE_REASON = {
    "disagree": "Linked events do not agree on one source IP.",
    "stray": "Linked traffic does not consistently originate from the sender IP.",
    "few": "At least three linked threshold-crossing events are required for a host block.",
    "elsewhere": "No linked event targets this host; an inbound host block would not contain the observed traffic.",
    "unblockable": "Source is not a validated public or private IPv4 address; automatic blocking is disabled.",
    "own": "Source IP belongs to this host; automatic blocking is disabled.",
}


def source_evidence(events: DataFrame, local_ips: DataFrame) -> DataFrame:
    """Per incident: the one source its events agree on, and whether it could be contained, with the reason if not.

    events: incident, event_id, sender_ip, src, dst, src_port, dst_port.  local_ips: ip (this host's own addresses).
    """
    local = local_ips.select("ip").distinct()
    e = events
    for c in ("src", "dst", "sender_ip"):
        e = e.join(local.select(F.col("ip").alias(c), F.lit(True).alias(f"_{c}_local")), c, "left").fillna(False, [f"_{c}_local"])
    lead = events.groupBy("incident").agg(F.min_by("sender_ip", "event_id").alias("_lead"))
    e = e.join(lead, "incident")
    reply = (F.col("dst") == F.col("sender_ip")) & F.col("_src_local")
    stray = (F.col("src") != "") & (F.col("src") != F.col("sender_ip")) & ~reply
    stop = F.when((F.col("sender_ip") == "") | (F.col("sender_ip") != F.col("_lead")), "disagree").when(stray, "stray")
    g = e.groupBy("incident").agg(
        F.count(F.lit(1)).alias("events"), F.first("_lead").alias("_ip"), F.min_by(stop, F.when(stop.isNotNull(), F.col("event_id"))).alias("_stop"),
        F.max((reply | F.col("_dst_local")).cast("int")).alias("_local_dst"), F.max(F.col("_sender_ip_local").cast("int")).alias("_ip_local"), F.countDistinct("dst_port").alias("_peer_ports"))
    most = lambda c, out: events.groupBy("incident", c).agg(F.count(F.lit(1)).alias("_n")).groupBy("incident").agg(
        F.max_by(F.struct(F.col(c).alias("v"), "_n"), F.struct("_n", c)).alias(out))
    g = g.join(most("src_port", "_port"), "incident").join(most("dst", "_peer"), "incident")
    share = lambda c: F.col(f"{c}._n") * 10 >= F.col("events") * 9
    served = ((F.col("_ip_local") == 1) & (F.col("_peer_ports") >= 3) & share("_port") & share("_peer") & (F.col("_port.v") != 0) & (F.col("_peer.v") != ""))
    g = g.withColumns({"source_ip": F.when(served, F.col("_peer.v")).otherwise(F.col("_ip")), "served_port": F.when(served, F.col("_port.v")).otherwise(0),
                       "_reaches": served | (F.col("_local_dst") == 1)})
    g = g.join(local.select(F.col("ip").alias("source_ip"), F.lit(True).alias("_own")), "source_ip", "left")
    code = (F.when(F.col("_stop").isNotNull(), F.col("_stop")).when(F.col("events") < 3, "few").when(~F.col("_reaches"), "elsewhere")
            .when(~blockable(F.col("source_ip")), "unblockable").when(F.col("_own"), "own"))
    reason = F.coalesce(F.create_map(*[x for k, v in SOURCE_REASON.items() for x in (F.lit(k), F.lit(v))])[code], F.lit(""))
    agreed = F.coalesce(F.col("_stop") != "disagree", F.lit(True))
    return g.select("incident", "events", F.when(agreed, F.col("source_ip")).otherwise("").alias("source_ip"), "served_port", reason.alias("reason"), (reason == "").alias("eligible"))


# --- service rules ------------------------------------------------------------------------------------------------------


def _family(c: Column) -> Column:
    return F.lower(F.replace(c, F.lit(" ")))


def tag_events(events: DataFrame) -> DataFrame:
    """Service context of linked events: the connection evidence decides what a reply may be called."""
    e = events.withColumns({"_transport": F.when(F.col("protocol") == 6, "TCP").when(F.col("protocol") == 17, "UDP").otherwise(""),
                            "_est": F.coalesce("established_connection", F.lit(False)), "_gvcp_ok": F.coalesce("normal_gvcp_discovery", F.lit(False))})
    return service_tags(e, "_transport", "src", "dst", "src_port", "dst_port", "_est", "_gvcp_ok").drop("_transport", "_est", "_gvcp_ok", "rule_classification", "rule_reason")


# The reasons a decision can carry.
REASON = {
    "few": "Fewer than three linked events; insufficient evidence for service suppression",
    "incomplete": "Linked event has incomplete network evidence; model incident retained",
    "burst": "Measured source packet burst; routine-service suppression disabled",
    "camera": "Unverified or excessive camera discovery traffic; model incident retained",
    "fanout": "Linked events show destination or port fanout; service port is not a whitelist",
    "dense": "Concentrated flow crossings; routine-service suppression disabled",
    "role": "At least one linked event lacks a corroborated normal service role",
    "external": "External service port alone cannot establish benign behavior; model incident retained",
    "mixed": "Linked events span different services or peers; model incident retained",
    "none": "Model incident retained; no deterministic service suppression rule applies",
    "truncated": "Only a preview of the linked events was evaluated; model incident retained",
    "routine": "Linked crossings match one routine internal service or established HTTPS response peer, without measured bursts or service fanout; "
               "raw model verdict retained separately",
}


def judge_service(events: DataFrame, key: str = "incident", minimum: int = 3, truncated: str | None = None) -> DataFrame:
    """One decision per incident from its tagged events, in event order.

    events: key, family, event_id, t_us, endpoints, protocol, evidence columns and the tags of `tag_events`.
    Suppressed only if every event has a corroborated normal role on one internal (or verified HTTPS reply) service.
    """
    c = F.col
    fam = _family(c("family"))
    web, internal_family = fam.isin(WEB_FAMILIES), fam == INTERNAL_FAMILY
    version = F.coalesce("service_evidence_version", F.lit(0))
    pps = F.coalesce("source_packets_per_second", F.lit(0))
    dns_ok = F.coalesce("normal_dns_query", F.lit(False))
    reply_class = c("traffic_class") == "RESPONSE_TRAFFIC"
    server, client = F.when(reply_class, c("src")).otherwise(c("dst")), F.when(reply_class, c("dst")).otherwise(c("src"))
    port = F.when(reply_class, c("src_port")).otherwise(c("dst_port"))
    invalid = (~is_address(c("src")) | ~is_address(c("dst")) | ~c("src_port").between(0, 65535) | ~c("dst_port").between(0, 65535) | (c("t_us") <= 0))
    stop = (F.when(F.coalesce(invalid, F.lit(True)), "incomplete").when((pps > 250) | (pps < 0), "burst")
            .when((c("protocol_tag") == "GVCP") & ((pps > 10) | ~F.coalesce("normal_gvcp_discovery", F.lit(False)) | (version == 0)), "camera"))
    response = reply_class & (c("protocol_tag") == "HTTPS") & web & (c("dst_port") >= 49152) & (version > 0)
    normal = c("traffic_class").isin("NORMAL_SERVICE", "INTERNAL_SERVICE", "RESPONSE_TRAFFIC")
    outside = ~internal_family & ((version == 0) | ((c("protocol_tag") == "DNS") & ~dns_ok) | c("protocol_tag").isin("HTTP", "HTTPS"))
    bare = (c("protocol") == 6) & ~F.coalesce("established_connection", F.lit(False))
    odd_udp = (c("protocol") == 17) & ~c("protocol_tag").isin("DNS", "GVCP")
    odd_dns = (version > 0) & (c("protocol_tag") == "DNS") & ~dns_ok
    role_ok = normal & (response | ~(outside | bare | odd_udp | odd_dns))
    e = events.withColumns({"_stop": stop, "_role": role_ok, "_inside": c("is_internal_service") | response, "_server": server, "_client": client, "_port": port})
    shape = F.struct("protocol_tag", "_server", "_client", "_port", "protocol")
    g = e.groupBy(key).agg(
        F.first("family").alias("family"), F.count(F.lit(1)).alias("events"), F.min_by("_stop", F.when(c("_stop").isNotNull(), c("event_id"))).alias("_stopped"),
        F.min(c("_role").cast("int")).alias("_role"), F.min(c("_inside").cast("int")).alias("_inside"), (F.min(shape) == F.max(shape)).alias("_one"),
        (F.max("t_us") - F.min("t_us")).alias("_span"), F.min_by("traffic_class", "event_id").alias("_class"), F.min_by("protocol_tag", "event_id").alias("protocol_tag"))
    fan = e.groupBy(key).agg(F.countDistinct("_server").alias("_peers"), F.countDistinct("_port").alias("_ports"))
    g = g.join(fan, key)
    ruled = _family(c("family")).isin(INTERNAL_FAMILY, *WEB_FAMILIES)
    code = (F.when(~ruled, "none").when(c("events") < minimum, "few").when(c("_stopped").isNotNull(), c("_stopped"))
            .when((c("_peers") >= 8) | (c("_ports") >= 8), "fanout").when((c("events") > 20) & (c("_span") < 1_000_000), "dense")
            .when(c("_role") == 0, "role").when(c("_inside") == 0, "external").when(~c("_one"), "mixed").otherwise("routine"))
    if truncated is not None:
        cut = events.groupBy(key).agg(F.max(F.col(truncated).cast("int")).alias("_cut"))
        g = g.join(cut, key)
        code = F.when((code == "routine") & (c("_cut") == 1), "truncated").otherwise(code)
    g = g.withColumn("code", code)
    text = F.create_map(*[x for k, v in REASON.items() for x in (F.lit(k), F.lit(v))])
    return g.select(key, "family", "events", "protocol_tag", F.when(c("code") == "routine", "SUPPRESSED").otherwise("RETAINED").alias("final_decision"),
                    F.when(c("code").isin("burst", "fanout", "dense"), "SUSPICIOUS").when(c("code") == "routine", c("_class")).otherwise("UNKNOWN").alias("rule_classification"),
                    text[c("code")].alias("rule_reason"))


def partition_by_decision(incidents: DataFrame, decisions: DataFrame, key: str = "incident") -> tuple[DataFrame, DataFrame]:
    """(visible, suppressed): every incident is in exactly one; one without a decision stays visible."""
    j = incidents.join(decisions.select(key, "final_decision", "rule_reason"), key, "left").fillna({"final_decision": "RETAINED"})
    return j.where("final_decision <> 'SUPPRESSED'"), j.where("final_decision = 'SUPPRESSED'")


def unordered_link(a: Column, b: Column) -> Column:
    return F.concat_ws("|", F.least(a, b), F.greatest(a, b))


def routine_links(flagged: DataFrame, sender: str = "sender_ip", receiver: str = "receiver_ip") -> DataFrame:
    """Links whose flagged events are all one routine internal service, judged together, one event being enough."""
    f = flagged.withColumns({"link": unordered_link(F.col(sender), F.col(receiver)), "family": F.lit("Infiltration")})
    return judge_service(tag_events(f), "link", minimum=1).where("final_decision = 'SUPPRESSED'").select("link", "protocol_tag", "rule_classification", "events")


def suppress_links(table: DataFrame, links: DataFrame, sender: str = "sender_ip", receiver: str = "receiver_ip") -> tuple[DataFrame, DataFrame]:
    """Split incidents, flags or forecast alerts into (kept, set aside) by their link."""
    t = table.withColumn("link", unordered_link(F.col(sender), F.col(receiver)))
    return t.join(links.select("link"), "link", "left_anti"), t.join(links.select("link"), "link", "left_semi")


# --- summaries ------------------------------------------------------------------------------------------------------------


def attention_topk(att: DataFrame, k: int = 8, event: str = "event_id", edge: Sequence[str] = ("source_node", "query_node"), weight: str = "weight") -> DataFrame:
    """Per event the `k` edges with the most summed attention, six decimals."""
    s = att.groupBy(event, *edge).agg(F.sum(weight).alias("weight"))
    w = Window.partitionBy(event).orderBy(F.col("weight").desc(), *edge)
    return s.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).withColumn("weight", F.round("weight", 6))


def link_summary(scored: DataFrame, direction: int, tight: float, served: float, link: Sequence[str] = ("sender", "receiver"), value: str = "value") -> DataFrame:
    g = scored.groupBy(*link).agg(F.count(F.lit(1)).alias("events"), (F.max(F.col(value) * direction) * direction).alias("value"))
    return g.withColumn("severity", severity(F.col("value"), direction, tight, served))


def forecast_steps(edges: DataFrame, direction: int, tight: float, served: float) -> DataFrame:
    """Per rollout step: links, share that alert, value closest to alerting."""
    sev = severity(F.col("value"), direction, tight, served)
    return edges.groupBy("step").agg(F.count(F.lit(1)).alias("links"), F.round(F.avg((sev != "").cast("double")), 6).alias("alert_share"), (F.max(F.col("value") * direction) * direction).alias("step_value"))


def forecast_first_crossing(edges: DataFrame, direction: int, tight: float, served: float, link: Sequence[str] = ("sender", "receiver")) -> DataFrame:
    """Per predicted link the first step at which it alerts (ties on a step to the smaller row id)."""
    e = edges.withColumn("severity", severity(F.col("value"), direction, tight, served)).where("severity <> ''")
    return e.groupBy(*link).agg(F.min_by(F.struct(F.col("step").alias("crosses_at_step"), "value", "severity"), F.struct("step", "row_id")).alias("_f")).select(*link, "_f.*")


def packet_counters(packets: DataFrame, position: str = "frame_no", us: str = "us", rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """Packets by class, and how often a packet was older than the one before it."""
    p = keyed_scan(packets.select(position, us, "src_ip", "protocol"), [], position, lags={"_t": F.col(us)}, rows_per_chunk=rows_per_chunk)
    v6 = F.col("src_ip").contains(":")
    return p.agg(F.count(F.lit(1)).alias("total_ip_packets"), F.count(F.when(v6, 1)).alias("ipv6_packets_excluded"),
                 F.count(F.when(~v6 & ~F.col("protocol").isin(6, 17), 1)).alias("other_ipv4_protocol_packets_excluded"),
                 F.count(F.when(~v6 & F.col("protocol").isin(6, 17), 1)).alias("packets"), F.count(F.when(F.col(us) < F.col("_t"), 1)).alias("packet_timestamp_reversals"))


def service_counters(scored: DataFrame, incidents: DataFrame, now_us: int, gap_s: float = GAP_S, rate_window_s: int = 30) -> DataFrame:
    """Per family: detections, incidents opened, incidents active, events scored with one packet, events per second."""
    s = scored.groupBy("family").agg(
        F.count(F.when(F.col("score") >= F.col("threshold"), 1)).alias("detections"), F.count(F.when(F.col("packets_seen") == 1, 1)).alias("scored_with_one_packet"),
        F.round(F.count(F.when(F.col("t_us") >= now_us - rate_window_s * 1_000_000, 1)) / float(rate_window_s), 3).alias("events_per_second"))
    i = incidents.groupBy("family").agg(F.count(F.lit(1)).alias("opened"), F.countDistinct(F.when(F.col("last_alert_us") + int(gap_s * 1e6) >= now_us, F.col("sender"))).alias("active"))
    return s.join(i, "family", "left").fillna(0, ["opened", "active"])


def rate_per_cycle(fresh: DataFrame, known: DataFrame, key: Sequence[str], elapsed_s: float, now_us: int, remember_s: float = 3600.0) -> DataFrame:
    """Scored keys not seen in the last hour, per second since the previous cycle (at least one second)."""
    recent = known.where(F.col("seen_us") >= now_us - int(remember_s * 1e6)).select(*key).distinct()
    new = fresh.select(*key).distinct().join(recent, list(key), "left_anti")
    return new.agg(F.count(F.lit(1)).alias("fresh"), (F.count(F.lit(1)) / max(elapsed_s, 1.0)).alias("rate"))
