"""Causal neighbourhoods, links, campaigns and lead times over the ordered event stream.

Every operator reads only earlier positions of the stream, so its result on a prefix equals the same rows of a longer run.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wiresift.plans.ordering import ROWS_PER_CHUNK, dense_id, grouped_median, keyed_scan, per_key
from wiresift.session import pinned

SIZE = 20


#: Rows of an endpoint, or summaries of such stretches, under one summary.
FAN = 16


def _newest(items: Column, since: Column | int, most: int) -> Column:
    """Of items, newest first, the first `most` whose peer is not met again before place `since`."""
    return F.slice(F.filter(items, lambda x: x["again"] >= since), 1, most)


def _peers_before(summaries: DataFrame, width: int, places: int, most: int) -> DataFrame:
    """(role, endpoint, block, carry): the newest distinct peers before each block of `width` places, from each block's own (items).

    Summaries merge: what is newest in a stretch of blocks is what is newest in its blocks and not met again in it. A block's carry is the merge of its elder siblings' and of the carry of their common stretch.
    """
    if places <= width:
        return summaries.select("role", "endpoint", "block", F.array().cast(summaries.schema["items"].dataType).alias("carry"))
    own = ["role", "endpoint", "above"]
    s = summaries.withColumn("above", F.floor(F.col("block") / FAN).cast("bigint"))
    newest_first = F.flatten(F.sort_array(F.collect_list(F.struct("block", "items")), asc=False)["items"])
    up = s.groupBy(*own).agg(newest_first.alias("l")).select(
        "role", "endpoint", F.col("above").alias("block"), _newest(F.col("l"), (F.col("above") + 1) * (width * FAN), most).alias("items"))
    over = _peers_before(up, width * FAN, places, most).withColumnsRenamed({"block": "above", "carry": "_over"})
    elder = F.collect_list("items").over(Window.partitionBy(*own).orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    joined = s.withColumn("_elder", elder).join(over, own)
    return joined.select("role", "endpoint", "block", _newest(F.concat(F.flatten(F.reverse("_elder")), "_over"), F.col("block") * width, most).alias("carry"))


def distinct_peer_neighbours(events: DataFrame, position: str = "position", sender: str = "sender", receiver: str = "receiver", size: int = SIZE,
                             rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """For every event the latest earlier event per distinct other peer of its sender and of its receiver, newest first.

    The rows of an endpoint are numbered; each knows the place at which its peer is met again, so that it is a peer's latest one for all rows up to there. Stretches of `FAN` rows are summed up by
    their newest `size` + 1 peers (one of them may be the queried link), summaries merge into those of longer stretches, and a row sees the rows of its own stretch and the carry into it. All
    of it is built-in expressions over at most `FAN` lists of `size` + 1; no task holds an endpoint.
    """
    side = lambda role, a, b: F.struct(F.lit(role).alias("role"), F.col(a).alias("endpoint"), F.col(b).alias("peer"), F.col(position).cast("bigint").alias("position"))
    rows = events.select(F.inline(F.array(side(0, sender, receiver), side(1, receiver, sender))))
    key, never = ["role", "endpoint"], F.lit(1 << 62)
    numbered = per_key(rows, key, rows_per_chunk, lambda x, cut: keyed_scan(
        keyed_scan(x, key, "position", sums={"_place": F.lit(1)}, rows_per_chunk=cut), [*key, "peer"], "position", lags={"_again": F.col("_place")}, reverse=True, rows_per_chunk=cut))
    numbered = pinned(numbered.select(*key, F.floor(F.col("_place") / FAN).cast("bigint").alias("block"), "_place", "position", F.coalesce("_again", never).alias("again")))
    item = F.struct("position", "again")
    kept = F.collect_list(F.when(F.col("again") >= (F.col("block") + 1) * FAN, item))
    summaries = pinned(numbered.groupBy(*key, "block").agg(F.sort_array(kept, asc=False).alias("items")))
    last = summaries.agg(F.max("block")).first()[0]
    carry = _peers_before(summaries, FAN, ((last or 0) + 1) * FAN, size + 1)
    before = Window.partitionBy(*key, "block").orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    met = numbered.withColumn("_before", F.collect_list(item).over(before)).join(carry, [*key, "block"])
    # the queried peer was met last at the row whose `again` is this very place
    seen = F.filter(F.concat(F.reverse("_before"), "carry"), lambda x: x["again"] > F.col("_place"))
    halves = met.select("position", F.slice(seen, 1, size)["position"].alias("neighbours"))
    return halves.groupBy("position").agg(F.slice(F.sort_array(F.flatten(F.collect_list("neighbours")), asc=False), 1, size).alias("neighbours"))


def causal_recent(events: DataFrame, position: str = "position", us: str = "us", sender: str = "sender", receiver: str = "receiver", node: str = "sender",
                  size: int = SIZE, rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """The node's last `size` events strictly before each event's time (simultaneous ones excluded), newest first, with peers.

    Frames are `size` rows wide; an event inherits the frame of the first event of its instant. Chunks are cut between
    instants, and each starts from the last `size` rows of the chunks before it.
    """
    ends = F.array_distinct(F.array(sender, receiver))
    other = F.when(F.col(sender) == F.col("node"), F.col(receiver)).otherwise(F.col(sender))
    instant = F.min(position).over(Window.partitionBy(us))
    rows = events.withColumn("_chunk", F.floor(instant / rows_per_chunk).cast("bigint")).select(
        position, us, "_chunk", sender, receiver, F.col(node).alias("_asked"), F.explode(ends).alias("node"))
    rows = rows.select("*", F.struct(F.col(position).alias("position"), other.alias("peer")).alias("_event"))
    w = Window.partitionBy("node", "_chunk").orderBy(position)
    tie = Window.partitionBy("node", "_chunk", us).orderBy(position)
    rows = rows.withColumn("_frame", F.collect_list("_event").over(w.rowsBetween(-size, -1))).withColumn("_frame", F.first("_frame").over(tie))
    back = Window.partitionBy("node", "_chunk").orderBy(F.col(position).desc())
    tail = rows.withColumn("_rn", F.row_number().over(back)).where(F.col("_rn") <= size).groupBy("node", "_chunk").agg(
        F.array_sort(F.collect_list("_event")).alias("_tail"))
    before = Window.partitionBy("node").orderBy("_chunk").rowsBetween(-size, -1)
    tail = tail.select("node", "_chunk", F.flatten(F.collect_list("_tail").over(before)).alias("_carry"))
    j = rows.where(F.col("node") == F.col("_asked")).join(tail, ["node", "_chunk"])
    seen = F.concat("_carry", "_frame")
    newest = F.slice(F.reverse(seen), 1, size)
    return j.select(position, "node", newest.alias("recent"))


def recently_active(events: DataFrame, last: int, window: int = 4096, cap: int = 64, position: str = "position", sender: str = "sender", receiver: str = "receiver") -> DataFrame:
    """Distinct endpoints among the `window` + 1 events up to `last`, most recent first."""
    span = events.where(F.col(position).between(max(0, last - window), last))
    ends = span.select(F.col(position).alias("_p"), F.posexplode(F.array(sender, receiver)).alias("_role", "node"))
    latest = ends.groupBy("node").agg(F.max(F.struct("_p", (-F.col("_role")).alias("_role"))).alias("_at"))
    top = latest.orderBy(F.col("_at").desc()).limit(cap)
    return top.select("node", F.col("_at._p").alias("last_position"), F.row_number().over(Window.orderBy(F.col("_at").desc())).alias("recency"))


def link_ids(events: DataFrame, sender: str = "sender", receiver: str = "receiver") -> DataFrame:
    """Dense ids of the directed pairs, by (sender, receiver)."""
    return dense_id(events.select(sender, receiver).distinct(), [sender, receiver], "link_id")


def attach_link_ids(events: DataFrame, links: DataFrame, sender: str = "sender", receiver: str = "receiver") -> DataFrame:
    """A pair that is not in the table gets -1."""
    return events.join(links, [sender, receiver], "left").fillna({"link_id": -1})


def link_state(messages: DataFrame, position: str = "position", us: str = "us", sender: str = "sender", receiver: str = "receiver", kind: str = "kind",
               kinds: tuple[str, ...] = ("event", "summary", "record"), ttl_s: float = 3600.0, rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """Per message: gap since the link's last one, whether the link restarted (gap above `ttl_s`), counts by kind since then."""
    key = [sender, receiver]
    gap = (F.col(us) - F.col("_last")) / F.lit(1e6)

    def chain(m: DataFrame, cut) -> DataFrame:
        m = keyed_scan(m, key, position, lags={"_last": F.col(us)}, rows_per_chunk=cut)
        m = m.withColumns({"gap_s": gap, "restarted": gap.isNull() | (gap > ttl_s)})
        m = keyed_scan(m, key, position, sums={"_life": F.col("restarted").cast("int")}, rows_per_chunk=cut)
        return keyed_scan(m, [*key, "_life"], position, sums={f"{k}_count": (F.col(kind) == k).cast("int") for k in kinds}, rows_per_chunk=cut)
    return per_key(messages, key, rows_per_chunk, chain).drop("_last", "_life")


def campaigns(events: DataFrame, attack: Column, host: str = "host", position: str = "position", quiet: int = 20, rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """Campaign id per event, -1 for non-attacks: a host's attack opens one after `quiet` non-attack events on that host.

    Ids are dense in (host, opening position) order.
    """
    opens = F.coalesce((F.col("_calm") - F.col("_calm_before") >= quiet).cast("int"), F.lit(1))

    def chain(e: DataFrame, cut) -> DataFrame:
        e = keyed_scan(e, [host], position, sums={"_calm": (~F.col("_attack")).cast("int")}, rows_per_chunk=cut)
        a = keyed_scan(e.where("_attack"), [host], position, lags={"_calm_before": F.col("_calm")}, rows_per_chunk=cut)
        return keyed_scan(a.withColumn("_opens", opens), [host], position, sums={"_nth": F.col("_opens")}, rows_per_chunk=cut)
    a = pinned(per_key(events.select(host, position, attack.alias("_attack")), [host], rows_per_chunk, chain))  # attack rows only
    ids = dense_id(a.where("_opens = 1").select(host, "_nth"), [host, "_nth"], "campaign")
    named = a.select(host, "_nth", F.col(position)).join(ids, [host, "_nth"]).select(position, "campaign")
    return events.join(named, position, "left").fillna({"campaign": -1})


def campaign_coverage(events: DataFrame, points: DataFrame, split: str = "split") -> DataFrame:
    """Per operating point: event recall, false alarms, and campaigns in test, covered and missed with the missed sizes.

    events: campaign, score, split, attack.  points: point, threshold (a few rows).  Scores meet the points only after
    each campaign's best alerting score is known.
    """
    test = F.col(split) == 2
    per = events.where("campaign >= 0").groupBy("campaign").agg(
        F.count(F.lit(1)).alias("size"), F.count(F.when(test, 1)).alias("in_test"), F.max(F.when(test, F.col("score"))).alias("best"))
    camp = per.where("in_test > 0").join(F.broadcast(points), F.lit(True)).groupBy("point", "threshold").agg(
        F.count(F.lit(1)).alias("campaigns_in_test"), F.count(F.when(F.col("best") >= F.col("threshold"), 1)).alias("campaigns_covered"),
        F.coalesce(F.sum(F.when(F.col("best") < F.col("threshold"), F.col("size"))), F.lit(0)).alias("missed_events"))
    hits = events.where(test).join(F.broadcast(points), F.lit(True)).groupBy("point").agg(
        F.count(F.when(F.col("attack"), 1)).alias("_pos"), F.count(F.when(F.col("attack") & (F.col("score") >= F.col("threshold")), 1)).alias("_tp"),
        F.count(F.when(~F.col("attack") & (F.col("score") >= F.col("threshold")), 1)).alias("false_alarms"))
    return camp.join(hits, "point").select(
        "point", "threshold", (F.col("_tp") / F.greatest("_pos", F.lit(1))).alias("event_recall"), "false_alarms", "campaigns_in_test", "campaigns_covered",
        (F.col("campaigns_in_test") - F.col("campaigns_covered")).alias("campaigns_missed"), "missed_events")


def missed_campaigns(events: DataFrame, threshold: float, split: str = "split") -> DataFrame:
    """Campaign ids seen in test that no alert covers: a set difference."""
    test = events.where((F.col("campaign") >= 0) & (F.col(split) == 2))
    return test.select("campaign").distinct().exceptAll(test.where(F.col("score") >= threshold).select("campaign").distinct())


def lead_ceilings(events: DataFrame, families: list[str], host: str = "host", position: str = "position", us: str = "us", label: str = "label", split: str = "split",
                  rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """Per family: how early a warning could come from its attacking hosts' own non-attack events, warm-up and stagger."""
    t = F.col(us)
    nxt = keyed_scan(events, [host], position, lasts={f"_next_{i}": F.when(F.col(label) == f, t) for i, f in enumerate(families)}, reverse=True, rows_per_chunk=rows_per_chunk)
    parts = F.array(*[F.struct(F.lit(f).alias("family"), (F.col(label) == f).alias("attack"), (F.col(f"_next_{i}") - t).alias("_gap")) for i, f in enumerate(families)])
    long = nxt.select(host, F.col(position).alias("_p"), t.alias("_t"), F.col(split).alias("_split"), F.inline(parts))
    hosts = long.groupBy("family", host).agg(
        F.min("_t").alias("_seen"), F.min(F.when(F.col("attack"), F.col("_t"))).alias("_first"), F.count(F.when(F.col("attack"), 1)).alias("_n"),
        F.min_by("_split", F.when(F.col("attack"), F.col("_p"))).alias("_first_split")).where(F.col("_first").isNotNull())
    # A non-attack event with an attack after it on the same host is by itself proof that the host attacks.
    leads = long.where(~F.col("attack") & F.col("_gap").isNotNull()).select("family", (F.col("_gap") / F.lit(1e6)).alias("lead_s"))
    lead = leads.groupBy("family").agg(F.count(F.lit(1)).alias("event_lead_n"), F.max("lead_s").alias("event_lead_max_s"), F.count(F.when(F.col("lead_s") > 60, 1)).alias("event_lead_n_over_60s"))
    lead = lead.join(grouped_median(leads, ["family"], "lead_s", "event_lead_median_s"), "family", "left")
    warm = hosts.withColumns({"warm_s": (F.col("_first") - F.col("_seen")) / F.lit(1e6)})
    ordered = dense_id(warm, ["family", "_first", host], "_order")
    gaps = keyed_scan(ordered, ["family"], "_order", lags={"_before": F.col("_first")}, rows_per_chunk=rows_per_chunk).withColumn("gap_s", (F.col("_first") - F.col("_before")) / F.lit(1e6))
    per = gaps.groupBy("family").agg(
        F.sum("_n").alias("attack_events"), F.count(F.lit(1)).alias("attacking_hosts"), F.max("warm_s").alias("campaign_warmup_max_s"),
        ((F.max("_first") - F.min("_first")) / F.lit(1e6)).alias("cross_host_total_stagger_s"),
        F.count(F.when(F.col("_first_split") == 0, 1)).alias("first_attacks_in_train"), F.count(F.when(F.col("_first_split") == 2, 1)).alias("first_attacks_in_test"))
    out = per.join(lead, "family", "left")
    out = out.join(grouped_median(warm, ["family"], "warm_s", "campaign_warmup_median_s"), "family", "left")
    return out.join(grouped_median(gaps.where("gap_s IS NOT NULL"), ["family"], "gap_s", "cross_host_median_gap_s"), "family", "left").fillna(
        {"event_lead_n": 0, "event_lead_n_over_60s": 0})


def time_to_new_peer(events: DataFrame, host: str = "sender", peer: str = "receiver", position: str = "position", us: str = "us", rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """Per event: seconds until its host first contacts a peer it has never contacted, null when it never does."""
    def chain(e: DataFrame, cut) -> DataFrame:
        e = keyed_scan(e, [host, peer], position, lags={"_met": F.lit(1)}, rows_per_chunk=cut)
        return keyed_scan(e, [host], position, lasts={"_next": F.when(F.col("_met").isNull(), F.col(us))}, reverse=True, rows_per_chunk=cut)
    e = per_key(events, [host], rows_per_chunk, chain)
    return e.withColumn("wait_s", (F.col("_next") - F.col(us)) / F.lit(1e6)).drop("_met", "_next")


def new_peer_summary(waits: DataFrame, family: str = "label", horizons: tuple[float, ...] = (1.0, 150.0)) -> DataFrame:
    """Per family: share of events that reach a new peer later, median wait, share still ahead at each horizon."""
    reached = F.count("wait_s")
    s = waits.groupBy(family).agg(F.count(F.lit(1)).alias("events"), (reached / F.count(F.lit(1))).alias("share_reaching"),
                                  *[F.when(reached > 0, F.count(F.when(F.col("wait_s") > h, 1)) / reached).alias(f"ahead_{int(h)}s") for h in horizons])
    return s.join(grouped_median(waits.where("wait_s IS NOT NULL"), [family], "wait_s", "median_wait_s"), family, "left")


def dedupe_alarms(alarms: DataFrame, key: list[str], order: str, baseline: DataFrame) -> DataFrame:
    """Each key once, at its first appearance, leaving out the keys of the priming snapshot."""
    cols = [c for c in alarms.columns if c not in key]
    first = alarms.groupBy(*key).agg(F.min_by(F.struct(*cols), order).alias("_r")).select(*key, "_r.*")
    return first.join(baseline.select(*key).distinct(), key, "left_anti")


def rank_hosts(scores: DataFrame, group: str, host: str, score: str) -> DataFrame:
    """Rank by score, then host id. Groups are one forecast's candidates."""
    w = Window.partitionBy(group).orderBy(F.col(score).desc(), F.col(host).asc())
    return scores.withColumn("rank", F.row_number().over(w))


def seed_selection(events: DataFrame, initiator: str, surprise: str, position: str, n: int) -> DataFrame:
    """The most surprising event of each initiator, the `n` most surprising of those (ties by position)."""
    best = events.groupBy(initiator).agg(F.max(F.struct(F.col(surprise).alias("surprise"), (-F.col(position)).alias("_p"))).alias("_b"))
    return best.select(initiator, (-F.col("_b._p")).alias(position), F.col("_b.surprise").alias(surprise)).orderBy(
        F.col(surprise).desc(), position).limit(n)


def candidate_pool(lists: list[DataFrame], host: str = "host") -> DataFrame:
    """Union of ranked candidate lists (host, rank): each host once, at its best place by (list, rank)."""
    tagged = [l.select(host, F.struct(F.lit(i).alias("source"), F.col("rank").cast("int").alias("rank")).alias("_at")) for i, l in enumerate(lists)]
    out = tagged[0]
    for t in tagged[1:]:
        out = out.unionByName(t)
    return out.groupBy(host).agg(F.min("_at").alias("_at")).select(host, "_at.source", "_at.rank")
