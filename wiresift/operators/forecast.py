"""Forecast evaluation: next occurrences, candidate rankings, fusion and hit metrics."""
from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wiresift.functions.scalars import portable_hash
from wiresift.operators.metrics import quantiles
from wiresift.plans import dominance
from wiresift.plans.ordering import ROWS_PER_CHUNK, dense_id, grouped_median, keyed_scan, per_key
from wiresift.plans.sizes import HOSTS
from wiresift.session import pinned

HORIZON_S = 3600.0
#: Pairs of a forecast's target and a host that one task of `proximity_ranking` compares.
MET_ROWS = 1_000_000
#: Whole lists are ranked where they hold at most so many hosts for each pair asked for; a place counted on its own costs more than that.
WHOLE_SHARE = 4


def next_occurrence(predictions: DataFrame, links: DataFrame, horizon_s: float = HORIZON_S, link: Sequence[str] = ("sender", "receiver"), t: str = "t_us",
                    rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """Per prediction: seconds until its link next occurs strictly after it (null beyond the horizon), and whether it had occurred.

    Both tables are sorted together by (link, time) and scanned both ways; a busy link never multiplies rows.
    """
    link = list(link)
    none = F.lit(None).cast("bigint")
    both = links.select(*link, t, F.lit(0).alias("_kind"), none.alias("prediction")).unionByName(
        predictions.select(*link, t, F.lit(1).alias("_kind"), F.col("prediction").cast("bigint").alias("prediction")))
    both = dense_id(both, [*link, t, "_kind", "prediction"], "_pos")
    seen = F.when(F.col("_kind") == 0, F.col(t))
    s = per_key(both, link, rows_per_chunk, lambda x, cut: keyed_scan(
        keyed_scan(x, link, "_pos", lasts={"_last": seen}, rows_per_chunk=cut), link, "_pos", lasts={"_next": seen}, reverse=True, rows_per_chunk=cut)).where("_kind = 1")
    delay = (F.col("_next") - F.col(t)) / F.lit(1e6)
    return s.select("prediction", *link, t, F.when(delay <= horizon_s, delay).alias("delay_s"), F.col("_last").isNotNull().alias("repeat"))


def ahead_share(predictions: DataFrame, group: str, lags: Sequence[float] = (150.0, 1.0)) -> DataFrame:
    """Per group of predicted links: share that happen, median wait, share still ahead at each lag, share of new links."""
    happens = F.count("delay_s")
    g = predictions.groupBy(group).agg(
        F.count(F.lit(1)).alias("links"), (happens / F.count(F.lit(1))).alias("happens"), F.avg((~F.col("repeat")).cast("double")).alias("new_link_share"),
        *[F.when(happens > 0, F.count(F.when(F.col("delay_s") > l, 1)) / happens).otherwise(0.0).alias(f"ahead_{int(l)}s") for l in lags])
    return g.join(grouped_median(predictions.where("delay_s IS NOT NULL"), [group], "delay_s", "median_wait_s"), group, "left")


def forecast_points(events: DataFrame, every: int, role: str = "role", position: str = "position") -> DataFrame:
    """One forecast per block of `every` events that holds an attack: its last attacker-to-victim event."""
    a = events.where(F.col(role) == 1)
    cols = [c for c in events.columns if c != position]
    return a.groupBy(F.floor(F.col(position) / every).alias("forecast")).agg(
        F.max(position).alias(position), F.max_by(F.struct(*cols), position).alias("_e")).select("forecast", position, "_e.*")


def _ranked(df: DataFrame, order: list, cap: int | None = None) -> DataFrame:
    """Ranks from 0; with `cap` the first so many, a filter on the rank itself, which Spark applies in each task before the shuffle."""
    r = df.withColumn("rank", F.row_number().over(Window.partitionBy("forecast").orderBy(*order, "host")))
    return (r if cap is None else r.where(F.col("rank") <= cap)).withColumn("rank", F.col("rank") - 1)


def recency_ranking(events: DataFrame, forecasts: DataFrame, window: int = 4096, cap: int = 64, position: str = "position", sender: str = "sender", receiver: str = "receiver") -> DataFrame:
    """Hosts active in the `window` + 1 events up to each forecast, most recent first; the attacker is left out.

    Forecasts are spread over the position blocks their window touches, so an event meets only the forecasts that see it.
    """
    block = lambda c: F.floor(c / window)
    f = forecasts.select("forecast", F.col(position).alias("_at"), F.col(sender).alias("_attacker"),
                         F.explode(F.sequence(F.greatest(block(F.col(position)) - 1, F.lit(0)), block(F.col(position)))).alias("_block"))
    e = events.select(F.col(position).alias("_p"), F.posexplode(F.array(sender, receiver)).alias("_side", "host")).withColumn("_block", block(F.col("_p")))
    j = e.join(f, "_block").where(F.col("_p").between(F.col("_at") - window, F.col("_at")) & (F.col("host") != F.col("_attacker")))
    last = j.groupBy("forecast", "host").agg(F.max(F.struct("_p", (-F.col("_side")).alias("s"))).alias("_last"))
    return _ranked(last, [F.col("_last").desc()], cap).select("forecast", "host", "rank")


def popularity_ranking(events: DataFrame, forecasts: DataFrame, history: int = 20_000, every: int = 500, position: str = "position", sender: str = "sender", receiver: str = "receiver",
                       cap: int | None = None) -> DataFrame:
    """Hosts by how often they were contacted in the last ~`history` events before the forecast's own block; ties by host id.

    Contacts are counted per (block, host) first; only those counts meet the forecasts.
    """
    blocks = max(1, history // every)
    counts = events.groupBy(F.floor(F.col(position) / every).alias("_block"), F.col(receiver).alias("host")).agg(F.count(F.lit(1)).alias("n"))
    f = forecasts.select("forecast", F.col(sender).alias("_attacker"), F.floor(F.col(position) / every).alias("_own"))
    f = f.select("forecast", "_attacker", F.explode(F.filter(F.sequence(F.col("_own") - blocks, F.col("_own") - 1), lambda b: b >= 0)).alias("_block"))
    j = counts.join(f, "_block").where(F.col("host") != F.col("_attacker")).groupBy("forecast", "host").agg(F.sum("n").alias("popularity"))
    return _ranked(j, [F.col("popularity").desc()], cap)


def last_targets(events: DataFrame, forecasts: DataFrame, position: str = "position", sender: str = "sender", receiver: str = "receiver", rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """(forecast, position, _attacker, _target): the attacker's last three targets at each forecast, as the operators by distance take them."""
    e = per_key(events.select(position, sender, receiver), [sender], rows_per_chunk, lambda x, cut: keyed_scan(
        keyed_scan(x, [sender], position, lags={"_r1": F.col(receiver)}, rows_per_chunk=cut), [sender], position, lags={"_r2": F.col("_r1")}, rows_per_chunk=cut))
    return e.join(forecasts.select("forecast", position), position).select(
        "forecast", position, F.col(sender).alias("_attacker"), F.explode(F.filter(F.array(receiver, "_r1", "_r2"), lambda x: x.isNotNull())).alias("_target"))


def proximity_ranking(events: DataFrame, forecasts: DataFrame, hosts: DataFrame, cap: int, position: str = "position", sender: str = "sender", receiver: str = "receiver",
                      rows_per_chunk: int = ROWS_PER_CHUNK, targets: DataFrame | None = None) -> DataFrame:
    """The first `cap` of the hosts seen before each forecast by IPv4 distance to the nearest of the attacker's last three targets.

    hosts: host, ip_number, first_position. Hosts without a number are not near any and not listed. Hosts are put in address order once, and a target meets
    only those within `reach` places of its own.  A forecast is settled when `cap` of them are nearer than anything outside could be; the
    others look eight times as far, so no forecast meets all hosts unless its own answer needs them. `proximity_places` has the place of any host in the whole list.

    Forecasts are dealt to tasks by how many hosts they are going to meet, about `MET_ROWS` a task, not by their own size; a forecast's hosts are then reduced and ranked where they are met.
    """
    targets = last_targets(events, forecasts, position, sender, receiver, rows_per_chunk) if targets is None else targets
    placed = pinned(dense_id(hosts.where("ip_number IS NOT NULL").select("host", "ip_number", "first_position"), ["ip_number", "host"], "_i"))
    total = placed.count()
    left = pinned(targets.join(placed.select(F.col("host").alias("_target"), F.col("ip_number").alias("_ip"), F.col("_i").alias("_at_i")), "_target")
                  .select("forecast", F.col(position).alias("_at"), "_attacker", "_target", "_ip", "_at_i").distinct())
    edge = placed.select(F.col("_i").alias("_edge"), F.col("ip_number").alias("_edge_ip"))
    done, reach, far = [], max(256, 4 * cap), float("inf")
    while True:
        block = lambda c: F.floor(c / reach)
        # how near a host outside the stretch could be, on either side
        ends = left.withColumns({"_low": F.col("_at_i") - reach, "_high": F.col("_at_i") + reach})
        ends = ends.join(edge.withColumnRenamed("_edge_ip", "_low_ip"), F.col("_low") == F.col("_edge"), "left").drop("_edge")
        ends = ends.join(edge.withColumnRenamed("_edge_ip", "_high_ip"), F.col("_high") == F.col("_edge"), "left").drop("_edge")
        safe = F.least(F.coalesce((F.col("_ip") - F.col("_low_ip")).cast("double"), F.lit(far)), F.coalesce((F.col("_high_ip") - F.col("_ip")).cast("double"), F.lit(far)))
        ends = pinned(ends.withColumn("_safe", safe))
        limit = ends.groupBy("forecast").agg(F.min("_safe").alias("_safe"))
        tasks = max(1, -(-ends.count() * min(2 * reach + 1, total) // MET_ROWS))
        asked = ends.drop("_safe").join(limit, "forecast")
        if total <= HOSTS:  # every task has the hosts, a forecast stays where it is dealt
            asked, hosts_by_block = asked.repartition(tasks, "forecast"), F.broadcast(placed.withColumn("_block", block(F.col("_i"))))
        else:
            hosts_by_block = placed.withColumn("_block", block(F.col("_i")))
        away = F.abs(F.col("ip_number") - F.col("_ip"))
        asked = asked.withColumn("_block", F.explode(F.sequence(block(F.col("_low")), block(F.col("_high")))))
        met = asked.join(hosts_by_block, "_block").where(
            (F.abs(F.col("_i") - F.col("_at_i")) <= reach) & (F.col("first_position") <= F.col("_at")) & (F.col("host") != F.col("_attacker")) & (away < F.col("_safe")))
        met = met.select("forecast", "host", away.alias("distance"))
        if total > HOSTS:
            met = met.repartition(tasks, "forecast")
        near = pinned(_ranked(met.groupBy("forecast", "host").agg(F.min("distance").alias("distance")), [F.col("distance").asc()], cap))
        enough = near.groupBy("forecast").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= cap).select("forecast")
        settled = enough.union(limit.where(F.col("_safe") == far).select("forecast")).distinct()
        done.append(near.join(settled, "forecast", "left_semi").select("forecast", "host", "distance", "rank"))
        if reach >= total:
            break
        left = pinned(left.join(settled, "forecast", "left_anti"))
        if not left.limit(1).count():
            break
        reach *= 8
    return reduce(DataFrame.unionByName, done)


#: Host ids are below 2**31 (they are dense), addresses below 2**32: (address, host) is one long in order.
_HOST_BITS, _ADDRESSES = 31, 1 << 32


def _address_order(ip: Column, host: Column) -> Column:
    return F.when(ip >= _ADDRESSES, F.lit((1 << 63) - 1)).otherwise(F.shiftleft(F.greatest(ip, F.lit(0).cast("long")), _HOST_BITS) + host)


def _by_id(hosts: DataFrame) -> DataFrame:
    """Points (x = host id, y = first position), and those without an address once more, moved by `_ADDRESSES`."""
    every = hosts.select(F.col("host").cast("long").alias("x"), F.col("first_position").cast("long").alias("y"))
    return every.union(hosts.where("ip_number IS NULL").select((F.col("host") + _ADDRESSES).cast("long"), F.col("first_position").cast("long")))


def hosts_seen(forecasts: DataFrame, hosts: DataFrame, position: str = "position", rows: int = dominance.ROWS) -> DataFrame:
    """(forecast, n): how many hosts a whole list of each forecast has: those seen by then, but for the attacker."""
    corners = forecasts.select("forecast", F.lit(1).alias("sign"), F.lit(_ADDRESSES).alias("x"), (F.col(position) + 1).cast("long").alias("y"))
    return dominance.counts(_by_id(hosts), corners, ["forecast"], rows).select("forecast", (F.col("n") - 1).alias("n"))


def _whole_tasks(pairs: DataFrame, forecasts: DataFrame, hosts: DataFrame) -> int:
    """How many tasks rank all lists whole, where the pairs asked for are a good share of them; 0 where their places are better counted."""
    known = hosts.count()
    whole = forecasts.count() * known
    return 0 if known > HOSTS or whole > WHOLE_SHARE * pairs.count() else max(1, -(-whole // MET_ROWS))


def proximity_places(pairs: DataFrame, events: DataFrame, forecasts: DataFrame, hosts: DataFrame, position: str = "position", sender: str = "sender", receiver: str = "receiver",
                     rows_per_chunk: int = ROWS_PER_CHUNK, rows: int = dominance.ROWS, targets: DataFrame | None = None) -> DataFrame:
    """(forecast, host, distance, rank): the place of each pair's host in the forecast's whole list by distance; hosts not seen by then, and the attacker, are not listed.

    Hosts without an address, or all where no target has one, come last with no distance, in order of their ids. A place is a count of hosts in ranges of (address, host) that
    were seen by the forecast: the open stretches around the targets, and of equally far addresses the smaller ids. The ranges' ends are counted all at once.
    Where the pairs are a good share of the lists, the lists are ranked instead, a forecast's where it is dealt.
    """
    number = hosts.select("host", "ip_number", "first_position")
    targets = last_targets(events, forecasts, position, sender, receiver, rows_per_chunk) if targets is None else targets
    near = targets.join(number.select(F.col("host").alias("_target"), F.col("ip_number").alias("_ip")), "_target", "left").groupBy("forecast", position, "_attacker").agg(F.array_sort(F.collect_set("_ip")).alias("t"))
    near = near.join(number.select(F.col("host").alias("_attacker"), F.col("ip_number").alias("_own")), "_attacker", "left")
    away = lambda ip: F.array_min(F.transform("t", lambda x: F.abs(ip - x)))
    if tasks := _whole_tasks(pairs, forecasts, hosts):
        # as in the counts, a host without a first position is counted, but not listed
        every = near.repartition(tasks, "forecast").join(F.broadcast(number), (F.col("first_position").isNull() | (F.col("first_position") <= F.col(position))) & (F.col("host") != F.col("_attacker")))
        every = every.select("forecast", "host", "first_position", away(F.col("ip_number")).alias("distance"))
        place = F.row_number().over(Window.partitionBy("forecast").orderBy(F.col("distance").asc_nulls_last(), "host")) - 1
        every = every.withColumn("rank", place.cast("long")).where("first_position IS NOT NULL").drop("first_position")
        return every.join(pairs.select("forecast", "host").distinct(), ["forecast", "host"], "left_semi")
    asked = pairs.select("forecast", "host").distinct().join(number, "host").join(near, "forecast").where((F.col("first_position") <= F.col(position)) & (F.col("host") != F.col("_attacker")))
    asked = pinned(asked.withColumns({"distance": away(F.col("ip_number")), "_attacker_distance": away(F.col("_own"))}))

    d, t, y = F.col("distance"), F.col("t"), (F.col(position) + 1).cast("long").alias("y")
    keyed = ["forecast", "host"]
    # stretches of addresses nearer than d, one behind the other, and the addresses at distance d outside them
    nth = lambda i: F.get(t, i)
    inside = F.transform(t, lambda x, i: F.struct(F.when(i > 0, F.greatest(x - d + 1, nth(i - 1) + d)).otherwise(x - d + 1).alias("low"), (x + d).alias("high")))
    inside = F.filter(inside, lambda r: r["low"] < r["high"])
    ties = F.array_distinct(F.flatten(F.transform(t, lambda x, i: F.filter(F.array(
        F.when((i == 0) | (x - nth(i - 1) >= 2 * d), x - d), F.when((i == F.size(t) - 1) | (nth(i + 1) - x >= 2 * d), x + d)), lambda v: v.isNotNull() & (v >= 0) & (v < _ADDRESSES)))))
    ends = F.concat(
        F.flatten(F.transform(inside, lambda r: F.array(F.struct(F.lit(1).alias("sign"), _address_order(r["high"], F.lit(0)).alias("x")), F.struct(F.lit(-1).alias("sign"), _address_order(r["low"], F.lit(0)).alias("x"))))),
        F.flatten(F.transform(ties, lambda v: F.array(F.struct(F.lit(1).alias("sign"), _address_order(v, F.col("host")).alias("x")), F.struct(F.lit(-1).alias("sign"), _address_order(v, F.lit(0)).alias("x"))))))
    numbered = hosts.where("ip_number IS NOT NULL").select(_address_order(F.col("ip_number"), F.col("host")).cast("long").alias("x"), F.col("first_position").cast("long").alias("y"))
    corners = asked.where("distance IS NOT NULL").select(*keyed, F.explode(ends).alias("e"), y).select(*keyed, "e.sign", F.col("e.x").cast("long").alias("x"), "y")
    nearer = dominance.counts(numbered, corners, keyed, rows)
    # without a distance: behind all hosts that have one, in order of ids
    last = asked.where("distance IS NULL")
    ids = lambda sign, x: F.struct(F.lit(sign).alias("sign"), x.cast("long").alias("x"))
    some = F.size("t") > 0  # all hosts seen, less those without an address and no smaller id
    behind = F.when(some, F.array(ids(1, F.lit(_ADDRESSES)), ids(-1, F.lit(2 * _ADDRESSES)), ids(1, F.lit(_ADDRESSES)), ids(1, F.col("host") + _ADDRESSES), ids(-1, F.lit(_ADDRESSES)))).otherwise(F.array(ids(1, F.col("host"))))
    counted = dominance.counts(_by_id(hosts), last.select(*keyed, F.explode(behind).alias("e"), y).select(*keyed, "e.sign", "e.x", "y"), keyed, rows)
    mine = F.struct(F.col("distance").isNull(), F.col("distance"), F.col("host"))
    before = F.struct(F.col("_attacker_distance").isNull(), F.col("_attacker_distance"), F.col("_attacker")) < mine
    return asked.join(nearer.union(counted), keyed).select(*keyed, "distance", (F.col("n") - before.cast("int")).cast("long").alias("rank"))


def popularity_places(pairs: DataFrame, events: DataFrame, forecasts: DataFrame, hosts: DataFrame, history: int = 20_000, every: int = 500, position: str = "position", sender: str = "sender",
                      receiver: str = "receiver", rows: int = dominance.ROWS) -> DataFrame:
    """(forecast, host, popularity, rank): the place of each pair's host in the whole list by popularity, where hosts seen but not contacted of late have 0; others are not listed.

    A forecast's contacted hosts are listed; behind them a place is the number of hosts seen with a smaller id, less the contacted ones among them.
    Where the pairs are a good share of the lists, the lists are ranked instead.
    """
    list_ = pinned(popularity_ranking(events, forecasts, history, every, position, sender, receiver))
    at = forecasts.select("forecast", position, F.col(sender).alias("_attacker"))
    if tasks := _whole_tasks(pairs, forecasts, hosts):
        # as in the counts, hosts without a first position are counted, but not listed; so are hosts without an id, ahead of all quiet ones, and once more without an address
        nameless = hosts.where("host IS NULL").select(F.col("first_position").alias("_since"), F.when(F.col("ip_number").isNull(), 2).otherwise(1).alias("_n"))
        at = at.join(F.broadcast(nameless), F.col("_since").isNull() & F.col("_n").isNotNull() | (F.col("_since") <= F.col(position)), "left").groupBy(*at.columns).agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("ahead"))
        met = at.repartition(tasks, "forecast").join(F.broadcast(hosts.select("host", "first_position")), (F.col("first_position").isNull() | (F.col("first_position") <= F.col(position))) & (F.col("host") != F.col("_attacker")))
        none = F.lit(None).cast("long")
        both = met.select("forecast", "host", none.alias("popularity"), none.alias("rank"), F.col("first_position").isNotNull().cast("int").alias("seen"), "ahead").union(
            list_.select("forecast", "host", "popularity", F.col("rank").cast("long"), F.lit(0), none))
        one = both.repartition(tasks, "forecast").groupBy("forecast", "host").agg(*[F.max(c).alias(c) for c in ("popularity", "rank", "seen", "ahead")])
        place = F.row_number().over(Window.partitionBy("forecast").orderBy(F.col("rank").asc_nulls_last(), "host")) - 1 + F.when(F.col("rank").isNull(), F.col("ahead")).otherwise(0)
        one = one.select("forecast", "host", F.coalesce("popularity", F.lit(0)).alias("popularity"), place.cast("long").alias("rank"), "seen").where("seen = 1").drop("seen")
        return one.join(pairs.select("forecast", "host").distinct(), ["forecast", "host"], "left_semi")
    asked = pairs.select("forecast", "host").distinct().join(hosts.select("host", "first_position"), "host").join(at, "forecast").where((F.col("first_position") <= F.col(position)) & (F.col("host") != F.col("_attacker")))
    asked = asked.join(list_, ["forecast", "host"], "left")
    quiet = pinned(asked.where("rank IS NULL").select("forecast", "host", position, "_attacker"))
    corners = quiet.select("forecast", "host", F.lit(1).alias("sign"), F.col("host").cast("long").alias("x"), (F.col(position) + 1).cast("long").alias("y"))
    seen = dominance.counts(_by_id(hosts), corners, ["forecast", "host"], rows)
    ordered = Window.partitionBy("forecast").orderBy("host").rowsBetween(Window.unboundedPreceding, 0)
    contacted = list_.select("forecast", "host", F.lit(1).alias("one")).union(quiet.select("forecast", "host", F.lit(0)))
    contacted = contacted.withColumns({"smaller": F.sum("one").over(ordered), "all": F.sum("one").over(Window.partitionBy("forecast"))}).where("one = 0")
    place = F.col("all") + F.col("n") - F.col("smaller") - (F.col("_attacker") < F.col("host")).cast("int")
    behind = quiet.join(seen, ["forecast", "host"]).join(contacted, ["forecast", "host"]).select("forecast", "host", F.lit(0).cast("long").alias("popularity"), place.cast("long").alias("rank"))
    return asked.where("rank IS NOT NULL").select("forecast", "host", "popularity", F.col("rank").cast("long").alias("rank")).union(behind)


def _filled(few: DataFrame, value: Column, forecasts: DataFrame, hosts: DataFrame, cap: int, position: str, sender: str) -> DataFrame:
    """Lists of at most `cap` rows, filled up with hosts seen that they lack, in order of ids: ids are tried from the smallest on, further only for forecasts that still lack some."""
    columns = few.columns
    have = few.groupBy("forecast").agg(F.count(F.lit(1)).alias("have"))
    left = pinned(forecasts.select("forecast", position, F.col(sender).alias("_attacker")).join(have, "forecast", "left").fillna(0, ["have"]).where(F.col("have") < cap))
    top = hosts.agg(F.max("host")).first()[0]
    reach, parts = 4 * cap, [few]
    while top is not None and left.limit(1).count():
        ids = left.withColumn("host", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(min(reach, top)).cast("long")))).where("host <> _attacker")
        seen = ids.join(hosts.select(F.col("host").cast("long").alias("host"), "first_position"), "host").where(F.col("first_position") <= F.col(position))
        more = pinned(_ranked(seen.join(few.select("forecast", "host"), ["forecast", "host"], "left_anti"), []).where(F.col("rank") < F.lit(cap) - F.col("have")))
        enough = more.groupBy("forecast", "have").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") + F.col("have") >= cap).select("forecast")
        done = more if reach >= top else more.join(enough, "forecast", "left_semi")
        parts.append(done.select("forecast", "host", value.alias(columns[2]), (F.col("have") + F.col("rank")).cast("int").alias("rank")))
        if reach >= top:
            break
        left = pinned(left.join(enough, "forecast", "left_anti"))
        reach *= 8
    return reduce(DataFrame.union, parts)


def popularity_first(events: DataFrame, forecasts: DataFrame, hosts: DataFrame, cap: int, history: int = 20_000, every: int = 500, position: str = "position", sender: str = "sender", receiver: str = "receiver") -> DataFrame:
    """(forecast, host, popularity, rank): the first `cap` of each whole list by popularity; hosts seen but not contacted of late have 0."""
    few = pinned(popularity_ranking(events, forecasts, history, every, position, sender, receiver, cap).select("forecast", "host", "popularity", "rank"))
    return _filled(few, F.lit(0).cast("long"), forecasts, hosts, cap, position, sender)


def proximity_first(events: DataFrame, forecasts: DataFrame, hosts: DataFrame, cap: int, position: str = "position", sender: str = "sender", receiver: str = "receiver", targets: DataFrame | None = None) -> DataFrame:
    """(forecast, host, distance, rank): the first `cap` of each whole list by distance; hosts without one come behind, in order of ids."""
    few = pinned(proximity_ranking(events, forecasts, hosts, cap, position, sender, receiver, targets=targets).select("forecast", "host", "distance", "rank"))
    return _filled(few, F.lit(None).cast("long"), forecasts, hosts, cap, position, sender)


def every_host(forecasts: DataFrame, hosts: DataFrame, position: str = "position", sender: str = "sender", per_part: int = 4096) -> DataFrame:
    """(forecast, host) of all hosts seen by each forecast, the attacker left out: for callers who ask for whole lists; the result is as large as that."""
    parts = -(-hosts.count() // per_part) or 1
    asked = forecasts.select("forecast", F.col(position).alias("_at"), F.col(sender).alias("_attacker"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("_part"))
    dealt = hosts.select("host", "first_position", F.pmod(F.xxhash64("host"), F.lit(parts)).cast("int").alias("_part"))
    return dealt.join(asked, "_part").where((F.col("first_position") <= F.col("_at")) & (F.col("host") != F.col("_attacker"))).select("forecast", "host")


def rrf_fuse(lists: Sequence[DataFrame], k: float = 60.0) -> DataFrame:
    """Reciprocal-rank fusion of (forecast, host, rank from 0) lists; ties by host id."""
    out = lists[0].select("forecast", "host", "rank")
    for l in lists[1:]:
        out = out.unionByName(l.select("forecast", "host", "rank"))
    s = out.groupBy("forecast", "host").agg(F.sum(1.0 / (F.lit(k) + F.col("rank") + 1)).alias("score"))
    return _ranked(s, [F.round("score", 12).desc()])


def prior_fuse(scored: DataFrame, proximity: DataFrame, alpha: float, lengths: DataFrame | None = None) -> DataFrame:
    """alpha ln p + (1 - alpha) ln q with q normalised from 1 / (1 + proximity rank); hosts without a rank come behind the list.

    `proximity` needs the places of the scored hosts only; `lengths` (forecast, n) then tells how long each whole list is.
    """
    n = proximity.groupBy("forecast").agg(F.count(F.lit(1)).alias("_len")) if lengths is None else lengths.select("forecast", F.col("n").alias("_len"))
    j = scored.join(proximity.select("forecast", "host", F.col("rank").alias("_prox")), ["forecast", "host"], "left").join(n, "forecast", "left")
    j = j.withColumn("_q", 1.0 / (1 + F.coalesce("_prox", "_len", F.lit(0))))
    total = j.groupBy("forecast").agg(F.sum("_q").alias("_total"))
    j = j.join(total, "forecast")
    fused = alpha * F.log(F.greatest("p", F.lit(1e-12))) + (1 - alpha) * F.log(F.col("_q") / F.col("_total"))
    return _ranked(j.withColumn("fused", fused), [F.round("fused", 12).desc()]).select("forecast", "host", "fused", "rank")


def new_contacts(events: DataFrame, forecasts: DataFrame, horizon_s: float = HORIZON_S, most: int = 6, position: str = "position", us: str = "t_us", sender: str = "sender", receiver: str = "receiver",
                 rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """The attacker's contacts within the horizon after each forecast: first delay per host, `order` among the hosts it had never contacted.

    `order` counts the first `most` new hosts (the truth the rankings are judged on); other contacts have none.

    A contact answers the forecasts made between the pair's previous contact and itself, so each (forecast, host) comes
    from exactly one event. Contacts and forecasts of an attacker meet by blocks of one horizon, of which a forecast sees two.
    """
    width = int(horizon_s * 1e6)
    block = lambda c: F.floor(c / width)
    asked = forecasts.select(sender, "forecast", F.col(us).alias("t0"), F.explode(F.array(block(F.col(us)), block(F.col(us)) + 1)).alias("_block"))
    e = keyed_scan(events.select(position, us, sender, receiver), [sender, receiver], position, lags={"_before": F.col(us)}, rows_per_chunk=rows_per_chunk)
    t = F.col(us)
    j = e.withColumn("_block", block(t)).join(asked, [sender, "_block"]).where(
        (F.col("t0") < t) & (F.col("t0") >= t - width) & (F.col("_before").isNull() | (F.col("t0") >= F.col("_before"))))
    j = j.select(F.col(receiver).alias("host"), us, F.col("_before").isNull().alias("is_new"), "t0", "forecast")
    w = Window.partitionBy("forecast", "is_new").orderBy(us, "host")
    j = j.withColumn("_n", F.row_number().over(w))
    return j.select("forecast", "host", ((t - F.col("t0")) / F.lit(1e6)).alias("delay_s"), "is_new", F.when(F.col("is_new") & (F.col("_n") <= most), F.col("_n")).alias("order"))


def first_ranks(rankings: DataFrame, truth: DataFrame) -> DataFrame:
    """(method, forecast, order, rank): where each list put each true new host; null when it is not listed."""
    methods = rankings.select("method").distinct()
    wanted = truth.where("`order` IS NOT NULL").select("forecast", "host", "order").join(F.broadcast(methods), F.lit(True))
    return wanted.join(rankings.select("method", "forecast", "host", "rank"), ["method", "forecast", "host"], "left")


def hit_report(rankings: DataFrame, truth: DataFrame, sizes: Sequence[int] = (1, 3, 5, 10, 20), recall_at: Sequence[int] = (5, 10, 20), precision_at: Sequence[int] = (3, 10)) -> DataFrame:
    """hit@N and MRR of the next new host, recall@N over all new hosts, precision@N over the horizon's contacts, per method.

    `rankings` (method, forecast, host, rank) need hold only the first of each list, up to the largest of `precision_at`, and the places of the true hosts in it.
    """
    rankings, truth = pinned(rankings), pinned(truth)  # read several times
    r = pinned(first_ranks(rankings, truth))
    first = r.where("`order` = 1").groupBy("method").agg(
        F.count(F.lit(1)).alias("forecasts"), *[F.avg(F.coalesce((F.col("rank") < n).cast("double"), F.lit(0.0))).alias(f"hit_{n}") for n in sizes],
        F.avg(F.coalesce(1.0 / (F.col("rank") + 1), F.lit(0.0))).alias("mrr"))
    each = r.groupBy("method", "forecast").agg(*[F.avg(F.coalesce((F.col("rank") < n).cast("double"), F.lit(0.0))).alias(f"_r{n}") for n in recall_at])
    recall = each.groupBy("method").agg(*[F.avg(f"_r{n}").alias(f"recall_{n}") for n in recall_at])
    judged = truth.where("`order` = 1").select("forecast").distinct()
    shown = rankings.where(F.col("rank") < max(precision_at)).join(judged, "forecast", "left_semi").join(
        truth.select("forecast", "host", F.lit(1.0).alias("_true")), ["forecast", "host"], "left").fillna(0.0, ["_true"])
    p = shown.groupBy("method", "forecast").agg(*[F.avg(F.when(F.col("rank") < n, F.col("_true"))).alias(f"_p{n}") for n in precision_at])
    precision = p.groupBy("method").agg(*[F.avg(f"_p{n}").alias(f"precision_{n}") for n in precision_at])
    return first.join(recall, "method").join(precision, "method")


def conformal_list_size(ranks: DataFrame, levels: Sequence[float] = (0.8, 0.9)) -> DataFrame:
    """Smallest list that holds the next new host for a share of the first half of forecasts, and how often it held in the second.

    ranks: method, forecast, rank (null = not listed, infinitely far).
    """
    r = ranks.withColumn("_rank", F.coalesce(F.col("rank").cast("double"), F.lit(float("inf"))))
    total = r.groupBy("method").agg(F.count(F.lit(1)).alias("_n"))
    r = dense_id(r, ["method", "forecast"], "_place")
    begin = r.groupBy("method").agg(F.min("_place").alias("_begin"))
    r = r.join(total, "method").join(begin, "method").withColumn("_half", F.col("_place") - F.col("_begin") < F.floor(F.col("_n") / 2))
    cal = quantiles(r.where("_half"), ["method"], "_rank", list(levels), "higher").select("method", F.col("q").alias("level"), (F.col("quantile") + 1).alias("size"))
    chk = r.where("NOT _half").join(F.broadcast(cal), "method")
    return chk.groupBy("method", "level", "size").agg(F.avg((F.col("_rank") < F.col("size")).cast("double")).alias("held"))


def reach_scores(paths: DataFrame) -> DataFrame:
    """Per forecast: hosts by the weight of the paths that reach them; weights are the softmax of the paths' log probability.

    paths: forecast, path, log_probability, hosts (array).
    """
    top = paths.groupBy("forecast").agg(F.max("log_probability").alias("_top"))
    p = paths.join(top, "forecast").withColumn("_w", F.exp(F.col("log_probability") - F.col("_top")))
    total = p.groupBy("forecast").agg(F.sum("_w").alias("_total"))
    e = p.join(total, "forecast").select("forecast", (F.col("_w") / F.col("_total")).alias("_w"), F.explode(F.array_distinct("hosts")).alias("host"))
    return _ranked(e.groupBy("forecast", "host").agg(F.sum("_w").alias("reach")), [F.round("reach", 12).desc()])


def target_and_negatives(events: DataFrame, active: DataFrame, every: int, n: int = 5, seed: int = 0, position: str = "position", sender: str = "sender", receiver: str = "receiver", role: str = "role") -> DataFrame:
    """Per attack event the victim endpoint and `n` other active hosts in hash order, never the target or the sender.

    active: block, hosts (the bounded active set of each block of `every` events).
    """
    target = F.when(F.col(role) == 2, F.col(sender)).otherwise(F.col(receiver))
    a = events.where(F.col(role).isin(1, 2)).select(position, sender, target.alias("target"), F.floor(F.col(position) / every).alias("block"))
    j = a.join(active, "block")
    free = F.array_except("hosts", F.array("target", sender))
    keyed = F.array_sort(F.transform(free, lambda h: F.struct(portable_hash(h, F.col(position) + seed).alias("k"), h.alias("h"))))
    return j.select(position, sender, "target", F.transform(F.slice(keyed, 1, n), lambda x: x["h"]).alias("negatives"))


def active_sets(events: DataFrame, every: int, cap: int | None = None, position: str = "position", sender: str = "sender", receiver: str = "receiver") -> DataFrame:
    """Per block of `every` events the distinct hosts of the block before it (at most two an event), or the `cap` most recent ones."""
    ends = events.select(F.col(position).alias("_p"), F.floor(F.col(position) / every).alias("_b"), F.explode(F.array(sender, receiver)).alias("host"))
    last = ends.groupBy((F.col("_b") + 1).alias("block"), "host").agg(F.max("_p").alias("_p"))
    if cap is not None:
        w = Window.partitionBy("block").orderBy(F.col("_p").desc(), "host")
        last = last.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= cap)
    return last.groupBy("block").agg(F.array_sort(F.collect_list("host")).alias("hosts"))


def pairwise_accuracy(ranks: DataFrame) -> DataFrame:
    """Share of (positive, negative) score pairs ordered rightly, over pairs given row by row."""
    return ranks.agg(F.avg((F.col("positive") > F.col("negative")).cast("double")).alias("pairwise"), F.count(F.lit(1)).alias("pairs"))
