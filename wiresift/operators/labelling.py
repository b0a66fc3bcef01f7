"""Attack schedule: rule checks, labels, roles and the label audit.

A schedule is a table of a few authored rows (`schemas.RULES`). It is turned into lookup tables keyed on what the data
can be joined on, so that labelling is one hash lookup per row and no data row is ever duplicated.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wiresift.functions.addresses import normalize_ip
from wiresift.plans.sizes import SCHEDULE_PAIRS, broadcast_if_small
from wiresift.sources.schemas import LABEL_COLUMNS, RULES

OFFSET_HOURS = -4  # schedule clock = UTC - 4 h
EDGE_US = 120_000_000
HOUR_US = 3_600_000_000


def load_rules(spark: SparkSession, path: str) -> DataFrame:
    """Rules from JSON lines, schema-checked."""
    return spark.read.schema(RULES).option("mode", "FAILFAST").json(path)


def day_date(day: Column) -> Column:
    """The date in `Weekday-DD-MM-YYYY`."""
    return F.to_date(F.substring_index(day, "-", -3), "dd-MM-yyyy")


def check_rules(rules: DataFrame) -> DataFrame:
    """One row per broken rule with the reason; an empty result is a valid schedule."""
    empty = lambda c: (F.size(F.filter(F.coalesce(c, F.array()), lambda x: F.trim(x) != "")) <= 0)
    clock = lambda c: F.try_to_timestamp(F.concat(F.lit("2000-01-01 "), c))
    reason = (F.when(empty(F.col("attacker_ips")) | empty(F.col("victim_ips")), "empty endpoint set")
              .when(clock(F.col("start")).isNull() | clock(F.col("end")).isNull(), "invalid time")
              .when(clock(F.col("start")) > clock(F.col("end")), "start after end")
              .when(F.exists(F.coalesce("service_ports", F.array()), lambda p: p.isNull() | ~p.between(0, 65535))
                    | F.exists(F.coalesce("protocols", F.array()), lambda p: p.isNull()), "ports or protocols not integers"))
    return rules.select("name", "rule_order", reason.alias("reason")).where(F.col("reason").isNotNull())


def utc_rules(rules: DataFrame, offset_hours: int = OFFSET_HOURS) -> DataFrame:
    """Rules with their windows as inclusive UTC microsecond bounds; the data's clock is never shifted."""
    at = lambda c: F.unix_micros(F.to_timestamp(F.concat_ws(" ", day_date(F.col("day")).cast("string"), c))) - offset_hours * HOUR_US
    return rules.withColumns({
        "start_us": at(F.col("start")), "end_us": at(F.col("end")),
        "attacker_ips": F.transform("attacker_ips", lambda x: F.trim(x)), "victim_ips": F.transform("victim_ips", lambda x: F.trim(x)),
        "service_ports": F.coalesce("service_ports", F.array().cast("array<int>")),
        "protocols": F.coalesce("protocols", F.array().cast("array<int>"))})


def _pairs(rules: DataFrame) -> DataFrame:
    """(src, dst) -> its rules in list order, both orientations; one row per address pair."""
    r = utc_rules(rules).withColumn("attacker", F.explode("attacker_ips")).withColumn("victim", F.explode("victim_ips"))
    turned = lambda src, dst, heading, rank: F.struct(
        F.col(src).alias("_src"), F.col(dst).alias("_dst"), F.struct(
            "rule_order", F.lit(rank).alias("rank"), "name", F.lit(heading).alias("heading"), "confidence",
            "start_us", "end_us", "service_ports", "protocols").alias("rule"))
    r = r.select(F.inline(F.array(turned("attacker", "victim", "forward", 1), turned("victim", "attacker", "reverse", 0))))
    return r.groupBy("_src", "_dst").agg(F.array_sort(F.collect_list("rule")).alias("_rules"))


def label_by_schedule(df: DataFrame, rules: DataFrame, us: str = "us", src: str = "src_ip", dst: str = "dst_ip",
                      sport: str = "src_port", dport: str = "dst_port", proto: str = "protocol") -> DataFrame:
    """Add the five label columns. The first matching rule in list order wins; two names on one row is an error."""
    pairs = broadcast_if_small(_pairs(rules), SCHEDULE_PAIRS)  # a shuffle on address pairs would put a flood in one task
    has = lambda arr, v: (F.size(arr) == 0) | F.coalesce(F.array_contains(arr, v.cast("int")), F.lit(False))
    fits = lambda r: (F.col(us).between(r["start_us"], r["end_us"]) & has(r["protocols"], F.col(proto))
                      & has(r["service_ports"], F.when(r["heading"] == "forward", F.col(dport)).otherwise(F.col(sport))))
    # Addresses are compared in canonical text; anything with a colon takes the Arrow path.
    j = df.withColumns({"_s": normalize_ip(F.col(src)), "_d": normalize_ip(F.col(dst))})
    j = j.join(pairs, (F.col("_s") == F.col("_src")) & (F.col("_d") == F.col("_dst")), "left")
    j = j.withColumn("_hits", F.when(F.col("_rules").isNotNull(), F.filter("_rules", fits)))
    j = j.withColumn("_hit", F.when(
        F.size(F.array_distinct(F.transform("_hits", lambda r: r["name"]))) > 1,
        F.raise_error(F.lit("ambiguous overlapping attack rules"))).otherwise(F.try_element_at("_hits", F.lit(1))))
    hit = F.col("_hit")
    out = {
        "Label": F.coalesce(hit["name"], F.lit("Benign")), "attack_name": F.coalesce(hit["name"], F.lit("")),
        "label_source": F.when(hit["name"].isNotNull(), "attack_timeline").otherwise("default"),
        "label_confidence": F.coalesce(hit["confidence"], F.lit("none")),
        "label_direction": F.coalesce(hit["heading"], F.lit(""))}
    assert list(out) == LABEL_COLUMNS
    return j.withColumns(out).drop("_s", "_d", "_src", "_dst", "_rules", "_hits", "_hit")


def _rule_list(rules: DataFrame) -> DataFrame:
    """The whole schedule as one row holding an array (a schedule is a handful of rules)."""
    return utc_rules(rules).agg(F.array_sort(F.collect_list(F.struct(
        "rule_order", "name", "start_us", "end_us", "attacker_ips", "victim_ips", "service_ports", "protocols"))).alias("_schedule"))


def resolve_roles(df: DataFrame, rules: DataFrame, us: str = "us", sender: str = "sender_ip", receiver: str = "receiver_ip") -> DataFrame:
    """0 benign, 1 attacker to victim, 2 victim to attacker, 3 one named endpoint inside a window; folded in rule order."""
    s, d, t = F.col(sender), F.col(receiver), F.col(us)

    def step(role, r):
        att, vic = r["attacker_ips"], r["victim_ips"]
        inside = t.between(r["start_us"], r["end_us"])
        fa, tv, fv, ta = (F.array_contains(att, s), F.array_contains(vic, d), F.array_contains(vic, s), F.array_contains(att, d))
        return (F.when(~inside, role).when(fv & ta, F.lit(2)).when(fa & tv, F.lit(1))
                .when((fa | tv | fv | ta) & (role == 0), F.lit(3)).otherwise(role))
    j = df.join(F.broadcast(_rule_list(rules)), F.lit(True))
    return j.withColumn("role", F.aggregate("_schedule", F.lit(0), step)).drop("_schedule")


def window_name(schedule: Column, us: Column) -> Column:
    """The last rule whose window holds the time, '' for none."""
    held = F.filter(schedule, lambda r: us.between(r["start_us"], r["end_us"]))
    return F.coalesce(F.try_element_at(held, F.lit(-1))["name"], F.lit(""))


def label_disagreement(mapped: DataFrame, rules: DataFrame) -> DataFrame:
    """Packets whose label differs from their flow's, as window-edge or unexplained counts.

    `mapped` has us, packet_label, flow_start_us, flow_label; rows without a flow are not counted.
    """
    j = mapped.where(F.col("flow_label").isNotNull()).join(F.broadcast(_rule_list(rules)), F.lit(True))
    differ = F.col("packet_label") != F.col("flow_label")
    crossing = window_name(F.col("_schedule"), F.col("us")) != window_name(F.col("_schedule"), F.col("flow_start_us"))
    return j.agg(F.count(F.lit(1)).alias("joined"), F.count(F.when(differ & crossing, 1)).alias("window_edge"),
                 F.count(F.when(differ & ~crossing, 1)).alias("unexplained"))


def offset_detection(flows: DataFrame, rules: DataFrame, configured_minutes: int = OFFSET_HOURS * 60) -> DataFrame:
    """Flows aligned with their attack's windows at each quarter-hour offset; `chosen` marks the winner.

    Flows are reduced to a per-minute histogram first, and only that histogram meets the 97 offsets.
    """
    u = utc_rules(rules, 0)  # windows on the schedule clock, expressed as if it were UTC
    pairs = u.select("name", F.explode("attacker_ips").alias("a"), "victim_ips").select("name", "a", F.explode("victim_ips").alias("v"))
    pairs = pairs.select("name", F.explode(F.array(F.struct(F.col("a").alias("_s"), F.col("v").alias("_d")),
                                                   F.struct(F.col("v").alias("_s"), F.col("a").alias("_d")))).alias("p")).select(
        "name", "p.*").distinct()
    minute = F.floor(F.col("us") / 60_000_000).cast("bigint")
    pre = flows.groupBy("src_ip", "dst_ip", minute.alias("minute")).agg(F.count(F.lit(1)).alias("n"))
    hist = pre.join(broadcast_if_small(pairs, SCHEDULE_PAIRS), (F.col("src_ip") == F.col("_s")) & (F.col("dst_ip") == F.col("_d"))).groupBy("name", "minute").agg(F.sum("n").alias("n"))
    moved = hist.select("name", "n", "minute", F.explode(F.expr("transform(sequence(-48, 48), i -> i * 15)")).alias("offset_minutes"))
    local = (F.col("minute") + F.col("offset_minutes")) * 60_000_000
    spans = u.select(F.col("name").alias("_name"), "start_us", "end_us")
    held = moved.join(broadcast_if_small(spans, SCHEDULE_PAIRS), (F.col("name") == F.col("_name")) & local.between(F.col("start_us"), F.col("end_us")), "left_semi")
    every = flows.sparkSession.range(-48, 49).select((F.col("id") * 15).cast("int").alias("offset_minutes"))
    scores = every.join(held.groupBy("offset_minutes").agg(F.sum("n").alias("aligned")), "offset_minutes", "left").fillna(0)
    pick = scores.agg(F.max_by("offset_minutes", F.struct(
        "aligned", (F.col("offset_minutes") == configured_minutes).alias("same"), (-F.col("offset_minutes")).alias("early"))).alias("_best"),
        F.max("aligned").alias("_most"))
    return scores.join(F.broadcast(pick), F.lit(True)).select(
        "offset_minutes", "aligned", ((F.col("offset_minutes") == F.col("_best")) & (F.col("_most") > 0)).alias("chosen"))


def label_audit(flows: DataFrame, rules: DataFrame) -> DataFrame:
    """Per scheduled attack: rows, directions, span, captures, rows outside its windows, escaped look-alikes.

    `flows` carries us, endpoints, ports, protocol, capture and the label columns.
    """
    j = flows.join(F.broadcast(_rule_list(rules)), F.lit(True))
    t = F.col("us")
    covered = F.exists("_schedule", lambda r: t.between(r["start_us"] - EDGE_US, r["end_us"] + EDGE_US))

    def shaped(r):
        port_ok = lambda p: (F.size(r["service_ports"]) == 0) | F.array_contains(r["service_ports"], p)
        fwd = F.array_contains(r["attacker_ips"], F.col("src_ip")) & F.array_contains(r["victim_ips"], F.col("dst_ip")) & port_ok(F.col("dst_port"))
        rev = F.array_contains(r["victim_ips"], F.col("src_ip")) & F.array_contains(r["attacker_ips"], F.col("dst_ip")) & port_ok(F.col("src_port"))
        return (fwd | rev) & ((F.size(r["protocols"]) == 0) | F.array_contains(r["protocols"], F.col("protocol")))
    shapes = F.when(~covered, F.array_distinct(F.transform(F.filter("_schedule", shaped), lambda r: r["name"])))
    inside = F.exists("_schedule", lambda r: (r["name"] == F.col("Label")) & t.between(r["start_us"], r["end_us"]))
    mine = F.when(F.col("Label") != "Benign", F.array(F.struct(
        F.col("Label").alias("name"), F.lit(1).alias("labelled"), F.lit(0).alias("escaped"), (~inside).cast("int").alias("stray"))))
    theirs = F.transform(F.coalesce(shapes, F.array().cast("array<string>")), lambda n: F.struct(
        n.alias("name"), F.lit(0).alias("labelled"), F.lit(1).alias("escaped"), F.lit(0).alias("stray")))
    none = F.array().cast("array<struct<name:string,labelled:int,escaped:int,stray:int>>")
    rows = j.select("us", "capture", "label_direction", F.inline(F.concat(F.coalesce(mine, none), theirs)))
    hit = F.col("labelled") == 1
    got = rows.groupBy("name").agg(
        F.sum("labelled").alias("labelled_rows"), F.count(F.when(hit & (F.col("label_direction") == "forward"), 1)).alias("forward_rows"),
        F.count(F.when(hit & (F.col("label_direction") == "reverse"), 1)).alias("reverse_rows"),
        F.min(F.when(hit, F.col("us"))).alias("first_us"), F.max(F.when(hit, F.col("us"))).alias("last_us"),
        F.countDistinct(F.when(hit, F.col("capture"))).alias("captures"), F.sum("stray").alias("outside_rows"), F.sum("escaped").alias("escaped_rows"))
    counts = ["labelled_rows", "forward_rows", "reverse_rows", "captures", "outside_rows", "escaped_rows"]
    return rules.select("name").distinct().join(got, "name", "left").fillna(0, counts)


def audit_ports(flows: DataFrame, k: int = 4) -> DataFrame:
    """Most frequent victim and attacker ports of each attack: counts first, then a per-attack rank on the counts."""
    fwd = F.col("label_direction") == "forward"
    side = lambda name, a, b: F.struct(F.lit(name).alias("side"), F.when(fwd, F.col(a)).otherwise(F.col(b)).alias("port"))
    rows = flows.where(F.col("Label") != "Benign").select("Label", F.inline(F.array(
        side("victim", "dst_port", "src_port"), side("attacker", "src_port", "dst_port"))))
    counts = rows.groupBy("Label", "side", "port").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("Label", "side").orderBy(F.col("n").desc(), "port")
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def coverage(selected: DataFrame, processed: DataFrame, key: str = "capture") -> DataFrame:
    """Captures missing from, or extra to, the selected set."""
    missing = selected.select(key).exceptAll(processed.select(key)).withColumn("state", F.lit("missing"))
    extra = processed.select(key).exceptAll(selected.select(key)).withColumn("state", F.lit("extra"))
    return missing.unionByName(extra)
