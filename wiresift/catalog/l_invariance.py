"""Prefix invariance of the causal operators, each over the whole stream and over its first half."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wiresift.catalog import d_events as de
from wiresift.catalog import f_graph as fg
from wiresift.catalog.registry import query
from wiresift.operators import events as ev
from wiresift.operators import flows as fl
from wiresift.operators import graph as gr
from wiresift.operators import incidents as inc
from wiresift.operators import invariance as iv
from wiresift.session import pinned
from wiresift.sources import fixtures as fx

CUT_S = 20.0


def _seen(e):
    return ev.time_since_last_seen(e.withColumns({"event_id": F.col("position"), "t": F.col("us") / 1e6}), "sender", "dt")


def _ports(e):
    return ev.port_access(e.select("position", F.col("position").alias("event_id"), F.lit(0.0).alias("reversed"), F.col("sender").alias("src_node_id"), F.col("receiver").alias("dst_node_id"),
                                   F.lit(1).alias("src_port"), (F.col("k") * 3).alias("dst_port")))


def _available(e):
    return ev.availability_order(e.select(F.col("position").alias("event_id"), (F.col("us") / 1e6).alias("t_obs"), F.lit(True).alias("has_packets")))


def _alerts(e):
    runs = inc.persist_runs(e.withColumn("t_us", F.col("us")), ["sender"], fires=F.col("score") > 34, n=2)
    return inc.incidents_from_alerts(runs.where("alert"), ["sender"], CUT_S)[0]


def _packet_links(p):
    slots = p.select("flow_uid", F.col("position").alias("slot"), (F.col("us") / 1e6).alias("offset_s"), (F.col("src_port") < F.col("dst_port")).cast("int").alias("direction"))
    return ev.packet_links(slots).withColumn("position", F.col("to_slot"))


#: What is checked: the operator over a stream with `position`, and the columns that must not change.
EVENTS = {
    "w03_time_since_last_seen": (_seen, ["position", "dt"]),
    "w04_port_access": (_ports, ["position", "port_delta", "dst_port_new"]),
    "w05_availability_order": (_available, ["position", "event_id"]),
    "w11_distinct_peer_neighbours": (gr.distinct_peer_neighbours, ["position", "neighbours"]),
    "w12_causal_recent": (lambda e: gr.causal_recent(e, size=8), ["position", "node", "recent"]),
    "w15_link_state": (lambda e: gr.link_state(e, ttl_s=90.0), ["position", "gap_s", "restarted", "event_count", "summary_count", "record_count"]),
    "w17_persist_runs": (lambda e: inc.persist_runs(e, ["sender"], fires=F.col("score") > 34, n=2), ["position", "run", "alert"]),
    "w18_incidents_from_alerts": (_alerts, ["position", "sender", "nth", "opens"]),
}
PACKETS = {
    "w16_packet_links": (_packet_links, ["position", "flow_uid", "from_slot", "to_slot", "kind", "seconds"]),
    "a13_corroborated_replies": (lambda p: fl.corroborated_replies(p), ["position", "corroborated"]),
}


@query("m12_prefix_invariance", "WITH " + fx.PACKETS_CTE + ", m AS (SELECT max(frame_no) // 2 AS cut FROM packets), n AS (SELECT count(*) AS n FROM packets, m WHERE frame_no < cut) SELECT name AS operator, CASE WHEN every THEN n ELSE -1 END AS events, 0::BIGINT AS missing, 0::BIGINT AS added FROM n, (VALUES "
       + ", ".join(f"('{x}', {str(x[:3] in ('w03', 'w04', 'w05', 'w11', 'w15', 'w17') or x.startswith('a13')).lower()})" for x in (*EVENTS, *PACKETS)) + ") v(name, every)")
def _m12(spark, d):
    """Per operator: the rows compared (-1 where an event has not exactly one row) and those that a longer stream changes."""
    e, p = pinned(fg.stream(spark, d)), pinned(de.mapped(spark, d).withColumn("position", F.col("frame_no")))
    cut = e.agg(F.max("position")).first()[0] // 2
    parts = []
    for events, ops in ((e, EVENTS), (p, PACKETS)):
        for name, (op, columns) in ops.items():
            every = name[:3] in ("w03", "w04", "w05", "w11", "w15", "w17") or name.startswith("a13")
            found = iv.prefix_differences(op, events, cut, columns)
            parts.append(found.select(F.lit(name).alias("operator"), (F.col("compared") if every else F.when(F.col("compared") > 0, F.lit(-1)).otherwise(0)).cast("bigint").alias("events"), "missing", "added"))
    return reduce(DataFrame.unionByName, parts)
