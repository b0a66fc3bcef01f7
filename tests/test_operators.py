"""Hand-made edge cases and brute-force comparisons."""
import ipaddress
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wiresift.functions import addresses as addr
from wiresift.functions import scalars as sc
from wiresift.operators import events as ev
from wiresift.operators import features as ft
from wiresift.operators import flows as fl
from wiresift.operators import graph as gr
from wiresift.operators import incidents as inc
from wiresift.operators import labelling as la
from wiresift.operators import mapping as mp
from wiresift.operators import segments
from wiresift.operators import splits as sp
from wiresift.operators import telemetry as te
from wiresift.sources import tables as tb
from wiresift.sources.schemas import RULES
from wiresift.streaming import replay as rp
from wiresift.streaming import sinks as sk

US = 1_000_000


def test_normalize_ip(spark):
    r = random.Random(0)
    raw = [" 10.0.0.1 ", None, "", "x", "::1", "2001:DB8:0:0:0:0:0:1", "fe80::0:1:0:0", "1:0:0:2:0:0:3:4", "::", "1::", "::ffff:1.2.3.4", "1:2:3", ":::", "g::1", "1::2::3", "0001:0:0:0:5:0:0:0"]
    raw += [":".join("%x" % r.choice([0, 0, 0, 1, 0xabcd]) for _ in range(8)) for _ in range(60)]

    def want(x):
        t = (x or "").strip()
        try:
            return str(ipaddress.ip_address(t))
        except ValueError:
            return t
    got = {row.i: row.n for row in spark.createDataFrame(list(enumerate(raw)), "i int, x string").select("i", addr.normalize_ip(F.col("x")).alias("n")).collect()}
    assert got == {i: want(x) for i, x in enumerate(raw)}


def test_flow_key_is_the_same_both_ways(spark):
    df = spark.createDataFrame([("10.0.0.10", 80, "10.0.0.9", 4000, 6)], "a string, p int, b string, q int, n int")
    c = {k: F.col(k) for k in "apbqn"}
    x = df.select(sc.canonical_flow_key(c["a"], c["p"], c["b"], c["q"], c["n"]).alias("f"), sc.canonical_flow_key(c["b"], c["q"], c["a"], c["p"], c["n"]).alias("r")).first()
    assert x.f == x.r == "10.0.0.10:80|10.0.0.9:4000|6"


def test_reversed_orientation(spark):
    rows = [("a", "80", "5000", None, None, 1.0), ("a", "5000", "80", None, None, 0.0), ("a", "80", "80", None, None, -1.0), ("a", "x", "80", None, None, -1.0), ("a", "80", "5000", "a", "80", 0.0), ("a", "5000", "80", "b", "80", 1.0)]
    df = spark.createDataFrame(rows, "src string, sp string, dp string, ip string, port string, want double")
    assert all(r.got == r.want for r in df.select("want", sc.is_reversed(F.col("src"), F.col("sp"), F.col("dp"), F.col("ip"), F.col("port")).alias("got")).collect())


def test_service_response_needs_evidence(spark):
    rows = [("TCP", "8.8.8.8", "10.0.0.1", 443, 50000, True), ("TCP", "8.8.8.8", "10.0.0.1", 443, 50000, False), ("TCP", "10.0.0.1", "10.0.0.2", 50000, 6379, False)]
    df = spark.createDataFrame(rows, "transport string, src_ip string, dst_ip string, src_port int, dst_port int, established boolean").withColumn("gvcp_discovery", F.lit(False))
    got = [(r.traffic_class, r.connection_role, r.is_internal_service) for r in addr.service_tags(df).orderBy("dst_port", F.col("established").desc()).collect()]
    assert got == [("INTERNAL_SERVICE", "INTERNAL_CLIENT", True), ("RESPONSE_TRAFFIC", "SERVER_RESPONSE", False), ("UNKNOWN", "UNKNOWN", False)]


def packets(spark, rows):
    """rows: frame, us, src, sport, dst, dport, proto, flags text"""
    out = []
    for f, us, s, sp_, d, dp, pr, flags in rows:
        out.append((f, us, s, sp_, d, dp, pr, 100, 60, *[int(x in flags) for x in "SAFRPU"], 64, 1000, 0, 0, 0, f % 7))
    return spark.createDataFrame(out, "frame_no bigint, us bigint, src_ip string, src_port int, dst_ip string, dst_port int, protocol int, length int, payload_len int, tcp_flag_syn int, tcp_flag_ack int, "
                                 "tcp_flag_fin int, tcp_flag_rst int, tcp_flag_psh int, tcp_flag_urg int, ttl int, tcp_window int, ip_flag_mf int, ip_frag_offset int, tcp_retransmission int, tcp_seq bigint")


def brute_map(p, f, slack):
    out = {}
    for frame, key, us in p:
        best = None
        for uid, k, a, b in f:
            if k == key and a <= us <= b + slack and (best is None or (a, b, uid) > best[:3]):
                best = (a, b, uid)
        out[frame] = best and best[2]
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_interval_mapping_equals_brute_force(spark, seed):
    r = random.Random(seed)
    keys = ["hot"] * 6 + ["b", "c", "none"]
    f = [(f"u{i:03d}", r.choice(keys[:-1]), a, a + r.choice([0, 5, 50, 400])) for i, a in enumerate(r.randrange(0, 1000) for _ in range(120))]
    p = [(i, r.choice(keys), r.randrange(0, 1500)) for i in range(400)]
    pf = spark.createDataFrame(p, "frame_no bigint, flow_key string, us bigint")
    ff = spark.createDataFrame(f, "flow_uid string, flow_key string, start_us bigint, end_us bigint")
    got = {x.frame_no: x.flow_uid for x in mp.map_packets_to_flows(pf, ff, slack_us=3, rows_per_chunk=11).collect()}
    assert got == brute_map(p, f, 3)


def test_packet_past_its_window_falls_back_to_the_containing_one(spark):
    ff = spark.createDataFrame([("outer", "k", 0, 100), ("inner", "k", 10, 20)], "flow_uid string, flow_key string, start_us bigint, end_us bigint")
    pf = spark.createDataFrame([(1, "k", 15), (2, "k", 50), (3, "k", 500), (4, "z", 15)], "frame_no bigint, flow_key string, us bigint")
    got = {x.frame_no: x.flow_uid for x in mp.map_packets_to_flows(pf, ff, 0).collect()}
    assert got == {1: "inner", 2: "outer", 3: None, 4: None}


def segments_of(rows, timeout):
    """Plain fold over one key."""
    start, out = None, []
    for frame, us, fin in rows:
        if start is not None and us - start > timeout:
            start = None
        if start is None:
            start = us
            out.append([frame])
            continue
        out[-1].append(frame)
        if fin:
            start = None
    return out


@pytest.mark.parametrize("chunk", [3, 1000])
def test_segments_equal_a_plain_fold(spark, chunk):
    r = random.Random(4)
    us, rows = 0, []
    for i in range(300):
        us += r.choice([1, 5, 20, 60, 130]) * US
        rows.append((i, us, "a", 1, "b", 2, 6, "F" if r.random() < 0.3 else "A"))
    got = {}
    for x in fl.segment_packets(packets(spark, rows), rows_per_chunk=chunk).collect():
        got.setdefault(x.segment, []).append(x.frame_no)
    want = segments_of([(f, u, fl_ == "F") for f, u, *_, fl_ in rows], 120 * US)
    assert sorted(sorted(v) for v in got.values()) == sorted(want)


@pytest.mark.parametrize("fins,span", [(0.0, 3), (0.05, 30)])
def test_one_conversation_with_a_third_of_all_packets(spark, fins, span):
    """Chunks of a conversation that never pauses, with clocks that step back; the others are too small to be cut. Sixteen-fold composition goes over three levels."""
    r = random.Random(int(span + 100 * fins))
    us, rows = 0, []
    for i in range(3000):
        us += r.randrange(span * US)
        at = us - r.choice([0, 0, 0, 90 * US])
        who = ("a", 1, "b", 2) if i % 3 == 0 else (f"h{r.randrange(400)}", 1, "b", 2)
        rows.append((i, at, *(who if r.random() < 0.5 else who[2:] + who[:2]), 6, "F" if r.random() < fins else "A"))
    want = set()
    for key in {frozenset((x[2], x[4])) for x in rows}:
        want |= {tuple(s) for s in segments_of([(x[0], x[1], x[7] == "F") for x in rows if {x[2], x[4]} == key], 120 * US)}
    for chunk in (10, 200):
        got = {}
        for x in fl.segment_packets(packets(spark, rows), rows_per_chunk=chunk).collect():
            got.setdefault(x.segment, []).append(x.frame_no)
            assert (x.segment == x.frame_no) == (x.opens == 1)
        assert {tuple(sorted(v)) for v in got.values()} == want


def test_step_functions_compose():
    """Composed functions of chunks equal the fold over their rows, from any start."""
    r = np.random.default_rng(3)
    for _ in range(60):
        us = np.cumsum(r.integers(0, 30, 40)) - r.integers(0, 20, 40)
        fin = r.random(40) < r.choice([0, 0.1])
        heads = np.array([0, 10, 13, 30])
        parts = list(segments.Block(us, fin, np.arange(40), heads, 60).steps())
        step = parts[0]
        for p in parts[1:]:
            step = segments.composed(step, p)
        for start in range(-150, 300, 7):
            now = (start, -7)
            for i in range(40):
                if us[i] - now[0] > 60:
                    now = (us[i], i)
                elif fin[i]:
                    now = (segments.NONE, -1)
            got = segments.after(step, np.array([start]), np.array([-7]))
            assert (got[0][0], got[1][0]) == now


def test_segment_orientation_survives_a_timeout_but_not_a_fin(spark):
    rows = [(0, 0, "a", 1, "b", 2, 6, "S"), (1, US, "b", 2, "a", 1, 6, "A"), (2, 200 * US, "b", 2, "a", 1, 6, "A"), (3, 201 * US, "a", 1, "b", 2, 6, "F"), (4, 202 * US, "b", 2, "a", 1, 6, "A"), (5, 203 * US, "a", 1, "b", 2, 6, "A")]
    got = [(x.first_frame, x.src_ip, x.closed_by_fin) for x in fl.segment_flows(packets(spark, rows), rows_per_chunk=2).orderBy("first_frame").collect()]
    assert got == [(0, "a", 0), (2, "a", 1), (4, "b", 0)]


def test_flow_states(spark):
    cases = {"est": ["S", "SA", "A"], "closed": ["S", "SA", "F", "FA", "A"], "wait": ["S", "SA", "AF"], "reset": ["S", "R", "SA"], "init": ["A", "A"], "sent": ["S", "P"], "ack": ["S", "A"], "synfin": ["SAF", "A"]}
    rows, f = [], 0
    for i, (name, flags) in enumerate(cases.items()):
        for x in flags:
            rows.append((f, f * US, name, 1, "srv", 2, 6, x))
            f += 1
    p = packets(spark, rows).withColumn("flow_key", F.col("src_ip"))
    got = {x.flow_key: x.state for x in fl.flow_state(p, rows_per_chunk=2).collect()}
    assert got == {"est": "ESTABLISHED", "closed": "CLOSED", "wait": "FIN_WAIT", "reset": "RESET", "init": "INIT", "sent": "SYN_SENT", "ack": "ESTABLISHED", "synfin": "FIN_WAIT"}


def test_flow_statistics_single_packet_and_idle(spark):
    rows = [(0, 0, "b", 2, "a", 1, 6, "S")] + [(i, t * US, *(("a", 1, "b", 2) if i % 2 else ("b", 2, "a", 1)), 17, "") for i, t in enumerate([1, 2, 10, 11, 30], 1)]
    p = packets(spark, rows).withColumns({"flow_uid": F.when(F.col("frame_no") == 0, "one").otherwise("many"), "header_len": F.lit(20)})
    got = {r["flow_uid"]: r for r in fl.flow_statistics(p, rows_per_chunk=2).collect()}
    one, many = got["one"], got["many"]
    assert one["Flow Pkts/s"] == 0 and one["Tot Fwd Pkts"] == 1 and one["Pkt Len Std"] == 0
    assert (many["Tot Fwd Pkts"], many["Tot Bwd Pkts"]) == (3, 2)
    assert many["Idle Max"] == 19 * US and many["Idle Min"] == 8 * US and many["Active Max"] == US and many["Active Min"] == US
    assert many["Fwd IAT Tot"] == 29 * US


def history(spark, n=250, seed=0, hosts=6):
    r = random.Random(seed)
    rows = [(i, i // 3 * US, 0 if r.random() < 0.4 else r.randrange(hosts), r.randrange(hosts), r.random() < 0.2, r.random()) for i in range(n)]
    return rows, spark.createDataFrame(rows, "position bigint, us bigint, sender int, receiver int, attack boolean, score double")


def brute_neighbours(rows, size):
    out = {}
    for i, (_, _, s, d, *_r) in enumerate(rows):
        found = []
        for end, peer, ei, pi in ((s, d, 2, 3), (d, s, 3, 2)):
            last = {}
            for row in rows[:i]:
                if row[ei] == end and row[pi] != peer:
                    last[row[pi]] = row[0]
            found += last.values()
        out[i] = sorted(found, reverse=True)[:size]
    return out


@pytest.mark.parametrize("chunk", [13, 10_000])
def test_neighbours_equal_brute_force(spark, chunk):
    rows, df = history(spark)
    got = {r.position: r.neighbours for r in gr.distinct_peer_neighbours(df, size=4, rows_per_chunk=chunk).collect()}
    assert got == brute_neighbours(rows, 4)


@pytest.mark.parametrize("chunk", [9, 10_000])
def test_causal_recent_excludes_ties(spark, chunk):
    rows, df = history(spark)
    got = {r.position: [(x.position, x.peer) for x in r.recent] for r in gr.causal_recent(df, size=3, rows_per_chunk=chunk).collect()}
    for i, us, s, *_ in rows:
        before = [(r[0], r[3] if r[2] == s else r[2]) for r in rows if s in r[2:4] and r[1] < us]
        assert got[i] == before[::-1][:3]


def prefix_invariant(op, df, cut, cols):
    whole = sorted(map(tuple, op(df).where(F.col("position") < cut).select(cols).collect()), key=str)
    part = sorted(map(tuple, op(df.where(F.col("position") < cut)).select(cols).collect()), key=str)
    assert whole == part


def test_causal_operators_do_not_look_ahead(spark):
    _, df = history(spark, 180)
    ops = {
        "neighbours": (lambda d: gr.distinct_peer_neighbours(d, size=5), ["position", "neighbours"]),
        "recent": (lambda d: gr.causal_recent(d, size=5), ["position", "recent"]),
        "link state": (lambda d: gr.link_state(d.withColumn("kind", F.lit("event")), ttl_s=20), ["position", "gap_s", "restarted", "event_count"]),
        "runs": (lambda d: inc.persist_runs(d, ["sender"], fires=F.col("score") > 0.5), ["position", "run", "alert"]),
        "last seen": (lambda d: ev.time_since_last_seen(d.withColumns({"event_id": F.col("position"), "t": F.col("us") / 1e6}), "sender", "dt"), ["position", "dt"]),
        "ports": (lambda d: ev.port_access(d.select("position", F.col("position").alias("event_id"), F.lit(0.0).alias("reversed"), F.col("sender").alias("src_node_id"), F.col("receiver").alias("dst_node_id"),
                                                    F.lit(1).alias("src_port"), (F.col("receiver") * 3).alias("dst_port"))), ["position", "port_delta", "dst_port_new"]),
    }
    for op, cols in ops.values():
        prefix_invariant(op, df, 97, cols)


def test_campaigns(spark):
    flags = [1, 0, 0, 1, 0, 0, 0, 1, 1]
    df = spark.createDataFrame([(i, "h", bool(x)) for i, x in enumerate(flags)], "position bigint, host string, attack boolean")
    got = [r.campaign for r in gr.campaigns(df, F.col("attack"), quiet=3, rows_per_chunk=2).orderBy("position").collect()]
    assert got == [0, -1, -1, 0, -1, -1, -1, 1, 1]


def test_run_is_broken_by_one_low_event_and_gap_is_strict(spark):
    rows = [(i, "f", 1, t * US, s, 1.0) for i, (t, s) in enumerate([(0, 2), (1, 2), (2, 0), (3, 2), (4, 2), (5, 2), (125, 2), (246, 2)])]
    df = spark.createDataFrame(rows, "position bigint, family string, sender bigint, t_us bigint, score double, threshold double".replace("score double", "score int"))
    r = inc.persist_runs(df, ["family", "sender"], rows_per_chunk=3)
    assert [x.run for x in r.orderBy("position").collect()] == [1, 2, 0, 1, 2, 3, 4, 5]
    _, i = inc.incidents_from_alerts(r.where("alert"), ["family", "sender"], 120, rows_per_chunk=3)
    # 5 -> 125 is exactly the gap: same incident; 125 -> 246 is past it: a new one.
    assert sorted((x.opened_us // US, x.last_alert_us // US) for x in i.collect()) == [(5, 125), (246, 246)]


def rule(name, start, end, order, attackers=("A",), victims=("V",), ports=(), protos=()):
    return (name, "Monday-01-01-2024", start, end, list(attackers), list(victims), list(ports), list(protos), "time_endpoint", order)


def at(h, m, s=0):
    return (1704067200 + (h + 4) * 3600 + m * 60 + s) * US


def test_labels_and_direction(spark):
    r = spark.createDataFrame([rule("X", "10:00:00", "11:00:00", 0, ports=(80,)), rule("X", "11:00:00", "12:00:00", 1)], RULES)
    rows = [(0, at(10, 0), "A", "V", 5, 80, 6), (1, at(10, 30), "V", "A", 80, 5, 6), (2, at(10, 30), "A", "V", 5, 81, 6), (3, at(11, 0), "A", "V", 5, 81, 6), (4, at(12, 0, 1), "A", "V", 5, 80, 6), (5, at(10, 30), "A", "Z", 5, 80, 6)]
    df = spark.createDataFrame(rows, "i int, us bigint, src_ip string, dst_ip string, src_port int, dst_port int, protocol int")
    got = {x.i: (x.Label, x.label_direction) for x in la.label_by_schedule(df, r).collect()}
    assert got == {0: ("X", "forward"), 1: ("X", "reverse"), 2: ("Benign", ""), 3: ("X", "forward"), 4: ("Benign", ""), 5: ("Benign", "")}


def test_ambiguous_rules_are_an_error(spark):
    r = spark.createDataFrame([rule("X", "10:00:00", "11:00:00", 0), rule("Y", "10:30:00", "12:00:00", 1)], RULES)
    df = spark.createDataFrame([(at(10, 45), "A", "V", 1, 2, 6)], "us bigint, src_ip string, dst_ip string, src_port int, dst_port int, protocol int")
    with pytest.raises(Exception, match="ambiguous"):
        la.label_by_schedule(df, r).collect()


def test_rank_split_small_families(spark):
    w = spark.createDataFrame([], "start_us bigint, end_us bigint")
    rows = [(i, i * 600 * US, "Benign") for i in range(20)] + [(100, 0, "one"), (101, 0, "two"), (102, 600 * US, "two"), *[(110 + i, i * 1200 * US, "three") for i in range(3)]]
    df = spark.createDataFrame(rows, "position bigint, us bigint, label string")
    got = {x.position: x.split for x in sp.stratified_split(df, w, "position", rows_per_chunk=4).collect()}
    assert got[100] == got[101] == got[102] == 0 and [got[110], got[111], got[112]] == [0, 1, 2]


def test_dropped_twins_and_orientation_error(spark):
    e = spark.createDataFrame([("k", "a", True), ("k", "b", False), ("z", "c", False)], "flow_key string, flow_uid string, has_packets boolean")
    assert sorted(r.flow_uid for r in ev.drop_represented_twins(e).collect()) == ["a", "c"]
    bad = spark.createDataFrame([("x", "a", "b", 1, 2)], "first_sender string, src_ip string, dst_ip string, src_node_id int, dst_node_id int")
    with pytest.raises(Exception, match="neither endpoint"):
        ev.orient_endpoints(bad).collect()


def test_misaligned_tables_are_an_error(spark):
    a, b = spark.range(5).withColumnRenamed("id", "event_id"), spark.range(4).withColumnRenamed("id", "event_id").withColumn("x", F.lit(1))
    with pytest.raises(Exception, match="do not line up"):
        ev.join_event_tables(a, b).collect()
    assert ev.join_event_tables(a, a.withColumn("x", F.lit(1))).count() == 5


def test_feature_leak_is_refused():
    with pytest.raises(ValueError):
        ft.check_features(["length", "label"])


def test_window_gap_skips_backward_steps(spark):
    rows = [(0, 0, "a", 1, "b", 2, 6, "S"), (1, 3000, "a", 1, "b", 2, 6, "S"), (2, 1000, "a", 1, "b", 2, 6, "S"), (3, 5000, "a", 1, "b", 2, 6, "S")]
    p = packets(spark, rows).withColumns({"is_dns": F.lit(False), "is_icmp_echo": F.lit(False), "tcp_seq": F.lit(1)})
    for chunk in (1, 100):
        t = te.window_telemetry(p, rows_per_chunk=chunk).first()
        assert (t.iat_min_us, t.iat_max_us, t.syn_count, t.syn_ack_ratio, t.approx_incomplete_connections) == (3000.0, 4000.0, 4, 4.0, 4)
        assert t.tcp_retransmissions_count == 2


def test_flooded_window_survives_chunks(spark):
    rows = [(i, i * 10, "a", 1, "b", 2, 6, "S") for i in range(500)] + [(500, 25 * US, "a", 1, "b", 2, 6, "S")]
    p = packets(spark, rows).withColumns({"is_dns": F.lit(False), "is_icmp_echo": F.lit(False)})
    a, b = (te.window_telemetry(p, rows_per_chunk=c).orderBy("window_index").collect() for c in (7, 10_000))
    assert a == b and [r.total_packets for r in a] == [500, 0, 1]


def test_ledger_is_idempotent_and_keeps_the_larger_flag(spark):
    t = tb.BatchTable(spark, rp.scratch(spark, "ledger"))
    step = sk.incident_ledger(t, ["k"], "at", merged="incident", retention_us=100)
    rows = lambda *r: spark.createDataFrame(list(r), "k string, at bigint, incident int, note string")
    step(rows(("a", 10, 1, "first"), ("b", 20, 0, "b")), 0)
    step(rows(("a", 10, 0, "again"), ("c", 115, 0, "c")), 1)
    step(rows(("a", 10, 0, "again"), ("c", 115, 0, "c")), 1)
    got = {r.k: (r.incident, r.note) for r in t.before(2, "k string, at bigint, incident int, note string").collect()}
    assert got == {"b": (0, "b"), "c": (0, "c")}


def test_calibration_log_clears_after_a_long_silence(spark):
    t = tb.BatchTable(spark, rp.scratch(spark, "log"))
    step = sk.score_log(t, duration_s=1000, max_gap_s=50)
    rows = lambda *r: spark.createDataFrame([("n", f, s * US, float(x)) for f, s, x in r], "name string, flow string, t_us bigint, score double")
    schema = "name string, flow string, t_us bigint, score double, start_us bigint"
    step(rows(("a", 0, 1), ("b", 40, 2)), 0)
    step(rows(("b", 60, 9), ("c", 80, 3)), 1)
    got = {(r.flow, r.score, r.start_us // US) for r in t.before(2, schema).collect()}
    assert got == {("a", 1.0, 0), ("b", 2.0, 0), ("c", 3.0, 0)}
    step(rows(("d", 200, 4)), 2)
    assert {(r.flow, r.start_us // US) for r in t.before(3, schema).collect()} == {("d", 200)}


def test_adaptive_threshold_never_drops_below_the_baseline(spark):
    """Against the plain quantile of all scores and the newest ones, batch after batch; a batch that runs again changes nothing."""
    t = tb.BatchTable(spark, rp.scratch(spark, "adaptive"))
    step = sk.adaptive_threshold(t, baseline=0.5, budget=0.1, recent=20, warmup=30)
    r, everything = random.Random(2), []
    for batch, (n, high) in enumerate([(20, 1.0), (40, 0.9), (0, 1.0), (100, 0.7), (300, 0.2)]):
        new = [(len(everything) + i, round(r.random() * high, 2)) for i in range(n)]
        everything += new
        for _ in range(2 if batch == 3 else 1):
            step(spark.createDataFrame(new, "event_id bigint, score double"), batch)
        state = t.before(batch + 1, sk.ADAPTIVE).collect()
        pool = sorted([x for _, x in everything] + [x for _, x in everything[-20:]])
        quantile = pool[math.ceil((len(pool) - 1) * (1 - max(0.1, 4 / len(everything))))]
        assert {(x.seen, x.threshold) for x in state} == {(len(everything), max(0.5, quantile) if len(everything) >= 30 else 0.5)}
        assert sum(x.n for x in state if x.event_id is None) == len(everything) and sorted(x.event_id for x in state if x.event_id is not None) == [i for i, _ in everything[-20:]]


def test_day_names_sort_by_date(spark):
    d = spark.createDataFrame([("Friday-02-03-2018",), ("Wednesday-14-02-2018",), ("odd",)], "day string")
    assert [r.day for r in tb.list_days(d).collect()] == ["odd", "Wednesday-14-02-2018", "Friday-02-03-2018"]


def test_interrupted_day_is_rebuilt(spark):
    root = rp.scratch(spark, "days")
    df = spark.range(3)
    assert tb.write_day_table(df, root, "d", "1") and not tb.write_day_table(df, root, "d", "1") and tb.write_day_table(df, root, "d", "2")


def test_evidence_pulls_in_pending_crossings(spark):
    s = [1, 1, 0, 1, 1, 1, 1]
    df = spark.createDataFrame([(i, "f", 7, i * US, float(x), 1.0) for i, x in enumerate(s)], "position bigint, family string, sender bigint, t_us bigint, score double, threshold double")
    got = sorted((r.position, r.run, r.opened_us // US) for r in inc.incident_evidence(df, ["family", "sender"], rows_per_chunk=2).collect())
    assert got == [(3, 1, 5), (4, 2, 5), (5, 3, 5), (6, 4, 5)]


class _Cluster:
    """Just enough of a session to ask for its checkpoint folder."""
    def __init__(self, master, named=None):
        self.sparkContext = self
        self.master, self.named, self.set = master, named, None
        self.conf = self

    def getCheckpointDir(self):
        return self.set

    def setCheckpointDir(self, path):
        self.set = path

    def getConf(self):
        return self

    def get(self, key, default=None):
        return self.named


def test_checkpoint_folder_is_named_on_a_cluster():
    from wiresift.session import ensure_checkpoint_dir
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(_Cluster("spark://host:7077"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(_Cluster("local-cluster[2,1,1024]"))
    assert ensure_checkpoint_dir(_Cluster("yarn", "hdfs:///shared")) == "hdfs:///shared"
    assert ensure_checkpoint_dir(_Cluster("local[4]"))


def test_discovery_from_local_use_blocks(spark):
    inside = ["10.1.2.3", "169.254.1.5", "172.16.0.1", "192.168.7.7", "198.18.0.9", "192.0.2.1", "198.51.100.4", "203.0.113.8", "240.0.0.1", "0.1.2.3", "192.0.0.8"]
    outside = ["127.0.0.1", "8.8.8.8", "100.64.0.1", "224.0.0.1", "172.32.0.1", "192.0.0.9", "::1", "fc00::1", "", None]
    df = spark.createDataFrame([(x,) for x in inside + outside], "src string").withColumn("p", F.unhex(F.lit("420100020000FFFF")))
    flag = addr.gvcp_discovery_flag(F.lit(17), F.col("src"), F.lit("255.255.255.255"), F.lit(3956), F.lit(0), F.lit(0), F.col("p"), F.length("p"))
    assert [r.f for r in df.select(flag.alias("f")).collect()] == [True] * len(inside) + [False] * len(outside)


def test_dns_names_of_any_length(spark):
    def query(labels, end="00"):
        return "ABCD01000001000000000000" + "".join(f"{n:02X}" + "61" * n for n in labels) + end + "00010001"
    rows = [(query([1] * 140), True), (query([1] * 247), True), (query([63, 63, 63]), True), (query([64]), False), (query([]), True), ("ABCD01000001000000000000", False), (query([5])[:-2], False), (None, False)]
    df = spark.createDataFrame(rows, "h string, want boolean").withColumn("p", F.unhex("h"))
    flag = addr.routine_dns_flag(F.lit(17), F.lit(53), F.lit(0), F.lit(0), F.col("p"), F.length("p"))
    assert [(r.got, r.want) for r in df.select(flag.alias("got"), "want").collect() if r.got != r.want] == []


def test_addresses_are_checked_whole(spark):
    rows = [("1.2.3.4", True), ("::", True), ("fe80::1", True), ("1:2:3:4:5:6:7:8", True), ("::ffff:1.2.3.4", True), (":::::", False), ("1::2::3", False), ("1:2:3", False), ("12345::", False), ("::ffff:1.2.3.400", False), ("1.2.3", False), ("", False), (None, False)]
    df = spark.createDataFrame(rows, "ip string, want boolean")
    assert all(r.got == r.want for r in df.select(addr.is_address(F.col("ip")).alias("got"), "want").collect())


def test_clock_columns_are_no_features():
    from wiresift.sources.schemas import FLOW_STATISTICS, RECORD_STATISTICS
    ft.check_features(RECORD_STATISTICS)
    for c in set(FLOW_STATISTICS) - set(RECORD_STATISTICS):
        with pytest.raises(ValueError):
            ft.check_features(["length", c])


def test_every_event_of_a_large_incident_counts(spark):
    e = spark.range(31_000).select(F.lit(1).alias("incident"), F.col("id").alias("event_id"))
    got = inc.incident_events(e)
    assert got.count() == 31_000 and got.where("truncated").count() == 0
    assert inc.incident_events(e, 30_000, 10).count() == 10


def test_replay_keeps_order_in_one_pass(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("position")).repartition(6)
    seen = []
    rp.run_batches(rp.staged(df, "position", 4), lambda b, i: seen.append([r.position for r in b.collect()]))
    assert len(seen) == 4 and [min(x) for x in seen] == sorted(min(x) for x in seen) and sorted(x for b in seen for x in b) == list(range(5000))
    assert all(max(a) < min(b) for a, b in zip(seen, seen[1:]))


def test_nearest_hosts_against_brute_force(spark):
    from wiresift.operators import forecast as fo
    r = random.Random(12)
    hosts = [(h, r.randrange(0, 3000) if r.random() < 0.9 else None, r.randrange(0, 400)) for h in range(1500)]
    hosts = [(h, None if ip is None else (ip if ip < 1500 else ip * 5000), 0 if h < 40 else first) for h, ip, first in hosts]
    events = [(p, r.randrange(12), r.randrange(40)) for p in range(400)]
    asked = [(p // 20, p, events[p][1]) for p in range(19, 400, 20)]
    e = spark.createDataFrame(events, "position long, sender long, receiver long")
    got = {}
    for x in fo.proximity_ranking(e, spark.createDataFrame(asked, "forecast long, position long, sender long"), spark.createDataFrame(hosts, "host long, ip_number long, first_position long"), cap=9).collect():
        got.setdefault(x.forecast, {})[x.rank] = (x.distance, x.host)
    ip = {h: i for h, i, _ in hosts}
    for forecast, at, attacker in asked:
        last = [b for p, a, b in events if a == attacker and p <= at][-3:]
        near = [ip[b] for b in last if ip[b] is not None]
        want = sorted((min(abs(i - t) for t in near), h) for h, i, first in hosts if i is not None and first <= at and h != attacker)[:9] if near else []
        assert [got.get(forecast, {})[k] for k in sorted(got.get(forecast, {}))] == want


@pytest.mark.parametrize("rows", [16, 1 << 16])
def test_places_in_whole_lists_against_brute_force(spark, rows):
    """The place of any host, by distance and by popularity, counted without listing the others: also without an address, at equal distances, and not contacted of late."""
    from wiresift.operators import forecast as fo
    r = random.Random(13)
    hosts = [(h, r.choice([r.randrange(0, 300), r.randrange(0, 5), 2**32 - 1, 0]) if h < 4 or h > 8 and r.random() < 0.9 else None, 0 if h < 12 or h == 99 else r.randrange(0, 400)) for h in range(300)]
    events = [(p, r.randrange(12), r.choice([*range(12), 5, 6, 7, 8])) for p in range(400)] + [(400 + k, 99, 5) for k in range(20)]
    asked = [(p // 20, p, events[p][1]) for p in range(19, 420, 20)]
    e = spark.createDataFrame(events, "position long, sender long, receiver long")
    f = spark.createDataFrame(asked, "forecast long, position long, sender long")
    h = spark.createDataFrame(hosts, "host long, ip_number long, first_position long")
    pairs = [(k, x) for k in range(21) for x in r.sample(range(300), 60)] + [(k, k % 12) for k in range(21)]
    p = spark.createDataFrame(pairs, "forecast long, host long")
    near = {(x.forecast, x.host): (x["rank"], x.distance) for x in fo.proximity_places(p, e, f, h, rows=rows).collect()}
    popular = {(x.forecast, x.host): (x["rank"], x.popularity) for x in fo.popularity_places(p, e, f, h, 100, 20, rows=rows).collect()}
    seen = {x.forecast: x.n for x in fo.hosts_seen(f, h, rows=rows).collect()}
    first = {n: {} for n in ("near", "popular")}
    for name, rows_ in (("near", fo.proximity_first(e, f, h, 13)), ("popular", fo.popularity_first(e, f, h, 13, 100, 20))):
        for x in rows_.collect():
            first[name].setdefault(x.forecast, {})[x["rank"]] = (x.host, x[2])
    ip = {host: i for host, i, _ in hosts}
    for forecast, at, attacker in asked:
        own = [x for x, _, begun in hosts if begun <= at and x != attacker]
        targets = [ip[b] for b in [b for _, a, b in events[:at + 1] if a == attacker][-3:] if ip[b] is not None]
        far = {x: None if ip[x] is None or not targets else min(abs(ip[x] - t) for t in targets) for x in own}
        block = at // 20
        count = {x: sum(1 for q, _, b in events if b == x and block - 5 <= q // 20 < block) for x in own}
        lists = sorted(own, key=lambda x: (far[x] is None, far[x] or 0, x)), sorted(own, key=lambda x: (-count[x], x))
        assert seen[forecast] == len(own)
        for got, value, order in ((near, far, lists[0]), (popular, count, lists[1])):
            mine = {x: got[forecast, x] for k, x in pairs if k == forecast and (k, x) in got}
            assert mine == {x: (order.index(x), value[x]) for k, x in pairs if k == forecast and x in value}
        assert first["near"][forecast] == {i: (x, far[x]) for i, x in enumerate(lists[0][:13])}
        assert first["popular"][forecast] == {i: (x, count[x]) for i, x in enumerate(lists[1][:13])}


def test_dominance_counts(spark):
    from wiresift.plans import dominance
    r = np.random.default_rng(1)
    a, b, x, y = (r.integers(0, 50, n) for n in (400, 400, 300, 300))
    assert (dominance.dominated(a, b, x, y) == [((a < i) & (b < j)).sum() for i, j in zip(x, y)]).all()
    points = spark.createDataFrame(pd.DataFrame({"x": a, "y": b}))
    corners = spark.createDataFrame(pd.DataFrame({"k": np.arange(300), "sign": r.choice([1, -2], 300), "x": x - 1, "y": y + 1}))
    got = {row.k: row.n for row in dominance.counts(points, corners, ["k"], rows=20, per_task=7).collect()}
    assert got == {row.k: row.sign * int(((a < row.x) & (b < row.y)).sum()) for row in corners.collect()}
    assert [row.n for row in dominance.counts(points.limit(0), corners.limit(1), ["k"]).collect()] == [0]


def test_whole_list_queries_have_no_cut():
    """Places come from the whole lists by popularity and distance; the cut ones serve the retrieval pool alone."""
    import re

    from wiresift.catalog import h_forecast, load
    sql = load().ORACLES
    for name in ("m14_rrf_fuse", "m14_prior_fuse", "m15_hit_report", "m16_conformal_list_size"):
        own = sql[name].replace(h_forecast.RANKS.strip(), "")
        assert len(own) < len(sql[name]) and "proxw" in own and not re.search(r"\b(prox|pop|px0|pc)\b", own)
        assert name == "m14_rrf_fuse" or sql[f"{name}_whole"] == sql[name]


def test_contacts_answer_any_number_of_forecasts(spark):
    from wiresift.operators import forecast as fo
    n = 21_000
    e = spark.range(2 * n).select(F.col("id").alias("position"), (F.col("id") * 1000).alias("t_us"), (F.col("id") % 2).alias("sender"), (F.col("id") % 7 + 10).alias("receiver"))
    f = e.where("position % 2 = 0").select((F.col("position") / 2).cast("long").alias("forecast"), "position", "t_us", "sender")
    got = fo.new_contacts(e, f, horizon_s=0.01)
    assert f.count() == n and got.select("forecast").distinct().count() == n - 1
    one = {(x.forecast, x.host): x.delay_s for x in got.where("forecast between 500 and 502").collect()}
    want = {}
    for k in (500, 501, 502):
        for p in range(2 * k + 2, 2 * k + 11, 2):
            want.setdefault((k, p % 7 + 10), (p - 2 * k) / 1000)
    assert one == want


def test_calibration_log_starts_afresh_under_another_policy(spark):
    rows = lambda *r: spark.createDataFrame([("n", f, s * US, float(x)) for f, s, x in r], "name string, flow string, t_us bigint, score double")
    schema = "name string, flow string, t_us bigint, score double, start_us bigint"
    for other in ({"duration_s": 900}, {"max_gap_s": 60}, {"signature": "model-2"}):
        t = tb.BatchTable(spark, rp.scratch(spark, "log"))
        same = {"duration_s": 1000, "max_gap_s": 50, "signature": "model-1"}
        sk.score_log(t, **same)(rows(("a", 0, 1)), 0)
        sk.score_log(t, **same)(rows(("b", 10, 2)), 1)
        assert {r.flow for r in t.before(2, schema).collect()} == {"a", "b"}
        sk.score_log(t, **(same | other))(rows(("c", 20, 3)), 2)
        assert {(r.flow, r.start_us // US) for r in t.before(3, schema).collect()} == {("c", 20)}


def test_silence_is_found_across_stretches(spark):
    t = tb.BatchTable(spark, rp.scratch(spark, "log"))
    times = [0, 49, 99, 149, 200, 249]  # only 149 -> 200 is longer than 50
    sk.score_log(t, 1000, 50)(spark.createDataFrame([("n", str(s), s * US, 1.0) for s in times], "name string, flow string, t_us bigint, score double"), 0)
    assert {r.flow for r in t.before(1, "name string, flow string").collect()} == {"200", "249"}


def test_realised_rates_that_leave_their_budget():
    assert sk.drifted(0.04, 0.01) and sk.drifted(0.003, 0.01) and not sk.drifted(0.02, 0.01) and not sk.drifted(0.0, 0.01)


def test_day_tables_are_written_in_one_pass_and_rebuilt_after_an_interruption(spark):
    root = rp.scratch(spark, "day-tables")
    df = spark.createDataFrame([(d, i) for d in "abc" for i in range(5)], "day string, x long")
    days = lambda: {r.day: r.n for r in spark.read.schema("x long, day string").parquet(root).groupBy("day").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert tb.write_day_tables(df, root, {"a": "1", "b": "1"}) == ["a", "b"] and days() == {"a": 5, "b": 5}
    assert tb.write_day_tables(df, root, {"a": "1", "b": "2", "c": "1"}) == ["b", "c"] and days() == {"a": 5, "b": 5, "c": 5}
    # rows of a day replaced, its marker not yet written: the day is rebuilt, and only that one
    df.where("day = 'c' and x < 2").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(root)
    assert not tb.is_current(spark, root, "c", "1") and days()["c"] == 2
    assert tb.write_day_tables(df, root, {"a": "1", "b": "2", "c": "1"}) == ["c"] and days()["c"] == 5
    # a day that has lost all rows
    assert tb.write_day_tables(df.where("day <> 'a'"), root, {"a": "3"}) == ["a"] and "a" not in days() and tb.is_current(spark, root, "a", "3")


def test_prefix_check_finds_an_operator_that_looks_ahead(spark):
    from pyspark.sql import Window

    from wiresift.operators import invariance as iv
    _, df = history(spark, 60)
    w = Window.partitionBy("sender").orderBy("position")
    check = lambda op: tuple(iv.prefix_differences(lambda d: d.withColumn("x", op), df, 40, ["position", "x"]).first())
    assert check(F.lag("position").over(w)) == (40, 0, 0)
    compared, missing, added = check(F.lead("position").over(w))
    assert compared == 40 and missing == added > 0


def test_flow_files_are_read_by_header_and_skipped_ones_reported(spark, tmp_path):
    from wiresift.sources import readers as rd
    from wiresift.sources.schemas import FLOW_REQUIRED
    cells = {"Flow ID": "a", "Src IP": "10.0.0.1", "Src Port": "80", "Dst IP": "10.0.0.2", "Dst Port": "5000", "Protocol": "6", "Timestamp": "t", "Flow Duration": "1.5"}

    def put(name, header, rows):
        (tmp_path / name).write_text("\n".join([",".join(header)] + [",".join(cells.get(c.strip('"'), "NaN") for c in header)] * rows) + "\n")
    for i in range(12):
        put(f"many {i}.csv", FLOW_REQUIRED, i)
    put("quoted.csv", [f'"{c}"' for c in FLOW_REQUIRED] + ["Flow Byts/s", "Twice", "Twice"], 3)
    put("marked.csv", ["﻿Flow ID", *FLOW_REQUIRED[1:]], 0)
    put("short.csv", [c for c in FLOW_REQUIRED if c not in ("Timestamp", "Dst IP")], 4)
    (tmp_path / "blank.csv").write_text("\n\n")
    (tmp_path / "empty.csv").write_text("")
    before = len(spark.sparkContext.statusTracker().getJobIdsForGroup())
    flows, skipped = rd.read_flow_csv(spark, sorted(str(p) for p in tmp_path.iterdir()), "d")
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup()) - before < 17
    got = {r.file: r.reason for r in skipped.select(F.regexp_extract("file", "([a-z]+).csv$", 1).alias("file"), "reason").collect()}
    assert got == {"short": "missing Dst IP, Timestamp", "blank": "missing " + ", ".join(FLOW_REQUIRED)}
    rows = flows.select("`Flow ID`", "`Flow Duration`", "`Flow Byts/s`", "flow_key").collect()
    assert len(rows) == sum(range(12)) + 3 and {(r[0], r[1]) for r in rows} == {("a", 1.5)}
    assert sum(r[2] is not None and math.isnan(r[2]) for r in rows) == 3 and len({r[3] for r in rows}) == 1
    with pytest.raises(ValueError):
        rd.read_flow_csv(spark, [str(tmp_path / "short.csv")], "d")


def test_packet_events_from_topic_values(spark):
    from wiresift.sources.schemas import PACKET_JSON
    from wiresift.streaming import windows as wi
    line = '{"id": "7", "timestamp": "2024-01-01T00:00:01.5Z", "unknown": [1]}'
    raw = spark.createDataFrame([(bytearray(x.encode()),) for x in (line, "", "not json", "{}", '{"id": null}', line[:20])], "value binary")
    got = wi.packet_events(raw)
    rows = got.collect()
    assert len(rows) == 1 and str(rows[0]["id"]) == "7" and rows[0]["us"] == 1_704_067_201_500_000
    assert set(PACKET_JSON.names) < set(got.columns)
    assert wi.packet_events(raw.where("false")).count() == 0


def test_stream_gaps_and_retransmissions_across_stretches_and_batches(spark):
    from wiresift.streaming import windows as wi
    r = random.Random(5)
    rows, us = [], 1_700_000_000_000_000
    for i in range(400):
        us += r.choice([0, 1, 900, 1500, 2500, 40_000, 90_000, -700])
        hot = i % 3 == 0
        rows.append((i, us, "h" if hot else f"s{r.randrange(4)}", None if hot else r.randrange(3), "d", 80, 6 if r.random() < 0.9 else 17, 10 if hot else r.choice([0, 10]), r.randrange(2), 0, 1 if hot else r.randrange(3)))
    names = ["frame_no", "us", "src_ip", "src_port", "dst_ip", "dst_port", "protocol", "payload_len", "tcp_flag_syn", "tcp_flag_fin", "tcp_seq"]
    df = spark.createDataFrame(rows, "frame_no long, us long, src_ip string, src_port int, dst_ip string, dst_port int, protocol int, payload_len int, tcp_flag_syn int, tcp_flag_fin int, tcp_seq long")
    stream = lambda: rp.staged(rp.with_last_tick(df, "frame_no", "us"), "frame_no", 4)
    windows = {}
    for row in (dict(zip(names, x)) for x in rows):
        windows.setdefault(row["us"] // 10_000_000, []).append(row)
    got = {x.window_index: x for x in rp.run_to_table(wi.stream_window_gaps(stream(), stretch=7)).collect()}
    assert set(got) == set(windows)
    for w, x in windows.items():
        gaps = [b["us"] - a["us"] for a, b in zip(x, x[1:]) if b["us"] >= a["us"]]
        assert (got[w].iat_min_us, got[w].iat_max_us) == (min(gaps, default=0), max(gaps, default=0))
        assert abs(got[w].iat_mean_us - np.mean(gaps)) < 0.006 and abs(got[w].iat_stddev_us - np.std(gaps)) < 0.006
    late = {x.window_index: x.tcp_retransmissions_count for x in rp.run_to_table(wi.stream_window_retransmissions(stream(), salts=3)).collect()}
    want = {}
    for w, x in windows.items():
        first = {}
        for p in x:
            if p["protocol"] == 6 and (p["payload_len"] or p["tcp_flag_syn"] or p["tcp_flag_fin"]):
                key = tuple(p[c] for c in names if c in ("src_ip", "src_port", "dst_ip", "dst_port", "tcp_seq", "payload_len"))
                want[w] = want.get(w, 0) + (p["us"] - first.setdefault(key, p["us"]) > 2000)
    assert late == want and sum(want.values()) > 50


def test_bootstrap_ranking_moves_a_row_a_distinct_score(spark, monkeypatch):
    """Resamples are columns: what is written before the prefix sums is a row a score, and the interval is that of the resamples drawn one by one."""
    from wiresift.operators import metrics as me
    from wiresift.functions.scalars import portable_hash
    pinned, sizes = me.pinned, []

    def looked(df):
        sizes.append(df.count())
        return pinned(df)
    monkeypatch.setattr(me, "pinned", looked)
    r = random.Random(15)
    rows = [(i, g, r.choice([None, -1.5, 0.0, 2.0, 3.0, 7.5, 9.0]), r.random() < 0.3) for i in range(600) for g in "ab"] + [(900, "c", 1.0, True)]
    df = spark.createDataFrame(rows, "position long, family string, score double, positive boolean")
    got = {(x.family, x.metric): (x.low, x.high) for x in me.bootstrap_ranking_ci(df, "position", ["family"], samples=8, seed=3).collect()}
    assert sizes and max(sizes) <= 15
    one = [F.struct(portable_hash(F.col("position"), F.lit(i * 1_000_003 + 3)).alias("h"), me._poisson_weight("position", i, 3).alias("w")) for i in range(8)]
    weights = {(x.position, x.family): [y.w for y in x.w] for x in df.select("position", "family", F.array(*one).alias("w")).collect()}
    same = {(x.position, x.family): x.w for x in df.select("position", "family", me._poisson_weights("position", 8, 3).alias("w")).collect()}
    assert same == weights
    for family in "ab":
        values = {"auroc": [], "pr_auc": []}
        for i in range(8):
            mine = [(-math.inf if s is None else s, p, weights[k, g][i]) for k, g, s, p in rows if g == family and weights[k, g][i]]
            # a null score shares its bucket with zero, before it
            mine = [(-1e-9 if s == -math.inf else s, p, w) for s, p, w in mine]
            pos, neg = sum(w for _, p, w in mine if p), sum(w for _, p, w in mine if not p)
            wins = sum(w * v * ((s > t) + (s == t) / 2) for s, p, w in mine if p for t, q, v in mine if not q)
            values["auroc"].append(wins / (pos * neg))
            at = {s: [sum(w for t, q, w in mine if t >= s and (q or not only)) for only in (False, True)] for s in {s for s, _, _ in mine}}
            values["pr_auc"].append(sum(w / pos * at[s][1] / at[s][0] for s, p, w in mine if p))
        for metric, v in values.items():
            assert got[family, metric] == pytest.approx(tuple(np.quantile(v, [0.025, 0.975])), abs=1e-9)
    assert got.get(("c", "auroc"), (None, None)) == (None, None)


def _task_rows(df):
    return [len(p) for p in df.rdd.glom().collect()]


@pytest.mark.parametrize("few_hosts", [True, False])
def test_proximity_ranking_deals_forecasts_by_the_hosts_they_meet(spark, monkeypatch, few_hosts):
    """The tasks that compare and rank follow the number of pairs, not the size of the forecasts."""
    from wiresift.operators import forecast as fo
    ranked, tasks = fo._ranked, []

    def looked(df, order, cap=None):
        tasks.append(_task_rows(df))
        return ranked(df, order, cap)
    monkeypatch.setattr(fo, "_ranked", looked)
    monkeypatch.setattr(fo, "MET_ROWS", 1000)
    monkeypatch.setattr(fo, "HOSTS", 1_000_000 if few_hosts else 0)
    e = spark.createDataFrame([(p, p % 7, (p * 5) % 11) for p in range(600)], "position long, sender long, receiver long")
    f = spark.createDataFrame([(p // 10, p, p % 7) for p in range(9, 600, 10)], "forecast long, position long, sender long")
    h = spark.createDataFrame([(x, 1000 + x * x, 0) for x in range(100)], "host long, ip_number long, first_position long")
    got = {(x.forecast, x.rank): x.host for x in fo.proximity_ranking(e, f, h, cap=3).collect()}
    assert len(got) == 180 and all(max(t) <= 1000 and sum(1 for n in t if n) > 5 for t in tasks)
    events = {p: (p % 7, (p * 5) % 11) for p in range(600)}
    for p in range(9, 600, 10):
        last = [events[q][1] for q in range(p + 1) if q % 7 == p % 7][-3:]
        want = sorted((min(abs(x * x - t * t) for t in last), x) for x in range(100) if x != p % 7)[:3]
        assert [got[p // 10, k] for k in range(3)] == [x for _, x in want]


def test_whole_lists_are_ranked_where_most_places_are_asked(spark, monkeypatch):
    """Counted and ranked places agree, and pairs that are most of the lists need no counting."""
    from wiresift.operators import forecast as fo
    from wiresift.plans import dominance
    r = random.Random(14)
    hosts = [(h, None if h % 9 == 8 else r.choice([r.randrange(0, 200), 2**32 - 1, 0]), 0 if h < 12 else r.randrange(0, 300)) for h in range(80)]
    events = [(p, r.randrange(12), r.randrange(12)) for p in range(300)] + [(300 + k, 11, 8) for k in range(20)]
    e = spark.createDataFrame(events, "position long, sender long, receiver long")
    f = spark.createDataFrame([(p // 20, p, events[p][1]) for p in range(19, 320, 20)], "forecast long, position long, sender long")
    h = spark.createDataFrame(hosts, "host long, ip_number long, first_position long")
    pairs = spark.createDataFrame([(k, x) for k in range(16) for x in range(80) if r.random() < 0.6], "forecast long, host long")
    unseen = h.unionByName(spark.createDataFrame([(80, 7, None)], h.schema))
    nameless = unseen.unionByName(spark.createDataFrame([(None, None, 5)], h.schema))
    both = lambda: [sorted(map(tuple, x.collect())) for x in (
        fo.proximity_places(pairs, e, f, h), fo.popularity_places(pairs, e, f, h, 100, 20), fo.proximity_places(pairs, e, f, unseen), fo.popularity_places(pairs, e, f, nameless, 100, 20))]
    monkeypatch.setattr(fo, "WHOLE_SHARE", 0)
    counted = both()
    monkeypatch.undo()
    monkeypatch.setattr(dominance, "counts", None)
    monkeypatch.setattr(fo, "MET_ROWS", 100)
    assert both() == counted and all(counted)


def test_replay_batches_take_several_files(spark, monkeypatch):
    """A micro-batch grows with the table up to a bound, so that a large table is not replayed in as many micro-batches as files."""
    monkeypatch.setattr(rp, "ROWS_PER_SLICE", 100)
    df = spark.range(2000).select((F.col("id") * 7919 % 2000).alias("position")).repartition(6)
    seen = []
    rp.run_batches(rp.staged(df, "position"), lambda b, i: seen.append([r.position for r in b.collect()]))
    assert len(seen) == 4 and sorted(x for b in seen for x in b) == list(range(2000))
    assert all(max(a) < min(b) for a, b in zip(seen, seen[1:]))
    monkeypatch.setattr(rp, "FILES_PER_BATCH", 2)
    seen.clear()
    rp.run_batches(rp.staged(df, "position"), lambda b, i: seen.append(b.count()))
    assert len(seen) == 10 and sum(seen) == 2000
