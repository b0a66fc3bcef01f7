"""Keyed streaming operators. Each keeps a small state per key and must equal its batch twin on the same rows.

Rows of a key inside one micro-batch are ordered by their stream position first; a micro-batch is bounded by the
source's rate limit (`maxFilesPerTrigger`, `maxOffsetsPerTrigger`), so the sort is too.
"""
from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

TIMEOUT_US = 120_000_000
FORGET_US = 3_600_000_000


def _ordered(batches: Iterator[pd.DataFrame], by: str) -> pd.DataFrame:
    parts = [b for b in batches if len(b)]
    return pd.concat(parts, ignore_index=True).sort_values(by, kind="stable") if parts else pd.DataFrame()


def stream_alerts(scored: DataFrame, n: int = 3, gap_s: float = 120.0) -> DataFrame:
    """Incidents as they open: state per (family, sender) is the current run and when the open incident ends.

    scored: family, sender, position, t_us, score, threshold.
    """
    gap = int(gap_s * 1e6)

    def step(key, batches, state: GroupState):
        run, until = state.get if state.exists else (0, -1)
        out = []
        rows = _ordered(batches, "position")
        for p, t, score, cut in zip(rows["position"], rows["t_us"], rows["score"], rows["threshold"]):
            run = run + 1 if score >= cut else 0
            if run >= n:
                if t > until:
                    out.append((key[0], key[1], int(p), int(t), float(score)))
                until = int(t) + gap
        state.update((int(run), int(until)))
        yield pd.DataFrame(out, columns=["family", "sender", "opened_position", "opened_us", "opening_score"])
    return scored.groupBy("family", "sender").applyInPandasWithState(
        step, "family string, sender long, opened_position long, opened_us long, opening_score double", "run long, until long", "append", GroupStateTimeout.NoTimeout)


def stream_history(events: DataFrame) -> DataFrame:
    """History features in stream order, long form (position, feature, value).

    One keyed stage serves all three roles: a host as source, as destination and as dialling client. A gap is never
    negative; a first sighting is -1.  events: position, t_us, src, dst, src_port, dst_port, reversed.
    """
    rev = F.col("reversed") == 1
    role = lambda name, key, port: F.struct(F.lit(name).alias("role"), key.alias("host"), port.cast("long").alias("port"))
    rows = events.select("position", "t_us", F.inline(F.array(
        role("src", F.col("src"), F.lit(0)), role("dst", F.col("dst"), F.lit(0)),
        role("client", F.when(rev, F.col("dst")).otherwise(F.col("src")), F.when(rev, F.col("src_port")).otherwise(F.col("dst_port"))))))

    def step(key, batches, state: GroupState):
        name = key[0]
        last, port, dialled = state.get if state.exists else (-1, -1, [])
        seen = set(dialled)
        out = []
        rows = _ordered(batches, "position")
        for p, t, q in zip(rows["position"], rows["t_us"], rows["port"]):
            if name == "client":
                out.append((int(p), "port_delta", float(q - port) if port >= 0 else 0.0))
                out.append((int(p), "dst_port_new", 0.0 if int(q) in seen else 1.0))
                port = int(q)
                seen.add(port)
            else:
                out.append((int(p), f"dt_{name}", max(t - last, 0) / 1e6 if last >= 0 else -1.0))
                last = max(int(t), int(last))
        # A port set has at most 65,536 members.
        state.update((int(last), int(port), sorted(seen)))
        yield pd.DataFrame(out, columns=["position", "feature", "value"])
    return rows.groupBy("role", "host").applyInPandasWithState(
        step, "position long, feature string, value double", "last long, port long, dialled array<long>", "append", GroupStateTimeout.NoTimeout)


def stream_neighbours(events: DataFrame, size: int = 20) -> DataFrame:
    """Halves of every event's neighbourhood (position, role, neighbours): read before push, state of size + 1 peers."""
    side = lambda role, a, b: F.struct(F.lit(role).alias("role"), F.col(a).alias("endpoint"), F.col(b).alias("peer"))
    rows = events.select("position", F.inline(F.array(side(0, "sender", "receiver"), side(1, "receiver", "sender"))))

    def step(key, batches, state: GroupState):
        recent = OrderedDict(zip(*state.get)) if state.exists else OrderedDict()
        at, found = [], []
        rows = _ordered(batches, "position")
        for p, peer in zip(rows["position"], rows["peer"]):
            at.append(int(p))
            found.append([v for q, v in reversed(recent.items()) if q != peer][:size])
            recent.pop(peer, None)
            recent[int(peer)] = int(p)
            if len(recent) > size + 1:
                recent.popitem(last=False)
        state.update((list(recent.keys()), list(recent.values())))
        yield pd.DataFrame({"position": at, "role": [int(key[0])] * len(at), "neighbours": found})
    return rows.groupBy("role", "endpoint").applyInPandasWithState(
        step, "position long, role int, neighbours array<long>", "peers array<long>, positions array<long>", "append", GroupStateTimeout.NoTimeout)


def merge_neighbours(halves: DataFrame, size: int = 20) -> DataFrame:
    """The two halves of each event as one list, newest first."""
    return halves.groupBy("position").agg(F.slice(F.sort_array(F.flatten(F.collect_list("neighbours")), asc=False), 1, size).alias("neighbours"))


def stream_flows(packets: DataFrame, timeout_us: int = TIMEOUT_US, delay: str = "1 second") -> DataFrame:
    """Closed flow segments of a packet stream: by FIN, by a packet past the start-anchored timeout, or by event time.

    State per address pair: the open segment, and for an hour after a timeout the orientation its successor keeps.
    packets: frame_no, us, length, protocol, tcp_flag_fin and the endpoints.
    """
    a, b = F.concat_ws(":", "src_ip", "src_port"), F.concat_ws(":", "dst_ip", "dst_port")
    p = packets.where(F.col("protocol").isin(6, 17) & ~F.col("src_ip").contains(":")).select(
        F.concat_ws("|", F.least(a, b), F.greatest(a, b), F.col("protocol").cast("string")).alias("segment_key"), a.alias("source"), "frame_no", "us", "length",
        F.when(F.col("protocol") == 6, F.col("tcp_flag_fin")).otherwise(0).cast("int").alias("fin"), F.timestamp_micros("us").alias("event_time"))
    p = p.withWatermark("event_time", delay)
    cols = ["segment_key", "source", "packets", "bytes", "start_us", "end_us", "first_frame", "closed_by_fin"]

    def step(key, batches, state: GroupState):
        # (open?, oriented source, packets, bytes, start, end, first frame)
        s = list(state.get) if state.exists else [0, "", 0, 0, 0, 0, 0]
        out = []
        # Never earlier than the watermark allows; a timer set in the past is moved to its edge.
        arm = lambda us: state.setTimeoutTimestamp(max(us // 1000 + 1, state.getCurrentWatermarkMs() + 1))

        def close(fin):
            if s[2] > 1:
                out.append((key[0], s[1], s[2], s[3], s[4], s[5], s[6], fin))
            s[0] = 0
            if fin:
                s[1] = ""
        if state.hasTimedOut:
            if s[0]:
                close(0)
                state.update(tuple(s))
                arm(s[4] + timeout_us + FORGET_US)
            else:
                state.remove()
            yield pd.DataFrame(out, columns=cols)
            return
        rows = _ordered(batches, "frame_no")
        for source, frame, us, length, fin in zip(rows["source"], rows["frame_no"], rows["us"], rows["length"], rows["fin"]):
            us, length, frame = int(us), int(length), int(frame)
            if s[0] and us - s[4] > timeout_us:
                close(0)
            if not s[0]:
                if s[1] and us - s[4] - timeout_us > FORGET_US:
                    s[1] = ""
                s[:] = [1, s[1] or source, 1, length, us, us, frame]
                continue
            s[2], s[3], s[5] = s[2] + 1, s[3] + length, max(s[5], us)
            if fin:
                close(1)
        state.update(tuple(s))
        arm(s[4] + timeout_us)
        yield pd.DataFrame(out, columns=cols)
    return p.groupBy("segment_key").applyInPandasWithState(
        step, "segment_key string, source string, packets long, bytes long, start_us long, end_us long, first_frame long, closed_by_fin int",
        "live int, source string, packets long, bytes long, start_us long, end_us long, first_frame long", "append", GroupStateTimeout.EventTimeTimeout)


def open_flows(state: DataFrame) -> DataFrame:
    """The end of a packet stream: the segments of at least two packets that `stream_flows` still holds open, as closed by neither FIN nor timeout.

    state: (key, state), as `replay.state_of` reads them from the stopped query.
    """
    s = state.where("state.live = 1 AND state.packets > 1").select("key.segment_key", "state.*")
    return s.select("segment_key", "source", "packets", "bytes", "start_us", "end_us", "first_frame", F.lit(0).alias("closed_by_fin"))
