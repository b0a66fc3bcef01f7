"""Start-anchored flow segments as jumps over packets, so that no task walks a conversation.

A packet that opens a segment determines the packet that opens the next one: the first behind a FIN, or the first that comes later than the timeout after the opening packet. These
jumps form a functional graph. Inside a block of rows it is followed by doubling the jumps, all conversations of the block at once. A conversation of very many packets is
cut into chunks; what a chunk does to a segment left open by the chunk before it is a step function of that segment's start time, one row a chunk. The functions of neighbouring chunks are composed, sixteen at a time, until a conversation has
few; then the open starts are handed down the same way, and every chunk is resolved on its own.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wiresift.plans.ordering import per_key
from wiresift.session import pinned

ROWS = 1 << 17   # packets of a conversation that one task holds
FAN = 16         # step functions composed at once
#: Start time of no open segment: every packet comes too late for it. SAME stands for the start that came in.
NONE, NO_FRAME, SAME = -(1 << 61), -1, -2


def first_above(values: np.ndarray, limit: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """For each i the first place at or behind begin[i] whose value is above limit[i], or the end, by descent over maxima of stretches of 1, 2, 4, ... places."""
    levels, n = [values], len(values)
    while 1 << len(levels) <= n:
        w = 1 << (len(levels) - 1)
        levels.append(np.maximum(levels[-1][:-w], levels[-1][w:]))
    at = begin.copy()
    for k in reversed(range(len(levels))):
        w = 1 << k
        fits = np.flatnonzero(at + w <= n)
        at[fits[levels[k][at[fits]] <= limit[fits]]] += w
    return at


class Block:
    """Rows of whole groups (a conversation, or a chunk of one) in order: where the segment that each row would open ends."""

    def __init__(self, us: np.ndarray, fin: np.ndarray, frame: np.ndarray, heads: np.ndarray, timeout_us: int):
        n = len(us)
        self.us, self.frame, self.heads, self.timeout = us, frame, heads, timeout_us
        self.ends = np.r_[heads[1:], n]
        self.end = np.repeat(self.ends, self.ends - heads)
        places = np.arange(n)
        self.fin_at = np.r_[np.minimum.accumulate(np.where(fin, places, n)[::-1])[::-1], n]
        late = np.minimum(first_above(us, us + timeout_us, places + 1), self.end)
        self.shut = self.fin_at[places + 1] < late
        self.next = np.where(self.shut, self.fin_at[places + 1] + 1, late)

    def entries(self, start: np.ndarray) -> np.ndarray:
        """The first row of each group that opens a segment, given the start of the one open before it; the group's end if none does."""
        late = np.minimum(first_above(self.us, start + self.timeout, self.heads), self.ends)
        return np.where(self.fin_at[self.heads] < late, self.fin_at[self.heads] + 1, late)

    def openings(self, entry: np.ndarray) -> np.ndarray:
        """Which rows open a segment: all that the jumps reach from the entries."""
        n = len(self.us)
        jump = np.r_[np.where(self.next < self.end, self.next, n), n]
        mark = np.zeros(n + 1, bool)
        mark[entry[entry < self.ends]] = True
        while True:
            reached = jump[np.flatnonzero(mark)]
            if (reached == n).all():
                return mark[:n]
            mark[reached] = True
            jump = jump[jump]

    def left_open(self) -> tuple[np.ndarray, np.ndarray]:
        """(start time, first frame) of the segment open behind the group, if each row opened one."""
        root = np.where(self.next < self.end, self.next, np.arange(len(self.us)))
        while True:
            further = root[root]
            if (further == root).all():
                break
            root = further
        return np.where(self.shut[root], NONE, self.us[root]), np.where(self.shut[root], NO_FRAME, self.frame[root])

    def steps(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each group the step function from the start open before it to the one open behind it: an incoming start below upper[i] gives out[i], a later one the last."""
        us, frame = self.left_open()
        for head, end in zip(self.heads.tolist(), self.ends.tolist(), strict=True):
            fin = int(self.fin_at[head])
            top = np.maximum.accumulate(self.us[head:min(fin, end - 1) + 1])
            record = np.flatnonzero(np.r_[True, top[1:] > top[:-1]])
            if fin >= end:
                last = (NONE, SAME)
            else:
                last = (us[fin + 1], frame[fin + 1]) if fin + 1 < end else (NONE, NO_FRAME)
            yield merged(top[record] - self.timeout, np.r_[us[head + record], last[0]], np.r_[frame[head + record], last[1]])


def merged(upper: np.ndarray, us: np.ndarray, frame: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same step function without steps between equal values."""
    differs = np.flatnonzero((us[1:] != us[:-1]) | (frame[1:] != frame[:-1]))
    return upper[differs], us[np.r_[differs, len(us) - 1]], frame[np.r_[differs, len(us) - 1]]


def after(step, us: np.ndarray, frame: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts left open behind a chunk, from those open before it."""
    upper, out_us, out_frame = step
    k = np.searchsorted(upper, us, "right")
    same = out_frame[k] == SAME
    return np.where(same, us, out_us[k]), np.where(same, frame, out_frame[k])


def composed(first, second):
    """One step function for a chunk and the next. Only a last step keeps the incoming start, and then what the next chunk does to it comes behind."""
    upper, us, frame = first
    if frame[-1] != SAME:
        return merged(upper, *after(second, us, frame))
    head = after(second, us[:-1], frame[:-1])
    rest = second[0] > upper[-1] if len(upper) else np.ones(len(second[0]), bool)
    tail = np.flatnonzero(np.r_[rest, True])
    return merged(np.r_[upper, second[0][rest]], np.r_[head[0], second[1][tail]], np.r_[head[1], second[2][tail]])


STEP = "upper array<long>, out_us array<long>, out_frame array<long>"


def _arrays(row) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return tuple(np.asarray(row[c], np.int64) for c in ("upper", "out_us", "out_frame"))


def _composed(rows: pd.DataFrame) -> pd.DataFrame:
    rows, step = rows.sort_values("chunk"), None
    for _, row in rows.iterrows():
        step = _arrays(row) if step is None else composed(step, _arrays(row))
    return pd.DataFrame({"segment_key": [rows["segment_key"].iloc[0]], "chunk": [rows["above"].iloc[0]], "upper": [step[0]], "out_us": [step[1]], "out_frame": [step[2]]})


def _handed_down(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("chunk")
    us, frame = np.array([rows["open_us"].iloc[0]]), np.array([rows["open_frame"].iloc[0]])
    seen = []
    for _, row in rows.iterrows():
        seen.append((us[0], frame[0]))
        us, frame = after(_arrays(row), us, frame)
    return pd.DataFrame({"segment_key": rows["segment_key"], "chunk": rows["chunk"], "open_us": [u for u, _ in seen], "open_frame": [f for _, f in seen]})


def open_before(steps: DataFrame, fan: int = FAN) -> DataFrame:
    """(segment_key, chunk, open_us, open_frame): the segment open before each chunk, from (segment_key, chunk, upper, out_us, out_frame). `steps` should be a written table."""
    above = steps.withColumn("above", F.floor(F.col("chunk") / fan).cast("long"))
    state = "segment_key string, chunk long, open_us long, open_frame long"
    if steps.agg(F.max("chunk") - F.min("chunk")).first()[0] < fan:
        begun = steps.withColumns({"open_us": F.lit(NONE), "open_frame": F.lit(NO_FRAME).cast("long")})
        return begun.groupBy("segment_key").applyInPandas(_handed_down, state)
    up = pinned(above.groupBy("segment_key", "above").applyInPandas(_composed, f"segment_key string, chunk long, {STEP}"))
    parents = open_before(up, fan).withColumnRenamed("chunk", "above")
    return above.join(parents, ["segment_key", "above"]).groupBy("segment_key", "above").applyInPandas(_handed_down, state)


def _blocks(batches: Iterator[pd.DataFrame], rows: int):
    """Whole groups of (segment_key, chunk), about `rows` rows at a time, with where each group begins."""
    held: list[pd.DataFrame] = []

    def heads(b):
        key, chunk = b["segment_key"].to_numpy(), b["chunk"].to_numpy()
        return np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (chunk[1:] != chunk[:-1])])
    for b in batches:
        if len(b):
            held.append(b)
        if sum(map(len, held)) >= rows:
            b = pd.concat(held, ignore_index=True)
            at = heads(b)
            if len(at) > 1:
                yield b.iloc[:at[-1]], at[:-1]
                b = b.iloc[at[-1]:].reset_index(drop=True)
            held = [b]
    if held:
        b = pd.concat(held, ignore_index=True)
        yield b, heads(b)


def _block(b: pd.DataFrame, at: np.ndarray, timeout_us: int) -> Block:
    return Block(b["us"].to_numpy(np.int64), b["fin"].to_numpy() == 1, b["frame_no"].to_numpy(np.int64), at, timeout_us)


def assign(rows: DataFrame, timeout_us: int, rows_per_chunk: int = ROWS) -> DataFrame:
    """Add `segment` (the frame that opened it) and `opens` to rows with segment_key, frame_no (unique), us and fin; the order is that of frame_no."""
    schema = T.StructType([*rows.schema.fields, T.StructField("segment", T.LongType()), T.StructField("opens", T.IntegerType())])

    def stepped(batches):
        for b, at in _blocks(batches, rows_per_chunk):
            steps = list(_block(b, at, timeout_us).steps())
            yield pd.DataFrame({"segment_key": b["segment_key"].to_numpy()[at], "chunk": b["chunk"].to_numpy()[at], "upper": [s[0] for s in steps], "out_us": [s[1] for s in steps], "out_frame": [s[2] for s in steps]})

    def resolved(batches):
        for b, at in _blocks(batches, rows_per_chunk):
            block = _block(b, at, timeout_us)
            opens = block.openings(block.entries(b["open_us"].to_numpy(np.int64)[at]))
            last = np.maximum.accumulate(np.where(opens, np.arange(len(b)), -1))
            own = last >= np.repeat(at, block.ends - at)
            segment = np.where(own, block.frame[np.maximum(last, 0)], b["open_frame"].to_numpy(np.int64))
            yield b.drop(columns=["chunk", "open_us", "open_frame"]).assign(segment=segment, opens=opens.astype(np.int32))

    def laid(x: DataFrame) -> DataFrame:
        return x.repartition("segment_key", "chunk").sortWithinPartitions("segment_key", "chunk", "frame_no")

    def chain(x: DataFrame, cut) -> DataFrame:
        if cut is None:
            x = x.withColumns({"chunk": F.lit(0).cast("long"), "open_us": F.lit(NONE), "open_frame": F.lit(NO_FRAME).cast("long")})
        else:
            x = x.withColumn("chunk", F.floor(F.col("frame_no") / int(cut)).cast("long"))
            slim = laid(x.select("segment_key", "chunk", "frame_no", "us", "fin"))
            steps = pinned(slim.mapInPandas(stepped, f"segment_key string, chunk long, {STEP}"))
            x = x.join(open_before(steps), ["segment_key", "chunk"])
        names = [*rows.columns, "chunk", "open_us", "open_frame"]
        return laid(x.select(*names)).mapInPandas(resolved, schema)
    return per_key(rows, ["segment_key"], rows_per_chunk, chain)
