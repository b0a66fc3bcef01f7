"""Byte strings of `WINDOW` bytes that repeat across documents, by suffix arrays over shards (operator 4).

1. Every window of `WINDOW` bytes has one anchor, its `GRAM`-byte string with the least fingerprint, so equal windows have equal anchors. Each task
   sorts the fingerprints of its anchors: a run, dealt out by leading bits. Runs of one range are merged pairwise by binary search, which tells
   the fingerprints that more than one document holds and sends them back to the shards (documents by hash) that hold them.
2. A shard writes, for each repeated anchor, its context: the bytes of all windows that belong to the anchor. Contexts meet by anchor.
3. In numpy, equal contexts become one with its smallest doc_id. Where an anchor has several contexts, a suffix array over them is refined by
   prefix doubling from 8 bytes (Larsson and Sadakane: only suffixes that are still tied are sorted again), neighbours get their common prefix from
   the kept ranks in place of Kasai's sequential loop (same values), and a run of common prefixes of `WINDOW` bytes or more is one string.
4. Anchors that more than `HOT` documents may hold do not meet in a task: their windows become rows and are counted by Spark, map side first.

Copies of a whole text are settled beforehand by SHA-256 and take no part in 2 to 4.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wiresift.llm import scan
from wiresift.llm.common import release, small_batches, stored

WINDOW, GRAM, HOT = 50, 20, 20_000
#: Bytes of text in a shard, and of contexts that one task judges, about.
SHARD_BYTES = 64 << 20
SPAN = WINDOW - GRAM + 1
#: Fingerprints in one sorted run, about; contexts (bytes) in one suffix array, about.
RUN, BLOCK = 4_000_000, 1 << 20
#: A coordinate is a tag of the text (rows sharing a doc_id stay apart) above 40 bits of byte position.
PLACE = 40


def _anchors(data: np.ndarray, offsets: np.ndarray):
    """(position, fingerprint, text, first window, windows) of the anchor of every stretch of windows."""
    values = scan.byte_values(data)
    ok = scan.within(offsets, len(data), WINDOW)
    none = np.zeros(0, np.int64)
    if not ok.any():
        return none, np.zeros(0, scan.U), none, none, none
    grams = scan.rolling(values, GRAM, scan.BASE)
    starts = np.flatnonzero(ok)
    at = scan.sliding_argmin(grams, SPAN)[starts]
    head = np.ones(len(at), bool)
    head[1:] = (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(head)
    count = np.diff(np.r_[first, len(at)])
    text = np.searchsorted(offsets, starts[first], "right") - 1
    return at[first], grams[at[first]], text, starts[first], count


def _keys(prints: np.ndarray, bits: int) -> np.ndarray:
    """The leading `bits`, which are the range, and the next 40: a chance match of two only costs a comparison of contexts."""
    return prints >> scan.U(max(0, 24 - bits))


def _five(keys: np.ndarray) -> bytes:
    return keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _from_five(raw: bytes, high: int) -> np.ndarray:
    out = np.zeros((len(raw) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(raw, np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel() | scan.U(high << 40)


def _runs(bits: int, shard_type: str):
    """Sorted runs: for each range the anchors of some texts, once for each shard that holds one, with the number of those texts (up to 255)."""
    def emit(parts):
        prints, shard, text = (np.concatenate(x) for x in zip(*parts))
        prints = _keys(prints, bits)
        order = np.lexsort((text, shard, prints))
        prints, shard, text = prints[order], shard[order], text[order]
        new_text = np.ones(len(prints), bool)
        new_text[1:] = (prints[1:] != prints[:-1]) | (text[1:] != text[:-1])
        new = np.ones(len(prints), bool)
        new[1:] = (prints[1:] != prints[:-1]) | (shard[1:] != shard[:-1])
        at = np.flatnonzero(new)
        holders = np.minimum(np.add.reduceat(new_text.astype(np.int64), at), 255).astype(np.uint8)
        prints, shard = prints[at], shard[at].astype(shard_type)
        ranges = (prints >> scan.U(40)).astype(np.int64)
        cut = np.flatnonzero(np.r_[True, ranges[1:] != ranges[:-1]])
        bounds = np.r_[cut, len(prints)]
        return pa.RecordBatch.from_arrays([
            pa.array(ranges[cut]),
            pa.array([_five(prints[a:b]) for a, b in zip(bounds, bounds[1:])], pa.binary()),
            *(pa.array([x[a:b].tobytes() for a, b in zip(bounds, bounds[1:])], pa.binary()) for x in (shard, holders)),
        ], names=["range", "prints", "shards", "holders"])

    def run(batches):
        parts, size, base = [], 0, 0
        for batch in batches:
            for i, j, data, offsets in scan.text_batches(batch.column(1)):
                _, prints, text, _, _ = _anchors(data, offsets)
                if len(prints):
                    parts.append((prints, batch.column(0).slice(i, j - i).to_numpy(zero_copy_only=False)[text], text + base))
                    size += len(prints)
                base += j - i
                if size >= RUN:
                    yield emit(parts)
                    parts, size = [], 0
        if size:
            yield emit(parts)
    return run


def merge_sorted(a: tuple, b: tuple) -> tuple:
    """Two runs (keys ascending, columns alongside) as one; binary search places the rows of each among the other's."""
    x, y = np.arange(len(a[0])) + np.searchsorted(b[0], a[0], "left"), np.arange(len(b[0])) + np.searchsorted(a[0], b[0], "right")
    out = []
    for left, right in zip(a, b):
        whole = np.empty(len(left) + len(right), left.dtype)
        whole[x], whole[y] = left, right
        out.append(whole)
    return tuple(out)


def _repeated(most: int, shard_type: str):
    """Merge the runs of each range; write the fingerprints of more than one text for each shard that holds them."""
    def run(batches):
        runs = {}
        for batch in batches:
            for r, prints, shards, holders in zip(*(c.to_pylist() for c in batch.columns)):
                runs.setdefault(r, []).append((_from_five(prints, r), np.frombuffer(shards, shard_type), np.frombuffer(holders, np.uint8)))
        for r in sorted(runs):
            level = runs.pop(r)
            while len(level) > 1:
                level = [merge_sorted(level[i], level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
            prints, shards, holders = level[0]
            head = np.flatnonzero(np.r_[True, prints[1:] != prints[:-1]])
            count = np.repeat(np.add.reduceat(holders.astype(np.int64), head), np.diff(np.r_[head, len(prints)]))
            keep = count > 1
            prints, shards, hot = prints[keep], shards[keep], count[keep] > most
            order = np.lexsort((prints, shards))
            prints, shards, hot = prints[order], shards[order].astype(np.int32), hot[order]
            cut = np.flatnonzero(np.r_[True, shards[1:] != shards[:-1]]) if len(shards) else np.zeros(0, np.int64)
            bounds = np.r_[cut, len(shards)]
            yield pa.RecordBatch.from_arrays([
                pa.array(shards[cut], pa.int32()), *(pa.array([x[a:b].tobytes() for a, b in zip(bounds, bounds[1:])], pa.binary()) for x in (prints, hot)),
            ], names=["shard", "prints", "hot"])
    return run


def _contexts(texts: pa.Table, found: pa.Table, bits: int) -> pa.Table:
    """Contexts of the repeated anchors of one shard, and the windows of its hot ones, as rows
    (anchor, second, doc_id, places, windows, context); a text that repeats a context or a window has one row of it with all its places."""
    import pyarrow.compute as pc
    known = [np.frombuffer(x, np.uint64) for x in found["prints"].to_pylist() if x is not None]
    hot = [np.frombuffer(x, np.bool_) for x in found["hot"].to_pylist() if x is not None]
    known, hot = (np.concatenate(known), np.concatenate(hot)) if known else (np.zeros(0, np.uint64), np.zeros(0, bool))
    order = np.argsort(known)
    known, hot = known[order], hot[order]
    copies = {(a, b) for a, b in zip(found["doc_id"].to_pylist(), found["tag"].to_pylist()) if a is not None}
    out = []
    schema = pa.schema([("anchor", pa.int64()), ("second", pa.int32()), ("doc_id", pa.int64()), ("places", pa.list_(pa.int64())), ("windows", pa.int32()), ("context", pa.binary())])
    texts = texts.filter(pc.is_valid(texts["doc_id"])) if len(known) else texts.slice(0, 0)
    for i, j, data, offsets in scan.text_batches(texts["text"]):
        ids, tags = texts["doc_id"].slice(i, j - i).to_numpy(), texts["tag"].slice(i, j - i).to_numpy()
        _, prints, text, first, count = _anchors(data, offsets)
        keys = _keys(prints, bits)
        slot = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        keep = known[slot] == keys
        if copies:
            keep &= ~np.array([(a, b) in copies for a, b in zip(ids.tolist(), tags.tolist())], bool)[text]
        prints, text, first, count, slot = (x[keep] for x in (prints, text, first, count, slot))
        place = (tags[text] << PLACE) | (first - offsets[text])
        values = scan.byte_values(data)
        sums = scan.prefix(values, scan.BASE)
        plain = np.flatnonzero(~hot[slot])
        order, heads = scan.grouped(text[plain], prints[plain], scan.spans(sums, scan.BASE, first[plain], first[plain] + count[plain] + WINDOW - 1))
        places = scan.listed(place[plain][order], heads)
        plain = plain[order[heads]]
        size = count[plain] + WINDOW - 1
        bounds = np.r_[0, np.cumsum(size)]
        take = np.repeat(first[plain] - bounds[:-1], size) + np.arange(bounds[-1])
        context = pa.Array.from_buffers(pa.binary(), len(plain), [None, pa.py_buffer(bounds.astype(np.int32).tobytes()), pa.py_buffer(data[take].tobytes())])
        out.append(pa.Table.from_arrays([pa.array(prints[plain].view(np.int64)), pa.nulls(len(plain), pa.int32()), pa.array(ids[text[plain]]), places, pa.array(count[plain].astype(np.int32)), context], schema=schema))
        split = np.flatnonzero(hot[slot])
        n = int(count[split].sum())
        if n:
            each = np.repeat(split, count[split])
            step = np.arange(n) - np.repeat(np.cumsum(count[split]) - count[split], count[split])
            start = first[each] + step
            one = scan.spans(sums, scan.BASE, start, start + WINDOW)
            two = (scan.spans(scan.prefix(scan.mix(values), scan.CHAIN), scan.CHAIN, start, start + WINDOW) >> scan.U(32)).astype(np.uint32).view(np.int32)
            order, heads = scan.grouped(text[each], one, two)
            at, n = order[heads], len(heads)
            out.append(pa.Table.from_arrays([pa.array(one[at].view(np.int64)), pa.array(two[at]), pa.array(ids[text[each[at]]]), scan.listed((place[each] + step)[order], heads), pa.array(np.ones(n, np.int32)), pa.nulls(n, pa.binary())], schema=schema))
    return pa.concat_tables(out) if out else schema.empty_table()


def suffix_array(data: np.ndarray, starts: np.ndarray, depth: int = WINDOW) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """(`starts` ordered by their first `depth` bytes, ranks by prefix length 8, 16, ..): prefix doubling that sorts only what is still tied."""
    n = len(data)
    padded = np.r_[data, np.zeros(2 * depth, np.uint8)]
    key = np.zeros(n, np.uint64)
    for b in range(8):
        key = (key << scan.U(8)) | padded[b:b + n]
    order = np.argsort(key, kind="stable")
    head = np.ones(n, bool)
    head[1:] = key[order][1:] != key[order][:-1]
    rank = np.empty(n, np.int64)
    rank[order] = np.flatnonzero(head)[np.cumsum(head) - 1]
    levels, h = [(8, rank)], 8
    while 2 * h <= depth:
        # groups of more than one suffix are the unsorted ones
        lone = head & np.r_[head[1:], True]
        tied = order[~lone]
        ahead = np.where(tied + h < n, rank[np.minimum(tied + h, n - 1)], -1)
        by = np.lexsort((ahead, rank[tied]))
        tied, ahead = tied[by], ahead[by]
        old = rank[tied]
        cut = np.ones(len(tied), bool)
        cut[1:] = (old[1:] != old[:-1]) | (ahead[1:] != ahead[:-1])
        place = np.flatnonzero(~lone)
        order[place], head[place] = tied, cut
        rank = rank.copy()
        rank[tied] = place[np.flatnonzero(cut)[np.cumsum(cut) - 1]]
        h *= 2
        levels.append((h, rank))
    rest = np.minimum(starts + depth - h, n - 1)
    return starts[np.lexsort((rank[rest], rank[starts]))], levels


def common_prefixes(sa: np.ndarray, levels: list[tuple[int, np.ndarray]], data: np.ndarray, depth: int = WINDOW) -> np.ndarray:
    """Common prefix of each suffix with the one before it (0 for the first), up to `depth`."""
    n, x, y = len(data), sa[1:].copy(), sa[:-1].copy()
    length = np.zeros(len(x), np.int64)
    for h, rank in reversed(levels):
        for _ in range(depth // h):
            same = (length + h <= depth) & (x < n) & (y < n)
            same[same] = rank[x[same]] == rank[y[same]]
            length[same] += h
            x[same] += h
            y[same] += h
    for _ in range(min(7, depth)):
        same = (length < depth) & (x < n) & (y < n)
        same[same] = data[x[same]] == data[y[same]]
        length[same] += 1
        x[same] += 1
        y[same] += 1
    return np.r_[0, length]


def _later(anchor, ids, windows, data, bounds) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context row, first window, number) of the windows that also start in a document with a smaller id, for contexts of some anchors."""
    n = len(ids)
    prints = scan.spans(scan.prefix(scan.byte_values(data), scan.BASE), scan.BASE, bounds[:-1], bounds[1:])
    order = np.lexsort((prints, anchor))
    new = np.ones(n, bool)
    new[1:] = (prints[order][1:] != prints[order][:-1]) | (anchor[order][1:] != anchor[order][:-1])
    kind = np.empty(n, np.int64)
    kind[order] = np.cumsum(new) - 1
    first = order[new]
    least = np.full(len(first), np.iinfo(np.int64).max)
    np.minimum.at(least, kind, ids)
    # anchors with one context only: its smallest document decides
    _, group, size = np.unique(anchor[first], return_inverse=True, return_counts=True)
    several = size[group] > 1
    chosen = np.flatnonzero(several)
    lowest = np.repeat(least, windows[first]) if len(first) else least
    offset = np.r_[0, np.cumsum(windows[first])]
    if len(chosen):
        rows = first[chosen]
        size = bounds[rows + 1] - bounds[rows]
        base = np.r_[0, np.cumsum(size)]
        text = data[np.repeat(bounds[rows] - base[:-1], size) + np.arange(base[-1])]
        count = windows[rows]
        step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        starts = np.repeat(base[:-1], count) + step
        owner = np.repeat(chosen, count)
        where = np.empty(base[-1], np.int64)
        where[starts] = np.arange(len(starts))
        sa, levels = suffix_array(text, starts)
        lcp = common_prefixes(sa, levels, text)
        head = np.flatnonzero(lcp < WINDOW)
        at = where[sa]
        low = np.minimum.reduceat(least[owner[at]], head)
        low = np.repeat(low, np.diff(np.r_[head, len(sa)]))
        lowest[offset[owner[at]] + step[at]] = low
    # each occurrence against the lowest document of each of its windows
    total = windows.sum()
    row = np.repeat(np.arange(n), windows)
    step = np.arange(total) - np.repeat(np.cumsum(windows) - windows, windows)
    gone = lowest[offset[kind[row]] + step] < ids[row]
    at = np.flatnonzero(gone)
    if not len(at):
        return at, at, at
    head = np.ones(len(at), bool)
    head[1:] = (at[1:] != at[:-1] + 1) | (row[at][1:] != row[at][:-1])
    begin = np.flatnonzero(head)
    return row[at[begin]], step[at[begin]], np.diff(np.r_[begin, len(at)])


def _judged(batches):
    """Suffix arrays over the contexts of a partition, in blocks that keep an anchor together."""
    batches = list(batches)
    if not sum(b.num_rows for b in batches):
        return
    table = pa.Table.from_batches(batches)
    anchor, ids, windows = (table[c].to_numpy() for c in ("anchor", "doc_id", "windows"))
    places = table["places"].combine_chunks()
    data, bounds = scan.joined(table["context"])
    blocks = max(1, len(data) // BLOCK)
    block = (scan.mix(anchor.view(np.uint64)) % scan.U(blocks)).astype(np.int64)
    order = np.argsort(block, kind="stable")
    cut = np.searchsorted(block[order], np.arange(blocks + 1))
    for a, b in zip(cut, cut[1:]):
        rows = order[a:b]
        if not len(rows):
            continue
        size = bounds[rows + 1] - bounds[rows]
        base = np.r_[0, np.cumsum(size)]
        text = data[np.repeat(bounds[rows] - base[:-1], size) + np.arange(base[-1])]
        row, step, count = _later(anchor[rows], ids[rows], windows[rows].astype(np.int64), text, base)
        held = places.take(pa.array(rows[row]))
        shifted = held.flatten().to_numpy() + np.repeat(step, held.value_lengths().to_numpy())
        moved = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(held.value_lengths().to_numpy())].astype(np.int32)), pa.array(shifted))
        yield pa.RecordBatch.from_arrays([pa.array(ids[rows][row]), moved, pa.array(count.astype(np.int32))], names=["doc_id", "places", "windows"])


def _cut(batches):
    for batch in batches:
        out = {k: [] for k in ("n", "removed", "spans", "kept")}
        for text, tag, later, copy in zip(*(batch.column(i).to_pylist() for i in range(1, 5))):
            raw = (text or "").encode()
            gone = np.zeros(len(raw) + 1, np.int64)
            if copy and len(raw) >= WINDOW:
                gone[0], gone[-1] = 1, -1
            elif later:
                place = np.array([p for x in later for p in x["places"]], np.int64)
                count = np.repeat([x["windows"] for x in later], [len(x["places"]) for x in later])
                own = (place >> PLACE) == tag
                start = place[own] & ((1 << PLACE) - 1)
                np.add.at(gone, start, 1)
                np.add.at(gone, start + count[own] + WINDOW - 1, -1)
            edge = np.flatnonzero(np.diff(np.r_[0, np.cumsum(gone[:-1]) > 0, 0])) if copy or later else np.zeros(0, np.int64)
            begin, end = edge[::2], edge[1::2]
            out["n"].append(len(raw))
            out["removed"].append(int((end - begin).sum()))
            out["spans"].append([{"start": int(a), "end": int(b)} for a, b in zip(begin, end)])
            out["kept"].append(raw if not len(edge) else b"".join(raw[a:b] for a, b in zip(np.r_[0, end], np.r_[begin, len(raw)])))
        yield pa.RecordBatch.from_arrays([
            batch.column(0), pa.array(out["n"], pa.int64()), pa.array(out["removed"], pa.int64()),
            pa.array(out["spans"], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(out["kept"], pa.binary()),
        ], names=["doc_id", "n_bytes", "n_removed", "removed", "kept"])


def _pieces(df: DataFrame, column: str, size: int) -> int:
    """Into how many parts `df` is dealt, so that a part has about `size` bytes of `column`; the session's setting is the least."""
    whole = df.agg(F.sum(F.octet_length(column))).first()[0] or 0
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-whole // size))


def remove_repeats(docs: DataFrame, hot: int = HOT, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(doc_id, n_bytes, n_removed, removed, kept) for every row of `docs` (doc_id, text; other columns are not read).

    A byte goes if a string of `WINDOW` bytes around it also starts in a document with a smaller doc_id, judged on the input. `removed` are maximal
    byte ranges, `kept` the other bytes (a character may be cut). A null text is empty; shorter texts stay whole. Rows that share a doc_id never
    remove from each other; rows without a doc_id neither lose bytes nor cost others any. An empty table gives an empty result.
    A shard has about `shard_bytes` of text, and a task judges about as many bytes of contexts, whatever the table's size.
    """
    spark = docs.sparkSession
    small_batches(spark)
    tag = F.xxhash64("text").bitwiseAND(F.lit((1 << 23) - 1))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), tag.alias("tag"))
    shards = _pieces(texts, "text", shard_bytes)
    shard = F.pmod(F.hash("doc_id"), F.lit(shards)).alias("shard")
    own = texts.where("doc_id is not null")
    # copies of a whole text
    sums = own.where(F.octet_length("text") >= WINDOW).select("doc_id", "tag", F.unhex(F.sha2("text", 256)).alias("sum"))
    copies = stored(sums.join(sums.groupBy("sum").agg(F.min("doc_id").alias("first")), "sum").where("doc_id > first").select("doc_id", "tag").distinct(), "copies")
    bits, shard_type = (shards - 1).bit_length(), "<u2" if shards <= 1 << 16 else "<i4"
    runs = own.select(shard, "text").mapInArrow(_runs(bits, shard_type), "range long, prints binary, shards binary, holders binary")
    found = runs.repartition("range").mapInArrow(_repeated(hot, shard_type), "shard int, prints binary, hot binary")
    nothing = [F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("tag")]
    told = stored(found.select("shard", "prints", "hot", *nothing), "repeated")
    release(spark)
    right = told.union(copies.select(shard, F.lit(None).cast("binary"), F.lit(None).cast("binary"), "doc_id", "tag"))
    row = "anchor long, second int, doc_id long, places array<long>, windows int, context binary"
    contexts = stored(own.select(shard, "doc_id", "tag", "text").groupBy("shard").cogroup(right.groupBy("shard")).applyInArrow(lambda a, b: _contexts(a, b, bits), row), "contexts")
    release(spark)
    plain = contexts.where("context is not null").repartition(_pieces(contexts, "context", shard_bytes), "anchor").mapInArrow(_judged, "doc_id long, places array<long>, windows int")
    rows = contexts.where("context is null").select("anchor", "second", "doc_id", "places", "windows")
    common = rows.groupBy("anchor", "second").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").drop("last")
    later = plain.union(rows.join(common, ["anchor", "second"]).where("doc_id > first").select("doc_id", "places", "windows"))
    by_doc = stored(later.groupBy("doc_id").agg(F.collect_list(F.struct("places", "windows")).alias("later")), "spans")
    release(spark)
    joined = texts.join(by_doc, "doc_id", "left").join(copies.withColumn("copy", F.lit(True)), ["doc_id", "tag"], "left")
    return joined.select("doc_id", "text", "tag", "later", "copy").mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, removed array<struct<start:long,end:long>>, kept binary")
