"""Spelling variants: words one inserted, deleted or replaced letter apart, found by a bit-sliced position index.

Words are runs of letters, counted over all texts; a few runs lose a letter by a rule of the caller's contract. Near words are looked for in groups of words that
agree outside one region: two words of L and L (or L + 1) letters that are one edit apart agree outside the half that holds the edit. A group that is still large
is cut again into the halves of its region, which ends with regions of one letter, so a group is bounded by the alphabet and never by the vocabulary. Inside a task a
few thousand words share one index: a bitset for every (position, letter). A query word walks its letters over the bitsets of its group, carrying the words that agree so far, those
with one replaced letter, and those with one letter more, read at the next position.

Rows: a null text has no words; a null doc_id counts as an empty one; repeated rows count as often as they stand; an empty table gives an empty result; ties of the
most frequent near word go to the smaller word in code-point order. Other columns are not read, whatever their names.
"""
from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wiresift.llm import scan
from wiresift.llm.common import small_batches, stored
from wiresift.plans.sizes import broadcast_if_small

U = np.uint64
LEAST = 6          # letters of a word
HOT = 4096         # rows of a group that is cut no further
BLOCK = 8192       # rows under one index
CELLS = 1 << 16    # bitset words that a batch of queries holds at once


def letters(data: np.ndarray) -> np.ndarray:
    """Which bytes belong to A-Z, a-z or U+00C0..U+00FF (the lead byte C3 and what follows it)."""
    lead = data == 0xC3
    inside = (((data | np.uint8(32)) - np.uint8(97)) < 26) | lead
    inside[1:] |= lead[:-1]
    return inside


def _counted(every: int):
    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id")
            for i, j, data, offsets in scan.text_batches(batch.column("text"), 4 << 20):
                low = scan.lower(data)
                words = scan.Words(low, offsets, letters(low))
                more = np.r_[0, np.cumsum((low & np.uint8(0xC0)) == 0x80)]
                long = words.end - words.start - (more[words.end] - more[words.start]) >= LEAST
                if not long.any():
                    continue
                found = scan.cut_out(low, words.start[long], words.end[long]).dictionary_encode()
                names = found.dictionary.cast(pa.large_binary()).to_pylist()
                pairs, n = np.unique(words.row()[long] * len(names) + found.indices.to_numpy(), return_counts=True)
                row, code = np.divmod(pairs, len(names))
                # the checksum of "<doc_id>:<run>" goes on from that of "<doc_id>:"
                heads = [zlib.crc32(f"{'' if x is None else x}:".encode()) for x in ids.slice(i, j - i).to_pylist()]
                sums = np.fromiter((zlib.crc32(names[c], heads[r]) for r, c in zip(row.tolist(), code.tolist(), strict=True)), np.int64, len(row))
                left, changed = n.copy(), Counter()
                for k in np.flatnonzero(sums % every == 0) if every else ():
                    run = names[code[k]].decode()
                    at = int(sums[k]) % len(run)
                    if len(run) > LEAST:
                        changed[run[:at] + run[at + 1:]] += int(n[k])
                    left[k] = 0
                total = np.bincount(code, left, len(names)).astype(np.int64)
                stay = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([found.dictionary.take(pa.array(stay)).cast(pa.string()), pa.array(total[stay])], ["word", "n"])
                if changed:
                    yield pa.RecordBatch.from_arrays([pa.array(list(changed), pa.string()), pa.array(list(changed.values()), pa.int64())], ["word", "n"])
    return run


def word_counts(docs: DataFrame, least: int = 5, every: int = 199) -> DataFrame:
    """(word, n): runs of at least six letters found `least` times or more. Where the CRC-32 of `<doc_id>:<run>` is a multiple of `every`, the run has lost one letter (0: none has)."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInArrow(_counted(every), "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


class Index:
    """Bitsets over `words`: at[p << 21 | letter] is the row of `bits` that tells which words have that letter at position p."""

    def __init__(self, words: pa.Array):
        self.points = np.frombuffer("".join(words.to_pylist()).encode("utf-32-le"), np.uint32).astype(np.int64)
        self.size = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        self.start = np.r_[0, np.cumsum(self.size)[:-1]]
        row = np.repeat(np.arange(len(words)), self.size)
        codes = (np.arange(len(self.points)) - self.start[row]) << 21 | self.points
        self.at, self.place = np.unique(codes, return_inverse=True)
        self.width = (len(words) + 63) // 64
        order, heads = scan.grouped(self.place, row >> 6)
        self.bits = np.zeros((len(self.at) + 1, self.width), U)  # the last row: no word has it
        self.bits[self.place[order[heads]], (row >> 6)[order[heads]]] = np.bitwise_or.reduceat(U(1) << (row[order] & 63).astype(U), heads)

    def where(self, position: int, letter: np.ndarray) -> np.ndarray:
        """Rows of `bits` for letters at one position."""
        codes = np.int64(position) << 21 | letter
        k = np.minimum(np.searchsorted(self.at, codes), len(self.at) - 1)
        return np.where(self.at[k] == codes, k, len(self.at))


def _mask(lo: np.ndarray, hi: np.ndarray, first: np.ndarray, width: int) -> np.ndarray:
    """Bitsets, one a row, of the words lo..hi - 1, over `width` 64-bit cells from cell `first`."""
    cell = (first[:, None] + np.arange(width)) << 6
    up_to = lambda n: np.where(n >= 64, ~U(0), (U(1) << np.clip(n, 0, 63).astype(U)) - U(1))
    return up_to(np.clip(hi[:, None] - cell, 0, 64)) & ~up_to(np.clip(lo[:, None] - cell, 0, 64))


def near_in_groups(words: pa.Array, size: np.ndarray, region_end: np.ndarray, heads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a, b): places of near words inside the groups that begin at `heads`, each pair in both directions, once.

    A group holds words of `size` and `size` + 1 letters that agree outside a region ending at letter `region_end` of the shorter ones.
    Of a pair with an inserted letter, the group whose region holds the end of the common prefix reports it.
    """
    index = Index(words)
    ends = np.r_[heads[1:], len(words)]
    group = np.repeat(np.arange(len(heads)), ends - heads)
    shorter = index.size == size
    asks = np.flatnonzero(shorter & ((ends - heads)[group] > 1))
    if not len(asks):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    lo, hi = heads[group[asks]], ends[group[asks]]
    width = np.minimum(index.width, 1 << np.ceil(np.log2(((hi - 1) >> 6) - (lo >> 6) + 1)).astype(np.int64))
    same = np.packbits(np.r_[shorter, np.zeros(-len(shorter) % 64, bool)], bitorder="little").view(U)
    order, cuts = scan.grouped(size[asks], width)
    out = []
    for c, d in zip(cuts, np.r_[cuts[1:], len(order)], strict=True):
        w, m = int(width[order[c]]), int(size[asks[order[c]]])
        for s in range(c, d, max(1, CELLS // w)):
            k = order[s:min(d, s + max(1, CELLS // w))]
            q, first = asks[k], np.minimum(lo[k] >> 6, index.width - w)
            cells = first[:, None] + np.arange(w)
            agree = _mask(lo[k], hi[k], first, w)
            equal_size = same[cells]
            replaced, longer, beyond = np.zeros_like(agree), np.zeros_like(agree), np.zeros_like(agree)
            for j in range(m):
                at = index.start[q] + j
                here = index.bits[index.place[at][:, None], cells]
                after = index.bits[index.where(j + 1, index.points[at])[:, None], cells]
                longer = (longer | agree) & after
                replaced = (replaced & here) | (agree & ~here)
                agree &= here
                ending = region_end[q] == j + 1
                if j + 1 < m and ending.any():
                    beyond[ending] = agree[ending]
            for hit, both in ((replaced & equal_size, False), ((longer | agree) & ~equal_size & ~beyond, True)):
                a, bit = np.nonzero(np.unpackbits(hit.view(np.uint8), axis=1, bitorder="little"))
                a, b = q[a], (first[a] << 6) + bit
                out += [(a, b), (b, a)] if both else [(a, b)]
    return np.concatenate([x for x, _ in out]), np.concatenate([x for _, x in out])


def _judged(batches):
    """For each word and group: how many near words it has there, and the best of them by (largest n, smallest word)."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table]).combine_chunks()
        if len(held) >= BLOCK:
            key = held["key"].combine_chunks()
            cuts = np.flatnonzero(pc.not_equal(key[1:], key[:-1]).to_numpy(zero_copy_only=False)) + 1
            if len(cuts):
                yield from _best(held.slice(0, int(cuts[-1])))
                held = held.slice(int(cuts[-1])).combine_chunks()
    if held is not None and len(held):
        yield from _best(held)


def _best(table: pa.Table):
    key, words, n = (table[c].combine_chunks() for c in ("key", "word", "n"))
    heads = np.r_[0, np.flatnonzero(pc.not_equal(key[1:], key[:-1]).to_numpy(zero_copy_only=False)) + 1]
    stay = np.repeat(np.diff(np.r_[heads, len(key)]) > 1, np.diff(np.r_[heads, len(key)]))
    if not stay.any():
        return
    table = table.filter(pa.array(stay))
    words, n, size, end = (table[c].combine_chunks() for c in ("word", "n", "size", "hi"))
    key = table["key"].combine_chunks()
    heads = np.r_[0, np.flatnonzero(pc.not_equal(key[1:], key[:-1]).to_numpy(zero_copy_only=False)) + 1]
    n = n.to_numpy()
    a, b = near_in_groups(words, size.to_numpy(), end.to_numpy(), heads)
    if not len(a):
        return
    rank = np.empty(len(words), np.int64)
    rank[pc.sort_indices(words).to_numpy()] = np.arange(len(words))
    order, heads = scan.grouped(a, -n[b], rank[b])
    first = order[heads]
    starts = np.flatnonzero(np.r_[True, a[first][1:] != a[first][:-1]])
    best = first[starts]
    count = np.diff(np.r_[heads[starts], len(order)])
    yield pa.RecordBatch.from_arrays([words.take(pa.array(a[best])), pa.array(count.astype(np.int64)), words.take(pa.array(b[best])), pa.array(n[b[best]])], ["word", "n_near", "near", "near_n"])


def _regions(words: DataFrame) -> DataFrame:
    """Every word in the groups of its own length and of the length one less, with either half of the word as the region."""
    m = F.length("word")
    half = lambda s: F.array(F.struct(s.alias("size"), F.lit(0).alias("lo"), F.floor(s / 2).cast("int").alias("hi")), F.struct(s.alias("size"), F.floor(s / 2).cast("int").alias("lo"), s.alias("hi")))
    return words.select("word", "n", F.explode(F.when(m > LEAST, F.concat(half(m), half(m - 1))).otherwise(half(m))).alias("r")).select("word", "n", "r.*")


def _halves(rows: DataFrame) -> DataFrame:
    mid = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
    parts = F.array(F.struct("size", "lo", mid.alias("hi")), F.struct("size", mid.alias("lo"), "hi"))
    return rows.select("word", "n", F.explode(parts).alias("r")).select("word", "n", "r.*")


def _keyed(rows: DataFrame) -> DataFrame:
    """`key`: the region and the letters outside it, the ones before it and the last size - hi."""
    rest = F.expr("right(word, size - hi)")
    return rows.withColumn("key", F.concat_ws(" ", "size", "lo", "hi", F.concat(F.expr("left(word, lo)"), rest)))


def near_words(words: DataFrame, hot: int = HOT) -> DataFrame:
    """(word, n_near, near, near_n): near words of each word of `words` (word, n) that has any, and the one of largest n."""
    rows, parts = _keyed(_regions(words)), []
    while True:
        large = stored(rows.groupBy("key").agg(F.count(F.lit(1)).alias("_n"), F.max(F.col("hi") - F.col("lo")).alias("_w")).where((F.col("_n") > hot) & (F.col("_w") > 1)).select("key"), "hot-groups")
        if not large.limit(1).count():
            break
        large = broadcast_if_small(large, 10_000)
        parts.append(rows.join(large, "key", "left_anti"))
        rows = _keyed(_halves(stored(rows.join(large, "key", "left_semi"), "cut-groups")))
    for part in parts:
        rows = rows.unionByName(part)
    found = rows.select("key", "word", "n", "size", "hi").repartition("key").sortWithinPartitions("key").mapInArrow(_judged, "word string, n_near long, near string, near_n long")
    best = F.min(F.struct((-F.col("near_n")).alias("minus"), F.col("near").alias("word")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select("word", "n_near", F.col("best.word").alias("near"), (-F.col("best.minus")).alias("near_n"))


def variants(words: DataFrame, times: int = 5, hot: int = HOT) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of `words` (word, n), which should be a written table.

    `form` is the near word of largest n where that is `times` the word's own n or more, `root` the word at the end of the chain of forms. Counts grow along a chain by
    that factor, so chains are short, and pointers to the end are doubled by joins.
    """
    near = near_words(words, hot)
    formed = F.col("near_n") >= F.lit(times) * F.col("n")
    judged = stored(words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(formed, F.col("near")).alias("form"), F.when(formed, F.col("near_n")).alias("form_n")), "variants")
    ends = judged.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        step = stored(ends.join(ends.select(F.col("word").alias("root"), F.col("root").alias("next")), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        ends = step.select("word", "root")
        if not step.where("moved").limit(1).count():
            break
    return judged.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))
