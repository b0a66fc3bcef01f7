"""Passages of `WINDOW` words that repeat across documents, by a compacted graph of token k-mers (operator 6).

The graph is a De Bruijn graph on chosen k-mers: of every window of `WINDOW` words the k-mer with the least fingerprint is an edge, so equal
windows always hold the same edge, and about one k-mer in sixteen is one. Two edges that follow each other in a document are joined by a link, the
fingerprint of all words from the first to the end of the second. An edge all of whose occurrences share the next link, met by an edge all of
whose occurrences share it as the previous one, does not branch; one join on the link finds these, and runs of them in a document are one
compacted path. All windows inside a path have the occurrences of any of its edges. Windows at branching edges are compared one by one, by 96-bit
fingerprints. Source coordinates (document and word) carry every decision back to the text.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wiresift.llm import scan
from wiresift.llm.common import quoted, release, small_batches, stored

WINDOW, KMER = 50, 20
#: A coordinate is a tag of the text (so that rows sharing a doc_id stay apart) above 40 bits of word position.
PLACE = 40


def _edges_of(words: scan.Words, prints: np.ndarray):
    """(k-mer fingerprints, window mask, edge position of each window)"""
    return scan.rolling(prints, KMER), scan.within(words.at, len(prints), WINDOW)


def _edges(batches):
    for batch in batches:
        for i, j, data, offsets in scan.text_batches(batch.column(1)):
            words = scan.Words(data, offsets)
            prints = words.prints()
            grams, ok = _edges_of(words, prints)
            if not ok.any():
                continue
            at = np.unique(scan.sliding_argmin(grams, WINDOW - KMER + 1)[ok])
            row = words.row()[at]
            p = scan.prefix(prints, scan.CHAIN)
            link = np.zeros(len(at) + 1, scan.U)
            follows = np.flatnonzero(row[1:] == row[:-1])
            link[follows + 1] = scan.spans(p, scan.CHAIN, at[follows], at[follows + 1] + KMER) | scan.U(1)
            tag = batch.column(2).slice(i, j - i).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([
                pa.array(grams[at].view(np.int64)), batch.column(0).slice(i, j - i).take(pa.array(row)),
                pa.array((tag[row] << PLACE) | (at - words.at[row])), pa.array(link[:-1].view(np.int64)), pa.array(link[1:].view(np.int64)),
            ], names=["edge", "doc_id", "place", "prev", "next"])


def _own(entries, tag: int):
    """Entries (place, first, joined) of the text with this tag, in order."""
    place = np.array([e["place"] for e in entries], np.int64)
    own = (place >> PLACE) == tag
    order = np.argsort(place[own], kind="stable")
    first = np.array([e["first"] for e in entries], np.int64)[own][order]
    joined = np.array([bool(e["joined"]) for e in entries], bool)[own][order]
    return (place[own] & ((1 << PLACE) - 1))[order], first, joined


def _paths(at: np.ndarray, first: np.ndarray, joined: np.ndarray):
    """Runs of joined edges as (first word, end word, smallest doc_id)."""
    if not len(at):
        return at, at, first
    head = np.ones(len(at), bool)
    head[1:] = ~joined[:-1]
    begin = np.flatnonzero(head)
    last = np.r_[begin[1:] - 1, len(at) - 1]
    return at[begin], at[last] + KMER, first[begin]


def _inside(n: int, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Starts of the windows that lie inside [begin, end) ranges, as a mask over n words."""
    mark = np.zeros(n + 1, np.int64)
    long = end - begin >= WINDOW
    np.add.at(mark, begin[long], 1)
    np.add.at(mark, end[long] - WINDOW + 1, -1)
    return np.cumsum(mark[:-1]) > 0


def _windows(batches):
    """Windows whose edge is repeated and that no compacted path decides."""
    for batch in batches:
        batch = batch.filter(pc.is_valid(batch.column(3)))
        for i, j, data, offsets in scan.text_batches(batch.column(1)):
            words = scan.Words(data, offsets)
            prints = words.prints()
            grams, ok = _edges_of(words, prints)
            if not ok.any():
                continue
            edge = scan.sliding_argmin(grams, WINDOW - KMER + 1)
            wanted, settled = np.zeros(len(prints), bool), np.zeros(len(prints), bool)
            tags = batch.column(2).slice(i, j - i).to_pylist()
            for r, entries in enumerate(batch.column(3).slice(i, j - i).to_pylist()):
                at, first, joined = _own(entries, tags[r])
                a, b = words.at[r], words.at[r + 1]
                wanted[a + at] = True
                begin, end, _ = _paths(at, first, joined)
                settled[a:b] = _inside(b - a, begin, end)
            s = np.flatnonzero(ok & wanted[edge] & ~settled[:len(ok)])
            row = words.row()[s]
            one = scan.spans(scan.prefix(prints, scan.CHAIN), scan.CHAIN, s, s + WINDOW)
            two = scan.spans(scan.prefix(scan.mix(prints), scan.BASE), scan.BASE, s, s + WINDOW)
            two = (two >> scan.U(32)).astype(np.uint32).view(np.int32)
            order, heads = scan.grouped(row, one, two)  # a text that repeats a window has one row of it
            place = (np.array(tags, np.int64)[row] << PLACE) | (s - words.at[row])
            at = order[heads]
            yield pa.RecordBatch.from_arrays([
                pa.array(one[at].view(np.int64)), pa.array(two[at]), batch.column(0).slice(i, j - i).take(pa.array(row[at])), scan.listed(place[order], heads),
            ], names=["f1", "f2", "doc_id", "places"])


def _removed(n: int, doc_id, tag: int, entries, later) -> np.ndarray:
    gone = np.zeros(n + 1, np.int64)
    start = np.zeros(n, bool)
    if entries and doc_id is not None:
        begin, end, first = _paths(*_own(entries, tag))
        earlier = first < doc_id
        start |= _inside(n, begin[earlier], end[earlier])
    if later:
        place = np.array(later, np.int64)
        place = place[(place >> PLACE) == tag] & ((1 << PLACE) - 1)
        start[place] = True
    s = np.flatnonzero(start)
    np.add.at(gone, s, 1)
    np.add.at(gone, s + WINDOW, -1)
    return np.cumsum(gone[:-1]) > 0


def _cut(carry: list[str], as_is: bool):
    def cut(batches):
        for batch in batches:
            ids, texts, tags, entries, later = (batch.column(i).to_pylist() for i in range(5))
            n_words, n_removed, kept, spans = [], [], [], []
            for doc_id, text, tag, own, late in zip(ids, texts, tags, entries, later):
                words = (text or "").encode().split()
                gone = _removed(len(words), doc_id, tag, own, late) if own or late else np.zeros(0, bool)
                n_words.append(len(words))
                n_removed.append(int(gone.sum()))
                edges = np.flatnonzero(np.diff(np.r_[False, gone, False])) if n_removed[-1] else np.zeros(0, np.int64)
                spans.append([{"start": int(a), "end": int(b)} for a, b in zip(edges[::2], edges[1::2])])
                if len(edges):
                    words = [w for a, b in zip(np.r_[0, edges[1::2]], np.r_[edges[::2], len(words)]) for w in words[a:b]]
                kept.append(text if as_is and not len(edges) else b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
                pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.string()), *batch.columns[5:],
            ], names=["doc_id", "n_words", "n_removed", "removed", "kept_text", *carry])
    return cut


def remove_repeats(docs: DataFrame, carry: list[str] | None = None, as_is: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, removed, kept_text, *carry) for every row of `docs` (doc_id, text; of other columns only `carry` are read).

    A word goes if a window of `WINDOW` words around it also starts in a document with a smaller doc_id, judged on the input. `removed` lists word
    ranges, `kept_text` the other words joined by one space
    (with `as_is`, texts that lose nothing keep their own layout). A carried column that is named like one of the operator's own comes back beside it, under its own name. A null text has no words; texts shorter than a window stay whole. Rows that share a
    doc_id never remove from each other; rows without a doc_id neither lose words nor cost others any. Empty tables give empty results.
    """
    spark = docs.sparkSession
    small_batches(spark)
    names = [f"carried_{i}" for i in range(len(carry or []))]
    more = [F.col(quoted(c)).alias(n) for c, n in zip(carry or [], names)]
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").bitwiseAND(F.lit((1 << 23) - 1)).alias("tag"), *more)
    edges = texts.select("doc_id", "text", "tag").where("doc_id is not null").mapInArrow(_edges, "edge long, doc_id long, place long, prev long, next long")
    repeated = edges.groupBy("edge").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), *(f(c).alias(f"{f.__name__}_{c}") for c in ("prev", "next") for f in (F.min, F.max))).where("first < last")
    repeated = stored(repeated, "edges")
    release(spark)
    ahead = repeated.where("min_next = max_next and min_next <> 0").select("edge", F.col("min_next").alias("link"))
    back = repeated.where("min_prev = max_prev and min_prev <> 0").select(F.col("min_prev").alias("link"))
    joined = ahead.join(back, "link", "left_semi").select("edge", F.lit(True).alias("joined"))
    found = edges.select("edge", "doc_id", "place").join(repeated.select("edge", "first").join(joined, "edge", "left"), "edge")
    by_doc = stored(found.groupBy("doc_id").agg(F.collect_list(F.struct("place", "first", "joined")).alias("entries")), "occurrences")
    release(spark)
    held = texts.join(by_doc, "doc_id", "left").select("doc_id", "text", "tag", "entries", *names)
    windows = held.mapInArrow(_windows, "f1 long, f2 int, doc_id long, places array<long>")
    common = windows.groupBy("f1", "f2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").drop("last")
    later = windows.join(common, ["f1", "f2"]).where("doc_id > first").groupBy("doc_id").agg(F.flatten(F.collect_list("places")).alias("later"))
    full = held.join(later, "doc_id", "left").select("doc_id", "text", "tag", "entries", "later", *names)
    own = T.StructType.fromDDL("doc_id long, n_words long, n_removed long, removed array<struct<start:long,end:long>>, kept_text string")
    cut = full.mapInArrow(_cut(names, as_is), T.StructType([*own, *(full.schema[n] for n in names)]))
    return cut.select("doc_id", "n_words", "n_removed", "removed", "kept_text", *(F.col(n).alias(c) for c, n in zip(carry or [], names)))
