"""Near-duplicate classes from bottom-k sketches of one hash function (operator 7).

Every document becomes the set of its 5-word shingles (64-bit fingerprints). Equal sets are one class. A class keeps its `SKETCH` least
fingerprints; inverted lists of the retained values give candidates, the least values of a pair's union estimate its similarity, and the full
sets decide. Three things keep the lists short without losing a link:

* Of a sketch only the rarest retained values open a list. Two sets with a Jaccard similarity of `SIMILAR` share at least `needed(n)` retained
  values (but for one chance in 10**10), so their rarest `kept - needed + 1` values must have one in common; values of a passage that a third
  of all documents hold are the commonest and stay outside.
* A list of up to `SMALL` classes compares all of them; a longer one first compares all with its smallest class, and copies of one text are then
  one component. Where a long list still holds several components, its classes are compared in packs of about `PACK` with the same longest list:
  two packs meet if their longest lists are those of classes that share any list, one task row multiplies their full sets, and only one link for
  each class and component leaves it. So no group is ever gathered in a task, and pairs that fail are never written.
* A pair that meets in several lists is compared once.
"""
from __future__ import annotations

from math import ceil, comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wiresift.llm import scan
from wiresift.llm.common import components, release, small_batches, stored

WORDS, SKETCH, SIMILAR, MISS = 5, 64, 75, 1e-10
SMALL, PACK = 6, 64


def needed(n: int, k: int = SKETCH, similar: int = SIMILAR, miss: float = MISS) -> int:
    """How many retained values a set of n shares with any set of at least that similarity, but for a chance of `miss`."""
    if 100 * n <= similar * k:  # the union fits in a sketch: both are whole
        return max(1, ceil(similar * n / 100))
    s, p, total, c = min(n, k), similar / 100, 0.0, 0
    while True:
        total += comb(s, c) * p**c * (1 - p) ** (s - c)
        if total > miss:
            return max(1, c)
        c += 1


NEEDED = [needed(max(n, 1)) for n in range(SKETCH + 1)]
#: A pair is given up where fewer of its union sketch's values are shared than a link has but for a chance of `MISS`; a union that fits in its sketch is exact.
FLOOR = NEEDED[SKETCH] / SKETCH


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = WORDS):
    """The distinct shingles of each text as (values, bounds), ascending within a text. Fewer words than `width`: the whole sequence is one."""
    data = scan.lower(data)
    words = scan.Words(data, offsets)
    prints = words.prints()
    rows = len(offsets) - 1
    rolled = scan.rolling(prints, width)
    ok = scan.within(words.at, len(prints), width)
    values, row = rolled[ok], words.row()[:len(rolled)][ok]
    lengths = np.diff(words.at)
    short = np.flatnonzero((lengths > 0) & (lengths < width))
    if len(short):
        whole = scan.spans(scan.prefix(prints, scan.CHAIN), scan.CHAIN, words.at[short], words.at[short + 1])
        values, row = np.concatenate([values, whole]), np.concatenate([row, short])
    order = np.argsort(values, kind="stable")
    order = order[np.argsort(row[order], kind="stable")]
    values, row = values[order], row[order]
    first = np.ones(len(values), bool)
    first[1:] = (values[1:] != values[:-1]) | (row[1:] != row[:-1])
    values, row = values[first], row[first]
    return values, np.searchsorted(row, np.arange(rows + 1))


def _sketches(batches):
    for batch in batches:
        for i, j, data, offsets in scan.text_batches(batch.column(1)):
            values, at = shingle_sets(data, offsets)
            n = np.diff(at)
            keep = np.minimum(n, SKETCH)
            total = int(keep.sum())
            take = np.repeat(at[:-1] - np.r_[0, np.cumsum(keep)[:-1]], keep) + np.arange(total)
            p, q = scan.prefix(values, scan.BASE), scan.prefix(values ^ scan.U(0x5851F42D4C957F2D), scan.CHAIN)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).slice(i, j - i), pa.array(n.astype(np.int64)),
                pa.array(scan.spans(p, scan.BASE, at[:-1], at[1:]).view(np.int64)), pa.array(scan.spans(q, scan.CHAIN, at[:-1], at[1:]).view(np.int64)),
                pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(keep)].astype(np.int32)), pa.array(values[take].view(np.int64))),
            ], names=["doc_id", "n", "c1", "c2", "sketch"])


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, n, c1, c2, sketch) of (doc_id, text): set size, a 128-bit fingerprint of the set, its least values as unsigned, stored signed."""
    return docs.mapInArrow(_sketches, "doc_id long, n long, c1 long, c2 long, sketch array<long>")


def _full_sets(batches):
    for batch in batches:
        for i, j, data, offsets in scan.text_batches(batch.column(1)):
            values, at = shingle_sets(data, offsets)
            raw = (values & scan.U((1 << 48) - 1)).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()
            bounds = (at * 6).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.LargeBinaryArray.from_buffers(pa.large_binary(), j - i, [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(raw)]).cast(pa.binary())], names=["node", "whole"])


def _confirm(batches):
    """Keep the pairs whose full sets are similar enough."""
    def unpack(x):
        raw = np.zeros((len(x) // 6, 8), np.uint8)
        raw[:, :6] = np.frombuffer(x, np.uint8).reshape(-1, 6)
        return raw.view(np.uint64).ravel()
    for batch in batches:
        keep = []
        for x, y in zip(batch.column(2), batch.column(3)):
            u, v = unpack(x.as_buffer()), unpack(y.as_buffer())
            both = len(u) + len(v) - len(np.unique(np.concatenate([u, v])))
            keep.append(100 * both >= SIMILAR * (len(u) + len(v) - both))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _lists(nodes: DataFrame) -> DataFrame:
    """Inverted lists (value, node) of the values that open one."""
    postings = nodes.select("node", "n", F.explode("sketch").alias("value"))
    common = postings.groupBy("value").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    need = F.element_at(F.array(*[F.lit(x) for x in NEEDED]), (F.least(F.col("n"), F.lit(SKETCH)) + 1).cast("int"))
    shared = postings.join(common, "value").groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("df", "value"))).alias("v"))
    opening = F.least(F.col("n"), F.lit(SKETCH)) - need + 1 - (F.least(F.col("n"), F.lit(SKETCH)) - F.size("v"))
    return shared.where(opening > 0).select("node", F.explode(F.slice("v", 1, opening.cast("int"))).alias("x")).select("node", F.col("x.value").alias("value"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of `docs` (doc_id, text; other columns are not read).

    component_id is the smallest doc_id reachable over links of similarity `SIMILAR` or more between 5-word shingle sets; kept is whether that is
    the row's own. A null or empty text, or one without a word, has no shingle and is linked with nothing. A doc_id should name
    one text; where rows with different texts share one and it is the smallest of each of their classes, these classes are one. Rows without a doc_id follow the class of their text and are kept only where it has no doc_id at all. An empty
    table gives an empty result; the order of rows and copies of rows change nothing.
    """
    spark = docs.sparkSession
    small_batches(spark)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    made = stored(sketches(slim).withColumn("row", F.monotonically_increasing_id()), "sketches")
    # one row of each class, the first with its smallest doc_id, stands for it
    first = F.min(F.struct("doc_id", "row")).alias("x")
    classes = stored(made.where("n > 0 and doc_id is not null").groupBy("c1", "c2").agg(first).select("c1", "c2", F.col("x.doc_id").alias("node"), F.col("x.row").alias("row")), "classes")
    nodes = stored(made.select("row", "n", "sketch").join(classes.select("row", "node"), "row").drop("row"), "nodes")
    lists = stored(_lists(nodes), "lists")
    release(spark)
    labels = _link(slim, nodes, lists)
    named = classes.join(labels, "node", "left").select("c1", "c2", F.coalesce("label", "node").alias("component"))
    out = made.drop("sketch", "row").join(named, ["c1", "c2"], "left")
    component = F.when(F.col("n") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def _first_pairs(lists: DataFrame) -> DataFrame:
    """All pairs of the small lists, and the smallest class of each longer list with all others of it."""
    small = lists.where(F.col("size") <= SMALL).select("value", "node")
    met = small.join(small.withColumnRenamed("node", "other"), "value").where("node < other")
    long = lists.where(F.col("size") > SMALL).select("least", "node").where("node > least")
    return met.select(F.col("node").alias("a"), F.col("other").alias("b")).union(long).distinct()


def _likely(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs whose union sketch puts them near the threshold or above."""
    sketch = nodes.select("node", "sketch")
    seen = pairs.join(sketch.select(F.col("node").alias("a"), F.col("sketch").alias("s")), "a").join(sketch.select(F.col("node").alias("b"), F.col("sketch").alias("t")), "b")
    # the retained values are least as unsigned numbers: flip the top bit around sorting
    flip = lambda x: F.transform(x, lambda y: y.bitwiseXOR(F.lit(-(1 << 63))))
    union = flip(F.slice(F.array_sort(flip(F.array_union("s", "t"))), 1, SKETCH))
    return seen.where(F.size(F.array_intersect(F.array_intersect("s", "t"), union)) >= F.lit(FLOOR) * F.size(union)).select("a", "b")


def _across(batches):
    """Links between two packs of full sets: for each class of the first, one in each other component of the second."""
    for batch in batches:
        a, b = [], []
        for row in range(batch.num_rows):
            left, right = batch.column(0)[row].as_py(), batch.column(1)[row].as_py()
            sets = [np.frombuffer(x["whole"], np.uint8).reshape(-1, 6) for x in (*left, *right)]
            sizes = np.array([len(x) for x in sets])
            raw = np.zeros((int(sizes.sum()), 8), np.uint8)
            raw[:, :6] = np.concatenate(sets)
            _, value, count = np.unique(raw.view(np.uint64).ravel(), return_inverse=True, return_counts=True)
            owner = np.repeat(np.arange(len(sets)), sizes)
            shared = count[value] > 1
            owner, value = owner[shared], np.cumsum(count > 1)[value[shared]] - 1
            order = np.argsort(value, kind="stable")
            owner, value, k = owner[order], value[order], len(left)
            both = np.zeros((k, len(right)), np.float32)
            for low in range(0, int(value[-1]) + 1 if len(value) else 0, 8192):
                i, j = np.searchsorted(value, [low, low + 8192])
                held = np.zeros((len(sets), 8192), np.float32)
                held[owner[i:j], value[i:j] - low] = 1
                both += held[:k] @ held[k:].T
            union = sizes[:k, None] + sizes[None, k:] - both
            labels, others = np.array([x["label"] for x in left]), np.array([x["label"] for x in right])
            x, y = np.nonzero((100 * both >= SIMILAR * union) & (labels[:, None] != others[None, :]))
            _, once = np.unique(np.stack([x, others[y]], 1), axis=0, return_index=True) if len(x) else (None, np.zeros(0, np.int64))
            a += [left[i]["node"] for i in x[once]]
            b += [right[i]["node"] for i in y[once]]
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _packed(home: DataFrame, sets: DataFrame, labels: DataFrame) -> DataFrame:
    """(home, part, x): the nodes of each home dealt by hash into packs of about `PACK`, with their labels and full sets."""
    parts = home.groupBy("home").agg(F.ceil(F.count(F.lit(1)) / PACK).alias("parts"))
    dealt = home.join(parts, "home").select("home", "node", F.pmod(F.xxhash64("node"), "parts").alias("part"))
    full = dealt.join(sets, "node").join(labels, "node", "left").select("home", "part", F.struct("node", F.coalesce("label", "node").alias("label"), "whole").alias("x"))
    return full.groupBy("home", "part").agg(F.collect_list("x").alias("x"))


def _link(slim: DataFrame, nodes: DataFrame, lists: DataFrame) -> DataFrame:
    """(node, label) of all nodes with a link."""
    spark = slim.sparkSession
    sizes = lists.groupBy("value").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("least")).where("size > 1")
    lists = stored(lists.join(sizes, "value"), "members")
    texts = slim.join(lists.select(F.col("node").alias("doc_id")).distinct(), "doc_id", "left_semi")
    sets = stored(texts.mapInArrow(_full_sets, "node long, whole binary"), "sets")
    release(spark)
    likely = _likely(_first_pairs(lists), nodes)
    full = likely.join(sets.select(F.col("node").alias("a"), F.col("whole").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("whole").alias("y")), "b")
    links = full.select("a", "b", "x", "y").mapInArrow(_confirm, "a long, b long")
    labels = components(links)
    release(spark)
    # long lists with several components
    seen = lists.where(F.col("size") > SMALL).join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    split = seen.groupBy("value").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("value")
    seen = stored(seen.join(split, "value", "left_semi").select("value", "node", "size"), "open")
    home = seen.groupBy("node").agg(F.max(F.struct("size", "value")).alias("x")).select("node", F.col("x.value").alias("home"))
    homes = stored(seen.select("value", "node").join(home, "node").select("value", "home").distinct(), "homes")
    near = homes.join(homes.withColumnRenamed("home", "other"), "value").where("home <= other").select("home", "other").distinct()
    packs = stored(_packed(home, sets, labels), "packs")
    met = near.join(packs.withColumnRenamed("x", "left"), "home").join(packs.select(F.col("home").alias("other"), F.col("x").alias("right"), F.col("part").alias("other_part")), "other")
    met = met.where("home < other or part <= other_part")
    more = met.select("left", "right").mapInArrow(_across, "a long, b long")
    return components(labels.where("node <> label").select(F.col("node").alias("a"), F.col("label").alias("b")).union(more))
