"""Quality rules over document statistics, and gradient-boosted trees on top of them (operator 3).

Statistics of whole texts come from one vectorised pass per Arrow batch. The trees are grown on the driver from a bounded sample of labelled rows
(`FIT_ROWS`, the labels with the least hash of their doc_id), as histograms in numpy; they are complete binary trees kept as flat node arrays, so
a batch is scored by array lookups. Shares of symbols, repeated lines and repeated words may only lower a score (monotonic constraints).
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wiresift.llm import scan
from wiresift.llm.common import small_batches

#: At most so many labelled rows fit the trees.
FIT_ROWS = 20_000
TREES, DEPTH, RATE, BINS, LEAST, RIDGE = 60, 4, 0.2, 64, 5, 1.0
#: Documents whose score (the probability of good quality) is below this are rejected.
CUT = 0.5
SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)
#: Features and the direction in which each may move the score (0: either).
FEATURES = {
    "log_words": 0, "word_length": 0, "symbols_per_word": -1, "dup_line_share": -1, "repeat_word_share": -1, "upper_share": 0, "digit_share": 0,
    "mark_share": 0, "distinct_share": 0, "words_per_line": 0, "wide_share": 0, "longest_word": 0,
}
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def _seen_before(prints: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(equal to an earlier one of its text, equal to any other one of its text), by position."""
    key = scan.mix(prints ^ scan.mix(row.astype(scan.U) + scan.U(1)))
    order = np.argsort(key, kind="stable")
    same = np.zeros(len(key) + 1, bool)
    same[1:-1] = key[order][1:] == key[order][:-1]
    earlier, other = np.zeros(len(key), bool), np.zeros(len(key), bool)
    earlier[order] = same[:-1]
    other[order] = same[:-1] | same[1:]
    return earlier, other


def statistics(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(base counts, features) of each text, one row a text."""
    words = scan.Words(data, offsets)
    prints, row, rows = words.prints(), words.row(), len(offsets) - 1
    n = np.diff(words.at)
    chars = _sums(words.inside & ((data & 0xC0) != 0x80), offsets)
    symbols = _sums(np.isin(data, SYMBOLS), offsets)
    # lines: cut at \n and at the ends of texts; those with a word count
    filled = offsets[:-1][np.diff(offsets) > 0]
    begin = np.unique(np.r_[filled, np.flatnonzero(data == 10) + 1])
    begin = begin[begin < len(data)]
    text = np.searchsorted(offsets, begin, "right") - 1
    end = np.r_[begin[1:], len(data)]
    end = end - ((end > begin) & (data[np.maximum(end, 1) - 1] == 10)) if len(begin) else end
    has = np.searchsorted(words.start, end) > np.searchsorted(words.start, begin)
    lines = scan.byte_prints(data, begin[has], end[has])
    again, _ = _seen_before(lines, text[has])
    dup_lines = np.bincount(text[has], again, rows).astype(np.int64) if rows else np.zeros(0, np.int64)
    n_lines = np.bincount(text[has], minlength=rows)
    # words in 5-word windows that occur twice
    grams = scan.rolling(prints, 5)
    ok = scan.within(words.at, len(prints), 5)
    at = np.flatnonzero(ok)
    _, twice = _seen_before(grams[at], row[at])
    mark = np.zeros(len(prints) + 1, np.int64)
    mark[at[twice]] += 1
    np.subtract.at(mark, at[twice] + 5, 1)
    repeated = _sums(np.cumsum(mark[:-1]) > 0, words.at)
    known, _ = _seen_before(prints, row)
    distinct = n - _sums(known, words.at)
    base = np.stack([n, chars, symbols, dup_lines, repeated], 1).astype(np.int64)
    size, w = np.maximum(np.diff(offsets), 1), np.maximum(n, 1)
    longest = np.zeros(rows)
    np.maximum.at(longest, row, (words.end - words.start).astype(float))
    letter = (data | 0x20) - np.uint8(97) < 26
    upper = _sums((data - np.uint8(65)) < 26, offsets)
    features = np.stack([
        np.log1p(n), chars / w, symbols / w, dup_lines / np.maximum(n_lines, 1), repeated / w, upper / np.maximum(_sums(letter, offsets), 1),
        _sums((data - np.uint8(48)) < 10, offsets) / size, _sums((data == 33) | (data == 63), offsets) / w, distinct / w, n / np.maximum(n_lines, 1),
        _sums(data >= 0xC0, offsets) / size, np.log1p(longest),
    ], 1)
    return base, features


class Trees:
    """Boosted trees as flat arrays: node i of a tree has children 2i + 1 and 2i + 2; leaves are the last 2**DEPTH nodes."""

    def __init__(self, feature, cut, value, start):
        self.feature, self.cut, self.value, self.start = feature, cut, value, start

    def score(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.full(len(x), self.start), np.arange(len(x))
        inner = 2**DEPTH - 1
        for t in range(len(self.feature)):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, self.feature[t][node]] > self.cut[t][node])
            total += self.value[t][node - inner]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, direction: list[int], trees: int = TREES) -> Trees:
    """Logistic boosting with histogram splits. With no row, or one class only, every score is that class's share (1 for no row)."""
    share = float(y.mean()) if len(y) else 1.0
    start = float(np.log(np.clip(share, 1e-6, 1 - 1e-6) / (1 - np.clip(share, 1e-6, 1 - 1e-6))))
    inner, width = 2**DEPTH - 1, x.shape[1]
    if not len(y) or share in (0.0, 1.0):
        return Trees(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, 2**DEPTH)), start)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for f in range(width)]
    binned = np.stack([np.searchsorted(cuts[f], x[:, f]) for f in range(width)], 1)  # x > cuts[b] exactly when the bin is above b
    feature, cut, value = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, 2**DEPTH))
    total = np.full(len(y), start)
    for t in range(trees):
        p = 1 / (1 + np.exp(-total))
        grad, hess = y - p, np.maximum(p * (1 - p), 1e-9)
        node, low, high = np.zeros(len(y), np.int64), np.full(2 * inner + 1, -np.inf), np.full(2 * inner + 1, np.inf)
        for level in range(DEPTH):
            for at in range(2**level - 1, 2 ** (level + 1) - 1):
                own = np.flatnonzero(node == at)
                best = (1e-6, 0, 0, None)
                for f in range(width if len(own) >= 2 * LEAST else 0):
                    b, k = binned[own, f], len(cuts[f]) + 1
                    g, h, c = np.bincount(b, grad[own], k).cumsum(), np.bincount(b, hess[own], k).cumsum(), np.bincount(b, minlength=k).cumsum()
                    gl, hl, gr, hr = g[:-1], h[:-1], g[-1] - g[:-1], h[-1] - h[:-1]
                    wl, wr = np.clip(gl / (hl + RIDGE), low[at], high[at]), np.clip(gr / (hr + RIDGE), low[at], high[at])
                    gain = gl**2 / (hl + RIDGE) + gr**2 / (hr + RIDGE) - g[-1]**2 / (h[-1] + RIDGE)
                    gain[(c[:-1] < LEAST) | (c[-1] - c[:-1] < LEAST) | (direction[f] * (wr - wl) < 0)] = 0
                    if len(gain) and gain.max() > best[0]:
                        i = int(gain.argmax())
                        best = (float(gain[i]), f, i, (wl[i] + wr[i]) / 2)
                left, right = 2 * at + 1, 2 * at + 2
                low[[left, right]], high[[left, right]] = low[at], high[at]
                if best[3] is not None:
                    feature[t, at], cut[t, at] = best[1], cuts[best[1]][best[2]]
                    if direction[best[1]]:
                        (high if direction[best[1]] > 0 else low)[left] = best[3]
                        (low if direction[best[1]] > 0 else high)[right] = best[3]
                node[own] = left + (binned[own, feature[t, at]] > best[2] if best[3] is not None else 0)
        for leaf in range(2**DEPTH):
            own = node == inner + leaf
            w = grad[own].sum() / (hess[own].sum() + RIDGE)
            value[t, leaf] = RATE * np.clip(w, low[inner + leaf], high[inner + leaf])
            total[own] += value[t, leaf]
    return Trees(feature, cut, value, start)


def _featured(batches):
    for batch in batches:
        for i, j, data, offsets in scan.text_batches(batch.column(0)):
            _, x = statistics(data, offsets)
            yield pa.RecordBatch.from_arrays([batch.column(1).slice(i, j - i), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))], names=["y", "x"])


def fit_on(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Trees:
    """Trees from at most `rows` labelled documents: those with the least hash of their doc_id. Rows without a doc_id or label take no part."""
    small_batches(docs.sparkSession)
    sample = labels.where("doc_id is not null and quality is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).dropDuplicates(["doc_id"])
    sample = sample.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    got = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select(F.col("text").cast("string").alias("text"), "quality")
    table = got.mapInArrow(_featured, "y int, x array<double>").toArrow()
    if not table.num_rows:
        return fit(np.zeros((0, len(FEATURES))), np.zeros(0), list(FEATURES.values()))
    x = np.asarray(table["x"].combine_chunks().flatten()).reshape(-1, len(FEATURES))
    y = np.asarray(table["y"].combine_chunks()).astype(float)
    order = np.lexsort((*x.T, y))  # the same trees whatever the order of rows
    return fit(x[order], y[order], list(FEATURES.values()))


def judge(docs: DataFrame, trees: Trees, cut: float = CUT) -> DataFrame:
    """`docs` (doc_id, text; other columns are not read) with base counts, base_failed, score and kept, one row for each row.

    A null text has no words; texts with fewer than ten words, or with more than a fifth of their words in repeated 5-word windows, fail the base
    rules and are not kept. Copies of rows get equal results; an empty table gives an empty one.
    """
    names = ["doc_id", *BASE, "base_failed", "score", "kept"]

    def scored(batches):
        for batch in batches:
            for i, j, data, offsets in scan.text_batches(batch.column(1)):
                base, x = statistics(data, offsets)
                failed = (base[:, 0] < 10) | (100 * base[:, 4] > 20 * base[:, 0])
                score = trees.score(x)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *(pa.array(base[:, c]) for c in range(5)), pa.array(failed), pa.array(score), pa.array(~failed & (score >= cut))], names=names)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(scored, f"doc_id long, {', '.join(f'{c} long' for c in BASE)}, base_failed boolean, score double, kept boolean")


def kept_rows(docs: DataFrame, trees: Trees, cut: float = CUT) -> DataFrame:
    """The rows of `docs` that pass, with all their columns, whatever their names; the text is read once and nothing is shuffled."""
    at = docs.columns.index("text")

    def passing(batches):
        for batch in batches:
            flags = []
            for _, _, data, offsets in scan.text_batches(batch.column(at)):
                base, x = statistics(data, offsets)
                flags.append((base[:, 0] >= 10) & (100 * base[:, 4] <= 20 * base[:, 0]) & (trees.score(x) >= cut))
            yield batch.filter(pa.array(np.concatenate(flags) if flags else np.zeros(0, bool)))
    numbered = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    return numbered.mapInArrow(passing, numbered.schema).toDF(*docs.columns)
