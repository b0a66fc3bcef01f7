"""Packing of documents into training sequences by cutting-stock column generation (operator 8).

Documents are tokenised and cut only where they exceed a sequence: full pieces and one remainder each. Piece lengths, rounded up to `UNIT` tokens,
make a histogram of at most `LENGTH / UNIT` classes, which is all that the driver sees. A linear program over packing patterns starts from one
pattern a class; knapsack dynamic programming prices the pattern that the current dual prices most undervalue, until the number of sequences is within
`GAP` of the dual bound (or `TURNS` patterns were priced; only padding depends on either). Multiplicities are rounded down and what is left over is packed first-fit. Pieces are ranked inside their class, and a
table of rank intervals (one row for each class of each pattern) says which sequence holds which rank.
"""
from __future__ import annotations

import os
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wiresift.llm import scan
from wiresift.llm.common import small_batches, stored, with_rank

LENGTH, UNIT, END, GAP, TURNS = 4096, 8, 2, 1e-3, 4000
#: Words, and parts of words, whose ids a worker remembers; it forgets them all when it has so many.
KNOWN, PARTS = 1_000_000, 250_000
#: How the tokenizer splits a normalised word (fixed value of its file), and words whose normal form is left to the tokenizer itself.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
UNSURE = r"[^\u0021-\u007e\u00a1-\u012f\u0131-\u024f]|<\|"


class WordEncoder:
    """Token ids of texts by the words between ASCII white space, each encoded once and then found by its 64-bit fingerprint.

    Right for tokenizers that drop white space and never join tokens across it. Where the tokenizer lower-cases and splits words by `SPLIT`, plain
    Latin words are split here first, so that a part is encoded once for all words that hold it; other words go to the tokenizer whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import json

        import regex
        from tokenizers import Tokenizer, normalizers, pre_tokenizers
        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        kinds = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])]
        first = ((spec["pre_tokenizer"] or {}).get("pretokenizers") or [{}])[0]
        known = kinds == ["NFC", "Replace", "Lowercase"] and first.get("pattern") == {"Regex": SPLIT}
        suffix = spec["model"].get("end_of_word_suffix")
        known = known and bool(suffix)
        self.split, self.unsure = regex.compile(SPLIT + r"|\n").findall if known else None, regex.compile(UNSURE).search
        if known:  # which ids end a part
            vocabulary = self.tokenizer.get_vocab()
            self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
            self.ends[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True
            # parts are normalised and split already: the same model behind white space only
            self.model = Tokenizer.from_file(path)
            self.model.normalizer = normalizers.Sequence([])
            self.model.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.parts = {"\n": b""}
        self.forget()

    def forget(self):
        """Known words: fingerprints in order, and where the ids of each stand in `ids`."""
        self.known, self.start, self.length, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [array("I", x.ids).tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_parts(self, parts: list[str]) -> list[bytes]:
        """Ids of parts, many in one text: the ids that end a part tell them apart."""
        out = []
        for k in range(0, len(parts), 300):
            some = parts[k:k + 300]
            ids = np.array(self.model.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, np.uint32)
            cut = np.flatnonzero(self.ends[ids]) + 1
            if len(cut) != len(some) or cut[-1] != len(ids):
                out += self._encode(some)
                continue
            raw, bounds = ids.tobytes(), [0, *(4 * cut).tolist()]
            out += [raw[i:j] for i, j in zip(bounds, bounds[1:])]
        return out

    def _ids_of(self, words: list[bytes]) -> tuple[np.ndarray, bytes]:
        """(number of ids of each word, all ids in a row)"""
        if self.split is None:
            odd, plain = np.ones(len(words), bool), []
        else:
            text = b"\n".join(words).decode()
            odd = np.zeros(len(words), bool)
            if self.unsure(text.replace("\n", "!")):
                odd = np.fromiter((self.unsure(w.decode()) is not None for w in words), bool, len(words))
                plain = [w for w, x in zip(words, odd) if not x]
            else:
                plain = words
        lengths, out = np.zeros(len(words), np.int64), [b""] * len(words)
        sure = np.flatnonzero(~odd)
        if len(plain):
            found = self.split(b"\n".join(plain).decode().lower() + "\n")
            if len(self.parts) > PARTS:
                self.parts = {"\n": b""}
            new = list(set(found).difference(self.parts))
            self.parts.update(zip(new, self._encode_parts(new)))
            ids = list(map(self.parts.__getitem__, found))
            size = np.fromiter(map(len, ids), np.int64, len(ids))
            total = np.cumsum(size)[size == 0] // 4  # only the line feed between words has no ids
            lengths[sure] = np.diff(np.r_[0, total])
            raw = b"".join(ids)
            if not odd.any():
                return lengths, raw
            bounds = np.r_[0, 4 * total].tolist()
            for k, i, j in zip(sure.tolist(), bounds, bounds[1:]):
                out[k] = raw[i:j]
        for k, ids in zip(np.flatnonzero(odd).tolist(), self._encode([w.decode() for w, x in zip(words, odd) if x])):
            out[k], lengths[k] = ids, len(ids) // 4
        return lengths, b"".join(out)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, bounds of the texts in them) of joined texts."""
        words = scan.Words(data, offsets)
        prints, first, which = np.unique(words.prints(), return_index=True, return_inverse=True)
        at = np.searchsorted(self.known, prints)
        fresh = np.ones(len(prints), bool)
        inside = at < len(self.known)
        fresh[inside] = self.known[at[inside]] != prints[inside]
        if fresh.any():
            if len(self.known) + fresh.sum() > KNOWN:
                self.forget()
                fresh[:] = True
            raw, new = data.tobytes(), first[fresh]
            lengths, ids = self._ids_of([raw[i:j] for i, j in zip(words.start[new].tolist(), words.end[new].tolist())])
            place = np.searchsorted(self.known, prints[fresh])
            self.start = np.insert(self.start, place, len(self.ids) + np.cumsum(lengths) - lengths)
            self.length = np.insert(self.length, place, lengths)
            self.known = np.insert(self.known, place, prints[fresh])
            self.ids = np.r_[self.ids, np.frombuffer(ids, np.uint32)]
            at = np.searchsorted(self.known, prints)
        at = at[which]
        start, n = self.start[at], self.length[at]
        end = np.cumsum(n)
        ids = self.ids[np.repeat(start - (end - n), n) + np.arange(int(n.sum()))]
        return ids, np.r_[0, end][words.at]


_ENCODERS: dict[str, WordEncoder] = {}


def word_encoder(path: str) -> WordEncoder:
    """The encoder of this worker, which goes from task to task with what it knows."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def pieces(docs: DataFrame, tokenizer: str, length: int = LENGTH) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, ids) of (doc_id, text): ids as little-endian unsigned 32-bit numbers, id `END` last."""
    def cut(batches):
        encoder = word_encoder(tokenizer)
        for batch in batches:
            for i, j, data, offsets in scan.text_batches(batch.column(1), 1 << 20):
                tokens, bounds = encoder.encode(data, offsets)
                out = {k: [] for k in ("row", "start", "length", "crc", "total", "ids")}
                for k in range(j - i):
                    ids = np.r_[tokens[bounds[k]:bounds[k + 1]], np.uint32(END)].astype("<u4")
                    for s in range(0, len(ids), length):
                        raw = ids[s:s + length].tobytes()
                        for name, x in zip(out, (i + k, s, len(raw) // 4, zlib.crc32(raw), len(ids), raw)):
                            out[name].append(x)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array(out["row"])), *(pa.array(out[k], pa.int64()) for k in ("start", "length", "crc", "total")), pa.array(out["ids"], pa.binary()),
                ], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"])
    return docs.mapInArrow(cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary")


def knapsack(sizes: np.ndarray, prices: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The dearest multiset of items (sizes ascending) that fits, as (value, count of each)."""
    best, took = np.zeros(room + 1), np.full(room + 1, -1)
    upto = np.searchsorted(sizes, np.arange(room + 1), "right")
    for c in range(1, room + 1):
        best[c] = best[c - 1]
        if upto[c]:
            value = best[c - sizes[:upto[c]]] + prices[:upto[c]]
            i = int(value.argmax())
            if value[i] > best[c] + 1e-12:
                best[c], took[c] = value[i], i
    counts, c = np.zeros(len(sizes), np.int64), room
    while c > 0:
        if took[c] < 0:
            c -= 1
        else:
            counts[took[c]] += 1
            c -= int(sizes[took[c]])
    return float(best[room]), counts


def patterns(sizes: np.ndarray, counts: np.ndarray, room: int, gap: float = GAP) -> list[tuple[np.ndarray, int]]:
    """(count of each class, multiplicity) of patterns that hold exactly `counts` items of `sizes` (ascending)."""
    if not len(sizes):
        return []
    m, total = len(sizes), int(counts.sum())
    share = counts / total
    columns = np.diag((room // sizes).astype(float))
    inverse, x = np.diag(1.0 / (room // sizes)), share / (room // sizes)
    calm, bound, weight = np.zeros(m), 0.0, 0.8
    for _ in range(TURNS):
        prices = inverse.sum(0)
        # price at a point between the best dual found so far and this one: fewer, better columns
        mixed = np.maximum(weight * calm + (1 - weight) * prices, 0)
        value, pattern = knapsack(sizes, mixed, room)
        low = float((share * mixed).sum()) / max(value, 1e-12)  # mixed / value is dual feasible
        if low > bound:
            bound, calm = low, mixed / max(value, 1e-12)
        if x.sum() <= bound * (1 + gap):
            break
        held = np.flatnonzero(pattern)
        if (prices[held] * pattern[held]).sum() <= 1 + 1e-9:
            weight = 0.0 if weight < 0.05 else weight / 2
            if weight == 0.0 and value <= 1 + 1e-9:
                break
            continue
        weight = min(0.8, weight + 0.1)
        move = (inverse[:, held] * pattern[held]).sum(1)
        up = move > 1e-10
        ratio = np.full(m, np.inf)
        ratio[up] = x[up] / move[up]
        out = int(ratio.argmin())
        columns[:, out] = pattern
        step = ratio[out]
        x = np.maximum(x - step * move, 0)
        x[out] = step
        row = inverse[out] / move[out]
        inverse -= np.outer(move, row)
        inverse[out] = row
    left, made = counts.copy(), []
    for p in np.argsort(-x, kind="stable"):
        a = columns[:, p].astype(np.int64)
        used = a > 0
        times = min(int(np.floor(x[p] * total + 1e-6)), int((left[used] // a[used]).min()))
        if times > 0:
            made.append((a, times))
            left = left - a * times
    while left.any():  # fewer than a pattern of each column is left: largest first
        a, rest = np.zeros(m, np.int64), room
        for i in range(m - 1, -1, -1):
            a[i] = min(left[i], rest // sizes[i])
            rest -= int(a[i] * sizes[i])
        used = a > 0
        times = int((left[used] // a[used]).min())
        made.append((a, times))
        left = left - a * times
    return made


def intervals(sizes: np.ndarray, made: list[tuple[np.ndarray, int]]) -> list[tuple[int, int, int, int, int]]:
    """(size class, first rank, end rank, items in a sequence, first sequence)"""
    done, sequence, rows = np.zeros(len(sizes), np.int64), 0, []
    for a, times in made:
        for i in np.flatnonzero(a):
            n = int(a[i]) * times
            rows.append((int(sizes[i]), int(done[i]), int(done[i]) + n, int(a[i]), sequence))
            done[i] += n
        sequence += times
    return rows


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, unit: int = UNIT, seed: int = 8) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_tokens, padded_tokens, ids), one row a piece.

    Every row of `docs` (doc_id, text; other columns are not read) is packed, copies and rows without a doc_id as rows of their own; a null or
    empty text is its end id alone. Sequences are padded to `length`, except where their size is a power of two. An empty table gives no row.
    """
    spark = docs.sparkSession
    small_batches(spark)
    cut = stored(pieces(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), tokenizer, length), "pieces")
    cut = cut.withColumn("size", F.ceil(F.col("length") / unit))
    counted = sorted((r.size, r["count"]) for r in cut.groupBy("size").count().collect())  # at most length / unit rows
    sizes, counts = np.array([x for x, _ in counted], np.int64), np.array([x for _, x in counted], np.int64)
    rows = intervals(sizes, patterns(sizes, counts, length // unit))
    table = spark.createDataFrame(rows, "size long, low long, high long, items long, first long")
    order = [F.xxhash64(F.lit(seed), "doc_id", "start", "ids_crc32"), F.col("doc_id"), F.col("start"), F.col("ids_crc32")]
    ranked = with_rank(cut, F.col("size"), order, order[0])
    hold = (ranked["size"] == table["size"]) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))
    # the table has a row for each class of each pattern, whatever the number of documents
    placed = ranked.join(F.broadcast(table), hold).withColumn("sequence_id", F.col("first") + F.floor((F.col("rank") - F.col("low")) / F.col("items"))).drop(table["size"])
    inside = Window.partitionBy("sequence_id").orderBy(F.col("size").desc(), "rank")
    whole = F.sum("length").over(Window.partitionBy("sequence_id"))
    seated = placed.withColumns({"offset": F.sum("length").over(inside) - F.col("length"), "sequence_tokens": whole})
    power = F.col("sequence_tokens").bitwiseAND(F.col("sequence_tokens") - 1) == 0
    return seated.withColumn("padded_tokens", F.when(power, F.col("sequence_tokens")).otherwise(length)).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_tokens", "padded_tokens", "ids")
