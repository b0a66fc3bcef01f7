"""Language-model scores by a hashed maximum-entropy model with class-factored softmax.

P(word | history) = P(class | history) P(word | class). The class factor is a softmax over features of the two tokens before: the token before, hashed into buckets (n-gram);
the class of the token before that (skip); both together, hashed into a table of weights. The word factor has one feature a word, whose maximum-entropy fit with additive smoothing is
(c + 0.1) / (that sum over the class), so that without any feature of the history the model is the additively smoothed unigram model.
Classes: the end, the most frequent words on their own, and all other words by a hash of their last two bytes; words that training never saw count as one word of the last class.

All training tokens are counted. The features see a history only as (bucket, class), so the counts of (bucket, class, class of the word) are all that the gradient needs:
they are one table of fixed size, cut by bucket; each step sends the weights out, and every slice of the table returns the gradient of its part.
Texts become blocks of token numbers in the shared folder. Word counts are looked up by ranges of fingerprints: a block sends each range its words and gets their counts back, as arrays.

Words are told apart by 64-bit fingerprints (XXH3). Rows: a null text is an empty one, which holds one end; rows without doc_id are held out; repeated rows are scored (and learnt) each on its own;
without training rows every score is that of the one unknown word, 0; an empty table gives an empty result. Other columns are not read, whatever their names.
"""
from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wiresift.llm import scan
from wiresift.llm.common import release, small_batches, stored

U = np.uint64
BUCKETS, CLASSES, ALONE = 1024, 64, 31       # of the token before; of words; most frequent words with a class each
SLICES, WEIGHTS = 16, 1 << 16                # parts of the count table; hashed weights of each
STEPS, PRIOR, ACTIVE = 15, 2.0, 3            # gradient steps; Gaussian prior; features of the history at a token
SMOOTH = 0.1
BLOCK = 3 << 20                              # bytes of text in a block; a longer text stands alone
PIECE = 1 << 18                              # words in a row of the vocabulary
UNKNOWN = CLASSES - 1
END = U(xxhash.xxh3_64_intdigest(b" "))      # no word holds white space


def _blocks(field: pa.DataType):
    def run(batches):
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            ids = batch.column("doc_id")
            for i, j, data, offsets in scan.text_batches(batch.column("text"), BLOCK):
                own = ids.slice(i, j - i).to_pylist()
                train = np.array([x is not None and zlib.crc32(str(x).encode()) % 10 != 0 for x in own])
                low = scan.lower(data)
                words = scan.Words(low, offsets)
                coded = scan.cut_out(low, words.start, words.end).dictionary_encode()
                names = coded.dictionary.cast(pa.large_binary()).to_pylist()
                prints = np.fromiter(map(xxhash.xxh3_64_intdigest, names), U, len(names))
                shapes = np.fromiter((zlib.crc32(x[-2:]) & 255 for x in names), np.uint8, len(names))
                distinct, place = np.unique(np.r_[prints, END], return_inverse=True)
                shape = np.zeros(len(distinct), np.uint8)
                shape[place[:-1]] = shapes
                sizes = np.diff(words.at) + 1  # with the end
                tokens = np.full(sizes.sum(), place[-1], np.int32)
                tokens[np.arange(len(words.start)) + words.row()] = place[coded.indices.to_numpy()]
                n = np.bincount(tokens[np.repeat(train, sizes)], minlength=len(distinct)).astype(np.int32)
                block += 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block]), pa.array([own], pa.list_(field)), pa.array([train.tolist()], pa.list_(pa.bool_())), pa.array([sizes.astype(np.int32).tobytes()]), pa.array([tokens.tobytes()]),
                     pa.array([distinct.tobytes()]), pa.array([shape.tobytes()]), pa.array([n.tobytes()]), pa.array([len(distinct)], pa.int64())],
                    ["block", "ids", "train", "sizes", "tokens", "prints", "shapes", "n", "distinct"])
    return run


def blocks_of(docs: DataFrame) -> DataFrame:
    """Blocks of whole texts: the tokens of each as places in the block's sorted fingerprints, with their training counts."""
    docs = docs.select("doc_id", "text")
    small_batches(docs.sparkSession)
    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("ids", T.ArrayType(docs.schema["doc_id"].dataType)), T.StructField("train", T.ArrayType(T.BooleanType())),
                           *[T.StructField(c, T.BinaryType()) for c in ("sizes", "tokens", "prints", "shapes", "n")], T.StructField("distinct", T.LongType())])
    field = pa.int64() if docs.schema["doc_id"].dataType == T.LongType() else pa.int32() if docs.schema["doc_id"].dataType == T.IntegerType() else pa.string()
    return stored(docs.mapInArrow(_blocks(field), schema), "token-blocks")


def _cut(prints: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(ranges, bounds): the leading `bits` of sorted fingerprints, and where each range begins, with the end."""
    r = (prints >> U(64 - bits)).astype(np.int64)
    heads = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
    return r[heads], np.r_[heads, len(r)]


def _parts(bits: int, counted: bool):
    """A row for each block and range: the fingerprints, with their training counts or just as a question."""
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                prints, n, shapes = np.frombuffer(row["prints"], U), np.frombuffer(row["n"], np.int32), np.frombuffer(row["shapes"], np.uint8)
                if counted:
                    seen = n > 0
                    prints, n, shapes = prints[seen], n[seen], shapes[seen]
                    if not len(prints):
                        continue
                r, at = _cut(prints, bits)
                cut = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())
                more = [cut(n.astype(np.int64)), cut(shapes)] if counted else [pa.nulls(len(r), pa.binary()), pa.nulls(len(r), pa.binary())]
                yield pa.RecordBatch.from_arrays([pa.array(r), pa.array(np.full(len(r), row["block"])), cut(prints), *more], ["range", "block", "prints", "n", "shapes"])
    return run


PARTS = "range long, block long, prints binary, n binary, shapes binary"


def _summed(prints: list, n: list, shapes: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    prints, n, shapes = np.concatenate(prints), np.concatenate(n), np.concatenate(shapes)
    order, heads = scan.grouped(prints)
    return prints[order[heads]], np.add.reduceat(n[order], heads), shapes[order[heads]]


def _merged(batches):
    """Parts in order of range -> rows of the vocabulary: sorted fingerprints with their counts, a bounded number a row."""
    now, held, size = None, [], 0

    def out():
        prints, n, shapes = _summed(*zip(*held, strict=True))
        for s in range(0, len(prints), PIECE):
            e = s + PIECE
            yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([s - len(prints)]), *[pa.array([x[s:e].tobytes()], pa.binary()) for x in (prints, n, shapes)]], ["range", "block", "prints", "n", "shapes"])
    for batch in batches:
        for row in batch.to_pylist():
            if row["range"] != now:
                if held:
                    yield from out()
                now, held, size = row["range"], [], 0
            held.append((np.frombuffer(row["prints"], U), np.frombuffer(row["n"], np.int64), np.frombuffer(row["shapes"], np.uint8)))
            size += len(held[-1][0])
            if size > 16 * PIECE and size > 2 * len(held[0][0]):  # the sum so far stands first
                held = [_summed(*zip(*held, strict=True))]
                size = len(held[0][0])
    if held:
        yield from out()


def vocabulary_of(blocks: DataFrame) -> tuple[DataFrame, int]:
    """Counts of all training tokens, as sorted arrays by range of fingerprints (negative `block`s keep their order), and the bits that name a range."""
    words = blocks.agg(F.sum("distinct")).first()[0] or 0
    bits = min(14, max(5, (words >> 21).bit_length()))
    parts = blocks.select("block", "prints", "n", "shapes").mapInArrow(_parts(bits, True), PARTS)
    return stored(parts.repartition(1 << bits, "range").sortWithinPartitions("range", "block").mapInArrow(_merged, PARTS), "vocabulary"), bits


def _answers(batches):
    """Rows of one range, its vocabulary first: the counts of each block's words there."""
    now, held, known = None, [], None
    for batch in batches:
        blocks, ranges, found = [], [], []
        for row in batch.to_pylist():
            if row["range"] != now:
                now, held, known = row["range"], [], None
            prints = np.frombuffer(row["prints"], U)
            if row["block"] < 0:
                held.append((prints, np.frombuffer(row["n"], np.int64)))
                continue
            if known is None:
                known = (np.concatenate([x for x, _ in held]), np.concatenate([n for _, n in held])) if held else (np.zeros(1, U), np.zeros(1, np.int64))
                held = []
            k = np.minimum(np.searchsorted(known[0], prints), len(known[0]) - 1)
            blocks.append(row["block"])
            ranges.append(now)
            found.append(np.where(known[0][k] == prints, known[1][k], 0).tobytes())
        if blocks:
            yield pa.RecordBatch.from_arrays([pa.array(blocks), pa.array(ranges), pa.array(found, pa.binary())], ["block", "range", "counts"])


def _classes(prints: np.ndarray, shapes: np.ndarray, alone: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The class of each word: 0 the end, then the frequent words `alone` (sorted fingerprints; `place` their classes), then by shape."""
    out = (1 + ALONE + shapes % (CLASSES - 1 - ALONE)).astype(np.int64)
    if len(alone):
        k = np.minimum(np.searchsorted(alone, prints), len(alone) - 1)
        out = np.where(alone[k] == prints, place[k], out)
    out[prints == END] = 0
    return out


def _bucket(prints: np.ndarray) -> np.ndarray:
    return ((prints >> U(20)) % U(BUCKETS)).astype(np.int64)


def _history(tokens: np.ndarray, sizes: np.ndarray, bucket: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """(bucket of the token before) * CLASSES + (class of the one before that); an end stands before every text."""
    heads = np.r_[0, np.cumsum(sizes)[:-1]]
    b, k = bucket[tokens], classes[tokens]
    b, k = np.r_[_bucket(np.array([END])), b[:-1]], np.r_[0, 0, k[:-2]][:len(tokens)]
    k[heads] = 0  # the token before a text's first is the end of the one before it, two before it a word
    return b * CLASSES + k


def _histories(alone, place):
    """Training counts of (history, class of the word), summed over a task in one array of fixed size, by slice."""
    def run(batches):
        total, codes, size = np.zeros(BUCKETS * CLASSES * CLASSES, np.int64), [], 0
        for batch in batches:
            for row in batch.to_pylist():
                prints, tokens, sizes = np.frombuffer(row["prints"], U), np.frombuffer(row["tokens"], np.int32), np.frombuffer(row["sizes"], np.int32)
                classes = _classes(prints, np.frombuffer(row["shapes"], np.uint8), alone, place)
                learnt = np.repeat(np.array(row["train"], bool), sizes)
                codes.append((_history(tokens, sizes, _bucket(prints), classes) * CLASSES + classes[tokens])[learnt].astype(np.int32))
                size += len(codes[-1])
                if size > 1 << 21:
                    total += np.bincount(np.concatenate(codes), minlength=len(total))
                    codes, size = [], 0
        if codes:
            total += np.bincount(np.concatenate(codes), minlength=len(total))
        for s, own in enumerate(np.split(total, SLICES)):
            at = np.flatnonzero(own)
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([at.astype(np.int32).tobytes()], pa.binary()), pa.array([own[at].tobytes()], pa.binary())], ["slice", "at", "n"])
    return run


def _tabled(batches):
    """The counts of a slice as one array."""
    now, total = None, None
    for batch in batches:
        for row in batch.to_pylist():
            if row["slice"] != now:
                if now is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["slice", "n"])
                now, total = row["slice"], np.zeros(BUCKETS * CLASSES * CLASSES // SLICES, np.int64)
            total[np.frombuffer(row["at"], np.int32)] += np.frombuffer(row["n"], np.int64)
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["slice", "n"])


def hashed(history: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Which weight of its slice belongs to (history, class) together."""
    x = scan.mix((history * CLASSES + k).astype(U))
    return (x >> U(40)).astype(np.int64) % WEIGHTS


class Model:
    """Weights: `bias` a class, `before` (bucket, class), `skip` (class, class), `both` (slice, hashed); `mass` of each class, `norm` of each history."""

    def __init__(self, alone, place, mass):
        self.alone, self.place, self.mass = alone, place, mass
        self.bias = np.where(mass > 0, np.log(np.maximum(mass, 1e-300)), -200.0)
        self.before, self.skip, self.both = np.zeros((BUCKETS, CLASSES)), np.zeros((CLASSES, CLASSES)), np.zeros((SLICES, WEIGHTS))
        self.norm = None

    def logits(self, s: int) -> tuple[np.ndarray, np.ndarray]:
        """(logits, hashed places) of all histories of a slice, as (buckets, class before, class)."""
        rows = BUCKETS // SLICES
        history = np.arange(rows * CLASSES)
        at = hashed(history[:, None] + s * rows * CLASSES, np.arange(CLASSES)).reshape(rows, CLASSES, CLASSES)
        return self.bias + self.before[s * rows:(s + 1) * rows, None, :] + self.skip[None] + self.both[s][at], at

    def expected(self, s: int, n: np.ndarray):
        """What the slice's counts show and what the model expects, for each kind of weight, and the log-likelihood."""
        n = n.reshape(-1, CLASSES, CLASSES).astype(np.float64)
        x, at = self.logits(s)
        x -= x.max(axis=2, keepdims=True)
        x -= np.log(np.exp(x).sum(axis=2, keepdims=True))
        e = np.exp(x) * n.sum(axis=2, keepdims=True)
        by_hash = lambda v: np.bincount(at.ravel(), v.ravel(), WEIGHTS)
        return s, (n.sum(axis=1), e.sum(axis=1)), (n.sum(axis=0), e.sum(axis=0)), (by_hash(n), by_hash(e)), float((n * x).sum())

    @staticmethod
    def step(weights, seen, expected):
        """The gradient of the penalised likelihood over a bound of its curvature."""
        return weights + (seen - expected - PRIOR * weights) / (ACTIVE * np.maximum(seen, expected) + PRIOR)

    def close(self):
        self.norm = np.concatenate([np.logaddexp.reduce(self.logits(s)[0], axis=2).ravel() for s in range(SLICES)])
        return self

    def log_class(self, history: np.ndarray, k: np.ndarray) -> np.ndarray:
        """log P(class | history)"""
        b, k2 = np.divmod(history, CLASSES)
        return self.bias[k] + self.before[b, k] + self.skip[k2, k] + self.both[b // (BUCKETS // SLICES), hashed(history, k)] - self.norm[history]


def _frequent(batches):
    for batch in batches:
        for row in batch.to_pylist():
            prints, n = np.frombuffer(row["prints"], U), np.frombuffer(row["n"], np.int64)
            prints, n = prints[prints != END], n[prints != END]
            top = np.lexsort((prints, -n))[:ALONE]
            yield pa.RecordBatch.from_arrays([pa.array(prints[top].view(np.int64)), pa.array(n[top])], ["print", "n"])


def _mass(alone, place):
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                n = np.frombuffer(row["n"], np.int64)
                k = _classes(np.frombuffer(row["prints"], U), np.frombuffer(row["shapes"], np.uint8), alone, place)
                words = np.bincount(k, minlength=CLASSES)
                tokens = np.zeros(CLASSES, np.int64)
                np.add.at(tokens, k, n)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(CLASSES)), pa.array(words), pa.array(tokens)], ["class", "words", "tokens"])
    return run


def fit(blocks: DataFrame, vocabulary: DataFrame) -> tuple[Model, int, int, list[float]]:
    """The model, the training tokens and distinct training tokens, and the log-likelihood of the classes at each step."""
    top = vocabulary.select("prints", "n").mapInArrow(_frequent, "print long, n long").orderBy(F.desc("n"), "print").limit(ALONE).collect()
    alone = np.array([r.print for r in top], np.int64).view(U)
    place = 1 + np.argsort(alone)
    alone = np.sort(alone)
    stats = vocabulary.select("prints", "n", "shapes").mapInArrow(_mass(alone, place), "class long, words long, tokens long").groupBy("class").agg(F.sum("words").alias("words"), F.sum("tokens").alias("tokens")).collect()
    mass = np.zeros(CLASSES)
    mass[UNKNOWN] = SMOOTH
    for r in stats:
        mass[r["class"]] += r.tokens + SMOOTH * r.words
    model = Model(alone, place, mass)
    counts = blocks.select("sizes", "tokens", "prints", "shapes", "train").mapInArrow(_histories(alone, place), "slice int, at binary, n binary")
    table = stored(counts.repartition(SLICES, "slice").sortWithinPartitions("slice").mapInArrow(_tabled, "slice int, n binary"), "histories")
    sc = blocks.sparkSession.sparkContext
    rows, trace = table.rdd, []
    for _ in range(STEPS):
        sent = sc.broadcast(model)
        parts = rows.map(lambda r, sent=sent: sent.value.expected(r.slice, np.frombuffer(r.n, np.int64))).collect()
        sent.unpersist()
        skip = [np.zeros((CLASSES, CLASSES)), np.zeros((CLASSES, CLASSES))]
        per = BUCKETS // SLICES
        for s, before, own, both, _ in sorted(parts, key=lambda p: p[0]):
            model.before[s * per:(s + 1) * per] = model.step(model.before[s * per:(s + 1) * per], *before)
            model.both[s] = model.step(model.both[s], *both)
            skip = [skip[0] + own[0], skip[1] + own[1]]
        model.skip = model.step(model.skip, *skip)
        trace.append(sum(p[-1] for p in sorted(parts, key=lambda p: p[0])))
    return model.close(), sum(r.tokens for r in stats), sum(r.words for r in stats), trace


def _slim(alone, place):
    """Blocks without fingerprints: the class and bucket of each word stand for it."""
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                prints = np.frombuffer(row["prints"], U)
                k = _classes(prints, np.frombuffer(row["shapes"], np.uint8), alone, place)
                yield pa.RecordBatch.from_arrays([pa.array([row["block"]]), pa.array([1 << 40]), pa.array([k.astype(np.uint8).tobytes()]), pa.array([_bucket(prints).astype(np.uint16).tobytes()]), pa.array([row["sizes"]], pa.binary()), pa.array([row["tokens"]], pa.binary())],
                                                 ["block", "range", "counts", "buckets", "sizes", "tokens"])
    return run


def _scored(sent, tokens_in_training: int, distinct: int):
    total = np.log10(tokens_in_training + SMOOTH * (distinct + 1))

    def run(batches):
        now, held = None, []
        for batch in batches:
            for row in batch.to_pylist():
                if row["block"] != now:
                    now, held = row["block"], []
                if row["tokens"] is None:
                    held.append(np.frombuffer(row["counts"], np.int64))
                    continue
                model, c = sent.value, np.concatenate(held)
                sizes, tokens = np.frombuffer(row["sizes"], np.int32), np.frombuffer(row["tokens"], np.int32)
                classes, buckets = np.frombuffer(row["counts"], np.uint8).astype(np.int64), np.frombuffer(row["buckets"], np.uint16).astype(np.int64)
                history = _history(tokens, sizes, buckets, classes)
                k = np.where(c > 0, classes, UNKNOWN)
                log_c = np.log10(c + SMOOTH)
                inside = log_c - np.log10(model.mass[k])
                scores = model.log_class(history, k[tokens]) / np.log(10) + inside[tokens]
                heads = np.r_[0, np.cumsum(sizes)[:-1]]
                by_text = lambda x: np.add.reduceat(x, heads)
                yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([by_text((c > 0)[tokens].astype(np.int64)).tolist()]), pa.array([by_text((log_c - total)[tokens]).tolist()]), pa.array([by_text(scores).tolist()])], ["block", "n_known", "base_score", "score"])
    return run


def score(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of `docs` (doc_id, text); scores are log10 probabilities of whole texts."""
    spark = docs.sparkSession
    blocks = blocks_of(docs)
    vocabulary, bits = vocabulary_of(blocks)
    release(spark)
    model, n, distinct, _ = fit(blocks, vocabulary)
    release(spark)
    asked = blocks.select("block", "prints", "n", "shapes").mapInArrow(_parts(bits, False), PARTS).union(vocabulary)
    answers = stored(asked.repartition(1 << bits, "range").sortWithinPartitions("range", "block").mapInArrow(_answers, "block long, range long, counts binary"), "answers")
    release(spark)
    slim = blocks.select("block", "prints", "shapes", "sizes", "tokens").mapInArrow(_slim(model.alone, model.place), "block long, range long, counts binary, buckets binary, sizes binary, tokens binary")
    none = F.lit(None).cast("binary")
    both = answers.withColumns({"buckets": none, "sizes": none, "tokens": none}).union(slim)
    scored = both.repartition("block").sortWithinPartitions("block", "range").mapInArrow(_scored(spark.sparkContext.broadcast(model), n, distinct), "block long, n_known array<long>, base_score array<double>, score array<double>")
    sized = blocks.select("block", "ids", "train", "sizes")
    each = scored.join(sized.mapInArrow(_sizes, T.StructType([sized.schema["block"], sized.schema["ids"], sized.schema["train"], T.StructField("n_tokens", T.ArrayType(T.LongType()))])), "block")
    rows = each.select(F.explode(F.arrays_zip("ids", "train", "n_tokens", "n_known", "base_score", "score")).alias("v"))
    return rows.select(F.col("v.ids").alias("doc_id"), (~F.col("v.train")).alias("held_out"), "v.n_tokens", "v.n_known", F.lit(n).cast("long").alias("train_tokens"), "v.base_score", "v.score")


def _sizes(batches):
    for batch in batches:
        sizes = [np.frombuffer(x, np.int32).astype(np.int64).tolist() for x in batch.column("sizes").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("block"), batch.column("ids"), batch.column("train"), pa.array(sizes, pa.list_(pa.int64()))], ["block", "ids", "train", "n_tokens"])
