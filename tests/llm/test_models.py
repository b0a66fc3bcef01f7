"""Clustering, language-model scores and spelling variants against plain Python versions, on the smallest tables and on odd rows."""
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wiresift.llm import lloyd, maxent, queries, spelling
from wiresift.llm.common import read

SMALL = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string"
LOWER = {i: i + 32 for i in range(65, 91)}
CLASHES = ("word", "n", "key", "size", "block", "range", "slice", "chunk", "shard", "cluster", "vector", "id", "a.b", "score")
NULLS_LAST = lambda r: tuple((x is None, x) for x in r)


def with_clashes(df):
    return df.withColumns({c: F.lit(c) for c in CLASHES} | {"a map": F.create_map(F.lit("k"), F.lit(1))})


def odd_texts():
    r = random.Random(3)
    many = " ".join(r.choice(["colour", "color", "colours", "Kolour", "colou", "Ünïcode", "uncoded", "unicode", "aaaaaaa", "aaaaaa", "aaaaaaaa", "ÀÀÀÀÀÀ×÷", "abcdef", "abcdefg", "bcdefg"]) for _ in range(4000))
    return [(1, None), (2, ""), (3, " \t\n"), (4, many), (4, many), (None, many), (None, None), (5, "x" * 3000 + " " + "x" * 2999), (6, ("y" * 500 + "z ") * 7 + ("y" * 500 + "w ") * 50), (7, "short words only"), (-8, "naïveté " * 9 + "\x00null"), (2**40, "ſtraße façade " * 6)]


# ---------------------------------------------------------------- 11


def plain_lloyd(rows, dims=64, k=8, rounds=10):
    kept = [(i, [math.floor(Fraction(x) * 1024) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    mark = lambda i: hashlib.sha256(f"3:{'' if i is None else i}".encode()).hexdigest()
    centroids = [q for _, q in sorted(kept, key=lambda r: (mark(r[0]), r[1]))[:k]]

    def nearest():
        gaps = [[sum((a - b) ** 2 for a, b in zip(q, c)) for c in centroids] for _, q in kept]
        return [min((d, j) for j, d in enumerate(g)) for g in gaps]
    for _ in range(rounds):
        at = nearest()
        for j in range(len(centroids)):
            own = [q for (_, q), (_, label) in zip(kept, at) if label == j]
            if own:
                centroids[j] = [sum(column) // len(own) for column in zip(*own)]
    at, total = nearest(), Counter()
    for d, j in at:
        total[j] += d
    long = lambda x: x if x < 2**63 else None
    return sorted(((i, j, long(d), long(total[j]), long(sum(total.values())), hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest()) for (i, _), (d, j) in zip(kept, at)), key=NULLS_LAST)


def test_op11(spark):
    got = sorted(map(tuple, queries.QUERIES["op11_dimension_sharded_lloyd"](spark, SMALL).collect()))
    assert got == plain_lloyd([(r.vec_id, r.embedding) for r in read(spark, SMALL, "embeddings").collect()]) and len(got) == 500


def test_op11_odd(spark):
    """Ids that are null or repeat, equal vectors, numbers beyond 64 bits, vectors that take no part, fewer vectors than clusters, clashing names, no rows."""
    r = random.Random(1)
    rows = [(i if i % 7 else None, [r.choice([1e30, -1e300, 0.5, -0.25, 3.0, 1e17, -1e-9]) for _ in range(64)]) for i in range(30)]
    rows += [(5, [1.0] * 64), (5, [1.0] * 64), (6, None), (7, [1.0] * 63), (8, [float("nan")] * 64), (9, [None] * 64), (10, [0.0] * 64), (11, [float("-inf")] + [0.0] * 63)]
    df = with_clashes(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3))
    assert sorted(map(tuple, lloyd.cluster(df).collect()), key=NULLS_LAST) == plain_lloyd(rows)
    two = [(1, [1.0] * 64), (2, [2.0] * 64)]
    assert sorted(map(tuple, lloyd.cluster(spark.createDataFrame(two, "vec_id long, embedding array<float>")).collect())) == plain_lloyd(two)
    assert lloyd.cluster(df.limit(0)).collect() == []


def test_lloyd_blocks():
    big = np.array([[2**70, -2**70], [3, -1]], object)
    assert (lloyd.unpack(lloyd.pack(big), 2) == big).all()
    x, c = np.array([[2**40, 1], [0, 0]]), np.array([[0, 0], [2**40, 2]])
    assert lloyd.partial(x, c).tolist() == [[2**80 + 1, 1], [0, 2**80 + 4]]
    assert lloyd.moved(np.array([[-3, 5, 2], [0, 0, 0]], object), np.array([[9, 9], [7, 8]])).tolist() == [[-2, 2], [7, 8]]


# ---------------------------------------------------------------- 12


def held_out(i):
    return i is None or zlib.crc32(str(i).encode()) % 10 == 0


def plain_base(rows):
    tokens = [(i, re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)) + [""]) for i, t in rows]
    c = Counter(w for i, ws in tokens if not held_out(i) for w in ws)
    n, v = sum(c.values()), len(c)
    return [(i, held_out(i), len(ws), sum(1 for w in ws if c[w]), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), 6)) for i, ws in tokens]


def check_base(got, rows):
    own = [(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got]
    for a, b in zip(sorted(own, key=NULLS_LAST), sorted(plain_base(rows), key=NULLS_LAST), strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], rel=1e-9, abs=1e-5)


def test_op12(spark):
    """Counts and base scores are those of a plain version; the model is better on held-out texts than its base."""
    rows = [(r.doc_id, r.text) for r in read(spark, SMALL, "documents").collect()]
    got = queries.QUERIES["op12_maxent_scoring"](spark, SMALL).collect()
    check_base(got, rows)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) + 0.05 * sum(r.n_tokens for r in held)


def test_op12_odd(spark):
    rows = odd_texts()
    df = with_clashes(spark.createDataFrame(rows, COLUMNS).repartition(3))
    got = maxent.score(df).collect()
    check_base(got, rows)
    assert all(math.isfinite(r.score) and r.score <= 1e-9 for r in got)
    assert maxent.score(df.limit(0)).collect() == []
    none = maxent.score(spark.createDataFrame([(None, "never learnt"), (None, None)], COLUMNS)).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in sorted(none, key=lambda r: r.n_tokens)] == [(1, 0, 0, 0.0), (3, 0, 0, 0.0)] and all(abs(r.score) < 1e-9 for r in none)


def test_op12_sums_to_one(spark):
    """Over all words and the unknown one, probabilities after any history add up to 1, and training raises the likelihood at every step."""
    docs = read(spark, SMALL, "documents")
    blocks = maxent.blocks_of(docs)
    vocabulary, _ = maxent.vocabulary_of(blocks)
    model, n, distinct, trace = maxent.fit(blocks, vocabulary)
    assert all(b > a for a, b in zip(trace, trace[1:]))
    mass = np.zeros(maxent.CLASSES)
    mass[maxent.UNKNOWN] = 0.1
    for r in vocabulary.collect():
        c = np.frombuffer(r.n, np.int64)
        np.add.at(mass, maxent._classes(np.frombuffer(r.prints, np.uint64), np.frombuffer(r.shapes, np.uint8), model.alone, model.place), c + 0.1)
    assert mass == pytest.approx(model.mass) and mass.sum() == pytest.approx(n + 0.1 * (distinct + 1))
    for history in (0, 77, 4095, maxent.BUCKETS * maxent.CLASSES - 1):
        k = np.flatnonzero(mass > 0)
        assert np.exp(model.log_class(np.full(len(k), history), k)).sum() == pytest.approx(1)


# ---------------------------------------------------------------- 13


def plain_variants(rows, every=199, least=5):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if every and h % every == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 6:
                counts[run] += 1
    words, near, same = {w: n for w, n in counts.items() if n >= least}, defaultdict(set), defaultdict(set)
    for w in words:
        for p in range(len(w)):
            less = w[:p] + w[p + 1:]
            same[p, less].add(w)
            if less in words:
                near[w].add(less)
                near[less].add(w)
    for group in same.values():
        for w in group:
            near[w] |= group - {w}
    form = {}
    for w, n in words.items():
        if near[w]:
            best = min(near[w], key=lambda x: (-words[x], x))
            if words[best] >= 5 * n:
                form[w] = best
    out = []
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, n, len(near[w]), form.get(w), words.get(form.get(w)), root))
    return sorted(out)


def collected(df):
    return sorted(tuple(r[c] for c in ("word", "n", "n_near", "form", "form_n", "root")) for r in df.collect())


def test_op13(spark):
    want = plain_variants([(r.doc_id, r.text) for r in read(spark, SMALL, "documents").collect()])
    assert collected(queries.QUERIES["op13_spelling_variants"](spark, SMALL)) == want and any(r[3] for r in want)
    counted = spark.createDataFrame([r[:2] for r in want], "word string, n long")
    assert collected(spelling.variants(counted, hot=3)) == want  # every group is cut down to regions of one letter


@pytest.mark.parametrize("every", [199, 3, 0])
def test_op13_odd(spark, every):
    rows = odd_texts()
    df = with_clashes(spark.createDataFrame(rows, COLUMNS).repartition(3))
    assert collected(spelling.variants(spelling.word_counts(df, every=every))) == plain_variants(rows, every)
    assert spelling.variants(spelling.word_counts(df.limit(0))).collect() == []


@pytest.mark.parametrize("hot", [2, 50, 4096])
def test_op13_dense(spark, hot):
    """Words over two letters, nearly all of them: many near words each, many ways to insert a letter into a run of equal ones."""
    r = random.Random(hot)
    words = {"".join(r.choice("ab") for _ in range(r.randrange(6, 10))) for _ in range(500)}
    counts = {w: r.randrange(5, 500) for w in words}
    rows = [(0, " ".join(w for w, n in counts.items() for _ in range(n)))]
    table = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert collected(spelling.variants(table, hot=hot)) == plain_variants(rows, every=0)


def test_bitsets_over_one_word_of_bits():
    words = [f"{a}{b}{c}word" for a in "abcdefgh" for b in "abcdef" for c in "abcde"] + ["aaword", "abcdeword"]
    a, b = spelling.near_in_groups(pa.array(words), np.full(len(words), 7), np.full(len(words), 7), np.array([0]))
    own = {(words[i], words[j]) for i, j in zip(a, b)}
    assert len(own) == len(a) == len({(x, y) for x in words[:240] for y in words[:240] if sum(p != q for p, q in zip(x, y)) == 1})
