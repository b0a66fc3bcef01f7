"""The corpus pipeline, stage by stage, against plain Python versions."""
import sys
from pathlib import Path

sys.path[:0] = [str(Path(__file__).parent), str(Path(__file__).parents[2])]
import brute  # noqa: E402
import corpus_pipeline  # noqa: E402

SMALL = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_rules", "near_dedup", "substring_dedup", "packing"]
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        now = corpus_pipeline.stored(stage(spark, docs, SMALL), name)
        out[name] = (docs, now)
        if name != "packing":
            assert now.columns == docs.columns
        docs = now
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    before, after = ({r.doc_id: r.text for r in d.collect()} for d in out["quality_rules"])
    for i, text in before.items():
        failed = brute.base_counts(text)[-1]
        if failed:
            assert i not in after
        elif labels.get(i) == 1:
            assert i in after
    assert sum(labels.get(i) == 0 for i in after) <= 0.2 * sum(v == 0 for v in labels.values())
    before, after = ({r.doc_id: r.text for r in d.collect()} for d in out["near_dedup"])
    assert set(after) == {i for i, (_, c) in brute.near(list(before.items())).items() if i == c}
    before, after = ({r.doc_id: r for r in d.collect()} for d in out["substring_dedup"])
    want = brute.repeats([(i, r.text) for i, r in before.items()])
    assert set(before) == set(after)
    for i, r in after.items():
        if want[i][1]:
            assert len(brute.words(r.text)) == want[i][0] - want[i][1] and r.n_chars == len(r.text)
        else:
            assert r == before[i]
    packed = out["packing"][1].collect()
    assert {r.doc_id for r in packed} == set(after)
    assert sum(r.length for r in packed) == sum({r.doc_id: r.doc_tokens for r in packed}.values())


def test_near_dedup_judges_rows_that_share_a_doc_id(spark):
    """A clean text stays though another row of its doc_id is a near copy; whole repeats, with a doc_id or without, leave one row."""
    def text(k, changed=None):
        return " ".join("changed" if i == changed else f"w{k}x{i}" for i in range(200))
    rows = [(3, text(0)), (5, text(1)), (5, text(0, 100)), (7, text(2)), (7, text(2)), (7, text(2)), (None, text(3)), (None, text(3)), (None, text(1, 50)), (None, None), (None, None), (9, ""), (9, None), (9, None), (10, text(4))]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = dict(corpus_pipeline.STAGES)["near_dedup"](spark, docs, SMALL)
    assert got.columns == docs.columns
    want = [(3, text(0)), (5, text(1)), (7, text(2)), (None, text(3)), (None, None), (9, ""), (9, None), (10, text(4))]
    key = lambda x: (x[0] or 0, x[1] or "", x[1] is None)
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=key) == sorted(want, key=key)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SMALL)
        assert docs.count() == 0


def test_other_columns_of_any_name_and_type(spark):
    """Columns named like the operators' own, with dots, quotes and maps, pass through every filtering stage, also where doc_ids repeat."""
    from pyspark.sql import functions as F
    names = ["n_words", "n_removed", "removed", "kept_text", "kept", "entries", "tag", "word", "row", "a.b", "a b", "row_tag", "row_id", "__tag", "__n", "__id", "other_0", "N_REMOVED"]
    odd = spark.read.parquet(f"{SMALL}/documents.parquet").withColumns({c: F.lit(i) for i, c in enumerate(names[:-1])})
    odd = odd.withColumn("a map", F.create_map(F.lit("k"), F.col("doc_id"))).withColumn("nested", F.struct(F.lit(1).alias("x.y"), F.col("doc_id")))
    twice = odd.union(odd.where("doc_id < 5"))
    plain = spark.read.parquet(f"{SMALL}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:3]:
        want = sorted(tuple(r) for r in stage(spark, plain, SMALL).collect())
        for docs in (odd, twice):
            got = stage(spark, docs, SMALL)
            assert got.columns == odd.columns and got.schema["a map"].dataType == odd.schema["a map"].dataType
            rows = got.collect()
            assert all(r["a map"] == {"k": r.doc_id} and r.nested[1] == r.doc_id and r["a.b"] == 9 for r in rows)
            if docs is odd or name == "near_dedup":
                assert sorted(tuple(r)[:5] for r in rows) == want
    assert corpus_pipeline.packed(spark, odd, SMALL).count() > 0
