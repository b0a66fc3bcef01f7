"""From raw documents to packed training sequences: quality rules, near-duplicates, repeated passages, packing."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wiresift.llm import neardup, packing, passages, quality
from wiresift.llm.common import quoted, read, stored, unused
from wiresift.llm.queries import word_bpe
from wiresift.plans.ordering import dense_id


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the trees, which are fitted on the labelled ones among them."""
    return quality.kept_rows(docs, quality.fit_on(docs, read(spark, sf_dir, "labels")))


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates stays, the one with the smallest doc_id.

    Where rows share a doc_id, or have none, rows are told apart by doc_id and text: of rows that repeat both one stays (the first by its other columns as JSON), and the others are numbered in
    order of doc_id (rows without one last) and text hash, so that each text is judged on its own and not with all of its doc_id. Other columns may have any name and type.
    """
    if docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or doc_id is null").limit(1).count():
        return _distinct_rows(docs)
    gone = neardup.near_duplicates(docs).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*map(quoted, docs.columns))


def _distinct_rows(docs: DataFrame) -> DataFrame:
    tag, n, none, id_ = (unused(docs.columns, x) for x in ("row_tag", "row_copy", "row_without_id", "row_id"))
    named = F.sha2(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.concat(F.lit("t"), F.col("text")), F.lit(""))), 256)
    rest = [F.col(quoted(c)) for c in docs.columns if c not in ("doc_id", "text")]
    first = Window.partitionBy(tag).orderBy(F.to_json(F.struct(*rest)) if rest else F.lit(0))
    once = stored(docs.withColumn(tag, named).withColumn(n, F.row_number().over(first)).where(F.col(n) == 1).drop(n), "once")
    places = dense_id(once.select(F.col("doc_id").isNull().alias(none), "doc_id", tag), [none, "doc_id", tag], id_).select(tag, id_)
    numbered = stored(once.join(places, tag), "numbered")
    kept = neardup.near_duplicates(numbered.select(F.col(id_).alias("doc_id"), "text")).where("kept").select(F.col("doc_id").alias(id_))
    return numbered.join(kept, id_, "left_semi").select(*map(quoted, docs.columns))


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that an earlier document holds too; a text that lost words is its other words joined by one space.

    Other columns pass through under any name and of any type (they are carried by number); only `n_chars` follows the text.
    """
    rest = {c: f"other_{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")}
    cut = passages.remove_repeats(docs.select("doc_id", "text", *(F.col(quoted(c)).alias(n) for c, n in rest.items())), carry=list(rest.values()), as_is=True)
    now = {c: F.col(n) for c, n in rest.items()} | {"doc_id": F.col("doc_id"), "text": F.col("kept_text")}
    if "n_chars" in rest:
        now["n_chars"] = F.when(F.col("n_removed") > 0, F.length("kept_text").cast("long")).otherwise(now["n_chars"])
    return cut.select(*(now[c].alias(c) for c in docs.columns))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents and their places in training sequences."""
    return packing.pack(docs, word_bpe()).drop("ids")


#: Steps in order; each takes what the one before kept.
STAGES = [
    ("quality_rules", good_documents),
    ("near_dedup", distinct_documents),
    ("substring_dedup", without_repeats),
    ("packing", packed),
]
ORACLE_SQL = None  # learned rules and link components have no SQL form; tests compare with a plain Python version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over `documents`, each written and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
