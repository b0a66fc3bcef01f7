"""Document boundaries of flat, unindexed token files by a separator scan (operator 2).

A flat file is a sequence of little-endian unsigned 16-bit ids; the end-of-document id follows each document and nothing else marks one. Files are
written in bounded shards by Spark's text writer, whose line separator is the two bytes of that id. The scan reads a file in blocks, finds the
separators of a block with one vectorised comparison, and writes a row a separator and a summary a block. Documents that span blocks are stitched
by prefix scans over the summaries: how many separators came before a block, and where the last one stood.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wiresift.llm.common import bundles, shared_path, small_batches, stored

#: Tokens of a block; documents and bytes in a file at most (one longer document is a file of its own); characters encoded in one call, about; the
#: end-of-document id (a control piece that no text is encoded to).
BLOCK, PER_FILE, FILE_BYTES, CHARS, END = 1 << 16, 5000, 32 << 20, 1 << 20, 2


def _calls(texts: list[str]):
    """Consecutive `texts` in lists of about `CHARS` characters."""
    held, n = [], 0
    for text in texts:
        held.append(text)
        n += len(text) + 1
        if n >= CHARS:
            yield held
            held, n = [], 0
    if held:
        yield held


def write_flat(docs: DataFrame, model: str, path: str, per_file: int = PER_FILE, file_bytes: int = FILE_BYTES) -> None:
    """Write the ids of all texts of `docs` (text; other columns are not read) as flat files under `path`; a null text is an empty one.

    A file holds documents up to `per_file` and `file_bytes`, or a single longer one; each task of Spark begins a new file.
    """
    separator = END.to_bytes(2, "little")

    def encoded(batches):
        import sentencepiece
        m = sentencepiece.SentencePieceProcessor(model_file=model)
        if m.vocab_size() > 1 << 16 or not m.is_control(END):
            raise ValueError("16-bit files need a vocabulary of at most 65,536 ids with a control piece as separator")
        for batch in batches:
            for texts in _calls([x or "" for x in batch.column(0).to_pylist()]):
                for ids in m.encode(texts, num_threads=1):
                    yield np.array(ids, "<u2").tobytes()

    def files(batches):
        for file in bundles(encoded(batches), separator, per_file, file_bytes):
            yield pa.RecordBatch.from_arrays([pa.array([file], pa.binary())], names=["ids"])
    flat = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(files, "ids binary")
    # one row is one file, and the line separator ends its last document
    flat.select(F.col("ids").cast("string").alias("value")).write.option("lineSep", separator.decode()).option("maxRecordsPerFile", 1).text(path)


def _blocks(size: int):
    def scan(batches):
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                tokens = np.frombuffer(content.as_buffer(), "<u2")
                for block, low in enumerate(range(0, len(tokens), size)):
                    at = np.flatnonzero(tokens[low:low + size] == END) + low
                    yield pa.RecordBatch.from_arrays([
                        pa.array([path.rpartition("/")[2]]), pa.array([block], pa.int64()), pa.array([min(size, len(tokens) - low)], pa.int64()), pa.array([len(at)], pa.int64()),
                        pa.array([int(at[-1]) if len(at) else None], pa.int64()), pa.array([at], pa.list_(pa.int64())),
                    ], names=["file", "block", "tokens", "separators", "last", "at"])
    return scan


def scan_flat(spark, path: str, block: int = BLOCK) -> DataFrame:
    """(file, document, start, n_tokens): every document of the flat files under `path`; `document` counts from 0 in a file.

    n_tokens leaves the separator out. Tokens after the last separator of a file are a document that was not ended, and are returned as one. Empty
    files and empty folders give no row; two separators in a row enclose an empty document.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    blocks = stored(files.mapInArrow(_blocks(block), "file string, block long, tokens long, separators long, last long, at array<long>"), "blocks")
    # prefix scans over the blocks of a file: one row a block
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.select("file", "block", "at", F.coalesce(F.sum("separators").over(before), F.lit(0)).alias("earlier"), F.coalesce(F.max("last").over(before), F.lit(-1)).alias("carry"))
    inside = F.expr("transform(at, (x, i) -> struct(earlier + i as document, if(i = 0, carry, at[i - 1]) + 1 as start, x as end))")
    ended = carried.select("file", F.explode(inside).alias("d")).select("file", "d.document", "d.start", (F.col("d.end") - F.col("d.start")).alias("n_tokens"))
    whole = blocks.groupBy("file").agg(F.sum("tokens").alias("tokens"), F.sum("separators").alias("document"), F.coalesce(F.max("last"), F.lit(-1)).alias("last"))
    open_ = whole.where("last + 1 < tokens").select("file", "document", (F.col("last") + 1).alias("start"), (F.col("tokens") - F.col("last") - 1).alias("n_tokens"))
    return ended.union(open_)


def token_counts(docs: DataFrame, model: str, path: str | None = None) -> DataFrame:
    """Write `docs` as flat files (in a new shared folder if no path is given) and return their documents as `scan_flat` does."""
    spark = docs.sparkSession
    small_batches(spark)
    path = path or shared_path(spark, "tokens")
    write_flat(docs, model, path)
    return scan_flat(spark, path)
