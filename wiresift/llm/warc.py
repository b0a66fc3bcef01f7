"""WARC archives and a globally ordered capture index by external merge (operator 5).

Records are written by Spark's text writer with the line separator CR LF CR LF, which is exactly how a WARC record ends, so archives land in any
store that Spark writes to; a task joins its records to archives of bounded size. Reading parses each archive (of bounded size) by its Content-Length fields and sorts its captures by URL key, timestamp
and record id: one run. Runs are cut at sampled keys, a range's pieces of all runs meet in one task, and a loser tree merges them.
"""
from __future__ import annotations

import base64
import hashlib
import re
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wiresift.llm.common import bundles, shared_path, small_batches, stored

#: Records in one archive at most, and bytes of it before compression (one longer record is an archive of its own), so that a task can read one whole.
PER_ARCHIVE, ARCHIVE_BYTES = 4000, 32 << 20
#: Captures of a key range of the index, about.
PER_RANGE = 50_000
EPOCH = 1_700_000_000
END = "\r\n\r\n"
ENTRY = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, url_key string, timestamp string, archive string, start long, size long"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def url_key(url: str | None) -> str:
    """Sort key of a URL: host labels from the top, then port, path and query, in lower case and without a scheme, www or a fragment."""
    if not url:
        return ")"
    m = re.match(r"(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://)?([^/?#]*)([^#]*)", url)
    host, path = m[1].rpartition("@")[2].lower(), m[2].lower()
    name, _, port = host.partition(":")
    labels = [x for x in name.split(".") if x]
    labels = labels[1:] if len(labels) > 2 and re.fullmatch(r"www\d*", labels[0]) else labels
    return ",".join(reversed(labels)) + (f":{port}" if port and port not in ("80", "443") else "") + ")" + (path or "/")


def _digests(batches):
    for batch in batches:
        payloads = [(x.as_py() or "").encode() for x in batch.column(2)]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([payload_digest(x) for x in payloads]), pa.array([len(x) for x in payloads], pa.int64())], names=["page_id", "url", "html", "digest", "bytes"])


def _records(batches):
    """The bytes of each record, without the CR LF CR LF that ends it."""
    for batch in batches:
        for page_id, url, html, digest, size, original, at in zip(*batch.columns):
            name, again, url = page_id.as_py() if page_id.is_valid else "none", original.is_valid, url.as_py()
            head = ["WARC/1.1", f"WARC-Type: {'revisit' if again else 'response'}", f"WARC-Record-ID: <urn:page:{name}>", f"WARC-Date: {at}", f"WARC-Payload-Digest: sha1:{digest}"]
            if url is not None:
                head.append(f"WARC-Target-URI: {quote(url, safe=''.join(map(chr, range(33, 127))).replace('%', ''))}")
            if again:
                head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{original}>"]
            body = "" if again else html.as_py() or ""
            yield ("\r\n".join([*head, "Content-Type: text/html; charset=utf-8", f"Content-Length: {0 if again else size}"]) + END + body).encode()


def _archives(per_archive: int, archive_bytes: int):
    def pack(batches):
        for archive in bundles(_records(batches), END.encode(), per_archive, archive_bytes):
            yield pa.RecordBatch.from_arrays([pa.array([archive], pa.binary())], names=["value"])
    return pack


def write_archives(pages: DataFrame, path: str, per_archive: int = PER_ARCHIVE, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write a record for every row of `pages` (page_id, url, html) as gzip archives under `path`.

    Of records with equal payloads (a null html is an empty payload) the one with the largest page_id is the response, the others revisit it. Rows
    that repeat that page_id are responses too; a row without a page_id is always a response and never referred to. Capture times are page_id
    seconds after `EPOCH`. An archive holds records up to `per_archive` and `archive_bytes`, or a single longer one, in one gzip member.
    """
    slim = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    made = slim.mapInArrow(_digests, "page_id long, url string, html string, digest string, bytes long")
    # only payloads that come again need their largest page_id
    largest = made.select("digest", "page_id").groupBy("digest").agg(F.max("page_id").alias("original"), F.count("page_id").alias("n")).where("n > 1").drop("n")
    at = F.date_format(F.timestamp_seconds(F.lit(EPOCH) + F.coalesce("page_id", F.lit(0)) % 1_000_000_000), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    known = made.join(largest, "digest", "left").select("page_id", "url", "html", "digest", "bytes", F.when(F.col("page_id") < F.col("original"), F.col("original")).alias("original"), at.alias("at"))
    archives = known.mapInArrow(_archives(per_archive, archive_bytes), "value binary").select(F.col("value").cast("string").alias("value"))
    # one row is one archive, and the line separator ends its last record
    archives.write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", 1).text(path)


def _entries(batches):
    """The captures of each archive, sorted: one run an archive."""
    import zlib
    for batch in batches:
        for path, content in zip(batch.column(0), batch.column(1)):
            data, at, run = zlib.decompress(content.as_buffer(), 47), 0, []
            while at < len(data):
                stop = data.index(b"\r\n\r\n", at)
                head = dict(x.split(": ", 1) for x in data[at:stop].decode().split("\r\n")[1:])
                body, size = stop + 4, int(head["Content-Length"])
                payload, record = data[body:body + size], head["WARC-Record-ID"][10:-1]
                end = body + size + 4
                digest, again = head["WARC-Payload-Digest"][5:], head["WARC-Type"] == "revisit"
                if not again and payload_digest(payload) != digest:
                    raise ValueError(f"{path.as_py()} at {at}: the payload differs from its digest")
                url = unquote(head["WARC-Target-URI"]) if "WARC-Target-URI" in head else None
                stamp = re.sub(r"\D", "", head["WARC-Date"])
                run.append((url_key(url), stamp, None if record == "none" else int(record), None if again else size, digest, head["WARC-Type"], int(head["WARC-Refers-To"][10:-1]) if again else None, url, at, end - at))
                at = end
            run.sort(key=lambda x: (x[0], x[1], -1 if x[2] is None else x[2], x[8]))
            key, stamp, page, size, digest, kind, refers, url, start, length = zip(*run) if run else [()] * 10
            yield pa.RecordBatch.from_arrays([
                pa.array(page, pa.int64()), pa.array(size, pa.int64()), pa.array(digest, pa.string()), pa.array(kind, pa.string()), pa.array(refers, pa.int64()), pa.array(url, pa.string()), pa.array(key, pa.string()),
                pa.array(stamp, pa.string()), pa.array([path.as_py().rpartition("/")[2]] * len(run), pa.string()), pa.array(start, pa.int64()), pa.array(length, pa.int64()),
            ], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "url_key", "timestamp", "archive", "start", "size"])


def read_archives(spark, path: str) -> DataFrame:
    """The capture entries of all archives under `path`, each archive's in order. A digest that does not fit its payload is an error.

    `start` and `size` are a record's place in the decompressed archive.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("path", "content")
    return files.mapInArrow(_entries, ENTRY)


def merge_runs(runs: list[list], key):
    """Merge sorted lists with a loser tree: each inner node keeps the loser of its match, so a new head plays one match a level."""
    k = len(runs)
    at = [0] * k
    last = (1,)
    heads = [(0, key(r[0]), i) if r else last for i, r in enumerate(runs)]
    losers, winners = [0] * max(k, 1), [0] * (2 * k)
    for i in range(k):
        winners[k + i] = i
    for node in range(k - 1, 0, -1):
        a, b = winners[2 * node], winners[2 * node + 1]
        winners[node], losers[node] = (a, b) if heads[a] <= heads[b] else (b, a)
    best = winners[1] if k > 1 else 0
    while k and heads[best] is not last:
        yield runs[best][at[best]]
        at[best] += 1
        heads[best] = (0, key(runs[best][at[best]]), best) if at[best] < len(runs[best]) else last
        node, now = (k + best) // 2, best
        while node:
            if heads[losers[node]] < heads[now]:
                losers[node], now = now, losers[node]
            node //= 2
        best = now


def _merge(batches):
    """All pieces of one key range, split into their runs again and merged."""
    batches = list(batches)
    if not sum(b.num_rows for b in batches):
        return
    table = pa.Table.from_batches(batches)
    runs = {}
    for i, archive in enumerate(table["archive"].to_pylist()):
        runs.setdefault(archive, []).append(i)
    place = table["place"].to_pylist()
    keys = list(zip(table["url_key"].to_pylist(), table["timestamp"].to_pylist(), [-1 if x is None else x for x in table["page_id"].to_pylist()], table["archive"].to_pylist(), place))
    pieces = [sorted(runs[a], key=place.__getitem__) for a in sorted(runs)]
    order = list(merge_runs(pieces, keys.__getitem__))
    merged = table.drop_columns(["place"]).take(pa.array(order)).append_column("range_pos", pa.array(range(len(order)), pa.int64()))
    yield from merged.combine_chunks().to_batches()


def capture_index(entries: DataFrame) -> DataFrame:
    """`entries` with capture_rank (from 0): captures by (url_key, timestamp, page_id), each URL's history together.

    Ranges are cut at sampled keys that include the timestamp and the id, so a URL with any share of all captures spreads over ranges.
    """
    runs = entries.withColumn("place", F.monotonically_increasing_id())
    ranges = max(int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-entries.count() // PER_RANGE))
    cut = runs.repartitionByRange(ranges, "url_key", "timestamp", "page_id", "archive", "place")
    merged = stored(cut.mapInArrow(_merge, f"{ENTRY}, range_pos long").withColumn("range_id", F.spark_partition_id()), "index")
    before = Window.orderBy("range_id").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    sizes = merged.groupBy("range_id").agg(F.count(F.lit(1)).alias("n")).select("range_id", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begin"))
    return merged.join(F.broadcast(sizes), "range_id").withColumn("capture_rank", F.col("begin") + F.col("range_pos")).drop("range_id", "range_pos", "begin")


def archive_and_index(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write `pages` as archives under `path` (a new shared folder if not given), read them back and return the capture index.

    A revisit gets the length of the payload that it refers to. One row for each row of `pages`; an empty table gives none.
    """
    spark = pages.sparkSession
    small_batches(spark)
    path = path or shared_path(spark, "warc")
    write_archives(pages, path)
    entries = stored(read_archives(spark, path), "captures")
    index = capture_index(entries)
    full = entries.where("record_type = 'response' and page_id is not null").groupBy(F.col("page_id").alias("refers_to"), "payload_digest").agg(F.max("payload_bytes").alias("__bytes"))
    return index.join(full, ["refers_to", "payload_digest"], "left").withColumn("payload_bytes", F.coalesce("payload_bytes", "__bytes")).drop("__bytes")
