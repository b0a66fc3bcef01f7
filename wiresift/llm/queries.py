"""Registered queries of this package."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wiresift.llm import lattice, lloyd, maxent, neardup, packing, passages, quality, separators, sharding, spelling, suffixes, vptree, warc
from wiresift.llm.common import read, stored

QUERIES, ORACLES = {}, {}


#: The words of a text, in DuckDB.
WS = r"regexp_extract_all({t}, '[^\x20\x09-\x0D]+')"
NEAR_SQL = "WITH RECURSIVE w AS (SELECT doc_id, " + WS.format(t="translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')") + """ AS ws FROM documents)
, s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS sh FROM w)
, n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1)
, p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2)
, e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c))
, both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e)
, reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON reach.b = both_ways.a)
, low AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1)
SELECT d.doc_id, COALESCE(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM documents d JOIN low USING (doc_id) LEFT JOIN n USING (doc_id)"""
PASSAGES_SQL = "WITH w AS (SELECT doc_id, " + WS.format(t="COALESCE(text, '')") + """ AS ws FROM documents)
, win AS (SELECT doc_id, unnest(list_transform(range(1, len(ws) - 48), lambda i: {'i': i, 't': array_to_string(ws[i:i + 49], ' ')}), recursive := true) FROM w WHERE len(ws) >= 50)
, least AS (SELECT t, min(doc_id) AS first FROM win GROUP BY 1)
, gone AS (SELECT DISTINCT win.doc_id, unnest(range(i, i + 50)) AS j FROM win JOIN least USING (t) WHERE first < win.doc_id)
, word AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS j FROM w)
, kept AS (SELECT word.doc_id, count(gone.j) AS n_removed, string_agg(word, ' ' ORDER BY word.j) FILTER (gone.j IS NULL) AS text FROM word LEFT JOIN gone ON gone.doc_id = word.doc_id AND gone.j = word.j GROUP BY 1)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, COALESCE(n_removed, 0) AS n_removed, sha256(COALESCE(text, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)"""
BYTES_SQL = """WITH h AS (SELECT doc_id, hex(encode(COALESCE(text, ''))) AS h, strlen(COALESCE(text, '')) AS n FROM documents)
, win AS (SELECT doc_id, unnest(list_transform(range(0, n - 49), lambda i: {'i': i, 't': substring(h, 2 * i + 1, 100)}), recursive := true) FROM h WHERE n >= 50)
, least AS (SELECT t, min(doc_id) AS first FROM win GROUP BY 1)
, gone AS (SELECT DISTINCT win.doc_id, unnest(range(i, i + 50)) AS j FROM win JOIN least USING (t) WHERE first < win.doc_id)
, runs AS (SELECT doc_id, count(*) AS n_removed, count(CASE WHEN before IS NULL OR before < j - 1 THEN 1 END) AS n_spans FROM (SELECT doc_id, j, lag(j) OVER (PARTITION BY doc_id ORDER BY j) AS before FROM gone) GROUP BY 1)
, byte AS (SELECT doc_id, unnest(list_transform(range(0, n), lambda i: {'j': i, 'x': substring(h, 2 * i + 1, 2)}), recursive := true) FROM h)
, kept AS (SELECT byte.doc_id, string_agg(x, '' ORDER BY byte.j) AS x FROM byte ANTI JOIN gone ON gone.doc_id = byte.doc_id AND gone.j = byte.j GROUP BY 1)
SELECT h.doc_id, n::BIGINT AS n_bytes, COALESCE(n_removed, 0) AS n_removed, COALESCE(n_spans, 0) AS n_spans, sha256(unhex(COALESCE(x, ''))) AS kept_sha256 FROM h LEFT JOIN runs USING (doc_id) LEFT JOIN kept USING (doc_id)"""


def word_bpe() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def piece_bpe() -> str:
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql.strip()
        return fn
    return register


@query("op7_minhash_near_dedup", NEAR_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(read(spark, sf_dir, "documents"))


@query("op6_debruijn_substring_dedup", PASSAGES_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = passages.remove_repeats(read(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query("op3_boosted_quality_rules")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return quality.judge(docs, quality.fit_on(docs, read(spark, sf_dir, "labels")))


@query("op8_cutting_stock_packing")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), word_bpe()).drop("ids")


#: Rows of 8 shards by proportional interleaving. The order of 64-bit hashes has no SQL twin, so the query is tested against a plain Python version.
@query("op1_proportional_interleaving")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    dealt = sharding.interleave(docs, 8, key=[F.col(c) for c in ("doc_id", "text_crc32", "size")])
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")


@query("op9_vantage_point_search")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vptree.nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


#: Host labels from the top, SHA-1 in base 32 from its hexadecimal form, and the order of captures.
WARC_SQL = r"""WITH u AS (SELECT page_id, url, COALESCE(html, '') AS html, sha1(COALESCE(html, '')) AS h, regexp_extract(COALESCE(url, ''), '^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://)?([^/?#]*)([^#]*)', 1) AS host0, lower(regexp_extract(COALESCE(url, ''), '^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://)?([^/?#]*)([^#]*)', 2)) AS path FROM pages)
, v AS (SELECT *, lower(regexp_replace(host0, '^.*@', '')) AS host FROM u)
, l AS (SELECT *, list_filter(string_split(split_part(host, ':', 1), '.'), lambda x: x <> '') AS labels, CASE WHEN contains(host, ':') THEN substr(host, strpos(host, ':') + 1) ELSE '' END AS port FROM v)
, k AS (SELECT *, CASE WHEN COALESCE(url, '') = '' THEN ')' ELSE array_to_string(list_reverse(CASE WHEN len(labels) > 2 AND regexp_full_match(labels[1], 'www\d*') THEN labels[2:] ELSE labels END), ',')
   || CASE WHEN port IN ('', '80', '443') THEN '' ELSE ':' || port END || ')' || CASE WHEN path = '' THEN '/' ELSE path END END AS url_key, strftime(make_timestamp((1700000000 + page_id % 1000000000) * 1000000), '%Y%m%d%H%M%S') AS timestamp FROM l)
, b AS (SELECT *, array_to_string(list_transform(range(1, 41), lambda i: substr('0000000100100011010001010110011110001001101010111100110111101111', 4 * strpos('0123456789abcdef', substr(h, i, 1)) - 3, 4)), '') AS bits FROM k)
, d AS (SELECT *, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(list_sum(list_transform(range(0, 5), lambda j: CAST(substr(bits, 5 * i + j + 1, 1) AS INTEGER) * (16 >> j::INTEGER))) AS INTEGER), 1)), '') AS payload_digest FROM b)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes, payload_digest, CASE WHEN page_id = max(page_id) OVER (PARTITION BY html) THEN 'response' ELSE 'revisit' END AS record_type,
  nullif(max(page_id) OVER (PARTITION BY html), page_id) AS refers_to, url_key, timestamp, row_number() OVER (ORDER BY url_key, timestamp, page_id) - 1 AS capture_rank FROM d"""


@query("op5_warc_capture_index", WARC_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.archive_and_index(read(spark, sf_dir, "pages"))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "timestamp", "capture_rank")


@query("op4_suffix_array_dedup", BYTES_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffixes.remove_repeats(read(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query("op2_separator_scan")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return separators.token_counts(read(spark, sf_dir, "documents"), piece_bpe())


@query("op10_piece_lattice")
def op10_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the ids of its whole text, the text that they decode to, and whether it is the document's own."""
    return lattice.round_trip(read(spark, sf_dir, "documents"), lattice.Vocabulary(piece_bpe()))


@query("op10_word_dictionary")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct word of all documents with its occurrences and ids, and the word that they decode to."""
    vocabulary = lattice.Vocabulary(piece_bpe())
    words = stored(lattice.distinct_words(read(spark, sf_dir, "documents"), vocabulary), "words")
    short, long = (lattice.decode(x, vocabulary, ["word", "occurrences", "ids"]) for x in lattice.encode_words(words, vocabulary))
    return short.union(long).withColumnRenamed("text", "decoded")


@query("op13_spelling_variants")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents with their near words, forms and roots; CRC-32 has no SQL twin, so the query is tested against a plain Python version."""
    return spelling.variants(stored(spelling.word_counts(read(spark, sf_dir, "documents")), "spelling-words"))


def lloyd_sql(rounds: int = 10, k: int = 8) -> str:
    """Each round is a table of labels and a table of centroids."""
    gap = "list_sum(list_transform(range(1, 65), lambda i: (v.q[i] - c.q[i]) * (v.q[i] - c.q[i])))::BIGINT"
    steps = []
    for i in range(rounds + 1):
        steps.append(f"a{i} AS MATERIALIZED (SELECT r, vec_id, q, k, d FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY d, k) AS place FROM (SELECT v.r, v.vec_id, v.q, c.k, {gap} AS d FROM kept v CROSS JOIN c{i} c)) WHERE place = 1)")
        if i < rounds:
            steps.append(f"""s{i} AS (SELECT k, j, sum(q[j])::BIGINT AS s, count(*) AS n FROM a{i}, (SELECT unnest(range(1, 65)) AS j) GROUP BY k, j)
, c{i + 1} AS MATERIALIZED (SELECT c.k, COALESCE(m.q, c.q) AS q FROM c{i} c LEFT JOIN (SELECT k, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY j) AS q FROM s{i} GROUP BY k) m ON m.k = c.k)""")
    return f"""WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS q FROM embeddings
 WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)
, c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY h) - 1)::INT AS k, q FROM (SELECT sha256('3:' || vec_id::VARCHAR) AS h, q FROM kept ORDER BY h LIMIT {k}))
, {', '.join(steps)}
SELECT a.vec_id, a.k AS cluster, a.d AS distance, (sum(a.d) OVER (PARTITION BY a.k))::BIGINT AS cluster_inertia, (sum(a.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.q, ',')) AS centroid_sha256 FROM a{rounds} a JOIN c{rounds} c ON c.k = a.k"""


@query("op11_dimension_sharded_lloyd", lloyd_sql())
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lloyd.cluster(read(spark, sf_dir, "embeddings"))


@query("op12_maxent_scoring")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by the model trained on nine tenths of them; learned weights and CRC-32 have no SQL twin, so the query is tested against a plain Python version."""
    return maxent.score(read(spark, sf_dir, "documents"))
