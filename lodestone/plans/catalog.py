"""Every operator of the engine as a query over the test tables, with the same query in SQL.

The tables stand in for a corpus: a document is a file at source/lang/id.txt, its chunks are word windows, an embedding
belongs to the first chunk of the document of its id, and its label gives that chunk's media type.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Display, MediaLane, MediaOptions
from ..functions import scoring, text, vectors
from ..operators import retrieval as R
from ..operators import search as S
from ..operators.chunking import chunked
from ..sources import embed, ingest, policy
from ..sources.listing import text_of
from ..sources.store import fingerprint_of
from ..streaming import feed

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def r6(c: Column) -> Column:
    """What is compared of a double: six decimals, and no negative zero."""
    return F.round(c, 6) + F.lit(0.0)


# The corpus


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").withColumn("path", F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))))


def plain_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return chunked(documents(spark, sf).select("doc_id", "path", "text")).withColumn("chunk_id", F.col("doc_id") * 1000 + F.col("chunk_idx"))


def vecs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select((F.col("vec_id") * 1000).alias("chunk_id"), "embedding")


MEDIA_OF = ("text", "image", "pdf", "audio", "video")


_indexes: dict[tuple[str, str], S.Index] = {}


def index(spark: SparkSession, sf: str) -> S.Index:
    """Chunks of all documents; the first chunk of one with an embedding has its label's media type.

    Chunks and terms are kept, as they would be in a stored index, for as long as the session reads the same tables."""
    key = spark.sparkContext.applicationId, sf
    if key not in _indexes:
        _indexes[key] = _index(spark, sf)
    return _indexes[key]


def _index(spark: SparkSession, sf: str) -> S.Index:
    labels = table(spark, sf, "embeddings").select((F.col("vec_id") * 1000).alias("chunk_id"), "label")
    kind = F.when(F.col("label").isNull(), F.lit("text")).otherwise(F.element_at(F.array(*map(F.lit, MEDIA_OF)), F.coalesce(F.col("label"), F.lit(0)) % 5 + 1))
    pdf = F.col("media_type") == "pdf"
    c = plain_chunks(spark, sf).join(labels, "chunk_id", "left").withColumn("media_type", kind)
    c = c.withColumns({
        "mime_type": F.when(pdf, "application/pdf"), "media_start": F.when(pdf, F.col("doc_id") % 3), "media_end": F.when(pdf, F.col("doc_id") % 3 + 1 + F.col("doc_id") % 2),
        "media_unit": F.when(pdf, "page"), "truncated": F.col("doc_id") % 7 == 0,
    })
    c = c.persist()
    terms = R.indexed(c.filter("media_type = 'text'"), heading=None).persist()
    files = documents(spark, sf).select("path", F.sha2("text", 256).alias("content_hash"))
    return S.Index(c, vecs(spark, sf), terms, files, 64)


def query_vector(spark: SparkSession, sf: str, vec_id: int = 7) -> list[float]:
    return list(table(spark, sf, "embeddings").filter(F.col("vec_id") == vec_id).first()["embedding"])


CHUNKS_SQL = r"""
docs AS (SELECT doc_id, source || '/' || lang || '/' || doc_id || '.txt' AS path, text, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
chunks AS (
  SELECT doc_id, path, CAST(i AS BIGINT) AS chunk_idx, doc_id * 1000 + i AS chunk_id,
    CASE WHEN len(w) <= 500 THEN regexp_replace(text, '[ \t\r\n]+$', '') ELSE array_to_string(w[i * 450 + 1 : i * 450 + 500], ' ') END AS content
  FROM (SELECT *, unnest(range(0, CASE WHEN len(w) = 0 THEN 0 WHEN len(w) <= 500 THEN 1 ELSE CAST(ceil((len(w) - 500) / 450.0) AS BIGINT) + 1 END)) AS i FROM docs))"""
INDEX_SQL = CHUNKS_SQL + r""",
idx AS (
  SELECT c.*, coalesce(['text', 'image', 'pdf', 'audio', 'video'][label % 5 + 1], 'text') AS media_type, doc_id % 3 AS ms, doc_id % 3 + 1 + doc_id % 2 AS me, doc_id % 7 = 0 AS truncated
  FROM chunks c LEFT JOIN (SELECT vec_id * 1000 AS chunk_id, label FROM embeddings) USING (chunk_id)),
terms AS (SELECT chunk_id, regexp_extract_all(strip_accents(lower(content)), '[\p{L}\p{N}]+') AS t FROM idx WHERE media_type = 'text'),
stats AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM terms)"""
SNIPPET_SQL = r"""CASE WHEN length(flat) > 240 OR (length(flat) = 240 AND flat LIKE '% ' AND regexp_matches(body, '\s\s$')) THEN trim(flat[1:240])[1:237] || '...' ELSE trim(flat) END"""
BODY_SQL = r"""CASE WHEN NOT starts_with(content, '#') THEN content WHEN instr(content, chr(10)) > 0 THEN content[instr(content, chr(10)) + 1 :] ELSE content[2:] END"""


def sql_distance(a: str, b: str) -> str:
    return f"1 - list_dot_product(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[])) / (sqrt(list_dot_product(CAST({a} AS DOUBLE[]), CAST({a} AS DOUBLE[]))) * sqrt(list_dot_product(CAST({b} AS DOUBLE[]), CAST({b} AS DOUBLE[]))))"


def sql_bm25(phrases: list[list[str]]) -> str:
    """CTEs tf and bm (chunk_id, score) over `terms` and `stats`."""
    def count(p: list[str]) -> str:
        same = " AND ".join(f"t[i + {k}] = '{w}'" for k, w in enumerate(p))
        return f"len(list_filter(range(1, len(t) - {len(p) - 2}), lambda i: {same}))"

    n = range(len(phrases))
    idf = lambda i: f"CASE WHEN (n - d{i} + 0.5) / (d{i} + 0.5) > 1 THEN ln((n - d{i} + 0.5) / (d{i} + 0.5)) ELSE 1e-6 END"
    score = " + ".join(f"({idf(i)}) * (f{i} * 2.2) / (f{i} + 1.2 * (0.25 + 0.75 * dl / mean))" for i in n)
    return f"""tf AS (SELECT chunk_id, len(t) AS dl, {", ".join(f"{count(p)} AS f{i}" for i, p in enumerate(phrases))} FROM terms),
df AS (SELECT {", ".join(f"count(*) FILTER (f{i} > 0) AS d{i}" for i in n)} FROM tf),
bm AS (SELECT chunk_id, -({score}) AS score FROM tf, df, stats WHERE {" AND ".join(f"f{i} > 0" for i in n)})"""


# Files

_PATH = """CASE doc_id % 9 WHEN 0 THEN source || '/' || doc_id || '.md' WHEN 1 THEN source || '/' || doc_id || '.PNG' WHEN 2 THEN '.hidden/' || doc_id || '.md' WHEN 3 THEN 'node_modules/' || doc_id || '.txt'
  WHEN 4 THEN source || '/../' || doc_id || '.md' WHEN 5 THEN source || '/' || doc_id || '.pdf' WHEN 6 THEN source || '/' || doc_id || '.rtf' WHEN 7 THEN '/abs/' || doc_id || '.md' ELSE source || '/' || doc_id END"""
_KIND = r"CASE WHEN regexp_matches(lower(p), '[^/]\.(md|txt)$') THEN 'text' WHEN regexp_matches(lower(p), '[^/]\.(png|jpg|jpeg|webp|gif)$') THEN 'image' WHEN regexp_matches(lower(p), '[^/]\.pdf$') THEN 'pdf' END"
_SAFE = r"p <> '' AND NOT starts_with(p, '/') AND NOT regexp_matches(p, '(^|/)(\.[^/]+|node_modules)(/|$)')"
OPTIONS = MediaOptions(enabled=True, include=("src*/**",), exclude=("src1/*", "*/9?.pdf"))


def _files(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "text", F.expr(_PATH).alias("path"))


@query(f"SELECT doc_id, {_KIND} AS media_type FROM (SELECT doc_id, {_PATH} AS p FROM documents)")
def ext_media_type(spark, sf):
    return _files(spark, sf).select("doc_id", policy.media_type_of(F.col("path")).alias("media_type"))


@query(f"SELECT doc_id, {_SAFE} AS safe FROM (SELECT doc_id, {_PATH} AS p FROM documents)")
def path_safety(spark, sf):
    return _files(spark, sf).select("doc_id", policy.is_safe(F.col("path")).alias("safe"))


@query(rf"""SELECT doc_id, p AS path, CASE WHEN {_SAFE} AND (k = 'text' OR (regexp_matches(p, '^src.*/') AND NOT regexp_matches(p, '^src1/') AND NOT regexp_matches(p, '/9.\.pdf$'))) THEN k END AS media_type,
  coalesce(k = 'text' OR octets <= 20 * 1024 * 1024, false) AS small_enough
FROM (SELECT *, {_KIND} AS k FROM (SELECT doc_id, {_PATH} AS p, strlen(text) AS octets FROM documents))""")
def scan_eligibility(spark, sf):
    kind = policy.media_type_of(F.col("path"))
    small = F.coalesce(policy.allowed_size(kind, F.octet_length("text"), OPTIONS), F.lit(False))
    return _files(spark, sf).select("doc_id", "path", policy.classified(F.col("path"), OPTIONS).alias("media_type"), small.alias("small_enough"))


@query(f"""SELECT doc_id, CASE WHEN k = 'text' THEN sha256(text) ELSE sha256(CAST(encode(text) || '\\x00'::BLOB || encode('media-v1|max_file_mb=20|pdf_pages_per_chunk=6|pdf_dpi=150') AS BLOB)) END AS content_hash
FROM (SELECT doc_id, text, {_KIND} AS k FROM (SELECT doc_id, text, {_PATH} AS p FROM documents)) WHERE k IS NOT NULL""")
def effective_hash(spark, sf):
    f = _files(spark, sf).withColumn("kind", policy.media_type_of(F.col("path"))).filter("kind IS NOT NULL")
    return f.select("doc_id", policy.effective_hash(F.col("text"), F.col("kind"), OPTIONS).alias("content_hash"))


# Changes: the disk lacks one residue class of the index's files; the index lacks another and knows old content of a third

_SCAN = "SELECT source || '/' || lang || '/' || doc_id || '.txt' AS path, sha256(text) AS content_hash FROM documents WHERE doc_id % 7 <> 0"
_FILES = "SELECT source || '/' || lang || '/' || doc_id || '.txt' AS path, sha256(CASE WHEN doc_id % 5 = 0 THEN text || '!' ELSE text END) AS content_hash FROM documents WHERE doc_id % 11 <> 0"
_DIFF = f"SELECT path, CASE WHEN s.content_hash IS NULL THEN 'removed' WHEN f.content_hash IS NULL THEN 'new' WHEN s.content_hash <> f.content_hash THEN 'changed' ELSE 'unchanged' END AS status FROM ({_SCAN}) s FULL JOIN ({_FILES}) f USING (path)"


def _states(spark, sf) -> tuple[DataFrame, DataFrame]:
    d = documents(spark, sf)
    scan = d.filter("doc_id % 7 <> 0").select("path", F.sha2("text", 256).alias("content_hash"))
    files = d.filter("doc_id % 11 <> 0").select("path", F.sha2(F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("content_hash"))
    return scan, files


@query(_DIFF)
def dirty_diff(spark, sf):
    return ingest.diff(*_states(spark, sf))


@query(f"SELECT path FROM ({_DIFF}) WHERE status IN ('new', 'changed')")
def dirty_paths(spark, sf):
    return ingest.dirty(*_states(spark, sf))


@query(f"SELECT path FROM ({_FILES}) WHERE path NOT IN (SELECT path FROM ({_SCAN}))")
def prune_anti(spark, sf):
    return ingest.pruned(*_states(spark, sf))


@query(f"SELECT path FROM ({_DIFF}) WHERE status = 'unchanged'")
def unchanged_skip(spark, sf):
    return ingest.diff(*_states(spark, sf)).filter("status = 'unchanged'").select("path")


@query(f"SELECT count(*) FILTER (status <> 'removed') AS scanned, count(*) FILTER (status IN ('new', 'changed')) AS dirty, count(*) FILTER (status = 'removed') AS pruned FROM ({_DIFF})")
def scan_summary(spark, sf):
    return ingest.summary(*_states(spark, sf))


_CACHE = "SELECT sha256(text) AS content_hash, min(doc_id) AS e FROM documents WHERE doc_id % 3 = 0 GROUP BY 1"


def _cache(spark, sf) -> tuple[DataFrame, DataFrame]:
    d = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"))
    return d, d.filter("doc_id % 3 = 0").groupBy("content_hash").agg(F.min("doc_id").alias("embedding"))


@query(f"SELECT doc_id, content_hash, e AS cached FROM (SELECT doc_id, sha256(text) AS content_hash FROM documents) LEFT JOIN ({_CACHE}) USING (content_hash)")
def cache_probe_left(spark, sf):
    return ingest.with_cache(*_cache(spark, sf)).withColumnRenamed("embedding", "cached").select("doc_id", "content_hash", "cached")


@query(f"SELECT DISTINCT sha256(text) AS content_hash FROM documents WHERE text IS NOT NULL AND sha256(text) NOT IN (SELECT content_hash FROM ({_CACHE}))")
def cache_miss_anti(spark, sf):
    return ingest.misses(*_cache(spark, sf)).select("content_hash")


@query(f"SELECT count(*) FILTER (e IS NOT NULL) AS cached, count(DISTINCT content_hash) FILTER (e IS NULL) AS embedded FROM (SELECT sha256(text) AS content_hash FROM documents) LEFT JOIN ({_CACHE}) USING (content_hash)")
def cache_counters(spark, sf):
    rows = ingest.with_cache(*_cache(spark, sf))
    return rows.agg(F.count_if(F.col("embedding").isNotNull()).alias("cached"), F.count_distinct(F.when(F.col("embedding").isNull(), F.col("content_hash"))).alias("embedded"))


# Chunks


@query(f"WITH {CHUNKS_SQL} SELECT chunk_id, path, chunk_idx, content, sha256(content) AS content_hash, CAST(len(list_filter(regexp_split_to_array(content, '\\s+'), lambda x: x <> '')) AS BIGINT) AS tokens FROM chunks")
def chunk_word_window(spark, sf):
    return plain_chunks(spark, sf).select("chunk_id", "path", "chunk_idx", "content", "content_hash", "tokens")


@query(f"WITH {CHUNKS_SQL} SELECT count(*) AS chunks FROM chunks")
def count_chunks(spark, sf):
    return plain_chunks(spark, sf).agg(F.count("*").alias("chunks"))


@query(f"WITH {CHUNKS_SQL} SELECT path, count(*) AS chunks, CAST(sum(len(list_filter(regexp_split_to_array(content, '\\s+'), lambda x: x <> ''))) AS BIGINT) AS tokens FROM chunks GROUP BY path")
def token_counts(spark, sf):
    return plain_chunks(spark, sf).groupBy("path").agg(F.count("*").alias("chunks"), F.sum("tokens").alias("tokens"))


def _markdown(spark, sf) -> DataFrame:
    """A conversation as a document: a heading of level 1, and one of level 2 a turn, with a fenced comment before it."""
    t = table(spark, sf, "conversations").select("conv_id", "turn", F.concat(F.lit("## "), "role", F.lit(" "), "turn", F.lit(" ##\n```\n# no heading\n```\n"), F.coalesce("text", F.lit("")), F.lit("\n")).alias("part"))
    turns = t.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "part"))).alias("p"))
    return turns.select("conv_id", F.concat(F.lit("# conv "), "conv_id", F.lit("\r\n\n"), F.array_join(F.transform("p", lambda x: x.part), "")).alias("text"))


_MARKDOWN_SQL = r"""
SELECT conv_id, CAST(0 AS BIGINT) AS chunk_idx, 'conv ' || conv_id AS heading, 'conv ' || conv_id AS heading_path, '# conv ' || conv_id AS content FROM (SELECT DISTINCT conv_id FROM conversations)
UNION ALL
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS chunk_idx, role || ' ' || turn AS heading, 'conv ' || conv_id || ' > ' || role || ' ' || turn AS heading_path,
  regexp_replace('## ' || role || ' ' || turn || ' ##' || chr(10) || '```' || chr(10) || '# no heading' || chr(10) || '```' || chr(10) || coalesce(text, ''), '[ \t\r\n]+$', '') AS content
FROM conversations"""


@query(_MARKDOWN_SQL)
def chunk_markdown_sections(spark, sf):
    return chunked(_markdown(spark, sf)).select("conv_id", "chunk_idx", "heading", "heading_path", "content")


@query(f"SELECT heading_path, count(*) AS n FROM ({_MARKDOWN_SQL}) GROUP BY 1")
def chunk_heading_path(spark, sf):
    return chunked(_markdown(spark, sf)).groupBy("heading_path").agg(F.count("*").alias("n"))


# Vectors

_Q7 = "q AS (SELECT embedding AS v FROM embeddings WHERE vec_id = 7)"


@query(f"WITH {_Q7} SELECT vec_id * 1000 AS chunk_id, round({sql_distance('embedding', 'v')}, 6) + 0.0 AS distance FROM embeddings, q ORDER BY {sql_distance('embedding', 'v')}, chunk_id LIMIT 30")
def knn_cosine_topk(spark, sf):
    return R.knn(vecs(spark, sf), R.literal(query_vector(spark, sf)), 30).withColumn("distance", r6(F.col("distance")))


_MEDIA_DISTANCE = "CAST(least(greatest(1 - list_dot_product(CAST(embedding AS DOUBLE[]), CAST(v AS DOUBLE[])), 0.0), 2.0) AS FLOAT)"


@query(f"WITH {_Q7} SELECT vec_id * 1000 AS chunk_id, round(CAST({_MEDIA_DISTANCE} AS DOUBLE), 6) + 0.0 AS distance FROM embeddings, q WHERE label % 5 IN (1, 2) ORDER BY {_MEDIA_DISTANCE}, chunk_id LIMIT 30")
def knn_media_filtered_topk(spark, sf):
    i = index(spark, sf)
    return R.knn_media(i.vectors, i.chunks, R.literal(query_vector(spark, sf)), 30, ["image", "pdf"]).withColumn("distance", r6(F.col("distance").cast("double")))


@query(f"""SELECT query_id, chunk_id, round(d, 6) + 0.0 AS distance, rank FROM (
  SELECT query_id, chunk_id, d, CAST(row_number() OVER (PARTITION BY query_id ORDER BY d, chunk_id) AS BIGINT) AS rank
  FROM (SELECT q.vec_id AS query_id, e.vec_id * 1000 AS chunk_id, {sql_distance('e.embedding', 'q.embedding')} AS d FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id % 20 = 0) q)) WHERE rank <= 10""")
def knn_batch_topk(spark, sf):
    q = table(spark, sf, "embeddings").filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return R.knn_batch(vecs(spark, sf), q, 10).select("query_id", "chunk_id", r6(F.col("distance")).alias("distance"), F.col("rank").cast("long").alias("rank"))


@query("""WITH m AS (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS m FROM (SELECT label, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) GROUP BY label, i),
s AS (SELECT label, sqrt(sum(m * m)) AS s FROM m GROUP BY label)
SELECT label, CAST(i - 1 AS BIGINT) AS i, round(m / s, 6) + 0.0 AS x FROM m JOIN s USING (label)""")
def centroid_normalised(spark, sf):
    c = vectors.centroid(table(spark, sf, "embeddings"), ["label"], dim=64)
    return c.select("label", F.posexplode(vectors.normalised(F.col("centroid"))).alias("i", "x")).select("label", F.col("i").cast("long").alias("i"), r6(F.col("x")).alias("x"))


@query("SELECT vec_id FROM embeddings WHERE vec_id IN (SELECT doc_id FROM labels)")
def vectors_for_chunks(spark, sf):
    return table(spark, sf, "embeddings").join(table(spark, sf, "labels").select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi").select("vec_id")


# Full text


@query(r"""SELECT item_id, coalesce(array_to_string(list_transform(list_filter(regexp_extract_all(text, '[\p{L}\p{N}_-]+'), lambda x: strlen(x) > 1), lambda x: '"' || x || '"'), ' '), '') AS match FROM benchmark""")
def fts_query_tokens(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", F.coalesce(text.match_query(F.col("text")), F.lit("")).alias("match"))


@query(r"SELECT doc_id, CAST(len(t) AS BIGINT) AS n_terms, sha256(array_to_string(t, ' ')) AS terms_sha256 FROM (SELECT doc_id, coalesce(regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}]+'), []) AS t FROM documents)")
def fts_terms(spark, sf):
    t = text.terms(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.size(t).cast("long").alias("n_terms"), F.sha2(F.array_join(t, " "), 256).alias("terms_sha256"))


@query(f"WITH {INDEX_SQL} SELECT n AS n_rows, round(mean, 6) AS mean_terms FROM stats")
def bm25_corpus_stats(spark, sf):
    return R.corpus_stats(index(spark, sf).terms).select("n_rows", F.round("mean_terms", 6).alias("mean_terms"))


def _bm25(name: str, asked: str, k: int = 30) -> None:
    phrases = R.phrases_of(asked)

    def run(spark, sf):
        return R.bm25(index(spark, sf).terms, phrases, k).withColumn("score", r6(F.col("score")))

    run.__name__ = name
    query(f"WITH {INDEX_SQL}, {sql_bm25(phrases)} SELECT chunk_id, round(score, 6) + 0.0 AS score FROM bm ORDER BY bm.score, chunk_id LIMIT {k}")(run)


_bm25("bm25_single", "hand")
_bm25("bm25_and", "that hand (with)")
_bm25("bm25_phrase", "of-the")
_bm25("bm25_accent", "é pour")


@query(rf"""WITH {INDEX_SQL},
q AS (SELECT item_id, unnest(list_distinct(flatten(list_transform(list_filter(regexp_extract_all(text, '[\p{{L}}\p{{N}}_-]+'), lambda x: strlen(x) > 1)[1:3], lambda x: regexp_extract_all(strip_accents(lower(x)), '[\p{{L}}\p{{N}}]+'))))) AS term FROM benchmark),
p AS (SELECT chunk_id, dl, term, count(*) AS tf FROM (SELECT chunk_id, len(t) AS dl, unnest(t) AS term FROM terms) GROUP BY ALL),
d AS (SELECT term, count(*) AS d FROM p GROUP BY term),
s AS (SELECT item_id, chunk_id, count(*) AS found, sum(CASE WHEN (n - d + 0.5) / (d + 0.5) > 1 THEN ln((n - d + 0.5) / (d + 0.5)) ELSE 1e-6 END * (tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * dl / mean))) AS s FROM q JOIN p USING (term) JOIN d USING (term), stats GROUP BY ALL)
SELECT query_id, chunk_id, score, rank FROM (
  SELECT item_id AS query_id, chunk_id, round(-s, 6) + 0.0 AS score, CAST(row_number() OVER (PARTITION BY item_id ORDER BY round(-s, 9), chunk_id) AS BIGINT) AS rank
  FROM s JOIN (SELECT item_id, count(*) AS asked FROM q GROUP BY 1) USING (item_id) WHERE found = asked) WHERE rank <= 10""")
def bm25_batch(spark, sf):
    b = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.array_join(F.slice(text.query_tokens(F.col("text")), 1, 3), " ").alias("text"))
    return R.bm25_batch(index(spark, sf).terms, b, 10).select("query_id", "chunk_id", r6(F.col("score")).alias("score"), F.col("rank").cast("long").alias("rank"))


#: The same on whole benchmark texts: `bm25_batch` asks for their first three tokens, as its SQL does.
@query(ORACLE_SQL["bm25_batch"].replace("> 1)[1:3], lambda", "> 1), lambda"))
def bm25_batch_text(spark, sf):
    b = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return R.bm25_batch(index(spark, sf).terms, b, 10).select("query_id", "chunk_id", r6(F.col("score")).alias("score"), F.col("rank").cast("long").alias("rank"))


# Fusion and hits

ASKED = "that with"
_PHRASES = R.phrases_of(ASKED)
_FUSED = f"""{INDEX_SQL}, {sql_bm25(_PHRASES)}, {_Q7},
v AS (SELECT chunk_id, row_number() OVER (ORDER BY d, chunk_id) AS v_rank FROM (SELECT vec_id * 1000 AS chunk_id, {sql_distance('embedding', 'v')} AS d FROM embeddings, q) ORDER BY d, chunk_id LIMIT 30),
b AS (SELECT chunk_id, row_number() OVER (ORDER BY score, chunk_id) AS b_rank FROM bm ORDER BY score, chunk_id LIMIT 30),
fused AS (SELECT chunk_id, v_rank, b_rank, coalesce(1.0::DOUBLE / (60 + v_rank), 0) + coalesce(1.0::DOUBLE / (60 + b_rank), 0) AS s FROM v FULL JOIN b USING (chunk_id))"""


def _fused(spark, sf) -> DataFrame:
    i = index(spark, sf)
    return S._ranks(i, R.literal(query_vector(spark, sf)), _PHRASES, 30)


@query(f"WITH {_FUSED} SELECT chunk_id, v_rank, b_rank, round(s, 6) AS score_rrf FROM fused")
def rrf_fusion(spark, sf):
    return _fused(spark, sf).select("chunk_id", "v_rank", "b_rank", F.round("score_rrf", 6).alias("score_rrf"))


_NORM = "0.55::DOUBLE * coalesce(11.0::DOUBLE / (10 + v_rank), 0) + 0.45::DOUBLE * coalesce(11.0::DOUBLE / (10 + b_rank), 0)"


@query(f"WITH {_FUSED} SELECT chunk_id, round({_NORM}, 9) AS score_normalized FROM fused")
def normalize_scores(spark, sf):
    return _fused(spark, sf).select("chunk_id", F.round(scoring.normalized(F.col("v_rank"), F.col("b_rank"), Display()), 9).alias("score_normalized"))


_MEDIA_SNIPPET = "CASE media_type WHEN 'image' THEN 'Image' WHEN 'pdf' THEN CASE WHEN me = ms + 1 THEN 'PDF page ' || (ms + 1) WHEN me > ms + 1 THEN 'PDF pages ' || (ms + 1) || '–' || me ELSE 'PDF' END END"
_TITLE = r"regexp_replace(regexp_extract(path, '[^/]*$'), '(.)\.[^.]*$', '\1')"


def sql_hits(source: str, limit: int, where: str = "true", media: str = "coalesce(11.0::DOUBLE / (10 + v_rank), 0)") -> str:
    return rf"""SELECT path, {_TITLE} AS title, '' AS heading_path, coalesce({_MEDIA_SNIPPET}, {SNIPPET_SQL}) AS snippet, round(s, 6) AS score, round(s, 6) AS score_rrf,
  round(CASE WHEN media_type = 'text' THEN {_NORM} ELSE {media} END, 9) AS score_normalized, chunk_id, media_type, CASE WHEN media_type = 'pdf' THEN 'application/pdf' END AS mime_type,
  CASE WHEN media_type = 'pdf' THEN ms END AS media_start, CASE WHEN media_type = 'pdf' THEN me END AS media_end, CASE WHEN media_type = 'pdf' THEN 'page' END AS media_unit, truncated
FROM (SELECT *, ltrim(regexp_replace(body, '\s+', ' ', 'g')) AS flat FROM (SELECT *, {BODY_SQL} AS body FROM {source} JOIN idx USING (chunk_id)))
WHERE {where} ORDER BY s DESC, chunk_id LIMIT {limit}"""


def rounded(hits: DataFrame) -> DataFrame:
    return hits.withColumns({"score": r6(F.col("score")), "score_rrf": r6(F.col("score_rrf")), "score_normalized": F.round("score_normalized", 9) + F.lit(0.0)})


@query(f"WITH {_FUSED} {sql_hits('fused', 10)}")
def hybrid_search(spark, sf):
    return rounded(S.search(index(spark, sf), ASKED, query_vector(spark, sf)))


@query(f"WITH {_FUSED} SELECT * FROM ({sql_hits('fused', 20)}) WHERE starts_with(path, 'src1')")
def path_prefix_search(spark, sf):
    return rounded(S.prefix_filter(S.search(index(spark, sf), ASKED, query_vector(spark, sf), 20), "src1"))


@query(f"WITH {_FUSED} SELECT path, chunk_id, content FROM idx JOIN fused USING (chunk_id)")
def hydrate_hits(spark, sf):
    return index(spark, sf).chunks.join(F.broadcast(_fused(spark, sf)), "chunk_id").select("path", "chunk_id", "content")


_ALONE = f"{INDEX_SQL}, {_Q7}, near AS (SELECT chunk_id, d, row_number() OVER (ORDER BY d, chunk_id) AS v_rank, CAST(NULL AS BIGINT) AS b_rank, 1.0::DOUBLE / (60 + row_number() OVER (ORDER BY d, chunk_id)) AS s FROM (SELECT vec_id * 1000 AS chunk_id, {_MEDIA_DISTANCE} AS d FROM embeddings, q WHERE label % 5 IN @types) ORDER BY d, chunk_id LIMIT 30)"


@query(f"WITH {_ALONE.replace('@types', '(1, 3)')} {sql_hits('near', 10)}")
def media_only_search(spark, sf):
    return rounded(S.search(index(spark, sf), ASKED, query_vector(spark, sf), media_only=True, media_types=["image", "audio", "image"]))


LANE = MediaLane(enabled=True, fraction=0.5, gate_image=1.0, gate_pdf=1.0, best_image=0.25, worst_image=1.0, best_pdf=0.35, worst_pdf=1.2)
_SPREAD = "CASE WHEN media_type = 'pdf' THEN least(greatest((1.2::DOUBLE - CAST(d AS DOUBLE)) / (1.2::DOUBLE - 0.35::DOUBLE), 0), 1) ELSE least(greatest((1.0::DOUBLE - CAST(d AS DOUBLE)) / (1.0::DOUBLE - 0.25::DOUBLE), 0), 1) END"


@query(f"WITH {_ALONE.replace('@types', '(1, 2, 3, 4)')} {sql_hits('near', 10, media=_SPREAD)}")
def media_only_by_distance(spark, sf):
    return rounded(S.search(index(spark, sf), ASKED, query_vector(spark, sf), display=Display(lane=LANE), media_only=True))


_NEAR = _ALONE.replace("@types", "(1, 2, 3, 4)").split(f"{_Q7}, ")[1]
_LANE_SQL = f"""WITH RECURSIVE {_FUSED}, {_NEAR},
top AS (SELECT chunk_id, s, media_type FROM idx JOIN fused USING (chunk_id) ORDER BY s DESC, chunk_id LIMIT 10),
r AS (SELECT list({{'id': chunk_id, 'txt': media_type = 'text'}} ORDER BY s DESC, chunk_id) AS l, count(*) AS n, count(*) FILTER (media_type = 'text') AS n_text FROM top),
m AS (SELECT list({{'id': chunk_id, 'txt': false}} ORDER BY d, chunk_id) AS l, count(*) AS n FROM near JOIN idx USING (chunk_id) WHERE media_type <> 'text' AND d <= CAST(1.0 AS FLOAT) AND chunk_id NOT IN (SELECT chunk_id FROM top)),
slots AS (SELECT least(greatest(10 - r.n, 0) + r.n_text, m.n, 5) AS n FROM r, m),
put(i, l) AS (
  SELECT CAST(0 AS BIGINT), l FROM r
  UNION ALL
  SELECT i + 1, list_concat(list_concat(roomy[1 : place], list_value(list_extract(m.l, i + 1))), roomy[place + 1 :])
  FROM (SELECT i, roomy, least(CAST(ceil(10.0 / slots.n) AS BIGINT) * (i + 1) - 1, len(roomy)) AS place FROM (
    SELECT i, CASE WHEN len(l) < 10 THEN l ELSE list_concat(l[1 : last - 1], l[last + 1 :]) END AS roomy FROM (SELECT i, l, list_max(list_transform(range(1, len(l) + 1), lambda k: CASE WHEN l[k].txt THEN k END)) AS last FROM put)), slots WHERE i < slots.n), m),
woven AS (SELECT unnest(l).id AS chunk_id FROM (SELECT l FROM put ORDER BY i DESC LIMIT 1)),
shown AS ({sql_hits('fused', 10)}),
lane AS ({sql_hits('near', 30, media=_SPREAD)})
SELECT * FROM shown WHERE chunk_id IN (SELECT chunk_id FROM woven) UNION ALL SELECT * FROM lane WHERE chunk_id IN (SELECT chunk_id FROM woven) AND chunk_id NOT IN (SELECT chunk_id FROM top)"""


@query(_LANE_SQL)
def media_lane_search(spark, sf):
    return rounded(S.search(index(spark, sf), ASKED, query_vector(spark, sf), display=Display(lane=LANE)))


def _like(spark, sf) -> str:
    return documents(spark, sf).join(table(spark, sf, "embeddings").filter("label % 5 = 0 AND vec_id % 1000 > 1").select(F.col("vec_id").alias("doc_id")), "doc_id").orderBy("doc_id").select("path").first()[0]


_SIMILAR_SQL = rf"""WITH {INDEX_SQL},
chosen AS (SELECT path FROM docs WHERE doc_id = (SELECT min(doc_id) FROM documents JOIN embeddings ON vec_id = doc_id WHERE label % 5 = 0 AND vec_id % 1000 > 1)),
own AS (SELECT * FROM idx WHERE path = (SELECT path FROM chosen)),
bag AS (SELECT coalesce(string_agg(content || ' ', '' ORDER BY chunk_idx), '') AS x FROM (SELECT * FROM own WHERE media_type = 'text' ORDER BY chunk_idx LIMIT 4)),
ph AS (SELECT p, count(*) AS times FROM (
  SELECT unnest(list_transform(list_filter(regexp_extract_all(x, '[\p{{L}}\p{{N}}_-]+'), lambda k: strlen(k) > 1), lambda k: regexp_extract_all(strip_accents(lower(k)), '[\p{{L}}\p{{N}}]+'))) AS p FROM bag) WHERE len(p) > 0 GROUP BY p),
tf AS (
  SELECT chunk_id, [term] AS p, count(*) AS f FROM (SELECT chunk_id, unnest(t) AS term FROM terms) WHERE term IN (SELECT p[1] FROM ph WHERE len(p) = 1) GROUP BY chunk_id, term
  UNION ALL
  SELECT * FROM (SELECT chunk_id, p, len(list_filter(range(1, len(t) - len(p) + 2), lambda i: t[i : i + len(p) - 1] = p)) AS f FROM terms, (SELECT p FROM ph WHERE len(p) > 1) WHERE list_contains(t, p[1])) WHERE f > 0),
df AS (SELECT p, count(*) AS d FROM tf GROUP BY p),
bm AS (SELECT chunk_id, -sum(times * CASE WHEN (n - d + 0.5) / (d + 0.5) > 1 THEN ln((n - d + 0.5) / (d + 0.5)) ELSE 1e-6 END * (f * 2.2) / (f + 1.2 * (0.25 + 0.75 * dl / mean))) AS score
  FROM tf JOIN ph USING (p) JOIN df USING (p) JOIN (SELECT chunk_id, len(t) AS dl FROM terms) USING (chunk_id), stats GROUP BY chunk_id HAVING count(*) = (SELECT count(*) FROM ph)),
mean AS (SELECT i, avg(x) AS x FROM (SELECT unnest(range(1, 65)) AS i, unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings WHERE vec_id * 1000 IN (SELECT chunk_id FROM own)) GROUP BY i),
q AS (SELECT list(CAST(x / (SELECT sqrt(sum(x * x)) FROM mean) AS FLOAT) ORDER BY i) AS v FROM mean),
v AS (SELECT chunk_id, row_number() OVER (ORDER BY d, chunk_id) AS v_rank FROM (SELECT vec_id * 1000 AS chunk_id, {sql_distance('embedding', 'v')} AS d FROM embeddings, q) ORDER BY d, chunk_id LIMIT 30),
b AS (SELECT chunk_id, row_number() OVER (ORDER BY score, chunk_id) AS b_rank FROM bm ORDER BY score, chunk_id LIMIT 30),
fused AS (SELECT chunk_id, v_rank, b_rank, coalesce(1.0::DOUBLE / (60 + v_rank), 0) + coalesce(1.0::DOUBLE / (60 + b_rank), 0) AS s FROM v FULL JOIN b USING (chunk_id))
{sql_hits('fused', 10, where='path <> (SELECT path FROM chosen)')}"""


@query(_SIMILAR_SQL)
def similar_path(spark, sf):
    """Documents like the first one with text and an embedding."""
    return rounded(S.similar(index(spark, sf), _like(spark, sf)))


@query(f"WITH {_Q7} SELECT chunk_id, media_type, gated, round(CASE WHEN media_type <> 'text' THEN {_SPREAD} END, 6) AS display FROM (SELECT *, media_type <> 'text' AND d <= CAST(1.0 AS FLOAT) AS gated FROM (SELECT vec_id * 1000 AS chunk_id, ['text', 'image', 'pdf', 'audio', 'video'][label % 5 + 1] AS media_type, {_MEDIA_DISTANCE} AS d FROM embeddings, q))")
def media_gate(spark, sf):
    q = R.literal(query_vector(spark, sf))
    d = vectors.unit_distance(F.col("embedding"), q)
    e = table(spark, sf, "embeddings").select((F.col("vec_id") * 1000).alias("chunk_id"), F.element_at(F.array(*map(F.lit, MEDIA_OF)), F.col("label") % 5 + 1).alias("media_type"), d.alias("d"))
    return e.select("chunk_id", "media_type", scoring.gate(F.col("d"), F.col("media_type"), LANE).alias("gated"), r6(scoring.media_display(F.col("d"), F.col("media_type"), LANE)).alias("display"))


# What is shown


@query(rf"SELECT doc_id, {SNIPPET_SQL} AS snippet FROM (SELECT *, ltrim(regexp_replace(body, '\s+', ' ', 'g')) AS flat FROM (SELECT doc_id, {BODY_SQL} AS body FROM (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN '# ' || text WHEN doc_id % 4 = 1 THEN '#' || replace(text, chr(10), ' ') ELSE text END AS content FROM documents)))")
def snippet(spark, sf):
    t = F.col("text")
    c = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("# "), t)).when(F.col("doc_id") % 4 == 1, F.concat(F.lit("#"), F.replace(t, F.lit("\n"), F.lit(" ")))).otherwise(t)
    return table(spark, sf, "documents").select("doc_id", text.snippet(c).alias("snippet"))


@query(rf"SELECT doc_id, {_TITLE} AS title FROM (SELECT doc_id, {_PATH} AS path FROM documents)")
def title(spark, sf):
    return _files(spark, sf).select("doc_id", text.title(F.col("path")).alias("title"))


_PAGES = "(SELECT page_id, page_id % 13 AS n, 1 + page_id % 6 AS p FROM pages)"


@query(f"SELECT page_id, s AS start, least(s + p, n) AS \"end\" FROM (SELECT page_id, n, p, unnest(range(0, n, p)) AS s FROM {_PAGES})")
def page_ranges(spark, sf):
    p = table(spark, sf, "pages").select("page_id", F.explode(text.page_ranges(F.col("page_id") % 13, 1 + F.col("page_id") % 6)).alias("r"))
    return p.select("page_id", "r.start", "r.end")


_TAGGED = "(SELECT doc_id, ['text', 'image', 'pdf', 'audio', 'a media type that is longer than the tag'][doc_id % 5 + 1] AS media_type, CASE WHEN doc_id % 11 <> 0 THEN doc_id % 4 - 1 END AS ms, doc_id % 3 + 1 AS me, doc_id % 7 = 0 AS truncated, text, source || '/' || doc_id || '.txt' AS path FROM documents)"


def _tagged(spark, sf) -> DataFrame:
    i = F.col("doc_id")
    kinds = F.array(*map(F.lit, ("text", "image", "pdf", "audio", "a media type that is longer than the tag")))
    return table(spark, sf, "documents").select("doc_id", F.element_at(kinds, (i % 5 + 1).cast("int")).alias("media_type"), F.when(i % 11 != 0, i % 4 - 1).alias("ms"), (i % 3 + 1).alias("me"), (i % 7 == 0).alias("truncated"), "text", F.concat("source", F.lit("/"), i.cast("string"), F.lit(".txt")).alias("path"))


@query(f"SELECT doc_id, {_MEDIA_SNIPPET} AS snippet FROM {_TAGGED}")
def media_snippet(spark, sf):
    return _tagged(spark, sf).select("doc_id", text.media_snippet(F.col("media_type"), F.col("ms"), F.col("me")).alias("snippet"))


_RANGE = "CASE WHEN ms >= 0 AND me > ms THEN CASE WHEN me = ms + 1 THEN ' p' || (ms + 1) ELSE ' p' || (ms + 1) || '-' || me END ELSE '' END"
_TAG = f"CASE WHEN media_type = 'text' THEN NULL ELSE '[' || CASE media_type WHEN 'image' THEN 'image' WHEN 'pdf' THEN 'pdf' || {_RANGE} ELSE CASE WHEN length(media_type) <= 24 THEN media_type ELSE media_type[1:21] || '...' END END || CASE WHEN truncated THEN ' truncated' ELSE '' END || ']' END"


@query(f"SELECT doc_id, {_TAG} AS tag FROM {_TAGGED}")
def media_tag(spark, sf):
    return _tagged(spark, sf).select("doc_id", text.media_tag(F.col("media_type"), F.col("ms"), F.col("me"), F.col("truncated")).alias("tag"))


@query(rf"SELECT doc_id, concat_ws(chr(10) || '        ', (doc_id + 1) || '. ' || printf('%.2f', (doc_id % 101) / 100.0) || '  ' || path || ' › ' || media_type, {_TAG}, CASE WHEN length(line) <= 72 THEN line ELSE line[1:69] || '...' END) AS line FROM (SELECT *, regexp_replace(text, '\s+', ' ', 'g') AS line FROM {_TAGGED})")
def cli_format_hit(spark, sf):
    i = F.col("doc_id")
    t = text.media_tag(F.col("media_type"), F.col("ms"), F.col("me"), F.col("truncated"))
    flat = F.regexp_replace("text", r"\s+", " ")
    return _tagged(spark, sf).select("doc_id", text.format_hit(i + 1, (i % 101) / 100.0, F.col("path"), F.col("media_type"), flat, t).alias("line"))


# The change feed: a user's events are a file's

_EVENTS = "(SELECT CAST(user_id AS VARCHAR) AS path, event_type AS kind, ts FROM events)"


def _events(spark, sf) -> DataFrame:
    e = table(spark, sf, "events")
    return e.select(F.col("user_id").cast("string").alias("path"), F.col("event_type").alias("kind"), F.col("ts").cast("timestamp").alias("ts"))


@query(f"""WITH e AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY path ORDER BY ts) <= INTERVAL 1 HOUR THEN 0 ELSE 1 END AS opens FROM {_EVENTS}),
s AS (SELECT *, sum(opens) OVER (PARTITION BY path ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM e)
SELECT path, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) + 3600000000 AS end_us, count(*) AS n_events FROM s GROUP BY path, n""")
def debounce_sessions(spark, sf):
    s = feed.debounced(_events(spark, sf), "1 hour")
    return s.select("path", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n_events")


@query(f"SELECT DISTINCT path FROM {_EVENTS}")
def dedupe_burst(spark, sf):
    return feed.pending(_events(spark, sf))


@query(f"SELECT path, kind, count(*) AS n FROM {_EVENTS} WHERE kind IN ('view', 'purchase', 'error') GROUP BY ALL")
def event_filter(spark, sf):
    return feed.relevant(_events(spark, sf), ("view", "purchase", "error")).groupBy("path", "kind").agg(F.count("*").alias("n"))


@query(f"SELECT path, epoch_us(max(ts)) AS last_us FROM {_EVENTS} GROUP BY path")
def change_feed_latest(spark, sf):
    return feed.latest_change(_events(spark, sf)).select("path", F.unix_micros("ts").alias("last_us"))


# Tables replaced by key

_ROWS = "SELECT source || '/' || lang AS path, doc_id, length(text) AS n FROM documents"


def _rows(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").select(F.concat_ws("/", "source", "lang").alias("path"), "doc_id", F.length("text").cast("long").alias("n"))


@query(f"SELECT * FROM ({_ROWS}) WHERE path NOT LIKE '%/de' UNION ALL SELECT path, doc_id + 1000000, n + 1 FROM ({_ROWS}) WHERE path LIKE '%/de' AND doc_id % 2 = 0")
def replace_by_key(spark, sf):
    rows = _rows(spark, sf)
    new = rows.filter("path LIKE '%/de' AND doc_id % 2 = 0").select("path", (F.col("doc_id") + 1000000).alias("doc_id"), (F.col("n") + 1).alias("n"))
    return ingest.replace_by_path(rows, new, rows.filter("path LIKE '%/de'"))


@query(f"SELECT * FROM ({_ROWS}) WHERE path NOT LIKE '%/fr'")
def remove_paths(spark, sf):
    rows = _rows(spark, sf)
    return ingest.remove_paths(rows, rows.filter("path LIKE '%/fr'"))


@query(f"SELECT path, doc_id, CASE WHEN doc_id % 3 = 0 THEN -n ELSE n END AS n FROM ({_ROWS})")
def upsert_rows(spark, sf):
    rows = _rows(spark, sf)
    return ingest.upsert(rows, rows.filter("doc_id % 3 = 0").withColumn("n", -F.col("n")), ["path", "doc_id"])


_ABSOLUTE = "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '/vault/' || source || '/' || doc_id WHEN 1 THEN source || '/' || doc_id ELSE '/vault_2/' || doc_id END AS path FROM documents"


def _absolute(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.expr("CASE doc_id % 3 WHEN 0 THEN '/vault/' || source || '/' || doc_id WHEN 1 THEN source || '/' || doc_id ELSE '/vault_2/' || doc_id END").alias("path"))


@query(f"SELECT doc_id, CASE WHEN starts_with(path, '/vault/') THEN path[8:] ELSE path END AS path FROM ({_ABSOLUTE})")
def migrate_relative_paths(spark, sf):
    return ingest.relativised(_absolute(spark, sf), "/vault")


_STORED = "SELECT CASE page_id % 5 WHEN 0 THEN '/vault/p/' || page_id WHEN 1 THEN '/vault' WHEN 2 THEN '/elsewhere/' || page_id ELSE 'p/' || page_id END AS path FROM pages"


@query(f"SELECT count(*) FILTER (starts_with(path, '/') AND NOT starts_with(path, '/vault/')) AS offenders FROM (SELECT path FROM ({_ABSOLUTE}) UNION ALL {_STORED})")
def offender_count(spark, sf):
    files = table(spark, sf, "pages").select(F.expr(_STORED[len("SELECT ") : _STORED.index(" AS path")]).alias("path"))
    return ingest.offenders(_absolute(spark, sf), files, "/vault/")


@query("""SELECT doc_id, CASE WHEN provider IS NULL OR model IS NULL OR dim IS NULL THEN 'fresh' WHEN provider = 'src1' AND model = 'en' AND dim = '1' THEN 'match' ELSE 'mismatch' END AS outcome
FROM (SELECT doc_id, CASE WHEN doc_id % 5 > 0 THEN source END AS provider, CASE WHEN doc_id % 7 > 0 THEN lang END AS model, CASE WHEN doc_id % 3 > 0 THEN CAST(doc_id % 3 AS VARCHAR) END AS dim FROM documents)""")
def fingerprint_check(spark, sf):
    """The guard over the settings of many indexes: a row is what one has stored."""
    i = F.col("doc_id")
    stored = table(spark, sf, "documents").select("doc_id", F.when(i % 5 > 0, F.col("source")).alias("provider"), F.when(i % 7 > 0, F.col("lang")).alias("model"), F.when(i % 3 > 0, (i % 3).cast("string")).alias("dim"))
    return stored.select("doc_id", fingerprint_of(F.col("provider"), F.col("model"), F.col("dim"), "src1", "en", 1).alias("outcome"))


@query("""SELECT doc_id, CASE WHEN len(k) > 0 THEN t[1 : k[1]] ELSE '' END AS text
FROM (SELECT doc_id, t, list_filter(range(0, length(t) + 1), lambda k: strlen(t[1 : k]) = least(strlen(t), 3 + doc_id % 37)) AS k FROM (SELECT doc_id, coalesce(text, '')[1:60] AS t FROM documents))""")
def utf8_text(spark, sf):
    """Bytes that are cut anywhere: where a character is cut through, they are no UTF-8, and there is no text."""
    t = F.substring(F.coalesce("text", F.lit("")), 1, 60).cast("binary")
    cut = table(spark, sf, "documents").select("doc_id", F.substring(t, F.lit(1), (3 + F.col("doc_id") % 37).cast("int")).alias("data"))
    return cut.select("doc_id", text_of("data").alias("text"))


#: First bytes of formats, of near misses, and of nothing known.
_HEADS = ("255044462D312E37", "89504E470D0A1A0A0000", "FFD8FFE000104A464946", "474946383961", "474946383761", "524946460000000057454250", "5249464600000000574156450000", "255064662D", "89504E470D0A1A", "")


@query(f"SELECT page_id, [{', '.join(['NULL' if m is None else repr(m) for m in ('application/pdf', 'image/png', 'image/jpeg', 'image/gif', 'image/gif', 'image/webp', None, None, None, None)])}][page_id % 10 + 1] AS mime FROM pages")
def media_sniff(spark, sf):
    heads = F.array(*[F.lit(h) for h in _HEADS])
    data = F.concat(F.unhex(F.element_at(heads, (F.col("page_id") % 10 + 1).cast("int"))), F.coalesce("html", F.lit("")).cast("binary"))
    return table(spark, sf, "pages").select("page_id", policy.sniffed(data).alias("mime"))


_FAKE_SQL = r"""WITH t AS (SELECT DISTINCT sha256(text) AS content_hash, coalesce(text, '') AS content FROM documents WHERE text IS NOT NULL),
h AS (SELECT content_hash, b, sha256('document\x00text\x00'::BLOB || encode(content) || unhex(printf('%02x', b * 8) || '00000000000000')) AS x FROM t, (SELECT unnest(range(0, 8)) AS b)),
v AS (SELECT content_hash, b * 8 + k AS i, CAST((CASE WHEN n > 32767 THEN n - 65536 ELSE n END) / 32768.0::DOUBLE AS FLOAT) AS x FROM (SELECT content_hash, b, k, CAST('0x' || x[4 * k + 1 : 4 * k + 4] AS INTEGER) AS n FROM h, (SELECT unnest(range(0, 8)) AS k))),
s AS (SELECT content_hash, CAST(sqrt(sum(CAST(x AS DOUBLE) * CAST(x AS DOUBLE))) AS FLOAT) AS s FROM v GROUP BY 1)
SELECT content_hash, CAST(i AS BIGINT) AS i, round(CAST(x / s AS DOUBLE), 6) + 0.0 AS x FROM v JOIN s USING (content_hash)"""


@query(_FAKE_SQL)
def fake_embed(spark, sf):
    """Deterministic vectors from hashes of the texts."""
    d = table(spark, sf, "documents").filter("text IS NOT NULL").select(F.sha2("text", 256).alias("content_hash"), F.col("text").alias("content")).dropDuplicates(["content_hash"])
    return embed.embedded(d, embed.Fake(64)).select("content_hash", F.posexplode("embedding").alias("i", "x")).select("content_hash", F.col("i").cast("long").alias("i"), r6(F.col("x").cast("double")).alias("x"))


@query("""SELECT page_id, sha256(CAST(encode('media-v1') || '\\x00'::BLOB || encode('image') || '\\x00'::BLOB || encode('multipart') || '\\x00'::BLOB
  || '\\x01\\x00\\x00\\x00\\x00\\x00\\x00\\x00\\x09\\x00\\x00\\x00\\x00\\x00\\x00\\x00'::BLOB || encode('image/png') || unhex(z[7:8] || z[5:6] || z[3:4] || z[1:2] || '00000000') || encode(h) AS BLOB)) AS cache_key
FROM (SELECT page_id, coalesce(html, '') AS h, printf('%08x', strlen(coalesce(html, ''))) AS z FROM pages)""")
def media_cache_key(spark, sf):
    return table(spark, sf, "pages").select("page_id", policy.cache_key_of("image", "image/png", F.coalesce("html", F.lit("")).cast("binary")).alias("cache_key"))


@query(f"SELECT path, kind FROM (SELECT p AS path, kind, is_file, {_KIND} AS k, {_SAFE} AS safe FROM (SELECT {_PATH} AS p, ['create', 'modify', 'remove', 'access'][doc_id % 4 + 1] AS kind, doc_id % 13 > 0 AS is_file FROM documents)) WHERE safe AND k IS NOT NULL AND kind <> 'access' AND (kind = 'remove' OR is_file)")
def watch_relevance(spark, sf):
    i = F.col("doc_id")
    kinds = F.array(*map(F.lit, ("create", "modify", "remove", "access")))
    events = _files(spark, sf).select("path", F.element_at(kinds, (i % 4 + 1).cast("int")).alias("kind"), (i % 13 > 0).alias("is_file"))
    return feed.relevant(events, options=MediaOptions(enabled=True)).select("path", "kind")


@query(f"SELECT path FROM ({_DIFF}) WHERE status <> 'unchanged' UNION SELECT source || '/' || lang || '/' || doc_id || '.txt' FROM documents WHERE doc_id IN (SELECT user_id FROM events)")
def dirty_union(spark, sf):
    scan, files = _states(spark, sf)
    touched = documents(spark, sf).join(table(spark, sf, "events").select(F.col("user_id").alias("doc_id")), "doc_id", "left_semi")
    return feed.dirty_union(ingest.dirty(scan, files), ingest.pruned(scan, files), touched)


@query(f"SELECT epoch_ms(max(ts)) AS last_change_ms FROM {_EVENTS} WHERE kind IN ('purchase', 'error')")
def last_change(spark, sf):
    return feed.last_change(feed.relevant(_events(spark, sf), ("purchase", "error")))


_HEADED = "en that"


_HEADED_SQL = INDEX_SQL.replace("lower(content)", "lower(content || ' ' || heading)").replace("SELECT c.*,", "SELECT c.*, split_part(path, '/', 1) || ' ' || split_part(path, '/', 2) AS heading,")


@query(f"WITH {_HEADED_SQL}, {sql_bm25(R.phrases_of(_HEADED))} SELECT chunk_id, round(score, 6) + 0.0 AS score FROM bm ORDER BY bm.score, chunk_id LIMIT 30")
def bm25_heading(spark, sf):
    """Ranking with a heading column: source and language stand in for it."""
    return R.bm25(_headed(spark, sf, False), R.phrases_of(_HEADED), 30).withColumn("score", r6(F.col("score")))


def _headed(spark, sf, stem: bool) -> DataFrame:
    part = lambda n: F.split_part("path", F.lit("/"), F.lit(n))
    c = index(spark, sf).chunks.filter("media_type = 'text'").withColumn("heading_path", F.concat_ws(" ", part(1), part(2)))
    return R.indexed(c, stem=stem)


@query()
def bm25_stemmed(spark, sf):
    """The same on stems.  SQL has no stemmer here; a test holds it against brute force."""
    return R.bm25(_headed(spark, sf, True), R.phrases_of("handing thats en", True), 30).withColumn("score", r6(F.col("score")))


@query(f"WITH {CHUNKS_SQL} SELECT path, chunk_idx, content FROM chunks WHERE path = (SELECT min(path) FROM docs)")
def chunks_for_path(spark, sf):
    c = plain_chunks(spark, sf)
    first = documents(spark, sf).agg(F.min("path").alias("path"))
    return c.join(F.broadcast(first), "path").orderBy("chunk_idx").select("path", "chunk_idx", "content")


@query(f"WITH {INDEX_SQL} SELECT media_type, count(*) AS n FROM idx GROUP BY 1")
def media_counts(spark, sf):
    return index(spark, sf).chunks.groupBy("media_type").agg(F.count("*").alias("n"))


@query(f"""WITH {INDEX_SQL}, a AS (SELECT path, content, row_number() OVER (PARTITION BY path ORDER BY chunk_idx) AS n FROM idx WHERE media_type = 'text')
SELECT path, sha256(string_agg(content || ' ', '' ORDER BY n)) AS bag_sha256 FROM a WHERE n <= 4 GROUP BY path""")
def similar_bag(spark, sf):
    """The text that stands for a document in a similarity search: its first four text chunks."""
    from pyspark.sql import Window

    t = index(spark, sf).chunks.filter("media_type = 'text'").withColumn("n", F.row_number().over(Window.partitionBy("path").orderBy("chunk_idx"))).filter("n <= 4")
    bag = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_idx", "content"))), lambda s: F.concat(s.content, F.lit(" "))), "")
    return t.groupBy("path").agg(F.sha2(bag, 256).alias("bag_sha256"))
