"""The registered queries of the training-data operators: thin layers that give each operator its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, decontam, html_text, langid, neardup, packing, quality, secrets, suffixes, warc
from .common import table

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def held_out(n: int, residue: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(n)) == residue


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html_text.main_text(pages, html_text.fit(pages)).withColumnRenamed("id", "page_id")


def op3_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = neardup.classes(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "class_id", (F.col("id") == F.col("class_id")).alias("kept"))


def op4_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffixes.deduplicated(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
    return out.drop("removed")  # not in the SQL


def op5_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontam.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.drop("hit_words")  # not in the SQL


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read(warc.write(table(spark, sf_dir, "pages"))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs, ~held_out(3, 1))
    out = langid.predict(docs, model)
    return out.select(F.col("id").alias("doc_id"), held_out_of("id", 3, 1).alias("held_out"), "lang_pred", "score", "ambiguous")


def held_out_of(column: str, n: int, residue: int):
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(n)) == residue


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"), ~held_out(5, 0))
    out = quality.score(docs, model)
    return out.select(F.col("id").alias("doc_id"), held_out_of("id", 5, 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), VOCABULARY).withColumnRenamed("id", "doc_id")


#: Strings of 50 bytes as 100 hexadecimal digits, in blocks of 256 places, since places far into a text are slow to reach.
OP4_SQL = r"""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b, hex(encode(coalesce(text, ''))) AS x FROM documents),
o AS (SELECT doc_id, j, substr(x, 512 * j + 1, 610) AS x FROM (SELECT doc_id, x, unnest(range(0, CAST(len(x) AS BIGINT), 512) ) // 512 AS j FROM d WHERE len(x) >= 100)),
w AS (SELECT doc_id, 256 * j + p AS p, substr(x, 2 * p + 1, 100) AS s FROM (SELECT doc_id, j, x, unnest(range(0, least(256, CAST(len(x) / 2 AS BIGINT) - 49))) AS p FROM o WHERE len(x) >= 100)),
f AS (SELECT s, min(doc_id) AS first FROM w GROUP BY s HAVING count(*) > 1),
h AS (SELECT doc_id, p FROM w JOIN f USING (s) WHERE first < doc_id),
g AS (SELECT doc_id, p, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= 50 THEN 0 ELSE 1 END AS opens FROM h),
r AS (SELECT doc_id, min(p) AS a, max(p) + 50 AS e FROM (SELECT doc_id, p, sum(opens) OVER (PARTITION BY doc_id ORDER BY p ROWS UNBOUNDED PRECEDING) AS n FROM g) GROUP BY doc_id, n),
k AS (SELECT doc_id, e AS a, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS e FROM r UNION ALL SELECT doc_id, 0, min(a) FROM r GROUP BY doc_id),
t AS (SELECT doc_id, string_agg(x[2 * a + 1 : coalesce(2 * e, len(x))], '' ORDER BY a) AS kept FROM k JOIN d USING (doc_id) GROUP BY doc_id),
c AS (SELECT doc_id, sum(e - a) AS n, count(*) AS spans FROM r GROUP BY doc_id)
SELECT doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(coalesce(unhex(kept), b)) AS kept_sha256
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""

OP5_SQL = r"""
WITH b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w
  FROM benchmark WHERE text IS NOT NULL),
bw AS (
  SELECT DISTINCT item_id, least(len(w), 13) n, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') k
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) i FROM b WHERE len(w) > 0)),
d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w
  FROM documents),
dw AS (
  SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') k
  FROM (SELECT doc_id, w, l.n n, unnest(range(1, len(w) - l.n + 2)) i FROM d, (SELECT DISTINCT n FROM bw) l WHERE len(w) >= l.n)),
h AS (SELECT doc_id, i, dw.n n, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.k = bw.k),
p AS (SELECT doc_id, count(DISTINCT j) n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) j FROM h) GROUP BY 1),
t AS (SELECT doc_id, count(*) n_items, string_agg(s, ',' ORDER BY s) c FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) s FROM h) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items, sha256(coalesce(c, '')) items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN t USING (doc_id)
"""

OP6_SQL = r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS h FROM p),
f AS (SELECT h, min(page_id) AS first FROM d GROUP BY h),
z AS (SELECT d.*, first, array_to_string(list_transform(string_split(h, ''), lambda c: lpad(bin(CAST('0x' || c AS INTEGER)), 4, '0')), '') AS bits FROM d JOIN f USING (h))
SELECT page_id, n AS payload_bytes, array_to_string(list_transform(range(0, 32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST('0b' || substr(bits, 5 * j + 1, 5) AS INTEGER), 1)), '') AS payload_digest,
  CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to
FROM z
"""

QUERIES = {"op1_ann": op1_ann, "op2_html": op2_html, "op3_neardup": op3_neardup, "op4_suffixes": op4_suffixes, "op5_decontam": op5_decontam, "op6_warc": op6_warc, "op7_langid": op7_langid, "op8_secrets": op8_secrets, "op9_quality": op9_quality, "op10_packing": op10_packing}
ORACLE_SQL = {"op4_suffixes": OP4_SQL, "op5_decontam": OP5_SQL, "op6_warc": OP6_SQL}
