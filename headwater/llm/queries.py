"""One query per operator, over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as c
from .bpe import encode_bpe
from .decontaminate import decontaminate
from .idstore import read_digests, write_store
from .licenses import scan_licenses
from .secrets import scan_secrets
from .simhash import near_duplicates
from .token_counts import count_tokens
from .topk import top_k
from .toxicity import score_toxicity
from .warc import read_warc, resolve_revisits, write_warc


def op1_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = c.table(spark, sf_dir, "pages")
    path = c.scratch_path(spark, "warc")
    write_warc(resolve_revisits(pages.select(F.col("page_id").alias("id"), "url", F.col("html").alias("payload"))), path)
    back = read_warc(spark, path)
    return back.select(F.col("id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


def op2_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(c.table(spark, sf_dir, "embeddings"))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(c.table(spark, sf_dir, "documents"), c.table(spark, sf_dir, "benchmark"))


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(c.table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(c.table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(c.table(spark, sf_dir, "documents"), c.table(spark, sf_dir, "labels"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_bpe(c.table(spark, sf_dir, "documents"), output="digests")


def op8_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(c.table(spark, sf_dir, "documents"))


def op9_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(c.table(spark, sf_dir, "documents"))


def op10_id_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = c.scratch_path(spark, "store")
    write_store(c.table(spark, sf_dir, "documents"), path)
    return read_digests(spark, path)


def queries() -> dict:
    return {
        "op1_warc_revisits": op1_warc_revisits,
        "op2_exact_top_k": op2_exact_top_k,
        "op3_benchmark_decontamination": op3_benchmark_decontamination,
        "op4_secret_scans": op4_secret_scans,
        "op5_token_counts": op5_token_counts,
        "op6_toxicity": op6_toxicity,
        "op7_byte_bpe": op7_byte_bpe,
        "op8_license_scans": op8_license_scans,
        "op9_simhash_near_duplicates": op9_simhash_near_duplicates,
        "op10_id_store": op10_id_store,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_warc_revisits": OP1_SQL, "op2_exact_top_k": OP2_SQL, "op3_benchmark_decontamination": OP3_SQL}


OP2_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, d.vec_id, CAST(list_inner_product(q.e, d.e) AS BIGINT) AS score
  FROM v q JOIN v d ON q.vec_id <> d.vec_id AND len(q.e) = len(d.e) WHERE q.vec_id % 20 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

OP1_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h) AS payload_bytes, sha1(h) AS x FROM p),
b AS (
  SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 8), lambda i: list_reduce(list_transform([15, 10, 5, 0],
    lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(x, CAST(1 + 5 * i AS INTEGER), 5) AS BIGINT) >> s) & 31 AS INTEGER), 1)), lambda a, c: a || c)), '') AS payload_digest
  FROM d),
f AS (SELECT payload_digest, payload_bytes, min(page_id) AS first_id FROM b GROUP BY ALL)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id = first_id OR first_id IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM b JOIN f USING (payload_digest, payload_bytes)
"""

WORDS_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: Windows as lists of words, joined by equality with those of each document.
OP3_SQL = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS k, doc_id, {WORDS_SQL} AS w FROM documents),
b AS MATERIALIZED (SELECT item_id, w, len(w) AS n, least(10, len(w)) AS size FROM (SELECT item_id, {WORDS_SQL} AS w FROM benchmark) WHERE len(w) > 0),
windows AS MATERIALIZED (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, size, array_to_string(w[s:s + size - 1], ' ') AS g FROM (SELECT *, unnest(range(1, n - size + 2)) AS s FROM b)),
sizes AS (SELECT DISTINCT size FROM windows),
grams AS (SELECT k, s, size, array_to_string(w[s:s + size - 1], ' ') AS g FROM (SELECT k, w, size, unnest(range(1, len(w) - size + 2)) AS s FROM d CROSS JOIN sizes WHERE len(w) >= size)),
found AS MATERIALIZED (SELECT DISTINCT k, s, grams.size AS size, item FROM grams JOIN windows USING (g)),
hits AS (SELECT k, count(DISTINCT p) AS n_hit FROM (SELECT k, unnest(range(s, s + size)) AS p FROM found) GROUP BY k),
items AS (SELECT k, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT k, item FROM found WHERE item IS NOT NULL) GROUP BY k)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN hits USING (k) LEFT JOIN items USING (k)
"""
