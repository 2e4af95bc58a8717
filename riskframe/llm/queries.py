"""Registered queries of the operators: ``{key: (callable, SQL twin or None)}``.

Each applies its operator to its whole table and derives the columns asked for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from riskframe.llm import (
    archive, bpe, fingerprints, near_text, near_vectors, packing, personal, quality, secret_spans, toxicity,
    url_filter, vector_codes, whitening,
)  # fmt: skip
from riskframe.llm.common import read

TOKENIZER = "byte_bpe_50k.json"
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_legacy_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive.archive_pages(read(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op2_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.near_vectors(read(spark, sf_dir, "embeddings"), cosine=0.98)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op4_near_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_text.near_duplicates(read(spark, sf_dir, "documents"), size=3, percent=85)


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_spans.secret_spans(read(spark, sf_dir, "documents"), vocabulary=tokenizer_path())


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.personal_spans(read(spark, sf_dir, "documents"))


def op7_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(read(spark, sf_dir, "documents"), tokenizer_path())


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"), tokenizer_path(), capacity=2048, end=0)


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(read(spark, sf_dir, "pages"), RULES).select(
        "page_id", "host", "path", "rule", "verdict"
    )


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge_quality(read(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress_vectors(read(spark, sf_dir, "embeddings"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten_vectors(read(spark, sf_dir, "embeddings"))


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_documents(read(spark, sf_dir, "documents"))


#: Four rounds over four parts: each round assigns and moves, as the operator does.
_CODES_ROUND = """
a{k} AS MATERIALIZED (
  SELECT p.vec_id, p.part, arg_min(c.entry, (d.gap, c.entry)) AS entry, min(d.gap) AS gap
  FROM parts p JOIN c{k} c USING (part),
    LATERAL (SELECT list_sum(list_transform(range(1, len(p.x) + 1), lambda i: (p.x[i] - c.c[i]) * (p.x[i] - c.c[i])))::BIGINT AS gap) d
  GROUP BY p.vec_id, p.part)"""
_CODES_MOVE = """
c{n} AS MATERIALIZED (
  SELECT c.part, c.entry, coalesce(m.c, c.c) AS c
  FROM c{k} c LEFT JOIN (
    SELECT part, entry, list(mean ORDER BY pos) AS c FROM (
      SELECT a.part, a.entry, i.pos, CAST(floor(sum(p.x[i.pos]) / count(*)) AS BIGINT) AS mean
      FROM a{k} a JOIN parts p USING (vec_id, part), (SELECT unnest(range(1, 17)) AS pos) i
      GROUP BY a.part, a.entry, i.pos) GROUP BY part, entry) m USING (part, entry))"""
CODES_SQL = (
    """
WITH kept AS MATERIALIZED (
  SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) AS r,
    list_transform(embedding, lambda v: CAST(floor(1024 * CAST(v AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
parts AS MATERIALIZED (
  SELECT vec_id, r, part, x[part * 16 + 1 : part * 16 + 16] AS x FROM kept, (SELECT unnest(range(4)) AS part)),
c0 AS MATERIALIZED (SELECT part, r - 1 AS entry, x AS c FROM parts WHERE r <= 256),"""
    + ",".join(_CODES_ROUND.format(k=k) + ("," + _CODES_MOVE.format(k=k, n=k + 1) if k < 4 else "") for k in range(5))
    + """,
coded AS (
  SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(gap) AS BIGINT) AS error
  FROM a4 GROUP BY vec_id)
SELECT k.vec_id, c.code, c.error, CAST(sum(c.error) OVER (PARTITION BY k.label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) FROM c4) AS codebooks_sha256
FROM kept k JOIN coded c USING (vec_id)"""
)

FINGERPRINT_SQL = r"""
WITH own AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n FROM documents),
chained AS (
  SELECT doc_id, t, n, coalesce(lead(t) OVER w, first_value(t) OVER (ORDER BY doc_id DESC)) AS follow
  FROM own WINDOW w AS (ORDER BY doc_id DESC)),
edits AS (
  SELECT *, substring(t, 1, n - n // 3) || substring(follow, 1, n // 3) AS e FROM chained),
texts AS MATERIALIZED (SELECT DISTINCT unnest([t, e, follow]) AS t FROM edits),
worded AS (
  SELECT t, regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	

]+') AS w FROM texts),
sketched AS MATERIALIZED (
  SELECT t, len(w) AS words, list_sort(list_distinct(list_filter(
    CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: substring(md5(array_to_string(w[i:i+4], ' ')), 1, 16))
         WHEN len(w) > 0 THEN [substring(md5(array_to_string(w, ' ')), 1, 16)] ELSE [] END, lambda h: h < '2'))) AS s
  FROM worded),
met AS (
  SELECT e.doc_id, e.n, e.e, a.words AS aw, a.s AS a, b.words AS bw, b.s AS b, c.words AS cw, c.s AS c
  FROM edits e JOIN sketched a ON a.t = e.t JOIN sketched b ON b.t = e.e JOIN sketched c ON c.t = e.follow)
SELECT doc_id, n AS n_chars, sha256(e) AS edited_sha256,
  aw || ':' || array_to_string(a, ',') AS fingerprint, bw || ':' || array_to_string(b, ',') AS edited_fingerprint,
  CASE WHEN least(len(a), len(b)) > 0 THEN len(list_intersect(a, b))::DOUBLE / least(len(a), len(b))::DOUBLE
       WHEN len(a) + len(b) = 0 AND aw = bw THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS near_edited,
  CASE WHEN least(len(a), len(c)) > 0 THEN len(list_intersect(a, c))::DOUBLE / least(len(a), len(c))::DOUBLE
       WHEN len(a) + len(c) = 0 AND aw = cw THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS near_next
FROM met"""


QUERIES = {
    "op1_legacy_archives": (op1_legacy_archives, None),
    "op2_near_vectors": (op2_near_vectors, None),
    "op3_toxicity": (op3_toxicity, None),
    "op4_near_texts": (op4_near_texts, None),
    "op5_secrets": (op5_secrets, None),
    "op6_personal_data": (op6_personal_data, None),
    "op7_bpe_round_trip": (op7_bpe_round_trip, None),
    "op8_packing": (op8_packing, None),
    "op9_url_filter": (op9_url_filter, None),
    "op10_quality": (op10_quality, None),
    "op11_vector_codes": (op11_vector_codes, CODES_SQL),
    "op12_whitening": (op12_whitening, None),
    "op13_fingerprints": (op13_fingerprints, FINGERPRINT_SQL),
}
