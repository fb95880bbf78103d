"""The queries that apply each operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, bpe, chat_format, decontam, embed_dedup, filter_audit, html_extract, line_dedup, lm_score, ngram_join, quality, token_counts, toxicity
from .common import Scratch


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(_table(spark, sf_dir, "documents").select("doc_id", "text"))


#: Shingles as text, counted pair by pair; then what links reach.
OP1_SQL = """
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
  FROM words
), shingles AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
)
SELECT sets.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, min(reach.b) AS component_id
FROM sets JOIN reach ON reach.a = sets.doc_id GROUP BY sets.doc_id, len(s)
"""


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = bpe.encode_documents(_table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"))
    return bpe.digests(encoded, "doc_id")


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"))


OP3_SQL = """
WITH RECURSIVE good AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
), unit AS (
  SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS norm FROM good
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM unit a JOIN unit b ON a.vec_id <> b.vec_id
  WHERE list_dot_product(a.v, b.v) / (a.norm * b.norm) >= 0.95
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
), root AS (
  SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a
)
SELECT root.vec_id, CAST((SELECT count(*) FROM links WHERE links.a = root.vec_id) AS BIGINT) AS n_links, component_id, root.vec_id = component_id AS kept
FROM root
"""


def _held_out(remainder: int, of: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % of == remainder


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = _table(spark, sf_dir, "documents"), _held_out(2, 4)
    net = quality.fit(docs, _table(spark, sf_dir, "labels").where(~held))
    scored = quality.score_documents(docs, net)
    return scored.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= quality.LEAST).cast("int").alias("predicted"))


def op5_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document and item that it leaks."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontam.find_leaks(docs, _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.*")


def op6_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_extract.extract_pages(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = _table(spark, sf_dir, "documents"), _held_out(0, 5)
    index = toxicity.fit(docs, _table(spark, sf_dir, "labels").where(~held))
    scored = toxicity.score_documents(docs, index)
    return scored.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat_format.digests(chat_format.format_turns(rows.unionByName(probe)))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("part"), "text")
    return filter_audit.audit(docs, _table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"))


#: Each document's failures as booleans, and each order by walking its steps.
OP11_SQL = """
WITH words AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), known AS (
  SELECT doc_id, max(quality) = 1 AS good, max(toxic) = 1 AS bad FROM labels GROUP BY doc_id
), firsts AS (
  SELECT coalesce(text, '') AS t, min(doc_id) AS first_id FROM documents GROUP BY 1
), flags AS (
  SELECT words.doc_id, part, coalesce(good, false) AS good, coalesce(bad, false) AS bad,
    MAP {'A': len(w) < 200, 'B': 100 * len(list_distinct(w)) < 50 * len(w),
         'C': 100 * length(regexp_replace(words.t, '[^A-Z]', '', 'g')) > 3 * length(words.t), 'D': regexp_matches(words.t, '[#$%&*|]'),
         'E': coalesce(words.doc_id > first_id, false)} AS f
  FROM words JOIN firsts ON firsts.t = words.t LEFT JOIN known ON known.doc_id = words.doc_id
), l AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS o FROM l a, l b, l c, l d, l e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), steps AS (
  SELECT o, unnest(range(1, 6)) AS s FROM orders
), kinds AS (
  SELECT part, f, count(*) AS n, count(*) FILTER (WHERE good) AS n_good, count(*) FILTER (WHERE bad) AS n_bad FROM flags GROUP BY part, f
), walked AS (
  SELECT part, o, s, f, n, n_good, n_bad, f[o[s]] AS fails, len(list_filter(range(1, s), lambda i: f[o[i]])) > 0 AS gone,
    len(list_filter(['A', 'B', 'C', 'D', 'E'], lambda x: f[x])) AS failures
  FROM kinds, steps
), counted AS (
  SELECT part, o AS filter_order, CAST(s AS INTEGER) AS step, o[s] AS x,
    sum(n) FILTER (WHERE NOT gone AND NOT fails) AS kept, sum(n) FILTER (WHERE fails AND NOT gone) AS removed,
    sum(n) FILTER (WHERE fails AND gone) AS redundant, sum(n) FILTER (WHERE fails AND failures = 1) AS unique_fails,
    sum(n_good) FILTER (WHERE fails AND NOT gone) AS good_lost, sum(n_bad) FILTER (WHERE fails AND NOT gone) AS toxic_lost
  FROM walked GROUP BY part, o, s
)
SELECT part, filter_order, step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed,
  CAST(coalesce(redundant, 0) AS BIGINT) AS redundant, CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails,
  CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
  CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, x) AS BIGINT) AS shapley
FROM counted
"""


def op12_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.coalesce(_held_out(0, 10), F.lit(False)).alias("held_out"), "text")
    scratch = Scratch(spark, "lm")
    model = lm_score.fit(docs.select((~F.col("held_out")).alias("train"), "text"), _tokenizer("piece_bpe_32k.model"), scratch)
    return lm_score.score_documents(docs, model, scratch, keep=("doc_id", "held_out"))


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.align_documents(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"), _tokenizer("piece_bpe_32k.model"))


QUERIES = {
    "op1_ngram_join": op1_ngram_join,
    "op2_bpe": op2_bpe,
    "op3_embedding_dedup": op3_embedding_dedup,
    "op4_quality": op4_quality,
    "op5_decontam": op5_decontam,
    "op6_html_extract": op6_html_extract,
    "op7_line_dedup": op7_line_dedup,
    "op8_chat_format": op8_chat_format,
    "op9_token_counts": op9_token_counts,
    "op10_toxicity": op10_toxicity,
    "op11_filter_audit": op11_filter_audit,
    "op12_lm_score": op12_lm_score,
    "op13_tokenizer_alignment": op13_tokenizer_alignment,
}

ORACLE_SQL: dict[str, str] = {"op1_ngram_join": OP1_SQL, "op3_embedding_dedup": OP3_SQL, "op11_filter_audit": OP11_SQL}
