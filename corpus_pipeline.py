"""The corpus pipeline: score, take out repeated passages, keep one of each group, take out leaks, encode.

Defined cases of all stages: a null or empty text is scored as an empty one, and repeats, links and leaks nothing; rows without an id
are linked with nothing; of rows that repeat an id one is kept, the one of the smallest columns, as they are one document; an empty table gives an empty one; columns
other than those of documents are dropped, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm import bpe, decontam, line_dedup, ngram_join, quality
from tallyforge.llm.common import Scratch

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A document scored below this is rejected, as by the classifier's own query.
LEAST_QUALITY = quality.LEAST


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on labelled rows of the whole table, doesn't reject.

    A quarter of the labels is held out, as in the classifier's own query.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2)
    net = quality.fit(spark.read.parquet(f"{sf_dir}/documents.parquet"), labels)
    return quality.score_documents(docs, net, keep=COLUMNS).where(F.col("score") >= LEAST_QUALITY).select(*COLUMNS)


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without runs that stood in earlier ones; documents of which nothing is left go."""
    out = line_dedup.dedup_lines(docs.select(*COLUMNS))
    return out.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words"))).select("doc_id", "text", "lang", "source", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of linked ones."""
    docs = docs.select(*COLUMNS)
    groups = ngram_join.jaccard_components(docs.select("doc_id", "text"))
    kept = groups.where("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("rows"))
    kept = Scratch(spark, "kept").table(kept)
    # What is kept grows with the documents, so it isn't broadcast.
    out = docs.join(kept.hint("merge"), "doc_id").select(*COLUMNS, "rows")
    once = out.where("rows = 1").select(*COLUMNS)
    if not kept.where("rows > 1").isEmpty():
        rest = COLUMNS[1:]
        again = out.where("rows > 1").groupBy("doc_id").agg(F.min(F.struct(*rest)).alias("row"))
        once = once.unionByName(again.select("doc_id", "row.*"))
    return once.unionByName(docs.where("doc_id IS NULL"))  # linked with nothing


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item."""
    found = decontam.find_leaks(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where(F.size("leaks") == 0).select(*COLUMNS)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, and what they decode to."""
    import public_tokenizers

    encoded = bpe.encode_documents(docs, public_tokenizers.path("word_bpe_49k.json"))
    return encoded.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids", "decoded")


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", repeated_lines),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("BPE encoding and decoding", encoding),
]

#: A trained network and edit distances can't be written in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for _, stage in STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
