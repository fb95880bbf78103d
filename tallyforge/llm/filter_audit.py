"""Filter interaction audit: what each filter removes that others would remove as well, for every order of the filters.

Relational: words are exploded, counted by (document, word) and then by document for totals and distinct words; the other flags are joined
to them, and documents are counted by the set of filters that they fail, one conditional-count column for each set. Everything about an
order is a sum over these columns, so orders cost nothing in the size of the input.

Texts are shuffled once, by document; both counts of words follow in place. Copies are found by digests: the smallest id of each digest is taken map-side,
and only digests with several ids are joined back, from a written table, so that Spark can split a digest with very many copies.

Defined cases: a null text is empty and has no words, so it is too short but not repetitive; a null ``part`` is the empty string; a row
without an id has no labels, and is no copy of others nor they of it; rows that repeat an id and text are documents each, none a copy of the other; one
that repeats an id with another text is another document; a label that stands twice counts if either row has it. An empty table gives no parts.
Columns other than those named are ignored, whatever their names. The words of a text are held as one array while they are exploded.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Words are what stands between these bytes.
GAP = r"[\x20\x09-\x0D]+"
LEAST_WORDS, LEAST_DISTINCT_PERCENT, MOST_CAPITALS_PERCENT = 200, 50, 3
MARKS = r"[#$%&*|]"
LETTERS = "ABCDE"


def word_counts(texts: DataFrame) -> DataFrame:
    """doc_id, h, n_words, n_distinct of (doc_id, h, text); texts without words have no row."""
    words = texts.repartition("doc_id", "h").select("doc_id", "h", F.explode(F.split("text", GAP)).alias("word")).where("word != ''")
    by_word = words.groupBy("doc_id", "h", "word").agg(F.count("*").alias("n"))
    return by_word.groupBy("doc_id", "h").agg(F.sum("n").alias("n_words"), F.count("*").alias("n_distinct"))


def _once(texts: DataFrame, repeated: DataFrame) -> DataFrame:
    """Each (doc_id, h) once, though a document may be repeated by any number of rows."""
    same = texts["doc_id"].eqNullSafe(repeated["doc_id"]) & (texts["h"] == repeated["h"])
    again = texts.join(repeated, same, "left_semi").groupBy("doc_id", "h").agg(F.min("text").alias("text"))
    return texts.join(repeated, same, "left_anti").unionByName(again)


def document_flags(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, part, n (rows that are alike), and the booleans A to E, true where the filter fails, of (doc_id, part, text)."""
    docs = docs.select("doc_id", F.coalesce(F.col("part"), F.lit("")).alias("part"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    docs = docs.withColumn("h", F.xxhash64("text"))
    capitals = F.octet_length(F.regexp_replace("text", "[^A-Z]+", ""))
    seen = docs.select(
        "doc_id", "part", "h", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"),
        (100 * capitals.cast("long") > MOST_CAPITALS_PERCENT * F.length("text").cast("long")).alias("C"), F.col("text").rlike(MARKS).alias("D"),
    )
    seen = scratch.table(seen.groupBy("doc_id", "part", "h", "digest", "C", "D").agg(F.count("*").alias("n")))
    copies = scratch.table(seen.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("digest", "first"))
    repeated = scratch.table(seen.groupBy("doc_id", "h").agg(F.sum("n").alias("rows")).where("rows > 1").select("doc_id", "h"))
    texts = docs.select("doc_id", "h", "text")
    counts = word_counts(texts if repeated.isEmpty() else _once(texts, repeated)).withColumnsRenamed({"doc_id": "counted_id", "h": "counted_h"})
    same = F.col("doc_id").eqNullSafe(F.col("counted_id")) & (F.col("h") == F.col("counted_h"))
    words, different = (F.coalesce(F.col(c), F.lit(0)) for c in ("n_words", "n_distinct"))
    flags = seen.join(copies, "digest", "left").join(counts, same, "full_outer")
    return flags.select(
        "doc_id", "part", "n", (words < LEAST_WORDS).alias("A"), (100 * different < LEAST_DISTINCT_PERCENT * words).alias("B"),
        "C", "D", F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)).alias("E"),
    )


def labelled(flags: DataFrame, labels: DataFrame) -> DataFrame:
    """With good and toxic, false where nothing is labelled."""
    known = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(*(F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(name) for c, name in (("quality", "good"), ("toxic", "toxic"))))
    return flags.join(known, "doc_id", "left").fillna(False, ["good", "toxic"])


def failing_sets(flags: DataFrame, letters: str = LETTERS) -> DataFrame:
    """part, and the documents, good and toxic ones by the set that they fail: 2 ** len(letters) columns each, as arrays (bit i: letter i)."""
    mask = sum((F.when(F.col(x), 1 << i).otherwise(0) for i, x in enumerate(letters)), F.lit(0))
    rows = flags.select("part", "n", "good", "toxic", mask.alias("mask"))
    columns = [F.sum(F.when((F.col("mask") == k) & kept, F.col("n")).otherwise(0)).alias(f"{name}{k}") for name, kept in (("all", F.lit(True)), ("good", F.col("good")), ("toxic", F.col("toxic"))) for k in range(1 << len(letters))]
    counted = rows.groupBy("part").agg(*columns)
    return counted.select("part", *(F.array(*(f"{name}{k}" for k in range(1 << len(letters)))).alias(name) for name in ("all", "good", "toxic")))


def every_order(sets: DataFrame, letters: str = LETTERS) -> DataFrame:
    """One row per part, order and step, from the counts by failing set."""
    size = len(letters)
    orders = F.array(*(F.lit("".join(p)) for p in itertools.permutations(letters)))
    bit_of = F.create_map(*itertools.chain.from_iterable((F.lit(x), F.lit(1 << i)) for i, x in enumerate(letters)))
    steps = sets.select("*", F.explode(orders).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(size))).alias("step"))
    before = F.transform(F.sequence(F.lit(1), F.lit(size)), lambda i: F.when(i < F.col("step"), bit_of[F.substring("filter_order", i, F.lit(1))]).otherwise(0))
    steps = steps.withColumns({"bit": bit_of[F.substring("filter_order", F.col("step"), F.lit(1))], "earlier": F.aggregate(before, F.lit(0), lambda a, x: a + x)})

    def total(counts: str, wanted) -> Column:
        """The sum of the columns whose set is wanted, each times what ``wanted`` gives."""
        return F.aggregate(F.sequence(F.lit(0), F.lit((1 << size) - 1)), F.lit(0).cast("long"), lambda a, k: a + F.element_at(counts, k + 1) * wanted(k).cast("long"))

    def fails(k: Column) -> Column:
        return k.bitwiseAND(F.col("bit")) != 0

    def reached(k: Column) -> Column:
        return k.bitwiseAND(F.col("earlier")) == 0

    # Of the orders, the failed filters of a document stand first equally often.
    share = F.array(*(F.lit(math.factorial(size) // k.bit_count() if k else 0) for k in range(1 << size)))
    here = lambda k: fails(k) & reached(k)
    return steps.select(
        "part", "filter_order", "step", total("all", lambda k: reached(k) & ~fails(k)).alias("kept"), total("all", here).alias("removed"),
        total("all", lambda k: fails(k) & ~reached(k)).alias("redundant"), F.element_at("all", F.col("bit") + 1).alias("unique_fails"),
        total("good", here).alias("good_lost"), total("toxic", here).alias("toxic_lost"), total("all", lambda k: F.when(fails(k), F.element_at(share, k + 1)).otherwise(0)).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of the five filters on (doc_id, part, text) with the labels (doc_id, quality, toxic)."""
    flags = document_flags(docs, Scratch(docs.sparkSession, "audit"))
    return every_order(failing_sets(labelled(flags, labels)))
