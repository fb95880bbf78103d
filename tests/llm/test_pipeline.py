"""The pipeline over the smallest table: each stage keeps what it should."""

from pyspark.sql import functions as F

import corpus_pipeline as P
from tallyforge.llm import quality, queries
from tests.llm.test_llm import groups_by_hand, sets_of


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, sf_dir).cache()
        assert out.columns == docs.columns and ids(out) <= ids(docs), name
        if stage is P.near_duplicates:
            groups = groups_by_hand(sets_of([(r.doc_id, r.text) for r in docs.collect()]))
            assert ids(out) == {root for _, root in groups.values()}
        docs = out
    assert docs.count() > 100
    assert P.STAGES[-1][1](spark, docs, sf_dir).count() == docs.count()


def test_the_pipeline_rejects_what_the_classifier_calls_bad(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(quality, "fit", lambda *_: None)
    monkeypatch.setattr(quality, "score_documents", lambda docs, net, keep=("doc_id",): docs.select(*keep, (F.col("doc_id") % 101 / 100).alias("score")))
    good = {r.doc_id for r in queries.op4_quality(spark, sf_dir).where("predicted = 1").collect()}
    kept = P.quality_classifier(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir)
    assert {r.doc_id for r in kept.collect()} == good


def test_stages_on_odd_rows(spark, sf_dir):
    """Nulls in any column, empty texts, repeated rows, an id with two texts, columns named as outputs, an empty table."""
    text = "A plain text of good words: " + " ".join(f"in row {i} of this table the word {i * 7919 % 1000} stands once," for i in range(9)) + " "
    plain = text + "The end."
    rows = [(1, plain, "en", "a", 3), (1, plain, "en", "a", 3), (2, None, None, None, None), (3, "", "en", "a", 0), (None, plain + " No id.", "en", "a", 9), (4, "first " + text.replace("plain", "other"), "en", "a", 1), (4, "second", "en", None, 1), (5, plain, "en", "b", 3)]
    extra = "score double, leaks string, n_words int, runs int, component_id long, __text string, __id long"
    schema = f"doc_id long, text string, lang string, source string, n_chars long, {extra}"
    docs = spark.createDataFrame([(*r, 0.5, "x", 1, 2, 3, "y", 4) for r in rows], schema)
    columns = [*P.COLUMNS]
    kept = {}
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == columns
        kept[name] = sorted((r.doc_id or 0, r.text or "") for r in out.collect())
        assert stage(spark, docs.limit(0), sf_dir).count() == 0
    assert kept["benchmark decontamination"] == sorted((r[0] or 0, r[1] or "") for r in rows)
    assert [d for d, _ in kept["n-gram Jaccard join"]] == [0, 1, 2, 3]  # one of the texts of 4 is nearly that of 1
    assert [d for d, t in kept["line dedup"] if t == plain] == [1, 1] and 5 not in [d for d, _ in kept["line dedup"]]
    encoded = P.STAGES[-1][1](spark, docs, sf_dir)
    assert encoded.columns == ["doc_id", "n_tokens", "token_ids", "decoded"] and encoded.count() == len(rows)
