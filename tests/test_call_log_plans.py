"""Call logs at size: calls are decided without copies of their rows; strict versions are told by one expression."""

import pytest
from pyspark.sql import functions as F

from tallyforge import queries
from tallyforge.sources import call_log


def test_calls_are_decided_without_copies_of_rows(spark, sf_dir):
    plan = queries.call_log_decisions(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" not in plan


def test_strict_versions(spark):
    good = ["1.2.3", "0.0.0", "2.1.97-rc.1", "2.1.97-0a.b-c+build.007", "1.2.3+0-1", "1.2.3--", "9" * 38 + ".0.0"]
    wrong = ["", "1.2", "1.2.3.4", "01.2.3", "1.2.3-", "1.2.3-01", "1.2.3-a..b", "1.2.3+", "1.2.3+a+b", "1.2.3\n", "v1.2.3", "1.2.x", "1.2.3-é", "1.2.3-" + "a" * 130, None]
    rows = spark.createDataFrame([(v,) for v in good + wrong], "v string").select("v", call_log.release(F.col("v")).alias("r")).collect()
    assert [r.v for r in rows if r.r is not None] == good
    assert [r.r.early for r in rows if r.r is not None] == [False, False, True, True, False, True, False]


@pytest.mark.parametrize(("version", "said"), [("2.1.97", "final"), ("2.1.97-rc.1", "placeholder"), ("2.1.96", "placeholder"), ("2.1.97+b", "final"), ("2.01.97", "unqualified")])
def test_finality_by_version(spark, version, said):
    assert spark.range(1).select(call_log.writer(F.lit(version)).alias("w")).first().w == said
