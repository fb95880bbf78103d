"""Operators on small tables with known answers."""

import ast
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tallyforge import queries
from tallyforge.functions import evidence, text
from tallyforge.operators import graph, matching, ordered, reconcile
from tallyforge.plans import pricing, report


def test_roots_of_chains_and_cycles(spark):
    nodes = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 3), (5, 99), (6, 7), (7, 6), (8, 6)], "node long, parent long")
    found = {r.node: (r.root, r.depth) for r in graph.chain_roots(nodes).collect()}
    assert found == {1: (1, 0), 2: (1, 1), 3: (1, 2), 4: (1, 3), 5: (5, 0), 6: (None, None), 7: (None, None), 8: (None, None)}


def test_long_chain(spark):
    nodes = spark.createDataFrame([(i, i - 1 if i else None) for i in range(200)], "node long, parent long")
    found = {r.node: (r.root, r.depth) for r in graph.chain_roots(nodes).collect()}
    assert found == {i: (0, i) for i in range(200)}


def test_only_the_ways_of_leaves_are_walked(spark):
    rows = [(i, i - 1 if i else None) for i in range(300)] + [(1000 + i, 150 if i == 0 else 999 + i) for i in range(40)] + [(5000, 5001), (5001, 5000)]
    nodes = spark.createDataFrame(rows, "node long, parent long")
    found = {(r.node, r.leaf, r.distance) for r in graph.branch(nodes, spark.createDataFrame([(1039,), (5000,)], "node long")).collect()}
    way = [*range(1039, 999, -1), *range(150, -1, -1)]
    assert found == {(n, 1039, d) for d, n in enumerate(way)} | {(5000, 5000, 0), (5001, 5000, 1)}


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (5, 4), (6, 6)] + [(i, i + 1) for i in range(100, 130)], "a long, b long")
    found = {r.node: r.component for r in graph.connected(edges).collect()}
    assert found == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6} | dict.fromkeys(range(100, 131), 100)


def test_totals_never_turn_missing_into_zero(spark):
    row = {"input_state": "known", "input_amount": 317, "output_state": "known", "output_amount": 41, "cache_read_state": "known", "cache_read_amount": 2063, "cache_write_state": "unknown", "cache_write_amount": None, "reported_state": "unknown", "reported_amount": None}
    rows = [row, row | {"cache_write_state": "known", "cache_write_amount": 79}, row | {"reported_state": "known", "reported_amount": 2500}, row | {"reported_state": "known", "reported_amount": 2420}]
    schema = ", ".join(f"{k} {'string' if k.endswith('state') else 'long'}" for k in row)
    df = spark.createDataFrame([tuple(r.values()) for r in rows], schema)
    assert [r[0] if r[0] is None else int(r[0]) for r in df.select(evidence.normalized_total()).collect()] == [None, 2500, 2500, None]


def test_sums_beyond_64_bits(spark):
    rows = [(2**63 - 1, "known", "selected", False)] * 3
    df = spark.createDataFrame(rows, "input_amount long, input_state string, decision string, lower_bound boolean")
    assert int(df.agg(*evidence.metric_sum("input")).first().input_known) == 3 * (2**63 - 1)


def test_scope_of_intervals(spark):
    rows = [("point", 10, None), ("point", 20, None), ("interval", 25, None), ("interval", 15, 12), ("interval", 15, 5), ("undated", None, None)]
    df = report.scoped(spark.createDataFrame(rows, "time_kind string, at_us long, start_us long"), 10, 20)
    assert sorted((r.time_kind, r.at_us or 0, r.included) for r in df.collect()) == [("interval", 15, False), ("interval", 15, True), ("interval", 25, False), ("point", 10, True), ("undated", 0, False)]


def test_tier_is_strictly_below_the_prompt(spark):
    data = '{"p": {"models": {"m": {"cost": {"input": 1.5, "output": 2, "tiers": [{"tier": {"type": "context", "size": 100}, "input": 3}]}}}}}'
    rates = pricing.catalog(spark, data)
    row = ("p", "m", "selected", "point", "known", 0, "known", 5, "known", 0, "known", 0)
    names = "provider string, model string, decision string, time_kind string, input_state string, input_amount long, output_state string, output_amount long, cache_read_state string, cache_read_amount long, cache_write_state string, cache_write_amount long"
    rows = [row[:5] + (n,) + row[6:] for n in (100, 101)]
    lines = {(r.category, r.threshold): (r.reason, r.micro_usd) for r in pricing.priced(spark.createDataFrame(rows, names), rates).collect()}
    assert lines[("input", 0)] == (None, 150) and lines[("input", 100)] == (None, 303) and lines[("output", 100)][0] == "missing_category_rate"


@pytest.mark.parametrize("key", [[], ["k"]])
def test_asof_with_intervals_in_each_other(spark, key):
    spans = [(0, 100), (10, 20), (15, 18), (15, 16), (30, 40), (35, 60), (120, 130), (120, 125), (5, 5)]
    axis = spark.createDataFrame([(k, *s) for k in (1, 2) for s in spans], "k int, start long, end long").where("k = 1" if not key else "true")
    points = spark.createDataFrame([(k, t) for k in (1, 2) for t in [*range(-2, 135), None]] + [(3, 50)], "k int, t long")
    want = lambda t: max(((a, b) for a, b in spans if t is not None and a <= t < b), default=(None, None))
    found = matching.asof(points, axis, "t", "start", "end", key).collect()
    assert len(found) == points.count()
    assert all((r.start, r.end) == (want(r.t) if not key or r.k < 3 else (None, None)) for r in found)


def test_token_counts_as_millions(spark):
    cases = {0: "0", 1: "<0.01", 9_999: "<0.01", 10_000: "0.01", 15_000: "0.02", 25_000: "0.02", 25_001: "0.03", 995_000: "1.00", 2**63 - 1: "9223372036854.78", -1: None}
    rows = spark.createDataFrame([(n,) for n in cases], "n long").select("n", text.mtok(F.col("n")).alias("m")).collect()
    assert {r.n: r.m for r in rows} == cases


def test_project_labels(spark):
    cases = {None: "Unassigned", "unassigned": "Unassigned", "directory:/a/b": "b", "directory:/a/b/.git": "b", "repository:/x/y.git/": "y.git", "directory:/": "/"}
    rows = spark.createDataFrame([(n,) for n in cases], "n string").select("n", text.project_label(F.col("n")).alias("m")).collect()
    assert {r.n: r.m for r in rows} == cases


def test_counts_that_cannot_be_read_make_a_total_unknown(spark):
    names = [f"{m}_{k}" for m in (*evidence.BUCKETS, "reported") for k in ("state", "amount", "reason")]
    known, bad, lacks = ("known", 3, None), ("unknown", None, "invalid_count"), ("unknown", None, "not_reported")
    rows = [(known,) * 4 + (lacks,), (known,) * 4 + (bad,), (bad, known, known, known, ("known", 12, None)), (lacks, known, known, known, ("known", 12, None))]
    df = spark.createDataFrame([sum(r, ()) for r in rows], ", ".join(f"{n} {'long' if n.endswith('amount') else 'string'}" for n in names))
    assert [r[0] if r[0] is None else int(r[0]) for r in df.select(evidence.normalized_total(reasons=True)).collect()] == [12, None, None, 12]


def test_islands_and_changes(spark):
    rows = spark.createDataFrame([(1, i, k) for i, k in enumerate("aabba")], "key int, at int, kind string")
    found = sorted((r.island, r.kind, r.first, r.last, r.members) for r in ordered.islands(rows, "key", ["at"], F.col("kind")).collect())
    assert found == [(1, "a", 0, 1, 2), (2, "b", 2, 3, 2), (3, "a", 4, 4, 1)]
    assert [r.shown for r in ordered.changes(rows, "key", ["at"], "kind").orderBy("at").collect()] == ["a", None, "b", None, "a"]


def test_band_matches_need_one_partner(spark):
    a = spark.createDataFrame([(1, 10), (1, 50)], "key int, line int")
    b = spark.createDataFrame([(1, 13), (1, 48), (1, 53)], "key int, line int")
    assert [tuple(r) for r in matching.band_matches(a, b, ["key"], "line", 4).collect()] == [(1, 10, 13)]


def test_asof_axis_is_checked(spark):
    axis = spark.createDataFrame([(0, 10), (10, 20)], "s long, e long")
    points = spark.createDataFrame([(5,), (10,), (25,)], "at long")
    assert sorted((r.at, r.s) for r in matching.asof(points, axis, "at", "s", "e").collect() if r.s is not None) == [(5, 0), (10, 10)]
    assert matching.asof(points, axis.limit(0), "at", "s", "e").where("s IS NULL").count() == 3


def test_pages_clamp(spark):
    rows = spark.range(25)
    last = report.page(rows, 9, 10, F.col("id").asc()).collect()
    assert [(r.id, r.position, r.total_rows) for r in last] == [(i, i + 1, 25) for i in range(20, 25)]
    with pytest.raises(ValueError):
        report.page(rows, 0, 10, F.col("id").asc())


def test_copied_paths(spark):
    sessions = spark.createDataFrame([(1, None), (2, 1), (3, 2)], "session_id long, parent_id long")
    rows = spark.createDataFrame([(1, 7, "a", "x"), (3, 7, "b", "x"), (2, 8, "c", "y"), (3, 8, "d", "z"), (3, 9, "e", "p"), (3, 9, "f", "q"), (2, 5, "g", "k"), (2, 5, "h", "k")], "session_id long, native_id long, observation_id string, fingerprint string")
    found = {r.observation_id: r.reason for r in reconcile.copied_paths(rows, sessions).collect()}
    assert found == {"a": "independent_entry", "b": "proven_copied_path", "c": "independent_entry", "d": "copied_identity_conflict", "e": "identity_conflict", "f": "identity_conflict", "g": "independent_entry", "h": "identical_measure_variant"}


def test_text_functions(spark):
    rows = spark.createDataFrame([("  a\n b ", "2026-09-12T10:00:00Z", "1.500"), ("x " * 100, "2026-09-12T10:00:00", "10"), ("", "nonsense", "3.0")], "t string, at string, n string")
    found = rows.select(text.excerpt(F.col("t")), text.instant(F.col("at")), text.normal_decimal(F.col("n")), text.semver(F.lit("2.1.97"))).collect()
    assert [r[0] for r in found][0] == "a b" and len(found[1][0]) <= 160 and found[2][0] is None
    assert [r[1] for r in found] == [1789207200000000, None, None]
    assert [r[2] for r in found] == ["1.5", "10", "3"] and found[0][3] == [2, 1, 97]


def test_no_name_is_defined_twice_in_a_module():
    """A second definition would silently stand for the first, also where that one is called."""
    for path in Path(queries.__file__).parent.rglob("*.py"):
        names = [n.name for n in ast.parse(path.read_text()).body if isinstance(n, ast.FunctionDef | ast.ClassDef)]
        assert len(names) == len(set(names)), path


def test_generations_in_stretches(spark, sf_dir):
    """The helper of both queries is the one for generations, not the one that counts parts of logs."""
    parts = queries._stretches(spark, sf_dir, 20).selectExpr("split(locator, '#')[1] = CAST(generation div 20 AS STRING) AS right").distinct().collect()
    assert [r.right for r in parts] == [True]
    assert queries.removed_locators(spark, sf_dir).first().locators > 0
