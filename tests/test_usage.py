"""From decided measures to the report, and calls decided by their writers, on hand-made rows."""

from decimal import Decimal

from tallyforge import queries
from tallyforge.operators import dialects
from tallyforge.plans import usage

OBS = "observation_id string, session_id string, provider string, model string, time_kind string, at_us long, start_us long, lower_bound boolean"


def built(spark, observations, values, decisions, rates, **more):
    wide = usage.pivot(spark.createDataFrame(values, "observation_id string, measure string, state string, amount long, reason string"), spark.createDataFrame(decisions, "observation_id string, measure string, state string"))
    sessions = spark.createDataFrame([("s", "h", "p", 5), ("t", "h", "q", 7)], "session_id string, harness string, project_id string, started_us long")
    owners = spark.createDataFrame([("t", "s")], "session_id string, owner_id string")
    base = usage.population(spark.createDataFrame(observations, OBS), wide, sessions, owners, **more)
    table = spark.createDataFrame([(p, m, c, t, Decimal(r)) for p, m, c, t, r in rates], "provider string, model string, category string, threshold long, rate decimal(17,9)")
    return base, usage.costs(usage.groups(base, table, {"alias": "p"}), table)


def obs(i, session="s", provider="p", model="m", kind="point", at=1):
    return (i, session, provider, model, kind, at, None, False)


def value(i, measure, amount, state="known", reason=None):
    return (i, measure, state, amount, reason)


def test_who_is_eligible_and_whose_it_is(spark):
    said = lambda i, **by: [(i, m, s) for m, s in by.items()]
    observations = [obs("a"), obs("b", "t"), obs("c"), obs("d"), obs("e")]
    values = [value("a", "input", 10), value("b", "input", 20), value("c", "input", 30), value("e", "output", 1)]
    decisions = said("a", input="selected", output="excluded") + said("b", input="unresolved") + said("c", input="excluded") + said("e", output="selected", input="selected")
    quantities = spark.createDataFrame([("d", "selected"), ("c", "excluded")], "observation_id string, state string")
    conflicts = spark.createDataFrame([("e",), ("e",)], "observation_id string")
    base, priced = built(spark, observations, values, decisions, [("p", "m", "input", 0, "2")], quantity_decisions=quantities, conflicts=conflicts)
    got = {r.observation_id: r for r in base.collect()}
    assert set(got) == {"a", "b", "d", "e"} and got["b"].owner_id == "s" and got["b"].project_id == "p" and (got["b"].selected, got["d"].selected) == (False, True)
    assert (got["e"].provider, got["e"].model, got["a"].model) == (None, None, "m") and got["a"].cache_read_decision == "excluded" and got["d"].input_state == "unknown"
    r = usage.summed(priced, "project_id").first()
    assert (r.project_id, r.observations, r.owners, int(r.input_known), r.input_unknown, int(r.output_known), r.unpriced) == ("p", 4, 1, 10, 2, 1, 2)
    assert r.micro_usd == 20


def test_prices_of_groups(spark):
    rates = [("p", "m", b, t, "2" if b == "input" else "3" if not t else "5") for b in usage.BUCKETS for t in (0, 100)] + [("p", "n", "input", 0, "7")]
    every = lambda i, amounts: [value(i, m, a) for m, a in zip(usage.BUCKETS, amounts, strict=True)]
    rows = {"low": (10, 1, 0, 0), "high": (101, 1, 0, 0), "span": (10, 1, 0, 0), "long": (1, 0, 0, 4), "gap": (1, 1, 0, 0), "lost": (1, 0, 0, 0), "alias": (50, 0, 0, 50)}
    observations = [obs(i, kind="interval" if i == "span" else "point", model={"gap": "n", "lost": "z"}.get(i, "m"), provider="alias" if i == "alias" else "p") for i in rows]
    values = [v for i, a in rows.items() for v in every(i, a)] + [value("long", "cache_write_1h", 1)]
    decisions = [(i, m, "selected") for i in rows for m in usage.BUCKETS]
    _, priced = built(spark, observations, values, decisions, rates)
    got = {(r.model, r.context_reason, r.context_threshold, r.long_cache, r.provider): (int(r.micro_usd), r.lines, r.unpriced) for r in priced.collect()}
    assert got == {
        ("m", None, None, False, "p"): (23, 2, 0), ("m", None, 100, False, "p"): (207, 2, 0),
        ("m", "aggregate_context", None, False, "p"): (20, 1, 1),  # the input has one rate in all tiers
        ("m", None, None, True, "p"): (2, 1, 1), ("n", None, None, False, "p"): (7, 1, 1), ("z", None, None, False, "p"): (0, 0, 1), ("m", None, None, False, "alias"): (250, 2, 0),
    }


def test_rows_of_an_observation_are_put_together_without_a_sort(spark):
    values = [value("a", "input", None, "unknown", "invalid_count"), value("a", "output", 3), value("a", "output", 5), value("b", "input", None, "not_applicable")]
    values = spark.createDataFrame(values, "observation_id string, measure string, state string, amount long, reason string")
    decisions = spark.createDataFrame([("a", "input", "selected"), ("a", "input", "unresolved"), ("b", "input", "excluded")], "observation_id string, measure string, state string")
    wide = usage.pivot(values, decisions)
    got = {r.observation_id: r for r in wide.collect()}
    assert (got["a"].input_state, got["a"].input_reason, got["a"].output_amount, got["a"].output_state, got["a"].input_decision) == ("unknown", "invalid_count", 5, "known", "unresolved")
    assert (got["b"].input_state, got["b"].input_reason, got["b"].total_decision, got["b"].reported_state) == ("not_applicable", None, "excluded", "unknown")
    plan = wide._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "HashAggregate" in plan


CALL = "row_id long, message_id string, request_id string, entry_id string, signature string, output long, finality string, writer_token string, usable boolean, reason string, at_us long, locator string, line long, current boolean, superseded boolean"


def call(i, m=None, q=None, u=None, sig="s", out=1, fin="final", token="w", usable=True, reason=None, at=None, current=True, superseded=False):
    return (i, m, q, u or f"u{i}", sig, out, fin, token, usable, reason, i if at is None else at, "f", i, current, superseded)


def test_calls_by_their_writers(spark):
    rows = [
        call(1, "m1", fin="placeholder", out=None, token="old"), call(2, "m1", "q1"), call(3, None, "q1", at=0),  # one made final what another began
        call(11, "m2"), call(12, "m2", out=2),  # final counts differ
        call(21, "m3"), call(22, "m3", token="v"),  # two final writers
        call(31, "m4"), call(32, "m4", fin="final_missing", out=None),
        call(41, "m5", "q5"), call(42, "m5", "q6"),  # not one to one
        call(51, usable=False, reason="missing_identity"), call(52, "m6", u="x"), call(53, u="x", usable=False, reason="missing_identity"),  # known through its entry
        call(61, "m7", superseded=True), call(62, "m7"), call(71, "m8", superseded=True),
        call(81, "m9", sig="a"), call(82, "m9", sig="b"), call(91, "m10", token=None), call(92, "m10"), call(101, "m11", u="e", fin="placeholder", out=None), call(102, "m11", u="e"),
        call(111, "m12", current=False, at=0), call(112, "m12"), call(112, "m12", u="again"), call(121, "m13", fin="unqualified", out=1, token=None),
    ]
    found = {r.row_id: (r.reason, r.canonical) for r in dialects.call_log_decisions(spark.createDataFrame(rows, CALL)).collect()}
    contested = lambda *ids: {i: ("output_conflict", None) for i in ids}
    assert found == {
        1: ("duplicate", 3), 2: ("duplicate", 3), 3: ("call", None), **contested(11, 12, 21, 22, 31, 32, 91, 92, 101, 102), 41: ("identity_conflict", None), 42: ("identity_conflict", None), 51: ("missing_identity", None),
        52: ("call", None), 53: ("duplicate", 52), 61: ("superseded_projection", 62), 62: ("call", None), 71: ("missing_identity", None), 81: ("identity_conflict", None), 82: ("identity_conflict", None), 111: ("duplicate", 112), 112: ("call", None), 121: ("call", None),
    }


def test_the_call_log_query_meets_every_reason(spark):
    found = {r.reason for r in queries.call_log_decisions(spark, "/root/testdata/sf0.01").select("reason").distinct().collect()}
    assert found >= {"output_conflict", "identity_conflict", "superseded_projection", "duplicate", "call"}


def dealt(spark, sf_dir, query, key):
    plan = queries.QUERIES[query](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "Exchange hashpartitioning(" in line and key in line]


def test_groups_are_dealt_by_session_and_owner_only(spark, sf_dir):
    """The rows of an observation lie in its session's part, and its groups in its owner's."""
    assert not dealt(spark, sf_dir, "usage_groups", "observation_id") and not dealt(spark, sf_dir, "usage_groups", "bucket_us")


def test_sums_are_exact_beyond_64_bits(spark):
    ids = [f"o{i}" for i in range(4)]
    values = [value(i, m, 2**62 + 2**33 + 5) for i in ids for m in ("input",)]
    _, priced = built(spark, [obs(i) for i in ids], values, [(i, "input", "selected") for i in ids], [])
    assert int(usage.summed(priced, "owner_id").first().input_known) == 4 * (2**62 + 2**33 + 5)


def test_owners_are_counted_without_a_distinct_count(spark, sf_dir):
    plan = queries.usage_by_project(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "sum(owners" in plan and "count(distinct" not in plan
