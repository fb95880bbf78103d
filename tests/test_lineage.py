"""Copies along sessions that continue others, and what a change reaches."""

import random

import pytest

from tallyforge import queries
from tallyforge.operators import affected, graph, lineage


def digests(spark, nodes):
    rows = spark.createDataFrame(nodes, "node string, parent string, labels array<string>")
    return {r.node: r.digests for r in graph.path_digests(rows).collect()}


def test_equal_ways_have_equal_digests(spark):
    rng = random.Random(6)
    nodes, ways = [], {}
    for n in range(300):
        parent = rng.randrange(n) if n and rng.random() < 0.95 else None
        label = [rng.choice("ab"), rng.choice("ab")]
        nodes.append((str(n), None if parent is None else str(parent), label))
        above = ways[str(parent)] if parent is not None else ("", "")
        ways[str(n)] = tuple(x + y for x, y in zip(label, above))
    found = digests(spark, nodes)
    for i in (0, 1):
        groups = {}
        for node, way in ways.items():
            groups.setdefault(way[i], set()).add(found[node][i])
        assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_ways_that_prove_nothing(spark):
    found = digests(spark, [("a", None, ["x", None]), ("b", "a", ["x", "y"]), ("c", "gone", ["x", "y"]), ("d", "c", ["x", "y"]), ("e", "f", ["x", "y"]), ("f", "e", ["x", "y"]), ("g", "e", ["x", "y"])])
    assert found["b"][0] and found["b"][1] is None and {found[n] and tuple(found[n]) for n in "cdefg"} == {(None, None)}


def decide(spark, rows, entries, parents):
    rows = spark.createDataFrame(rows, "row_id long, session_id string, native_id string, kind string, pending boolean, fingerprints array<string>")
    found = lineage.entry_decisions(rows, spark.createDataFrame(entries, "session_id string, native_id string, parent_entry string"), spark.createDataFrame(parents, "session_id string, parent_id string"), ("input", "output"))
    return {(r.row_id, r.measure): (r.state, r.reason, r.canonical) for r in found.collect()}


def test_a_copy_needs_the_whole_way(spark):
    row = lambda i, s, e, a="1", b="1": (i, s, e, "assistant", False, [a, b])
    chain = lambda s, *names: [(s, e, names[i - 1] if i else None) for i, e in enumerate(names)]
    entries = chain("p", "a", "b", "c") + chain("q", "a", "b", "c") + chain("t", "a", "x", "c") + chain("u", "a", "b", "c")
    rows = [row(1, "p", "a"), row(2, "p", "c"), row(3, "q", "a"), row(4, "q", "c"), row(5, "t", "c"), row(6, "u", "a", "2"), row(7, "u", "c")]
    found = decide(spark, rows, entries, [("p", None), ("q", "p"), ("t", "p"), ("u", "p")])
    assert found[3, "input"] == ("excluded", "proven_copied_path", 1) and found[4, "output"] == ("excluded", "proven_copied_path", 2)
    assert found[5, "input"] == ("unresolved", "copied_identity_conflict", None)  # another way
    assert found[6, "input"][1] == "copied_identity_conflict" and found[6, "output"] == ("excluded", "proven_copied_path", 1)  # each measure by itself
    assert found[7, "input"][1] == "copied_identity_conflict" and found[7, "output"] == ("excluded", "proven_copied_path", 2)


def test_two_parents_of_an_entry_and_fates_of_originals(spark):
    row = lambda i, s, e="a", kind="assistant", pending=False: (i, s, e, kind, pending, ["1", "1"])
    sessions = ("p", "q", "r", "o", "c", "d", "x", "y")
    entries = [(s, "a", None) for s in sessions] + [("o", "b", "a"), ("o", "b", None)]
    rows = [row(1, "p", kind="tool_result"), row(2, "q"), row(3, "r"), row(4, "o"), row(5, "c"), row(6, "d"), row(7, "x", pending=True), row(8, "y"), row(9, "y")]
    found = decide(spark, rows, entries, [("p", None), ("q", "p"), ("r", "q"), ("o", None), ("c", "d"), ("d", "c"), ("x", "gone"), ("y", "x")])
    assert {k[0]: v[1] for k, v in found.items()} == {1: "tool_overlap_unproven", 2: "tool_overlap_unproven", 3: "tool_overlap_unproven", 4: "identity_conflict", 5: "lineage_cycle", 6: "lineage_cycle", 7: "unfinished_attempt", 8: "unfinished_attempt", 9: "unfinished_attempt"}


def test_the_entries_query_meets_every_reason(spark):
    found = {r.reason for r in queries.entry_decisions(spark, "/root/testdata/sf0.001").select("reason").distinct().collect()}
    assert found == {"identity_conflict", "tool_overlap_unproven", "unfinished_attempt", "identical_measure_variant", "proven_copied_path", "copied_identity_conflict", "lineage_cycle", "missing_ancestor", "independent_entry"}


def test_a_change_reaches_all_that_shares_names_with_it(spark):
    rng = random.Random(9)
    for n in (0, 12, 60):
        rows = [(f"s{i}", f"/{i // 2}", f"/{rng.randrange(40)}" if rng.random() < 0.3 else None, f"r{rng.randrange(60)}" if rng.random() < 0.4 else None) for i in range(n)]
        frame = spark.createDataFrame(rows, "session_id string, locator string, parent_locator string, response_id string")
        for seed in (("locator", "/3"), ("locator", "/none"), ("response", "r1"), ("session", "s5")):
            held = {}
            for s, own, up, r in rows:
                held[s] = {("locator", own), ("locator", up), ("response", r), ("session", s)} - {("locator", None), ("response", None)}
            names, grown = {seed}, True
            while grown:
                more = set().union(*(h for h in held.values() if h & names), names)
                names, grown = more, more != names
            want = {s for s, h in held.items() if h & names}
            found = affected.reached(affected.names(frame), spark.createDataFrame([seed], "kind string, value string"))
            assert {r.session_id for r in found.collect()} == want


def test_a_refresh_only_rewrites_what_it_reaches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(affected, "PARTS", 8)
    table = affected.Decisions(spark, str(tmp_path / "d"), "row_id long, state string")
    rows = {f"s{i}": [(i * 10 + j, "old") for j in range(3)] for i in range(40)}

    def decide(sessions):
        flat = [(s.session_id, *r) for s in sessions.collect() for r in rows.get(s.session_id, [])]
        return spark.createDataFrame(flat, table.schema)

    sessions = lambda *names: spark.createDataFrame([(s,) for s in names], "session_id string")
    state = lambda: {(r.session_id, r.row_id, r.state) for r in table.read().collect()}
    want = lambda: {(s, *r) for s, rs in rows.items() for r in rs}
    assert state() == set()
    table.refresh(sessions(*rows), decide)
    assert state() == want()
    files = {p: p.stat().st_mtime_ns for p in (tmp_path / "d").rglob("*.parquet")}
    rows["s3"], rows["new"] = [(30, "new")], [(900, "new")]
    table.refresh(sessions("s3", "new"), decide)
    assert state() == want()
    assert len({p for p in files if p.exists() and p.stat().st_mtime_ns == files[p]} ) >= 5 and len({p.parent for p in files if not p.exists()}) <= 2
    rows.clear()
    table.refresh(sessions(*(f"s{i}" for i in range(40)), "new"), decide)  # nothing is left of them
    assert state() == set()
    table.refresh(sessions(), decide)
    assert state() == set()


def test_a_ring_costs_no_rounds(spark, monkeypatch):
    """Pointers that go round stay open; rounds end with the longest chain, however large the table is."""
    written = []
    table = graph.Scratch.table
    monkeypatch.setattr(graph.Scratch, "table", lambda self, df: written.append(1) or table(self, df))
    nodes = [(f"n{i}", None) for i in range(2000)] + [("a", "b"), ("b", "a"), ("c", "a"), ("d", "n1"), ("e", "d"), ("f", "e"), ("g", "gone"), ("h", "g")]
    found = {r.node: (r.root, r.depth) for r in graph.chain_roots(spark.createDataFrame(nodes, "node string, parent string")).collect()}
    assert {n: found[n] for n in "abcdefgh"} == {"a": (None, None), "b": (None, None), "c": (None, None), "d": ("n1", 1), "e": ("n1", 2), "f": ("n1", 3), "g": ("g", 0), "h": ("g", 1)}
    assert len(found) == 2008 and found["n7"] == ("n7", 0) and len(written) <= 6


def test_ways_are_those_of_the_branch_and_each_round_writes_what_it_adds(spark, monkeypatch):
    nodes = spark.createDataFrame([(i, i - 1 if i % 50 else None) for i in range(200)] + [(300, 299), (301, 300)], "node long, parent long")
    leaves = nodes.where("node % 3 = 0 OR node > 200").select("node")
    rows = lambda found: sorted((r.node, r.leaf, r.distance) for r in found.collect())
    want, written, table = rows(graph.branch(nodes, leaves)), [], graph.Scratch.table

    def counting(self, df):
        out = table(self, df)
        written.append(out.count() if "leaf" in out.columns else 0)
        return out

    monkeypatch.setattr(graph.Scratch, "table", counting)
    assert rows(graph.ways(nodes, leaves)) == want and sum(written) == len(want)
