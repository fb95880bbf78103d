"""Filter interactions, lattice scores and alignment of tokenizers against brute force, and their edge cases."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from tallyforge.llm import align, filter_audit, lm_score, queries
from tallyforge.llm.common import Scratch

WORD = re.compile("[^\x20\x09-\x0d]+")


def path(name):
    return queries._tokenizer(name)


def odd_texts(n=120, seed=5):
    rng = random.Random(seed)
    parts = [" ", "  ", "\n", "\t", "\x0b", "\x85", "\xa0", " a", " b", "'s", "1", "é", "Σ", "ß", " The", " #", "!", "|", "\x1d", " the", "<|endoftext|>", "</s>", "▁", "日本", "😀", " thereof", "\x00"]
    return ["", " ", "  ", "a", " a", "a ", "a  b \n\n c\t", "x" * 3000, "the " * 400, *("".join(rng.choice(parts) for _ in range(rng.randint(1, 40))) for _ in range(n))]


# Operator 11 -------------------------------------------------------------------------------------------------------------------------------


def brute_audit(rows, labels):
    good = {k for k, q, _ in labels if k is not None and q == 1}
    toxic = {k for k, _, t in labels if k is not None and t == 1}
    first = {}
    for k, _, t in rows:
        if k is not None:
            first[t or ""] = min(k, first.get(t or "", k))
    sets = collections.defaultdict(list)
    for k, part, t in rows:
        t = t or ""
        words = WORD.findall(t)
        failed = {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t),
            "D": any(c in "#$%&*|" for c in t), "E": k is not None and k > first[t],
        }
        sets[part or ""].append(({x for x, f in failed.items() if f}, k in good, k in toxic))
    out = set()
    for part, docs in sets.items():
        shapley = collections.Counter()
        steps = []
        for order in map("".join, itertools.permutations("ABCDE")):
            left = docs
            for i, x in enumerate(order):
                gone = [d for d in left if x in d[0]]
                left = [d for d in left if x not in d[0]]
                shapley[x] += len(gone)
                steps.append((order, i + 1, x, len(left), len(gone), sum(x in d[0] for d in docs) - len(gone), sum(d[0] == {x} for d in docs), sum(d[1] for d in gone), sum(d[2] for d in gone)))
        out |= {(part, *s[:2], *s[3:], shapley[s[2]]) for s in steps}
    return out


def audit_rows():
    rng = random.Random(3)
    words = ["a", "b", "AB", "été", "c#", "x|y", "Zz", *(f"w{i}" for i in range(300))]
    texts = [None, "", " \n", "#" * 5, *(" ".join(rng.choice(words[: rng.choice((3, 5, 300))]) for _ in range(rng.choice((1, 50, 199, 200, 201, 500)))) for _ in range(25))]
    rows = [(rng.choice((None, *range(40))), rng.choice((None, "", "en", "de")), rng.choice(texts)) for _ in range(150)]
    rows += rows[:20]  # repeated rows
    rows += [(100 + i, "en", texts[5]) for i in range(30)] + [(7, "de", texts[6]), (7, "de", texts[7]), (None, "en", texts[5])]
    return rows, [(i, i % 3 % 2, i % 2) for i in range(0, 45)] + [(3, 1, 1), (3, None, None), (None, 1, 1), (4, None, 1)]


def test_audit_equals_walking_every_order(spark):
    rows, labels = audit_rows()
    docs = spark.createDataFrame(rows, "doc_id long, part string, text string").select("*", F.lit(1).alias("h"), F.lit(2).alias("n"), F.lit("x").alias("digest"), F.lit(True).alias("A"))
    found = filter_audit.audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("part", F.lit("no")))
    assert found.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert {tuple(r) for r in found.collect()} == brute_audit(rows, labels)


def test_audit_of_nothing(spark):
    docs, labels = spark.createDataFrame([], "doc_id long, part string, text string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(docs, labels).collect() == []
    alone = filter_audit.audit(spark.createDataFrame([(1, None, None)], docs.schema), labels).collect()
    assert len(alone) == 600 and {(r.part, r.kept) for r in alone if r.step == 5} == {("", 0)} and {r.shapley for r in alone if r.filter_order[r.step - 1] == "A"} == {120}


def test_words_are_counted_where_texts_lie(spark):
    rows, _ = audit_rows()
    texts = spark.createDataFrame(rows, "doc_id long, part string, text string").select("doc_id", F.xxhash64("text").alias("h"), "text")
    plan = filter_audit.word_counts(texts)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_audit_query_equals_its_sql(spark, sf_dir):
    duck = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        duck.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    found = queries.QUERIES["op11_filter_audit"](spark, sf_dir)
    sql = duck.execute(f"SELECT {', '.join(found.columns)} FROM ({queries.ORACLE_SQL['op11_filter_audit']})").fetchall()
    assert sorted(map(tuple, found.collect())) == sorted(sql)


# Operator 12 -------------------------------------------------------------------------------------------------------------------------------


def spellings(word, pieces, byte_ids):
    """All segmentations of a marked word, as lists of ids."""
    letters = {p for p in pieces if len(p) == 1}

    def after(i):
        if i == len(word):
            yield []
            return
        for j in range(i + 1, len(word) + 1):
            if word[i:j] in pieces:
                for rest in after(j):
                    yield [pieces[word[i:j]], *rest]
        if word[i] not in letters:
            for rest in after(i + 1):
                yield [*(byte_ids[b] for b in word[i].encode()), *rest]

    return list(after(0))


def small_lattice():
    names = ["", *(f"<{i}>" for i in range(256)), "▁", "a", "b", "ab", "▁a", "ba", "aba", "日"]
    rng = random.Random(1)
    weight = [rng.random() for _ in names] + [0.7]
    log = [math.log(w / sum(weight)) for w in weight]
    pieces = ["" if i <= 256 else n for i, n in enumerate(names)]
    import numpy as np

    return lm_score.Lattice(pieces, list(range(1, 257)), np.array(log)), {p: i for i, p in enumerate(pieces) if p}, list(range(1, 257)), log


def test_lattice_sums_over_all_segmentations():
    lattice, pieces, byte_ids, log = small_lattice()
    words = ["a", "ab", "abab", "bba", "é", "a日é", "zz", "▁a", "ababababab"]
    found, expected = lattice.walk(words), lattice.walk(words, expected=True)
    counts = collections.Counter()
    for word, x in zip(words, found):
        ways = spellings("▁" + word, pieces, byte_ids)
        shares = [math.exp(sum(log[i] for i in way)) for way in ways]
        assert math.isclose(x, math.log(sum(shares)) + log[-1], rel_tol=1e-12)
        for way, share in zip(ways, shares):
            for i in way:
                counts[i] += share / sum(shares)
    counts[len(log) - 1] = len(words)
    assert all(math.isclose(x, counts[i], abs_tol=1e-9) for i, x in enumerate(expected))


def test_long_words_are_walked_whole():
    lattice, pieces, byte_ids, log = small_lattice()
    long = "ab" * 4000
    reached = [0.0]
    marked = "▁" + long
    for j in range(1, len(marked) + 1):  # scaled sums, one letter after the other
        ways = [reached[i] + log[pieces[marked[i:j]]] for i in range(max(0, j - 3), j) if marked[i:j] in pieces]
        top = max(ways)
        reached.append(top + math.log(sum(math.exp(w - top) for w in ways)))
    assert math.isclose(lattice.walk(["b", long, "a"])[1], reached[-1] + log[-1], rel_tol=1e-10)


def scored(spark, rows, **columns):
    docs = spark.createDataFrame(rows, "doc_id long, train boolean, text string").withColumns({k: F.lit(v) for k, v in columns.items()})
    scratch = Scratch(spark, "test")
    model = lm_score.fit(docs, path("piece_bpe_32k.model"), scratch)
    return model, lm_score.score_documents(docs, model, scratch, keep=("doc_id", "train")).collect()


@pytest.mark.parametrize("share", [300_000, 40])
def test_base_and_score_equal_brute_force(spark, monkeypatch, share):
    monkeypatch.setattr(lm_score, "SHARE", share)
    rng = random.Random(2)
    texts = [*odd_texts(40), *(" ".join(rng.choice(["the", "The", "of", "ab#", "éa", f"w{rng.randint(0, 60)}"]) for _ in range(rng.randint(1, 80))) for _ in range(60)), None]
    rows = [(i if i % 7 else None, i % 4 != 1, t) for i, t in enumerate(texts)] + [(1, None, "only here"), (2, True, texts[50]), (2, True, texts[50])]
    model, found = scored(spark, rows, row=1, word="x", n=2, known=3)
    tokens = lambda t: [*(w.lower().decode() for w in (t or "").encode().split()), None]
    count = collections.Counter(w for _, train, t in rows if train for w in tokens(t))
    n, v = sum(count.values()), len(count)
    log_p = {r.word: r.log_p / math.log(10) for r in model.table.collect()} | {None: math.log10(count[None] / n)}
    assert len(found) == len(rows) and set(log_p) == {w for _, _, t in rows for w in tokens(t)}
    want = collections.Counter()
    for k, train, t in rows:
        words = tokens(t)
        base = sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words)
        want[k, train, len(words), sum(count[w] > 0 for w in words), n, round(base, 6), round(sum(log_p[w] for w in words), 6)] += 1
    assert collections.Counter((*r[:5], round(r.base_score, 6), round(r.score, 6)) for r in found) == want


def test_known_words_take_what_the_spelled_ones_leave(spark):
    model, _ = scored(spark, [(1, True, "a a a b"), (2, True, "a c"), (3, False, "d")])
    p = {r.word: math.exp(r.log_p) for r in model.table.collect()}
    # tokens: a 4, b 1, c 1, the end 2; three words leave 0.75 each
    assert p["a"] > 3.25 / 8 > p["a"] - 3 * 0.75 / 8 and p["b"] > 0.25 / 8 and 0 < p["d"] < 3 * 0.75 / 8
    assert sum(p.values()) + 2 / 8 < 1


def test_scores_without_training_rows_and_of_nothing(spark):
    _, found = scored(spark, [(1, False, "a b"), (2, None, None)])
    assert [(r.n_tokens, r.n_known, r.train_tokens) for r in sorted(found)] == [(3, 0, 0), (1, 0, 0)] and all(r.score < 0 for r in found)
    assert scored(spark, [])[1] == []


def test_lm_query_holds_out_by_the_checksum(spark, sf_dir):
    found = {r.doc_id: r for r in queries.QUERIES["op12_lm_score"](spark, sf_dir).collect()}
    texts = {r.doc_id: (r.text or "") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    held = {k: zlib.crc32(str(k).encode()) % 10 == 0 for k in texts}
    words = {k: [w.lower() for w in t.encode().split()] for k, t in texts.items()}
    count = collections.Counter(w for k, ws in words.items() if not held[k] for w in [*ws, None])
    n, v = sum(count.values()), len(count)
    assert set(found) == set(texts)
    for k, r in found.items():
        tokens = [*words[k], None]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[k], len(tokens), sum(count[w] > 0 for w in tokens), n)
        assert math.isclose(r.base_score, sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens), rel_tol=1e-9)


# Operator 13 -------------------------------------------------------------------------------------------------------------------------------


def brute_alignment(rows):
    import sentencepiece
    import tokenizers

    a_lib = tokenizers.Tokenizer.from_file(path("byte_bpe_50k.json"))
    a_lib.encode_special_tokens = True
    b_lib = sentencepiece.SentencePieceProcessor(model_file=path("piece_bpe_32k.model"))
    back = {c: b for b, c in enumerate(align.byte_letters())}
    docs = []
    for k, t in rows:
        a = a_lib.encode(" " + t, add_special_tokens=False) if t else None
        a_tokens = [(i, bytes(back[c] for c in token)) for i, token in zip(a.ids, a.tokens)] if a else []
        b_tokens = []
        for i in b_lib.encode(t) if t else []:
            piece = b_lib.id_to_piece(i)
            b_tokens.append((i, bytes([int(piece[3:5], 16)]) if re.fullmatch("<0x..>", piece) else piece.replace("▁", " ").encode()))
        whole = (" " + t).encode() if t else b""
        if b"".join(x for _, x in a_tokens) != whole or b"".join(x for _, x in b_tokens) != whole:
            a_tokens = b_tokens = []
        spans = []
        for tokens in (a_tokens, b_tokens):
            at, side = 0, []
            for i, x in tokens:
                side.append((at, at + len(x), i))
                at += len(x)
            spans.append(side)
        links = [(x, y) for s, e, x in spans[0] for u, v, y in spans[1] if s < v and u < e] if len(spans[0]) < 900 else _swept(*spans)
        cuts = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        groups, low = [], 0
        for c in cuts:
            groups.append("|".join(",".join(str(i) for s, e, i in side if low <= s and e <= c) for side in spans))
            low = c
        docs.append((k, len(a_tokens), len(b_tokens), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""))
    count = collections.Counter(p for d in docs for p in d[4])
    highest = collections.Counter()
    for (_, y), n in count.items():
        highest[y] = max(highest[y], n)
    return collections.Counter((k, n, m, g, len(links), sum(count[p] == highest[p[1]] for p in links), sum(count[p] for p in links), d) for k, n, m, g, links, d in docs)


def _swept(a, b):
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        out.append((a[i][2], b[j][2]))
        e, f = a[i][1], b[j][1]
        i, j = i + (e <= f), j + (f <= e)
    return out


@pytest.mark.parametrize("share", [200_000, 30])
def test_alignment_equals_brute_force(spark, monkeypatch, share, sf_dir):
    pytest.importorskip("sentencepiece")
    monkeypatch.setattr(align, "SHARE", share)
    texts = [*odd_texts(), None, *(r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy(F.octet_length("text")).limit(60).collect())]
    rows = [(i if i % 9 else None, t) for i, t in enumerate(texts)] + [(1, texts[12]), (1, texts[12]), (1, "another")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumns({c: F.lit(5) for c in ("row", "a", "b", "n", "count_sum", "k0")})
    found = align.align_documents(docs, path("byte_bpe_50k.json"), path("piece_bpe_32k.model"))
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert collections.Counter(map(tuple, found.collect())) == brute_alignment(rows)


def test_alignment_hands_on_full_totals(spark, monkeypatch):
    totals = align.Totals()
    import numpy as np

    monkeypatch.setattr(align, "HELD", 10)
    rng, want, full = np.random.default_rng(1), collections.Counter(), False
    for _ in range(20):
        k = np.unique(rng.integers(0, 40, 8))
        full |= totals.add(k, k + 1)
        want.update({int(x): int(x) + 1 for x in k})
    totals.merge()
    assert full and dict(zip(totals.keys.tolist(), totals.counts.tolist())) == dict(want)


def test_alignment_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert align.align_documents(docs, path("byte_bpe_50k.json"), path("piece_bpe_32k.model")).collect() == []
    blank = align.align_documents(spark.createDataFrame([(1, None), (2, "")], docs.schema), path("byte_bpe_50k.json"), path("piece_bpe_32k.model")).collect()
    assert sorted(map(tuple, blank)) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]
