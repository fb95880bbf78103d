"""The training-data operators against libraries, brute force and round trips, and their edge cases."""

import collections
import hashlib
import random
import re
import time
import tracemalloc
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.llm import bpe, chat_format, decontam, embed_dedup, html_extract, line_dedup, ngram_join, quality, queries, token_counts, toxicity
from tallyforge.llm import words as hashing

ODD = ["", " ", "a", "  a   b \n\n c\t", "é é ΑΣ Σ", "<|endoftext|>hi<|startoftext|> <|endoftext|>", "a\x1cb !\x1c! \x85 x　y", "don't I'LL we'VE 123 45", "a  b   c    d", "İstanbul ß", "日本語 😀😀", "$$$***### !!!", "x" * 20_000]


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def path(name):
    return queries._tokenizer(name)


def library(name):
    tokenizers = pytest.importorskip("tokenizers")
    return tokenizers.Tokenizer.from_file(path(name))


def odd_texts(n=300):
    rng = random.Random(1)
    parts = [" ", "  ", "\n", "\t", "a", "b", "'s", "'", "1", "é", "é", "Σ", "!", "?", " ", "\x1d", "the", "<|endoftext|>", "日", "😀", "thereof"]
    return ODD + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 30))) for _ in range(n)]


def test_bpe_equals_the_library(spark):
    texts = odd_texts()
    rows = table(spark, [*enumerate(texts), (-1, None), (0, texts[0]), (None, "a b")], "doc_id long, text string")
    found = bpe.encode_documents(rows, path("word_bpe_49k.json")).collect()
    tok = library("word_bpe_49k.json")
    assert len(found) == len(texts) + 3
    for r in found:
        ids = tok.encode(texts[r.doc_id] if r.doc_id is not None and r.doc_id >= 0 else "a b" if r.doc_id is None else "", add_special_tokens=False).ids
        assert r.token_ids == ids and r.decoded == tok.decode(ids, skip_special_tokens=False)


def test_bpe_segment_tree_takes_the_leftmost_lowest_pair():
    rng = random.Random(2)
    for _ in range(300):
        ranks = {(a, b): None for a in range(4) for b in range(4) if rng.random() < 0.6}
        order = list(ranks)
        rng.shuffle(order)
        new = {p: 4 + i for i, p in enumerate(order)}
        word = [rng.randrange(4) for _ in range(rng.randint(1, 20))]
        mine = bpe.merge(word, {a << 17 | b: i for i, (a, b) in enumerate(order)}, [new[p] for p in order])
        slow = list(word)
        while True:
            found = [(order.index((a, b)), i) for i, (a, b) in enumerate(zip(slow, slow[1:])) if (a, b) in new]
            if not found:
                break
            _, i = min(found)
            slow[i : i + 2] = [new[slow[i], slow[i + 1]]]
        assert mine == slow


def test_token_counts_equal_the_library(spark):
    texts = odd_texts()
    tok = library("byte_bpe_50k.json")
    found = token_counts.count_tokens(table(spark, [*enumerate(texts), (-1, None)], "doc_id long, text string"), path("byte_bpe_50k.json")).collect()
    for r in found:
        text = texts[r.doc_id] if r.doc_id >= 0 else ""
        assert (r.n_tokens, r.n_bytes) == (len(tok.encode(text, add_special_tokens=False).ids), len(text.encode())) and r.over_limit == (r.n_tokens > 1024)


@pytest.mark.parametrize("piece", [1 << 20, 3])
def test_word_hashes_are_those_of_the_words(monkeypatch, piece):
    monkeypatch.setattr(hashing, "PIECE", piece)
    hasher, seen = hashing.WordHasher(), {}
    for text in [*odd_texts(), "ab ba AB Ba a b aab aba baa \x1c\x0b \x85"]:
        words = text.encode().lower().split()
        found = hasher(text.encode()).tolist()
        assert len(found) == len(words)
        for w, h in zip(words, found, strict=True):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def sets_of(docs):
    out = {}
    for d, t in docs:
        w = (t or "").encode().lower().split()
        out[d] = frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    return out


def groups_by_hand(sets):
    inverse, shared, parent = collections.defaultdict(list), collections.Counter(), {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for d, s in sets.items():
        for x in s:
            inverse[x].append(d)
    for ids in inverse.values():
        for i, b in enumerate(ids):
            for a in ids[:i]:
                shared[a, b] += 1
    for (a, b), n in shared.items():
        if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    return {d: (len(s), root(d)) for d, s in sets.items()}


@pytest.mark.parametrize("small", [24, 3])
def test_jaccard_join_equals_brute_force(spark, monkeypatch, small):
    monkeypatch.setattr(ngram_join, "SMALL", small)
    rng = random.Random(small)
    words = [f"w{i}" for i in range(300)]
    some = lambda n: [rng.choice(words) for _ in range(n)]
    passage, docs = some(60), []
    for n in (5, 6, 7, 8, 9, 12, 20, 50, 150, 300):
        base = some(n)
        for _ in range(rng.choice([3, 40])):
            w = list(base)
            for _ in range(rng.randint(0, max(1, n // 12))):
                w[rng.randrange(n)] = rng.choice(words)
            docs.append(" ".join(w))
    docs += [" ".join(some(rng.randint(20, 120)) + passage) for _ in range(60)]
    docs += ["a b", "A  B", "a b c d", None, "", "   ", "x " * 100, "É é"]
    docs = list(enumerate(docs))
    rng.shuffle(docs)
    df = table(spark, [(d, t, "x", 1) for d, t in docs] + [(None, "a b", "x", 1)], "doc_id long, text string, class string, sig int")
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(df).collect()}
    assert found.pop(None) == (1, None)
    assert found == groups_by_hand(sets_of(docs))


def test_jaccard_join_of_an_id_with_several_texts(spark):
    rng = random.Random(14)
    some = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    z, w, y = some(80), some(80), some(80)
    near = lambda x: " ".join(x[:-1] + some(1))
    rows = [(5, "zz " + " ".join(z)), (5, " ".join(w)), (5, " ".join(w)), (7, near(w)), (3, near(z)), (9, " ".join(y)), (None, " ".join(w)), (None, None)]
    found = ngram_join.jaccard_components(table(spark, rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id) for r in found if r.doc_id) == [(3, 76, 3), (5, 76, 3), (5, 76, 3), (5, 77, 3), (7, 76, 3), (9, 76, 9)]
    assert [r.component_id for r in found if r.doc_id is None] == [None, None]


def test_pigeonhole_holds():
    for k, upper in enumerate(ngram_join.BANDS[:40]):
        count, spare, deletions = ngram_join.PLANS[k]
        h = max(ngram_join.differing(t) for t in (2 * upper, 2 * upper - 1))
        assert 2 * count > h if deletions else count - h >= spare + 1


def test_empty_tables(spark):
    docs = table(spark, [], "doc_id long, text string")
    assert ngram_join.jaccard_components(docs).count() == 0
    assert line_dedup.dedup_lines(docs).count() == 0
    assert bpe.encode_documents(docs, path("word_bpe_49k.json")).count() == 0
    assert token_counts.count_tokens(docs, path("byte_bpe_50k.json")).count() == 0
    labels = table(spark, [], "doc_id long, quality int, toxic int")
    some = table(spark, [(1, "a"), (2, None)], "doc_id long, text string")
    assert {r.score for r in quality.score_documents(some, quality.fit(some, labels)).collect()} == {0.5}
    assert {r.score for r in toxicity.score_documents(some, toxicity.fit(some, labels)).collect()} == {0.5}
    assert decontam.find_leaks(some, table(spark, [], "item_id long, text string")).where(F.size("leaks") > 0).count() == 0
    assert embed_dedup.near_duplicates(table(spark, [], "vec_id long, embedding array<float>")).count() == 0
    assert html_extract.extract_pages(table(spark, [], "page_id long, url string, html string")).count() == 0
    assert chat_format.digests(chat_format.format_turns(table(spark, [], "conv_id long, turn long, role string, text string"))).count() == 0


def test_embeddings_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embed_dedup, "BLOCK", 40)
    monkeypatch.setattr(embed_dedup, "PER_CELL", 30)
    rng = np.random.default_rng(0)
    base = rng.normal(size=(60, 8))
    x = np.concatenate([base, base[:30] + rng.normal(scale=0.12, size=(30, 8)), np.repeat(base[:1], 80, 0) + rng.normal(scale=0.05, size=(80, 8)), base[:2], -base[:2]])
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(x)]
    odd = [(900, None), (901, [0.0] * 8), (902, [1.0, None] + [0.0] * 6), (903, [float("nan")] * 8), (904, [float("inf")] * 8), (905, [1.0]), (906, []), (0, rows[0][1]), (None, rows[0][1])]
    found = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embed_dedup.near_duplicates(table(spark, rows + odd, "vec_id long, embedding array<float>")).collect()}
    u = np.array([v for _, v in rows])
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    label = np.arange(len(near))
    for _ in range(len(near)):
        label = np.minimum(label, np.where(near, label[None, :], len(near)).min(1))
    assert near.sum() > 1000
    for i in range(len(rows)):
        assert found[i] == (near[i].sum(), label[i], label[i] == i)
    assert all(found[i] == (0, i, True) for i in range(900, 907)) and found[None] == (0, None, False)


def test_embeddings_of_repeated_and_missing_ids(spark):
    a, b, c = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]
    rows = [(5, a), (5, a), (5, b), (7, b), (7, b), (8, [0.01, 1.0, 0.0]), (3, a), (9, c), (None, a), (None, a), (5, None)]
    found = embed_dedup.near_duplicates(table(spark, [(*r, 1) for r in rows], "vec_id long, embedding array<float>, id int")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in found if r.vec_id) == [(3, 1, 3, True), (5, 3, 3, False), (7, 2, 3, False), (8, 2, 3, False), (9, 0, 9, True)]
    assert [(r.n_links, r.component_id, r.kept) for r in found if r.vec_id is None] == [(0, None, False)] * 2


def test_guests_meet_linked_vectors_in_many_cells():
    rng = np.random.default_rng(4)
    base = embed_dedup.unit(rng.normal(size=(6000, 64)))
    apart = rng.normal(size=base.shape)
    other = embed_dedup.unit(base + 0.3 * embed_dedup.unit(apart - (apart * base).sum(1, keepdims=True) * base))  # cosines of 0.957
    centres = embed_dedup.spherical_kmeans(base, 60)
    between = np.sqrt(np.maximum(0, 2 - 2 * centres @ centres.T))
    for spreads, least in ((embed_dedup.SPREADS, 0.995), (8.0, 1.0)):
        (h, r, c), (k, q, d) = (embed_dedup.visited(x, centres, between, embed_dedup.margin(64, 0.95, spreads)) for x in (base, other))
        first, second = set(zip(r.tolist(), c.tolist(), strict=True)), set(zip(q.tolist(), d.tolist(), strict=True))
        met = [h[i] == k[i] or (i, k[i]) in first or (i, h[i]) in second for i in range(len(base))]
        assert np.mean(met) >= least and (h != k).sum() > 900


def test_embeddings_along_few_directions_equal_brute_force(spark, monkeypatch):
    """Groups that vary along one to three directions are cut by cells exactly along these."""
    monkeypatch.setattr(embed_dedup, "BLOCK", 40)
    monkeypatch.setattr(embed_dedup, "PER_CELL", 30)
    rng = np.random.default_rng(6)
    parts = []
    for rank in (1, 2, 3):
        axes = np.linalg.qr(rng.normal(size=(64, rank + 1)))[0].T
        parts.append(axes[0] + rng.uniform(-1, 1, size=(200, rank)) @ axes[1:] + rng.normal(scale=0.002, size=(200, 64)))
    x = np.concatenate(parts).astype(np.float32)
    found = {r.vec_id: (r.n_links, r.component_id) for r in embed_dedup.near_duplicates(table(spark, [(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")).collect()}
    u = embed_dedup.unit(x.astype(np.float64))
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    label = np.arange(len(near))
    for _ in range(len(near)):
        label = np.minimum(label, np.where(near, label[None, :], len(near)).min(1))
    assert sum(n for n, _ in found.values()) == near.sum() > 10_000  # recall 1
    assert all(found[i] == (near[i].sum(), label[i]) for i in range(len(x)))


def labelled(rng, n):
    words = ["ba", "du", "ki", "lo", "me", "nu", "po", "ra"]
    rows = []
    for i in range(n):
        text = " ".join("".join(rng.choice(words) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(5, 120)))
        bad, toxic = rng.random() < 0.3, rng.random() < 0.3
        if bad:
            text = " ".join(w + "%%%" for w in text.split())
        if toxic:
            text += " zorgish" * rng.randint(1, 3)
        rows.append((i, text, int(not bad), int(toxic)))
    return rows


def test_classifiers_learn(spark, monkeypatch):
    monkeypatch.setattr(quality, "EPOCHS", 25)
    rows = labelled(random.Random(4), 500)
    docs = table(spark, [r[:2] for r in rows] + [(-1, None), (-2, ""), (7, rows[7][1])], "doc_id long, text string")
    labels = table(spark, [(r[0], r[2], r[3]) for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2], "doc_id long, quality int, toxic int")
    held = {r[0]: r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2}
    for op, at in ((quality, 2), (toxicity, 3)):
        scores = {r.doc_id: r.score for r in op.score_documents(docs, op.fit(docs, labels)).collect()}
        assert all(0 <= s <= 1 for s in scores.values()) and scores[-1] == scores[-2]
        assert np.mean([(scores[i] >= 0.5) == r[at] for i, r in held.items()]) > 0.9, op


def test_network_reads_the_whole_text():
    net = quality.train([b"good " * 20, b"bad%%% " * 20] * 40, np.array([1.0, 0.0] * 40))
    a = quality.score(net, [b"good " * 4000, b"good " * 4000 + b"bad%%% " * 4000])
    assert a[0] > a[1]


def test_scores_depend_on_the_text_alone():
    net = quality.train([b"good " * 20, b"bad%%% " * 20] * 40, np.array([1.0, 0.0] * 40))
    texts = [b"", b"%%%%", b"", b"x" * 125, b"%" * 126, b"x" * 125]
    together = quality.score(net, texts)
    assert together.tolist() == [quality.score(net, [t])[0] for t in texts]
    many = quality.score(net, [b"good bad%%% " * (i % 7) for i in range(400)])
    assert all(many[i] == many[i % 7] for i in range(400))


def test_quality_of_held_out_rows_at_the_production_setting(spark):
    d = "/root/testdata/sf0.1"
    scored = {r.doc_id: r for r in queries.op4_quality(spark, d).where("held_out").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").where("quality IS NOT NULL").collect() if r.doc_id in scored}
    good, bad = ([scored[i].predicted for i in labels if labels[i] == y] for y in (1, 0))
    assert len(bad) > 80 and np.mean(good) > 0.97 and np.mean(bad) < 0.05


def test_toxicity_of_held_out_rows_at_the_production_setting(spark):
    d = "/root/testdata/sf0.1"
    scored = {r.doc_id: r for r in queries.op10_toxicity(spark, d).where("held_out").collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{d}/labels.parquet").where("toxic IS NOT NULL").collect() if r.doc_id in scored}
    y, p, s = (np.array(x) for x in ([labels[i] for i in labels], [scored[i].predicted for i in labels], [scored[i].score for i in labels]))
    assert np.mean([len(scored[i].evidence) > 0 for i in labels]) > 0.95
    assert p[y == 1].mean() > 0.8 and y[p == 1].mean() > 0.93 and ((s - y) ** 2).mean() < 0.03 and abs(s.mean() - y.mean()) < 0.03


def by_hand(examples, docs):
    """TF-IDF cosines of every document with every example, term by term."""
    def bag(text):
        words = re.findall(r"[a-z0-9_\x80-\U0010ffff]+", (text or "").lower())
        return collections.Counter(t for w in words for t in [w.encode(), *((w.encode()[:k], k) for k in (4, 5, 6, 7) if k < len(w.encode()))])

    bags, known = [bag(t) for t in docs], {t for _, text, _ in examples for t in bag(text)}
    idf = {t: np.log(1 + len(docs) / max(1, sum(t in b for b in bags))) ** 2 for t in known}
    weigh = lambda b: {t: n * idf[t] for t, n in b.items() if t in known}
    unit = lambda w: {t: x / np.sqrt(sum(y * y for y in w.values())) for t, x in w.items()}
    left, right = [unit(weigh(b)) for b in bags], [unit(weigh(bag(t))) for _, t, _ in examples]
    return np.array([[sum(x * r.get(t, 0) for t, x in d.items()) for r in right] for d in left])


def test_toxicity_equals_dense_cosines(spark, monkeypatch):
    """End to end against brute force: neighbours, evidence and scores, with dense, common and rare terms."""
    monkeypatch.setattr(toxicity, "LEAST_NEAREST", 20)
    monkeypatch.setattr(toxicity, "BLOCK", 16)
    monkeypatch.setattr(toxicity, "DENSE", 0.4)
    monkeypatch.setattr(toxicity, "STEP", 2)
    monkeypatch.setattr(toxicity, "POWERS", (2.0,))
    rng = random.Random(5)
    rows = [(i, t + (" schön Ärger été" if i % 3 else ""), y) for i, t, _, y in labelled(rng, 160)]
    texts = [t for _, t, _ in rows] + [None, "", "qqqqq", rows[3][1], "zorgish " * 3000]
    docs = table(spark, list(enumerate(texts)), "doc_id long, text string")
    labels = table(spark, [(i, y) for i, _, y in rows if i % 4] + [(None, 1), (9999, 1)], "doc_id long, toxic int")
    examples = [r for r in rows if r[0] % 4]
    index = toxicity.fit(docs, labels)
    assert (index.dense >= 0).any() and (index.common >= 0).any() and ((index.common < 0) & (index.dense < 0)).any()
    cosines = by_hand(examples, texts)
    found = {r.doc_id: r for r in toxicity.score_documents(docs, index).collect()}
    for d in range(len(texts)):
        best = sorted(((-round(c, 6), examples[e][0], examples[e][2]) for e, c in enumerate(cosines[d]) if c > 1e-9))[:20]
        share = (toxicity.PRIOR * index.base + sum(-c * y for c, _, y in best)) / (toxicity.PRIOR + sum(-c for c, *_ in best))
        want = 1 / (1 + np.exp(-(index.slope * toxicity._logit(share) + index.offset)))
        assert abs(found[d].score - want) < 1e-3
        assert np.allclose([e.cosine for e in found[d].evidence], [-c for c, *_ in best[:5]], atol=2e-6)
    assert found[3].score == found[163].score and found[160].score == found[161].score == found[162].score and found[160].evidence == []


def test_short_pretokens_merge_under_the_root_as_in_the_tree_and_sooner():
    rng = random.Random(5)
    rank_of, merged = {}, []
    while len(merged) < 400:
        pair = rng.randrange(8 + len(merged) // 4) << 17 | rng.randrange(8 + len(merged) // 4)
        if pair not in rank_of:
            rank_of[pair] = len(merged)
            merged.append(8 + len(merged))
    words = [[rng.randrange(8) for _ in range(n)] for n in range(130) for _ in range(20)]
    kept = [w[:] for w in words]
    assert [bpe.merge(w, rank_of, merged) for w in words] == [bpe.merge_in_tree(w, rank_of, merged) for w in words] == [bpe.merge_under_root(w, rank_of, merged) for w in words]
    assert words == kept
    short = [w for w in words if 4 <= len(w) <= 16] * 10

    def seconds(how) -> float:
        start = time.process_time()
        for w in short:
            how(w, rank_of, merged)
        return time.process_time() - start

    assert min(seconds(bpe.merge) for _ in range(5)) < 0.8 * min(seconds(bpe.merge_in_tree) for _ in range(5))


def test_short_words_are_counted_without_a_binary_tree(monkeypatch):
    import public_tokenizers

    b = bpe.load(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["Quervanten bilostrade um Zwölfe", "x" * 40 + " naïve " + "qzv" * 12, " 12345  67\n\nab'll"]
    want = [len(b"".join(np.array(bpe.merge_in_tree([b.byte_id[c] for c in w.encode()], b.rank_of, b.merged), "<i4").tobytes() for w in b.pretokens(t))) // 4 for t in texts]
    monkeypatch.setattr(bpe, "merge_in_tree", None)
    counter = token_counts.Counter(b, frozenset())
    assert [counter.count(t) for t in texts] == want


def test_toxicity_holds_the_tables_of_one_index_at_a_time():
    """The driver keeps the postings of the best power; the tables of one index are there while its line is fitted."""
    rng, words = random.Random(7), [f"w{i:05}" for i in range(3000)]
    examples = [(i, " ".join(rng.choices(words, k=300)), i % 2) for i in range(1200)]
    vocabulary = toxicity.vocabulary_of(examples)
    found = np.full(len(vocabulary.names), 100)
    index = toxicity.build(examples, vocabulary, 1200, found)
    assert not {"matrix", "block_max", "begin"} & set(vars(index)) and index.place.dtype == np.int32
    index.tables()
    held = sum(x.nbytes for x in vars(index).values() if isinstance(x, np.ndarray))
    del index
    tracemalloc.start()
    toxicity.build(examples, vocabulary, 1200, found)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2 * held


def test_toxicity_is_calibrated(spark):
    """On rows whose labels weren't given: the mean score is the share of toxic rows, and scores of a fifth of the range too."""
    rows = labelled(random.Random(12), 900)
    docs = table(spark, [r[:2] for r in rows], "doc_id long, text string")
    scores = {r.doc_id: r.score for r in toxicity.score_documents(docs, toxicity.fit(docs, table(spark, [(r[0], r[3]) for r in rows[:600]], "doc_id long, toxic int"))).collect()}
    s, y = np.array([scores[r[0]] for r in rows[600:]]), np.array([r[3] for r in rows[600:]])
    assert abs(s.mean() - y.mean()) < 0.06 and ((s - y) ** 2).mean() < 0.1
    for low in (0, 0.8):
        part = (s >= low) & (s <= low + 0.2)
        assert part.sum() > 20 and abs(s[part].mean() - y[part].mean()) < 0.12


def test_decontamination_finds_edited_items(spark):
    rng = random.Random(6)
    words = [f"v{i}" for i in range(2000)]
    some = lambda n: [rng.choice(words) for _ in range(n)]
    items = [(i, " ".join(some(rng.randint(15, 60)))) for i in range(40)]
    docs, expected = [], {}
    for d in range(160):
        i, item = items[d % 40]
        w = item.split()
        for _ in range(rng.randint(0, int(len(w) * 0.15))):
            w[rng.randrange(len(w))] = rng.choice(words)
        docs.append((d, " ".join(some(rng.randint(0, 80)) + w + some(rng.randint(0, 80)))))
        expected[d] = i
    docs += [(1000 + d, " ".join(some(200))) for d in range(60)] + [(2000, None), (2001, ""), (2002, docs[0][1].upper()), (0, docs[0][1])]
    expected[2002] = expected[0]
    items_df = table(spark, items + [(90, None), (91, "... !"), (None, "a b c"), items[0]], "item_id long, text string")
    found = decontam.find_leaks(table(spark, [(*x, 5) for x in docs], "doc_id long, text string, leaks int"), items_df).collect()
    got = {r.doc_id: [x.item_id for x in r.leaks] for r in found}
    assert len(found) == len(docs)
    assert np.mean([expected[d] in got[d] for d in expected]) >= 0.95
    assert not any(got[d] for d in got if d not in expected)


@pytest.mark.parametrize("share, least", [(0.1, 0.99), (0.15, 0.97), (0.2, 0.9)])
def test_decontamination_recall_by_edits_against_brute_force(spark, share, least, monkeypatch):
    """Substitutions, insertions and deletions; more items than one chunk; an item twice in a text; what brute force doesn't find isn't found."""
    monkeypatch.setattr(decontam, "CHUNK", 20)
    rng = random.Random(int(share * 100))
    words = [f"v{i}" for i in range(3000)]
    some = lambda n: [rng.choice(words) for _ in range(n)]
    items = [(i, some(rng.randint(15, 60))) for i in range(50)]
    docs = []
    for d in range(150):
        w = list(items[d % 50][1])
        for _ in range(int(len(w) * share)):
            at = rng.randrange(len(w))
            w[at : at + rng.choice([0, 1, 1])] = rng.choice([[], some(1), some(1)])
        docs.append((d, some(rng.randint(0, 60)) + w + some(rng.randint(0, 60)) + (w if d % 10 == 0 else [])))
    docs += [(1000 + d, some(150)) for d in range(30)]
    want = {d: {i: e for i, p in items if (e := decontam.edit_search(p, w)[0]) <= decontam.allowed(len(p))} for d, w in docs}
    found = decontam.find_leaks(table(spark, [(d, " ".join(w)) for d, w in docs], "doc_id long, text string"), table(spark, [(i, " ".join(p)) for i, p in items], "item_id long, text string")).collect()
    got = {r.doc_id: {x.item_id: x.distance for x in r.leaks} for r in found}
    assert all(len(r.leaks) == len({x.item_id for x in r.leaks}) for r in found) and len(found) == len(docs)
    assert all(i in want[d] and e >= want[d][i] for d in got for i, e in got[d].items())
    pairs = [(d, i) for d in want for i in want[d]]
    assert len(pairs) > 100 and np.mean([i in got[d] for d, i in pairs]) >= least


def test_edit_search():
    def slow(p, t):
        row = [0] * (len(t) + 1)
        for i, x in enumerate(p, 1):
            after = [i]
            for j, y in enumerate(t, 1):
                after.append(min(row[j] + 1, after[-1] + 1, row[j - 1] + (x != y)))
            row = after
        return min(row)

    rng = random.Random(7)
    for _ in range(300):
        p, t = [rng.randrange(5) for _ in range(rng.randint(1, 12))], [rng.randrange(5) for _ in range(rng.randint(0, 25))]
        assert decontam.edit_search(p, t)[0] == slow(p, t)


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(20_000)]  # so that nothing but the passages repeats
    some = lambda n: [rng.choice(words) for _ in range(n)]
    passages, docs = [some(n) for n in (50, 51, 60, 49, 120)], []
    for d in range(50):
        w = some(rng.randint(0, 80))
        for _ in range(rng.randint(0, 2)):
            w += rng.choice(passages) + some(rng.randint(0, 30))
        docs.append((d, "".join(x + rng.choice([" ", " ", "\n", "  "]) for x in w).strip()))
    docs += [(62, docs[3][1]), (63, None), (64, "")]
    rows = [(*x, "a", 1) for x in docs] + [(None, docs[3][1], "a", 1), (62, docs[3][1], "a", 1)]
    found = line_dedup.dedup_lines(table(spark, rows, "doc_id long, text string, first string, runs int")).collect()
    assert len(found) == len(rows)
    out = {r.doc_id: r for r in found}
    assert out[None].text == docs[3][1] and out[63].text is None and out[64].text == ""
    seen = set()
    for d, t in docs:
        w = (t or "").split()
        want = [False] * len(w)
        for i in range(len(w) - 49):
            if (g := tuple(w[i : i + 50])) in seen:
                want[i : i + 50] = [True] * 50
            seen.add(g)
        got = [False] * len(w)
        for r in out[d].runs:
            got[r.start : r.end] = [True] * (r.end - r.start)
        assert got == want
        assert (out[d].text or "").split() == [x for x, gone in zip(w, got) if not gone]


@pytest.mark.parametrize("several", [False, True])
def test_line_dedup_sees_past_short_earlier_overlaps(spark, several):
    """Earlier documents hold 16 to 49 words of a passage, later ones all of it; texts with a period; several texts of an id."""
    rng = random.Random(9)
    some = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    docs = []
    for n in [50, 51, 55, 60, 70, 85, 100, 150] * 5:
        p = some(n)
        cuts = [(a, min(n, a + rng.randint(16, 49))) for a in range(0, n - 15, 15)]
        docs += [some(20) + p[a:b] + some(20) for a, b in cuts] + [some(rng.randint(0, 40)) + p + some(rng.randint(0, 40)) for _ in range(3)]
    docs += [["a"] * 130, ["a", "b"] * 60, some(7) * 12 + some(30), ["a"] * 90 + some(60)]
    rows = [(i, " ".join(w)) for i, w in enumerate(docs)]
    if several:
        rows += [(-1, " ".join(some(9) + docs[5] + some(4))), (-1, " ".join(some(5) + docs[5]))]
    found = {(r.doc_id, r.n_words, r.text): r for r in line_dedup.dedup_lines(table(spark, rows, "doc_id long, text string")).collect()}
    seen, n_gone = set(), 0
    left = sorted((r for r in found.values() if r.doc_id == -1), key=lambda r: r.n_removed)
    if several:
        assert len(left) == 2 and left[0].n_removed == 0 and left[1].n_removed == len(docs[5])
        seen |= {tuple(docs[5][i : i + 50]) for i in range(len(docs[5]) - 49)}
    for i, w in enumerate(docs):
        gone = [False] * len(w)
        for a in range(len(w) - 49):
            if (g := tuple(w[a : a + 50])) in seen:
                gone[a : a + 50] = [True] * 50
            seen.add(g)
        n_gone += sum(gone)
        text = " ".join(x for x, y in zip(w, gone, strict=True) if not y)
        assert (i, len(w), text) in found, (i, len(w))
    assert n_gone > 5000


def parsed(text, step):
    parser, out = chat_format.Parser(), []
    for a in range(0, len(text), step):
        out += parser.feed(text[a : a + step])
    parser.end()
    return out


def test_chat_formatting_round_trip(spark):
    """Turns parsed from whole conversations, and the loss mask, against the rows they were made of."""
    rng = random.Random(15)
    bits = ["</s>", "[INST]", " ok ", "[/INST]", "\\", "\\[", "<<SYS>>", "<</SYS>>", "<s>", "é😀", "<image:0>", "[/ROLE]", "[ROLE=x]", "]", ">", "\n", "\r\n", ""]
    roles = ["system", "user", "assistant", "assistant", None, "to]ol", "[ROLE=a]", ""]
    rows = [(c, t, rng.choice(roles), rng.choice([None, "", *("".join(rng.choice(bits) for _ in range(rng.randint(1, 9))) for _ in range(9))])) for c in [*range(40), None, -7] for t in range(rng.randint(1, 9))]
    rows += [(-7, 100, "user", "</s>[INST] ok [/INST]"), (-7, 101, "assistant", "</s>[INST] ok [/INST]"), (-8, None, "assistant", "first"), (-8, 0, "user", "then"), *[(-9, 0, "assistant", "a]</s>")] * 3, (-10, 0, "assistant", "</s>[INST]" * 100_000)]
    turns = chat_format.format_turns(table(spark, [(*r, "clash", 5) for r in rows], "conv_id long, turn long, role string, text string, piece string, loss_chars int"))
    by_conv = collections.defaultdict(list)
    for c, t, r, x in rows:
        by_conv[c].append((-1 if t is None else t, r or "", x or ""))
    pieces = collections.defaultdict(list)
    for r in turns.collect():
        pieces[r.conv_id].append((-1 if r.turn is None else r.turn, r.role, r.text, r.piece, r.loss_start, r.loss_chars))
    found = {r.conv_id: r for r in chat_format.digests(turns).collect()}
    assert set(found) == set(by_conv)
    for c, said in by_conv.items():
        said.sort()
        own = sorted(pieces[c], key=lambda p: p[:3])
        whole = "".join(p[3] for p in own)
        for step in (1, 7, len(whole)) if len(whole) < 5000 else (9973,):
            assert parsed(whole, step) == [x[1:] for x in said]
        spoken = "".join(x for _, r, x in said if r == "assistant")
        masked = "".join(chat_format.unescape(p[3][p[4] : p[4] + p[5]]) for p in own if p[5] is not None)
        r = found[c]
        assert masked == spoken and (r.n_turns, r.formatted_chars, r.loss_chars) == (len(said), len(whole), len(spoken))
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in said).encode()).hexdigest() and r.loss_sha256 == hashlib.sha256(spoken.encode()).hexdigest()
    assert sum(r.loss_chars for r in found.values()) > 1_000_000


def test_chat_parser_refuses_what_isn_t_formatted():
    for text in ("[INST]a</s>", "[INST]a", "a", "[INST]a[/INST]b", "<s>a[INST]b[/INST]</s>"):
        with pytest.raises(ValueError):
            parsed(text, 3)


def test_chat_parts(spark):
    parts = [("text", "see <", None, None, None, None, None), ("image", None, "u1", 28, 15, None, None), ("audio", None, "u2", None, None, 1.5, None), ("document", None, "u3", None, None, None, 2), None, ("/s>", None, None, None, None, None, None)]
    df = table(spark, [(1, 0, "user", parts)], f"conv_id long, turn long, role string, parts {chat_format.PARTS}")
    r = chat_format.format_turns(df, parts="parts").first()
    assert r.piece == "[INST]see \\<<image:0><audio:1><document:2><\\/s\\>:3>[/INST]" and parsed(r.piece, 2) == [("user", "see <<image:0><audio:1><document:2></s>:3>")]
    assert [(a.number, a.type, a.ref, a.tokens) for a in r.attachments] == [(0, "image", "u1", 4), (1, "audio", "u2", 38), (2, "document", "u3", 1600), (3, "/s>", None, 0)]


def page(i, body):
    return (i, f"http://h.example.org/{i}", f"<html><head><title>t{i}</title><script>if(a<b)x('</p>')</script></head><body><header class='top'>Site</header><nav><ul><li>Home<li>About {i}</ul></nav><div class='cookie-notice'>We use</div><article><h1>Head {i} &amp; more</h1>{body}<div class='share'>Share</div></article><aside>Other {i}</aside><div id=comments><p>nice {i}</p></div><form>in<input></form><footer>&copy; {i}</footer></body></html>")


def test_html_extraction(spark):
    rows = [page(i, f"<p>One  {i}<br>two\n<b>bold</b></p><p>un closed<p>last &lt;x&gt; a < b") for i in range(8)]
    rows += [(90, None, None), (91, "x", ""), (92, "http://z.org", "just <b>text</b>"), (93, "http://z.org", "<main><p>m</p><nav>n</nav></main><p>out"), (94, "http://z.org", "<article>" + "<p>q</p>" * 3000), rows[0]]
    df = table(spark, [(*r, "clash") for r in rows], "page_id long, url string, html string, host string")
    found = html_extract.extract_pages(df).collect()
    assert len(found) == len(rows)
    out = {r.page_id: r.text for r in found}
    for i in range(8):
        assert out[i] == f"Head {i} & more\nOne {i} two bold\nun closed\nlast <x> a < b"
    assert (out[90], out[91], out[92], out[93], out[94]) == ("", "", "just text", "m", "\n".join(["q"] * 3000))


@pytest.mark.parametrize("n", [1, 3, 10, 25])
def test_html_template_does_not_depend_on_the_number_of_pages(spark, n):
    """Only marked parts and elements that say the same in every page go, from the few pages on that tell a template."""
    inner = "<h1>Title {i}</h1><p>Body {i} and more {i}</p><p>Conclusion</p><div class='legal'>Legal</div><div class='search-results'>Results</div><p class='advert'>Buy {i}<p>Hot <span class='ad'>Sponsored <span>x</span> {i}</span> end</p>"
    shell = "<html><body><div class='site has-sidebar'><div class=top><ul><li>Home</ul></div><div class='sidebar'>Side {i}</div>%s<div class='promo'><p>Offer {i}</div></div></body></html>"
    rows = [(i, f"http://a.org/{i}", (shell % f"<article>{inner}</article>").replace("{i}", str(i))) for i in range(n)]
    rows += [(100 + i, f"http://b.org/{i}", (shell % f"<div class='c17'><div>{inner}</div></div>").replace("{i}", str(i))) for i in range(n)]
    found = html_extract.extract_pages(table(spark, rows, "page_id long, url string, html string")).collect()
    for r in found:
        if r.page_id < 100 or n > 1:
            repeated = "" if n >= html_extract.FEW else "Legal\nResults\n"
            assert r.text == f"Title {r.page_id % 100}\nBody {r.page_id % 100} and more {r.page_id % 100}\nConclusion\n{repeated}Hot end", r


@pytest.mark.parametrize("n", [3, 10, 25])
def test_html_slots_stay_and_the_template_goes_whatever_their_names(spark, n):
    inner = (
        "<h1>T {i}</h1><section id='discussion'><p>The discussion of {i}.</p></section><div class='related-work'>Others did {i}</div><p class='banner-text'>A banner {i} flew</p><p class='share-price'>It rose by {i}</p>"
        "<div class='menu'><p>Soup, fish and cake {i}</p></div><div class='tip'>Like us? <b>Tell</b> a friend today!</div><p class='notice'>Read our terms</p><div class='comments'><p>first {i}</p></div><h2>Summary</h2><p>End {i}</p>"
    )
    want = "T {i}\nThe discussion of {i}.\nOthers did {i}\nA banner {i} flew\nIt rose by {i}\nSoup, fish and cake {i}\nSummary\nEnd {i}"
    rows = [(i, f"http://a.org/{i}", f"<body><nav>n</nav><article>{inner}</article></body>".replace("{i}", str(i))) for i in range(n)]
    rows += [(100 + i, f"http://b.org/{i}", f"<body><ul><li>n</ul><div class='story'>{inner}</div><div class=end>All rights</div></body>".replace("{i}", str(i))) for i in range(n)]
    for r in html_extract.extract_pages(table(spark, rows, "page_id long, url string, html string")).collect():
        assert r.text == want.replace("{i}", str(r.page_id % 100)), r


def test_html_pages_that_all_say_the_same_stay_whole(spark):
    rows = [(i, f"http://a.org/{i}", "<body><nav>n</nav><article><div class=x><p>Only this</p></div><p>and that</p></article></body>") for i in range(9)]
    rows += [(20 + i, f"http://b.org/{i}", f"<body><article><div class=x>{'Copied text' if i else 'Another text'}</div><p>p {'' if i else 'other'}</p></article></body>") for i in range(4)]
    out = {r.page_id: r.text for r in html_extract.extract_pages(table(spark, rows, "page_id long, url string, html string")).collect()}
    assert {out[i] for i in range(9)} == {"Only this\nand that"} and out[20] == "Another text\np other" and {out[i] for i in (21, 22, 23)} == {"Copied text\np"}


def test_html_templates_equal_brute_force(spark):
    """Generated hosts with random wrappers: the occurrence vectors summed by Spark give the classes that whole vectors give, and the article comes back."""
    rng = random.Random(13)
    rows, want, word = [], {}, lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    for host in range(8):
        around = [rng.choice(["div class=w%d" % k, "section", "div", "div id=x%d" % k]) for k in range(rng.randint(0, 4))]
        side = rng.random() < 0.7
        tips = [f"<div class=t{k}>{' '.join(word() for _ in range(rng.randint(1, 9)))}</div>" for k in range(rng.randint(0, 3))]
        for i in range(25):
            key = host * 100 + i
            paragraphs = [" ".join(word() for _ in range(rng.randint(5, 40))) for _ in range(rng.randint(2, 6))]
            parts = [f"<p>{p}</p>" for p in paragraphs]
            for tip in tips:  # boilerplate inside the article
                parts.insert(rng.randint(0, len(parts)), tip)
            body = "".join(parts)
            if i % 3 == 0 and not tips:
                body = f"<div id=post-{key}>{body}</div>"
            page = f"<main class=page>{body}</main>" if host % 2 else f"<div class=text>{body}</div>"
            if side:
                page = f"<div class=logo>Same words on every page of this host, and many of them, {'x ' * 300}</div>{page}<ul class=list><li>one<li>two {word()}</ul>"
            for w in around:
                page = f"<{w}>{page}</{w.split(' ')[0]}>"
            rows.append((key, f"http://h{host}.org/{i}", f"<html><body class='id-{key}'><nav>menu {word()}</nav>{page}<footer>f {word()}</footer></body></html>"))
            want[key] = "\n".join(paragraphs)
    df = table(spark, rows, "page_id long, url string, html string")
    out = {r.page_id: r.text for r in html_extract.extract_pages(df).collect()}
    assert out == want
    vectors = collections.defaultdict(dict)
    for key, url, page in rows:
        for path, (count, *_) in html_extract.tokens(page)[0].items():
            vectors[url[7:9], path][key] = count
    summed = html_extract.occurrence_vectors(df.select(html_extract.host_of(F.col("url")).alias("host"), F.col("page_id").cast("string"), "html")).where("text IS NULL").collect()
    assert len(summed) == len(vectors)
    groups = [collections.defaultdict(set), collections.defaultdict(set)]
    for r in summed:
        groups[0][r.host, r.vector].add(r.path)
        groups[1][r.host, tuple(sorted(vectors[r.host[:2], r.path].items()))].add(r.path)
    assert sorted(map(sorted, groups[0].values())) == sorted(map(sorted, groups[1].values()))


def test_tokens_of_odd_tables(spark):
    """Clashing columns, nothing at all, and a text of a megabyte in one word."""
    clash = {c: F.lit("x") for c in ("token_ids", "decoded", "__text", "n_tokens", "n_bytes", "over_limit")}
    long = "ab" * 500_000
    rows = table(spark, [(1, long), (2, None), (2, None)], "doc_id long, text string").withColumns(clash)
    encoded = {r.doc_id: len(r.token_ids) for r in bpe.encode_documents(rows, path("word_bpe_49k.json")).collect()}
    counted = bpe.digests(bpe.encode_documents(rows.limit(0), path("word_bpe_49k.json")), "doc_id").collect()
    found = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(rows, path("byte_bpe_50k.json")).collect()}
    assert encoded[1] == len(library("word_bpe_49k.json").encode(long, add_special_tokens=False).ids) and encoded[2] == 0 and counted == []
    assert found[1] == (1_000_000, len(library("byte_bpe_50k.json").encode(long, add_special_tokens=False).ids), True) and found[2] == (0, 0, False)
    assert token_counts.count_tokens(rows.limit(0), path("byte_bpe_50k.json")).collect() == []


def test_every_operator_has_its_query():
    assert {int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES} == set(range(1, 14))
