"""N-gram Jaccard self-join by partitioning the universe.

A document's set is its distinct SHINGLE-word shingles. Sizes fall into bands, each a quarter wider than the one before,
so linked sets lie in one band or in neighbouring ones; a set is signed in its own band and in the one above. In a band
whose largest size is U, linked sets differ in at most H tokens. Tokens are dealt by hash into segments:

* long bands have H + 1 + spare segments, each signed by the hash of what it holds. Linked sets agree in spare + 1 of
  them, so up to ``spare`` segments that are empty or very common can be left out;
* short bands have half as many, signed by their content and by each content less one token (one-deletion
  neighbourhoods): if all segments differed by two or more, the sets would differ by more than H.

``allocation`` takes the cheaper one for each band. Equal sets are one class, which is signed once. Signatures that
two classes share are kept. Groups of at most SMALL classes give their pairs, which have to agree in as many segments as the
spare ones tell. Of a larger group each class is paired with
one hub only; its other links are found among the few classes of which more than the spare segments are so common
(any linked pair not found otherwise are both such): there, classes not yet joined with the others of their cluster are
compared with all of it, in blocks. Every pair is verified exactly on the whole texts, so the result is exact.

Defined cases: null and empty texts have an empty set, size 0, and link with nothing; rows without an id are left out of
links and come back each with a null component; rows that repeat an id are one document, which has the links of all its texts, and come back each
with the size of its own set; equal sets are linked; other columns are dropped.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import connected
from .common import Scratch, slices
from .words import WordHasher, distinct, mix, rolling

SHINGLE = 5
#: Linked: 100 * intersection >= PERCENT * union.
PERCENT = 80
SMALL = 24
#: Classes, and characters of their texts, of a block.
BLOCK, BLOCK_CHARS = 1500, 20_000_000
#: Signatures keep so many bits; a chance agreement only costs a verification.
BITS = 48


def _bands() -> list[int]:
    """The largest size of each band; sets below 4 only link with equal ones."""
    out = [4]
    while out[-1] < 1 << 40:
        out.append(max(out[-1] + 1, out[-1] * 100 // PERCENT))
    return out


BANDS = _bands()


def differing(total: int) -> int:
    """The most tokens in which two linked sets, of so many tokens together, differ."""
    shared = -(-total * PERCENT // (100 + PERCENT))
    return max(0, total - 2 * shared)


def allocation(upper: int) -> tuple[int, int, bool]:
    """Segments, spare ones, and whether they are signed with their one-deletion neighbourhoods.

    The cost is the number of signatures, each the dearer the likelier its segment holds a token or none, since those
    are shared by chance.
    """
    h = max(differing(2 * upper), differing(2 * upper - 1))
    spare = 3 + h // 8
    exact = h + 1 + spare
    near = h // 2 + 1
    poor = lambda mean: 12 * math.exp(-mean) * (1 + mean)
    if exact * (1 + poor(upper / exact)) <= (upper + near) * (1 + poor(upper / near)):
        return exact, spare, False
    return near, 0, True


PLANS = {k: allocation(u) for k, u in enumerate(BANDS[:64])}


class Shingler:
    def __init__(self):
        self.hashes = WordHasher()

    def __call__(self, text: str | None) -> np.ndarray:
        """The sorted hashes of a text's shingles."""
        h = self.hashes(text.encode("utf-8", "replace")) if text else ()
        if len(h) < SHINGLE:
            return mix(rolling(h, len(h)) + np.uint64(len(h)))[:1] if len(h) else np.zeros(0, dtype=np.uint64)
        return distinct(rolling(h, SHINGLE))


def class_of(tokens: np.ndarray) -> int:
    """An id of the set; equal sets have equal ids."""
    a, b = int(mix(tokens).sum(dtype=np.uint64)), int(np.bitwise_xor.reduce(mix(tokens + np.uint64(1))))
    return xxhash.xxh3_64_intdigest(f"{len(tokens)},{a},{b}") - (1 << 63)


def signatures(tokens: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """Band, how many common segments the set can spare there, and its signatures."""
    n = len(tokens)
    if n < BANDS[0]:
        return
    own = bisect.bisect_left(BANDS, n)
    weight = mix(tokens ^ np.uint64(0x5851F42D4C957F2D))
    for band in (own, own + 1):
        count, spare, deletions = PLANS[band]
        segment = ((tokens >> np.uint64(32)) * np.uint64(count)) >> np.uint64(32)  # in order, as tokens are sorted
        starts = np.searchsorted(segment, np.arange(count + 1, dtype=np.uint64))
        sums = np.concatenate([[np.uint64(0)], np.cumsum(weight, dtype=np.uint64)])
        content = sums[starts[1:]] - sums[starts[:-1]]
        salt = np.arange(count, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(band * 0x632BE59BD9B4E019 % (1 << 64))
        if deletions:
            at = segment.astype(np.int64)
            yield band, 0, distinct(np.concatenate([mix(content + salt), mix(content[at] - weight + salt[at])]) >> np.uint64(64 - BITS))
            continue
        empty = starts[1:] == starts[:-1]
        if (gone := int(empty.sum())) <= spare:
            content, salt, spare = content[~empty], salt[~empty], spare - gone
        yield band, spare, mix(content + salt) >> np.uint64(64 - BITS)


def sizes(docs: DataFrame, key: str, text: str) -> DataFrame:
    """doc, v, n, class: the size and class of each document's set (no class where it is empty); v: a hash of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler()
        for batch in batches:
            sets = map(shingle, batch.column(2).to_pylist())
            pairs = [(len(s), class_of(s) if len(s) else None) for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], ["doc", "v", "n", "class"])

    return docs.select(F.col(key).cast("long").alias("doc"), F.xxhash64(text).alias("v"), F.col(text)).mapInArrow(run, "doc long, v long, n long, class long")


def components(edges: DataFrame) -> DataFrame:
    """node, root of the nodes of ``edges`` (a, b)."""
    return connected(edges).withColumnRenamed("component", "root")


def signed(docs: DataFrame, text: str) -> DataFrame:
    """sig, class, tag (band and spare segments): the signatures of each class, mostly once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, done = Shingler(), set()
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a, b in slices(texts, 2_000_000):
                sigs, classes, tags = [], [], []
                for t in texts[a:b]:
                    tokens = shingle(t)
                    if len(tokens) < BANDS[0] or (c := class_of(tokens)) in done:
                        continue
                    if len(done) > 100_000:  # forgetting only repeats signatures
                        done.clear()
                    done.add(c)
                    for band, spare, sig in signatures(tokens):
                        sigs.append(sig.astype(np.int64))
                        classes.append(np.full(len(sig), c, dtype=np.int64))
                        tags.append(np.full(len(sig), band << 16 | spare, dtype=np.int32))
                if sigs:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (sigs, classes, tags)], ["sig", "class", "tag"])

    return docs.where(F.col(text).isNotNull()).select(text).mapInArrow(run, "sig long, class long, tag int")


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= PERCENT * (len(a) + len(b) - both)


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) of classes that are linked."""
    left = pairs.join(texts.select(F.col("class").alias("a"), F.col("text").alias("x")), "a")
    both = left.join(texts.select(F.col("class").alias("b"), F.col("text").alias("y")), "b").select("a", "b", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler()
        recent: dict[int, np.ndarray] = {}

        def of(key: int, text: pa.StringScalar) -> np.ndarray:
            if key not in recent:
                if len(recent) >= 64:
                    recent.clear()
                recent[key] = shingle(text.as_py())
            return recent[key]

        for batch in batches:
            a, b, x, y = batch.columns
            keep = [linked(of(p, s), of(q, t)) for p, q, s, t in zip(a.to_pylist(), b.to_pylist(), x, y, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, "a long, b long")


def _compare(pdf: pd.DataFrame) -> pd.DataFrame:
    """Links of a block's minor classes with all its classes, by counting shared tokens in matrices."""
    shingle = Shingler()
    pdf = pdf.drop_duplicates(["class", "minor"])
    rows, cols = pdf[pdf["minor"]], pdf[~pdf["minor"]]
    left, right = [shingle(t) for t in rows["text"]], [shingle(t) for t in cols["text"]]
    if not left or not right:
        return pd.DataFrame({"a": pd.Series(dtype="int64"), "b": pd.Series(dtype="int64")})
    shared = np.intersect1d(np.unique(np.concatenate(left)), np.unique(np.concatenate(right)), assume_unique=True)
    counts = np.zeros((len(left), len(right)), dtype=np.float32)
    for a in range(0, len(shared), 4096):
        part = shared[a : a + 4096]
        x, y = np.zeros((len(left), len(part)), np.float32), np.zeros((len(right), len(part)), np.float32)
        for m, sets in ((x, left), (y, right)):
            for i, s in enumerate(sets):
                at = np.searchsorted(part, s)
                at[at == len(part)] = 0
                m[i, at[part[at] == s]] = 1
        counts += x @ y.T
    n, m = np.array([len(s) for s in left])[:, None], np.array([len(s) for s in right])[None, :]
    i, j = np.nonzero(100 * counts >= PERCENT * (n + m - counts))
    a, b = rows["class"].to_numpy()[i], cols["class"].to_numpy()[j]
    return pd.DataFrame({"a": a[a != b], "b": b[a != b]})


def jaccard_components(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_shingles, component_id of every row of ``docs``."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "ngrams")
    members = scratch.table(sizes(docs, key, text))
    by_sig = signed(docs, text).repartition("sig")
    # The tag is asked for as well, so that both sides of the join are one exchange.
    shared = by_sig.groupBy("sig").agg(F.min("class").alias("low"), F.max("class").alias("high"), F.max("tag").alias("tag")).where("low < high AND tag >= 0").select("sig")
    kept = scratch.table(by_sig.join(shared.hint("shuffle_hash"), "sig").distinct())
    group = kept.groupBy("sig").agg(F.count("*").alias("g"))
    # Large groups: each class with a hub, the one that has most of the common signatures.
    many = scratch.table(kept.join(group.where(F.col("g") > SMALL), "sig").drop("g"))
    # Linked sets agree in spare + 1 segments; without those that are empty or common, so many are in small groups.
    common = many.groupBy("class", "tag").agg(F.count("*").alias("common"))
    need = F.greatest(F.lit(1), F.col("tag") % 65536 + 1 - F.coalesce("common", F.lit(0)))
    few = kept.join(group.where(F.col("g") <= SMALL), "sig").join(common, ["class", "tag"], "left").select("sig", "class", need.alias("need"), F.shiftright("tag", 16).alias("band"))
    both = few.select("sig", "band", F.col("class").alias("a"), F.col("need").alias("need_a")).join(few.select("sig", F.col("class").alias("b"), F.col("need").alias("need_b")), "sig").where("a < b")
    pairs = both.groupBy("a", "b", "band", "need_a", "need_b").agg(F.count("*").alias("agree")).where("agree >= need_a AND agree >= need_b").select("a", "b")
    weight = many.groupBy("class").agg(F.count("*").alias("w"))
    hub = many.join(weight, "class").groupBy("sig").agg(F.max(F.struct("w", "class"))["class"].alias("hub"))
    spokes = many.join(hub, "sig").where("class != hub").select(F.least("class", "hub").alias("a"), F.greatest("class", "hub").alias("b")).groupBy("a", "b").agg(F.count("*").alias("agree")).where("agree > 1").select("a", "b")
    pairs = scratch.table(pairs.unionByName(spokes).distinct())

    named = members.where("class IS NOT NULL AND doc IS NOT NULL")
    reps = named.groupBy("class").agg(F.min(F.struct("doc", "v")).alias("rep"))
    # The classes of an id that stands with several texts are tied to each other.
    ties = named.groupBy("doc").agg(F.min("class").alias("a"), F.max("class").alias("b")).where("a < b")
    ties = scratch.table(named.join(ties.select("doc", F.col("a").alias("b")), "doc").where("class != b").select(F.col("class").alias("a"), "b").distinct())
    # Linked pairs that no small group holds: both have more common segments than they can spare.
    over = common.where("common > tag % 65536").select("class", "tag")
    needed = pairs.select(F.col("a").alias("class")).unionByName(pairs.select(F.col("b").alias("class"))).unionByName(over.select("class")).distinct()
    # What is wanted grows with the documents, so it isn't broadcast: texts are shuffled once, at every size.
    wanted = reps.join(needed, "class").select("rep.doc", "rep.v", "class")
    texts = docs.select(F.col(key).cast("long").alias("doc"), F.xxhash64(text).alias("v"), F.col(text).alias("text")).join(wanted.hint("merge"), ["doc", "v"]).groupBy("class").agg(F.first("text").alias("text"))
    texts = scratch.table(texts)
    links = scratch.table(verified(pairs, texts).unionByName(ties))
    scratch.drop(kept)

    roots = components(links)
    over = many.join(over, ["class", "tag"], "left_semi").join(roots.withColumnRenamed("node", "class"), "class", "left").select("sig", "class", F.coalesce("root", "class").alias("root"))
    open_sigs = over.groupBy("sig").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.min("class").alias("least")).where("low < high").select("sig", "least")
    unresolved = scratch.table(over.join(open_sigs, "sig").select("class", "root", "least").distinct())
    if not unresolved.isEmpty():
        cluster = components(unresolved.select(F.col("class").alias("a"), F.col("least").alias("b"))).select(F.col("node").alias("class"), F.col("root").alias("cluster"))
        held = scratch.table(unresolved.select("class", "root").distinct().join(cluster, "class"))
        per_root = held.groupBy("cluster", "root").agg(F.count("*").alias("size"))
        size = held.join(texts.select("class", F.length("text").cast("long").alias("chars")), "class").groupBy("cluster").agg(F.sum("chars").alias("chars"))
        main = per_root.groupBy("cluster").agg(F.max(F.struct("size", "root")).alias("m"), F.sum("size").alias("total")).select("cluster", F.col("m.root").alias("main"), F.col("m.size").alias("most"), "total")
        # As many blocks as keep both the classes and, by the cluster's mean, the characters of a block near their bounds.
        blocks = lambda n: F.greatest(F.lit(1), F.ceil(n / BLOCK), F.ceil(F.col("chars") * n / F.col("total") / BLOCK_CHARS)).cast("int")
        placed = held.join(main, "cluster").join(size, "cluster").join(texts, "class").select("cluster", "class", "text", (F.col("root") != F.col("main")).alias("out"), blocks(F.col("total") - F.col("most")).alias("rows"), blocks(F.col("total")).alias("cols"), F.pmod(F.xxhash64("class"), F.lit(1 << 30)).alias("h"))
        row = placed.where("out").select("cluster", "class", "text", F.lit(True).alias("minor"), (F.col("h") % F.col("rows")).alias("i"), F.explode(F.sequence(F.lit(0), F.col("cols") - 1)).alias("j"))
        col = placed.select("cluster", "class", "text", F.lit(False).alias("minor"), F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("i"), (F.col("h") % F.col("cols")).alias("j"))
        each = row.select("cluster", "class", "text", "minor", F.col("i").cast("int"), F.col("j").cast("int")).unionByName(col.select("cluster", "class", "text", "minor", F.col("i").cast("int"), F.col("j").cast("int")))
        more = each.groupBy("cluster", "i", "j").applyInPandas(_compare, "a long, b long")
        more = scratch.table(more.join(roots.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a", "left").join(roots.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b", "left").where("coalesce(ra, a) != coalesce(rb, b)").select("a", "b").distinct())
        roots = components(links.unionByName(more))

    joined = members.join(roots.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    joined = scratch.table(joined.select("doc", "n", "root"))
    least = joined.where("root IS NOT NULL").groupBy("root").agg(F.min("doc").alias("least"))
    return joined.join(least, "root", "left").select(F.col("doc").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("doc").isNotNull(), F.coalesce("least", "doc")).alias("component_id"))
