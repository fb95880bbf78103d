"""Embedding near-dedup.

Spherical k-means, fitted on a bounded hash sample, gives cells. Equal vectors are one class, compared once. Each class goes
to the cell of its closest centre. Linked x in cell a and y in cell b are at most sqrt(2 - 2 t) apart, and y is not closer to centre a than
to b, so x . (a - b) <= (x - y) . (a - b) <= sqrt(2 - 2 t) |a - b|, and likewise for y: of two cells only the vectors with such a margin, on both
sides, are compared with each other, and no link is missed (with less than sqrt(dim) as ``spreads`` the reach is that many
spreads of a direction, and links that favour one are lost). Which cells a class is compared with is listed by id; its
vector is copied once for each, when the pairs of cells are dealt out. Each side of a pair is dealt into blocks of about BLOCK vectors; each task compares two of them by one matrix product in double precision:
a cell that holds a third of all vectors is many tasks, and a task holds two blocks. Of a pair of blocks only counts and a root per vector come back, never the pairs; components of the
roots give the groups.

Defined cases: null or zero vectors, and those with null or non-finite components, link with nothing; vectors of
different lengths don't link; rows that repeat an id are one vector and one row of the result, and where its values differ it has the links of all of them
(n_links adds them up, those among its own values included); rows without an id link with nothing, get no component and come back each; ties of centres go to
the first; other columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from ..operators.graph import connected
from .common import Scratch

THRESHOLD, SPREADS = 0.95, float("inf")
BLOCK = 2000
#: Vectors of a batch that are placed at a time, so that their products with all centres stay near 16 MB.
PLACED = 1000
#: The sample that centres are fitted on, vectors for each centre, and most centres.
FIT_ROWS, PER_CELL, MOST_CELLS, ROUNDS, SEED = 20_000, 2_000, 2_048, 8, 3


def unit(x: np.ndarray) -> np.ndarray:
    """Vectors (the last axis) of length one; scaled first, so that squares neither overflow nor vanish."""
    x = x / np.abs(x).max(-1, keepdims=True)
    return x / np.sqrt((x * x).sum(-1, keepdims=True))


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centres of length one; an empty cell keeps its centre."""
    rng = np.random.default_rng(SEED)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        cell = (x @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, cell, x)
        norm = np.sqrt((sums * sums).sum(1, keepdims=True))
        centres = np.where(norm > 1e-12, sums / np.maximum(norm, 1e-12), centres)
    return centres


def margin(dim: int, threshold: float, spreads: float) -> float:
    """How far past the middle between two centres linked vectors are looked for."""
    return float(np.sqrt(2 - 2 * threshold) * min(1.0, spreads / np.sqrt(dim))) + 1e-9


def visited(x: np.ndarray, centres: np.ndarray, apart: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The home cell of each vector, then (row, cell) of the visits to others."""
    near = x @ centres.T
    home = near.argmax(1)
    near = near[np.arange(len(x)), home][:, None] - near <= reach * apart[home] + 1e-9
    near[np.arange(len(x)), home] = False
    return home, *np.nonzero(near)


def _placed(vectors: DataFrame, centres: dict[int, np.ndarray], threshold: float, spreads: float) -> DataFrame:
    """id, dim, a, b, side: each class in its home cell (a = b) and in each pair of it with another where it may have links; side: 1 if its home is b."""
    sent = vectors.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apart = {}
        for batch in batches:
            dims = np.asarray(batch.column("v").value_lengths())
            for dim in np.unique(dims).tolist():
                c = sent.value.get(dim, np.zeros((1, dim)))
                if dim not in apart:
                    apart[dim] = np.sqrt(np.maximum(0, 2 - 2 * c @ c.T))
                at = np.flatnonzero(dims == dim)
                for a in range(0, len(at), PLACED):
                    part = batch.take(pa.array(at[a : a + PLACED]))
                    x = unit(part.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim))
                    home, row, cell = visited(x, c, apart[dim], margin(dim, threshold, spreads))
                    row, cell = np.concatenate([np.arange(len(x)), row]), np.concatenate([home, cell])
                    low, high = np.minimum(home[row], cell).astype(np.int32), np.maximum(home[row], cell).astype(np.int32)
                    side = (home[row] > cell).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([part.column("id").take(pa.array(row)), *map(pa.array, (np.full(len(row), dim, np.int32), low, high, side))], ["id", "dim", "a", "b", "side"])

    return vectors.select("id", "v").mapInArrow(run, "id long, dim int, a int, b int, side int")


def _roots(near: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For a table of links of rows with columns, the smallest id (left: the rows', right: the columns') each is joined with."""
    none = max(left.max(), right.max()) + 1
    while True:
        a = np.minimum(left, np.where(near, right[None, :], none).min(1))
        b = np.minimum(right, np.where(near, a[:, None], none).min(0))
        if (a == left).all() and (b == right).all():
            return a, b
        left, right = a, b


def _compare(threshold: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", kind="stable")
        i, j = pdf["i"].iloc[0], pdf["j"].iloc[0]
        rows = pdf[pdf["block"] == i]
        cols = rows if i == j else pdf[pdf["block"] == j]
        if rows.empty or cols.empty:
            return pd.DataFrame({"id": [], "n": [], "root": []}).astype("int64")
        sides = [unit(np.stack(p["v"].to_numpy()).astype(np.float64)) for p in (rows, cols)]
        near = sides[0] @ sides[1].T >= threshold
        ids = [p["id"].to_numpy() for p in (rows, cols)]
        if i == j:
            near[np.diag_indices(len(near))] = False
        a, b = near.any(1), near.any(0)
        near = near[a][:, b]
        if not near.size:
            return pd.DataFrame({"id": [], "n": [], "root": []}).astype("int64")
        ids, weights = [ids[0][a], ids[1][b]], [rows["w"].to_numpy()[a], cols["w"].to_numpy()[b]]
        n = [near @ weights[1], weights[0] @ near]
        names = np.unique(np.concatenate(ids))
        root = _roots(near, *(names.searchsorted(x).astype(np.int32) for x in ids))
        out = pd.DataFrame({"id": ids[0], "n": n[0], "root": names[root[0]]})
        return out if i == j else pd.concat([out, pd.DataFrame({"id": ids[1], "n": n[1], "root": names[root[1]]})])

    return run


def near_duplicates(table: DataFrame, *, key: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD, spreads: float = SPREADS) -> DataFrame:
    """key, n_links, component_id, kept of every row of ``table``."""
    spark = table.sparkSession
    scratch = Scratch(spark, "vectors")
    kind = "array<float>" if isinstance(table.schema[vector].dataType.elementType, FloatType) else "array<double>"
    rows = table.select(F.col(key).cast("long").alias("id"), F.col(vector).cast(kind).alias("v"))
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = rows.where(F.col("id").isNotNull() & F.col("v").isNotNull()).where((F.size("v") > 0) & ~odd & F.exists("v", lambda x: x != 0))
    least = scratch.table(good.groupBy("id").agg(F.min("v").alias("v"), (F.min("v") < F.max("v")).alias("several")))
    good = least.select("id", "v")
    several = not least.where("several").isEmpty()
    if several:  # further values of an id get names of their own, above all ids that are likely, and are tied to it
        more = rows.join(least.where("several").select("id", F.col("v").alias("least")), "id").where((F.size("v") > 0) & ~odd & F.exists("v", lambda x: x != 0) & (F.col("v") != F.col("least"))).select("id", "v").distinct()
        more = scratch.table(more.select(F.col("id").alias("owner"), F.xxhash64("id", "v").bitwiseAND((1 << 62) - 1).bitwiseOR(1 << 62).alias("id"), "v"))
        good = good.unionByName(more.select("id", "v"))
    # Equal vectors are one class, named by its smallest id; each class is compared once, with its weight.
    classes = scratch.table(good.groupBy("v").agg(F.min("id").alias("id"), F.count("*").alias("w")).select("id", "w", "v"))
    total = classes.count()
    sample = classes.select(F.xxhash64("id", F.lit(SEED)).alias("h"), "id", "v").orderBy("h", "id").limit(FIT_ROWS).collect()
    by_dim: dict[int, list] = {}
    for r in sample:
        by_dim.setdefault(len(r.v), []).append(r.v)
    share = total / max(1, len(sample))
    centres = {d: spherical_kmeans(unit(np.array(x, dtype=np.float64)), int(min(MOST_CELLS, max(1, len(x) * share / PER_CELL)))) for d, x in by_dim.items()}

    placed = scratch.table(_placed(classes, centres, threshold, spreads))
    many = lambda side: F.ceil(F.count_if(F.col("side") == side) / BLOCK).cast("int")
    count = placed.groupBy("dim", "a", "b").agg(many(0).alias("left"), many(1).alias("right")).where("left > 0 AND (a = b OR right > 0)")
    dealt = placed.join(count, ["dim", "a", "b"]).withColumn("block", F.when(F.col("side") == 1, F.col("left") + F.pmod(F.xxhash64("id"), F.greatest("right", F.lit(1)))).otherwise(F.pmod(F.xxhash64("id"), F.col("left"))).cast("int"))
    within = (F.col("a") == F.col("b")) | (F.col("side") == 1)
    others = F.when(within, F.sequence(F.lit(0), F.col("left") - 1)).otherwise(F.sequence(F.col("left"), F.col("left") + F.col("right") - 1))
    pairs = dealt.join(classes, "id").withColumn("other", F.explode(others)).withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    found = scratch.table(pairs.select("dim", "a", "b", "i", "j", "id", "w", "v", "block").groupBy("dim", "a", "b", "i", "j").applyInPandas(_compare(threshold), "id long, n long, root long"))
    links = found.groupBy("id").agg(F.sum("n").alias("n"))
    shared = classes.where("w > 1").select("v", F.col("id").alias("class"), "w")
    member = good.join(shared, "v").where("id != class").select("id", "class", "w").unionByName(shared.select(F.col("class").alias("id"), "class", "w"))
    edges = found.select(F.col("id").alias("a"), F.col("root").alias("b"))
    if several:
        of = lambda name: member.select(F.col("id").alias(name), F.col("class").alias(f"{name}_class"))
        ties = more.select("id", "owner").join(of("id"), "id", "left").join(of("owner"), "owner", "left")
        edges = edges.unionByName(ties.select(F.coalesce("id_class", "id").alias("a"), F.coalesce("owner_class", "owner").alias("b")))
    groups = connected(edges).select(F.col("node").alias("id"), F.col("component").alias("root"))
    out = rows.select("id").where("id IS NOT NULL").distinct().unionByName(rows.select("id").where("id IS NULL"))
    if several:
        out = out.unionByName(more.select("id"))
    out = out.join(member, "id", "left").withColumn("class", F.coalesce("class", "id"))
    out = out.join(links.withColumnRenamed("id", "class"), "class", "left").join(groups.withColumnRenamed("id", "class"), "class", "left")
    component = F.coalesce("root", "class")
    n_links = F.coalesce("n", F.lit(0)) + F.coalesce(F.col("w") - 1, F.lit(0))
    if several:
        out = out.select("id", n_links.alias("n"), component.alias("component")).join(more.select("id", "owner"), "id", "left")
        named = out.where("id IS NOT NULL").groupBy(F.coalesce("owner", "id").alias("id")).agg(F.sum("n").alias("n"), F.min("component").alias("class"))
        out = named.unionByName(out.where("id IS NULL").select("id", "n", F.col("component").alias("class")))
        n_links, component = F.col("n"), F.col("class")
    return out.select(F.col("id").alias(key), n_links.cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))
