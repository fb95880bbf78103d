"""Joins that aren't plain equalities: as-of, bands, disjunctions, one-to-one pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of an axis without a key, as many as a report's buckets.
MOST_INTERVALS = 100_000


def asof(points: DataFrame, axis: DataFrame, at: str, start: str, end: str, key: list[str] = ()) -> DataFrame:
    """Each point with the latest axis row whose [start, end) holds it, or nulls; intervals may overlap and lie in each other.

    With a key both sides are united and sorted by it and by time, and the open intervals are carried along as a stack: what has ended on
    top of it never holds a later point, nor does what ends no later than one that starts later, so a row is looked at once, and no more is held than what lies in each other. Without a
    key the axis has to be small: it is then sent to all tasks after its size was checked, as the stretches in which one interval holds, which are searched in halves. Times are whole numbers then.
    """
    if not key:
        rows = [tuple(r) for r in axis.select(start, end).where(F.col(start) < F.col(end)).limit(MOST_INTERVALS + 1).collect()]
        if len(rows) > MOST_INTERVALS:
            raise ValueError(f"an axis has {MOST_INTERVALS} rows at most")
        begins, owners = _segments(sorted(rows))
        sent = points.sparkSession.sparkContext.broadcast((np.array(begins, dtype=np.int64), pa.array([o and o[0] for o in owners], pa.int64()), pa.array([o and o[1] for o in owners], pa.int64())))
        names, where = [*points.columns, start, end], points.columns.index(at)
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points.schema.fields)

        def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            edges, a, b = sent.value
            for batch in batches:
                t = batch.column(where).cast(pa.int64())
                place = pa.array(np.searchsorted(edges, t.fill_null(0).to_numpy(zero_copy_only=False), "right"), mask=np.asarray(t.is_null()))
                yield pa.RecordBatch.from_arrays([*batch.columns, a.take(place), b.take(place)], names)

        return points.mapInArrow(look, f"{fields}, `{start}` long, `{end}` long")
    left = points.select(*key, F.col(at).alias("__at"), F.lit(1).alias("__kind"), F.lit(None).cast(axis.schema[start].dataType).alias("__start"), F.lit(None).cast(axis.schema[end].dataType).alias("__end"), F.struct(*points.columns).alias("__point"))
    right = axis.where(F.col(start) < F.col(end)).select(*key, F.col(start).alias("__at"), F.lit(0).alias("__kind"), F.col(start).alias("__start"), F.col(end).alias("__end"), F.lit(None).cast(left.schema["__point"].dataType).alias("__point"))
    both = left.unionByName(right).repartition(*key).sortWithinPartitions(*key, "__at", "__kind", "__end")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in [*points.schema.fields, axis.schema[start], axis.schema[end]])
    n = len(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, stack = None, []
        for batch in batches:
            places, found = [], []
            columns = [c.to_pylist() for c in batch.columns[: n + 4]]
            for i, (group, t, kind, a, b) in enumerate(zip(zip(*columns[:n], strict=True), *columns[n:], strict=True)):
                if group != now:
                    now, stack = group, []
                if kind == 0:
                    while stack and stack[-1][1] <= b:  # the later start wins while it holds, and outlasts it
                        stack.pop()
                    stack.append((a, b))
                    continue
                while stack and t is not None and stack[-1][1] <= t:
                    stack.pop()
                places.append(i)
                found.append(stack[-1] if stack and t is not None else (None, None))
            point = batch.column(n + 4).take(pa.array(places, pa.int64()))
            ends = [pa.array([x[k] for x in found], batch.column(n + 2 + k).type) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*point.flatten(), *ends], [*points_names, start, end])

    points_names = points.columns
    return both.mapInArrow(run, fields)


def _segments(rows: list[tuple]) -> tuple[list, list]:
    """The edges of these sorted intervals, and for what lies before the first and after each edge the latest interval that holds there, or None."""
    edges, owners, stack, i = sorted({t for row in rows for t in row}), [None], [], 0
    for t in edges:
        while i < len(rows) and rows[i][0] == t:
            stack.append(rows[i])
            i += 1
        while stack and stack[-1][1] <= t:
            stack.pop()
        owners.append(stack[-1] if stack else None)
    return edges, owners


def diagnostics_of(observations: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """observation_id, code: by observation, by line, or for the whole source.

    The disjunction is three equality joins, so no pair of rows is only compared.
    """
    o = observations.select("observation_id", "source_id", "line")
    by_observation = o.join(diagnostics.where("d_observation_id IS NOT NULL").select("source_id", F.col("d_observation_id").alias("observation_id"), "code"), ["source_id", "observation_id"])
    rest = diagnostics.where("d_observation_id IS NULL")
    by_line = o.join(rest.where("d_line IS NOT NULL").select("source_id", F.col("d_line").alias("line"), "code"), ["source_id", "line"])
    whole = o.join(rest.where("d_line IS NULL").select("source_id", "code"), "source_id")
    return by_observation.select("observation_id", "code").unionByName(by_line.select("observation_id", "code")).unionByName(whole.select("observation_id", "code")).distinct()


def band_matches(left: DataFrame, right: DataFrame, key: list[str], line: str, width: int) -> DataFrame:
    """Pairs of rows of a key whose lines are within ``width``, both having no other partner.

    Lines are dealt into cells as wide as the band; each left row looks into its own and the neighbouring cells.
    """
    cell = lambda c: F.floor(c / width).cast("long")
    a = left.select(*key, F.col(line).alias("a_line")).withColumn("cell", F.explode(F.array(*(cell(F.col("a_line")) + d for d in (-1, 0, 1)))))
    b = right.select(*key, F.col(line).alias("b_line")).withColumn("cell", cell(F.col("b_line")))
    near = a.join(b, [*key, "cell"]).where(F.abs(F.col("a_line") - F.col("b_line")) <= width)
    n = lambda c: F.count("*").over(Window.partitionBy(*key, c))
    return near.withColumn("__a", n("a_line")).withColumn("__b", n("b_line")).where("__a = 1 AND __b = 1").select(*key, "a_line", "b_line")


def pair_calls(calls: DataFrame, results: DataFrame, keys: list[str]) -> DataFrame:
    """Each key's status: paired, unanswered, orphan, or conflict where a side has several."""
    c = calls.groupBy(*keys).agg(F.count("*").alias("calls"))
    r = results.groupBy(*keys).agg(F.count("*").alias("results"))
    both = c.join(r, keys, "full_outer").na.fill(0, ["calls", "results"])
    status = F.when((F.col("calls") > 1) | (F.col("results") > 1), "conflict").when(F.col("results") == 0, "unanswered").when(F.col("calls") == 0, "orphan").otherwise("paired")
    return both.select(*keys, F.col("calls").cast("long"), F.col("results").cast("long"), status.alias("status"))


def unique_only(rows: DataFrame, key: Column, value: Column) -> DataFrame:
    """key, value of the keys that have exactly one value: what can be looked up without ambiguity."""
    return rows.select(key.alias("key"), value.alias("value")).where("key IS NOT NULL").groupBy("key").agg(F.countDistinct("value").alias("n"), F.min("value").alias("value")).where("n = 1").select("key", "value")
