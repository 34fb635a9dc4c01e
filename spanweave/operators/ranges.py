"""Aligned ranges: intervals as few power-of-four ranges, so that points and intervals meet by equality.

A range ``[start, end)`` of integers is cut into aligned ranges of 4^k, at most six per level. A point lies in one aligned range
per level, and in exactly one of those that make up an interval holding it. A join on (level, number) therefore brings together
just the points and the intervals that hold them. The integers are places among the distinct points (``placed``), so that an
interval makes no more ranges than it holds points.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanweave.operators.scan import BLOCK_MS, Running, block_of, running

#: Bits by which a level is wider than the one below.
STEP = 2


def with_ranges(df: DataFrame, start: Column, end: Column) -> DataFrame:
    """A row per aligned range that makes up ``[start, end)``, with ``__level`` and ``__node``; none where there is nothing inside."""
    shift, level, none = lambda x, k: F.call_function("shiftright", x, k), F.col("__level"), F.array().cast("array<bigint>")
    # No aligned range inside is longer than the whole.
    top = F.floor(F.log2(F.greatest(F.col("__to") - F.col("__from"), F.lit(1)).cast("double"))).cast("int")
    rows = df.withColumns({"__from": start.cast("bigint"), "__to": end.cast("bigint")}).where("__from < __to").withColumn("__level", F.explode(F.sequence(F.lit(0), top, F.lit(STEP))))
    # Numbers at this level are [low, high), of which the level above takes what fills ranges of its own.
    rows = rows.withColumns({"__low": -shift(-F.col("__from"), level), "__high": shift(F.col("__to"), level)}).where("__low < __high")
    rows = rows.withColumns({"__left": shift(-F.col("__low"), F.lit(STEP)) * -(1 << STEP), "__right": shift(F.col("__high"), F.lit(STEP)) * (1 << STEP)})

    def numbers(first: str, behind: str) -> Column:
        return F.when(F.col(first) < F.col(behind), F.sequence(F.col(first), F.greatest(F.col(first), F.col(behind) - 1))).otherwise(none)

    own = F.when(F.col("__left") < F.col("__right"), F.concat(numbers("__low", "__left"), numbers("__right", "__high"))).otherwise(numbers("__low", "__high"))
    return rows.withColumn("__node", F.explode(own)).drop("__from", "__to", "__low", "__high", "__left", "__right")


def at_levels(points: DataFrame, at: Column, ranged: DataFrame) -> DataFrame:
    """A row per point and level that ``ranged`` has, with ``__level`` and ``__node``. Levels are one row of at most 32 numbers."""
    levels = ranged.agg(F.collect_set("__level").alias("__levels"))
    return points.crossJoin(F.broadcast(levels)).withColumn("__level", F.explode("__levels")).withColumn(
        "__node", F.call_function("shiftright", at.cast("bigint"), F.col("__level"))).drop("__levels")


def placed(points: DataFrame, edges: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """For each distinct ``(keys, t)`` of points and edges, how many distinct points of the key lie before it (``__place``)."""
    sides = points.select(*keys, "t", F.lit(1).cast("bigint").alias("__point"))
    for edge in edges:
        sides = sides.unionByName(edge.select(*keys, "t", F.lit(0).cast("bigint").alias("__point")))
    once = sides.where("t is not null").groupBy(*keys, "t").agg(F.max("__point").alias("__point"))
    return running(once, keys, ["t"], [("t", block_of("t", BLOCK_MS))], __place=Running("sum", F.col("__point"))).drop("__point")


def placed_ranges(ranges: DataFrame, points: DataFrame, keys: Sequence[str], start: Column, end: Column, at: Column) -> tuple[DataFrame, DataFrame]:
    """``ranges`` with the aligned ranges of places that ``[start, end)`` holds, and ``points`` with theirs at those levels."""
    keys = list(keys)
    ranges, points = ranges.withColumns({"__start": start.cast("bigint"), "__end": end.cast("bigint")}).where("__start < __end"), points.withColumn("__at", at.cast("bigint"))
    place = placed(points.select(*keys, F.col("__at").alias("t")), [ranges.select(*keys, F.col(c).alias("t")) for c in ("__start", "__end")], keys)

    def lookup(df: DataFrame, column: str, name: str) -> DataFrame:
        return df.join(place.withColumnsRenamed({"t": column, "__place": name}), [*keys, column])

    edged = lookup(lookup(ranges, "__start", "__first"), "__end", "__behind")
    held = with_ranges(edged, F.col("__first"), F.col("__behind")).drop("__first", "__behind", "__start", "__end")
    asked = at_levels(lookup(points, "__at", "__place"), F.col("__place"), held).drop("__place", "__at")
    # The planner's estimate knows nothing of the rows that ranges unfold to, and must not send them to every task.
    return held.hint("merge"), asked


def held_pairs(ranges: DataFrame, points: DataFrame, keys: Sequence[str], start: Column, end: Column, at: Column) -> DataFrame:
    """Every range ``[start, end)`` with every point of its key that it holds, and no other pairs."""
    held, asked = placed_ranges(ranges, points, keys, start, end, at)
    return held.join(asked, [*keys, "__level", "__node"]).drop("__level", "__node")


def best_holder(ranges: DataFrame, points: DataFrame, keys: Sequence[str], start: Column, end: Column, at: str, best: Column) -> DataFrame:
    """For each distinct point ``(keys, at)`` the least ``best`` of the ranges ``[start, end)`` that hold it.

    Each aligned range keeps its best, so the work does not depend on how many ranges overlap. Points that nothing holds are left out.
    """
    keys = list(keys)
    sides = ranges.select(*keys, start.alias("__from"), end.alias("__to"), best.alias("__best"))
    held, asked = placed_ranges(sides, points.select(*keys, at).distinct(), keys, F.col("__from"), F.col("__to"), F.col(at))
    kept = held.groupBy(*keys, "__level", "__node").agg(F.min("__best").alias("__best")).hint("merge")
    return asked.join(kept, [*keys, "__level", "__node"]).groupBy(*keys, at).agg(F.min("__best").alias("best"))
