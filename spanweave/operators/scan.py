"""Running values and ranks over ordered keys that may hold a large share of all rows.

``Window.partitionBy(media)`` puts one media into one task. Here a key is cut into blocks along its
order: a summary per block (aggregated map-side, so a hot block costs no more than a cold one), a window
over the few summaries of a key for what each block inherits, and a window inside each block for the
rest. All of it is lazy, deterministic and built from joins and windows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Media-clock width of a block. Operators scan rows already reduced to one per (media, ms), so a block
#: holds at most this many rows whatever the skew.
BLOCK_MS = 3_600_000
#: Width of a block along a dense integer such as an id or a sequence number.
BLOCK_IDS = 65_536


@dataclass(frozen=True)
class Running:
    """One running value: ``sum``, ``max``, ``min`` or ``last`` (latest non-null) of ``value``."""

    kind: str
    value: Column
    inclusive: bool = False


def block_of(column: str | Column, width: int) -> Column:
    """Block number along a long column; floors negatives too."""
    value = F.col(column) if isinstance(column, str) else column
    return F.call_function("div", value - F.pmod(value, F.lit(width)), F.lit(width))


def _merge(kind: str, value: Column) -> Column:
    return {"sum": F.sum, "max": F.max, "min": F.min, "last": F.max}[kind](value)


def _combine(kind: str, carry: Column, local: Column) -> Column:
    if kind == "sum":
        return F.coalesce(carry, F.lit(0)) + F.coalesce(local, F.lit(0))
    if kind == "last":
        return F.coalesce(local, carry)
    pick = F.greatest if kind == "max" else F.least
    return pick(carry, local)  # both skip nulls


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column],
            blocks: Sequence[tuple[str, Column]], **values: Running) -> DataFrame:
    """Add running values per key in ascending ``order``.

    ``blocks`` names block columns from coarse to fine; each must follow the order, lexicographically.
    A value covers the rows before the current one, or up to it when ``inclusive``.
    """
    keys, order = list(keys), list(order)
    names = [f"__b{i}" for i in range(len(blocks))]
    rows = df.withColumns({n: c for n, (_, c) in zip(names, blocks)})

    def carried(name: str, run: Running) -> Column:
        if run.kind == "last":
            return F.max(F.when(run.value.isNotNull(), F.struct(*order, run.value.alias("v")))).alias(name)
        return _merge(run.kind, run.value).alias(name)

    summary = rows.groupBy(*keys, *names).agg(*[carried(f"__s_{n}", r) for n, r in values.items()])
    inherited = _inherit(summary, keys, names, values)
    joined = rows.join(inherited, [*keys, *names])

    spec = Window.partitionBy(*keys, *names).orderBy(*order)
    out = {}
    for name, run in values.items():
        frame = spec.rowsBetween(Window.unboundedPreceding, 0 if run.inclusive else -1)
        local = (F.last(run.value, ignorenulls=True) if run.kind == "last"
                 else _merge(run.kind, run.value)).over(frame)
        carry = F.col(f"__c_{name}")["v"] if run.kind == "last" else F.col(f"__c_{name}")
        out[name] = _combine(run.kind, carry, local)
    return joined.withColumns(out).drop(*names, *[f"__c_{n}" for n in values])


def _inherit(summary: DataFrame, keys: list[str], names: list[str],
             values: dict[str, Running]) -> DataFrame:
    """What each block takes over from the blocks before it, level by level."""
    spec = Window.partitionBy(*keys, *names[:-1]).orderBy(names[-1]).rowsBetween(Window.unboundedPreceding, -1)
    before = summary.withColumns({
        f"__c_{n}": _merge(r.kind, F.col(f"__s_{n}")).over(spec) for n, r in values.items()})
    before = before.drop(*[f"__s_{n}" for n in values])
    if len(names) == 1:
        return before
    coarser = summary.groupBy(*keys, *names[:-1]).agg(
        *[_merge(r.kind, F.col(f"__s_{n}")).alias(f"__s_{n}") for n, r in values.items()])
    outer = _inherit(coarser, keys, names[:-1], values).withColumnsRenamed(
        {f"__c_{n}": f"__o_{n}" for n in values})
    return before.join(outer, [*keys, *names[:-1]]).withColumns({
        f"__c_{n}": _combine(r.kind, F.col(f"__o_{n}"), F.col(f"__c_{n}")) for n, r in values.items()
    }).drop(*[f"__o_{n}" for n in values])


def time_blocks(column: str = "start_ms", width: int = BLOCK_MS) -> list[tuple[str, Column]]:
    return [(column, block_of(column, width))]


def id_blocks(column: str) -> list[tuple[str, Column]]:
    """Blocks along a dense id, with a coarser level on top so that no level grows long."""
    return [(column, block_of(column, BLOCK_IDS * 4096)), (column, block_of(column, BLOCK_IDS))]


def row_rank(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column],
             blocks: Sequence[tuple[str, Column]], name: str) -> DataFrame:
    """1-based position within the key."""
    return running(df, keys, order, blocks, **{name: Running("sum", F.lit(1).cast("bigint"), True)})


@dataclass(frozen=True)
class Along:
    """One key of a total order. Nulls come first in either direction unless ``nulls_last``."""

    value: Column
    descending: bool = False
    nulls_last: bool = False

    def sorting(self) -> Column:
        way = "desc" if self.descending else "asc"
        return getattr(self.value, f"{way}_nulls_{'last' if self.nulls_last else 'first'}")()


def _precedes(order: Sequence[Along], x: Column, y: Column) -> Column:
    """Whether struct ``x`` of the keys' values (``k0``, ``k1``, ...) comes before ``y``."""
    before = F.lit(False)
    for i, key in reversed(list(enumerate(order))):
        a, b = x[f"k{i}"], y[f"k{i}"]
        nulls = (a.isNotNull() & b.isNull()) if key.nulls_last else (a.isNull() & b.isNotNull())
        values = F.coalesce(a > b if key.descending else a < b, F.lit(False))
        before = nulls | values | (a.eqNullSafe(b) & before)
    return before


#: Of the keys every so many enter the sketch of a ranking, by hash; so many of those lie between two split points.
SKETCHED, BETWEEN = 64, 64


def global_rank(df: DataFrame, order: Sequence[Along], name: str) -> DataFrame:
    """1-based position over the whole table, for any total order; rows that tie in all keys get consecutive positions.

    Split points cut the order into ranges, twice as many as there are shuffle partitions: of the distinct keys that
    a hash picks, those with the smallest hashes, evenly spaced. They depend on the rows alone, not on how these are dealt, so any
    evaluation gives the same ranges and nothing has to be written or computed before an action. Counts per range
    give the offsets and a window ranks inside each. ``df`` must itself give the same rows whenever it is evaluated.
    """
    ranges = 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = F.struct(*[key.value.alias(f"k{i}") for i, key in enumerate(order)])
    inner = [Along(F.col(f"__key.k{i}"), key.descending, key.nulls_last) for i, key in enumerate(order)]
    keyed = df.withColumn("__key", keys)
    picked = keyed.select("__key", F.xxhash64("__key").alias("__h")).where(F.pmod("__h", F.lit(SKETCHED)) == 0).distinct()
    sketch = picked.orderBy("__h", *[key.sorting() for key in inner]).limit(ranges * BETWEEN)
    # The sketch is bounded by the number of ranges, and so are this window, the list and the broadcast of one row.
    placed = sketch.withColumn("__n", F.row_number().over(Window.orderBy(*[key.sorting() for key in inner])))
    points = placed.where(F.col("__n") % BETWEEN == 0).agg(F.transform(
        F.array_sort(F.collect_list(F.struct("__n", "__key"))), lambda p: p["__key"]).alias("__points"))
    wide = math.isqrt(ranges) + 1
    runs = F.transform(F.sequence(F.lit(0), F.floor(F.size("__points") / wide).cast("int")),
                       lambda i: F.slice(F.col("__points"), i * wide + 1, F.lit(wide)))
    runs = points.select(F.filter(runs, lambda r: F.size(r) > 0).alias("__runs"))

    def reached(points: Column, first) -> Column:
        return F.size(F.filter(points, lambda p: ~_precedes(order, F.col("__key"), first(p))))

    # Runs of points that have begun, and points of the last of those that are reached.
    placed = keyed.crossJoin(F.broadcast(runs)).withColumn("__run", reached(F.col("__runs"), lambda r: F.get(r, F.lit(0))))
    within = reached(F.get("__runs", F.col("__run") - 1), lambda p: p)
    ranged = placed.withColumn("__range", F.when(F.col("__run") == 0, 0).otherwise((F.col("__run") - 1) * wide + within)).drop("__runs", "__run")
    offsets = ranged.groupBy("__range").agg(F.count(F.lit(1)).alias("__rows")).select("__range", F.coalesce(F.sum("__rows").over(
        Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    local = F.row_number().over(Window.partitionBy("__range").orderBy(*[key.sorting() for key in inner])).cast("bigint")
    return (ranged.withColumn("__local", local).join(F.broadcast(offsets), "__range")
            .withColumn(name, F.col("__before") + F.col("__local")).drop("__range", "__before", "__local", "__key"))


def asof(probes: DataFrame, table: DataFrame, keys: Sequence[str], at: str, table_at: str,
         take: Sequence[str], inclusive: bool = True, width: int = BLOCK_MS) -> DataFrame:
    """For each distinct ``(keys, at)`` of the probes, ``take`` of the latest table row at or before it.

    The table holds one row per ``(keys, table_at)``. Result: the probe points with the looked-up
    columns, null where nothing precedes. Both sides meet in one ordered scan, so no pairs are formed.
    """
    keys = list(keys)
    points = probes.select(*keys, F.col(at).alias("__t")).distinct()
    sides = points.select(*keys, "__t", F.lit(1 if inclusive else 0).alias("__side"),
                          F.lit(True).alias("__probe"),
                          *[F.lit(None).cast(table.schema[c].dataType).alias(c) for c in take])
    facts = table.select(*keys, F.col(table_at).alias("__t"), F.lit(0 if inclusive else 1).alias("__side"),
                         F.lit(False).alias("__probe"), *take)
    merged = running(
        sides.unionByName(facts), keys, ["__t", "__side"], [("__t", block_of("__t", width))],
        __hit=Running("last", F.when(~F.col("__probe"), F.struct(*take))))
    return merged.where("__probe").select(
        *keys, F.col("__t").alias(at), *[F.col("__hit")[c].alias(c) for c in take])


def bins(df: DataFrame, start: Column, end: Column, width: int, name: str = "__bin") -> DataFrame:
    """One row per time bin that the closed range ``[start, end]`` touches."""
    return df.withColumn(name, F.explode(F.sequence(block_of(start, width), block_of(end, width))))


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)
