"""Near-duplicate vectors by iterative quantisation, multi-index Hamming tables and their original cosine.

Rotations are learned that give every bit of a vector's sign code about the same share of the variance. A code is cut into
parts, each part is a table, and two vectors meet where a part agrees: codes that differ in fewer bits than there are tables
always do. Where they meet, their original vectors decide.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, log, log2

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from spanweave.llm.common import column_of, importable
from spanweave.llm.components import connected_components
from spanweave.session import stage

#: Vectors and numbers that the rotations are learned from at most.
SAMPLE, SAMPLE_VALUES = 8192, 4 << 20
#: Vectors of a label that share a part of their code, on average; and of those that one task compares at most, twice.
BUCKET, BLOCK = 8, 2048
#: Share of pairs just at the threshold that must meet in some table, as measured on the sample.
RECALL = 0.995
ROUNDS = 30
_ROWS = 256


@dataclass
class Quantiser:
    """Parts of sign codes of vectors of one dimension. ``parts[t]``: rotation and bits of table t."""

    means: dict
    rotations: list[np.ndarray]
    parts: list[tuple[int, np.ndarray]]

    def codes(self, labels: list, unit: np.ndarray) -> np.ndarray:
        """Part of the code per vector and table; ``unit`` has vectors of length 1, which are taken from their label's middle."""
        middle = self.means[None]
        away = unit - np.array([self.means.get(x, middle) for x in labels]).reshape(unit.shape)
        bits = [away @ r > 0 for r in self.rotations]
        return np.stack([bits[r][:, at] @ (1 << np.arange(len(at))) for r, at in self.parts], axis=1).astype(np.int32)


def learn_rotation(away: np.ndarray, width: int, seed: int) -> np.ndarray:
    """Directions of the most variance, turned so that signs lose as little as can be: in turn the best codes for a rotation
    and the best rotation for codes."""
    rng = np.random.default_rng(seed)
    axes = np.linalg.eigh(away.T @ away + 1e-9 * np.eye(away.shape[1]))[1][:, ::-1][:, :width]
    turn = np.linalg.qr(rng.normal(size=(width, width)))[0]
    flat = away @ axes
    for _ in range(ROUNDS):
        left, _, right = np.linalg.svd(np.where(flat @ turn > 0, 1.0, -1.0).T @ flat)
        turn = (left @ right).T
    return axes @ turn


def fit_quantiser(labels: list, vectors: np.ndarray, largest: int, similarity: float) -> Quantiser:
    """A quantiser from a sample of vectors of one dimension; ``largest``: vectors of the largest label.

    Parts grow with the logarithm of ``largest``, so buckets don't grow. How often a bit differs at the threshold is measured on
    pairs made of the sample, and gives the number of tables.
    """
    unit = unit_vectors(vectors)
    dim = unit.shape[1]
    means = {None: unit.mean(axis=0) if len(unit) >= 32 else np.zeros(dim)}  # the middle of a few lies between them
    for label in set(labels):
        own = [i for i, x in enumerate(labels) if x == label]
        if len(own) >= 32:
            means[label] = unit[own].mean(axis=0)
    away = unit - np.array([means.get(x, means[None]) for x in labels])
    width = min(dim, 64)
    bits = min(max(6, round(log2(max(largest, 1) / BUCKET + 1))), 30, width)
    rng = np.random.default_rng(11)
    few = rng.permutation(len(unit))[:1024]
    noise = rng.normal(size=(len(few), dim))
    noise -= (noise * unit[few]).sum(axis=1)[:, None] * unit[few]
    partner = similarity * unit[few] + (1 - similarity ** 2) ** 0.5 * unit_vectors(noise)
    first = learn_rotation(away, width, 0)
    differ = float(((away[few] @ first > 0) != ((partner - unit[few] + away[few]) @ first > 0)).mean())
    agree = min(max((1 - differ) ** bits, 1e-3), 1 - 1e-9)
    tables = max(2, ceil(log(1 - RECALL) / log(1 - agree)))
    per = width // bits
    rotations = [first] + [learn_rotation(away, width, s) for s in range(1, ceil(tables / per))]
    shuffled = [np.random.default_rng(s).permutation(width) for s in range(len(rotations))]
    parts = [(t // per, shuffled[t // per][t % per * bits:(t % per + 1) * bits]) for t in range(tables)]
    return Quantiser(means, rotations, parts)


def unit_vectors(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length 1, by the largest component first so that no square overflows; zero stays zero."""
    scaled = vectors / np.maximum(np.abs(vectors).max(axis=1, initial=0, keepdims=True), np.finfo(float).tiny)
    return scaled / np.maximum(np.sqrt((scaled * scaled).sum(axis=1, keepdims=True)), np.finfo(float).tiny)


def _lists(column: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of lists of one length, and the lists as rows of a table, length by length."""
    offsets, values = column.offsets.to_numpy(), column.values.to_numpy()
    sizes = np.diff(offsets)
    for size in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == size)
        yield at, values[offsets[at][:, None] + np.arange(size)]


def _linked(unit: np.ndarray, codes: np.ndarray, table: int, part: np.ndarray | None, n: np.ndarray, similarity: float):
    """Of the vectors of a bucket: links of each that no earlier table shows, and the first of those that it hangs together with."""
    links, root = np.zeros(len(unit), np.int64), np.arange(len(unit))
    for at in range(0, len(unit), _ROWS):
        rows = unit[at:at + _ROWS]
        i, j = np.nonzero(np.triu(rows @ unit[at:].T >= similarity, 1))
        i, j = i + at, j + at
        new = ~(codes[i, :table] == codes[j, :table]).any(axis=1)
        if part is not None:
            new &= part[i] != part[j]
        i, j = i[new], j[new]
        np.add.at(links, i, n[j])
        np.add.at(links, j, n[i])
        while True:
            a, b = root[i], root[j]
            apart = a != b
            if not apart.any():
                break
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while (root[root] != root).any():
                root = root[root]
    return links, root


def link_vectors(vectors: DataFrame, similarity: float = 0.98) -> DataFrame:
    """Near duplicates among vectors of equal label.

    The project's records have no vectors, so this is general. ``vectors``: ``vector_id``, ``vector`` (array of numbers), ``label``;
    other columns are left out. Vectors of equal, non-null label and equal dimension whose cosine is ``similarity`` or more are linked.
    Result, one row per input row: ``vector_id``, ``n_links`` (other rows linked directly), ``component_id`` (the smallest id that
    links lead to, its own included), ``kept`` (it has that id). Vectors that are null, empty, zero, or hold a null or non-finite
    component link with nothing. Null ids are the largest. Copies of a vector are linked, and compared with others once.

    A link that is shown has the cosine; a pair is missed if no part of its codes agrees. At the threshold that is
    ``1 - RECALL`` of the pairs by measurement on the sample, and fewer above it. The rotations are learned from at most ``SAMPLE`` vectors and
    ``SAMPLE_VALUES`` numbers, chosen by hash; all vectors are coded. A bucket of more than ``BLOCK`` vectors is cut into blocks that
    meet two at a time in tasks of their own, and a task tells links as numbers per vector: pairs are never rows.
    """
    given = vectors.select(F.col("vector_id"), F.col("vector").cast("array<double>").alias("vector"), F.col("label"))
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = F.col("label").isNotNull() & F.col("vector").isNotNull() & ~bad & F.exists("vector", lambda x: x != 0)
    keyed = given.select("vector_id", "label", "vector", F.coalesce(usable, F.lit(False)).alias("usable")).withColumns(
        {"h": F.xxhash64("label", "vector"), "g": F.xxhash64(F.lit(1), "label", "vector")})
    distinct = stage(keyed.where("usable").groupBy("h", "g").agg(
        F.min("vector_id").alias("vector_id"), F.count(F.lit(1)).alias("n"), F.first("label").alias("label"), F.first("vector").alias("vector"))
        .withColumn("dim", F.size("vector")))
    shown = stage(_met(distinct, similarity))
    links = shown.groupBy("h", "g").agg(F.sum("links").alias("links"))

    def node(name: str):  # null ids last
        return F.struct(F.col(f"{name}.vector_id").isNull().alias("none"), F.col(f"{name}.vector_id").alias("id"), F.col(f"{name}.h").alias("h"), F.col(f"{name}.g").alias("g"))

    key = distinct.select("vector_id", "h", "g")
    edges = shown.where("h <> root_h OR g <> root_g").select("h", "g", "root_h", "root_g").distinct()
    ends = edges.join(key.alias("x"), ["h", "g"]).join(key.alias("y"), (F.col("y.h") == F.col("root_h")) & (F.col("y.g") == F.col("root_g")))
    roots = connected_components(ends.select(node("x").alias("a"), node("y").alias("b"))).select(
        F.col("node.h").alias("h"), F.col("node.g").alias("g"), F.col("root.id").alias("root_id"))
    found = distinct.select("h", "g", "n", F.col("vector_id").alias("own_id")).join(links, ["h", "g"], "left").join(roots, ["h", "g"], "left").select(
        F.col("h").alias("rh"), F.col("g").alias("rg"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root_id", "own_id").alias("component_id"))
    rows = keyed.select("vector_id", "usable", "h", "g").join(found, F.col("usable") & (F.col("h") == F.col("rh")) & (F.col("g") == F.col("rg")), "left")
    component = F.when(F.col("n_links").isNull(), F.col("vector_id")).otherwise(F.col("component_id"))
    return rows.select("vector_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"),
                       F.col("vector_id").eqNullSafe(component).alias("kept"))


def _met(distinct: DataFrame, similarity: float) -> DataFrame:
    """``h``, ``g``, ``links``, ``root_h``, ``root_g``: of each vector and table where it has links, how many it shows first, and a
    vector that it hangs together with."""
    context = distinct.sparkSession.sparkContext
    quantisers = context.broadcast(_fitted(distinct, similarity))
    key = ["label", "dim", "at", "bucket"]
    sent = StructType([distinct.schema["label"], StructField("dim", IntegerType()), StructField("at", IntegerType()), StructField("bucket", IntegerType()),
                       StructField("h", LongType()), StructField("g", LongType()), StructField("n", LongType()),
                       StructField("codes", ArrayType(IntegerType())), StructField("vector", ArrayType(DoubleType()))])

    def coded(batches):
        for batch in batches:
            for where, vectors in _lists(column_of(batch, "vector")):
                rows = batch.take(pa.array(where))
                quantiser = quantisers.value.get(vectors.shape[1]) or Quantiser({None: np.zeros(vectors.shape[1])}, [], [(0, np.zeros(0, int))])
                labels = column_of(rows, "label")
                codes = quantiser.codes(labels.to_pylist(), unit_vectors(vectors)) if quantiser.rotations else np.zeros((len(rows), 1), np.int32)
                tables = codes.shape[1]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, codes.size + 1, tables, dtype=np.int32)), pa.array(codes.ravel()))
                for t in range(tables):
                    yield pa.RecordBatch.from_arrays(
                        [labels, column_of(rows, "dim"), pa.array(np.full(len(rows), t, np.int32)), pa.array(np.ascontiguousarray(codes[:, t])),
                         *[column_of(rows, c) for c in ("h", "g", "n")], lists, column_of(rows, "vector")], names=sent.names)

    in_tables = importable(distinct.select("label", "dim", "h", "g", "n", "vector")).mapInArrow(coded, sent)
    hot = stage(in_tables.groupBy(*key).count().where(F.col("count") > BLOCK).select(*key, F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")))
    # A vector of a hot bucket goes to the tasks of its block with each other block.
    split = in_tables.join(hot, key, "left").withColumn("part", F.pmod("h", F.coalesce("blocks", F.lit(1))).cast("int")).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)))
    cells = split.select(*key, F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "part", "h", "g", "n", "codes", "vector")
    cell = [*key, "low", "high"]

    def compared(batches):
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            done, held = _split_last(held, cell)
            if done is not None:
                yield _compare(done, cell, similarity)
        if held is not None:
            yield _compare(held, cell, similarity)

    return importable(cells.repartition(*cell).sortWithinPartitions(*cell)).mapInArrow(compared, "h bigint, g bigint, links bigint, root_h bigint, root_g bigint")


def _changes(rows: pa.Table, cell: list[str]) -> np.ndarray:
    """Where a cell starts."""
    new = np.zeros(max(rows.num_rows - 1, 0), bool)
    for c in cell:
        values = rows[c].combine_chunks()
        new |= pa.compute.not_equal(values[1:], values[:-1]).to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.flatnonzero(new) + 1])


def _split_last(rows: pa.Table, cell: list[str]) -> tuple[pa.Table | None, pa.Table]:
    """All cells but the last, which may go on in the next batch."""
    last = int(_changes(rows, cell)[-1]) if rows.num_rows else 0
    return (rows.slice(0, last) if last else None), rows.slice(last)


def _compare(rows: pa.Table, cell: list[str], similarity: float) -> pa.RecordBatch:
    starts = _changes(rows, cell) if rows.num_rows else np.zeros(0, int)
    ends = np.append(starts[1:], rows.num_rows)
    out: list[tuple] = []
    h, g, n, dims, at, part, low, high = (rows[c].to_numpy() for c in ("h", "g", "n", "dim", "at", "part", "low", "high"))
    vectors, codes = rows["vector"].combine_chunks(), rows["codes"].combine_chunks()
    v, v_at = vectors.values.to_numpy(), vectors.offsets.to_numpy()
    c, c_at = codes.values.to_numpy(), codes.offsets.to_numpy()
    for a, b in zip(starts.tolist(), ends.tolist()):
        if b - a > 1:
            unit = unit_vectors(v[v_at[a]:v_at[b]].reshape(b - a, dims[a]))
            links, root = _linked(unit, c[c_at[a]:c_at[b]].reshape(b - a, -1), int(at[a]), part[a:b] if low[a] != high[a] else None, n[a:b], similarity)
            some = np.flatnonzero(links)
            out.append((h[a + some], g[a + some], links[some], h[a + root[some]], g[a + root[some]]))
    columns = [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, np.int64)] * 5
    return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["h", "g", "links", "root_h", "root_g"])


def _fitted(distinct: DataFrame, similarity: float) -> dict[int, Quantiser]:
    """A quantiser per dimension of the sample; vectors of a dimension that it lacks share one bucket."""
    groups = distinct.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n"))
    facts = groups.agg(F.max("dim").alias("dim"), F.max("n").alias("n")).first()
    if not facts["dim"]:
        return {}
    rows = distinct.orderBy("h", "g").limit(min(SAMPLE, max(64, SAMPLE_VALUES // facts["dim"]))).select("label", "vector").toArrow().combine_chunks()
    labels = rows["label"].to_pylist()
    return {vectors.shape[1]: fit_quantiser([labels[i] for i in where.tolist()], vectors, facts["n"], similarity)
            for where, vectors in _lists(rows["vector"].combine_chunks())}
