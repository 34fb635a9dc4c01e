"""Exact top-k inner products, term at a time.

The library's own records hold no vectors, so the operator is general: rows of any kind, as sparse integer weights
per term (for instance the observation counts of samples per shot).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanweave.llm.common import importable

#: Candidates and queries that meet in one task. A block's postings and one strip of score arrays are all it holds.
CANDIDATES, QUERIES = 8192, 1024
_STRIP = 64


def _scan(queries: pd.DataFrame, rows: pd.DataFrame, k: int) -> pd.DataFrame:
    """The best ``k`` of a block of candidates for each of a block of queries."""
    rows = rows.sort_values("row_id", kind="stable", ignore_index=True)
    ids, n = rows["row_id"].to_numpy(), len(rows)
    lengths = rows["terms"].map(len).to_numpy()
    # Postings: the candidates and weights of each term.
    term = np.concatenate([*rows["terms"], np.zeros(0, np.int64)]).astype(np.int64)
    weight = np.concatenate([*rows["weights"], np.zeros(0, np.int64)]).astype(np.int64)
    at = np.repeat(np.arange(n), lengths)
    order = np.argsort(term, kind="stable")
    names, starts = np.unique(term[order], return_index=True)
    ends = np.append(starts[1:], len(order))
    postings = {t: (at[order[a:b]], weight[order[a:b]]) for t, a, b in zip(names.tolist(), starts, ends)}
    found = []
    for first in range(0, len(queries), _STRIP):
        strip = queries.iloc[first:first + _STRIP]
        scores = np.zeros((len(strip), n), np.int64)
        for i, (terms, weights) in enumerate(zip(strip["terms"], strip["weights"])):
            for t, w in zip(terms, weights):
                if (posting := postings.get(t)) is not None:
                    # a candidate lists a term once, so the scatter adds to each place once
                    scores[i][posting[0]] += posting[1] * w
        for i, own in enumerate(strip["row_id"]):
            line = scores[i]
            others = np.flatnonzero(ids != own)
            if len(others) > k:
                # All that reach the k-th score, then the smaller ids among equals: rows are in order of id.
                worst = np.partition(line[others], len(others) - k)[len(others) - k]
                over, equal = others[line[others] > worst], others[line[others] == worst]
                others = np.concatenate([over, equal[:k - len(over)]])
            found.append(pd.DataFrame({"query_id": own, "row_id": ids[others], "score": line[others]}))
    return pd.concat(found) if found else pd.DataFrame({"query_id": [], "row_id": [], "score": []}).astype("int64")


def top_k(queries: DataFrame, rows: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` rows with the largest inner product for each query, other than the query's own row.

    Both tables: ``row_id`` (long), ``terms`` (array of long, each term once), ``weights`` (array of long of the same
    length); other columns are left out. Rows with a null id, array or element, or arrays of unlike length take no
    part. Result: ``query_id``, ``rank`` from 1, ``row_id``, ``score``; ties go to the smaller ``row_id``; fewer than
    ``k`` rows if there are fewer. A row without common terms scores 0 and takes part. Repeated ids in ``rows`` or in
    ``queries`` count once (equal rows) and are an error of the caller otherwise: one of them is kept, the one with
    the smaller arrays.

    Every block of ``QUERIES`` queries meets every block of ``CANDIDATES`` rows in one task, which keeps its best k;
    those few are merged by query. Blocks are dealt by a hash of the id, so no value is hot.
    """
    def whole(df):
        picked = df.select(F.col("row_id").cast("bigint").alias("row_id"), F.col("terms").cast("array<bigint>").alias("terms"),
                           F.col("weights").cast("array<bigint>").alias("weights"))
        ok = (F.col("row_id").isNotNull() & F.col("terms").isNotNull() & F.col("weights").isNotNull() & (F.size("terms") == F.size("weights"))
              & ~F.exists("terms", lambda x: x.isNull()) & ~F.exists("weights", lambda x: x.isNull()))
        return picked.where(ok).groupBy("row_id").agg(F.min(F.struct("terms", "weights")).alias("v")).select("row_id", "v.*")

    q, c = whole(queries), whole(rows)
    # Two counts decide the number of blocks.
    n_q, n_c = q.count(), c.count()
    q_blocks, c_blocks = -(-n_q // QUERIES) or 1, -(-n_c // CANDIDATES) or 1
    block = lambda n: F.pmod(F.xxhash64("row_id"), F.lit(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = q.select("*", block(q_blocks).alias("qb"), all_of(c_blocks).alias("cb")).repartition(q_blocks * c_blocks, "qb", "cb")
    c = c.select("*", block(c_blocks).alias("cb"), all_of(q_blocks).alias("qb")).repartition(q_blocks * c_blocks, "qb", "cb")
    met = importable(q).groupBy("qb", "cb").cogroup(c.groupBy("qb", "cb")).applyInPandas(
        lambda left, right: _scan(left, right, k), "query_id bigint, row_id bigint, score bigint")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "row_id")
    return met.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "row_id", "score")
