"""Ranked lexical search over media texts with exact results, by geometric blocks of posting lists.

Texts are reduced to the impacts of the terms that are asked for. Some thousand of them form a shard; there each term's
posting list is cut into blocks of texts that are alike, and a block stores the largest impact of each term among its
texts. A query walks its lists from the weightiest term on, and passes over a block only if the block's largest
impacts can't reach the best scores known so far.
"""

from __future__ import annotations

import heapq
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from spanweave.llm.common import column_of, importable, portions, texts_of
from spanweave.session import stage

#: Texts in a shard, and numbers in its table, at most; texts in a block on average; directions in which likeness is measured.
SHARD, SHARD_CELLS, BLOCK, DIRECTIONS = 2048, 10 << 20, 32, 24
#: Queries, and code points in them, that are walked in one reading of the texts, on average.
QUERIES, QUERY_CHARS = 512, 1 << 21
#: Share of length in a text's norm, in percent.
LENGTH = 75

#: Bytes that are no part of a term become spaces; A-Z are lowered.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def terms_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split()


def term_array(text: Column) -> Column:
    """The terms of a text, as ``terms_of``, for the few texts that are queries."""
    lowered = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(lowered, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda t: t != "")


@dataclass
class Asked:
    """Queries by their terms: numbers of terms with the weight of each, once per repetition."""

    ids: np.ndarray
    terms: list[np.ndarray]
    weights: list[np.ndarray]


@dataclass
class Shard:
    """Posting lists of some texts. ``impacts[d, t]`` is the impact of term t in text d, 0 where it does not occur.

    ``blocks[t]`` are the texts of a list, block by block, and the largest impacts of each block, rounded up to a byte's steps.
    """

    impacts: np.ndarray
    step: np.ndarray = field(init=False)
    blocks: dict[int, tuple[list[np.ndarray], np.ndarray]] = field(init=False, default_factory=dict)

    def __post_init__(self):
        rng = np.random.default_rng(5)
        scaled = self.impacts.astype(np.float32)
        scaled /= np.maximum(np.sqrt((scaled * scaled).sum(axis=1, keepdims=True)), 1)
        self.shape = scaled @ rng.normal(size=(self.impacts.shape[1], DIRECTIONS)).astype(np.float32)
        self.most = self.impacts.max(axis=0, initial=0).astype(np.int64)
        self.step = np.maximum(-(-self.most // 255), 1).astype(np.int32)

    def list_of(self, term: int) -> tuple[list[np.ndarray], np.ndarray]:
        """The blocks of a term's list and their summaries, made when a query first walks the list."""
        made = self.blocks.get(term)
        if made is None:
            texts = np.flatnonzero(self.impacts[:, term])
            blocks = self.alike(texts)
            summary = np.stack([self.impacts[b].max(axis=0) for b in blocks]) if blocks else np.zeros((0, len(self.step)), np.int32)
            made = self.blocks[term] = blocks, (-(-summary // self.step)).astype(np.uint8)
        return made

    def alike(self, texts: np.ndarray) -> list[np.ndarray]:
        """Texts by the nearest of some of them, evenly chosen, in blocks of at most ``2 * BLOCK``."""
        if len(texts) <= BLOCK:
            return [texts] if len(texts) else []
        middles = texts[np.linspace(0, len(texts) - 1, -(-len(texts) // BLOCK)).astype(int)]
        nearest = (self.shape[texts] @ self.shape[middles].T).argmax(axis=1)
        order = np.argsort(nearest, kind="stable")
        groups = np.split(texts[order], np.flatnonzero(np.diff(nearest[order])) + 1)
        return [part for group in groups for part in np.array_split(group, -(-len(group) // (2 * BLOCK)))]

    def best(self, terms: np.ndarray, weights: np.ndarray, k: int, floor: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Texts that may be among the ``k`` best above ``floor``, with their scores, and how many blocks were passed over.

        A text whose score equals the k-th best stays, so that ids can settle the tie.
        """
        each, at = np.unique(terms, return_inverse=True)
        weight = np.bincount(at, weights, len(each)).astype(np.int64)
        order = np.argsort(-(weight * self.most[each]), kind="stable")
        each, weight = each[order], weight[order]
        reach = np.append(np.cumsum((weight * self.most[each])[::-1])[::-1], 0)  # of the terms from here on
        done = np.zeros(len(self.impacts), bool)
        found, scores, passed = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
        least = max(floor, 1)
        top: list[int] = []
        for i, term in enumerate(each.tolist()):
            if reach[i] < least:
                break
            blocks, summary = self.list_of(term)
            # Texts with an earlier term are settled, so the terms from here on bound the others.
            bounds = (summary[:, each[i:]].astype(np.int64) * self.step[each[i:]]) @ weight[i:]
            for b in np.argsort(-bounds, kind="stable").tolist():
                if bounds[b] < least:
                    break
                texts = blocks[b][~done[blocks[b]]]
                done[texts] = True
                score = self.impacts[np.ix_(texts, each)].astype(np.int64) @ weight
                good = score >= least
                found.append(texts[good])
                scores.append(score[good])
                for s in score[good].tolist():
                    if len(top) < k:
                        heapq.heappush(top, s)
                    elif s > top[0]:
                        heapq.heapreplace(top, s)
                if len(top) == k:
                    least = max(least, top[0])
            passed += int((bounds < least).sum())
            done[np.flatnonzero(self.impacts[:, term])] = True
        texts, score = np.concatenate(found), np.concatenate(scores)
        good = score >= least
        return texts[good], score[good], passed


def rank_scripts(scripts: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """For each query the ``k`` media whose texts score highest, exactly.

    ``scripts``: ``media_id``, ``text`` (subtitles or transcript of a media); ``queries``: ``query_id``, ``text`` (a line or passage of
    dialogue to look for); other columns are left out. Terms are runs of ASCII letters, digits and all characters beyond ASCII; only A-Z are
    lowered; null text has none. With N texts that have a term, L terms in all, n terms of a text and df texts with a term, a term
    weighs ``w = floor(1000 * ln((2 N + 2) / (2 df + 1)))`` and a text has ``m = 100 - LENGTH + LENGTH * n * N // L``. The score is the sum of
    ``w * (1000000000 * tf // (1000 * tf + 8 * m))`` over the query's terms, repeats included; all but w in 64-bit integers.

    Result: ``query_id``, ``rank`` (from 1, unique), ``media_id``, ``score``; only scores above 0, equal ones by media id, nulls last. Each row of
    ``scripts`` is a text of its own; rows of ``queries`` with equal id and text are one query. Empty tables have no result.

    Queries are walked in groups of ``QUERIES`` or ``QUERY_CHARS`` on average, dealt by hash; a group and its terms fit in a task and are all
    that is sent to each. Texts are read once per group for the counts of its terms, which are staged, and each task keeps ``k`` texts per
    query, whatever it reads.
    """
    asked = queries.select("query_id", F.col("text").cast("string").alias("text")).distinct()
    sizes = asked.agg(F.count(F.lit(1)).alias("n"), F.sum(F.char_length("text")).alias("chars")).first()
    groups = max(1, -(-sizes["n"] // QUERIES), -(-(sizes["chars"] or 0) // QUERY_CHARS))
    keyed = stage(asked.withColumn("query", F.xxhash64("query_id", "text")))
    texts = scripts.select("media_id", F.col("text").cast("string").alias("text"))
    parts = [_ranked_group(texts, keyed.where(F.pmod("query", F.lit(groups)) == g), k) for g in range(groups)]
    best = parts[0]
    for part in parts[1:]:
        best = best.unionByName(part)
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("media_id").asc_nulls_last())
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.join(keyed.select("query", "query_id"), "query").select("query_id", F.col("rank").cast("int").alias("rank"), "media_id", "score")


def _ranked_group(texts: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    context = texts.sparkSession.sparkContext
    rows = queries.select("query", term_array(F.col("text")).alias("terms")).toArrow().to_pylist()
    names = sorted({t for r in rows for t in r["terms"]})
    vocabulary = context.broadcast({t.encode("utf-8", "surrogatepass"): i for i, t in enumerate(names)})
    counted = stage(_counted(texts, vocabulary))
    # One number per term of the group, and two more.
    whole = counted.agg(F.count(F.when(F.col("n") > 0, True)).alias("texts"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    held = _document_counts(counted, len(names)).groupBy("term").agg(F.sum("df").alias("df")).select(
        "term", F.floor(1000 * F.log((F.lit(2.0) * whole["texts"] + 2) / (2 * F.col("df") + 1))).cast("bigint").alias("w")).toArrow()
    weights = np.zeros(len(names), np.int64)  # a term of no text has no say
    weights[held["term"].to_numpy()] = held["w"].to_numpy()
    number = {t: i for i, t in enumerate(names)}
    terms = [np.array([number[t] for t in r["terms"]], np.int64) for r in rows]
    ids = np.array([r["query"] for r in rows], np.int64)
    sent = context.broadcast(Asked(ids, terms, [weights[t] for t in terms]))
    n_texts, n_terms, width = whole["texts"], whole["terms"], len(names)

    def search(batches):
        asked = sent.value
        best: list[list] = [[] for _ in asked.ids]
        key = None
        for media, impacts in _shards(batches, n_texts, n_terms, width):
            key, shard, ids = media.type, Shard(impacts), media.to_pylist()
            for q, (of, weight) in enumerate(zip(asked.terms, asked.weights)):
                if not len(of):
                    continue
                floor = -best[q][-1][0] if len(best[q]) == k else 1
                found, scores, _ = shard.best(of, weight, k, floor)
                if len(found):
                    more = ((-s, ids[t] is None, ids[t]) for t, s in zip(found.tolist(), scores.tolist()))
                    best[q] = heapq.nsmallest(k, [*best[q], *more], key=lambda x: (x[0], x[1], 0 if x[1] else x[2]))
        if key is not None:
            flat = [(int(i), m, -s) for i, rows in zip(asked.ids, best) for s, _, m in rows]
            query, media, score = zip(*flat) if flat else ([], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(query, pa.int64()), pa.array(media, key), pa.array(score, pa.int64())], names=["query", "media_id", "score"])

    schema = StructType([StructField("query", LongType()), StructField("media_id", texts.schema["media_id"].dataType), StructField("score", LongType())])
    return importable(counted).mapInArrow(search, schema)


def _counted(texts: DataFrame, vocabulary) -> DataFrame:
    """``media_id``, ``n`` (terms of the text), and which of the asked terms it holds how often."""

    def run(batches):
        known = vocabulary.value
        for batch in portions(batches):
            lengths, terms, times, ends = [], [], [], [0]
            for text in texts_of(batch):
                found = Counter(terms_of(text))
                lengths.append(found.total())
                own = [(known[t], n) for t, n in found.items() if t in known] if len(found) < len(known) else [(i, found[t]) for t, i in known.items() if t in found]
                terms += [t for t, _ in own]
                times += [n for _, n in own]
                ends.append(len(terms))
            ends = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays([column_of(batch, "media_id"), pa.array(lengths, pa.int64()), pa.ListArray.from_arrays(ends, pa.array(terms, pa.int32())),
                                              pa.ListArray.from_arrays(ends, pa.array(times, pa.int64()))], names=["media_id", "n", "terms", "times"])

    schema = StructType([StructField("media_id", texts.schema["media_id"].dataType), StructField("n", LongType()), StructField("terms", ArrayType(IntegerType())),
                         StructField("times", ArrayType(LongType()))])
    return importable(texts).mapInArrow(run, schema)


def _document_counts(counted: DataFrame, width: int) -> DataFrame:
    """``term``, ``df``: texts with a term, summed within each task."""

    def run(batches):
        df = np.zeros(width, np.int64)
        for batch in batches:
            df += np.bincount(column_of(batch, "terms").flatten().to_numpy(), minlength=width)
        there = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), pa.array(df[there])], names=["term", "df"])

    return importable(counted.select("terms")).mapInArrow(run, "term int, df bigint")


def _shards(batches, n_texts: int, n_terms: int, width: int):
    """Ids and impacts of at most ``SHARD`` texts at a time; texts without any of the terms are left out."""
    size = max(1, min(SHARD, SHARD_CELLS // max(width, 1)))
    for batch in batches:
        batch = batch.filter(pa.compute.greater(pa.compute.list_value_length(column_of(batch, "terms")), 0))
        for at in range(0, batch.num_rows, size):
            part = batch.slice(at, size)
            n = column_of(part, "n").to_numpy()
            terms, times = column_of(part, "terms"), column_of(part, "times").flatten().to_numpy()
            row = np.repeat(np.arange(part.num_rows), np.diff(terms.offsets.to_numpy()))
            norm = (100 - LENGTH) + LENGTH * n * n_texts // n_terms
            impacts = np.zeros((part.num_rows, width), np.int32)  # at most 1,000,000
            impacts[row, terms.flatten().to_numpy()] = 1_000_000_000 * times // (1000 * times + 8 * norm[row])
            yield column_of(part, "media_id"), impacts
