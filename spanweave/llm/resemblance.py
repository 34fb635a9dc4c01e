"""Groups of texts that share most of their shingles: SimHash links and, beyond their reach, links proved on the sets.

Fingerprints at two differing bits miss most pairs of similarity 0.8, which differ in some ten bits. The rest comes
from banded minima: two texts of similarity s agree in a band of five minima with probability s^5, so at 0.8 they
meet in one of 20 bands with 0.9996. A meeting is only a candidate; the shingles of both texts decide.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField

from spanweave.llm.common import column_of, importable, map_batches, portions, scripts_of, texts_of
from spanweave.llm.components import connected_components
from spanweave.llm.simhash import SEED, fingerprint_of, links, shingle_digests
from spanweave.session import stage

#: Bands and minima in each. Every band counts once more with the first minimum of the next one added, which tells
#: apart the texts of a band that only have a common passage.
BANDS, ROWS = 20, 5
_ODD = np.array([xxhash.xxh32_intdigest(f"odd{i}", SEED) | 1 for i in range(BANDS * ROWS)], np.uint32)
_MASK = np.array([xxhash.xxh32_intdigest(f"mask{i}", SEED) for i in range(BANDS * ROWS)], np.uint32)
#: Shingles whose minima are taken at a time.
_CHUNK = 4096


def shingle_set(digests: np.ndarray) -> np.ndarray:
    """The distinct shingles as sorted 32-bit values."""
    return np.unique((digests >> np.uint64(32)).astype("<u4"))


def bands_of(shingles: np.ndarray) -> list[int]:
    """Signed 64-bit names of the bands of a set, odd ones for those with an added minimum; none for an empty set."""
    if not len(shingles):
        return []
    least = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(shingles), _CHUNK):
        part = shingles[at:at + _CHUNK].astype(np.uint32)
        np.minimum(least, ((part[:, None] ^ _MASK) * _ODD).min(axis=0), out=least)
    data = np.concatenate([least, least[:1]]).astype("<u4").tobytes()
    size = 4 * ROWS
    names = [xxhash.xxh64_intdigest(data[b * size:(b + 1) * size + more], b) for more in (0, 4) for b in range(BANDS)]
    kind = np.arange(2 * BANDS, dtype=np.uint64) // np.uint64(BANDS)
    return (np.array(names, np.uint64) >> np.uint64(1) << np.uint64(1) | kind).view(np.int64).tolist()


def sketches(scripts: DataFrame, shingle: int, *carried: str) -> DataFrame:
    """``carried``, ``fingerprint``, ``own`` (a digest of the set of shingles), ``n`` (their number) and ``bands`` of each row of ``scripts``."""

    def run(batches):
        for batch in batches:
            prints, own, sizes, bands = [], [], [], []
            for text in texts_of(batch):
                digests = shingle_digests(text, shingle)
                shingles = shingle_set(digests)
                prints.append(fingerprint_of(digests))
                own.append(xxhash.xxh64_intdigest(shingles.tobytes(), SEED))
                sizes.append(len(shingles))
                bands.append(bands_of(shingles))
            yield pa.RecordBatch.from_arrays(
                [*[column_of(batch, c) for c in carried], pa.array(np.array(prints, np.uint64).view(np.int64)),
                 pa.array(np.array(own, np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), pa.array(bands, pa.list_(pa.int64()))],
                names=[*carried, "fingerprint", "own", "n", "bands"])

    return map_batches(scripts_of(scripts, *[c for c in carried if c != "media_id"]), run, StructField("fingerprint", LongType()), StructField("own", LongType()),
                       StructField("n", IntegerType()), StructField("bands", ArrayType(LongType())), keep=carried)


def resembling(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The ``pairs`` (``a``, ``b``) whose ``sets`` (``own``, ``shingles``) have that share of their union in common."""

    def run(batches):
        for batch in portions(batches):
            left, right = (column_of(batch, c).to_pylist() for c in ("left", "right"))
            near = []
            for x, y in zip(left, right):
                x, y = np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4")
                common = len(np.intersect1d(x, y, assume_unique=True))
                near.append(common + 1e-9 >= similarity * (len(x) + len(y) - common))
            picked = batch.filter(pa.array(near, pa.bool_()))
            yield pa.RecordBatch.from_arrays([column_of(picked, "a"), column_of(picked, "b")], names=["a", "b"])

    both = pairs.select("a", "b").join(sets.select(F.col("own").alias("a"), F.col("shingles").alias("left")), "a").join(
        sets.select(F.col("own").alias("b"), F.col("shingles").alias("right")), "b")
    return importable(both).mapInArrow(run, "a bigint, b bigint")


def crossing(texts: DataFrame, sets: DataFrame, named: DataFrame, similarity: float) -> DataFrame:
    """Pairs (``a``, ``b``) of texts in different groups that may reach ``similarity``, among texts that share a band with texts of other groups.

    An exact prefix filter: shingles are ordered from the rarest on, and sets of that similarity have one in common among the first of
    both, so many of the larger set and fewer of the smaller one. A passage that a whole family shares is frequent, so it comes
    last and brings nobody together; where groups differ in it alone, its place tells that what follows is too little.
    ``named``: ``node``, ``root`` of the groups so far.
    """
    banded = texts.select("own", "n", F.explode(F.filter("bands", lambda b: b.bitwiseAND(1) == 0)).alias("band"))
    tagged = banded.join(named.select(F.col("node").alias("own"), "root"), "own", "left").withColumn("root", F.coalesce("root", "own"))
    mixed = tagged.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("members")).where(
        "low <> high AND members > 2").select("band")  # two have been held against each other
    inside = stage(tagged.join(mixed, "band").select("own", "root", "n").distinct())

    def lists(batches):
        for batch in portions(batches):
            found = [np.frombuffer(x, "<i4") for x in column_of(batch, "shingles").to_pylist()]
            ends = pa.array(np.cumsum([0, *map(len, found)]).astype(np.int32))
            values = pa.array(np.concatenate([np.zeros(0, np.int32), *found]))
            yield pa.RecordBatch.from_arrays([*[column_of(batch, c) for c in kept], pa.ListArray.from_arrays(ends, values)], names=[*kept, "tokens"])

    kept = ["own", "root", "n"]
    held = importable(inside.join(sets, "own").select(*kept, "shingles")).mapInArrow(lists, "own bigint, root bigint, n int, tokens array<int>")
    tokens = held.select(*kept, F.explode("tokens").alias("token"))
    # A shingle of one text has only a place; one of a single group brings nobody new.
    common = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df"), (F.min("root") != F.max("root")).alias("mixed")).where("df > 1")
    ordered = tokens.join(common, "token").groupBy(*kept).agg(F.array_sort(F.collect_list(F.struct("df", "token", "mixed"))).alias("order"))
    placed = F.transform("order", lambda t, i: F.struct(t["token"].alias("token"), (F.col("n") - F.size("order") + i).alias("at"), t["mixed"].alias("mixed")))

    def first(share: float):
        return F.col("n") - F.ceil(F.col("n") * share - 1e-9) + 1

    many = first(similarity)
    places = stage(ordered.select(*kept, F.explode(F.filter(placed, lambda t: t["mixed"] & (t["at"] < many))).alias("t")).select(
        *kept, "t.token", "t.at", (F.col("t.at") < first(2 * similarity / (1 + similarity))).alias("few")))
    x, y = places.alias("x"), places.where("few").alias("y")
    smaller = (F.col("y.n") < F.col("x.n")) | ((F.col("y.n") == F.col("x.n")) & (F.col("y.own") < F.col("x.own")))
    left = F.least(F.col("x.n") - F.col("x.at"), F.col("y.n") - F.col("y.at"))
    may = left + 1e-9 >= similarity / (1 + similarity) * (F.col("x.n") + F.col("y.n"))
    near = x.join(y, F.col("x.token") == F.col("y.token")).where(
        (F.col("x.root") != F.col("y.root")) & smaller & may & (F.col("y.n") + 1e-9 >= similarity * F.col("x.n")))
    return stage(near.select(F.col("x.own").alias("a"), F.col("y.own").alias("b")).distinct())


def resembling_groups(scripts: DataFrame, key: tuple[str, str], shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """Groups of media whose texts are near duplicates: fingerprints within two bits, or sets of shingles of at least
    ``similarity``, directly or over other texts.

    ``scripts``: ``media_id``, ``text`` and two columns ``key`` (never null) that name a row by its id and text; others
    are left out. Result, one row per input row: ``media_id``, the key, ``fingerprint``, ``root`` (names the group).
    Texts without a word, null ones too, are one group with each other. Repeated rows keep their number. An empty
    table has no groups.

    One text stands for each set of shingles. In each band its texts are held against one of them, so
    candidates grow with the texts and not with the pairs of a group: first each text against the one it shares most
    bands with, then the candidates that are still in different groups. Where a band then holds texts of several groups,
    those are joined exactly, see ``crossing``, so no pair that shares a band is lost. Sets of candidates alone are shuffled.
    """
    rows = stage(sketches(scripts, shingle, "media_id", *key))
    texts = stage(rows.groupBy("own").agg(F.min(F.struct(*key, "fingerprint", "n", "bands")).alias("r")).select("own", "r.*"))
    # Of the sets with one fingerprint the least stands for it; a set whose shingles repeat differently has several.
    printed = rows.select("own", "fingerprint").distinct()
    prints = stage(printed.groupBy("fingerprint").agg(F.min("own").alias("least")))
    close = links(prints)
    for end in ("a", "b"):
        close = close.join(prints.select(F.col("fingerprint").alias(end), F.col("least").alias(f"own_{end}")), end)
    close = close.select(F.col("own_a").alias("a"), F.col("own_b").alias("b")).union(
        printed.join(prints, "fingerprint").where("own <> least").select(F.col("own").alias("a"), F.col("least").alias("b")))
    banded = texts.select(F.col("own").alias("a"), F.explode("bands").alias("band"))
    # Even bands agree on the smallest set's name. Odd ones each have an order of their own, so that a text which
    # resembles another one only, and not the smallest, meets that one as well.
    order = F.when(F.col("band").bitwiseAND(1) == 1, F.col("band")).otherwise(0)
    hubs = stage(banded.groupBy("band").agg(F.min(F.col("a").bitwiseXOR(order)).alias("b"), F.count(F.lit(1)).alias("members"))
                 .where("members > 1").select("band", F.col("b").bitwiseXOR(order).alias("b")))
    met = banded.join(hubs, "band").where("a <> b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))
    sizes = texts.select("own", "n")
    sized = met.join(sizes.select(F.col("own").alias("a"), F.col("n").alias("na")), "a").join(
        sizes.select(F.col("own").alias("b"), F.col("n").alias("nb")), "b")
    # Sets whose sizes are further apart cannot have so much in common.
    pairs = stage(sized.where(F.least("na", "nb") + 1e-9 >= similarity * F.greatest("na", "nb")).select("a", "b", "shared"))

    company = banded.join(hubs, "band").select(F.col("a").alias("own")).distinct()
    chosen = texts.join(company, "own").select(*key, "own")

    def shingles(batches):
        for batch in batches:
            sets = [shingle_set(shingle_digests(t, shingle)).tobytes() for t in texts_of(batch)]
            yield pa.RecordBatch.from_arrays([column_of(batch, "own"), pa.array(sets, pa.binary())], names=["own", "shingles"])

    # Candidates grow with the table: the same join at every size, and no broadcast of a small one.
    written = scripts.select(*key, "text").join(stage(chosen).hint("merge"), list(key)).select("own", F.col("text").cast("string").alias("text"))
    sets = stage(map_batches(written, shingles, StructField("shingles", BinaryType()), keep=("own",)).dropDuplicates(["own"]))

    best = stage(pairs.groupBy("a").agg(F.max(F.struct("shared", "b"))["b"].alias("b")))
    first = close.union(resembling(best, sets, similarity))
    roots = stage(connected_components(first))
    rest = pairs.select("a", "b").join(best, ["a", "b"], "left_anti")
    for end in ("a", "b"):
        rest = rest.join(roots.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}")), end, "left")
    apart = stage(rest.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b"))
    more = roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(resembling(apart, sets, similarity))
    named = stage(connected_components(more))
    last = named.select(F.col("node").alias("a"), F.col("root").alias("b")).union(resembling(crossing(texts, sets, named, similarity), sets, similarity))
    named = stage(connected_components(last)).select(F.col("node").alias("own"), "root")
    return rows.join(named, "own", "left").select("media_id", *key, "fingerprint", F.coalesce("root", "own").alias("root"))
