"""Near-duplicate texts by SimHash, compared around the words of a covering code.

Two fingerprints that differ in at most two bits differ in at most one bit in one of their 32-bit halves. Each
half is covered by the words of a Hamming code on 31 bits and one free bit: every value is within one bit of
exactly one anchor (its radius), so a value that differs in one more bit is within two bits of that anchor.
Sending each fingerprint to all anchors within two bits of either half therefore brings every pair together.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from spanweave.llm.common import column_of, importable, map_batches, scripts_of, texts_of
from spanweave.llm.components import connected_components
from spanweave.session import stage

SEED = 42
#: Fingerprints that differ in at most so many bits are linked; the anchors are laid out for it.
LINK_BITS = 2
#: Fingerprints at one anchor up to which they are compared in place. Anchors with more pass theirs on to the
#: comparison by words in between, whose groups have at most 65 members.
CROWD = 32_768
#: Rows compared at a time.
_CHUNK = 65_536

_BITS = np.uint64(1) << np.arange(64, dtype=np.uint64)
_PAIR = StructType([StructField("a", LongType()), StructField("b", LongType())])


def shingle_digests(text: str, shingle: int) -> np.ndarray:
    """Unsigned digests of the shingles, with repeats: A-Z lower-cased, words between ASCII white space."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([digest(b" ".join(words), SEED)], np.uint64)
    return np.fromiter((digest(b" ".join(s), SEED) for s in zip(*[words[i:] for i in range(shingle)])), np.uint64, len(words) - shingle + 1)


def fingerprint_of(digests: np.ndarray) -> int:
    """A bit is 1 if it is set in over half the digests."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(digests), _CHUNK):  # little-endian bytes and bits: column i is bit i
        part = digests[at:at + _CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(_BITS[2 * ones > len(digests)].sum())


def fingerprint(text: str, shingle: int = 3) -> int:
    """Unsigned 64-bit SimHash of a text; 0 without a word."""
    return fingerprint_of(shingle_digests(text, shingle))


def fingerprints(scripts: DataFrame, shingle: int = 3, *carried: str) -> DataFrame:
    """``media_id``, the ``carried`` columns and ``fingerprint`` (the 64 bits as a signed long) of each row of ``scripts``."""
    kept = ("media_id", *carried)

    def run(batches):
        for batch in batches:
            prints = np.array([fingerprint(t, shingle) for t in texts_of(batch)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*[column_of(batch, c) for c in kept], pa.array(prints)], names=[*kept, "fingerprint"])

    return map_batches(scripts_of(scripts, *carried), run, StructField("fingerprint", LongType()), keep=kept)


def anchors(half: np.ndarray) -> np.ndarray:
    """Per 32-bit value (uint64), the 17 anchors within two bits; places without an anchor repeat the nearest.

    The positions 1-31 of a Hamming code name themselves: the exclusive or of the positions of the set bits is the
    position of the one bit to flip. Two bits lead to another word when their positions add up to the same.
    """
    low = half & np.uint64(0x7FFFFFFF)
    position = np.arange(1, 32, dtype=np.uint64)
    mask = [sum(1 << (int(p) - 1) for p in position if int(p) >> b & 1) for b in range(5)]
    syndrome = np.zeros_like(half)
    for b in range(5):
        syndrome |= (np.bitwise_count(low & np.uint64(mask[b])).astype(np.uint64) & np.uint64(1)) << np.uint64(b)

    def bit(p):  # no bit for position 0
        return np.where(p > 0, np.uint64(1) << (np.maximum(p, 1) - np.uint64(1)), np.uint64(0))

    nearest = half ^ bit(syndrome)
    out = [nearest, nearest ^ np.uint64(1 << 31)]
    partner = position[None, :] ^ syndrome[:, None]
    pairs = half[:, None] ^ bit(position)[None, :] ^ bit(partner)
    use = (partner > position[None, :]) & (syndrome[:, None] > 0)
    # 15 pairs where the syndrome is not 0: {p, p ^ s} but for p = s
    packed = np.repeat(nearest[:, None], 15, axis=1)
    rows, columns = np.nonzero(use)
    if len(rows):
        starts = np.searchsorted(rows, np.arange(len(half)))
        packed[rows, np.arange(len(rows)) - starts[rows]] = pairs[rows, columns]
    return np.column_stack([*out, packed])


def _near(anchor: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs that connect, at each anchor, the prints that differ in at most two bits.

    ``anchor`` is sorted. Small groups by shifted comparison; large ones by the words within one bit: two prints
    differ in at most two bits exactly if such words coincide.
    """
    starts = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    sizes = np.diff(np.concatenate([starts, [len(anchor)]]))
    size = np.repeat(sizes, sizes)
    left, right = [], []
    few = np.flatnonzero((size > 1) & (size <= 48))
    a, p = anchor[few], prints[few]
    for k in range(1, 48):
        if k >= len(few):
            break
        same = a[k:] == a[:-k]
        if not same.any():
            break
        hit = np.flatnonzero(same & (np.bitwise_count(p[k:] ^ p[:-k]) <= LINK_BITS))
        left.append(few[hit])
        right.append(few[hit + k])
    for start, n in zip(starts[sizes > 48], sizes[sizes > 48]):
        group = prints[start:start + n]
        words = np.concatenate([group[:, None], group[:, None] ^ _BITS[None, :]], axis=1).ravel()
        owner = np.repeat(np.arange(start, start + n), 65)
        order = np.argsort(words, kind="stable")
        words, owner = words[order], owner[order]
        hit = np.flatnonzero(words[1:] == words[:-1])
        left.append(owner[hit])
        right.append(owner[hit + 1])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def _forest(a: np.ndarray, b: np.ndarray) -> dict[int, int]:
    """Each linked print and the one that stands for it: at most one edge per print."""
    above: dict[int, int] = {}

    def root(x):
        while (up := above.setdefault(x, x)) != x:
            above[x] = above[up]
            x = up
        return x

    for x, y in zip(a.tolist(), b.tolist()):
        x, y = root(x), root(y)
        if x != y:
            above[max(x, y)] = min(x, y)
    return {x: root(x) for x in list(above) if root(x) != x}


def links(prints: DataFrame) -> DataFrame:
    """Edges ``a``, ``b`` that connect the distinct ``fingerprint`` values differing in at most two bits.

    Not every pair: as many as keep the linked ones connected. Each value goes to 17 anchors of either half; a
    task reads its anchors in order and holds one run of them at a time, ``CROWD`` values of one at most.
    """

    def replicate(batches):
        for batch in batches:
            p = column_of(batch, "fingerprint").to_numpy().view(np.uint64)
            for at in range(0, len(p), _CHUNK):
                part = p[at:at + _CHUNK]
                both = np.concatenate([anchors(part & np.uint64(0xFFFFFFFF)), anchors(part >> np.uint64(32)) | np.uint64(1 << 32)], axis=1)
                both.sort(axis=1)
                first = np.ones(both.shape, bool)
                first[:, 1:] = both[:, 1:] != both[:, :-1]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(both[first].view(np.int64)), pa.array(np.repeat(part, first.sum(axis=1)).view(np.int64))], names=["anchor", "fingerprint"])

    def compare(batches):
        def found(anchor, p):
            i, j = _near(anchor, p)
            forest = _forest(p[i].view(np.int64), p[j].view(np.int64))
            return pa.RecordBatch.from_arrays([pa.array(list(forest), pa.int64()), pa.array(list(forest.values()), pa.int64())], names=["a", "b"])

        def crowd(p):
            return pa.RecordBatch.from_arrays([pa.array(p.view(np.int64)), pa.nulls(len(p), pa.int64())], names=["a", "b"])

        anchor, p, passed = np.zeros(0, np.int64), np.zeros(0, np.uint64), None
        for batch in batches:
            anchor = np.concatenate([anchor, column_of(batch, "anchor").to_numpy()])
            p = np.concatenate([p, column_of(batch, "fingerprint").to_numpy().view(np.uint64)])
            if passed is not None:  # the rest of a crowd that is being passed on
                n = np.searchsorted(anchor, passed, side="right")
                yield crowd(p[:n])
                anchor, p = anchor[n:], p[n:]
                passed = passed if not len(anchor) else None
            while len(anchor) >= _CHUNK:
                whole = np.searchsorted(anchor, anchor[-1], side="left")
                if whole:
                    yield found(anchor[:whole], p[:whole])
                    anchor, p = anchor[whole:], p[whole:]
                elif len(anchor) > CROWD:  # one anchor alone
                    yield crowd(p)
                    passed, anchor, p = anchor[0], anchor[:0], p[:0]
                else:
                    break
        if len(anchor):
            yield found(anchor, p)

    placed = importable(prints).select("fingerprint").mapInArrow(replicate, "anchor bigint, fingerprint bigint")
    compared = stage(placed.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(compare, _PAIR))
    flips = F.array(F.lit(0).cast("bigint"), *[F.lit(int(b)).cast("bigint") for b in _BITS.view(np.int64)])
    between = compared.where("b IS NULL").select("a").distinct().select("a", F.explode(flips).alias("flip"))
    stars = between.groupBy(F.col("a").bitwiseXOR(F.col("flip"))).agg(F.min("a").alias("m"), F.collect_list("a").alias("all"))
    crowded = stars.where(F.size("all") > 1).select("m", F.explode("all").alias("a")).where("a <> m").select("a", F.col("m").alias("b")).distinct()
    return compared.where("b IS NOT NULL").union(crowded)


def near_duplicates(scripts: DataFrame, shingle: int = 3, *carried: str) -> DataFrame:
    """Groups of media whose texts have nearly the same fingerprint.

    ``scripts``: ``media_id``, ``text``; other columns are left out, but for those ``carried``. Result, one row per input
    row: ``media_id``, ``fingerprint`` (long), ``root`` (a fingerprint that names the group), ``component_id``: the smallest ``media_id`` that can be reached over links of at most two
    differing bits, its own included. Texts without a word, null ones too, have fingerprint 0 and are linked like
    any other. Null ids are never the smallest: a component of null ids alone has a null id.

    Copies collapse to one row per fingerprint before anything is replicated, so the largest group of equal texts
    costs one comparison; only (id, fingerprint) pairs are shuffled.
    """
    rows = stage(fingerprints(scripts, shingle, *carried))
    prints = rows.groupBy("fingerprint").agg(F.min("media_id").alias("least"))
    roots = connected_components(links(prints)).select(F.col("node").alias("fingerprint"), "root")
    rooted = prints.join(roots, "fingerprint", "left").withColumn("root", F.coalesce("root", "fingerprint"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = stage(rooted.join(least, "root").select("fingerprint", "root", "component_id"))
    return rows.join(named, "fingerprint").select("media_id", *carried, "fingerprint", "root", "component_id")
