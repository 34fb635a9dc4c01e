"""Collocations in media texts: phrases whose words stand together more often than their parts would by chance.

Phrases are counted in a HAT-trie per task: a shallow trie over word ids with hash containers below it, which burst
into trie nodes as they grow. A full trie spills whole subtrees as sorted runs, and the runs are merged per partition
of phrase prefixes. Most phrases never come near the least count, so digests are counted first, length by length, since a
phrase can't be more frequent than the phrases in it; only what may be frequent enters a trie.
"""

from __future__ import annotations

import zlib
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanweave.llm.common import column_of, importable, portions, texts_of
from spanweave.session import stage

#: Entries of a hash container before it bursts, of a trie before it spills, and words known to a task before it starts afresh.
BURST, HELD, KNOWN = 4096, 300_000, 500_000
#: Bits in the sketch of what is frequent: 8 MB whatever the corpus. It has no false negatives; false positives cost time alone.
SKETCH_BITS = 1 << 26
#: Lengths whose frequent phrases are told apart first, one reading of the texts each, and those that are then counted in one.
SIFTED, COUNTED = (1, 2, 3), (1, 2, 3, 4, 5)
#: A first part shared by many phrases is looked up under so many keys.
SALTS = 16
_SLICE = 4 << 20
_STRIPS = 2 << 20
_ROWS = 1 << 15

_UPPER, _LOWER = bytes(range(65, 91)), bytes(range(97, 123))
#: A-Z are lowered; signs that end a piece become line feeds, and then a word of their own that no text has.
_FOLD = bytes.maketrans(_UPPER + b".,;:!?\x0b\x0c\r\t", _LOWER + b"\n" * 9 + b" ")
_END = b"."


class _Node:
    __slots__ = ("ends", "kids")

    def __init__(self):
        self.ends: dict[int, int] = {}  # counts of phrases that end with this word
        self.kids: dict[int, dict | _Node] = {}  # by word: a container of the words behind it, or a node


class HatTrie:
    """Counts of phrases, tuples of word ids."""

    def __init__(self, burst: int = BURST):
        self.burst, self.size, self.root = burst, 0, _Node()

    def add(self, phrase: tuple[int, ...], n: int) -> None:
        node, at = self.root, 0
        while True:
            word, at = phrase[at], at + 1
            if at == len(phrase):
                self.size += word not in node.ends
                node.ends[word] = node.ends.get(word, 0) + n
                return
            kid = node.kids.get(word)
            if kid is None:
                kid = node.kids[word] = {}
            if type(kid) is dict:
                rest = phrase[at:]
                known = kid.get(rest)
                kid[rest] = n if known is None else known + n
                if known is None:
                    self.size += 1
                    if len(kid) > self.burst:
                        node.kids[word] = _burst(kid)
                return
            node = kid

    def spill(self, keep: int) -> list[tuple[tuple[int, ...], int]]:
        """Take out whole subtrees below first words, the largest first, until at most ``keep`` entries are left."""
        root = self.root
        sizes = dict.fromkeys(root.ends, 1)
        for word, kid in root.kids.items():
            sizes[word] = sizes.get(word, 0) + _entries(kid)
        out = []
        for word in sorted(sizes, key=sizes.__getitem__, reverse=True):
            if self.size <= keep:
                break
            self.size -= sizes[word]
            if word in root.ends:
                out.append(((word,), root.ends.pop(word)))
            if word in root.kids:
                out += _walk((word,), root.kids.pop(word))
        return out


def _burst(container: dict) -> _Node:
    node = _Node()
    for rest, n in container.items():
        if len(rest) == 1:
            node.ends[rest[0]] = n
        else:
            node.kids.setdefault(rest[0], {})[rest[1:]] = n
    return node


def _entries(kid: dict | _Node) -> int:
    return len(kid) if type(kid) is dict else len(kid.ends) + sum(map(_entries, kid.kids.values()))


def _walk(before: tuple[int, ...], kid: dict | _Node) -> Iterator[tuple[tuple[int, ...], int]]:
    if type(kid) is dict:
        for rest, n in kid.items():
            yield before + rest, n
    else:
        for word, n in kid.ends.items():
            yield (*before, word), n
        for word, below in kid.kids.items():
            yield from _walk((*before, word), below)


class _Words(dict):
    """Ids of the words of one language; -1 for those that are not frequent and for the end of a piece."""

    def __init__(self, reader: PhraseReader, lang: str):
        super().__init__({_END: -1})
        self.reader, self.lang = reader, lang
        self.seed = xxhash.xxh64_intdigest(lang.encode("utf-8", "surrogatepass"), 42)

    def __missing__(self, word: bytes) -> int:
        reader, digest = self.reader, xxhash.xxh64_intdigest(word, self.seed)
        if 1 not in reader.sketches or int(reader.sketches[1][digest >> 6 & SKETCH_BITS // 64 - 1]) >> (digest & 63) & 1:
            at = self[word] = len(reader.spelled)
            reader.spelled.append((self.lang, word))
            reader.digests.append(digest)
        else:
            at = self[word] = -1
        return at


def _in_sketch(sketch: np.ndarray, digests: np.ndarray) -> np.ndarray:
    return (sketch[digests >> np.uint64(6) & np.uint64(SKETCH_BITS // 64 - 1)] >> (digests & np.uint64(63)) & np.uint64(1)).astype(bool)


def _longer(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Digests of phrases that go on with a word."""
    mixed = (before ^ before >> np.uint64(29)) * np.uint64(0x9E3779B97F4A7C15) + word
    return (mixed ^ mixed >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)


class PhraseReader:
    """Phrases of texts whose shorter parts are all frequent, as far as ``sketches`` by length tell."""

    def __init__(self, lengths: tuple[int, ...], sketches: dict[int, np.ndarray]):
        self.lengths, self.sketches = lengths, sketches
        self.forget()

    def forget(self) -> None:
        self.spelled: list[tuple[str, bytes]] = []
        self.digests = array("Q")
        self.words: dict[str, _Words] = {}

    def read(self, lang: str, texts: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Length, digests and places of phrases, and the word ids that places point to, slice by slice."""
        known = self.words.get(lang)
        if known is None:
            known = self.words[lang] = _Words(self, lang)
        whole = b" . ".join([t.translate(_FOLD).replace(b"\n", b" . ") for t in texts])
        at, carried, reach = 0, np.zeros(0, np.int64), max(self.lengths) - 1
        while at < len(whole):
            end = len(whole)
            if end - at > _SLICE:  # between two words; the last words before are carried over
                end = whole.rfind(b" ", at, at + _SLICE)
                if end <= at:
                    end = whole.find(b" ", at + 1)
                    end = len(whole) if end < 0 else end
            tokens = whole[at:end].split()
            ids = np.concatenate([carried, np.fromiter(map(known.__getitem__, tokens), np.int64, len(tokens))])
            yield from self._phrases(ids, len(carried))
            carried, at = ids[len(ids) - min(reach, len(ids)):], end

    def _phrases(self, ids: np.ndarray, carried: int):
        ok = ids >= 0
        words = np.frombuffer(self.digests.tobytes() or bytes(8), np.uint64)[np.maximum(ids, 0)]
        digest = words
        for k in range(1, max(self.lengths) + 1):
            if k > 1:
                digest, ok = _longer(digest[:-1], words[k - 1:]), ok[:-1] & ok[1:]
                where = np.flatnonzero(ok)
                if k in self.sketches:
                    ok[where[~_in_sketch(self.sketches[k], digest[where])]] = False
            if k in self.lengths:
                where = np.flatnonzero(ok)
                where = where[where + k > carried]  # the others lie in the slice before
                yield k, digest[where], where, ids


class PhraseCounter(PhraseReader):
    """Exact counts of phrases in a HAT-trie."""

    def __init__(self, lengths: tuple[int, ...], sketches: dict[int, np.ndarray], held: int = HELD, burst: int = BURST):
        super().__init__(lengths, sketches)
        self.held, self.trie = held, HatTrie(burst)

    def feed(self, lang: str, texts: list[bytes]) -> Iterator[list]:
        """Count the phrases of texts; whatever is spilled meanwhile."""
        for k, digests, where, ids in self.read(lang, texts):
            _, first, n = np.unique(digests, return_index=True, return_counts=True)
            words = ids[where[first][:, None] + np.arange(k)]
            if len(first) < len(digests):  # equal digests are settled by the words themselves
                words, n = _settled(words, n, digests, where, ids, k)
            for phrase, times in zip(words.tolist(), n.tolist()):
                self.trie.add(tuple(phrase), times)
            if self.trie.size > self.held:
                yield self.run(self.held // 2)
        if len(self.spelled) > KNOWN:
            yield self.run(0)
            self.forget()

    def run(self, keep: int = 0) -> list[tuple[str, bytes, int]]:
        """A sorted run of (language, phrase, count)."""
        spelled = self.spelled
        return sorted((spelled[p[0]][0], b" ".join([spelled[w][1] for w in p]), n) for p, n in self.trie.spill(keep))


def _settled(words: np.ndarray, n: np.ndarray, digests: np.ndarray, where: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Phrases and counts, also if different phrases have one digest."""
    number = np.unique(digests, return_inverse=True)[1]
    odd = np.zeros(len(digests), bool)
    for i in range(k):
        odd |= ids[where + i] != words[number, i]
    if not odd.any():
        return words, n
    return np.unique(ids[where[:, None] + np.arange(k)], axis=0, return_counts=True)


def _texts_by_lang(batch: pa.RecordBatch) -> dict[str, list[bytes]]:
    by_lang: dict[str, list[bytes]] = {}
    for lang, text in zip(column_of(batch, "lang").to_pylist(), texts_of(batch)):
        by_lang.setdefault(lang, []).append(text.encode("utf-8", "surrogatepass"))
    return by_lang


def count_phrases(scripts: DataFrame, lengths: tuple[int, ...], sketches: dict[int, object], least: int, held: int = HELD, burst: int = BURST) -> DataFrame:
    """``lang``, ``phrase``, ``n`` of phrases of ``lengths`` words found ``least`` times or more, overlaps included. ``sketches``:
    broadcasts of what is frequent, by length.

    A spilled run is cut by the first two words of its phrases and sent as one value per cut; the runs of a cut are merged.
    """
    cuts = 4 * int(scripts.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        counter = PhraseCounter(lengths, {k: s.value for k, s in sketches.items()}, held, burst)

        def sent(rows):
            by_part: dict[int, list] = {}
            for row in rows:
                prefix = row[1].split(b" ", 2)[:2]
                by_part.setdefault(xxhash.xxh64_intdigest(b" ".join([row[0].encode("utf-8", "surrogatepass"), *prefix])) % cuts, []).append(row)
            yield pa.RecordBatch.from_arrays([pa.array(list(by_part), pa.int32()), pa.array([_packed(r) for r in by_part.values()], pa.binary())], names=["part", "run"])

        for batch in portions(batches):
            for lang, texts in _texts_by_lang(batch).items():
                for spilled in counter.feed(lang, texts):
                    yield from sent(spilled)
        yield from sent(counter.run())

    def merge(batches):
        now, runs = None, []

        def merged():
            table = pa.concat_tables(runs).group_by(["lang", "phrase"]).aggregate([("n", "sum")]).rename_columns(["lang", "phrase", "n"])
            yield from table.filter(pa.compute.greater_equal(table["n"], least)).to_batches(_ROWS)

        for batch in batches:
            for part, packed in zip(column_of(batch, "part").to_pylist(), column_of(batch, "run")):
                if part != now and runs:
                    yield from merged()
                    runs = []
                now = part
                runs.append(pa.ipc.open_stream(packed.as_buffer()).read_all())
        if runs:
            yield from merged()

    packed = importable(scripts).mapInArrow(run, "part int, run binary").repartition("part").sortWithinPartitions("part")
    return packed.mapInArrow(merge, "lang string, phrase string, n bigint")


def _packed(run: list[tuple[str, bytes, int]]) -> bytes:
    """A sorted run as a compressed Arrow stream; neighbours in it have much in common."""
    lang, phrase, n = zip(*run)
    batch = pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array([p.decode("utf-8", "surrogatepass") for p in phrase], pa.string()), pa.array(n, pa.int64())],
                                       names=["lang", "phrase", "n"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd"))) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def frequent_digests(scripts: DataFrame, length: int, sketches: dict[int, object], least: int) -> tuple[np.ndarray, DataFrame]:
    """A sketch of the phrases of ``length`` words found ``least`` times or more, and ``lang``, ``n``: words read.

    Tasks send sorted strips of digests with their counts, cut at the upper bits, and each range of digests is summed. Phrases
    that share a digest count together, so none is lost. At most ``SKETCH_BITS`` bits reach the driver, however many phrases there are.
    """
    spark = scripts.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) * 4 - 1).bit_length()

    def strips(found: list[np.ndarray], sums: list[np.ndarray]):
        digests, n = _summed(np.concatenate(found), np.concatenate(sums))
        cut = np.searchsorted(digests, np.arange(1, 1 << parts, dtype=np.uint64) << np.uint64(64 - parts))
        for part, (d, c) in enumerate(zip(np.split(digests, cut), np.split(n, cut))):
            if len(d):
                yield part, _strip(d, np.minimum(c, least))

    def run(batches):
        reader = PhraseReader((length,), {k: s.value for k, s in sketches.items()})
        found, sums, size, total = [], [], 0, Counter()

        def sent():
            part, strip = zip(*strips(found, sums)) if size else ([], [])
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(strip, pa.binary()), pa.nulls(len(part), pa.string()), pa.nulls(len(part), pa.int64())],
                                             names=["part", "strip", "lang", "n"])

        for batch in portions(batches):
            for lang, texts in _texts_by_lang(batch).items():
                for _, digests, _, _ in reader.read(lang, texts):
                    total[lang] += len(digests)
                    digests, n = np.unique(digests, return_counts=True)
                    found.append(digests)
                    sums.append(n)
                    size += len(digests)
                if size > _STRIPS:
                    yield from sent()
                    found, sums, size = [], [], 0
            if len(reader.spelled) > KNOWN:
                reader.forget()
        yield from sent()
        yield pa.RecordBatch.from_arrays([pa.nulls(len(total), pa.int32()), pa.nulls(len(total), pa.binary()), pa.array(list(total), pa.string()),
                                          pa.array(list(total.values()), pa.int64())], names=["part", "strip", "lang", "n"])

    def frequent(batches):
        now, held = None, []

        def done():
            digests, n = _summed(*(np.concatenate(x) for x in zip(*map(_unstrip, held))))
            at = digests[n >= least] & np.uint64(SKETCH_BITS - 1)
            return pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).view(np.int64)), pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))], names=["w", "b"])

        for batch in batches:
            for part, strip in zip(column_of(batch, "part").to_pylist(), column_of(batch, "strip")):
                if part != now and held:
                    yield done()
                    held = []
                now = part
                held.append(strip.as_py())
        if held:
            yield done()

    read = stage(importable(scripts).mapInArrow(run, "part int, strip binary, lang string, n bigint"))
    by_part = read.where("part IS NOT NULL").select("part", "strip").repartition("part").sortWithinPartitions("part")
    bits = by_part.mapInArrow(frequent, "w bigint, b bigint").groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    sketch = np.zeros(SKETCH_BITS >> 6, np.uint64)
    sketch[bits["w"].to_numpy()] = bits["b"].to_numpy().view(np.uint64)
    return sketch, read.where("lang IS NOT NULL").groupBy("lang").agg(F.sum("n").alias("n"))


def _summed(digests: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    each, at = np.unique(digests, return_inverse=True)
    return each, np.bincount(at, n, len(each)).astype(np.int64)


def _strip(digests: np.ndarray, n: np.ndarray) -> bytes:
    """Sorted digests byte by byte, so that the upper ones, which hardly change, and the counts pack well."""
    planes = np.concatenate([digests.view(np.uint8).reshape(-1, 8).T.ravel(), n.astype("<u4").view(np.uint8).reshape(-1, 4).T.ravel()])
    return len(digests).to_bytes(8, "little") + zlib.compress(planes.tobytes(), 1)


def _unstrip(strip: bytes) -> tuple[np.ndarray, np.ndarray]:
    size = int.from_bytes(strip[:8], "little")
    planes = np.frombuffer(zlib.decompress(strip[8:]), np.uint8)
    digests = np.ascontiguousarray(planes[:8 * size].reshape(8, size).T).view(np.uint64).ravel()
    return digests, np.ascontiguousarray(planes[8 * size:].reshape(4, size).T).view("<u4").ravel()


def mine_collocations(scripts: DataFrame, min_count: int = 100, top: int = 2000, held: int = HELD, burst: int = BURST) -> DataFrame:
    """The strongest collocations of two to five words per language of media texts.

    ``scripts``: ``media_id``, ``text`` (subtitles or transcript of a media), ``lang``; other columns are left out. Null text is
    empty, null language is ``und``. A-Z are lowered, texts are cut into pieces at ``[.,;:!?\\x0A-\\x0D]`` and those into words
    at spaces and tabs; phrases lie within a piece. Repeated rows count each time. An empty table has no result.

    Candidates are phrases found ``min_count`` times or more (``a``). Cut after its first k words, a candidate scores
    ``1000 * a * n // (l * r)``: ``n`` words of its language, ``l`` and ``r`` occurrences of the two parts; its lowest cut counts, of
    equal ones the first. A candidate inside a longer one that is as frequent is dropped. Result, at most ``top`` rows per
    language: ``lang``, ``rank`` (from 1; by score, then ``a``, both descending, then phrase), ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``.

    The texts are read once per length in ``SIFTED``, for a sketch of what is frequent, whose size is fixed, and once to count what
    the sketches leave; the more a corpus fills them, the less they leave out, and the more is spilled. ``held`` bounds the entries of
    a task's trie, ``burst`` those of a container.
    """
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("und"))
    texts = scripts.select(lang.alias("lang"), F.col("text").cast("string").alias("text"))
    context = scripts.sparkSession.sparkContext
    sketches, totals = {}, None
    for length in SIFTED:
        sketch, words = frequent_digests(texts, length, dict(sketches), min_count)
        sketches[length] = context.broadcast(sketch)
        totals = words if totals is None else totals
    frequent = stage(count_phrases(texts, COUNTED, sketches, min_count, held, burst))
    return _ranked(_scored(frequent, totals.withColumnRenamed("n", "total")), top)


def _scored(frequent: DataFrame, totals: DataFrame) -> DataFrame:
    """Candidates with their lowest cut; those as frequent as a longer one are left out."""
    words = F.split("phrase", " ")
    candidates = frequent.where(F.size(words) > 1).select("lang", "phrase", F.col("n").alias("a"), words.alias("words"))

    def part(start: Column, length: Column) -> Column:
        return F.array_join(F.slice("words", start, length), " ")

    # One word more is enough: between a candidate and a longer one that is as frequent all lengths are as frequent.
    size = F.size("words")
    inner = candidates.where(size > 2).select("lang", "a", F.explode(F.array(part(F.lit(1), size - 1), part(F.lit(2), size - 1))).alias("phrase"))
    inner = inner.groupBy("lang", "phrase").agg(F.max("a").alias("longer_a"))
    whole = candidates.join(inner, ["lang", "phrase"], "left").where(F.col("longer_a").isNull() | (F.col("longer_a") < F.col("a")))

    salt = F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).cast("int")
    cuts = whole.withColumn("k", F.explode(F.sequence(F.lit(1), size - 1))).select(
        "lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("first"), part(F.col("k") + 1, size - F.col("k")).alias("rest"), salt.alias("salt"))
    salted = frequent.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    parts = cuts.join(salted.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l"), "salt"), ["lang", "first", "salt"])
    parts = parts.join(salted.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r"), "salt"), ["lang", "rest", "salt"])
    parts = parts.join(F.broadcast(totals), "lang")  # a row per language

    def exact(c: str) -> Column:
        return F.col(c).cast("decimal(18,0)")

    score = F.call_function("div", F.lit(1000).cast("decimal(4,0)") * (exact("a") * exact("total")).cast("decimal(34,0)"), exact("l") * exact("r"))
    lowest = F.min(F.struct(score.cast("bigint").alias("score"), "k", "l", "r"))
    return parts.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.first("total").alias("n"), lowest.alias("cut"))


def _ranked(scored: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("lang").orderBy(F.col("cut.score").desc(), F.col("a").desc(), "phrase")
    ranked = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n",
                         F.col("cut.score").alias("score"))
