"""Rule counts and n-gram perplexity of media texts, with a band per language.

The language model is a modified Kneser-Ney model over bytes, counted by Spark over all texts. Its n-grams and their
probabilities are Spark tables, all grams of all orders; texts are read in blocks, and each block looks up its distinct
grams by a join.
"""

from __future__ import annotations

import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from spanweave.llm.common import SPACES, column_of, give_back, importable, portions, row_key, scripts_of, texts_of
from spanweave.session import scratch_path, stage

#: Longest n-gram, in bytes. A gram is packed into a long, most recent byte last.
ORDER = 5
#: Bytes of text in a block at least, if its task has as many; a block has as many distinct grams at most.
BLOCK = 32 << 20
#: Discounts where counts of counts leave them undefined.
DISCOUNT = 0.75
#: Base rules: fewest words, and the most percent of them in repeated windows.
MIN_WORDS, MAX_REPEATED = 10, 20
#: A band is the middle half of a language's texts, widened by so many of its widths.
WIDTHS = 1.5
#: The mean over n bytes of text varies between texts of a language as 1 + SPREAD / n: perplexities are compared after
#: their distance from the median is divided by the root of it.
SPREAD = 1000.0
SYMBOLS = "#*$%&|<>"
_STRIP = 1 << 16

_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeat_words(words: list[bytes], span: int = 5) -> int:
    """Words inside windows of ``span`` words that the text holds more than once, the first one included."""
    n = len(words) - span + 1
    if n < 2:
        return 0
    hashes = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    mixed = np.zeros(n, np.uint64)
    for i in range(span):
        mixed = (mixed ^ hashes[i:i + n]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    order = np.sort(mixed)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    maybe = np.flatnonzero(np.isin(mixed, twice)).tolist()
    windows = [tuple(words[i:i + span]) for i in maybe]  # equal hashes are settled by the words themselves
    seen = Counter(windows)
    covered = np.zeros(len(words) + 1, np.int64)
    for i, window in zip(maybe, windows):
        if seen[window] > 1:
            covered[i] += 1
            covered[i + span] -= 1
    return int((np.cumsum(covered) > 0).sum())


def rule_counts(text: str) -> tuple[int, int, int, int, int]:
    """Words, code points in words, symbols, lines equal to an earlier one, and words in repeated windows."""
    words = text.encode("utf-8", "surrogatepass").split()
    chars = len(text) - sum(map(text.count, SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [line for line in text.split("\n") if line.strip(SPACES)]
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeat_words(words)


# -- the model ----------------------------------------------------------------------------------------


def _grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The packed gram that ends at each byte, and where each text starts; a text is preceded by zero bytes."""
    pad = bytes(ORDER - 1)
    lengths = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer(b"".join(x for t in texts for x in (pad, t)), np.uint8)
    packed = np.zeros(max(len(data) - ORDER + 1, 0), np.uint64)
    for i in range(ORDER):
        packed = (packed << np.uint64(8)) | data[i:i + len(packed)]
    # Grams that end inside the padding of a text do not count.
    starts = np.cumsum(np.concatenate([[0], lengths + ORDER - 1]))
    real = np.zeros(len(packed) + ORDER, bool)
    for s, n in zip(starts, lengths):
        real[s:s + n] = True
    return packed[real[:len(packed)]], np.concatenate([[0], np.cumsum(lengths)])


def read_blocks(scripts: DataFrame, passing_only: bool = False) -> DataFrame:
    """The texts, and the grams that they hold, dealt into blocks of ``BLOCK`` bytes by one scan; if ``passing_only``, texts
    that fail the base rules come without their text and grams.

    A row of ``texts`` has ``block`` and some megabytes of texts as a compressed Arrow stream, with ``media_id``, ``text_key``,
    ``lang``, ``lang_key``, ``text``, ``n_bytes`` and the rule counts; one of a gram has ``block``, ``lang_key``, ``gram`` (``ORDER``
    bytes in a long) and ``n``, how often it is in the block's texts of that language. ``lang_key`` is never null.
    """
    names = ["block", "lang_key", "gram", "n", "texts"]

    def run(batches):
        part, number, size = TaskContext.get().partitionId(), 0, 0
        held: dict[str, list] = {}

        def emit():
            for lang, found in held.items():
                g, n = _summed(found)
                for at in range(0, len(g), _STRIP):
                    few = len(g[at:at + _STRIP])
                    yield pa.RecordBatch.from_arrays([pa.array([part << 32 | number] * few, pa.int64()), pa.array([lang] * few, pa.string()),
                                                      pa.array(g[at:at + _STRIP].view(np.int64)), pa.array(n[at:at + _STRIP]), pa.nulls(few, pa.binary())], names=names)

        for batch in portions(batches):
            texts, keys = texts_of(batch), column_of(batch, "lang_key").to_pylist()
            raw = [t.encode("utf-8", "surrogatepass") for t in texts]
            counts = np.array([rule_counts(t) for t in texts], np.int64).reshape(-1, len(_COUNTS))
            sent = [not passing_only or n >= MIN_WORDS and 100 * repeated <= MAX_REPEATED * n for n, repeated in counts[:, [0, -1]].tolist()]
            for lang in set(keys):
                for some in _portions([t for t, x, s in zip(raw, keys, sent) if x == lang and s]):
                    found = held.setdefault(lang, [])
                    found.append(np.unique(_grams(some)[0], return_counts=True))
                    if len(found) > 2:
                        held[lang] = [_summed(found)]
            told = {c: column_of(batch, c) for c in ("media_id", "text_key", "lang", "lang_key")} | {
                "text": pa.array([t if s else None for t, s in zip(texts, sent)], pa.string()), "n_bytes": pa.array([len(t) for t in raw], pa.int64()),
                **{c: pa.array(counts[:, i]) for i, c in enumerate(_COUNTS)}}
            yield pa.RecordBatch.from_arrays([pa.array([part << 32 | number]), pa.nulls(1, pa.string()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()),
                                              pa.array([_packed(pa.RecordBatch.from_pydict(told))], pa.binary())], names=names)
            size += sum(map(len, raw))
            if size >= BLOCK:
                yield from emit()
                held, number, size = {}, number + 1, 0
        yield from emit()
        held.clear()
        give_back()

    lang = F.col("lang").cast("string")
    key = F.when(lang.isNull(), "").otherwise(F.concat(F.lit("="), lang))
    rows = scripts_of(scripts, lang.alias("lang"), key.alias("lang_key")).withColumn("text_key", row_key())
    return importable(rows).mapInArrow(run, "block bigint, lang_key string, gram bigint, n bigint, texts binary")


def _packed(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 9))) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _portions(texts: list[bytes], limit: int = 1 << 20):
    """Texts in portions of a megabyte; a longer text is a portion of its own."""
    part, size = [], 0
    for t in texts:
        if part and size + len(t) > limit:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t)
    if part:
        yield part


def _summed(parts: list) -> tuple[np.ndarray, np.ndarray]:
    if len(parts) == 1:
        return parts[0]
    g, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return g, np.bincount(inverse, np.concatenate([p[1] for p in parts])).astype(np.int64)


def gram_orders(found: DataFrame) -> list[DataFrame]:
    """``lang_key``, ``gram``, ``n`` of the orders from the shortest: the longest grams have their counts, shorter ones the
    number of different bytes that come before them."""
    orders = [stage(found.groupBy("lang_key", "gram").agg(F.sum("n").alias("n")))]
    for k in range(ORDER - 1, 0, -1):
        orders.append(stage(orders[-1].groupBy("lang_key", F.col("gram").bitwiseAND(F.lit((1 << 8 * k) - 1)).alias("gram")).agg(F.count(F.lit(1)).alias("n"))))
    return orders[::-1]


def discounts(grams: DataFrame) -> DataFrame:
    """``lang_key`` and the discounts of counts of 1, 2, and 3 or more, from the counts of counts; a row per language."""
    t = grams.groupBy("lang_key").agg(*[F.count(F.when(F.col("n") == i, True)).cast("double").alias(f"t{i}") for i in (1, 2, 3, 4)])
    t1, t2, t3, t4 = (F.col(f"t{i}") for i in (1, 2, 3, 4))
    y, known = t1 / (t1 + 2 * t2), (t1 > 0) & (t2 > 0)

    def held(ready: Column, value: Column, most: float) -> Column:
        return F.least(F.greatest(F.when(ready, value).otherwise(F.lit(DISCOUNT)), F.lit(0.1)), F.lit(most))

    return t.select("lang_key", held(known, 1 - 2 * y * t2 / t1, 0.95).alias("d1"), held(known & (t3 > 0), 2 - 3 * y * t3 / t2, 1.9).alias("d2"),
                    held(known & (t3 > 0) & (t4 > 0), 3 - 4 * y * t4 / t3, 2.85).alias("d3"))


def gram_scores(found: DataFrame) -> DataFrame:
    """``lang_key``, ``gram``, ``p``: the probability of the last byte of each of the longest grams after the others, under
    the interpolated modified Kneser-Ney model of its language.

    The suffix of a gram is a gram of the next shorter order, so probabilities build up by one join per order. A
    context has at most 256 followers, and a suffix as many bytes before it, so no key is hot.
    """
    below = None
    for k, grams in enumerate(gram_orders(found), 1):
        cut = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        same = Window.partitionBy("lang_key", "context")
        rows = grams.join(F.broadcast(discounts(grams)), "lang_key").select(  # a row per language
            "lang_key", "gram", "n", cut.alias("cut"), F.shiftright("gram", 8).alias("context"))
        total = F.sum("n").over(same)
        shares = rows.select("lang_key", "gram", (F.greatest(F.col("n") - F.col("cut"), F.lit(0.0)) / total).alias("own"), (F.sum("cut").over(same) / total).alias("gamma"))
        if below is None:
            below = shares.select("lang_key", "gram", (F.col("own") + F.col("gamma") / 257).alias("p"))
        else:
            shorter = below.select("lang_key", F.col("gram").alias("suffix"), "p")
            shares = shares.withColumn("suffix", F.col("gram").bitwiseAND(F.lit((1 << 8 * (k - 1)) - 1)))
            below = shares.join(shorter, ["lang_key", "suffix"]).select("lang_key", "gram", (F.col("own") + F.col("gamma") * F.col("p")).alias("p"))
    return below


class HashArray:
    """Values by 64-bit key in arrays sorted by hash; the upper bits of a hash index where to look."""

    def __init__(self, keys: np.ndarray, *values: np.ndarray):
        hashed = _mix(keys)
        order = np.argsort(hashed)
        self.hashes = np.append(hashed[order], np.uint64(0xFFFFFFFFFFFFFFFF))
        self.values = [np.append(v[order], v.dtype.type(0)) for v in values]
        bits = max(1, int(len(keys)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.starts = np.searchsorted(self.hashes[:-1], np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places, and whether the key is there."""
        hashed = _mix(keys)
        at = self.starts[hashed >> self.shift]
        seen = self.hashes[at]
        todo = np.flatnonzero(seen < hashed)
        while len(todo):
            at[todo] += 1
            todo = todo[self.hashes[at[todo]] < hashed[todo]]
        return at, self.hashes[at] == hashed


def _mix(keys: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits, so that different grams never share a hash."""
    h = keys * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    return h * np.uint64(0xD6E8FEB86659FD93)


def _log_perplexity(known: HashArray, texts: list[bytes]) -> np.ndarray:
    """Mean negative log probability per byte of each text; null (NaN) for an empty one. ``known`` has all their grams."""
    sums, lengths = [], []
    for part in _portions(texts):
        grams, starts = _grams(part)
        scores = np.concatenate([np.zeros(0), *[known.values[0][known.find(grams[i:i + _STRIP])[0]] for i in range(0, len(grams), _STRIP)]])
        total = np.concatenate([[0.0], np.cumsum(scores)])
        sums.append(total[starts[1:]] - total[starts[:-1]])
        lengths.append(np.diff(starts))
    s, n = np.concatenate([np.zeros(0), *sums]), np.concatenate([np.zeros(0), *lengths])
    return np.where(n > 0, -s / np.maximum(n, 1), np.nan)


# -- the verdict ---------------------------------------------------------------------------------------


def _stage_blocks(read: DataFrame) -> DataFrame:
    """``read`` as a table in buckets of blocks, as many as a shuffle has partitions: the texts, its bulk, are not shuffled to meet their grams."""
    spark, name = read.sparkSession, f"blocks_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    read.write.format("parquet").bucketBy(buckets, "block").option("path", scratch_path(spark, "blocks")).saveAsTable(name)
    return spark.table(name)


def score_scripts(scripts: DataFrame, passing_only: bool = False) -> DataFrame:
    """``media_id``, ``text_key``, ``lang``, ``n_bytes``, the rule counts and ``log_ppl``: the mean negative log probability per byte
    under the model of the language, counted over all texts of ``scripts``; null for an empty text. If ``passing_only``, over
    those that pass the base rules; null for others."""
    read = _stage_blocks(read_blocks(scripts, passing_only))
    found = read.where("gram IS NOT NULL").select("block", "lang_key", "gram", "n")
    looked_up = found.select(F.col("block").alias("in_block"), "lang_key", "gram").join(
        gram_scores(found).select("lang_key", "gram", F.log("p").cast("float").alias("log_p")), ["lang_key", "gram"])
    texts = read.where("texts IS NOT NULL").select("block", "texts")
    names = ["media_id", "text_key", "lang", "n_bytes", *_COUNTS]

    def run(texts: pa.Table, grams: pa.Table) -> pa.Table:
        known, keys, done = {}, grams["lang_key"].combine_chunks(), []
        for lang in keys.unique().to_pylist():
            own = grams.filter(pa.compute.equal(keys, lang))
            known[lang] = HashArray(own["gram"].to_numpy().view(np.uint64), own["log_p"].to_numpy())
        for row in texts["texts"]:
            batch = pa.ipc.open_stream(row.as_buffer()).read_next_batch()
            raw, langs = [t.encode("utf-8", "surrogatepass") for t in texts_of(batch)], column_of(batch, "lang_key").to_pylist()
            scores = np.full(len(raw), np.nan)
            for lang in known.keys() & set(langs):
                which = [i for i, x in enumerate(langs) if x == lang]
                scores[which] = _log_perplexity(known[lang], [raw[i] for i in which])
            done.append(pa.RecordBatch.from_arrays([*[column_of(batch, c) for c in names], pa.array(scores, mask=np.isnan(scores))], names=[*names, "log_ppl"]))
        known.clear()
        give_back()
        return pa.Table.from_batches(done)

    kinds = {"media_id": scripts.schema["media_id"].dataType, "lang": StringType(), "log_ppl": DoubleType()}
    schema = StructType([StructField(c, kinds.get(c, LongType())) for c in [*names, "log_ppl"]])
    return texts.groupBy("block").cogroup(importable(looked_up).groupBy("in_block")).applyInArrow(run, schema)


def judge_scripts(scripts: DataFrame, passing_only: bool = False) -> DataFrame:
    """Rule counts, perplexity and the verdict on each media's text.

    ``scripts``: ``media_id``, ``text``, ``lang``; other columns are left out. Null text has no words; texts without a
    language are a language of their own. Words are set apart by ASCII white space. Result, one row per input row:
    ``media_id``, ``text_key`` (tells texts of one id apart), ``lang``, ``n_words``, ``word_chars``, ``n_symbols``,
    ``n_dup_lines``, ``n_repeat_words``, ``log_ppl``, ``base_failed`` (fewer than ``MIN_WORDS`` words, or more than
    ``MAX_REPEATED`` percent of the words in repeated windows of five) and ``kept``: not failed, and the perplexity lies
    within the band of its language, whose lower end rejects text that repeats what the corpus holds and whose upper
    end text that is unlike it. Bands come from the texts of the language that pass the base rules. With
    ``passing_only`` the model does too, and ``log_ppl`` is null for texts that fail them; else it is counted over all.
    """
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    scored = stage(score_scripts(scripts, passing_only).withColumn("base_failed", failed))
    passed = scored.where("NOT base_failed")

    def with_language(texts: DataFrame, figures: DataFrame) -> DataFrame:
        return texts.alias("s").join(figures.alias("f"), F.col("s.lang").eqNullSafe(F.col("f.lang")), "left").drop(F.col("f.lang"))

    middles = passed.groupBy("lang").agg(F.percentile_approx("log_ppl", F.lit(0.5), 10_000).alias("middle"))
    distance = (F.col("log_ppl") - F.col("middle")) / F.sqrt(1 + F.lit(SPREAD) / F.greatest("n_bytes", F.lit(1)))
    quartiles = with_language(passed, middles).groupBy("lang").agg(
        F.first("middle").alias("middle"), F.percentile_approx(distance, F.array(F.lit(0.25), F.lit(0.75)), 10_000).alias("q"))
    slack = (F.col("q")[1] - F.col("q")[0]) * WIDTHS
    inside = (distance >= F.col("q")[0] - slack) & (distance <= F.col("q")[1] + slack)
    return with_language(scored, quartiles).select("media_id", "text_key", "lang", *_COUNTS, "log_ppl", "base_failed",
                                                   (~F.col("base_failed") & F.coalesce(inside, F.lit(False))).alias("kept"))
