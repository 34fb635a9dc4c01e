"""Lines that many media share, as compressed keep bitmaps per media.

Lines become hashes at the scan. The hashes are range-partitioned together with their media, so a line that
sits in a third of all texts spreads over many partitions, and are sorted by media and position in them; what
comes back is a bitmap of the dropped lines per text, never the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanweave.llm.common import SPACES, filled_text, row_key, scripts_of
from spanweave.session import stage

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Lines in one word of a bitmap.
WORD = 64


def line_key(line: Column) -> Column:
    """The line without outer ASCII white space, A-Z in lower case; other letters as they are."""
    bare = F.btrim(line, F.lit(SPACES))
    plain = F.octet_length(bare) == F.char_length(bare)  # lower() is exact, and faster, on ASCII alone
    return F.when(plain, F.lower(bare)).otherwise(F.translate(bare, _UPPER, _LOWER))


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_keep_bitmaps(scripts: DataFrame, min_chars: int = 40, min_media: int = 5) -> DataFrame:
    """Which lines of each media's text stay when lines that many media share are kept once.

    A line's key is the line without outer ASCII white space and with A-Z in lower case. A key of at least
    ``min_chars`` code points found in at least ``min_media`` media loses all its lines but those in the media with
    the largest ``media_id`` (all of them there). Media are told apart by ``media_id``; rows with a null id count
    as one media that is smaller than all others. Repeated rows get the same result each; rows of one id with
    different texts are one media but have a bitmap each.

    ``scripts``: ``media_id``, ``text``; other columns are left out. Null or empty text: one empty line. Result, one
    row per input row: ``media_id``, ``text_key`` (tells texts of one id apart), ``n_lines``, ``n_dropped`` and
    ``dropped``, the bitmap: an array of (``word``, ``bits``) for the 64-line words that drop any line, in order.
    Bit i of a word stands for line 64 * word + i; words not listed keep all lines.
    """
    texts = filled_text(scripts_of(scripts)).select("media_id", row_key().alias("text_key"), lines_of(F.col("text")).alias("lines"))
    line = F.posexplode("lines").alias("pos", "line")
    keys = texts.select("media_id", "text_key", line).select("media_id", "text_key", "pos", line_key(F.col("line")).alias("key"))
    # 128 bits: at 10^12 lines, 64 bits would collide.
    hashed = keys.where(F.char_length("key") >= min_chars).select(
        F.xxhash64("key").alias("h"), F.xxhash64(F.lit(1), F.col("key")).alias("g"), "media_id", "text_key", "pos")
    staged = stage(hashed)
    ordered = staged.repartitionByRange("h", "g", "media_id").sortWithinPartitions("h", "g", F.desc("media_id"), "pos")
    # One row per key and media off the sorted range, without another shuffle; then partial counts per key. As a table
    # of its own, so that the join reads both sides from shuffles that can be split at a hot line.
    common = stage(ordered.groupBy("h", "g", "media_id").agg(F.lit(1).alias("one"))
              .groupBy("h", "g").agg(F.count(F.lit(1)).alias("media"), F.max("media_id").alias("keeper"))
              .where(F.col("media") >= min_media).select("h", "g", "keeper"))
    dropped = staged.join(common, ["h", "g"]).where(~F.col("media_id").eqNullSafe(F.col("keeper")))
    words = dropped.groupBy("media_id", "text_key", F.expr(f"pos div {WORD}").cast("int").alias("word")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, pos % {WORD})")).alias("bits"))
    bitmaps = words.groupBy("media_id", "text_key").agg(F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("dropped"))
    # 'texts' is read again for its ids and sizes only; two texts of one id have two keys.
    sizes = texts.select("media_id", "text_key", F.size("lines").cast("bigint").alias("n_lines")).alias("s")
    joined = sizes.join(bitmaps.alias("b"), F.col("s.media_id").eqNullSafe(F.col("b.media_id")) & (F.col("s.text_key") == F.col("b.text_key")), "left")
    bits = F.coalesce(F.col("b.dropped"), F.expr("cast(array() as array<struct<word:int,bits:bigint>>)"))
    return joined.select("s.media_id", "s.text_key", "n_lines", n_dropped(bits).alias("n_dropped"), bits.alias("dropped"))


def n_dropped(bitmap: Column) -> Column:
    return F.aggregate(bitmap, F.lit(0).cast("bigint"), lambda n, w: n + F.bit_count(w["bits"]))


def kept_text(text: Column, bitmap: Column) -> Column:
    """The lines that a bitmap keeps, joined again."""
    whole = F.coalesce(text, F.lit(""))
    lines, table = lines_of(whole), F.map_from_entries(bitmap)
    dense = F.transform(F.sequence(F.lit(0), F.floor((F.size(lines) - 1) / WORD).cast("int")),
                        lambda w: F.coalesce(F.element_at(table, w), F.lit(0).cast("bigint")))
    # An array of one binds the dense bitmap, else it would be built again for every line.
    kept = F.transform(F.array(dense), lambda bits: F.array_join(F.filter(
        lines, lambda line, i: F.getbit(F.get(bits, F.floor(i / WORD).cast("int")), i % WORD) == 0), "\n"))
    return F.when(F.size(bitmap) == 0, whole).otherwise(F.get(kept, F.lit(0)))


def drop_lines(scripts: DataFrame, bitmaps: DataFrame, *carried: str) -> DataFrame:
    """``scripts`` with the lines taken out that ``bitmaps`` drop: ``media_id``, ``text``, ``n_lines``, ``n_dropped``, and
    the columns named in ``carried``.

    One row per input row: rows meet by id and text, and bitmaps of repeated rows are equal.
    """
    b = bitmaps.groupBy("media_id", "text_key").agg(
        F.first("n_lines").alias("n_lines"), F.first("n_dropped").alias("n_dropped"), F.first("dropped").alias("dropped")).alias("b")
    s = filled_text(scripts_of(scripts, *carried)).withColumn("text_key", row_key()).alias("s")
    joined = s.join(b, F.col("s.media_id").eqNullSafe(F.col("b.media_id")) & (F.col("s.text_key") == F.col("b.text_key")))
    return joined.select("s.media_id", kept_text(F.col("s.text"), F.col("dropped")).alias("text"), "n_lines", "n_dropped",
                         *[f"s.{c}" for c in carried])
