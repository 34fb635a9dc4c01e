"""Words in cues: tokens, lexicon matches and their timing."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from spanweave.functions.lexicon import Lexicon
from spanweave.functions.text import let, match_key, normalize_word, word_matches
from spanweave.functions.timefmt import idiv
from spanweave.operators.scan import block_of
from spanweave.session import stage

MEDIA = "media_id"
# Fixed values, in ms: padding, narrowest window, longest believable word, search margin, drift.
PAD_MS, MIN_WINDOW_MS, MAX_WORD_MS, CLIP_MARGIN_MS, DRIFT_MS = 70, 240, 1500, 1500, 1000
# Fixed value, in ms: padding of a word heard by speech recognition.
SPEECH_PAD_MS = 150


#: Bytes of text in a slice of a batch, and tokens in a batch of the result.
_SLICE, _ROWS = 1 << 20, 1 << 16


def tokenize_offsets(cues: DataFrame, *keep: str, columns: Sequence[str] = ("token", "norm", "char_offset"),
                     listed: Lexicon | None = None) -> DataFrame:
    """One row per token of single-spaced cue text, with its offset in the text and the cue's columns ``keep``.

    ``columns`` names what is worked out of a token: ``token``, ``norm``, ``char_offset``, ``word_len``, ``n_words`` of its line. With
    ``listed`` only the tokens whose ``norm`` that lexicon flags. Lines are split, normalised and
    counted whole, as Arrow arrays: an expression per token takes many times as long, and a list per line is quadratic.
    """
    kinds = {"token": "string", "norm": "string", "char_offset": "bigint", "word_len": "bigint", "n_words": "bigint"}
    exact = sorted({w for w, _, kind in listed.rows() if kind == "exact" and w}) if listed else []
    prefixes = [w for w, _, kind in listed.rows() if kind == "prefix"] if listed else []
    chosen, held, size, rows = listed is not None, [MEDIA, "cue_idx", *keep], _SLICE, _ROWS

    def tokens_of(lines: pa.RecordBatch) -> pa.Table:
        text = lines.column(len(held))
        split = pc.split_pattern(text, " ")
        tokens, ends = split.flatten(), np.cumsum(pc.list_value_length(split).to_numpy(), dtype=np.int64)
        counts = np.diff(ends, prepend=0)
        first, line = np.repeat(ends - counts, counts), np.repeat(np.arange(len(counts)), counts)
        out = {"token_idx": pa.array(np.arange(len(tokens)) - first)}
        if "token" in columns:
            out["token"] = tokens
        if "norm" in columns:
            bare = pc.replace_substring_regex(pc.utf8_lower(text), "[^a-z' ]+", "")
            out["norm"] = pc.utf8_trim(pc.split_pattern(bare, " ").flatten(), "'")
        widths = pc.utf8_length(tokens).to_numpy().astype(np.int64)
        if "char_offset" in columns:
            before = np.cumsum(widths + 1) - widths - 1
            out["char_offset"] = pa.array(before - before[first])
        if "word_len" in columns:
            out["word_len"] = pa.array(widths)
        if "n_words" in columns:
            out["n_words"] = pa.array(counts[line])
        if chosen:
            fits = pc.is_in(out["norm"], pa.array(exact, pa.string()))
            for prefix in prefixes:
                fits = pc.or_(fits, pc.starts_with(out["norm"], prefix))
            found = np.flatnonzero(fits.to_numpy(zero_copy_only=False))
            out, line = {c: x.take(pa.array(found)) for c, x in out.items()}, line[found]
        # Columns of the line are copied for the tokens that leave.
        return pa.table({**{c: lines.column(i).take(pa.array(line)) for i, c in enumerate(held)}, **out})

    def run(batches):
        for batch in batches:
            few = max(1, min(batch.num_rows, batch.num_rows * size // max(batch.nbytes, 1)))
            for at in range(0, batch.num_rows, few):
                yield from tokens_of(batch.slice(at, few)).to_batches(max_chunksize=rows)

    # Arrow refuses text that is no UTF-8.
    lines = cues.where("text <> ''").select(*held, F.make_valid_utf8("text").alias("__line"))
    made = StructType.fromDDL(", ".join(f"{c} {kinds[c]}" for c in kinds if c in columns))
    schema = StructType([*[lines.schema[c] for c in held], StructField("token_idx", LongType()), *made])
    return lines.mapInArrow(run, schema)


def _vocabulary(tokens: DataFrame, column: str) -> DataFrame:
    """Distinct words. Staged, as the optimiser would test each token if a test of distinct ones stood in the same plan."""
    return stage(tokens.select(column).distinct())


def lexicon_join(tokens: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Tokens with a listed word or prefix, as joins against a lexicon table.

    Tokens are looked up by ``norm``; where they have none, by the normal form of ``word``, worked out once for each spelling. The
    exact part is an equi-join. Prefixes join by their own text too: a token is looked up under its leading pieces of
    the lengths that prefixes have, so neither a large lexicon nor a long token makes more of them.
    """
    listed = lexicon.select(F.col("word").alias("piece"), (F.col("match_kind") == "prefix").alias("is_prefix"), "tier").where("match_kind IN ('exact', 'prefix')")
    rank = F.when(F.col("tier") == "strong", 0).when(F.col("tier") == "mild", 1).when(
        F.col("tier") == "blasphemy", 2).otherwise(3)
    # Distinct words, so that a word repeated all over the library is matched once.
    spelled = "norm" if "norm" in tokens.columns else "word"
    words = _vocabulary(tokens, spelled)
    words = words.select(F.col(spelled).alias("spelled"), (F.col("norm") if spelled == "norm" else normalize_word(F.col("word"))).alias("norm")).where("norm <> ''")
    # One row, with as many numbers as prefixes have lengths.
    lengths = listed.where("is_prefix").agg(F.collect_set(F.length("piece")).alias("lengths"))
    heads = F.transform(F.filter("lengths", lambda n: n <= F.length("norm")),
                        lambda n: F.struct(F.substring(F.col("norm"), F.lit(1), n).alias("piece"), F.lit(True).alias("is_prefix")))
    pieces = words.crossJoin(F.broadcast(lengths)).select(
        "spelled", F.inline(F.array_append(heads, F.struct(F.col("norm").alias("piece"), F.lit(False).alias("is_prefix")))))
    # Staged, so that the planner knows how few they are; from an estimate it would shuffle all tokens to meet them.
    hits = stage(pieces.join(listed, ["piece", "is_prefix"]).groupBy(F.col("spelled").alias(spelled)).agg(F.min(F.struct(rank.alias("r"), "tier"))["tier"].alias("tier")))
    return tokens.join(hits, spelled).select(*tokens.columns, "tier")


def flagged_words(cues: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Listed words per cue with their place in the text.

    Words are tested among the tokens of a batch and only matches leave it, so the text is copied for them alone.
    """
    hits = tokenize_offsets(cues, "start_ms", "end_ms", "text", columns=("norm", "char_offset", "word_len", "n_words"), listed=lexicon)
    return hits.select(MEDIA, "cue_idx", "start_ms", "end_ms", "text", "token_idx", F.col("norm").alias("key"), "word_len", "char_offset",
                       F.col("n_words").cast("int").alias("n_words"))


def estimate_span(start: Column, end: Column, text_len: Column, offset: Column, word_len: Column
                  ) -> tuple[Column, Column]:
    """Place a word by its share of the cue text."""
    span = F.greatest(end - start, F.lit(MIN_WINDOW_MS))
    total = F.greatest(text_len, F.lit(1))
    at = start + idiv(span * offset, total)
    return at, at + F.greatest(idiv(span * word_len, total), F.lit(MIN_WINDOW_MS))


def clamp_span(cue_start: Column, cue_end: Column, start: Column, end: Column) -> tuple[Column, Column]:
    """A heard word's span if it begins near its cue (else null), never longer than a word can be."""
    near = (start >= cue_start - CLIP_MARGIN_MS) & (start <= cue_end + CLIP_MARGIN_MS)
    capped = F.least(end, start + MAX_WORD_MS)
    return (F.when(near, start),
            F.when(near, F.when(capped <= start, start + MIN_WINDOW_MS).otherwise(capped)))


def mute_window(cue_start: Column, cue_end: Column, start: Column, end: Column) -> tuple[Column, Column]:
    """Final bounds: close to the cue, wide enough, padded, not before zero."""
    a = F.greatest(cue_start - DRIFT_MS, start)
    b = F.least(F.greatest(end, a + MIN_WINDOW_MS), cue_end + DRIFT_MS)
    return F.greatest(a - PAD_MS, F.lit(0)), b + PAD_MS


def to_ms(seconds: Column) -> Column:
    """Seconds to ms, truncating."""
    return (seconds * 1000).cast("bigint")


def cue_word_nearest(flagged: DataFrame, words: DataFrame, lexicon: Lexicon | None = None,
                     bin_ms: int = 10_000) -> DataFrame:
    """For each distinct flagged cue word, the matching heard word nearest the middle of its cue.

    Both sides are reduced to distinct (word, time) first, so copies do not meet. They then join on media,
    time bin and the first letters any two matching words share; the exact conditions follow. Given the
    lexicon, words that can match none of it are dropped in the scan and the rest is staged.
    """
    asked = flagged.select(MEDIA, "start_ms", "end_ms", "key").distinct()
    # Among equal starts the first transcript word wins; equal distances go to the word first heard.
    order = F.struct("seg_idx", "word_idx")
    heard = words.select(MEDIA, normalize_word(F.col("word")).alias("norm"), to_ms(F.col("start_s")).alias("w_start"),
                         to_ms(F.col("end_s")).alias("w_end"), "seg_idx", "word_idx")
    if lexicon is not None:
        heard = stage(heard.where(let(match_key(F.col("norm")), lambda k: k.isin(lexicon.match_keys()))))
    first_heard = heard.groupBy(MEDIA, "norm").agg(F.min(order).alias("norm_at"))
    heard = heard.groupBy(MEDIA, "norm", "w_start").agg(
        F.min(order).alias("word_at"), F.min_by("w_end", order).alias("w_end"))
    lo, hi = F.col("start_ms") - CLIP_MARGIN_MS, F.col("end_ms") + CLIP_MARGIN_MS
    asked = (asked.withColumn("__bin", F.explode(F.sequence(block_of(lo, bin_ms), block_of(hi, bin_ms))))
             .withColumn("__key", match_key(F.col("key"))))
    heard = heard.withColumns({"__bin": block_of("w_start", bin_ms), "__key": match_key(F.col("norm"))})
    middle = F.floor((F.col("start_ms") + F.col("end_ms")) / 2).cast("bigint")
    pairs = asked.join(heard, [MEDIA, "__bin", "__key"]).where(
        F.col("w_start").between(lo, hi) & word_matches(F.col("norm"), F.col("key")))
    near = pairs.withColumn("dist", F.abs(F.col("w_start") - middle))
    # Each norm holds two candidates at most per distance, so the tie on first hearing is small.
    best = near.groupBy(MEDIA, "start_ms", "end_ms", "key", "norm").agg(
        F.min(F.struct("dist", "word_at", "w_start", "w_end")).alias("b"))
    return (best.join(first_heard, [MEDIA, "norm"])
            .groupBy(MEDIA, "start_ms", "end_ms", "key").agg(
                F.min(F.struct("b.dist", "norm_at", "b.word_at", "b.w_start", "b.w_end")).alias("b"))
            .select(MEDIA, "start_ms", "end_ms", "key", F.col("b.w_start").alias("word_start_ms"),
                    F.col("b.w_end").alias("word_end_ms")))


def resolve_word_timing(flagged: DataFrame, nearest: DataFrame | None = None, whole_cue: bool = False) -> DataFrame:
    """Time each flagged word: whole cue, heard word, single-word cue, or estimate; with the source."""
    if nearest is None:
        found = flagged.withColumns({c: F.lit(None).cast("bigint") for c in ("word_start_ms", "word_end_ms")})
    else:
        found = flagged.join(nearest, [MEDIA, "start_ms", "end_ms", "key"], "left")
    cue_start, cue_end = F.col("start_ms"), F.col("end_ms")
    got_a, got_b = clamp_span(cue_start, cue_end, F.col("word_start_ms"), F.col("word_end_ms"))
    est_a, est_b = estimate_span(cue_start, cue_end, F.length("text").cast("bigint"), F.col("char_offset"),
                                 F.col("word_len"))
    if whole_cue:
        return found.withColumns({"word_from_ms": cue_start, "word_to_ms": cue_end, "source": F.lit("whole-cue")})
    found = found.withColumns({"__a": got_a, "__b": got_b})
    single = F.col("n_words") == 1

    def pick(got: Column, cue: Column, est: Column) -> Column:
        return F.when(F.col("__a").isNotNull(), got).when(single, cue).otherwise(est)

    return found.withColumns({
        "word_from_ms": pick(F.col("__a"), cue_start, est_a),
        "word_to_ms": pick(F.col("__b"), cue_end, est_b),
        "source": pick(F.lit("cached-asr"), F.lit("single-word-cue"), F.lit("estimated")),
    }).drop("__a", "__b", "word_start_ms", "word_end_ms")


def word_mutes(timed: DataFrame, whole_cue: bool = False) -> DataFrame:
    """Timed words to hits ready for merging."""
    if whole_cue:
        a, b = F.greatest(F.col("word_from_ms") - PAD_MS, F.lit(0)), F.col("word_to_ms") + PAD_MS
    else:
        a, b = mute_window(F.col("start_ms"), F.col("end_ms"), F.col("word_from_ms"), F.col("word_to_ms"))
    return timed.select(
        MEDIA, a.alias("start_ms"), b.alias("end_ms"), F.col("key").alias("word"),
        F.when(F.col("source") == "estimated", 0.5).otherwise(1.0).alias("confidence"),
        F.concat(F.substring("text", 1, 110), F.lit(" ("), F.col("source"), F.lit(")")).alias("context"),
        F.struct("cue_idx", "token_idx").alias("seq"))


def speech_hits(words: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Listed words in a transcript, padded."""
    return words.where(let(normalize_word(F.col("word")), lexicon.flags)).select(
        MEDIA, F.greatest(to_ms(F.col("start_s")) - SPEECH_PAD_MS, F.lit(0)).alias("start_ms"),
        (to_ms(F.col("end_s")) + SPEECH_PAD_MS).alias("end_ms"), F.trim("word").alias("word"),
        F.col("probability").alias("confidence"), F.substring("seg_text", 1, 120).alias("context"),
        F.struct("seg_idx", "word_idx").alias("seq"))
