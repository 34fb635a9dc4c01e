"""Streams, packets, rendered subtitle events, runtimes and audio samples."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanweave.functions.timefmt import idiv
from spanweave.operators.intervals import merge_spans
from spanweave.operators.scan import Running, bins, block_of, running, time_blocks
from spanweave.session import stage

MEDIA = "media_id"
# Subtitle codecs by kind, and timing limits in ms.
TEXT_CODECS = ("subrip", "ass", "ssa", "mov_text", "webvtt")
IMAGE_CODECS = ("dvd_subtitle", "dvdsub", "hdmv_pgs_subtitle", "pgssub")
MIN_CUE_MS, MAX_CUE_MS, FORCED_MAX_PACKETS = 300, 7000, 50


def _speaks(language: str) -> Column:
    return F.coalesce(F.lower("language"), F.lit("")).startswith(language[:2])


def pick_text_stream(streams: DataFrame, language: str = "eng") -> DataFrame:
    """The first text track in the language, else the first text track."""
    return streams.where(F.col("codec").isin(*TEXT_CODECS)).groupBy(MEDIA).agg(
        F.min(F.struct((~_speaks(language)).alias("other"), "index"))["index"].alias("index"))


def pick_image_stream(streams: DataFrame, language: str = "eng") -> DataFrame:
    """The fullest bitmap track in the language (else of all); null if even that is a forced track."""
    fullest = F.struct("packets", (-F.col("index")).alias("i"))
    best = streams.where(F.col("codec").isin(*IMAGE_CODECS)).groupBy(MEDIA).agg(
        F.coalesce(F.max(F.when(_speaks(language), fullest)), F.max(fullest)).alias("b"))
    return best.select(MEDIA, F.when(F.col("b.packets") > FORCED_MAX_PACKETS, -F.col("b.i")).alias("index"))


def packet_times(packets: DataFrame) -> DataFrame:
    """Start and end per packet from its text fields; a zero or missing duration counts as 300 ms."""
    start, span = F.col("pts_time").try_cast("double"), F.col("duration_time").try_cast("double")
    start_ms = (start * 1000).cast("bigint")
    width = F.when(F.coalesce(span, F.lit(0.0)) == 0, F.lit(MIN_CUE_MS)).otherwise((span * 1000).cast("bigint"))
    return packets.where(start.isNotNull() & ~F.isnan(start)).select(
        *[c for c in packets.columns if c not in ("pts_time", "duration_time")],
        start_ms.alias("start_ms"), (start_ms + width).alias("end_ms"))


def cue_end_from_blanks(events: DataFrame) -> DataFrame:
    """Timed cues from rendered subtitle events: a blank one ends the cue before it.

    ``events``: (media_id, t_ms, text); a null text is a blank frame, an empty one was unreadable.
    """
    cues = events.where("text <> ''").select(MEDIA, F.col("t_ms").alias("start_ms"), "text")
    # Three numbers per instant, staged: the scan for them reads the events, with their text, once.
    marks = stage(events.where("text is null or text <> ''").groupBy(MEDIA, "t_ms").agg(
        F.max(F.when(F.col("text").isNotNull(), F.col("t_ms"))).alias("cue_ms"),
        F.max(F.col("text").isNull()).alias("blank")))
    placed = running(marks, [MEDIA], ["t_ms"], time_blocks("t_ms"), of=Running("last", F.col("cue_ms"), True))
    ends = placed.where("blank and of is not null").groupBy(MEDIA, F.col("of").alias("start_ms")).agg(
        F.max("t_ms").alias("blank_ms"))
    shortest, longest = F.col("start_ms") + MIN_CUE_MS, F.col("start_ms") + MAX_CUE_MS
    return cues.join(ends, [MEDIA, "start_ms"], "left").select(
        MEDIA, "start_ms", F.least(F.greatest(F.coalesce("blank_ms", longest), shortest), longest).alias("end_ms"), "text")


def runtime_fallback(media: DataFrame, findings: DataFrame) -> DataFrame:
    """Measured runtime, else a minute past the last finding, else a minute."""
    last = findings.groupBy(MEDIA).agg(F.max("end_ms").alias("last_ms"))
    measured = F.when(F.col("duration_ms") > 0, F.col("duration_ms"))
    return media.join(last, MEDIA, "left").select(
        MEDIA, F.coalesce(measured, F.when(F.col("last_ms") != 0, F.col("last_ms") + 60_000), F.lit(60_000))
        .cast("bigint").alias("runtime_ms"))


def peaks(samples: DataFrame, windows: DataFrame, per_sec: int = 40) -> DataFrame:
    """Loudest sample per bucket of each window, as a share of full scale.

    ``windows``: (media_id, duration_s). Left-over samples at the end are dropped; a window with fewer
    samples than buckets is silent.
    """
    sizes = samples.groupBy(MEDIA).agg(F.count(F.lit(1)).alias("n_samples"))
    plan = windows.join(sizes, MEDIA, "left").withColumns({
        "n_samples": F.coalesce("n_samples", F.lit(0)),
        "n_buckets": F.greatest(F.bround(F.col("duration_s") * per_sec), F.lit(1)).cast("bigint")})
    plan = plan.withColumn("bucket", idiv(F.col("n_samples"), F.col("n_buckets")))
    loud = samples.join(plan.where("bucket > 0"), MEDIA).withColumn(
        "bucket_idx", idiv(F.col("sample_idx"), F.col("bucket"))).where("bucket_idx < n_buckets")
    measured = loud.groupBy(MEDIA, "bucket_idx").agg(
        F.bround(F.max(F.abs("amplitude")) / 32768.0, 3).alias("peak"))
    silent = plan.where("bucket = 0").select(
        MEDIA, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_buckets") - 1)).alias("bucket_idx"),
        F.lit(0.0).alias("peak"))
    return measured.unionByName(silent)


def span_subtract(mix: DataFrame, stem: DataFrame, spans: DataFrame, bin_samples: int = 8192) -> DataFrame:
    """Mixture minus stem inside the spans ``[from_idx, to_idx)``, clipped to full scale everywhere."""
    union = merge_spans(spans.where("to_idx > from_idx").select(
        MEDIA, F.col("from_idx").alias("start_ms"), F.col("to_idx").alias("end_ms")))
    reach = bins(union, F.col("start_ms"), F.col("end_ms") - 1, bin_samples)
    both = mix.join(stem.withColumnRenamed("amplitude", "stem"), [MEDIA, "sample_idx"], "left").withColumn(
        "__bin", block_of("sample_idx", bin_samples))
    hit = both.join(reach, [MEDIA, "__bin"]).where("sample_idx >= start_ms AND sample_idx < end_ms").select(
        MEDIA, "sample_idx", F.lit(True).alias("inside"))
    value = F.col("amplitude") - F.when(F.col("inside"), F.coalesce("stem", F.lit(0.0))).otherwise(0.0)
    return both.join(hit, [MEDIA, "sample_idx"], "left").select(
        MEDIA, "sample_idx", F.least(F.greatest(value, F.lit(-1.0)), F.lit(1.0)).alias("amplitude"))


Separator = Callable[[np.ndarray, int], np.ndarray]


def separate_stems(windows: DataFrame, load_separator: Callable[[], Separator], rate: int) -> DataFrame:
    """Run a user's source separator over audio windows held as arrays, one per row.

    A window is one value of a few seconds; the separator is loaded once per task and fed Arrow batches.
    """
    def run(batches):
        separator = load_separator()
        for batch in batches:
            yield pd.DataFrame({
                MEDIA: batch[MEDIA], "window_id": batch["window_id"], "from_idx": batch["from_idx"],
                "stem": [np.asarray(separator(np.asarray(w, dtype="float64"), rate), dtype="float64")[:len(w)]
                         for w in batch["samples"]]})

    arrays = windows.select(MEDIA, "window_id", "from_idx", "samples").mapInPandas(
        run, f"{MEDIA} bigint, window_id bigint, from_idx bigint, stem array<double>")
    return arrays.select(MEDIA, "window_id", "from_idx", F.posexplode("stem").alias("i", "amplitude")).select(
        MEDIA, (F.col("from_idx") + F.col("i")).alias("sample_idx"), "amplitude")
