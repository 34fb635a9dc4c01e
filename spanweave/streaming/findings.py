"""Bursts, incremental reconciliation and resumable scoring on streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanweave.operators.intervals import hit_bursts, merge_bursts, named_bursts
from spanweave.operators.reconcile import high_water, merge_reanalysis
from spanweave.operators.visual import Scorer, sample_key, score_samples
from spanweave.schema import FINDING_COLUMNS
from spanweave.streaming.state import KeyedLog, TieredRuns, run_available

MEDIA = "media_id"


def stream_merge_hits(hits: DataFrame, path: str, checkpoint: str, gap_ms: int = 750) -> TieredRuns:
    """Bursts of all hits that have arrived, whatever the order of arrival.

    The media clock starts anew with each film, so it is no event time and carries no watermark. An epoch merges its own
    hits alone and appends the bursts, so it costs what arrives, whatever has arrived before. Since bursts of bursts are the
    bursts of their hits, runs are compacted in tiers and ``latest`` merges the few that stand.
    """
    runs = TieredRuns(hits.sparkSession, path, lambda bursts: merge_bursts(bursts, gap_ms=gap_ms), lambda bursts: named_bursts(merge_bursts(bursts, gap_ms=gap_ms)))
    run_available(hits, lambda batch, epoch: runs.write(epoch, hit_bursts(batch.select(MEDIA, "start_ms", "end_ms", "word", "confidence", "context", "seq"))), checkpoint)
    return runs


def stream_incremental_reanalysis(fresh: DataFrame, prior: DataFrame, path: str, checkpoint: str,
                                  floors: DataFrame | None = None) -> KeyedLog:
    """Reconcile arriving detector output with the findings table, rewriting only the media it touches.

    A micro-batch replaces, per media, the engines it carries. Returns the log whose latest rows, with
    ``prior`` for media never touched, are the table. The next free ids are a log of their own beside it, so no id
    is given out twice, also if the finding that had it is gone.
    """
    log = KeyedLog(fresh.sparkSession, path, [MEDIA])
    ids = KeyedLog(fresh.sparkSession, f"{path}-ids", [MEDIA])

    def each(batch: DataFrame, epoch: int) -> None:
        touched = batch.select(MEDIA).distinct()
        known, marks = prior.join(touched, MEDIA, "left_semi"), floors
        earlier = log.before(epoch)
        if earlier is not None:
            done = earlier.select(MEDIA).distinct()
            known = known.join(done, MEDIA, "left_anti").select(FINDING_COLUMNS).unionByName(
                earlier.join(touched, MEDIA, "left_semi").select(FINDING_COLUMNS))
        given = ids.before(epoch)
        if given is not None:
            marks = given if marks is None else marks.select(MEDIA, "next_segment_id").unionByName(given)
        # What the table held counts too, though this run may replace it.
        marks = high_water(known, None if marks is None else marks.join(touched, MEDIA, "left_semi"))
        ran = batch.select(MEDIA, "engine").distinct()
        log.write(epoch, merge_reanalysis(known, batch, ran, marks))
        ids.write(epoch, high_water(log.at(epoch), marks))

    run_available(fresh, each, checkpoint)
    return log


def stream_scores(samples: DataFrame, load_scorer: Callable[[], Scorer], base: str, model: str, digest: str) -> str:
    """Score arriving samples once per model and prompt; a restart goes on where the last run stopped.

    The checkpoint belongs to (model, digest), so another model or prompt starts over beside it. The file
    sink commits each batch exactly once. Returns the folder of answers.
    """
    home = f"{base}/{model}-{digest}"
    keyed = samples.withColumn("sample_key", sample_key(F.col("shot_index"), F.col("at_ms") / 1000))
    query = (score_samples(keyed, load_scorer)
             .withColumns({"model": F.lit(model), "digest": F.lit(digest)})
             .writeStream.format("parquet").option("path", f"{home}/answers").option("checkpointLocation", f"{home}/checkpoint")
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return f"{home}/answers"
