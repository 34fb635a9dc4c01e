"""The built-in detectors and the registry for a user's own."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanweave.functions.lexicon import Lexicon
from spanweave.functions.policy import Policy
from spanweave.operators import dialogue, visual
from spanweave.operators.intervals import merge_hits
from spanweave.operators.scan import row_rank, time_blocks, union_all
from spanweave.schema import DETECTED_COLUMNS
from spanweave.session import stage

MEDIA = "media_id"
Tables = Mapping[str, DataFrame]
#: Tables and options to detected findings (``DETECTED_COLUMNS`` plus ``seq``, an integer per media).
Detector = Callable[[Tables, Mapping[str, Any]], DataFrame]

_REGISTRY: dict[str, Detector] = {}


def register_detector(name: str, detector: Detector) -> None:
    """Make a detector available to ``run_detectors`` under its engine name."""
    _REGISTRY[name] = detector


def detector_names() -> list[str]:
    return sorted(_REGISTRY)


def run_detectors(names: Sequence[str], tables: Tables, options: Mapping[str, Any] | None = None) -> DataFrame:
    """Union of the named detectors' findings, as one table to reconcile.

    Arrival order runs detector by detector: ``seq`` interleaves their own orders without a global sort.
    """
    if not names:
        raise ValueError("name at least one detector")
    unknown = [n for n in names if n not in _REGISTRY]
    if unknown:
        raise ValueError(f"unknown detector {unknown}; installed: {detector_names()}")
    parts = [_REGISTRY[n](tables, options or {}).select(
        *DETECTED_COLUMNS, (F.col("seq") * len(names) + i).alias("seq")) for i, n in enumerate(names)]
    return union_all(parts)


def lexicon_of(options: Mapping[str, Any]) -> Lexicon:
    return Lexicon.of(bool(options.get("include_mild", False)), bool(options.get("include_blasphemy", False)),
                      options.get("extra_words", ()))


def _as_findings(merged: DataFrame, engine: str) -> DataFrame:
    return merged.select(
        MEDIA, "start_ms", "end_ms", F.lit("profanity").alias("category"), "confidence",
        F.lit(engine).alias("engine"), F.lit("mute").alias("action"), F.lit(None).cast("boolean").alias("approved"),
        F.concat(F.lit("["), F.col("word"), F.lit("] "), F.col("context")).alias("reasoning"),
        F.lit(None).cast("string").alias("engine_ref"), F.col("start_ms").alias("seq"))


def subtitle_findings(cues: DataFrame, lexicon: Lexicon, words: DataFrame | None = None,
                      whole_cue: bool = False) -> DataFrame:
    """Listed words in cues as mute findings. ``words`` is a transcript to take exact times from."""
    # Listed words are few; staged, they are found in one pass over the text instead of one per consumer.
    flagged = stage(dialogue.flagged_words(cues, lexicon))
    nearest = None
    if words is not None and not whole_cue:
        nearest = dialogue.cue_word_nearest(flagged, words, lexicon)
    timed = dialogue.resolve_word_timing(flagged, nearest, whole_cue)
    return _as_findings(merge_hits(dialogue.word_mutes(timed, whole_cue)), "subtitles")


def whisper_findings(words: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Listed words in a transcript as mute findings."""
    merged = merge_hits(stage(dialogue.speech_hits(words, lexicon)))
    return _as_findings(merged.withColumn("confidence", F.bround("confidence", 3)), "whisper")


def visual_findings(samples: DataFrame, shots: DataFrame, policy: Policy = Policy(), bridge: int = 2, pad: int = 1,
                    action: str = "skip") -> DataFrame:
    """Observed samples to scene findings. Observations are the stored layer; policy is applied here."""
    flagged = visual.worst_sample_per_shot(samples, policy)
    found = visual.scene_findings(visual.group_scenes(flagged, bridge), shots, pad, action)
    return found.withColumnRenamed("scene", "seq")


def numbered(findings: DataFrame) -> DataFrame:
    """A detector's own timeline: ids from 1 in start order (merged spans never share a start)."""
    return row_rank(findings, [MEDIA], ["start_ms"], time_blocks(), "id")


register_detector("subtitles", lambda t, o: subtitle_findings(
    t["cues"], lexicon_of(o), t.get("words") if o.get("precise_timing", True) else None, bool(o.get("whole_cue", False))))
register_detector("whisper", lambda t, o: whisper_findings(t["words"], lexicon_of(o)))
register_detector("vlm", lambda t, o: visual_findings(
    t["samples"], t["shots"],
    Policy(bool(o.get("flag_male_shirtless", False)), bool(o.get("flag_underwear", True)),
           bool(o.get("flag_any_kissing", False))),
    int(o.get("bridge_shots", 2)), int(o.get("pad_shots", 1)), o.get("action", "skip")))
register_detector("pureframe", lambda t, o: visual.plan_verdict_join(t["verdicts"], t["plan_shots"]))
