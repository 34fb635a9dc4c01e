"""Decisions and review states."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The order in which the work-list shows states, and job states by activity.
STATUS_ORDER = {"ready": 0, "in_progress": 1, "reviewed": 2, "unanalyzed": 3}
ACTIVE_RANK = {"running": 0, "rendering": 1, "queued": 2}
TERMINAL = ("completed", "failed", "cancelled", "rendered")
FINISHED = ("completed", "rendered")
DETECTORS = ("pureframe", "whisper", "vlm", "subtitles")


def decision_state(approved: Column) -> Column:
    return F.when(approved.isNull(), "undecided").when(approved, "cut").otherwise("leave")


def review_state(analyzed: Column, count: Column, undecided: Column) -> Column:
    return (F.when(~analyzed, "unanalyzed").when(undecided <= 0, "reviewed")
            .when(undecided == count, "ready").otherwise("in_progress"))


def is_approved(approved: Column) -> Column:
    """The gate for acting: approved, and nothing else."""
    return approved.eqNullSafe(F.lit(True))


def not_rejected(approved: Column) -> Column:
    """The looser gate: approved or still undecided."""
    return ~approved.eqNullSafe(F.lit(False))


def is_playback_skip(action: Column, start: Column, end: Column) -> Column:
    """A finding a player can act on by itself."""
    return F.coalesce(F.lower(action) == "skip", F.lit(False)) & (end > start)
