"""Weekly analysis windows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LAST_MINUTE = 1439


@dataclass(frozen=True)
class DayWindow:
    """Minutes since local midnight; a start after the end runs into the next morning."""

    enabled: bool = False
    start_min: int = 0
    end_min: int = 0


@dataclass(frozen=True)
class Schedule:
    """Seven days from Monday. When not enabled, every instant is allowed."""

    enabled: bool
    days: tuple[DayWindow, ...]
    tz: str = ""

    @staticmethod
    def of(enabled: bool, days: Sequence[DayWindow], tz: str = "") -> "Schedule":
        """Exactly seven days, minutes in range, an unknown zone dropped."""
        week = (list(days) + [DayWindow()] * 7)[:7]

        def clamp(minute: int) -> int:
            return max(0, min(LAST_MINUTE, int(minute)))

        return Schedule(bool(enabled), tuple(
            DayWindow(bool(d.enabled), clamp(d.start_min), clamp(d.end_min)) for d in week), valid_zone(tz))

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(
            [(i, d.enabled, d.start_min, d.end_min) for i, d in enumerate(self.days)],
            "dow INT, enabled BOOLEAN, start_min INT, end_min INT")


def valid_zone(name: str) -> str:
    name = (name or "").strip()
    try:
        return ZoneInfo(name).key if name else ""
    except Exception:  # unknown names come back as several exception types
        return ""


def local_time(ts_utc: Column, tz: str) -> Column:
    """UTC instant (without zone) to wall clock in ``tz``."""
    plain = ts_utc.cast("timestamp_ntz")
    return F.convert_timezone(F.lit("UTC"), F.lit(tz), plain) if tz else plain


def schedule_allowed(ts_utc: Column, schedule: Schedule) -> Column:
    """Whether an instant falls in today's window, or in the rest of one that began yesterday."""
    if not schedule.enabled:
        return F.lit(True)
    local = local_time(ts_utc, schedule.tz)
    minute = F.hour(local) * 60 + F.minute(local)
    today = F.weekday(local)
    yesterday = (today + 6) % 7
    week = F.array(*[
        F.struct(F.lit(d.enabled).alias("enabled"), F.lit(d.start_min).alias("a"), F.lit(d.end_min).alias("b"))
        for d in schedule.days])
    day, before = F.get(week, today), F.get(week, yesterday)
    in_today = day["enabled"] & (
        (day["a"] == day["b"])
        | ((day["a"] < day["b"]) & (minute >= day["a"]) & (minute < day["b"]))
        | ((day["a"] > day["b"]) & (minute >= day["a"])))
    spill = before["enabled"] & (before["a"] > before["b"]) & (minute < before["b"])
    return in_today | spill


def schedule_normalize(days: DataFrame) -> DataFrame:
    """Day rows to exactly seven, clamped; missing days are off. At most seven rows leave."""
    spine = days.sparkSession.range(7).select(F.col("id").cast("int").alias("dow"))
    kept = days.where(F.col("dow").between(0, 6)).groupBy("dow").agg(
        F.min(F.struct("enabled", "start_min", "end_min")).alias("d"))

    def minute(name: str) -> Column:
        return F.least(F.greatest(F.coalesce(F.col("d")[name], F.lit(0)), F.lit(0)), F.lit(LAST_MINUTE))

    return spine.join(kept, "dow", "left").select(
        "dow", F.coalesce(F.col("d.enabled"), F.lit(False)).alias("enabled"),
        minute("start_min").cast("int").alias("start_min"), minute("end_min").cast("int").alias("end_min"))
