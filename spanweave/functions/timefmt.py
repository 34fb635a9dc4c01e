"""Timestamps, durations and padded windows as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def idiv(a: Column, b) -> Column:
    """Integer division of non-negative longs, without a detour through doubles."""
    return F.call_function("div", a, b if isinstance(b, Column) else F.lit(b))


def ts_to_ms(stamp: Column) -> Column:
    """``H:M:S,mmm`` (or ``.mmm``) to ms; anything else is null."""
    parts = F.split(F.trim(stamp), ":")
    rest = F.split(F.replace(F.get(parts, F.lit(2)), F.lit("."), F.lit(",")), ",")

    def number(array: Column, i: int) -> Column:
        return F.get(array, F.lit(i)).try_cast("bigint")

    value = (number(parts, 0) * 3600 + number(parts, 1) * 60 + number(rest, 0)) * 1000 + number(rest, 1)
    return F.when((F.size(parts) == 3) & (F.size(rest) == 2), value)


def ms_to_ts(ms: Column) -> Column:
    """``HH:MM:SS,mmm``; negatives show as zero."""
    t = F.greatest(ms, F.lit(0)).cast("bigint")
    return F.format_string("%02d:%02d:%02d,%03d", idiv(t, 3_600_000), idiv(t, 60_000) % 60,
                           idiv(t, 1000) % 60, t % 1000)


def fmt_hms(ms: Column) -> Column:
    """``H:MM:SS.mmm``."""
    t = F.greatest(F.floor(ms), F.lit(0)).cast("bigint")
    return F.format_string("%d:%02d:%02d.%03d", idiv(t, 3_600_000), idiv(t, 60_000) % 60,
                           idiv(t, 1000) % 60, t % 1000)


def fmt_clock(ms: Column) -> Column:
    """``MM:SS``, with an hour in front only when there is one."""
    t = idiv(ms.cast("bigint"), 1000)
    short = F.format_string("%02d:%02d", idiv(t, 60) % 60, t % 60)
    return F.when(t >= 3600, F.concat(idiv(t, 3600).cast("string"), F.lit(":"), short)).otherwise(short)


_LEADING_NUMBER = r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"


def parse_time(text: Column) -> Column:
    """A typed time (``H:MM:SS.mmm``, ``MM:SS`` or seconds) to rounded ms; unreadable is null."""
    parts = F.transform(
        F.split(F.trim(text), ":"),
        lambda p: F.regexp_extract(p, _LEADING_NUMBER, 1).try_cast("double"))
    first, second, third = (F.get(parts, F.lit(i)) for i in range(3))
    seconds = (F.when(F.size(parts) == 3, first * 3600 + second * 60 + third)
               .when(F.size(parts) == 2, first * 60 + second)
               .otherwise(first))
    bad = F.exists(parts, lambda p: p.isNull())
    return F.when(~bad, F.greatest(F.floor(seconds * 1000 + 0.5), F.lit(0)).cast("bigint"))


# Powers of two that add up to ten and to a hundred.
_DIGITS = {1: (8.0, 2.0), 2: (64.0, 32.0, 4.0)}


def scaled_round(x: Column, digits: int) -> Column:
    """``x`` times a power of ten, rounded half-even on the exact binary value of ``x``.

    Scaling by a power of two is exact, so two-sums give the product as a double plus its error; a plain
    product would already have rounded the tie away.
    """
    first, *rest = _DIGITS[digits]
    s, err = x * first, F.lit(0.0)
    for scale in rest:
        b = x * scale
        t = s + b
        bb = t - s
        err = err + ((s - (t - bb)) + (b - bb))
        s = t
    q = F.floor(s)
    d = s - q - 0.5
    up = (d > 0) | ((d == 0) & ((err > 0) | ((err == 0) & (q % 2 == 1))))
    return (q + F.when(up, 1).otherwise(0)).cast("bigint")


def fixed_two(x: Column) -> Column:
    """A non-negative number with two decimals, as sample keys are written."""
    hundredths = scaled_round(x, 2)
    return F.format_string("%d.%02d", idiv(hundredths, 100), hundredths % 100)


def fmt_duration(seconds: Column) -> Column:
    """``4.2s``, ``3m12s`` or ``1h04m``."""
    tenths = scaled_round(seconds, 1)
    whole = F.floor(seconds).cast("bigint")
    return (F.when(seconds < 60, F.format_string("%d.%ds", idiv(tenths, 10), tenths % 10))
            .when(whole < 3600, F.format_string("%dm%02ds", idiv(whole, 60), whole % 60))
            .otherwise(F.format_string("%dh%02dm", idiv(whole, 3600), idiv(whole % 3600, 60))))


def ms_to_ticks(ms: Column) -> Column:
    """Milliseconds to 100-nanosecond ticks."""
    return ms * 10_000


def clip_window(start: Column, end: Column, pad_ms: int = 15_000) -> dict[str, Column]:
    """The padded review window and the span's place inside it, measured from the clipped start."""
    clip_start = F.greatest(start - pad_ms, F.lit(0))
    lead = start - clip_start
    return {
        "clip_start_ms": clip_start,
        "clip_end_ms": end + pad_ms,
        "clip_length_ms": end - start + 2 * pad_ms,
        "span_from_ms": lead,
        "span_to_ms": lead + (end - start),
    }


def fix_inverted(start: Column, end: Column) -> tuple[Column, Column]:
    """Both ends at zero or later, in order."""
    a, b = F.greatest(start, F.lit(0)), F.greatest(end, F.lit(0))
    return F.least(a, b), F.greatest(a, b)


def parse_spans(text: Column) -> Column:
    """``"a-b,a-b"`` to an array of spans; malformed parts are dropped."""
    def one(part: Column) -> Column:
        # The first dash separates, so a second one makes the right side malformed.
        return F.struct(
            F.regexp_extract(part, r"^\s*([+]?\d+)\s*-", 1).try_cast("bigint").alias("start_ms"),
            F.regexp_extract(part, r"^[^-]*-\s*([+-]?\d+)\s*$", 1).try_cast("bigint").alias("end_ms"))

    spans = F.transform(F.split(F.coalesce(text, F.lit("")), ","), one)
    return F.filter(spans, lambda s: s["start_ms"].isNotNull() & s["end_ms"].isNotNull())


def progress_decile(fraction: Column) -> Column:
    """Progress rounded to four places, as a whole number of tenths."""
    return (F.bround(fraction, 4) * 10).cast("int")
