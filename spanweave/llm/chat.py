"""Dialogue turns as training windows: whole turns within a token budget, with limited history.

Prefix sums of the tokens of a dialogue's turns lay it out on a line that is cut every ``span`` tokens. Turns that
lie within one stretch make a window; a turn across a cut is a window of its own. So each window's place follows
from the sums alone and a dialogue of any length is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanweave.operators.scan import Running, running
from spanweave.session import stage

START, END = "<|im_start|>", "<|im_end|>"
#: A line feed inside a role, which ends a role otherwise. Escaped texts hold no such string.
ROLE_BREAK = "<|nl|>"
#: Turns of a dialogue that one task adds up at a time.
_BLOCK = 8192


def escape(text: Column) -> Column:
    """Text in which no control string can occur: every ``<|`` gets a tilde, those with tildes one more."""
    return F.regexp_replace(text, r"<(~*)\|", "<~$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<~(~*)\|", "<$1|")


def turn_tokens(text: Column) -> Column:
    """Measure of a turn's length: words, and signs other than white space; never less than tokens of the template."""
    return (F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[\p{L}\p{M}]+|\p{N}|[^\s\p{L}\p{M}\p{N}]")) + 4).cast("bigint")


def rendered(role: Column, text: Column) -> Column:
    safe_role = F.replace(escape(F.coalesce(role, F.lit(""))), F.lit("\n"), F.lit(ROLE_BREAK))
    return F.concat(F.lit(START), safe_role, F.lit("\n"), escape(F.coalesce(text, F.lit(""))), F.lit(END + "\n"))


def format_dialogues(turns: DataFrame, budget: int = 1024, history: int = 192, system: int = 256) -> DataFrame:
    """Windows of formatted dialogue with the places that carry loss.

    ``turns``: ``media_id``, ``cue_idx`` (order of the turns), ``role``, ``text``; other columns are left out. Turns are
    ordered by ``cue_idx`` (null first), then role, then text; equal rows are turns of their own. Null text and role
    count as empty; all rows without a media id are one dialogue.

    A first turn with the role ``system`` opens every window. New turns take up to ``budget - history - system``
    tokens; turns before them are repeated while they fit in ``history`` tokens in total, latest first. A turn is never
    cut: one longer than its window stands alone, without history, and may pass
    the budget, as may windows under a system turn of more than ``system`` tokens. Loss lies on the texts of ``assistant`` turns, in
    the one window that has them as new turns; repeated ones are masked. A dialogue of a system turn alone is one
    window.

    Result, one row per window: ``media_id``, ``window`` (ascending along the dialogue), ``formatted``, ``n_repeated``
    (turns in front that an earlier window or the system turn accounts for), ``n_turns`` (new ones), ``n_tokens``,
    ``loss``: array of (``start``, ``end``), code points of ``formatted``, in order.
    """
    if not 0 <= history <= budget - history - system:
        raise ValueError("history must fit in what the budget leaves for new turns")
    span = budget - history - system
    # Distinct first, with a number of copies, so that order is total; then one row per turn again.
    given = turns.select("media_id", F.col("cue_idx").cast("bigint").alias("cue_idx"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
                         F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    distinct = given.groupBy("media_id", "cue_idx", "role", "text").agg(F.count(F.lit(1)).alias("n"))
    each = distinct.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n")))).drop("n")
    at = F.coalesce("cue_idx", F.lit(-(1 << 62)))
    rows = each.withColumns({"at": at, "tokens": turn_tokens(F.col("text"))})
    sums = _summed(rows, ["at", "role", "text", "copy"])
    first = (F.col("place") == 0) & (F.col("role") == "system")
    placed = stage(sums.withColumn("is_system", first))  # five parts of a window are read from it
    stretch = F.expr(f"before div {span}")
    last = F.expr(f"(before + tokens - 1) div {span}")
    # Even numbers: turns within a stretch; odd ones: a turn across the cut behind it.
    window = F.when(stretch == last, stretch * 2).otherwise(stretch * 2 + 1)
    new = placed.where(~F.col("is_system")).withColumn("window", window)
    starts = new.groupBy("media_id", "window").agg(F.min("before").alias("opens"), F.sum("tokens").alias("own"))
    # A turn may be repeated by the windows that open within ``history`` tokens of it, and those are few.
    later = new.select("media_id", F.col("window").alias("from"), "place", "before", "tokens", "role", "text", F.explode(F.sequence(
        F.col("window") + 1, F.greatest(F.col("window") + 1, F.expr(f"2 * ((before + {history}) div {span}) + 1")))).alias("window"))
    repeated = (_join(later, starts.where(F.col("own") <= span), ["media_id", "window"])
                .where((F.col("opens") - F.col("before") <= history) & (F.col("before") + F.col("tokens") <= F.col("opens")))
                .select("media_id", "window", "place", "tokens", "role", "text", F.lit(False).alias("fresh")))
    system_turn = placed.where("is_system").select("media_id", "place", "tokens", "role", "text")
    opened = _join(starts.select("media_id", "window"), system_turn, ["media_id"]).select(
        "media_id", "window", "place", "tokens", "role", "text", F.lit(False).alias("fresh"))
    alone = _join(system_turn, starts.select("media_id").distinct(), ["media_id"], "left_anti").select(
        "media_id", F.lit(0).cast("bigint").alias("window"), "place", "tokens", "role", "text", F.lit(True).alias("fresh"))
    # The system turn counts as new in the first window of its dialogue.
    first_window = starts.groupBy("media_id").agg(F.min("window").alias("window")).withColumn("opening", F.lit(True))
    opened = _join(opened, first_window, ["media_id", "window"], "left").withColumn("fresh", F.coalesce("opening", F.lit(False))).drop("opening")
    fresh = new.select("media_id", "window", "place", "tokens", "role", "text", F.lit(True).alias("fresh"))
    parts = fresh.unionByName(repeated).unionByName(opened).unionByName(alone)
    return _windows(parts)


def _summed(rows: DataFrame, order: list[str]) -> DataFrame:
    """Tokens and turns before each turn of its dialogue. ``running`` joins on its key, which can't be null."""
    key = F.struct(F.col("media_id").isNotNull(), F.coalesce(F.col("media_id").cast("string"), F.lit("")))
    block = F.floor(F.col("at") / _BLOCK).cast("bigint")
    return running(rows.withColumn("key", key), ["key"], order, [("at", block)], before=Running("sum", F.col("tokens")),
                   place=Running("sum", F.lit(1).cast("bigint"))).drop("key", "at", "copy")


def _join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join that also matches null ids."""
    other = right.withColumnsRenamed({c: f"__{c}" for c in on})
    condition = F.lit(True)
    for c in on:
        condition = condition & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return left.join(other, condition, how).drop(*[f"__{c}" for c in on])


def _windows(parts: DataFrame) -> DataFrame:
    """One row per window from its turns. A window is bounded by the budget, or is one turn."""
    turn = F.struct("place", "fresh", "role", "tokens", rendered(F.col("role"), F.col("text")).alias("shown"),
                    (F.char_length(F.concat(F.lit(START), F.replace(escape(F.col("role")), F.lit("\n"), F.lit(ROLE_BREAK)))) + 1).alias("head"))
    held = parts.groupBy("media_id", "window").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    zero = F.struct(F.lit(0).cast("bigint").alias("at"), F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)").alias("loss"))

    def add(state, t):
        length = F.char_length(t["shown"]).cast("bigint")
        target = t["fresh"] & (t["role"] == "assistant") & (length > t["head"] + len(END) + 1)
        loss = F.struct((state["at"] + t["head"]).alias("start"), (state["at"] + length - (len(END) + 1)).alias("end"))
        return F.struct((state["at"] + length).alias("at"), F.when(target, F.concat(state["loss"], F.array(loss))).otherwise(state["loss"]).alias("loss"))

    return held.select(
        "media_id", "window", F.array_join(F.transform("turns", lambda t: t["shown"]), "").alias("formatted"),
        F.size(F.filter("turns", lambda t: ~t["fresh"])).cast("bigint").alias("n_repeated"),
        F.size(F.filter("turns", lambda t: t["fresh"])).cast("bigint").alias("n_turns"),
        F.aggregate(F.transform("turns", lambda t: t["tokens"]), F.lit(0).cast("bigint"), lambda a, b: a + b).alias("n_tokens"),
        F.aggregate("turns", zero, add, lambda s: s["loss"]).alias("loss"))


def read_turns(windows: DataFrame) -> DataFrame:
    """The dialogues back from their windows: ``media_id``, ``turns`` (array of (``role``, ``text``) in order).

    The inverse of ``format_dialogues``: the new turns of all windows of a dialogue, in one row.
    """
    shown = F.slice(F.split("formatted", START.replace("|", r"\|"), -1), 2 + F.col("n_repeated").cast("int"), F.col("n_turns").cast("int"))
    pieces = windows.select("media_id", "window", shown.alias("shown"))

    def turn(s):
        cut = F.locate("\n", s)
        text = F.substring(s, cut + 1, F.char_length(s) - cut - (len(END) + 1))
        return F.struct(unescape(F.replace(F.substring(s, F.lit(1), cut - 1), F.lit(ROLE_BREAK), F.lit("\n"))).alias("role"), unescape(text).alias("text"))

    by_window = pieces.select("media_id", "window", F.transform("shown", turn).alias("turns"))
    return by_window.groupBy("media_id").agg(F.array_sort(F.collect_list(F.struct("window", "turns"))).alias("w")).select(
        "media_id", F.flatten(F.transform("w", lambda w: w["turns"])).alias("turns"))
