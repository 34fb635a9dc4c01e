"""Interval algebra on the media clock: union, complement, coverage, overlap, nearest, time maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanweave.operators.ranges import best_holder, held_pairs
from spanweave.operators.scan import BLOCK_MS, Running, asof, block_of, running, time_blocks, union_all

MEDIA = "media_id"


def _starts(spans: DataFrame, keys: list[str]) -> DataFrame:
    """One row per distinct start with its furthest end: enough for any union, and free of copies."""
    return spans.groupBy(*keys, "start_ms").agg(F.max("end_ms").alias("end_ms"))


def islands(spans: DataFrame, keys=(MEDIA,), gap_ms: int = 0,
            blocks: list[tuple[str, Column]] | None = None) -> DataFrame:
    """Distinct starts with the start of the island they belong to (inclusive gap).

    Breaks are found inside blocks first. What a block inherits is the furthest end before it, which can
    only cancel its earliest breaks, so the last break of a block stands or falls as one value: a single
    pass over the block summaries settles both the reach and the open island.
    """
    keys, (_, block) = list(keys), (blocks or time_blocks())[-1]
    start, end = F.col("start_ms"), F.col("end_ms")
    inside = Window.partitionBy(*keys, "__b").orderBy("start_ms")
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    local = _starts(spans, keys).withColumn("__b", block).withColumn("__reach", F.max(end).over(before))
    local = local.withColumn("__opens", F.when(
        F.col("__reach").isNull() | (start - F.col("__reach") > gap_ms), start))

    earlier = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    facts = local.groupBy(*keys, "__b").agg(F.max(end).alias("m"), F.max("__opens").alias("o"))
    facts = facts.withColumn("__carry", F.max("m").over(earlier))
    stands = F.when(F.col("__carry").isNull() | (F.col("o") - F.col("__carry") > gap_ms), F.col("o"))
    facts = facts.withColumn("__open", F.max(stands).over(earlier)).select(*keys, "__b", "__carry", "__open")

    opens = F.when(F.col("__carry").isNull() | (F.col("__opens") - F.col("__carry") > gap_ms), F.col("__opens"))
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    return local.join(facts, [*keys, "__b"]).select(
        *keys, "start_ms", "end_ms", F.coalesce(F.max(opens).over(upto), F.col("__open")).alias("island_ms"))


def merge_spans(spans: DataFrame, keys=(MEDIA,), gap_ms: int = 0) -> DataFrame:
    """Union of overlapping or touching spans."""
    return (islands(spans, keys, gap_ms).groupBy(*keys, F.col("island_ms").alias("start_ms"))
            .agg(F.max("end_ms").alias("end_ms")))


def merge_hits(hits: DataFrame, keys=(MEDIA,), gap_ms: int = 750, seq: str = "seq") -> DataFrame:
    """Coalesce word hits into bursts.

    Words are joined in start order, confidence is the lowest, and a context is appended only if the text
    so far does not hold it. ``seq`` breaks ties between equal starts. The label names every word of a
    burst, so a burst is one value by definition; the media around it is not, and neither are its contexts, of which
    only first occurrences are gathered.
    """
    return named_bursts(merge_bursts(hit_bursts(hits, seq), keys, gap_ms), keys)


def hit_bursts(hits: DataFrame, seq: str = "seq") -> DataFrame:
    """Each hit as a burst of its own: ``words`` and ``contexts`` beside the columns that are not of the hit."""
    at = [F.col("start_ms"), F.col(seq).alias("seq"), F.col("word")]
    context = F.coalesce("context", F.lit("")).alias("context")
    return hits.withColumns({"words": F.array(F.struct(*at)), "contexts": F.array(F.struct(*at, context))}).drop(*{seq, "word", "context"})


def merge_bursts(bursts: DataFrame, keys=(MEDIA,), gap_ms: int = 750) -> DataFrame:
    """Bursts of bursts: ``start_ms``, ``end_ms``, the lowest ``confidence``, the ``words`` in order and the distinct
    ``contexts`` in the order of their first occurrence.

    Merging what has been merged gives what merging all at once does, in whatever order and grouping. Contexts are reduced to one
    per burst and text before any list is made, so a burst of many hits holds each of its contexts once.
    """
    keys, burst = list(keys), [*keys, "island_ms"]
    where = islands(bursts, keys, gap_ms).select(*keys, "start_ms", "island_ms")
    each = bursts.join(where, [*keys, "start_ms"]).select(*burst, "end_ms", "confidence", "words", F.posexplode("contexts").alias("i", "c"))
    # The words go along with the first context alone.
    words = F.flatten(F.collect_list(F.when(F.col("i") == 0, F.col("words"))))
    once = each.groupBy(*burst, F.col("c.context").alias("context")).agg(
        F.max("end_ms").alias("end_ms"), F.min("confidence").alias("confidence"), words.alias("words"), F.min(F.struct("c.start_ms", "c.seq", "c.word")).alias("at"))
    first = F.struct("at.start_ms", "at.seq", "at.word", "context")
    return once.groupBy(*keys, F.col("island_ms").alias("start_ms")).agg(
        F.max("end_ms").alias("end_ms"), F.min("confidence").alias("confidence"),
        F.array_sort(F.flatten(F.collect_list("words"))).alias("words"), F.array_sort(F.collect_list(first)).alias("contexts"))


def named_bursts(bursts: DataFrame, keys=(MEDIA,)) -> DataFrame:
    """Bursts with the words, the confidence and the folded context of their hits."""
    return bursts.select(*keys, "start_ms", "end_ms", *burst_label())


def burst_label() -> list[Column]:
    """Words, confidence and folded context of a burst."""
    def append(text: Column, item: Column) -> Column:
        return F.when(F.contains(text, item), text).otherwise(F.concat(text, F.lit(" … "), item))

    # A context met before is already in the text, so only first occurrences can add anything.
    contexts = F.transform("contexts", lambda c: c["context"])
    later = F.slice(contexts, F.lit(2), F.greatest(F.size(contexts) - 1, F.lit(0)))
    return [F.array_join(F.transform("words", lambda w: w["word"]), ", ").alias("word"), F.col("confidence"),
            F.aggregate(later, F.get(contexts, F.lit(0)), append).alias("context")]


def keep_intervals(skips: DataFrame, media: DataFrame, sliver_ms: int | None = None) -> DataFrame:
    """What remains of ``[0, duration_ms]`` per media once the skips are gone.

    ``sliver_ms`` keeps that much of a media that would otherwise vanish, as previews need.
    """
    starts = _starts(skips.join(media, MEDIA, "left_semi"), [MEDIA])
    seen = running(starts, [MEDIA], ["start_ms"], time_blocks(), reach=Running("max", F.col("end_ms")))
    floor = F.greatest(F.coalesce(F.col("reach"), F.lit(0)), F.lit(0)).cast("bigint")
    gaps = seen.where(F.col("start_ms") > floor).select(
        MEDIA, floor.alias("keep_start"), F.col("start_ms").alias("keep_end"))
    last = skips.groupBy(MEDIA).agg(F.max("end_ms").alias("reach"))
    tails = media.join(last, MEDIA, "left").where(floor < F.col("duration_ms")).select(
        MEDIA, floor.alias("keep_start"), F.col("duration_ms").alias("keep_end"))
    keeps = gaps.unionByName(tails)
    if sliver_ms is None:
        return keeps
    empty = media.join(keeps, MEDIA, "left_anti").select(
        MEDIA, F.lit(0).cast("bigint").alias("keep_start"),
        F.least(F.lit(sliver_ms), F.col("duration_ms")).cast("bigint").alias("keep_end"))
    return keeps.unionByName(empty)


def time_map(keeps: DataFrame) -> DataFrame:
    """Kept spans with where each begins in the shortened output."""
    out = running(keeps.withColumn("len_ms", F.col("keep_end") - F.col("keep_start")), [MEDIA],
                  ["keep_start"], time_blocks("keep_start"), clip_ms=Running("sum", F.col("len_ms")))
    return out.select(MEDIA, F.col("keep_start").alias("rel_ms"), F.col("clip_ms").cast("bigint"), "len_ms")


def map_output_to_source(points: DataFrame, mapping: DataFrame, at: str = "out_ms") -> DataFrame:
    """Output time to source time: the first keep that reaches it, else the end of the last keep.

    A keep reaches one ms past its end, so the lookup is for the last keep ending before ``t - 1``.
    """
    ends = mapping.withColumn("reach_ms", F.col("clip_ms") + F.col("len_ms"))
    # Keep k serves t unless t > reach_k + 1; its successor begins, in output time, where k ends.
    nxt = asof(points.withColumn("__p", F.col(at) - 1), ends, [MEDIA], "__p", "reach_ms",
               ["rel_ms", "len_ms"], inclusive=False).withColumnsRenamed(
                   {"rel_ms": "prev_rel", "len_ms": "prev_len"})
    first = mapping.where("clip_ms = 0").select(MEDIA, F.col("rel_ms").alias("first_rel"))
    chain = running(ends, [MEDIA], ["rel_ms"], time_blocks("rel_ms"),
                    prev_rel=Running("last", F.col("rel_ms"))).where("prev_rel is not null").select(
                        MEDIA, "prev_rel", F.col("rel_ms").alias("next_rel"), F.col("clip_ms").alias("next_clip"))
    placed = (points.withColumn("__p", F.col(at) - 1).join(nxt, [MEDIA, "__p"], "left")
              .join(first, MEDIA, "left").join(chain, [MEDIA, "prev_rel"], "left"))
    source = (F.when(F.col("first_rel").isNull(), F.col(at))
              .when(F.col("prev_rel").isNull(), F.col("first_rel") + F.greatest(F.col(at), F.lit(0)))
              .when(F.col("next_rel").isNotNull(),
                    F.col("next_rel") + F.greatest(F.col(at) - F.col("next_clip"), F.lit(0)))
              .otherwise(F.col("prev_rel") + F.col("prev_len")))
    return placed.select(*points.columns, source.cast("bigint").alias("source_ms"))


def window_overlap(findings: DataFrame, windows: DataFrame, min_ms: int = 20) -> DataFrame:
    """Findings overlapping each window, clipped and window-relative; slivers are dropped.

    The result is the overlapping pairs themselves, and no other pairs are formed: either a finding starts inside the
    window, or the window starts inside the finding, and both are look-ups of points in aligned ranges.
    """
    spans = findings.where("end_ms >= start_ms")
    begun = held_pairs(windows, spans, [MEDIA], F.col("win_start"), F.col("win_end"), F.col("start_ms"))
    open_at = held_pairs(spans, windows, [MEDIA], F.col("start_ms") + 1, F.col("end_ms"), F.col("win_start"))
    pairs = begun.unionByName(open_at).where(F.col("end_ms") > F.col("win_start"))
    clipped = pairs.withColumns({
        "rel_start": F.greatest(F.col("start_ms") - F.col("win_start"), F.lit(0)),
        "rel_end": F.least(F.col("end_ms"), F.col("win_end")) - F.col("win_start")})
    return clipped.where(F.col("rel_end") - F.col("rel_start") > min_ms)


def time_bucket_split(findings: DataFrame, windows: DataFrame) -> DataFrame:
    """What applies in each window, by action, on the media clock and clipped to the window.

    Approved findings apply, and so does the finding a window was opened for (``selected_id``). One row
    per span, so that a busy window needs no list held in one task.
    """
    pairs = window_overlap(findings, windows, min_ms=-1).where(
        (F.coalesce(F.col("approved"), F.lit(False)) | (F.col("id") == F.col("selected_id")))
        & F.col("action").isin("skip", "mute", "voice", "blur"))
    kind = (F.when(F.col("action") == "skip", "cuts").when(F.col("action") == "mute", "mutes")
            .when(F.col("action") == "voice", "voices").otherwise("blurs"))
    return pairs.select("window_id", MEDIA, "id", kind.alias("plan"),
                        F.greatest("start_ms", "win_start").alias("from_ms"),
                        F.least("end_ms", "win_end").alias("to_ms"))


def coverage_ms(findings: DataFrame, windows: DataFrame) -> DataFrame:
    """Regions set to cut in each window and the time their union removes, overhang included.

    No window meets its findings pair by pair. One scan forward over starts, ends and window edges carries how many cuts
    have begun and ended, how far they reach and how long their union is; one backward over ends carries the earliest start.
    """
    cuts = findings.where(F.col("approved").eqNullSafe(F.lit(True)) & (F.col("end_ms") >= F.col("start_ms")))
    n, none = F.count(F.lit(1)), F.lit(None).cast("bigint")
    reached = running(cuts.groupBy(MEDIA, "start_ms").agg(n.alias("n"), F.max("end_ms").alias("end_ms")), [MEDIA], ["start_ms"], time_blocks(),
                      reach=Running("max", F.col("end_ms")))
    grows = F.greatest(F.col("end_ms") - F.greatest("start_ms", "reach"), F.lit(0))
    ends = cuts.groupBy(MEDIA, "end_ms").agg(n.alias("n"), F.min("start_ms").alias("start_ms"))

    def events(at: Column, side: int, **given: Column) -> list[Column]:
        return [F.col(MEDIA), at.alias("t"), F.lit(side).alias("side"), *[given.get(c, none).cast("bigint").alias(c) for c in ("begun", "done", "end_ms", "grown")]]

    # At one instant what ends is gone and what starts has not begun, as windows are open at both sides.
    edges = windows.select(MEDIA, F.explode(F.array("win_start", "win_end")).alias("t")).distinct()
    ahead = union_all([ends.select(*events(F.col("end_ms"), 0, done=F.col("n"))), edges.select(*events(F.col("t"), 1)),
                       reached.select(*events(F.col("start_ms"), 2, begun=F.col("n"), end_ms=F.col("end_ms"), grown=grows))])
    seen = running(ahead, [MEDIA], ["t", "side"], [("t", block_of("t", BLOCK_MS))], n_begun=Running("sum", F.col("begun")), n_done=Running("sum", F.col("done")),
                   furthest=Running("max", F.col("end_ms")), length=Running("sum", F.col("grown"))).where("side = 1")
    # All of the union beyond an edge belongs to cuts that have begun before it.
    covered = F.col("length") - F.greatest(F.col("furthest") - F.col("t"), F.lit(0))
    seen = seen.select(MEDIA, "t", "n_begun", "n_done", "furthest", F.coalesce(covered, F.lit(0)).alias("covered"))

    back = union_all([ends.select(MEDIA, (-F.col("end_ms")).alias("back"), F.lit(0).alias("side"), "start_ms"),
                      windows.select(MEDIA, (-F.col("win_start")).alias("back")).distinct().select(MEDIA, "back", F.lit(-1).alias("side"), none.alias("start_ms"))])
    earliest = running(back, [MEDIA], ["back", "side"], [("back", block_of("back", BLOCK_MS))], earliest=Running("min", F.col("start_ms"))).where(
        "side = -1").select(MEDIA, (-F.col("back")).alias("win_start"), "earliest")

    at_start = seen.select(MEDIA, F.col("t").alias("win_start"), "n_done", F.col("covered").alias("u0"))
    at_end = seen.select(MEDIA, F.col("t").alias("win_end"), "n_begun", "furthest", F.col("covered").alias("u1"))
    joined = windows.join(at_start.join(earliest, [MEDIA, "win_start"]), [MEDIA, "win_start"], "left").join(at_end, [MEDIA, "win_end"], "left")
    over_left = F.greatest(F.col("win_start") - F.coalesce("earliest", "win_start"), F.lit(0))
    over_right = F.greatest(F.coalesce("furthest", "win_end") - F.col("win_end"), F.lit(0))
    return joined.select("window_id", MEDIA, F.coalesce(F.col("n_begun") - F.col("n_done"), F.lit(0)).cast("bigint").alias("regions"),
                         F.coalesce(F.col("u1") - F.col("u0") + over_left + over_right, F.lit(0)).cast("bigint").alias("removed_ms"))


def containing_shortest(findings: DataFrame, points: DataFrame) -> DataFrame:
    """For each distinct ``(media, t_ms)`` the shortest finding holding it, if any, however many overlap there."""
    best = F.struct((F.col("end_ms") - F.col("start_ms")).alias("len"), "start_ms", "id")
    return best_holder(findings.where("end_ms >= start_ms"), points, [MEDIA], F.col("start_ms"), F.col("end_ms") + 1, "t_ms", best)


def nearest_finding(findings: DataFrame, points: DataFrame) -> DataFrame:
    """Per playhead: the shortest finding containing it, else the one with the nearest edge."""
    inside = containing_shortest(findings, points).select(MEDIA, "t_ms", F.col("best.id").alias("inside_id"))
    ends = findings.groupBy(MEDIA, "end_ms").agg(F.min(F.struct("start_ms", "id")).alias("e"))
    starts = findings.groupBy(MEDIA, (-F.col("start_ms")).alias("back_ms")).agg(F.min("id").alias("s"))
    turned = points.withColumn("__back", -F.col("t_ms"))
    before = asof(points, ends.withColumn("e_end", F.col("end_ms")), [MEDIA], "t_ms", "end_ms", ["e", "e_end"])
    after = asof(turned, starts.withColumn("s_back", F.col("back_ms")), [MEDIA], "__back", "back_ms",
                 ["s", "s_back"]).withColumn("t_ms", -F.col("__back")).drop("__back")
    found = (points.join(inside, [MEDIA, "t_ms"], "left").join(before, [MEDIA, "t_ms"], "left")
             .join(after, [MEDIA, "t_ms"], "left"))
    to_end, to_start = F.col("t_ms") - F.col("e_end"), -F.col("s_back") - F.col("t_ms")
    # On equal distance the earlier start wins, which is the finding that has already ended.
    edge = F.when(to_end.isNull() | (to_start < to_end), F.col("s")).otherwise(F.col("e.id"))
    return found.select(*points.columns, F.coalesce("inside_id", edge).alias("finding_id"))

