"""Fresh detector output against human decisions: ids, carry-over, edits, merges and splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanweave.functions.policy import merge_severity
from spanweave.functions.text import finding_type
from spanweave.functions.timefmt import fix_inverted
from spanweave.operators.ranges import best_holder
from spanweave.operators.scan import BLOCK_MS, block_of, id_blocks, row_rank, running, Running
from spanweave.schema import FINDING_COLUMNS

MEDIA = "media_id"
MANUAL = "manual"


def next_ids(findings: DataFrame, floors: DataFrame | None = None) -> DataFrame:
    """Next free id per media: above every id in use and never below the high-water mark."""
    used = findings.groupBy(MEDIA).agg(F.max("id").alias("top"))
    if floors is None:
        return used.select(MEDIA, (F.col("top") + 1).alias("next_id"))
    marks = floors.groupBy(MEDIA).agg(F.max("next_segment_id").alias("next_segment_id"))  # one per media, whatever comes
    return marks.join(used, MEDIA, "full").select(
        MEDIA, F.greatest(F.coalesce("top", F.lit(0)) + 1, F.coalesce("next_segment_id", F.lit(0))).alias("next_id"))


def assign_ids(fresh: DataFrame, kept: DataFrame, floors: DataFrame | None = None, seq: str = "seq") -> DataFrame:
    """Ids for new findings, in arrival order. ``seq`` is an integer, unique within a media."""
    ranked = row_rank(fresh, [MEDIA], [seq], id_blocks(seq), "__n")
    free = next_ids(kept, floors)
    return ranked.join(free, MEDIA, "left").withColumn(
        "id", F.coalesce("next_id", F.lit(1)) + F.col("__n") - 1).drop("__n", "next_id", seq)


def prior_decisions(prior: DataFrame) -> DataFrame:
    """Last decision per (media, engine, reference, category); needs a reference and a decision."""
    return (prior.where(F.col("engine_ref").isNotNull() & F.col("approved").isNotNull())
            .groupBy(MEDIA, "engine", "engine_ref", "category")
            .agg(F.max_by("approved", F.struct("start_ms", "id")).alias("prior_approved")))


def carry_decisions(fresh: DataFrame, prior: DataFrame) -> DataFrame:
    """Fresh findings take over the decision on the same detection."""
    keys = [MEDIA, "engine", "engine_ref", "category"]
    return fresh.join(prior_decisions(prior), keys, "left").withColumn(
        "approved", F.coalesce("prior_approved", "approved")).drop("prior_approved").select(*fresh.columns)


def merge_reanalysis(prior: DataFrame, fresh: DataFrame, replacing: Sequence[str] | DataFrame,
                     floors: DataFrame | None = None, seq: str = "seq") -> DataFrame:
    """Prior findings of engines that did not run, all manual ones, and the fresh ones with new ids.

    ``replacing`` names the engines that ran, for every media or as a ``(media_id, engine)`` table.
    """
    if isinstance(replacing, DataFrame):
        gone = replacing.where(F.col("engine") != MANUAL).select(MEDIA, "engine").distinct()
        kept = prior.join(gone, [MEDIA, "engine"], "left_anti")
    else:
        kept = prior.where(~F.col("engine").isin(list(replacing)) | (F.col("engine") == MANUAL))
    kept = kept.select(FINDING_COLUMNS)
    carried = carry_decisions(fresh, prior)
    return kept.unionByName(assign_ids(carried, kept, floors, seq).select(FINDING_COLUMNS))


def high_water(findings: DataFrame, floors: DataFrame | None = None) -> DataFrame:
    """Header row per media for the next run."""
    return next_ids(findings, floors).withColumnRenamed("next_id", "next_segment_id")


def skip_done_engines(media: DataFrame, engines: Sequence[str], prior: DataFrame, force: bool = False) -> DataFrame:
    """The (media, engine) runs still to do."""
    wanted = media.select(MEDIA, F.explode(F.array(*[F.lit(e) for e in engines])).alias("engine"))
    return wanted if force else wanted.join(prior.select(MEDIA, "engine"), [MEDIA, "engine"], "left_anti")


#: Editable fields; a null is a value for some and no change for the others.
EDITABLE = {"approved": True, "start_ms": False, "end_ms": False, "action": False, "reasoning": True,
            "category": False}


#: Bits of ``seq`` by which edits of a finding are reduced at a time; that many edits at most are held as a list.
_EDIT_BITS = 16


def _moves(edits: DataFrame) -> DataFrame:
    """What all span edits of a finding do together, in the order of ``seq``, as one move per ``(media, id)``.

    An edit sets one end or both and puts the span in order, so from then on each end is one of the old ends, or a constant,
    held between two bounds. Such moves compose into moves of the same form, so runs of edits are reduced level by level and no
    finding needs a list of its edits. Columns: ``source`` (0 from start, 1 from end), ``low_a``, ``high_a``, ``low_b``, ``high_b``.
    """
    start, end = F.col("new_start"), F.col("new_end")
    none, low = F.lit(None).cast("bigint"), F.lit(-(1 << 63)).cast("bigint")
    high = F.lit((1 << 63) - 1).cast("bigint")

    def move(source: Column, *bounds: Column) -> Column:
        return F.struct(source.alias("source"), *[x.cast("bigint").alias(n) for x, n in zip(bounds, ("low_a", "high_a", "low_b", "high_b"))])

    least, most = F.least(start, end), F.greatest(start, end)
    one = (F.when(start.isNotNull() & end.isNotNull(), move(F.lit(0), least, least, most, most))
           .when(start.isNotNull(), move(F.lit(1), low, start, start, high)).otherwise(move(F.lit(0), low, end, end, high)))

    def held(x: Column, lo: Column, hi: Column) -> Column:
        return F.greatest(lo, F.least(x, hi))

    def then(m: Column, nxt: Column) -> Column:
        # The next move starts from one of this one's ends; its bounds close in on that end's own.
        lo, hi = F.when(nxt["source"] == 0, m["low_a"]).otherwise(m["low_b"]), F.when(nxt["source"] == 0, m["high_a"]).otherwise(m["high_b"])
        bounds = [held(x, nxt[f"low_{e}"], nxt[f"high_{e}"]) for e in "ab" for x in (lo, hi)]
        return move(m["source"], *bounds)

    # Of equal edits at one place in the order, those after the second change nothing.
    level = edits.where(start.isNotNull() | end.isNotNull()).groupBy(MEDIA, "id", F.col("seq").cast("bigint").alias("at"), "new_start", "new_end").agg(
        F.count(F.lit(1)).alias("n")).withColumn("again", F.explode(F.sequence(F.lit(1), F.least("n", F.lit(2))))).select(
            MEDIA, "id", "at", F.struct(start.alias("s"), end.alias("e"), "again").alias("tie"), one.alias("move"))
    for _ in range(64 // _EDIT_BITS):
        level = level.groupBy(MEDIA, "id", F.shiftright("at", _EDIT_BITS).alias("up")).agg(F.array_sort(F.collect_list(F.struct("at", "tie", "move"))).alias("parts"))
        first, later = F.get("parts", F.lit(0))["move"], F.slice("parts", F.lit(2), F.greatest(F.size("parts") - 1, F.lit(0)))
        level = level.select(MEDIA, "id", F.col("up").alias("at"), F.lit(0).alias("tie"), F.aggregate(later, first, lambda m, p: then(m, p["move"])).alias("move"))
    # Before and after zero remain: the sign is all that is left of the order.
    negative = F.max_by("move", F.when(F.col("at") < 0, 1))
    rest = F.max_by("move", F.when(F.col("at") >= 0, 1))
    return level.groupBy(MEDIA, "id").agg(negative.alias("m"), rest.alias("r")).select(
        MEDIA, "id", F.when(F.col("m").isNull(), F.col("r")).when(F.col("r").isNull(), F.col("m")).otherwise(then(F.col("m"), F.col("r"))).alias("move"))


def apply_edits(findings: DataFrame, edits: DataFrame) -> DataFrame:
    """Partial updates by (media, id): sent fields only, last one sent wins; spans are put in order after each edit.

    ``edits`` has the editable columns, ``fields_sent`` and an integer ``seq`` that orders them; span edits of equal ``seq`` follow their
    values. Edits are reduced per finding before they meet the findings, whatever their number.
    """
    ends = [f for f in ("start_ms", "end_ms") if f in edits.columns]
    fields = [f for f in EDITABLE if f in edits.columns and f not in ends]

    def moved(field: str) -> Column:
        if field not in ends:
            return F.lit(None).cast("bigint")
        return F.when(F.array_contains("fields_sent", field), F.greatest(F.col(field), F.when(F.col(field).isNotNull(), 0))).cast("bigint")

    def latest(field: str) -> Column:
        sent = F.array_contains("fields_sent", field)
        if not EDITABLE[field]:
            sent = sent & F.col(field).isNotNull()
        return F.max_by(F.struct(F.col(field).alias("v")), F.when(sent, F.col("seq"))).alias(f"new_{field}")

    spans = edits.select(MEDIA, "id", "seq", moved("start_ms").alias("new_start"), moved("end_ms").alias("new_end"))
    moves = F.min(F.when(moved("start_ms").isNotNull() | moved("end_ms").isNotNull(), F.col("seq")))
    reduced = edits.groupBy(MEDIA, "id").agg(F.min("seq").alias("first_seq"), moves.alias("first_move"), *[latest(f) for f in fields])
    reduced = reduced.join(_moves(spans), [MEDIA, "id"], "left")
    joined = findings.join(reduced.withColumn("edited", F.lit(True)), [MEDIA, "id"], "left")

    def value(field: str) -> Column:
        new = F.col(f"new_{field}")["v"]
        if field == "reasoning":
            new = F.coalesce(new, F.lit(""))
        return F.when(F.col(f"new_{field}").isNotNull(), new).otherwise(F.col(field))

    # An edit of another field comes first: it has put the span in order before any end moves.
    in_order = F.col("edited") & (F.col("first_move").isNull() | (F.col("first_seq") < F.col("first_move")))
    out = joined.withColumns({f: value(f) for f in fields}).withColumns({
        "__a": F.when(in_order, F.least("start_ms", "end_ms")).otherwise(F.col("start_ms")),
        "__b": F.when(in_order, F.greatest("start_ms", "end_ms")).otherwise(F.col("end_ms"))})
    source = F.when(F.col("move.source") == 0, F.col("__a")).otherwise(F.col("__b"))

    def end(which: str, untouched: str) -> Column:
        return F.when(F.col("move").isNull(), F.col(untouched)).otherwise(F.greatest(F.col(f"move.low_{which}"), F.least(source, F.col(f"move.high_{which}"))))

    return out.withColumns({"start_ms": end("a", "__a"), "end_ms": end("b", "__b")}).select(findings.columns)


def set_approvals(findings: DataFrame, ids: DataFrame, approved: bool | None) -> DataFrame:
    """One decision for many findings; unknown ids change nothing."""
    hit = ids.select(MEDIA, "id").distinct().withColumn("__hit", F.lit(True))
    return findings.join(hit, [MEDIA, "id"], "left").withColumn(
        "approved", F.when(F.col("__hit"), F.lit(approved).cast("boolean")).otherwise(F.col("approved"))
    ).select(findings.columns)


def bulk_by_type(findings: DataFrame, kind: str, approved: bool | None) -> DataFrame:
    """One decision for every finding of a display type."""
    same = finding_type(F.col("reasoning"), F.col("category")) == kind
    return findings.withColumn("approved", F.when(same, F.lit(approved).cast("boolean")).otherwise(F.col("approved")))


def delete_findings(findings: DataFrame, ids: DataFrame) -> DataFrame:
    """Remove by (media, id); survivors keep their ids."""
    return findings.join(ids.select(MEDIA, "id"), [MEDIA, "id"], "left_anti")


def create_findings(findings: DataFrame, requests: DataFrame, floors: DataFrame | None = None,
                    seq: str = "seq") -> DataFrame:
    """Findings plus hand-made ones. Asking for one is the decision, so it is approved unless it says otherwise."""
    a, b = fix_inverted(F.col("start_ms"), F.col("end_ms"))
    sent = requests.columns
    approved = F.col("approved") if "approved" in sent else F.lit(True)
    reasoning = F.col("reasoning") if "reasoning" in sent else F.lit(None).cast("string")
    made = requests.select(
        MEDIA, a.alias("start_ms"), b.alias("end_ms"), "category", F.lit(1.0).alias("confidence"),
        F.lit(MANUAL).alias("engine"), "action", approved.alias("approved"), reasoning.alias("reasoning"),
        F.lit(None).cast("string").alias("engine_ref"), seq)
    return findings.select(FINDING_COLUMNS).unionByName(
        assign_ids(made, findings, floors, seq).select(FINDING_COLUMNS))


def merge_into_one(findings: DataFrame, picks: DataFrame, action: str = "skip", approved: bool | None = True,
                   floors: DataFrame | None = None) -> DataFrame:
    """Replace each selection ``(media_id, merge_id, id)`` of two or more findings by one spanning them."""
    chosen = findings.join(picks.select(MEDIA, "merge_id", "id").distinct(), [MEDIA, "id"])
    worst = F.max(F.struct(merge_severity(F.col("category")).alias("s"), (-F.col("start_ms")).alias("a"),
                           (-F.col("id")).alias("i"), "category"))
    groups = chosen.groupBy(MEDIA, "merge_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"),
        worst["category"].alias("category"),
        # The label names every selected finding, so it is as long as the selection.
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start_ms", "id"))),
                                 lambda s: F.concat(F.lit("#"), s["id"].cast("string"))), ", ").alias("labels"),
    ).where("n >= 2")
    gone = chosen.join(groups.select(MEDIA, "merge_id"), [MEDIA, "merge_id"], "left_semi")
    rest = delete_findings(findings, gone).select(FINDING_COLUMNS)
    made = groups.select(
        MEDIA, "start_ms", "end_ms", "category", F.lit(1.0).alias("confidence"), F.lit(MANUAL).alias("engine"),
        F.lit(action).alias("action"), F.lit(approved).cast("boolean").alias("approved"),
        F.format_string("merged %d findings (%s)", "n", "labels").alias("reasoning"),
        F.lit(None).cast("string").alias("engine_ref"), F.col("merge_id").alias("seq"))
    return rest.unionByName(assign_ids(made, rest, floors).select(FINDING_COLUMNS))


def mergeable_groups(findings: DataFrame, picks: DataFrame) -> DataFrame:
    """Selections of two or more findings that all have one category."""
    return (findings.join(picks.select(MEDIA, "merge_id", "id").distinct(), [MEDIA, "id"])
            .groupBy(MEDIA, "merge_id")
            .agg(F.count(F.lit(1)).alias("n"), F.min("category").alias("category"), F.max("category").alias("__last"))
            .where("n >= 2 AND category = __last").drop("__last"))


def split_findings(findings: DataFrame, cuts: DataFrame, floors: DataFrame | None = None, edge_ms: int = 100) -> DataFrame:
    """Cut the first finding that holds each ``(media_id, t_ms)`` well inside; the pieces behind a cut are appended.

    A finding hit by k cuts becomes k + 1 pieces in order; the first one keeps the id.
    """
    inner = findings.where(F.col("end_ms") - F.col("start_ms") > 2 * edge_ms)
    hit = best_holder(inner, cuts, [MEDIA], F.col("start_ms") + edge_ms + 1, F.col("end_ms") - edge_ms, "t_ms", F.struct("start_ms", "id")).select(
        MEDIA, "t_ms", F.col("best.id").alias("id"))
    along = Window.partitionBy(MEDIA, "id").orderBy("t_ms")
    pieces = hit.select(MEDIA, "id", F.col("t_ms").alias("cut_ms"), F.lead("t_ms").over(along).alias("next_ms"))
    first_cut = hit.groupBy(MEDIA, "id").agg(F.min("t_ms").alias("cut_ms"))
    first = findings.join(first_cut, [MEDIA, "id"], "left").withColumn("end_ms", F.coalesce("cut_ms", "end_ms")).select(FINDING_COLUMNS)
    second = findings.join(pieces, [MEDIA, "id"]).select(
        MEDIA, F.col("cut_ms").alias("start_ms"), F.coalesce("next_ms", "end_ms").alias("end_ms"), "category", "action", "approved",
        F.coalesce("reasoning", F.lit("")).alias("reasoning"), F.col("cut_ms").alias("seq"), "id")
    # Two findings may be cut at the same instant, so the new ids follow (cut, old id).
    ranked = running(second, [MEDIA], ["seq", "id"], [("seq", block_of("seq", BLOCK_MS))],
                     __n=Running("sum", F.lit(1).cast("bigint"), True))
    made = ranked.drop("seq", "id").withColumnRenamed("__n", "seq")
    return create_findings(first, made, floors)


def union_job_timelines(job_findings: DataFrame, jobs: DataFrame, sidecars: DataFrame | None = None) -> DataFrame:
    """Findings of all jobs on one fingerprint, in start order, numbered from 1.

    Only for media without a timeline of their own (``sidecars``: fingerprint). Among equal starts the
    newer job comes first when ``jobs`` has ``created_at``.
    """
    dated = "created_at" in jobs.columns
    owned = job_findings.join(jobs.select("job_id", "fingerprint", *(["created_at"] if dated else [])), "job_id")
    if sidecars is not None:
        owned = owned.join(sidecars.select("fingerprint"), "fingerprint", "left_anti")
    # Nulls of the start come first, in a block of their own; a fingerprint that is null has no timeline.
    newest = [F.col("created_at").desc_nulls_last()] if dated else []
    order = [F.col("start_ms").asc_nulls_first(), *newest, F.col("job_id").asc_nulls_first(), F.col("id").asc_nulls_first()]
    hour = F.coalesce(block_of("start_ms", BLOCK_MS), F.lit(-(1 << 62)))
    owned = owned.where("fingerprint IS NOT NULL").withColumn("source_id", F.col("id"))
    return row_rank(owned, ["fingerprint"], order, [("start_ms", hour)], "__pos").withColumn("id", F.col("__pos")).drop("__pos")


def findings_by_time(findings: DataFrame) -> DataFrame:
    """A range-partitioned sort: media together, spans in start order."""
    return findings.orderBy(MEDIA, "start_ms", "id")


def unique_first(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Order-preserving de-duplication: the first row of each key, as a map-side aggregate."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__r")).select(
        *key, *[F.col(f"__r.{c}").alias(c) for c in rest]).select(df.columns)
