"""Progress, alerts, suppression and playback flags: pure batch functions and their streaming drivers.

A driver's ``foreachBatch`` calls the batch function with the state earlier epochs left, so stream and
batch agree by construction, and a hot key is spread inside a micro-batch just as in a batch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanweave.functions.review import TERMINAL
from spanweave.functions.schedule import Schedule, schedule_allowed
from spanweave.functions.timefmt import fmt_clock, progress_decile
from spanweave.operators.reconcile import create_findings, high_water
from spanweave.operators.scan import Running, id_blocks, running, union_all
from spanweave.schema import FINDING
from spanweave.streaming.state import KeyedLog, run_available, write_epoch


# -- progress ---------------------------------------------------------------------------------------

def progress_state(ticks: DataFrame) -> DataFrame:
    """Latest state per job; once a job has ended, later ticks no longer count.

    Built from order-free aggregates, so it runs unchanged on a stream, with partial aggregation before the
    shuffle, and late ticks fall into place.
    """
    row = F.struct("seq", "fraction", "stage", "status")
    ended = F.when(F.col("status").isin(*TERMINAL), row)
    return ticks.groupBy("job_id").agg(F.min(ended).alias("ended"), F.max(row).alias("latest")).select(
        "job_id", F.coalesce("ended", "latest").alias("t")).select("job_id", "t.seq", "t.fraction", "t.stage", "t.status")


def stream_progress_state(ticks: DataFrame, path: str, checkpoint: str) -> None:
    """Jobs changed by each epoch; the current state is the latest row per job."""
    log = KeyedLog(ticks.sparkSession, path, ["job_id"])
    run_available(progress_state(ticks), lambda batch, epoch: log.write(epoch, batch), checkpoint, "update")


# -- alerts -----------------------------------------------------------------------------------------

def decile_alerts(ticks: DataFrame, before: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Ticks that cross a new tenth or change stage, and the marks per job they leave.

    A job that was cancelled gives no more alerts. ``before``: (job_id, decile, stage, stopped) left by earlier ticks.
    """
    rows = ticks.select("job_id", "seq", progress_decile(F.col("fraction")).alias("decile"),
                        F.when(F.col("stage") != "", F.col("stage")).alias("stage"), (F.col("status") == "cancelled").alias("stopped"), F.lit(False).alias("mark"))
    if before is not None:
        lead = before.select("job_id", F.lit(-1).cast("bigint").alias("seq"), "decile", "stage", "stopped", F.lit(True).alias("mark"))
        rows = lead.unionByName(rows)
    seen = running(rows, ["job_id"], ["seq"], id_blocks("seq"), top=Running("max", F.col("decile")),
                   last_stage=Running("last", F.col("stage")), over=Running("max", F.col("stopped")))
    crossed = F.col("decile") > F.coalesce("top", F.lit(-1))
    moved = F.col("stage").isNotNull() & ~F.col("stage").eqNullSafe(F.col("last_stage"))
    alerts = seen.where(~F.col("mark") & ~F.coalesce("over", F.lit(False)) & (crossed | moved)).select(
        "job_id", "seq", F.when(crossed, "decile").otherwise("stage").alias("kind"), "decile",
        F.coalesce("stage", "last_stage", F.lit("")).alias("stage"))
    marks = rows.groupBy("job_id").agg(F.max("decile").alias("decile"), F.coalesce(F.max("stopped"), F.lit(False)).alias("stopped"), F.max(
        F.when(F.col("stage").isNotNull(), F.struct("seq", "stage")))["stage"].alias("stage"))
    return alerts, marks


def stream_decile_alerts(ticks: DataFrame, path: str, checkpoint: str) -> None:
    log = KeyedLog(ticks.sparkSession, f"{path}/marks", ["job_id"])

    def each(batch: DataFrame, epoch: int) -> None:
        before = log.before(epoch)
        if before is not None:
            before = before.join(batch.select("job_id").distinct(), "job_id", "left_semi")
        alerts, marks = decile_alerts(batch, before)
        write_epoch(alerts, f"{path}/alerts", epoch)
        log.write(epoch, marks)

    run_available(ticks, each, checkpoint)


# -- suppression ------------------------------------------------------------------------------------

#: A block of the clock has room for so many look-ups, and a run of blocks is so many.
_FAN = 64


def _entries(steps: Column, entry: Column, at: Column) -> Column:
    """(at, e) for each of the ordered ``steps`` (at, exits), where e is what the step before left to it, and last what
    the last one leaves. A step that does not follow at once finds the answer forgotten."""
    none = F.array().cast("array<struct<at:bigint,e:int>>")

    def on(acc: Column, step: Column) -> Column:
        e = F.when(step["at"] == acc["at"] + 1, acc["e"]).otherwise(F.lit(0))
        return F.struct(F.array_append(acc["seen"], F.struct(step["at"].alias("at"), e.alias("e"))).alias("seen"),
                        F.get(step["exits"], e).alias("e"), step["at"].alias("at"))

    return F.aggregate(steps, F.struct(none.alias("seen"), entry.cast("int").alias("e"), at.cast("bigint").alias("at")), on)


def _exit(steps: Column, entry: Column, at: Column) -> Column:
    """What the last of the ``steps`` leaves, and its place."""
    def on(acc: Column, step: Column) -> Column:
        e = F.when(step["at"] == acc["at"] + 1, acc["e"]).otherwise(F.lit(0))
        return F.struct(F.get(step["exits"], e).alias("e"), step["at"].alias("at"))

    return F.aggregate(steps, F.struct(entry.cast("int").alias("e"), at.cast("bigint").alias("at")), on)


def miss_rechecks(polls: DataFrame, ttl: int = 30, before: DataFrame | None = None) -> DataFrame:
    """Times (whole seconds) at which a repeated miss is looked up again: the first, then whenever the last is ``ttl`` old.

    A path's clock is cut into blocks. What a block needs to know of the past is how many of its first seconds the
    last answer still covers, one of ``ttl`` numbers; so each block is reduced to what it leaves to the next for each of
    them, runs of blocks likewise, and only these small maps are put in sequence per path. Then each block is
    walked alone. A block holds distinct seconds only, however many clients ask and however long a service stands.
    ``before``: (path, t_s) of the last look-up; polls up to it were answered by it and are left out, so a poll that
    arrives in a later batch than a younger one has no look-up of its own.
    """
    width = ttl * _FAN
    times = polls.select("path", "t_s")
    if before is not None:
        last = before.select("path", F.col("t_s").alias("last_s"))
        times = times.join(last, "path", "left").where("last_s is null or t_s > last_s").select("path", "t_s").unionByName(
            before.select("path", "t_s"))
    offset = F.expr(f"pmod(t_s, {width})").cast("int")
    blocks = times.where("t_s is not null").select("path", F.expr(f"(t_s - pmod(t_s, {width})) div {width}").alias("at"), offset.alias("o")).groupBy(
        "path", "at").agg(F.sort_array(F.collect_set("o")).alias("os"))

    def left(e: Column) -> Column:
        free = F.aggregate("os", e, lambda free, o: F.when(o >= free, o + ttl).otherwise(free))
        return F.greatest(free - width, F.lit(0))

    possible = F.sequence(F.lit(0), F.lit(ttl - 1))
    run = F.expr(f"(at - pmod(at, {_FAN})) div {_FAN}")
    runs = blocks.select("path", "at", F.transform(possible, left).alias("exits")).groupBy("path", run.alias("run")).agg(
        F.array_sort(F.collect_list(F.struct("at", "exits"))).alias("steps"))

    def left_by_run(e: Column) -> Column:
        out = _exit(F.col("steps"), e, F.col("run") * _FAN - 1)
        return F.when(out["at"] == F.col("run") * _FAN + _FAN - 1, out["e"]).otherwise(F.lit(0))

    sequence = runs.select("path", F.struct(F.col("run").alias("at"), F.transform(possible, left_by_run).alias("exits")).alias("step")).groupBy(
        "path").agg(F.array_sort(F.collect_list("step")).alias("steps"))
    entered = sequence.select("path", F.explode(_entries(F.col("steps"), F.lit(0), F.lit(-1))["seen"]).alias("r")).select(
        "path", F.col("r.at").alias("run"), F.col("r.e").alias("e"))
    walked = runs.join(entered, ["path", "run"]).select(
        "path", F.explode(_entries(F.col("steps"), F.col("e"), F.col("run") * _FAN - 1)["seen"]).alias("b")).select("path", "b.at", "b.e")

    def step(acc: Column, o: Column) -> Column:
        return F.when(o >= acc["free"], F.struct(F.array_append(acc["passed"], o).alias("passed"), (o + ttl).alias("free"))).otherwise(acc)

    start = F.struct(F.array().cast("array<int>").alias("passed"), F.col("e").alias("free"))
    passed = F.aggregate("os", start, step, lambda acc: acc["passed"])
    out = blocks.join(walked, ["path", "at"]).select("path", "at", F.explode(passed).alias("o")).select(
        "path", (F.col("at") * width + F.col("o")).alias("t_s"))
    return out if before is None else out.join(before, ["path", "t_s"], "left_anti")


def stream_miss_suppression(polls: DataFrame, path: str, checkpoint: str, ttl: int = 30) -> None:
    log = KeyedLog(polls.sparkSession, f"{path}/last", ["path"])

    def each(batch: DataFrame, epoch: int) -> None:
        before = log.before(epoch)
        if before is not None:
            before = before.join(batch.select("path").distinct(), "path", "left_semi")
        write_epoch(miss_rechecks(batch, ttl, before), f"{path}/rechecks", epoch)
        passed = batch.sparkSession.read.parquet(f"{path}/rechecks/epoch={epoch}")
        log.write(epoch, passed.groupBy("path").agg(F.max("t_s").alias("t_s")))

    run_available(polls, each, checkpoint)


# -- playback flags ---------------------------------------------------------------------------------

def flag_moments(flags: DataFrame, pad_ms: int = 1500, approved: bool | None = True) -> DataFrame:
    """Moments flagged in playback as padded manual findings. Flagging is deciding unless told otherwise."""
    at = F.col("t_ms")
    return flags.select(
        *[c for c in flags.columns if c != "t_ms"], F.greatest(at - pad_ms, F.lit(0)).alias("start_ms"),
        (at + pad_ms).alias("end_ms"), F.lit("manual").alias("category"), F.lit("skip").alias("action"),
        F.lit(approved).cast("boolean").alias("approved"),
        F.concat(F.lit("Flagged during playback at "), fmt_clock(at)).alias("reasoning"))


def stream_flag_moments(flags: DataFrame, path: str, checkpoint: str, pad_ms: int = 1500,
                        approved: bool | None = True, floors: DataFrame | None = None) -> None:
    """Append flagged moments as findings, with ids that go on where the media's table (``floors``: its next free id)
    or its last epoch ended. ``flags`` has ``seq``."""
    spark = flags.sparkSession
    log = KeyedLog(flags.sparkSession, f"{path}/ids", ["media_id"])

    def each(batch: DataFrame, epoch: int) -> None:
        marks = [m.select("media_id", "next_segment_id") for m in (floors, log.before(epoch)) if m is not None]
        made = create_findings(spark.createDataFrame([], FINDING), flag_moments(batch, pad_ms, approved), union_all(marks) if marks else None)
        write_epoch(made, f"{path}/findings", epoch)
        log.write(epoch, high_water(spark.read.parquet(f"{path}/findings/epoch={epoch}")))

    run_available(flags, each, checkpoint)


# -- schedule ---------------------------------------------------------------------------------------

def schedule_gate(events: DataFrame, schedule: Schedule, ts: str = "ts") -> DataFrame:
    """Events marked as allowed now or held. Stateless, so it runs on streams as it is."""
    return events.withColumn("allowed", schedule_allowed(F.col(ts), schedule))
