"""Job tables: upserts, ordering, reuse and what a library page shows of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanweave.functions.review import ACTIVE_RANK, DETECTORS, FINISHED, TERMINAL
from spanweave.functions.schedule import Schedule, schedule_allowed
from spanweave.functions.policy import lookup
from spanweave.functions.text import base_name_key
from spanweave.operators.scan import Along, global_rank, row_rank, time_blocks


def upsert_latest(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Last write per key wins. An aggregate, so a hot key is reduced before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__r")).select(
        *keys, *[F.col(f"__r.{c}").alias(c) for c in rest]).select(rows.columns)


def delete_cascade(jobs: DataFrame, timelines: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Jobs and their timelines without the deleted ids."""
    ids = gone.select("id")
    return (jobs.join(ids, "id", "left_anti"),
            timelines.join(ids.withColumnRenamed("id", "job_id"), "job_id", "left_anti"))


def reuse_by_fingerprint(requests: DataFrame, jobs: DataFrame) -> DataFrame:
    """Requests with the newest finished job on the same content and engine, null when there is none."""
    done = jobs.where(F.col("status").isin(*FINISHED)).groupBy("fingerprint", "engine").agg(
        F.max_by("id", F.struct("created_at", "id")).alias("reused_id"))
    return requests.join(done, ["fingerprint", "engine"], "left")


def order_key() -> list[Column]:
    """Queue order: position, unset last, then submission."""
    return [F.col("queue_position").asc_nulls_last(), F.col("created_at").asc(), F.col("id").asc()]


def queue_rank(jobs: DataFrame) -> DataFrame:
    return global_rank(jobs, [Along(F.col("queue_position"), nulls_last=True), Along(F.col("created_at")), Along(F.col("id"))], "rank")


def allocate_positions(jobs: DataFrame, new: DataFrame) -> DataFrame:
    """End-of-queue positions for new jobs in submission order."""
    # One row.
    top = jobs.agg(F.coalesce(F.max("queue_position") + 1, F.lit(0)).cast("bigint").alias("__start"))
    ranked = global_rank(new.drop("queue_position"), [Along(F.col("created_at")), Along(F.col("id"))], "__n")
    return ranked.crossJoin(F.broadcast(top)).withColumn("queue_position", F.col("__start") + F.col("__n") - 1).drop("__start", "__n")


def runnable(jobs: DataFrame, allowed: bool | Column, cancelled: DataFrame | None = None) -> DataFrame:
    """Jobs that may start: renders always, queued analysis while the schedule allows."""
    gate = F.lit(allowed) if isinstance(allowed, bool) else allowed
    free = jobs.where((F.col("status") == "rendering") | ((F.col("status") == "queued") & gate))
    return free if cancelled is None else free.join(cancelled.select("id"), "id", "left_anti")


def next_runnable(jobs: DataFrame, allowed: bool, cancelled: DataFrame | None = None) -> DataFrame:
    """The first runnable job in queue order: a top-1, so nothing is sorted in full."""
    return runnable(jobs, allowed, cancelled).orderBy(*order_key()).limit(1)


def next_runnable_at(jobs: DataFrame, instants: DataFrame, schedule: Schedule, ts: str = "ts") -> DataFrame:
    """What would run next at each instant. Only two answers exist: windows open, and closed."""
    order = F.struct(F.coalesce("queue_position", F.lit(2**62)).alias("p"), "created_at", "id")
    answers = jobs.where(F.col("status").isin("rendering", "queued")).agg(
        F.min(order)["id"].alias("open"),
        F.min(F.when(F.col("status") == "rendering", order))["id"].alias("closed"))
    answers = answers.select(F.explode(F.create_map(F.lit(True), "open", F.lit(False), "closed")).alias("allowed", "job_id"))
    return instants.withColumn("allowed", schedule_allowed(F.col(ts), schedule)).join(
        F.broadcast(answers), "allowed", "left")  # two rows


def jobs_newest_first(jobs: DataFrame) -> DataFrame:
    return jobs.orderBy(F.col("created_at").desc(), F.col("id").desc())


def recent_terminal(jobs: DataFrame) -> DataFrame:
    return jobs_newest_first(jobs.where(F.col("status").isin(*TERMINAL)))


def queue_depth(jobs: DataFrame, running_id: str | None = None, cancelled: DataFrame | None = None) -> DataFrame:
    """How many jobs wait to start."""
    waiting = jobs.where(F.col("status").isin("queued", "rendering"))
    if running_id is not None:
        waiting = waiting.where(F.col("id") != running_id)
    if cancelled is not None:
        waiting = waiting.join(cancelled.select("id"), "id", "left_anti")
    return waiting.agg(F.count(F.lit(1)).alias("depth"))


def jobs_by_type(jobs: DataFrame) -> DataFrame:
    """Jobs per engine: all, active, pending and finished one way or another."""
    status = F.col("status")
    return jobs.groupBy("engine").agg(
        F.count(F.lit(1)).alias("jobs"), F.count_if(status.isin("running", "rendering")).alias("active"),
        F.count_if(status.isin("queued", "rendering")).alias("pending"),
        F.count_if(status.isin(*TERMINAL)).alias("terminal"))


def with_name(jobs: DataFrame) -> DataFrame:
    return jobs.withColumn("name", base_name_key(F.col("media_path")))


def _rank() -> Column:
    return lookup(ACTIVE_RANK, F.col("status"), None)


_BRIEF = ("id", "status", "progress", "stage", "error", "engine")


def _newest_first(*lead: Column) -> Column:
    """Sortable so that the smallest is the newest."""
    return F.struct(*lead, (-F.unix_micros("created_at")).alias("age"), "id")


def film_jobs(jobs: DataFrame) -> DataFrame:
    """Per film name: the headline job, the engines done, and whether anything has finished."""
    brief = F.struct(*[c for c in _BRIEF if c in jobs.columns])
    active = F.when(_rank().isNotNull(), _newest_first(_rank().alias("r")))
    finished = F.col("status").isin(*FINISHED)
    return with_name(jobs).groupBy("name").agg(
        F.min_by(brief, active).alias("active_job"), F.min_by(brief, _newest_first()).alias("newest_job"),
        F.array_sort(F.collect_set(F.when(finished & F.col("engine").isin(*DETECTORS), F.col("engine")))).alias("engines_done"),
        F.max(finished).alias("just_analyzed"), F.count_if(_rank().isNotNull()).alias("n_active"))


def headline_job(jobs: DataFrame) -> DataFrame:
    """The job a film's one-line status shows: the most active, newest first; else the newest of any."""
    return film_jobs(jobs).select("name", F.coalesce("active_job", "newest_job").alias("job")).select(
        "name", F.col("job.id").alias("job_id"), F.col("job.status").alias("status"), F.col("job.engine").alias("engine"))


def engines_done(jobs: DataFrame) -> DataFrame:
    """Detectors with a finished job per film. The set has four members at most."""
    return film_jobs(jobs).select("name", F.array_join("engines_done", ",").alias("engines_done"))


def active_jobs(jobs: DataFrame) -> DataFrame:
    """Jobs in flight per film with the keys that order them: activity, then newest.

    Rows rather than one list per film, so a film with very many jobs is no single value.
    """
    return with_name(jobs).withColumn("rank", _rank()).where("rank is not null").select(
        "name", "rank", "created_at", *[c for c in _BRIEF if c in jobs.columns])


#: Span of one block of job ages, in microseconds.
_AGES = 3_600_000_000


def active_for_paths(requests: DataFrame, resolved: DataFrame, jobs: DataFrame) -> DataFrame:
    """The jobs in flight of each requested path, one row each: ``pos``, ``path``, ``place`` from 1 and what a page shows of a job.

    Running comes before rendering and that before queued, each newest first. A path without such jobs has no row.
    """
    flying = active_jobs(jobs).withColumn("age", -F.unix_micros("created_at"))
    placed = row_rank(flying, ["name", "rank"], ["age", "id"], time_blocks("age", _AGES), "__n")
    # Three ranks, so what stands before one is two counts.
    before = flying.groupBy("name").agg(F.count_if(F.col("rank") == 0).alias("__0"), F.count_if(F.col("rank") == 1).alias("__1"))
    place = F.col("__n") + F.when(F.col("rank") > 0, F.col("__0")).otherwise(0) + F.when(F.col("rank") > 1, F.col("__1")).otherwise(0)
    named = requests.join(resolved, "path").withColumn("name", base_name_key(F.col("resolved_path")))
    return named.select("pos", "path", "name").join(placed.join(before, "name"), "name").select(
        "pos", "path", place.alias("place"), *[c for c in _BRIEF if c in jobs.columns])


def status_for_paths(requests: DataFrame, resolved: DataFrame, jobs: DataFrame, counts: DataFrame,
                     sidecars: DataFrame) -> DataFrame:
    """One row per requested path, unresolved ones included, with ``pos`` to order by.

    ``resolved``: (path, resolved_path); ``counts``: review counts by ``name``; ``sidecars``: ``name`` of
    films with a timeline on disk. The columns ``job_...`` show the headline job, null where ``jobs`` lacks a
    field; its jobs in flight are rows of ``active_for_paths``.
    """
    named = requests.join(resolved, "path", "left").withColumn("name", base_name_key(F.col("resolved_path")))
    known = sidecars.select("name").distinct().withColumn("has_sidecar", F.lit(True))
    joined = (named.join(film_jobs(jobs), "name", "left").join(counts, "name", "left").join(known, "name", "left"))
    # A timeline on disk is enough, a film without findings has one too; a job that has just ended shows by them.
    analyzed = F.coalesce("has_sidecar", F.lit(False)) | (F.coalesce("just_analyzed", F.lit(False)) & F.col("total").isNotNull())
    job = F.coalesce("active_job", "newest_job")

    def count(name: str) -> Column:
        return F.when(analyzed, F.coalesce(name, F.lit(0))).otherwise(0).cast("bigint").alias(name)

    return joined.select(
        "pos", "path", "resolved_path", analyzed.alias("analyzed"), count("total"), count("approved"),
        count("rejected"), count("pending"),
        *[(job[c] if c in jobs.columns else F.lit(None).cast("string")).alias(f"job_{c}") for c in _BRIEF],
        F.coalesce("n_active", F.lit(0)).cast("bigint").alias("active"),
        F.coalesce(F.array_join("engines_done", ","), F.lit("")).alias("engines_done"))
