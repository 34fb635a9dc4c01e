"""Streaming operators fed from the benchmark tables, each with its batch result as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanweave.operators.jobs import upsert_latest
from spanweave.operators.reconcile import high_water
from spanweave.session import scratch_path
from spanweave.streaming import findings as sf_
from spanweave.streaming import jobs as sj
from workload import views as v
from workload.registry import query
from workload.review_queries import _COLS, _NO_ID, free_sql
from workload.span_queries import burst_sql
from workload.visual_queries import _load_stub

SQL = v.SQL


def stream_of(view, spark: SparkSession, sf: str, name: str, by: str = "event_id") -> DataFrame:
    """A derived view over a table that arrives as a stream of files, in three micro-batches along ``by``."""
    whole, folder = spark.read.parquet(f"{sf}/{name}.parquet"), scratch_path(spark, "arrivals")
    at = F.expr(f"cast({by} as double)")
    low, high = whole.agg(F.min(at), F.max(at)).first()
    third = F.least(F.floor((at - low) / ((high - low) or 1.0) * 3), F.lit(2))
    for part in range(3):  # one after the other, as files arrive in the order of their times
        whole.where(third == part).write.mode("append").parquet(folder)
    files = max(1, -(-len(spark.read.parquet(folder).inputFiles()) // 3))

    class _Stream:
        """Stands in for the session inside a view, so that one definition serves both forms."""
        def __init__(self):
            self.read = self

        def parquet(self, path: str) -> DataFrame:
            return spark.readStream.schema(whole.schema).option("maxFilesPerTrigger", files).parquet(folder)

    return view(_Stream(), sf)


def _folder(spark: SparkSession, label: str) -> tuple[str, str]:
    home = scratch_path(spark, label)
    return f"{home}/out", f"{home}/checkpoint"


@query("stream_merge_hits", "findings spans hits hits_u", burst_sql("hits_u"))
def stream_merge_hits(spark, sf):
    found = stream_of(v.findings, spark, sf, "events")
    hits = found.select("media_id", "start_ms", (F.col("start_ms") + F.expr("(end_ms - start_ms) div 20")).alias("end_ms"), F.col("category").alias("word"),
                        "confidence", F.col("reasoning").alias("context"), F.col("id").alias("seq"))
    out, checkpoint = _folder(spark, "bursts")
    return sf_.stream_merge_hits(hits, out, checkpoint).latest()


_STATE = """
WITH ended AS (SELECT job_id, min(seq) AS stop FROM ticks WHERE status = 'cancelled' GROUP BY job_id)
SELECT job_id, max(seq) AS seq, max_by(fraction, seq) AS fraction, max_by(stage, seq) AS stage, max_by(status, seq) AS status
FROM ticks LEFT JOIN ended USING (job_id) WHERE stop IS NULL OR seq <= stop GROUP BY job_id"""


@query("progress_state", "ticks", _STATE)
def progress_state(spark, sf):
    return sj.progress_state(v.ticks(spark, sf))


@query("stream_progress_state", "ticks", _STATE)
def stream_progress_state(spark, sf):
    out, checkpoint = _folder(spark, "progress")
    sj.stream_progress_state(stream_of(v.ticks, spark, sf, "events"), out, checkpoint)
    return upsert_latest(spark.read.parquet(out), ["job_id"], ["epoch"]).drop("epoch")


_ALERTS = """
SELECT job_id, seq, CASE WHEN decile > coalesce(top, -1) THEN 'decile' ELSE 'stage' END AS kind, decile, stage FROM (SELECT *,
    max(decile) OVER (PARTITION BY job_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top, lag(stage) OVER (PARTITION BY job_id ORDER BY seq) AS prev
  FROM (SELECT job_id, seq, stage, trunc(round_even(fraction, 4) * 10)::INT AS decile FROM ticks LEFT JOIN
    (SELECT job_id, min(seq) AS stop FROM ticks WHERE status = 'cancelled' GROUP BY job_id) USING (job_id) WHERE stop IS NULL OR seq <= stop)) WHERE decile > coalesce(top, -1) OR prev IS NULL OR stage <> prev"""


@query("decile_alerts", "ticks", _ALERTS)
def decile_alerts(spark, sf):
    return sj.decile_alerts(v.ticks(spark, sf))[0]


@query("stream_decile_alerts", "ticks", _ALERTS)
def stream_decile_alerts(spark, sf):
    out, checkpoint = _folder(spark, "alerts")
    sj.stream_decile_alerts(stream_of(v.ticks, spark, sf, "events"), out, checkpoint)
    return spark.read.parquet(f"{out}/alerts").drop("epoch")


_RECHECKS = """
WITH RECURSIVE polled AS (SELECT DISTINCT path, t_s FROM polls),
passed AS (SELECT path, min(t_s) AS t_s FROM polled GROUP BY path UNION ALL
  SELECT p.path, (SELECT min(q.t_s) FROM polled q WHERE q.path = p.path AND q.t_s >= p.t_s + 30) FROM passed p WHERE p.t_s IS NOT NULL)
SELECT path, t_s FROM passed WHERE t_s IS NOT NULL"""
_RECHECKS = "WITH RECURSIVE " + SQL["polls"].strip() + ", " + _RECHECKS.strip()[len("WITH RECURSIVE "):]


@query("miss_suppression", "", _RECHECKS)
def miss_suppression(spark, sf):
    return sj.miss_rechecks(v.polls(spark, sf))


@query("stream_miss_suppression", "", _RECHECKS)
def stream_miss_suppression(spark, sf):
    out, checkpoint = _folder(spark, "polls")
    sj.stream_miss_suppression(stream_of(v.polls, spark, sf, "events", "cast(ts as timestamp)"), out, checkpoint)
    return spark.read.parquet(f"{out}/rechecks").drop("epoch")


@query("stream_flag_moments", "findings media floors flags free_all", """
SELECT media_id, next_id + row_number() OVER (PARTITION BY media_id ORDER BY flag_id) - 1 AS id, greatest(t_ms - 1500, 0) AS start_ms, t_ms + 1500 AS end_ms, 'manual' AS category,
  'skip' AS action, true AS approved, 'Flagged during playback at ' || CASE WHEN t_ms >= 3600000 THEN (t_ms // 3600000) || ':' ELSE '' END ||
  printf('%02d:%02d', t_ms // 60000 % 60, t_ms // 1000 % 60) AS reasoning, 'manual' AS engine, 1.0::DOUBLE AS confidence, NULL::VARCHAR AS engine_ref
FROM flags JOIN free_all USING (media_id)""")
def stream_flag_moments(spark, sf):
    out, checkpoint = _folder(spark, "flags")
    flags = stream_of(v.flags, spark, sf, "events").withColumnRenamed("flag_id", "seq")
    from workload.review_queries import floors
    sj.stream_flag_moments(flags, out, checkpoint, floors=high_water(v.findings(spark, sf), floors(spark, sf)))
    return spark.read.parquet(f"{out}/findings").drop("epoch")


SQL["kept_ran"] = """
kept_ran AS (SELECT * FROM prior p WHERE NOT EXISTS (SELECT 1 FROM fresh f WHERE f.media_id = p.media_id AND f.engine = p.engine))"""
SQL["free_ran"] = free_sql("free_ran", "prior")


@query("stream_incremental_reanalysis", "findings media prior_fresh floors carried kept_ran free_ran", f"""
SELECT {_COLS} FROM kept_ran UNION ALL
SELECT media_id, next_id + row_number() OVER (PARTITION BY media_id ORDER BY seq) - 1 AS id, {_NO_ID[10:]} FROM carried JOIN free_ran USING (media_id)""")
def stream_incremental_reanalysis(spark, sf):
    from workload.review_queries import floors
    out, checkpoint = _folder(spark, "reanalysis")
    prior = v.prior(spark, sf)
    log = sf_.stream_incremental_reanalysis(stream_of(v.fresh, spark, sf, "events", "user_id"), prior, out, checkpoint, floors(spark, sf))
    changed = log.latest()
    return changed.unionByName(prior.join(changed.select("media_id").distinct(), "media_id", "left_anti"))


@query("stream_resume", "samples", """
SELECT media_id, shot_index, at_ms, at_ms % 3 = 0 AND at_ms % 7 <> 0 AS sex_act, 'm1' AS model, shot_index || ':' || printf('%.2f', at_ms / 1000.0::DOUBLE) AS sample_key FROM samples""")
def stream_resume(spark, sf):
    """Run, then restart on the same checkpoint: nothing is scored twice."""
    from spanweave.functions.policy import OBSERVATIONS
    home = scratch_path(spark, "scores")
    bare = stream_of(v.samples, spark, sf, "lineitem", "l_orderkey").drop(*OBSERVATIONS, "description")
    for _ in range(2):
        answers = sf_.stream_scores(bare, _load_stub, home, "m1", "d1")
    return spark.read.parquet(answers).select("media_id", "shot_index", "at_ms", "sex_act", "model", "sample_key")


@query("stream_schedule_gate", "schedule gated", "SELECT event_id, allowed FROM gated")
def stream_schedule_gate(spark, sf):
    out, checkpoint = _folder(spark, "gate")
    gated = sj.schedule_gate(stream_of(v.instants, spark, sf, "events"), v.SCHEDULE).select("event_id", "allowed")
    (gated.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
     .trigger(availableNow=True).start().awaitTermination())
    return spark.read.parquet(out)
