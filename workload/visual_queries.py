"""Shots, samples, scenes and detection plans."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from spanweave.functions.policy import OBSERVATIONS, Policy
from spanweave.operators import visual
from spanweave.plans import detectors
from workload import views as v
from workload.registry import query
from workload.scalar_queries import CLASSIFY

SQL = v.SQL

SQL["scaled"] = """
facts AS (SELECT media_id, duration_s, span_s, duration_s / span_s AS scale FROM durations
  LEFT JOIN (SELECT media_id, max_by(end_s, shot_index) AS span_s FROM shots_s GROUP BY media_id) USING (media_id)),
scaled AS (SELECT media_id, shot_index, start_frame, end_frame, least(duration_s, start_s * scale) AS start_s, least(duration_s, end_s * scale) AS end_s
  FROM shots_s JOIN facts USING (media_id) WHERE scale <= 1.5::DOUBLE AND start_s * scale < duration_s)"""


@query("rescale_timeline", "shots_s durations scaled", """
SELECT * FROM scaled UNION ALL SELECT media_id, 0, 0, NULL, 0.0::DOUBLE, duration_s FROM facts WHERE span_s IS NULL""")
def rescale_timeline(spark, sf):
    return visual.rescale_timeline(v.shots_s(spark, sf), v.durations(spark, sf))[0]


@query("rescale_rejected", "shots_s durations scaled", "SELECT media_id, span_s, duration_s FROM facts WHERE scale > 1.5::DOUBLE")
def rescale_rejected(spark, sf):
    return visual.rescale_timeline(v.shots_s(spark, sf), v.durations(spark, sf))[1]


SQL["worst"] = f"""
graded AS (SELECT *, {CLASSIFY.format('')} AS category FROM samples),
worst AS (SELECT media_id, shot_index, category, CASE category WHEN 'suggestive' THEN 0.5 ELSE 1.0 END::DOUBLE AS confidence, description, at_ms
  FROM (SELECT *, row_number() OVER (PARTITION BY media_id, shot_index ORDER BY CASE category WHEN 'sexual_activity' THEN 3 WHEN 'nudity' THEN 2
    WHEN 'intense_kissing' THEN 1 ELSE 0 END DESC, at_ms, description DESC) AS r FROM graded WHERE category IS NOT NULL) WHERE r = 1)"""
SQL["scened"] = """
scened AS (SELECT *, max(CASE WHEN prev IS NULL OR shot_index - prev > 3 THEN shot_index END) OVER (PARTITION BY media_id ORDER BY shot_index) AS scene
  FROM (SELECT *, lag(shot_index) OVER (PARTITION BY media_id ORDER BY shot_index) AS prev FROM worst))"""


@query("worst_sample_per_shot", "samples worst", "SELECT media_id, shot_index, category, confidence, description, at_ms FROM worst")
def worst_sample_per_shot(spark, sf):
    return visual.worst_sample_per_shot(v.samples(spark, sf))


@query("group_scenes", "samples worst scened", "SELECT media_id, shot_index, scene FROM scened")
def group_scenes(spark, sf):
    return visual.group_scenes(visual.worst_sample_per_shot(v.samples(spark, sf))).select("media_id", "shot_index", "scene")


SQL["scene_found"] = """
scene_found AS (SELECT g.media_id, g.scene, a.start_ms, b.end_ms, g.category, g.confidence, 'vlm' AS engine, 'skip' AS action, NULL::BOOLEAN AS approved,
    CASE WHEN n = 1 THEN 'shot ' || g.scene ELSE 'shots ' || g.scene || '-' || g.last END || ' (' || n || ' flagged): ' || description AS reasoning, engine_ref
  FROM (SELECT media_id, scene, max(shot_index) AS last, count(*) AS n, first(category ORDER BY confidence DESC, shot_index) AS category,
      max(confidence) AS confidence, first(description ORDER BY confidence DESC, shot_index) AS description,
      string_agg(shot_index::VARCHAR, ',' ORDER BY shot_index) AS engine_ref FROM scened GROUP BY media_id, scene) g
  JOIN (SELECT media_id, min(shot_index) AS lo, max(shot_index) AS hi FROM shots GROUP BY media_id) l USING (media_id)
  JOIN shots a ON a.media_id = g.media_id AND a.shot_index = greatest(lo, g.scene - 1)
  JOIN shots b ON b.media_id = g.media_id AND b.shot_index = least(hi, g.last + 1))"""


@query("scene_findings", "samples shots worst scened scene_found", "SELECT * FROM scene_found")
def scene_findings(spark, sf):
    return detectors.visual_findings(v.samples(spark, sf), v.shots(spark, sf)).withColumnRenamed("seq", "scene")


@query("policy_hook", "samples", f"""
SELECT media_id, shot_index, at_ms, description FROM samples WHERE ({CLASSIFY.format("WHEN kissing THEN 'intense_kissing'").replace(
    "WHEN underwear_only THEN 'suggestive'", "").replace("male_shirtless AND sexualised_framing", "male_shirtless")}) IS NOT NULL""")
def policy_hook(spark, sf):
    policy = Policy(flag_male_shirtless=True, flag_underwear=False, flag_any_kissing=True)
    return v.samples(spark, sf).where(policy.classify().isNotNull()).select("media_id", "shot_index", "at_ms", "description")


def _load_stub():
    """A stand-in model: answers from the sample's own instant, and not at all for some."""
    def score(batch: pd.DataFrame) -> pd.DataFrame:
        at = batch["at_ms"]
        answer = (at % 3 == 0).astype(object)
        answer[at % 7 == 0] = None
        return pd.DataFrame({"sex_act": answer, "kissing": at % 2 == 0, "description": "at " + at.astype(str)})
    return score


@query("score_samples", "samples", """
SELECT media_id, shot_index, at_ms, at_ms % 3 = 0 AND at_ms % 7 <> 0 AS sex_act, at_ms % 2 = 0 AS kissing, false AS female_topless,
  'at ' || at_ms AS description FROM samples""")
def score_samples(spark, sf):
    bare = v.samples(spark, sf).drop(*OBSERVATIONS, "description")
    return visual.score_samples(bare, _load_stub).select("media_id", "shot_index", "at_ms", "sex_act", "kissing", "female_topless", "description")


SQL["sample_plan"] = """
sample_plan AS (SELECT media_id, shot_index, i::INT AS sample_idx, start_s + least(0.25::DOUBLE, span / 10) + (span - 2 * least(0.25::DOUBLE, span / 10)) * i / (n - 1) AS at_s
  FROM (SELECT *, unnest(range(n)) AS i FROM (SELECT media_id, shot_index, start_s, end_s - start_s AS span,
    greatest(floor((end_s - start_s) / 2.5::DOUBLE)::BIGINT + CASE WHEN end_s - start_s > 2.5::DOUBLE THEN 1 ELSE 0 END, 2) AS n FROM shots_s)))"""


@query("pending_samples", "shots_s sample_plan", """
SELECT media_id, shot_index, sample_idx, at_s, shot_index || ':' || printf('%.2f', at_s) AS sample_key FROM sample_plan WHERE NOT (sample_idx = 0 AND shot_index % 2 = 0)""")
def pending_samples(spark, sf):
    """First samples are done, by this model for even shots and by an older one for the others."""
    plan = visual.sample_plan(v.shots_s(spark, sf))
    done = plan.where("sample_idx = 0").select(
        "media_id", visual.sample_key(F.col("shot_index"), F.col("at_s")).alias("sample_key"),
        F.when(F.col("shot_index") % 2 == 0, "m1").otherwise("m0").alias("model"), F.lit("d").alias("digest"))
    return visual.pending_samples(plan, done, "m1", "d")


SQL["planned"] = """
planned AS (SELECT v.media_id, v.seq, s.start_ms, s.end_ms, CASE upper(category) WHEN 'NUDITY' THEN 'nudity' WHEN 'PARTIAL_NUDITY' THEN 'nudity'
    WHEN 'KISSING' THEN 'intense_kissing' WHEN 'COMPOSITE' THEN 'sexual_activity' ELSE coalesce(lower(category), 'unknown') END AS category, confidence,
    v.shot_index::VARCHAR AS engine_ref, row_number() OVER (PARTITION BY v.media_id ORDER BY v.seq, v.shot_index) AS id
  FROM verdicts v JOIN shots s ON v.media_id = s.media_id AND v.shot_index = s.shot_index WHERE upper(coalesce(action, 'NONE')) <> 'NONE')"""


@query("plan_verdict_join", "shots verdicts planned", "SELECT media_id, id, start_ms, end_ms, category, confidence, engine_ref FROM planned")
def plan_verdict_join(spark, sf):
    return visual.plan_verdict_join(v.verdicts(spark, sf).withColumn("reasoning", F.lit(None).cast("string")), v.shots(spark, sf)).select(
        "media_id", "id", "start_ms", "end_ms", "category", "confidence", "engine_ref")


@query("whitelist_rejected", "verdicts", """
SELECT media_id, seq, shot_index, CASE WHEN (media_id + shot_index) % 3 = 1 AND shot_index < 1000 THEN 'NONE' ELSE action END AS action FROM verdicts""")
def whitelist_rejected(spark, sf):
    shots = v.shots(spark, sf)
    reviewed = shots.select("media_id", F.col("shot_index").cast("string").alias("engine_ref"),
                            v._pick((F.col("media_id") + F.col("shot_index")) % 3, [(0, True), (1, False)]).alias("approved"))
    return visual.whitelist_rejected(v.verdicts(spark, sf), reviewed).select("media_id", "seq", "shot_index", "action")


@query("frame_action_join", "shots_s verdicts", """
WITH v AS (SELECT media_id, seq, action, start_frame, end_frame FROM verdicts JOIN shots_s USING (media_id, shot_index)
  WHERE coalesce(action, 'NONE') <> 'NONE' AND end_frame > start_frame),
f AS (SELECT media_id, seq, action, unnest(range(start_frame, end_frame)) AS frame FROM v),
g AS (SELECT media_id, frame, CASE WHEN bool_or(action = 'FULL_FRAME_BLUR') THEN 'FULL_FRAME_BLUR' ELSE 'BLACK_BOX' END AS action,
    min(seq) FILTER (action = 'FULL_FRAME_BLUR') AS full_seq FROM f GROUP BY media_id, frame),
b AS (SELECT media_id, start_frame + seq % 3 AS frame, seq, seq % 640 AS x1 FROM v WHERE action = 'BLACK_BOX' AND start_frame + seq % 3 < end_frame)
SELECT g.media_id, g.action, count(*) AS n, count(DISTINCT g.frame) AS frames, sum(g.frame)::BIGINT AS frame_sum, count(b.seq) AS boxes, sum(b.seq % 1000003)::BIGINT AS seq_sum,
  sum(b.x1)::BIGINT AS x_sum FROM g LEFT JOIN b ON g.media_id = b.media_id AND g.frame = b.frame AND (full_seq IS NULL OR b.seq < full_seq) GROUP BY g.media_id, g.action""")
def frame_action_join(spark, sf):
    shots = v.shots_s(spark, sf).select("media_id", "shot_index", "start_frame", "end_frame")
    seq = F.col("seq")
    box = F.struct((F.col("start_frame") + seq % 3).alias("frame_idx"), (seq % 640).alias("x1"), F.lit(0).cast("bigint").alias("y1"),
                   (seq % 640 + 10).alias("x2"), F.lit(10).cast("bigint").alias("y2"))
    boxed = v.verdicts(spark, sf).join(shots.drop("end_frame"), ["media_id", "shot_index"]).withColumn("boxes", F.array(box)).drop("start_frame")
    frames = visual.frame_action_join(boxed, shots)
    return frames.groupBy("media_id", "action").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("nth") == 1).alias("frames"), F.sum("frame").alias("frame_sum"), F.count("seq").alias("boxes"),
        F.sum(F.col("seq") % 1000003).alias("seq_sum"), F.sum("x1").alias("x_sum"))
