"""Ids, decisions and edits."""

import pytest
from conftest import rows
from pyspark.sql import functions as F

from spanweave.operators import jobs as jb
from spanweave.operators import library as lb
from spanweave.operators import media as md
from spanweave.operators import reconcile as rc
from spanweave.operators import visual
from spanweave.plans import detectors
from spanweave.schema import FINDING

CANON = [
    (1, 1, 1000, 2000, "gore", 0.9, "vlm", "blur", None, "x", "shot-1"), (1, 2, 3000, 4000, "nudity", 0.9, "vlm", "skip", True, "y", "shot-2"),
    (1, 3, 5000, 6000, "profanity", 1.0, "subtitles", "mute", False, "[damn] a", None), (1, 4, 7000, 8000, "profanity", 1.0, "subtitles", "mute", None, "[hell] b", None),
    (1, 5, 9000, 9900, "suggestive", 0.5, "manual", "skip", True, "z", None)]


@pytest.fixture
def findings(spark):
    return spark.createDataFrame(CANON, FINDING)


def test_reanalysis_keeps_what_did_not_run(spark, findings):
    fresh = spark.createDataFrame([
        (1, 3100, 4100, "nudity", 0.8, "vlm", "skip", None, "new", "shot-2", 1), (1, 500, 600, "gore", 0.8, "vlm", "blur", None, "new", "shot-9", 2),
        (2, 1, 2, "gore", 0.8, "vlm", "blur", None, "new", None, 1)],
        "media_id long, start_ms long, end_ms long, category string, confidence double, engine string, action string, approved boolean, "
        "reasoning string, engine_ref string, seq long")
    floors = spark.createDataFrame([(1, 100)], "media_id long, next_segment_id long")
    got = rows(rc.merge_reanalysis(findings, fresh, ["vlm", "manual"], floors), "media_id", "id", "engine", "approved")
    assert got == sorted([(1, 3, "subtitles", False), (1, 4, "subtitles", None), (1, 5, "manual", True), (1, 100, "vlm", True), (1, 101, "vlm", None),
                          (2, 1, "vlm", None)], key=lambda t: tuple((x is not None, x) for x in t))


def test_edits(spark, findings):
    edits = spark.createDataFrame([
        (1, 1, 1, ["approved"], True, None, None), (1, 1, 2, ["approved"], None, None, None), (1, 2, 3, ["start_ms"], None, 9000, None),
        (1, 3, 4, ["action"], None, None, None), (1, 4, 5, ["end_ms", "action"], None, None, "skip"), (9, 9, 6, ["approved"], True, None, None)],
        "media_id long, id long, seq long, fields_sent array<string>, approved boolean, start_ms long, action string").withColumn("end_ms", F.lit(-4).cast("long"))
    got = {r[0]: r[1:] for r in rows(rc.apply_edits(findings, edits), "id", "start_ms", "end_ms", "action", "approved")}
    assert got == {1: (1000, 2000, "blur", None), 2: (4000, 9000, "skip", True), 3: (5000, 6000, "mute", False), 4: (0, 7000, "skip", None), 5: (9000, 9900, "skip", True)}


def test_spans_are_put_in_order_after_each_edit(spark, findings):
    edits = spark.createDataFrame([(1, 1, 1, ["start_ms"], 2100, None), (1, 1, 2, ["end_ms"], None, 2070), (1, 2, 3, ["start_ms", "end_ms"], 9, 5), (1, 2, 4, ["start_ms"], None, None)],
                                  "media_id long, id long, seq long, fields_sent array<string>, start_ms long, end_ms long")
    got = {r.id: (r.start_ms, r.end_ms) for r in rc.apply_edits(findings, edits).collect()}
    assert got[1] == (2000, 2070) and got[2] == (5, 9)


def test_every_cut_counts(spark, findings):
    cuts = spark.createDataFrame([(1, 3300), (1, 3500), (1, 3700)], "media_id long, t_ms long")
    got = {r.id: (r.start_ms, r.end_ms) for r in rc.split_findings(findings, cuts).collect()}
    assert got[2] == (3000, 3300) and [got[i] for i in (6, 7, 8)] == [(3300, 3500), (3500, 3700), (3700, 4000)]


def test_paged_headers_and_films_without_findings(spark, findings):
    from spanweave.sources import readers as rd
    from spanweave.sources import sinks as sk
    headers = spark.createDataFrame([(1, "fp", 50), (2, "empty", 7)], "media_id long, fingerprint string, next_segment_id long")
    back, heads = rd.parse_timelines(sk.timeline_json(sk.nest_timeline(findings, headers, page=2)))
    assert rows(heads) == [(1, "fp", 50), (2, "empty", 7)] and back.count() == findings.count()
    assert rows(rc.next_ids(findings, heads.union(heads))) == [(1, 50), (2, 7)]


def test_merge_split_create_delete(spark, findings):
    picks = spark.createDataFrame([(1, 1, 1), (1, 1, 2), (1, 2, 5), (1, 2, 77)], "media_id long, merge_id long, id long")
    merged = {r.id: r for r in rc.merge_into_one(findings, picks).collect()}
    assert sorted(merged) == [3, 4, 5, 6]
    one = merged[6]
    assert (one.start_ms, one.end_ms, one.category, one.approved, one.reasoning) == (1000, 4000, "gore", True, "merged 2 findings (#1, #2)")
    assert rc.mergeable_groups(findings, picks).count() == 0
    cuts = spark.createDataFrame([(1, 3500), (1, 5050)], "media_id long, t_ms long")
    split = {r.id: (r.start_ms, r.end_ms, r.approved) for r in rc.split_findings(findings, cuts).collect()}
    assert split[2] == (3000, 3500, True) and split[6] == (3500, 4000, True) and split[3] == (5000, 6000, False) and len(split) == 6
    assert rows(rc.delete_findings(findings, picks), "id") == [(3,), (4,)]
    asked = spark.createDataFrame([(1, 50, -10, "manual", "skip", 1)], "media_id long, start_ms long, end_ms long, category string, action string, seq long")
    made = rc.create_findings(findings, asked).where("id = 6").first()
    assert (made.start_ms, made.end_ms, made.approved, made.engine) == (0, 50, True, "manual")
    assert rows(rc.bulk_by_type(findings, "damn", None).where("id = 3"), "approved") == [(None,)]


def test_scenes(spark):
    flagged = spark.createDataFrame([(m, i, "nudity", 1.0, "d") for m, group in {1: [5, 6, 7], 2: [125, 127], 3: [10, 60], 4: [10, 14]}.items() for i in group],
                                    "media_id long, shot_index long, category string, confidence double, description string")
    scenes = visual.group_scenes(flagged)
    assert rows(scenes.groupBy("media_id").agg(F.count_distinct("scene").alias("n"))) == [(1, 1), (2, 1), (3, 2), (4, 2)]
    shots = spark.range(0, 200).selectExpr("explode(array(1,2,3,4)) as m", "id").selectExpr(
        "cast(m as bigint) media_id", "id as shot_index", "id * 1000 as start_ms", "id * 1000 + 1000 as end_ms")
    found = {(r.media_id, r.scene): r for r in visual.scene_findings(scenes, shots).collect()}
    one = found[1, 5]
    assert (one.start_ms, one.end_ms, one.engine_ref, one.reasoning) == (4000, 9000, "5,6,7", "shots 5-7 (3 flagged): d")
    assert found[3, 60].reasoning == "shot 60 (1 flagged): d"


def test_rescale(spark):
    shots = spark.createDataFrame([(1, 0, 0, 9, 0.0, 400.0), (1, 1, 9, 18, 400.0, 800.0), (2, 0, 0, 9, 0.0, 500.0), (3, 0, 0, 9, 0.0, 1250.0)],
                                  "media_id long, shot_index long, start_frame long, end_frame long, start_s double, end_s double")
    known = spark.createDataFrame([(m, 1000.0, 24000) for m in (1, 2, 3, 4)], "media_id long, duration_s double, frames long")
    good, bad = visual.rescale_timeline(shots, known)
    assert rows(bad, "media_id") == [(2,)]
    assert rows(good, "media_id", "shot_index", "end_frame", "end_s") == [(1, 0, 9, 500.0), (1, 1, 18, 1000.0), (3, 0, 9, 1000.0), (4, 0, 24000, 1000.0)]


def test_streams_and_jobs(spark):
    streams = spark.createDataFrame([(1, 2, "dvd_subtitle", "eng", 12), (1, 6, "dvd_subtitle", "eng", 1333), (1, 7, "dvd_subtitle", "spa", 1996), (2, 1, "dvd_subtitle", "eng", 12),
                                     (3, 4, "subrip", "spa", 1), (3, 5, "ass", "ENG", 1)], "media_id long, index long, codec string, language string, packets long")
    assert rows(md.pick_image_stream(streams)) == [(1, 6), (2, None)]
    assert rows(md.pick_text_stream(streams)) == [(3, 5)]
    jobs = spark.createDataFrame([("a", "/x/Film.mkv", "vlm", "queued", 3), ("b", "/y/film.MKV", "vlm", "running", 1), ("c", "/x/Film.mkv", "subtitles", "completed", 2),
                                  ("d", "/x/Other.mkv", "render", "failed", 5)], "id string, media_path string, engine string, status string, at int").selectExpr(
        "*", "timestamp_seconds(at) as created_at", "cast(null as bigint) as queue_position", "'f' as fingerprint")
    assert rows(jb.headline_job(jobs), "name", "job_id") == [("film.mkv", "b"), ("other.mkv", "d")]
    assert rows(jb.engines_done(jobs)) == [("film.mkv", "subtitles"), ("other.mkv", "")]
    assert rows(jb.queue_rank(jobs), "rank", "id") == [(1, "b"), (2, "c"), (3, "a"), (4, "d")]
    assert jb.next_runnable(jobs, True).first().id == "a" and jb.next_runnable(jobs, False).count() == 0


def test_library(spark):
    files = spark.createDataFrame([(0, "/m/Films/Alpha.mkv"), (0, "/m/Films/Alpha.timeline.json"), (1, "/n/Films/alpha.mkv"), (0, "/m/Kids/Beta.mp4"), (0, "/m/Kids/Beta (Clean).mp4"),
                                   (0, "/m/Films/Alpha.eng.srt"), (0, "/m/Films/Alpha.srt")], "root_idx int, path string")
    assert rows(lb.discover_media(files)) == [("/m/Films/Alpha.mkv",), ("/m/Kids/Beta.mp4",), ("/n/Films/alpha.mkv",)]
    assert rows(lb.preferred_sidecar_sub(files.where("path like '%mkv'"), files)) == [("/m/Films/Alpha.mkv", "/m/Films/Alpha.eng.srt")]
    asked = spark.createDataFrame([("Z:\\q\\BETA.mp4",), ("/m/Films/Alpha.mkv",), ("/none.mkv",)], "path string")
    assert rows(lb.resolve_path(asked, files)) == [("/m/Films/Alpha.mkv", "/m/Films/Alpha.mkv"), ("/none.mkv", None), ("Z:\\q\\BETA.mp4", "/m/Kids/Beta.mp4")]
    counts = spark.createDataFrame([("/m/Films/Alpha.mkv", 4, 2)], "path string, total long, pending long")
    summary = lb.film_summary(lb.films(files), counts)
    page, total = lb.library_view(summary)
    assert rows(page, "stem", "status") == [("Alpha", "in_progress")] and total.first()[0] == 1
    assert rows(lb.library_view(summary, "bt")[0], "stem", "collection", "status") == [("Beta", "Kids", "unanalyzed")]
    stems = spark.createDataFrame([("Iron Man (2008)",), ("Iron Man 2 (2010)",), ("Iron Man",)], "stem string")
    owned = spark.createDataFrame([(1, "Iron Man 2 (2010).en.srt"), (2, "iron man.mkv"), (3, "Other.mkv")], "file_id long, name string")
    assert rows(lb.assign_owner(owned, stems), "file_id", "owner") == [(1, "Iron Man 2 (2010)"), (2, "Iron Man"), (3, None)]


def test_detector_registry(spark):
    cues = spark.createDataFrame([(1, 0, 0, 10_000, "you are such a stupid person today"), (1, 1, 20_000, 21_000, "Damn!"), (2, 0, 0, 900, "hello")],
                                 "media_id long, cue_idx long, start_ms long, end_ms long, text string")
    got = rows(detectors.run_detectors(["subtitles"], {"cues": cues}, {"include_mild": True}), "start_ms", "end_ms", "confidence", "reasoning")
    at = 0 + 10_000 * 15 // 34
    assert got == [(at - 70, at + 10_000 * 6 // 34 + 70, 0.5, "[stupid] you are such a stupid person today (estimated)"),
                   (19_930, 21_070, 1.0, "[damn] Damn! (single-word-cue)")]
    with pytest.raises(ValueError, match="unknown detector"):
        detectors.run_detectors(["nope"], {})


def test_job_timelines_number_nulls_and_ties_without_a_total_order(spark):
    findings = spark.createDataFrame(
        [("a", 1, 7_200_000), ("a", 2, None), ("b", 1, None), ("b", 2, 5), ("b", 3, -3_700_000), ("c", 1, 5), ("c", 2, 7_200_000), ("d", 1, 1), ("e", 1, 1)],
        "job_id string, id long, start_ms long")
    jobs = spark.createDataFrame([("a", "f", 1), ("b", "f", 3), ("c", "f", None), ("d", None, 1), ("e", "g", 1)], "job_id string, fingerprint string, created_at long")
    found = rc.union_job_timelines(findings, jobs, spark.createDataFrame([("g",)], "fingerprint string"))
    assert rows(found, "id", "job_id", "source_id", "start_ms") == [
        (1, "b", 1, None), (2, "a", 2, None), (3, "b", 3, -3_700_000), (4, "b", 2, 5), (5, "c", 1, 5), (6, "a", 1, 7_200_000), (7, "c", 2, 7_200_000)]
    # Rows are compared with those of their own timeline, not with split points of all.
    assert "CartesianProduct" not in plan_of(found) and "BroadcastNestedLoopJoin" not in plan_of(found)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()
