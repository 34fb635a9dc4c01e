"""Reconciliation, review reports, jobs and the library."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanweave.operators import jobs as jb
from spanweave.operators import library as lb
from spanweave.operators import reconcile as rc
from spanweave.plans import detectors
from spanweave.session import scratch_path
from spanweave.sources import sinks as sk
from workload import views as v
from workload.registry import query
from workload.scalar_queries import _TYPE
from workload.visual_queries import SQL as _VISUAL  # noqa: F401  (scene views for the detector registry)

SQL = v.SQL
_COLS = "media_id, id, start_ms, end_ms, category, confidence, engine, action, approved, reasoning, engine_ref"
_NO_ID = _COLS.replace(" id,", "")


def floors(spark, sf):
    """High-water marks of half the media; the others derive theirs."""
    return v.media(spark, sf).where("media_id % 2 = 0").select("media_id", (F.col("media_id") * 100 + 5000).alias("next_segment_id"))


SQL["floors"] = "floors AS (SELECT media_id, media_id * 100 + 5000 AS next_segment_id FROM media WHERE media_id % 2 = 0)"


def free_sql(name: str, kept: str) -> str:
    return f"""
{name} AS (SELECT media_id, greatest(coalesce(max(id), 0) + 1, coalesce(any_value(next_segment_id), 0)) AS next_id
  FROM (SELECT DISTINCT media_id FROM findings) LEFT JOIN {kept} USING (media_id) LEFT JOIN floors USING (media_id) GROUP BY media_id)"""


SQL["free"] = free_sql("free", "prior")


@query("assign_ids", "findings media prior_fresh floors free", f"""
SELECT media_id, next_id + row_number() OVER (PARTITION BY media_id ORDER BY seq) - 1 AS id, {_NO_ID[10:]} FROM fresh JOIN free USING (media_id)""")
def assign_ids(spark, sf):
    return rc.assign_ids(v.fresh(spark, sf), v.prior(spark, sf), floors(spark, sf))


SQL["carried"] = """
told AS (SELECT media_id, engine, engine_ref, category, max_by(approved, (start_ms, id)) AS prior_approved FROM prior
  WHERE engine_ref IS NOT NULL AND approved IS NOT NULL GROUP BY ALL),
carried AS (SELECT f.* REPLACE (coalesce(prior_approved, f.approved) AS approved) FROM fresh f LEFT JOIN told t ON f.media_id = t.media_id AND f.engine = t.engine
  AND f.engine_ref = t.engine_ref AND f.category = t.category)"""


@query("carry_decisions", "findings prior_fresh carried", "SELECT * FROM carried")
def carry_decisions(spark, sf):
    return rc.carry_decisions(v.fresh(spark, sf), v.prior(spark, sf))


SQL["kept"] = "kept AS (SELECT * FROM prior WHERE engine <> 'vlm')"
SQL["free_kept"] = free_sql("free_kept", "kept")


@query("merge_reanalysis", "findings media prior_fresh floors carried kept free_kept", f"""
SELECT {_COLS} FROM kept UNION ALL
SELECT media_id, next_id + row_number() OVER (PARTITION BY media_id ORDER BY seq) - 1 AS id, {_NO_ID[10:]} FROM carried JOIN free_kept USING (media_id)""")
def merge_reanalysis(spark, sf):
    return rc.merge_reanalysis(v.prior(spark, sf), v.fresh(spark, sf), ["vlm"], floors(spark, sf))


@query("skip_done_engines", "findings", """
SELECT m.media_id, e.engine FROM (SELECT DISTINCT media_id FROM findings) m, (SELECT unnest(['subtitles', 'vlm', 'whisper']) AS engine) e
WHERE NOT EXISTS (SELECT 1 FROM findings f WHERE f.media_id = m.media_id AND f.engine = e.engine)""")
def skip_done_engines(spark, sf):
    return rc.skip_done_engines(v.media(spark, sf), ["subtitles", "vlm", "whisper"], v.findings(spark, sf))


@query("apply_edits", "findings edits", f"""
WITH last_of AS (SELECT media_id, id,
    max_by((approved,), seq) FILTER (kind IN (0, 3)) AS a, max_by((start_ms, end_ms), seq) FILTER (kind = 1) AS t,
    max_by(action, seq) FILTER (kind = 2 AND action IS NOT NULL) AS act, bool_or(kind = 2) AS cat, bool_or(kind = 3) AS note
  FROM edits GROUP BY media_id, id),
set_to AS (SELECT f.*, CASE WHEN t IS NOT NULL THEN greatest(t[1], 0) ELSE f.start_ms END AS s, CASE WHEN t IS NOT NULL THEN greatest(t[2], 0) ELSE f.end_ms END AS e,
    a, act, cat, note FROM findings f LEFT JOIN last_of l ON l.media_id = f.media_id AND l.id = f.id)
SELECT media_id, id, least(s, e) AS start_ms, greatest(s, e) AS end_ms, CASE WHEN cat THEN 'gore' ELSE category END AS category, confidence, engine,
  coalesce(act, action) AS action, CASE WHEN a IS NOT NULL THEN a[1] ELSE approved END AS approved, CASE WHEN note THEN '' ELSE reasoning END AS reasoning, engine_ref
FROM set_to""")
def apply_edits(spark, sf):
    return rc.apply_edits(v.findings(spark, sf), v.edits(spark, sf))


@query("set_approvals", "findings picks", f"""
SELECT media_id, id, CASE WHEN id % 4 < 3 THEN false ELSE approved END AS approved FROM findings""")
def set_approvals(spark, sf):
    return rc.set_approvals(v.findings(spark, sf), v.picks(spark, sf), False).select("media_id", "id", "approved")


@query("bulk_by_type", "findings", f"SELECT id, CASE WHEN {_TYPE} = 'w2' THEN true ELSE approved END AS approved FROM findings")
def bulk_by_type(spark, sf):
    return rc.bulk_by_type(v.findings(spark, sf), "w2", True).select("id", "approved")


@query("delete_findings", "findings", f"SELECT {_COLS} FROM findings WHERE id % 4 = 3")
def delete_findings(spark, sf):
    return rc.delete_findings(v.findings(spark, sf), v.picks(spark, sf))


SQL["free_all"] = free_sql("free_all", "findings")


@query("create_findings", "findings media floors flags free_all", f"""
SELECT {_COLS} FROM findings UNION ALL
SELECT media_id, next_id + row_number() OVER (PARTITION BY media_id ORDER BY flag_id) - 1 AS id, greatest(t_ms - 1500, 0), t_ms + 1500, 'manual', 1.0::DOUBLE, 'manual',
  'skip', true, 'Flagged', NULL FROM flags JOIN free_all USING (media_id)""")
def create_findings(spark, sf):
    asked = v.flags(spark, sf).select("media_id", (F.col("t_ms") + 1500).alias("start_ms"), (F.col("t_ms") - 1500).alias("end_ms"), F.lit("manual").alias("category"),
                                      F.lit("skip").alias("action"), F.lit("Flagged").alias("reasoning"), F.col("flag_id").alias("seq"))
    return rc.create_findings(v.findings(spark, sf), asked, floors(spark, sf))


SQL["merged"] = """
chosen AS (SELECT f.*, merge_id FROM findings f JOIN picks USING (media_id, id)),
grouped AS (SELECT media_id, merge_id, count(*) AS n, min(start_ms) AS start_ms, max(end_ms) AS end_ms, first(category ORDER BY CASE category WHEN 'nudity' THEN 5
    WHEN 'suggestive' THEN 2 WHEN 'profanity' THEN 1 ELSE 0 END DESC, start_ms, id) AS category, string_agg('#' || id, ', ' ORDER BY start_ms, id) AS labels
  FROM chosen GROUP BY media_id, merge_id HAVING count(*) >= 2),
rest AS (SELECT f.* FROM findings f WHERE NOT EXISTS (SELECT 1 FROM chosen c JOIN grouped g USING (media_id, merge_id) WHERE c.media_id = f.media_id AND c.id = f.id))"""
SQL["free_rest"] = free_sql("free_rest", "rest")


@query("merge_into_one", "findings media floors picks merged free_rest", f"""
SELECT {_COLS} FROM rest UNION ALL
SELECT media_id, next_id + row_number() OVER (PARTITION BY media_id ORDER BY merge_id) - 1, start_ms, end_ms, category, 1.0::DOUBLE, 'manual', 'skip', true,
  'merged ' || n || ' findings (' || labels || ')', NULL FROM grouped JOIN free_rest USING (media_id)""")
def merge_into_one(spark, sf):
    return rc.merge_into_one(v.findings(spark, sf), v.picks(spark, sf), floors=floors(spark, sf))


@query("mergeable_groups", "findings", """
SELECT media_id, start_ms // 43200000 AS merge_id, count(*) AS n, min(category) AS category FROM findings
GROUP BY media_id, start_ms // 43200000 HAVING count(*) >= 2 AND count(DISTINCT category) = 1""")
def mergeable_groups(spark, sf):
    found = v.findings(spark, sf)
    return rc.mergeable_groups(found, found.select("media_id", F.expr("start_ms div 43200000").alias("merge_id"), "id"))


SQL["split"] = """
struck AS (SELECT media_id, id, t_ms AS cut_ms, lead(t_ms) OVER (PARTITION BY media_id, id ORDER BY t_ms) AS next_ms, min(t_ms) OVER (PARTITION BY media_id, id) AS first_ms FROM (SELECT c.media_id, c.t_ms, first(f.id ORDER BY f.start_ms, f.id) AS id
    FROM (SELECT DISTINCT media_id, t_ms + 3600000 AS t_ms FROM flags) c JOIN findings f ON f.media_id = c.media_id AND c.t_ms > f.start_ms + 100 AND c.t_ms < f.end_ms - 100
    GROUP BY c.media_id, c.t_ms))"""


@query("split_findings", "findings media floors flags split free_all", f"""
SELECT {_COLS.replace('end_ms', 'coalesce(first_ms, end_ms) AS end_ms', 1)} FROM findings LEFT JOIN (SELECT DISTINCT media_id, id, first_ms FROM struck) USING (media_id, id) UNION ALL
SELECT media_id, next_id + row_number() OVER (PARTITION BY media_id ORDER BY cut_ms, id) - 1, cut_ms, coalesce(next_ms, end_ms), category, 1.0::DOUBLE, 'manual', action, approved,
  reasoning, NULL FROM findings JOIN struck USING (media_id, id) JOIN free_all USING (media_id)""")
def split_findings(spark, sf):
    cuts = v.flags(spark, sf).select("media_id", (F.col("t_ms") + 3_600_000).alias("t_ms"))
    return rc.split_findings(v.findings(spark, sf), cuts, floors(spark, sf))


@query("union_job_timelines", "findings", """
SELECT 'fp-' || (media_id % 97) AS fingerprint, id AS source_id, row_number() OVER (PARTITION BY media_id % 97 ORDER BY start_ms, media_id::VARCHAR, id) AS id, start_ms
FROM findings WHERE media_id % 97 > 9""")
def union_job_timelines(spark, sf):
    """A media is a job; jobs share fingerprints; the first ten fingerprints have a timeline of their own."""
    found = v.findings(spark, sf).withColumn("job_id", F.col("media_id").cast("string"))
    fingerprint = F.concat(F.lit("fp-"), (F.col("media_id") % 97).cast("string")).alias("fingerprint")
    owners = v.media(spark, sf).select(F.col("media_id").cast("string").alias("job_id"), fingerprint)
    sidecars = v.media(spark, sf).where("media_id % 97 <= 9").select(fingerprint).distinct()
    return rc.union_job_timelines(found, owners, sidecars).select("fingerprint", "source_id", "id", "start_ms")


@query("findings_by_time", "findings", "SELECT media_id, start_ms, id FROM findings ORDER BY media_id, start_ms, id")
def findings_by_time(spark, sf):
    return rc.findings_by_time(v.findings(spark, sf).select("media_id", "start_ms", "id"))


@query("register_detector", "findings", f"SELECT {_NO_ID}, id * 2 AS seq FROM findings UNION ALL SELECT {_NO_ID}, id * 2 + 1 FROM findings WHERE action = 'skip'")
def register_detector(spark, sf):
    """Two user detectors, registered and run together."""
    detectors.register_detector("replay", lambda tables, _: tables["findings"].withColumnRenamed("id", "seq"))
    detectors.register_detector("only", lambda tables, options: tables["findings"].where(F.col("action") == options["action"]).withColumnRenamed("id", "seq"))
    return detectors.run_detectors(["replay", "only"], {"findings": v.findings(spark, sf)}, {"action": "skip"})


# -- reports ----------------------------------------------------------------------------------------

@query("review_counts", "findings", """
SELECT media_id, count(*) AS total, count(*) FILTER (approved) AS approved, count(*) FILTER (NOT approved) AS rejected, count(*) FILTER (approved IS NULL) AS pending
FROM findings GROUP BY media_id""")
def review_counts(spark, sf):
    return lb.review_counts(v.findings(spark, sf))


@query("review_progress", "findings", """
SELECT media_id, c AS cut, l AS leave, u AS undecided, c * 100 / n::DOUBLE AS cut_pct, l * 100 / n::DOUBLE AS leave_pct, u * 100 / n::DOUBLE AS undecided_pct
FROM (SELECT media_id, count(*) AS n, count(*) FILTER (approved) AS c, count(*) FILTER (NOT approved) AS l, count(*) FILTER (approved IS NULL) AS u FROM findings GROUP BY media_id)""")
def review_progress(spark, sf):
    return lb.review_progress(v.findings(spark, sf))


@query("type_counts", "findings", f"SELECT media_id, {_TYPE} AS type, count(*) AS n FROM findings GROUP BY ALL")
def type_counts(spark, sf):
    return lb.type_counts(v.findings(spark, sf))


@query("action_counts", "findings", """
SELECT media_id, count(*) FILTER (action = 'blur') AS n_blur, count(*) FILTER (action = 'mute') AS n_mute, count(*) FILTER (action = 'skip') AS n_skip,
  count(*) FILTER (action = 'voice') AS n_voice FROM findings GROUP BY media_id""")
def action_counts(spark, sf):
    return lb.action_counts(v.findings(spark, sf))


# -- jobs -------------------------------------------------------------------------------------------

_ACTIVE = "status IN ('running', 'rendering', 'queued')"
_RANK = "CASE status WHEN 'running' THEN 0 WHEN 'rendering' THEN 1 WHEN 'queued' THEN 2 END"
_NAME = "lower(split_part(media_path, '/', -1))"


@query("engines_done", "jobs", f"""
SELECT {_NAME} AS name, coalesce(string_agg(DISTINCT engine, ',' ORDER BY engine) FILTER (status IN ('completed', 'rendered') AND engine <> 'render'), '') AS engines_done
FROM jobs GROUP BY 1""")
def engines_done(spark, sf):
    return jb.engines_done(v.jobs(spark, sf))


SQL["headline"] = f"""
headline AS (SELECT {_NAME} AS name, id AS job_id, status, engine, row_number() OVER (PARTITION BY {_NAME} ORDER BY coalesce({_RANK}, 3), created_at DESC, id) AS r FROM jobs)"""


@query("headline_job", "jobs headline", "SELECT name, job_id, status, engine FROM headline WHERE r = 1")
def headline_job(spark, sf):
    return jb.headline_job(v.jobs(spark, sf))


@query("active_jobs", "jobs", f"SELECT {_NAME} AS name, {_RANK} AS rank, id, status, engine FROM jobs WHERE {_ACTIVE}")
def active_jobs(spark, sf):
    return jb.active_jobs(v.jobs(spark, sf)).select("name", "rank", "id", "status", "engine")


@query("queue_depth", "jobs", "SELECT count(*) AS depth FROM jobs WHERE status IN ('queued', 'rendering') AND id <> '7' AND fingerprint <> 'fp-5'")
def queue_depth(spark, sf):
    all_jobs = v.jobs(spark, sf)
    return jb.queue_depth(all_jobs, "7", all_jobs.where("fingerprint = 'fp-5'"))


@query("jobs_by_type", "jobs", """
SELECT engine, count(*) AS jobs, count(*) FILTER (status IN ('running', 'rendering')) AS active, count(*) FILTER (status IN ('queued', 'rendering')) AS pending,
  count(*) FILTER (status IN ('completed', 'failed', 'cancelled', 'rendered')) AS terminal FROM jobs GROUP BY engine""")
def jobs_by_type(spark, sf):
    return jb.jobs_by_type(v.jobs(spark, sf))


@query("queue_rank", "jobs", "SELECT id, row_number() OVER (ORDER BY queue_position NULLS LAST, created_at, id) AS rank FROM jobs")
def queue_rank(spark, sf):
    return jb.queue_rank(v.jobs(spark, sf)).select("id", "rank")


@query("allocate_positions", "jobs", """
SELECT id, (SELECT max(queue_position) FROM jobs) + row_number() OVER (ORDER BY created_at, id) AS queue_position FROM jobs WHERE queue_position IS NULL""")
def allocate_positions(spark, sf):
    all_jobs = v.jobs(spark, sf)
    return jb.allocate_positions(all_jobs, all_jobs.where("queue_position is null")).select("id", "queue_position")


@query("next_runnable", "jobs", """
SELECT id, status FROM jobs WHERE status = 'rendering' AND fingerprint <> 'fp-5' ORDER BY queue_position NULLS LAST, created_at, id LIMIT 1""")
def next_runnable(spark, sf):
    all_jobs = v.jobs(spark, sf)
    return jb.next_runnable(all_jobs, False, all_jobs.where("fingerprint = 'fp-5'")).select("id", "status")


@query("next_runnable_at", "jobs schedule gated", """
SELECT event_id, allowed, CASE WHEN allowed THEN (SELECT first(id ORDER BY queue_position NULLS LAST, created_at, id) FROM jobs WHERE status IN ('queued', 'rendering'))
  ELSE (SELECT first(id ORDER BY queue_position NULLS LAST, created_at, id) FROM jobs WHERE status = 'rendering') END AS job_id FROM gated""")
def next_runnable_at(spark, sf):
    return jb.next_runnable_at(v.jobs(spark, sf), v.instants(spark, sf), v.SCHEDULE).select("event_id", "allowed", "job_id")


@query("jobs_newest_first", "jobs", "SELECT id, engine, status FROM jobs ORDER BY created_at DESC, id DESC")
def jobs_newest_first(spark, sf):
    return jb.jobs_newest_first(v.jobs(spark, sf)).select("id", "engine", "status")


@query("recent_terminal", "jobs", "SELECT id, engine, status FROM jobs WHERE status IN ('completed', 'failed', 'cancelled', 'rendered') ORDER BY created_at DESC, id DESC")
def recent_terminal(spark, sf):
    return jb.recent_terminal(v.jobs(spark, sf)).select("id", "engine", "status")


@query("reuse_by_fingerprint", "jobs", """
SELECT r.id, d.id AS reused_id FROM (SELECT id, fingerprint, engine FROM jobs WHERE status = 'queued') r LEFT JOIN (SELECT fingerprint, engine,
  first(id ORDER BY created_at DESC, id DESC) AS id FROM jobs WHERE status IN ('completed', 'rendered') GROUP BY ALL) d USING (fingerprint, engine)""")
def reuse_by_fingerprint(spark, sf):
    all_jobs = v.jobs(spark, sf)
    asked = all_jobs.where("status = 'queued'").select("id", "fingerprint", "engine")
    return jb.reuse_by_fingerprint(asked, all_jobs).select("id", "reused_id")


@query("upsert_latest", "jobs", f"""
SELECT name, first(id ORDER BY created_at DESC, id DESC) AS id, first(status ORDER BY created_at DESC, id DESC) AS status FROM (SELECT *, {_NAME} AS name FROM jobs) GROUP BY name""")
def upsert_latest(spark, sf):
    rows = jb.with_name(v.jobs(spark, sf)).select("name", "id", "status", "created_at")
    return jb.upsert_latest(rows, ["name"], ["created_at", "id"]).select("name", "id", "status")


@query("delete_cascade", "jobs findings", """
SELECT 'job' AS kind, id AS job_id, NULL::BIGINT AS id FROM jobs WHERE status <> 'failed' UNION ALL
SELECT 'timeline', media_id::VARCHAR, id FROM findings WHERE NOT EXISTS (SELECT 1 FROM jobs WHERE jobs.id = findings.media_id::VARCHAR AND status = 'failed')""")
def delete_cascade(spark, sf):
    all_jobs = v.jobs(spark, sf)
    found = v.findings(spark, sf).select(F.col("media_id").cast("string").alias("job_id"), "id")
    left, timelines = jb.delete_cascade(all_jobs, found, all_jobs.where("status = 'failed'"))
    return left.select(F.lit("job").alias("kind"), F.col("id").alias("job_id"), F.lit(None).cast("bigint").alias("id")).unionByName(
        timelines.select(F.lit("timeline").alias("kind"), "job_id", "id"))


# -- files and library ------------------------------------------------------------------------------

_FILE = "lower(split_part(path, '/', -1))"
SQL["idx"] = f"""
idx AS (SELECT name, first(path ORDER BY root_idx, path) AS path FROM (SELECT *, {_FILE} AS name FROM files) WHERE NOT ends_with(name, '.timeline.json') GROUP BY name)"""
SQL["sidecars"] = f"sidecars AS (SELECT DISTINCT {_FILE} AS name FROM files WHERE ends_with(lower(path), '.timeline.json'))"


@query("discover_media", "files", "SELECT DISTINCT path FROM files WHERE regexp_matches(lower(path), '[.](mkv|mp4|avi|m4v|webm|mov)$') AND NOT contains(path, '(Clean)')")
def discover_media(spark, sf):
    return lb.discover_media(v.files(spark, sf))


@query("library_index", "files idx", "SELECT name, path FROM idx")
def library_index(spark, sf):
    return lb.library_index(v.files(spark, sf))


@query("library_sidecars", "files sidecars", "SELECT name FROM sidecars")
def library_sidecars(spark, sf):
    return lb.library_sidecars(v.files(spark, sf))


SQL["brands"] = """
spread AS (SELECT DISTINCT '/lib/' || split_part(path, '/', -1) AS path FROM files UNION
  SELECT DISTINCT '/lib/' || replace(split_part(path, '/', -1), '.en.srt', '.srt') FROM files WHERE ends_with(path, '.en.srt') AND file_id % 5 = 0)"""


@query("preferred_sidecar_sub", "files brands", """
SELECT path AS media_path, first(sub ORDER BY pref) AS subtitle FROM (SELECT m.path, s.path AS sub, p.pref FROM spread m, (VALUES (0, '.en.srt'), (1, '.eng.srt'), (2, '.srt')) p(pref, ending)
  JOIN spread s ON s.path = regexp_replace(m.path, '[.][^./]+$', '') || p.ending WHERE regexp_matches(m.path, '[.](mkv|MP4)$')) GROUP BY path""")
def preferred_sidecar_sub(spark, sf):
    """All files in one folder, some with a second subtitle file."""
    name = lb.file_name(F.col("path"))
    flat = v.files(spark, sf).select(F.concat(F.lit("/lib/"), name).alias("path"), "file_id")
    plain = flat.where(F.col("path").endswith(".en.srt") & (F.col("file_id") % 5 == 0)).select(F.replace("path", F.lit(".en.srt"), F.lit(".srt")).alias("path"))
    spread = flat.select("path").unionByName(plain).distinct()
    return lb.preferred_sidecar_sub(spread.where(F.col("path").rlike(r"\.(mkv|MP4)$")), spread)


SQL["asked"] = """
asked AS (SELECT file_id AS pos, CASE file_id % 4 WHEN 0 THEN path WHEN 1 THEN 'Z:\\media\\' || upper(split_part(path, '/', -1)) WHEN 2 THEN '/nowhere/' || file_id || '.mkv'
    ELSE path END AS path FROM files),
resolved AS (SELECT a.path, coalesce(f.path, i.path) AS resolved_path FROM (SELECT DISTINCT path FROM asked) a LEFT JOIN (SELECT DISTINCT path FROM files) f USING (path)
  LEFT JOIN idx i ON i.name = lower(split_part(replace(a.path, '\\', '/'), '/', -1)))"""


def asked(spark, sf):
    name = lb.file_name(F.col("path"))
    return v.files(spark, sf).select(F.col("file_id").alias("pos"), v._pick(F.col("file_id") % 4, [
        (0, F.col("path")), (1, F.concat(F.lit("Z:\\media\\"), F.upper(name))), (2, F.concat(F.lit("/nowhere/"), F.col("file_id").cast("string"), F.lit(".mkv"))),
        (3, F.col("path"))]).alias("path"))


@query("resolve_path", "files idx asked", "SELECT path, resolved_path FROM resolved")
def resolve_path(spark, sf):
    return lb.resolve_path(asked(spark, sf), v.files(spark, sf))


SQL["owned"] = f"""
stems AS (SELECT DISTINCT regexp_replace(split_part(path, '/', -1), '[.][^.]+$', '') AS stem FROM files WHERE regexp_matches(path, '[.]mkv$')
  UNION SELECT 'Film' UNION SELECT 'Film 1 (1951)'),
named AS (SELECT file_id, split_part(path, '/', -1) || CASE WHEN file_id % 9 = 0 THEN '.Part.2.nfo' ELSE '' END AS name FROM files),
owned AS (SELECT n.file_id, n.name, max_by(stem, length(stem)) AS owner FROM named n LEFT JOIN stems s ON lower(n.name) = lower(stem) OR starts_with(lower(n.name), lower(stem) || '.')
  GROUP BY ALL)"""


def _named(spark, sf):
    return v.files(spark, sf).select("file_id", F.concat(lb.file_name(F.col("path")), F.when(F.col("file_id") % 9 == 0, ".Part.2.nfo").otherwise("")).alias("name"))


def _stems(spark, sf):
    name = lb.file_name(F.col("path"))
    films = v.files(spark, sf).where(F.col("path").endswith(".mkv")).select(F.regexp_replace(name, r"\.[^.]+$", "").alias("stem"))
    own = spark.createDataFrame([("Film",), ("Film 1 (1951)",)], "stem STRING")
    return films.unionByName(own).distinct()


@query("assign_owner", "files owned", "SELECT file_id, name, owner FROM owned")
def assign_owner(spark, sf):
    return lb.assign_owner(_named(spark, sf), _stems(spark, sf))


@query("assign_cleaned", "files owned", """
SELECT file_id, name, stem FROM named JOIN stems ON starts_with(lower(name), lower(stem) || ' ') OR starts_with(lower(name), lower(stem) || '.')""")
def assign_cleaned(spark, sf):
    return lb.assign_cleaned(_named(spark, sf), _stems(spark, sf))


@query("orphans_top20", "files owned", """
SELECT file_id, name FROM owned WHERE owner IS NULL ORDER BY name, file_id LIMIT 20""")
def orphans_top20(spark, sf):
    return lb.orphans_top20(_named(spark, sf), _stems(spark, sf))[0]


@query("orphans_more", "files owned", "SELECT greatest(count(*) - 20, 0) AS more FROM owned WHERE owner IS NULL")
def orphans_more(spark, sf):
    return lb.orphans_top20(_named(spark, sf), _stems(spark, sf))[1]


SQL["library"] = """
film_rows AS (SELECT i.path, i.name, regexp_replace(split_part(i.path, '/', -1), '[.][^.]+$', '') AS stem, split_part(i.path, '/', -2) AS collection,
    s.name IS NOT NULL AS analyzed FROM idx i LEFT JOIN sidecars s ON s.name = regexp_replace(i.name, '[.][^.]+$', '') || '.timeline.json'
  WHERE regexp_matches(i.name, '[.](mkv|mp4|m4v|avi|mov|ts|webm|wmv|mpg|mpeg)$') AND NOT contains(i.name, '(clean)')),
found_on AS (SELECT path, count(f.id) AS total, count(f.id) FILTER (approved IS NULL OR f.media_id % 2 = 0) AS pending FROM files
  JOIN findings f ON f.media_id = file_id GROUP BY path),
summary AS (SELECT path, name, stem, collection, analyzed, n AS finding_count, u AS undecided_count, CASE WHEN NOT analyzed THEN 'unanalyzed' WHEN u = 0 THEN 'reviewed'
    WHEN u = n THEN 'ready' ELSE 'in_progress' END AS status FROM (SELECT r.*, CASE WHEN analyzed THEN coalesce(total, 0) ELSE 0 END AS n,
    CASE WHEN analyzed THEN coalesce(pending, 0) ELSE 0 END AS u FROM film_rows r LEFT JOIN found_on USING (path)))"""


def summary(spark, sf):
    found = v.findings(spark, sf).withColumn("approved", F.when(F.col("media_id") % 2 == 0, None).otherwise(F.col("approved")))
    on_path = v.files(spark, sf).select(F.col("file_id").alias("media_id"), "path").join(found, "media_id")
    return lb.film_summary(lb.films(v.files(spark, sf)), lb.review_counts(on_path, "path"))


_LIB = "files findings idx sidecars library"


@query("film_summary", _LIB, "SELECT * FROM summary")
def film_summary(spark, sf):
    return summary(spark, sf)


@query("library_view", _LIB, """
SELECT path, stem, collection, status, finding_count, undecided_count FROM summary WHERE analyzed ORDER BY CASE status WHEN 'ready' THEN 0 WHEN 'in_progress' THEN 1
  WHEN 'reviewed' THEN 2 ELSE 3 END, undecided_count DESC, lower(stem), path LIMIT 50 OFFSET 5""")
def library_view(spark, sf):
    return lb.library_view(summary(spark, sf), offset=5)[0].select("path", "stem", "collection", "status", "finding_count", "undecided_count")


@query("library_search", _LIB, """
SELECT path, stem, status FROM (SELECT *, CASE WHEN starts_with(lower(stem), 'film 1') THEN 0 WHEN contains(lower(stem), 'film 1') THEN 1 ELSE 2 END AS r FROM summary
  WHERE contains(name, 'film 1') OR regexp_matches(name, 'f.*i.*l.*m.* .*1')) ORDER BY r, lower(stem), path LIMIT 200""")
def library_search(spark, sf):
    return lb.library_view(summary(spark, sf), " Film 1", limit=500)[0].select("path", "stem", "status")


@query("library_total", _LIB, "SELECT count(*) AS total FROM summary WHERE analyzed")
def library_total(spark, sf):
    return lb.library_view(summary(spark, sf))[1]


SQL["status"] = f"""
film_jobs AS (SELECT replace(lower(split_part(media_path, '/', -1)), '.mkv', ' (1950).mkv') AS name, id, engine, status, {_RANK} AS r, created_at,
    id::BIGINT % 101 / 100 AS progress, 'step ' || id::BIGINT % 5 AS stage, CASE WHEN status = 'failed' THEN 'lost ' || id END AS error FROM jobs),
film_state AS (SELECT name, first(id ORDER BY coalesce(r, 3), created_at DESC, id) AS job_id, first(status ORDER BY coalesce(r, 3), created_at DESC, id) AS job_status,
    first(progress ORDER BY coalesce(r, 3), created_at DESC, id) AS job_progress, first(stage ORDER BY coalesce(r, 3), created_at DESC, id) AS job_stage,
    first(error ORDER BY coalesce(r, 3), created_at DESC, id) AS job_error, first(engine ORDER BY coalesce(r, 3), created_at DESC, id) AS job_engine,
    count(r) AS active, bool_or(status IN ('completed', 'rendered')) AS done,
    coalesce(string_agg(DISTINCT engine, ',' ORDER BY engine) FILTER (status IN ('completed', 'rendered') AND engine <> 'render'), '') AS engines_done FROM film_jobs GROUP BY name),
film_counts AS (SELECT lower(split_part(path, '/', -1)) AS name, count(*) AS total, count(*) FILTER (approved) AS approved, count(*) FILTER (NOT approved) AS rejected,
    count(*) FILTER (approved IS NULL) AS pending FROM files JOIN findings ON media_id = file_id GROUP BY 1),
film_marks AS (SELECT DISTINCT replace(name, '.timeline.json', e) AS name FROM sidecars, (SELECT unnest(['.mkv', '.mp4']) AS e))"""


def shown_jobs(spark, sf):
    """Jobs with all that a page shows. They name their film without a year; give them one so that some meet the files."""
    key = F.col("id").cast("bigint")
    return v.jobs(spark, sf).withColumns({
        "media_path": F.replace("media_path", F.lit(".mkv"), F.lit(" (1950).mkv")), "progress": key % 101 / 100,
        "stage": F.concat(F.lit("step "), key % 5), "error": F.when(F.col("status") == "failed", F.concat(F.lit("lost "), "id"))})


@query("status_for_paths", "files jobs findings idx sidecars asked status", """
SELECT a.pos, a.path, r.resolved_path, ok AS analyzed, CASE WHEN ok THEN coalesce(total, 0) ELSE 0 END AS total, CASE WHEN ok THEN coalesce(approved, 0) ELSE 0 END AS approved,
  CASE WHEN ok THEN coalesce(rejected, 0) ELSE 0 END AS rejected, CASE WHEN ok THEN coalesce(pending, 0) ELSE 0 END AS pending, job_id, job_status, job_progress, job_stage, job_error, job_engine, coalesce(active, 0) AS active, coalesce(engines_done, '') AS engines_done
FROM asked a JOIN (SELECT *, m.name IS NOT NULL OR (coalesce(done, false) AND total IS NOT NULL) AS ok FROM resolved r
  LEFT JOIN film_state j ON j.name = lower(split_part(r.resolved_path, '/', -1)) LEFT JOIN film_counts c ON c.name = lower(split_part(r.resolved_path, '/', -1))
  LEFT JOIN film_marks m ON m.name = lower(split_part(r.resolved_path, '/', -1))) r USING (path)""")
def status_for_paths(spark, sf):
    files = v.files(spark, sf)
    requests = asked(spark, sf)
    named = shown_jobs(spark, sf)
    on_path = files.select(F.col("file_id").alias("media_id"), F.lower(lb.file_name(F.col("path"))).alias("name")).join(v.findings(spark, sf), "media_id")
    marks = lb.library_sidecars(files).select(F.explode(F.array(*[F.replace("name", F.lit(lb.SIDECAR), F.lit(e)) for e in (".mkv", ".mp4")])).alias("name"))
    return jb.status_for_paths(requests, lb.resolve_path(requests, files), named, lb.review_counts(on_path, "name"), marks)


@query("active_for_paths", "files jobs findings idx sidecars asked status", """
SELECT pos, path, row_number() OVER (PARTITION BY pos, path ORDER BY r, created_at DESC, id) AS place, id, status, progress, stage, error, engine
FROM asked JOIN resolved USING (path) JOIN film_jobs ON name = lower(split_part(resolved_path, '/', -1)) WHERE r IS NOT NULL""")
def active_for_paths(spark, sf):
    requests = asked(spark, sf)
    return jb.active_for_paths(requests, lb.resolve_path(requests, v.files(spark, sf)), shown_jobs(spark, sf))


@query("upsert_buckets", "jobs", "SELECT id, CASE WHEN status IN ('queued', 'running') THEN 'cancelled' ELSE status END AS status, engine FROM jobs")
def upsert_buckets(spark, sf):
    """All jobs go into a table, then those that wait or run are cancelled."""
    jobs = v.jobs(spark, sf).select("id", "status", "engine", F.lit(0).alias("seq"))
    table = sk.BucketedTable(spark, scratch_path(spark, "jobs"), ["id"], ["seq"], 16)
    table.upsert(jobs)
    table.upsert(jobs.where("status IN ('queued', 'running')").withColumns({"status": F.lit("cancelled"), "seq": F.lit(1)}))
    return table.read().drop("seq")
