"""Interval algebra, dialogue and speech detectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanweave.operators import dialogue, intervals
from spanweave.plans import detectors
from workload import views as v
from workload.registry import query
from workload.scalar_queries import LEXICON, MATCH, NORM, TIER

SQL = v.SQL
# The same findings with a twentieth of their length, so that timelines have gaps.
SQL["spans"] = "spans AS (SELECT * REPLACE (start_ms + (end_ms - start_ms) // 20 AS end_ms) FROM findings)"


def spans(spark, sf):
    return v.findings(spark, sf).withColumn("end_ms", F.col("start_ms") + F.expr("(end_ms - start_ms) div 20"))


def union_sql(name: str, source: str, gap: int = 0, key: str = "media_id") -> str:
    """Islands of ``source`` as ``name`` (rows with their group number)."""
    return f"""
{name}_r AS (SELECT *, max(end_ms) OVER (PARTITION BY {key} ORDER BY start_ms, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach
  FROM {source}),
{name} AS (SELECT *, sum(CASE WHEN reach IS NULL OR start_ms - reach > {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY {key} ORDER BY start_ms, seq) AS grp
  FROM {name}_r)"""


def burst_sql(name: str) -> str:
    return f"""SELECT media_id, min(start_ms) AS start_ms, max(end_ms) AS end_ms, string_agg(word, ', ' ORDER BY start_ms, seq) AS word,
  min(confidence) AS confidence, list_reduce(list(context ORDER BY start_ms, seq),
    lambda a, b: CASE WHEN contains(a, b) THEN a ELSE a || ' … ' || b END) AS context FROM {name} GROUP BY media_id, grp"""


SQL["skips"] = "skips AS (SELECT media_id, start_ms, end_ms, id AS seq FROM spans WHERE approved AND action = 'skip')"
SQL["cuts_u"] = union_sql("cuts_u", "skips")


def skips(spark, sf):
    return spans(spark, sf).where("approved AND action = 'skip'").select("media_id", "start_ms", "end_ms")


@query("merge_spans", "findings spans skips cuts_u", "SELECT media_id, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM cuts_u GROUP BY media_id, grp")
def merge_spans(spark, sf):
    return intervals.merge_spans(skips(spark, sf))


SQL["hits"] = """hits AS (SELECT media_id, start_ms, end_ms, category AS word, confidence, reasoning AS context, id AS seq FROM spans)"""
SQL["hits_u"] = union_sql("hits_u", "hits", 750)


@query("merge_hits", "findings spans hits hits_u", burst_sql("hits_u"))
def merge_hits(spark, sf):
    return intervals.merge_hits(spans(spark, sf).select(
        "media_id", "start_ms", "end_ms", F.col("category").alias("word"), "confidence", F.col("reasoning").alias("context"), F.col("id").alias("seq")))


SQL["keeps"] = """
reach AS (SELECT media_id, start_ms, coalesce(max(end_ms) OVER (PARTITION BY media_id ORDER BY start_ms, seq
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prev FROM skips),
keeps AS (SELECT media_id, prev AS keep_start, start_ms AS keep_end FROM reach WHERE start_ms > prev
  UNION ALL SELECT media_id, coalesce(last_ms, 0), duration_ms FROM media LEFT JOIN (SELECT media_id, max(end_ms) AS last_ms FROM skips GROUP BY media_id)
    USING (media_id) WHERE coalesce(last_ms, 0) < duration_ms)"""
_KEEP_VIEWS = "findings media spans skips keeps"


@query("keep_intervals", _KEEP_VIEWS, "SELECT media_id, keep_start, keep_end FROM keeps")
def keep_intervals(spark, sf):
    return intervals.keep_intervals(skips(spark, sf), v.media(spark, sf))


@query("keep_intervals_sliver", "findings media", """
SELECT media_id, 0::BIGINT AS keep_start, min(start_ms) AS keep_end FROM findings GROUP BY media_id HAVING min(start_ms) > 0
UNION ALL SELECT media_id, 0, 200 FROM findings GROUP BY media_id HAVING min(start_ms) = 0""")
def keep_intervals_sliver(spark, sf):
    """Everything from the first finding on is cut; a film that starts with one keeps a sliver."""
    long = v.findings(spark, sf).withColumn("end_ms", F.lit(2_678_400_000))
    return intervals.keep_intervals(long, v.media(spark, sf), sliver_ms=200)


SQL["tmap"] = """
tmap AS (SELECT media_id, keep_start AS rel_ms, coalesce(sum(keep_end - keep_start) OVER (PARTITION BY media_id ORDER BY keep_start
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS clip_ms, keep_end - keep_start AS len_ms FROM keeps)"""


@query("time_map", _KEEP_VIEWS + " tmap", "SELECT media_id, rel_ms, clip_ms, len_ms FROM tmap")
def time_map(spark, sf):
    return intervals.time_map(keep_intervals(spark, sf))


@query("map_output_to_source", _KEEP_VIEWS + " flags tmap", """
SELECT flag_id, media_id, t_ms AS out_ms, coalesce(min_by(rel_ms + greatest(t_ms - clip_ms, 0), rel_ms) FILTER (t_ms <= clip_ms + len_ms + 1),
  max_by(rel_ms + len_ms, rel_ms), t_ms)::BIGINT AS source_ms FROM flags LEFT JOIN tmap USING (media_id) GROUP BY flag_id, media_id, t_ms""")
def map_output_to_source(spark, sf):
    points = v.flags(spark, sf).withColumnRenamed("t_ms", "out_ms")
    return intervals.map_output_to_source(points, time_map(spark, sf)).select("flag_id", "media_id", "out_ms", "source_ms")


@query("window_overlap", "findings spans windows", """
SELECT window_id, media_id, id, greatest(start_ms - win_start, 0) AS rel_start, least(end_ms, win_end) - win_start AS rel_end
FROM windows JOIN spans USING (media_id) WHERE end_ms > win_start AND start_ms < win_end AND
  least(end_ms, win_end) - win_start - greatest(start_ms - win_start, 0) > 20""")
def window_overlap(spark, sf):
    return intervals.window_overlap(spans(spark, sf), v.windows(spark, sf)).select("window_id", "media_id", "id", "rel_start", "rel_end")


@query("time_bucket_split", "findings spans windows", """
SELECT window_id, media_id, id, CASE action WHEN 'skip' THEN 'cuts' WHEN 'mute' THEN 'mutes' WHEN 'voice' THEN 'voices' ELSE 'blurs' END AS plan,
  greatest(start_ms, win_start) AS from_ms, least(end_ms, win_end) AS to_ms FROM windows JOIN spans USING (media_id)
WHERE end_ms > win_start AND start_ms < win_end AND (approved IS TRUE OR id = selected_id)""")
def time_bucket_split(spark, sf):
    return intervals.time_bucket_split(spans(spark, sf), v.windows(spark, sf))


SQL["inwin"] = """
inwin AS (SELECT window_id, start_ms, end_ms, id AS seq FROM windows JOIN spans USING (media_id)
  WHERE approved IS TRUE AND end_ms > win_start AND start_ms < win_end)"""
SQL["inwin_u"] = union_sql("inwin_u", "inwin", key="window_id")


@query("coverage_ms", "findings spans windows inwin inwin_u", """
SELECT window_id, media_id, coalesce(regions, 0) AS regions, coalesce(removed_ms, 0) AS removed_ms FROM windows LEFT JOIN (
  SELECT window_id, sum(n)::BIGINT AS regions, sum(b - a)::BIGINT AS removed_ms FROM (
    SELECT window_id, count(*) AS n, min(start_ms) AS a, max(end_ms) AS b FROM inwin_u GROUP BY window_id, grp) GROUP BY window_id) USING (window_id)""")
def coverage_ms(spark, sf):
    return intervals.coverage_ms(spans(spark, sf), v.windows(spark, sf))


@query("nearest_finding", "findings spans flags", """
SELECT flag_id, media_id, t_ms, id AS finding_id FROM (SELECT flag_id, f.media_id, f.t_ms + 3600000 AS t_ms, s.id, row_number() OVER (PARTITION BY flag_id ORDER BY
    CASE WHEN f.t_ms + 3600000 BETWEEN s.start_ms AND s.end_ms THEN 0 ELSE 1 END,
    CASE WHEN f.t_ms + 3600000 BETWEEN s.start_ms AND s.end_ms THEN s.end_ms - s.start_ms
      ELSE least(abs(f.t_ms + 3600000 - s.start_ms), abs(f.t_ms + 3600000 - s.end_ms)) END, s.start_ms, s.id) AS r
  FROM flags f JOIN spans s ON f.media_id = s.media_id) WHERE r = 1""")
def nearest_finding(spark, sf):
    points = v.flags(spark, sf).withColumn("t_ms", F.col("t_ms") + 3_600_000)
    return intervals.nearest_finding(spans(spark, sf), points).select("flag_id", "media_id", "t_ms", "finding_id")


# -- dialogue ---------------------------------------------------------------------------------------

SQL["flagged"] = f"""
flagged AS (SELECT t.*, c.start_ms, c.end_ms, c.text, len(string_split(c.text, ' ')) AS n_words FROM (SELECT *, {TIER} AS tier FROM tokens) t
  JOIN cues c USING (media_id, cue_idx) WHERE tier IS NOT NULL)"""
SQL["near"] = f"""
heard AS (SELECT media_id, {NORM.format('word')} AS norm, trunc(start_s * 1000)::BIGINT AS w_start, trunc(end_s * 1000)::BIGINT AS w_end,
    seg_idx * 1000000 + word_idx AS pos FROM words),
heard_n AS (SELECT *, regexp_replace(norm, '''s$', '') AS t, min(pos) OVER (PARTITION BY media_id, norm) AS norm_pos FROM heard),
near_c AS (SELECT f.media_id, f.start_ms, f.end_ms, f.norm AS key, w.w_start, w.w_end, norm_pos, pos,
    abs(w.w_start - (f.start_ms + f.end_ms) // 2) AS dist
  FROM (SELECT DISTINCT media_id, start_ms, end_ms, norm, regexp_replace(norm, '''s$', '') AS h FROM flagged) f JOIN heard_n w
    ON f.media_id = w.media_id AND w.w_start BETWEEN f.start_ms - 1500 AND f.end_ms + 1500
  WHERE {MATCH.replace('heard = target', 'w.norm = f.norm').replace('h = t', 'f.h = w.t').replace('length(h)', 'length(f.h)').replace('length(t)', 'length(w.t)').replace('(h, t)', '(f.h, w.t)').replace('(t, h)', '(w.t, f.h)')}),
near AS (SELECT media_id, start_ms, end_ms, key, w_start AS word_start_ms, w_end AS word_end_ms FROM (SELECT *, row_number() OVER (
    PARTITION BY media_id, start_ms, end_ms, key ORDER BY dist, norm_pos, pos) AS r FROM near_c) WHERE r = 1)"""
_FLAGGED = "words tokens flagged"


def _flagged(spark, sf):
    return dialogue.flagged_words(v.cues(spark, sf), LEXICON)


@query("cue_word_nearest", _FLAGGED + " near", "SELECT media_id, start_ms, end_ms, key, word_start_ms, word_end_ms FROM near")
def cue_word_nearest(spark, sf):
    return dialogue.cue_word_nearest(_flagged(spark, sf), v.words(spark, sf), LEXICON)


_EST_A = "f.start_ms + greatest(f.end_ms - f.start_ms, 240) * char_offset // greatest(length(text), 1)"
_EST_B = f"({_EST_A} + greatest(greatest(f.end_ms - f.start_ms, 240) * length(token) // greatest(length(text), 1), 240))"


def timed_sql(near: bool) -> str:
    """Flagged words with their source and span, from the transcript where it has them."""
    got = "n.word_start_ms IS NOT NULL" if near else "false"
    a, b = ("n.word_start_ms", "CASE WHEN least(n.word_end_ms, n.word_start_ms + 1500) <= n.word_start_ms THEN n.word_start_ms + 240 ELSE "
            "least(n.word_end_ms, n.word_start_ms + 1500) END") if near else ("NULL", "NULL")
    join = "LEFT JOIN near n ON n.media_id = f.media_id AND n.start_ms = f.start_ms AND n.end_ms = f.end_ms AND n.key = f.norm" if near else ""
    return f"""
timed AS (SELECT f.media_id, f.cue_idx, f.token_idx, f.norm AS key, f.text, f.start_ms, f.end_ms,
    CASE WHEN {got} THEN {a} WHEN n_words = 1 THEN f.start_ms ELSE {_EST_A} END AS word_from_ms,
    CASE WHEN {got} THEN {b} WHEN n_words = 1 THEN f.end_ms ELSE {_EST_B} END AS word_to_ms,
    CASE WHEN {got} THEN 'cached-asr' WHEN n_words = 1 THEN 'single-word-cue' ELSE 'estimated' END AS source
  FROM flagged f {join})"""


SQL["timed_near"], SQL["timed"] = timed_sql(True), timed_sql(False)
SQL["mutes"] = """
mutes AS (SELECT media_id, greatest(a - 70, 0) AS start_ms, least(greatest(word_to_ms, a + 240), end_ms + 1000) + 70 AS end_ms, key AS word,
    CASE source WHEN 'estimated' THEN 0.5 ELSE 1.0 END::DOUBLE AS confidence, text[1:110] || ' (' || source || ')' AS context, seq
  FROM (SELECT *, greatest(start_ms - 1000, word_from_ms) AS a, cue_idx * 1000000 + token_idx AS seq FROM timed))"""
SQL["mutes_u"] = union_sql("mutes_u", "mutes", 750)


def found_sql(bursts: str, engine: str, confidence: str = "confidence") -> str:
    return f"""
SELECT media_id, row_number() OVER (PARTITION BY media_id ORDER BY start_ms) AS id, start_ms, end_ms, 'profanity' AS category,
  {confidence} AS confidence, '{engine}' AS engine, 'mute' AS action, NULL::BOOLEAN AS approved, '[' || word || '] ' || context AS reasoning,
  NULL::VARCHAR AS engine_ref FROM ({bursts})"""


@query("resolve_word_timing", _FLAGGED + " near timed_near", "SELECT media_id, cue_idx, token_idx, key, word_from_ms, word_to_ms, source FROM timed")
def resolve_word_timing(spark, sf):
    flagged = _flagged(spark, sf)
    return dialogue.resolve_word_timing(flagged, dialogue.cue_word_nearest(flagged, v.words(spark, sf), LEXICON)).select(
        "media_id", "cue_idx", "token_idx", "key", "word_from_ms", "word_to_ms", "source")


@query("subtitle_findings", "cues tokens flagged timed mutes mutes_u", found_sql(burst_sql("mutes_u"), "subtitles"))
def subtitle_findings(spark, sf):
    return detectors.numbered(detectors.subtitle_findings(v.cues(spark, sf), LEXICON)).drop("seq")


@query("subtitle_findings_precise", _FLAGGED + " near timed_near mutes mutes_u", found_sql(burst_sql("mutes_u"), "subtitles"))
def subtitle_findings_precise(spark, sf):
    found = detectors.subtitle_findings(v.cues(spark, sf), LEXICON, v.words(spark, sf))
    return detectors.numbered(found).drop("seq")


SQL["whole"] = """
whole AS (SELECT media_id, greatest(start_ms - 70, 0) AS start_ms, end_ms + 70 AS end_ms, norm AS word, 1.0::DOUBLE AS confidence,
    text[1:110] || ' (whole-cue)' AS context, cue_idx * 1000000 + token_idx AS seq FROM flagged)"""
SQL["whole_u"] = union_sql("whole_u", "whole", 750)


@query("subtitle_findings_whole_cue", "cues tokens flagged whole whole_u", found_sql(burst_sql("whole_u"), "subtitles"))
def subtitle_findings_whole_cue(spark, sf):
    return detectors.numbered(detectors.subtitle_findings(v.cues(spark, sf), LEXICON, whole_cue=True)).drop("seq")


SQL["spoken"] = f"""
spoken AS (SELECT media_id, greatest(trunc(start_s * 1000)::BIGINT - 150, 0) AS start_ms, trunc(end_s * 1000)::BIGINT + 150 AS end_ms, trim(word) AS word,
    probability AS confidence, seg_text[1:120] AS context, seg_idx * 1000000 + word_idx AS seq
  FROM (SELECT *, {NORM.format('word')} AS norm FROM words) WHERE {TIER} IS NOT NULL)"""
SQL["spoken_u"] = union_sql("spoken_u", "spoken", 750)


@query("whisper_hits", "words spoken spoken_u", found_sql(burst_sql("spoken_u"), "whisper", "round_even(confidence, 3)"))
def whisper_hits(spark, sf):
    return detectors.numbered(detectors.whisper_findings(v.words(spark, sf), LEXICON)).drop("seq")


@query("extra_words", "words", f"""
SELECT media_id, seg_idx, word_idx, word FROM words WHERE {NORM.format('word')} IN ('that', 'the', 'et')""")
def extra_words(spark, sf):
    """The caller's own words, as rows of the lexicon table, without any built-in tier."""
    own = spark.createDataFrame([(w, "extra", "exact") for w in ("that", "the", "et")], "word STRING, tier STRING, match_kind STRING")
    return dialogue.lexicon_join(v.words(spark, sf), own).select("media_id", "seg_idx", "word_idx", "word")
