"""Column functions: times, text, policy, review states, schedule, array generators."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanweave.functions import lexicon as lx
from spanweave.functions import policy as po
from spanweave.functions import review as rv
from spanweave.functions import schedule as sc
from spanweave.functions import text as tx
from spanweave.functions import timefmt as tf
from spanweave.operators import dialogue, library, media, reconcile, visual
from workload import views as v
from workload.registry import query

LEXICON = lx.Lexicon.of(include_mild=True, include_blasphemy=True, extra=["that", "und", "que"])


def sql_list(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


NORM = "trim(regexp_replace(lower({}), '[^a-z'']+', '', 'g'), '''')"
TIER = (f"CASE WHEN norm IN {sql_list(lx.STRONG)} OR " + " OR ".join(f"starts_with(norm, '{p}')" for p in lx.STRONG_PREFIXES)
        + f" THEN 'strong' WHEN norm IN {sql_list(lx.MILD)} THEN 'mild' WHEN norm IN {sql_list(lx.BLASPHEMY)} THEN 'blasphemy'"
        " WHEN norm IN ('que', 'that', 'und') THEN 'extra' END")


def stamp(ms: str) -> str:
    return f"printf('%02d:%02d:%02d,%03d', {ms} // 3600000, {ms} // 60000 % 60, {ms} // 1000 % 60, {ms} % 1000)"


# -- time -------------------------------------------------------------------------------------------

@query("ts_to_ms", "cues", f"""
SELECT media_id, cue_idx, CASE WHEN cue_idx % 10 = 3 THEN NULL ELSE start_ms END AS ms FROM cues""")
def ts_to_ms(spark, sf):
    cues = v.cues(spark, sf)
    text = tf.ms_to_ts(F.col("start_ms"))
    # Dots for commas, padding, and a broken stamp now and then.
    text = (F.when(F.col("cue_idx") % 10 == 3, F.concat(text, F.lit(":x"))).when(F.col("cue_idx") % 10 == 5, F.replace(text, F.lit(","), F.lit(".")))
            .otherwise(F.concat(F.lit("  "), text, F.lit(" "))))
    return cues.select("media_id", "cue_idx", tf.ts_to_ms(text).alias("ms"))


@query("ms_to_ts", "cues", f"""
SELECT media_id, cue_idx, {stamp('start_ms')} AS stamp, '00:00:00,000' AS early FROM cues""")
def ms_to_ts(spark, sf):
    return v.cues(spark, sf).select("media_id", "cue_idx", tf.ms_to_ts(F.col("start_ms")).alias("stamp"),
                                    tf.ms_to_ts(-F.col("end_ms")).alias("early"))


@query("fmt_hms", "findings", """
SELECT id, printf('%d:%02d:%02d.%03d', start_ms // 3600000, start_ms // 60000 % 60, start_ms // 1000 % 60, start_ms % 1000) AS hms
FROM findings""")
def fmt_hms(spark, sf):
    return v.findings(spark, sf).select("id", tf.fmt_hms(F.col("start_ms")).alias("hms"))


@query("parse_time", "findings", """
SELECT id, CASE id % 5 WHEN 0 THEN start_ms WHEN 1 THEN start_ms % 3600000 WHEN 2 THEN start_ms WHEN 3 THEN NULL ELSE 0 END AS ms
FROM findings""")
def parse_time(spark, sf):
    t = F.col("start_ms")
    typed = v._pick(F.col("id") % 5, [
        (0, tf.fmt_hms(t)), (1, F.format_string("%d:%d.%03ds", tf.idiv(t, 60000) % 60, tf.idiv(t, 1000) % 60, t % 1000)),
        (2, F.format_string(" %d.%03d ", tf.idiv(t, 1000), t % 1000)), (3, F.lit("1:x:3")), (4, F.lit("-12.5"))])
    return v.findings(spark, sf).select("id", tf.parse_time(typed).alias("ms"))


@query("fmt_duration", "findings", """
SELECT id, CASE WHEN s < 60 THEN printf('%.1fs', s) WHEN s::BIGINT < 3600 THEN printf('%dm%02ds', w // 60, w % 60)
  ELSE printf('%dh%02dm', w // 3600, w % 3600 // 60) END AS took
FROM (SELECT id, s, floor(s)::BIGINT AS w FROM (SELECT id, CASE id % 3 WHEN 0 THEN (id % 59999) / 1000.0::DOUBLE
  WHEN 1 THEN (id % 3599) + 0.5::DOUBLE ELSE (start_ms % 90000000) / 1000.0::DOUBLE END AS s FROM findings))""")
def fmt_duration(spark, sf):
    ident = F.col("id")
    seconds = v._pick(ident % 3, [(0, (ident % 59999) / 1000), (1, ident % 3599 + 0.5), (2, F.col("start_ms") % 90000000 / 1000)])
    return v.findings(spark, sf).select("id", tf.fmt_duration(seconds).alias("took"))


@query("ms_to_ticks", "findings", "SELECT id, start_ms * 10000 AS start_ticks, end_ms * 10000 AS end_ticks FROM findings")
def ms_to_ticks(spark, sf):
    return v.findings(spark, sf).select("id", tf.ms_to_ticks(F.col("start_ms")).alias("start_ticks"),
                                        tf.ms_to_ticks(F.col("end_ms")).alias("end_ticks"))


@query("clip_window", "findings", """
SELECT id, CASE WHEN start_ms < 15000 THEN 0 ELSE start_ms - 15000 END AS clip_start_ms, end_ms + 15000 AS clip_end_ms,
  end_ms - start_ms + 30000 AS clip_length_ms, least(start_ms, 15000) AS span_from_ms,
  least(start_ms, 15000) + end_ms - start_ms AS span_to_ms FROM findings""")
def clip_window(spark, sf):
    return v.findings(spark, sf).select("id", *[
        c.alias(n) for n, c in tf.clip_window(F.col("start_ms"), F.col("end_ms")).items()])


@query("flag_moment", "findings flags", """
SELECT flag_id, media_id, greatest(t_ms - 1500, 0) AS start_ms, t_ms + 1500 AS end_ms, 'manual' AS category, 'skip' AS action,
  true AS approved, 'Flagged during playback at ' || CASE WHEN t_ms >= 3600000 THEN (t_ms // 3600000) || ':' ELSE '' END ||
  printf('%02d:%02d', t_ms // 60000 % 60, t_ms // 1000 % 60) AS reasoning FROM flags""")
def flag_moment(spark, sf):
    from spanweave.streaming.jobs import flag_moments
    return flag_moments(v.flags(spark, sf)).select("flag_id", "media_id", "start_ms", "end_ms", "category", "action", "approved", "reasoning")


@query("runtime_fallback", "findings media", """
SELECT m.media_id, CASE WHEN m.media_id % 3 = 0 THEN 2678400000 ELSE coalesce(max(f.end_ms) + 60000, 60000) END AS runtime_ms
FROM media m LEFT JOIN findings f USING (media_id) GROUP BY m.media_id""")
def runtime_fallback(spark, sf):
    known = v.media(spark, sf).withColumn("duration_ms", F.when(F.col("media_id") % 3 == 0, F.col("duration_ms"))
                                          .when(F.col("media_id") % 3 == 1, 0))
    return media.runtime_fallback(known, v.findings(spark, sf))


@query("fix_inverted_span", "findings", """
SELECT id, least(a, b) AS start_ms, greatest(a, b) AS end_ms
FROM (SELECT id, greatest(end_ms - 40000, 0) AS a, greatest(start_ms - 60000, 0) AS b FROM findings)""")
def fix_inverted_span(spark, sf):
    a, b = tf.fix_inverted(F.col("end_ms") - 40000, F.col("start_ms") - 60000)
    return v.findings(spark, sf).select("id", a.alias("start_ms"), b.alias("end_ms"))


@query("parse_spans", "findings", """
SELECT id, start_ms, end_ms FROM findings UNION ALL SELECT id, id AS start_ms, id + 5 AS end_ms FROM findings WHERE id % 2 = 0""")
def parse_spans(spark, sf):
    pair = F.concat(F.col("start_ms").cast("string"), F.lit("-"), F.col("end_ms").cast("string"))
    extra = F.when(F.col("id") % 2 == 0, F.concat(F.lit(", "), F.col("id").cast("string"), F.lit(" - "), (F.col("id") + 5).cast("string"))).otherwise(",7")
    text = F.concat(F.lit("x-3,4-y,1-2-3,"), pair, extra)
    return v.findings(spark, sf).select("id", F.inline(tf.parse_spans(text)))


@query("progress_decile", "ticks", "SELECT job_id, seq, trunc(round_even(fraction, 4) * 10)::INT AS decile FROM ticks")
def progress_decile(spark, sf):
    return v.ticks(spark, sf).select("job_id", "seq", tf.progress_decile(F.col("fraction")).alias("decile"))


# -- text -------------------------------------------------------------------------------------------

_NOISY = "'NARRATOR: <i>' || text || '</i> (SIGHS) {b}[door closes]'"


@query("clean_cue_text", "cues", f"""
SELECT media_id, cue_idx, {v._space_sql("regexp_replace(regexp_replace(noisy, '<[^>]+>|[{][^}]*[}]', '', 'g'), '[(][^)]*[)]|[[][^]]*[]]|^[A-Z][A-Z ''.]{1,20}:', ' ', 'g')")} AS clean
FROM (SELECT media_id, cue_idx, CASE WHEN cue_idx % 2 = 0 THEN {_NOISY} ELSE text END AS noisy FROM cues)""")
def clean_cue_text(spark, sf):
    noisy = F.when(F.col("cue_idx") % 2 == 0, F.concat(F.lit("NARRATOR: <i>"), "text", F.lit("</i> (SIGHS) {b}[door closes]"))).otherwise(F.col("text"))
    return v.cues(spark, sf).select("media_id", "cue_idx", tx.clean_cue_text(noisy).alias("clean"))


@query("repair_mojibake", "", "SELECT doc_id, text AS repaired FROM documents")
def repair_mojibake(spark, sf):
    """Documents whose UTF-8 is first read as ISO 8859-1, then repaired. Controls 0x80-0x9f map to code page 1252."""
    docs = v.table(spark, sf, "documents")
    broken = F.translate(F.decode(F.encode("text", "utf-8"), "iso-8859-1"), tx._CONTROLS, tx._CP1252)
    # Five bytes have no 1252 character, so text holding one of them cannot have been broken this way.
    whole = ~broken.rlike(r"[\x{81}\x{8d}\x{8f}\x{90}\x{9d}]") & broken.rlike("â€|Ã")
    return docs.select("doc_id", tx.repair_mojibake(F.when(whole, broken).otherwise(F.col("text"))).alias("repaired"))


# Without look-around, a match takes its neighbours with it; a second pass gets those between two matches.
_OCR_BAR = f"regexp_replace({{}}, '(^|[^A-Za-z0-9])[|l]([''’]|{v._SPACE[:-1].replace('{', '{{').replace('}', '}}')})', '\\1I\\2', 'g')"
_OCR_ZERO = "regexp_replace({}, '([a-z])0([a-z])', '\\1o\\2', 'g')"


@query("ocr_cleanup", "cues", f"""
SELECT media_id, cue_idx, trim(regexp_replace(translate({_OCR_ZERO.format(_OCR_ZERO.format(_OCR_BAR.format(_OCR_BAR.format('text'))))}, '“”‘’', '""'''''), '{v._SPACE}', ' ', 'g'), ' -—') AS clean
FROM (SELECT media_id, cue_idx, '- |''m here l said, s0me l0ng0r words | l ' || text || ' —' AS text FROM cues)""")
def ocr_cleanup(spark, sf):
    """All cues, with planted misreadings before their own."""
    planted = F.concat(F.lit("- |'m here\nl said,  s0me l0ng0r words | l "), F.col("text"), F.lit(" —"))
    return v.cues(spark, sf).select("media_id", "cue_idx", tx.ocr_cleanup(planted).alias("clean"))


@query("normalize_word", "words", f"SELECT media_id, seg_idx, word_idx, {NORM.format('word')} AS norm FROM words")
def normalize_word(spark, sf):
    return v.words(spark, sf).select("media_id", "seg_idx", "word_idx", tx.normalize_word(F.col("word")).alias("norm"))


_TOKENS = f"""
tokens AS (SELECT media_id, cue_idx, token_idx, token, {NORM.format('token')} AS norm, (sum(length(token) + 1) OVER
    (PARTITION BY media_id, cue_idx ORDER BY token_idx) - length(token) - 1)::BIGINT AS char_offset
  FROM (SELECT media_id, cue_idx, unnest(string_split(text, ' ')) AS token,
        unnest(range(len(string_split(text, ' '))))::BIGINT AS token_idx FROM cues))"""
v.SQL["tokens"] = _TOKENS


@query("tokenize_offsets", "cues tokens", "SELECT media_id, cue_idx, token_idx, token, norm, char_offset FROM tokens")
def tokenize_offsets(spark, sf):
    return dialogue.tokenize_offsets(v.cues(spark, sf))


@query("lexicon_flag", "cues tokens", f"""
SELECT media_id, cue_idx, token_idx, tier FROM (SELECT *, {TIER} AS tier FROM tokens) WHERE tier IS NOT NULL""")
def lexicon_flag(spark, sf):
    tokens = dialogue.tokenize_offsets(v.cues(spark, sf), columns=("norm",), listed=LEXICON)
    return tokens.withColumn("tier", LEXICON.tier(F.col("norm"))).where("tier is not null").select("media_id", "cue_idx", "token_idx", "tier")


@query("lexicon_join", "cues tokens", f"""
SELECT media_id, cue_idx, token_idx, token, norm, char_offset, tier FROM (SELECT *, {TIER} AS tier FROM tokens) WHERE tier IS NOT NULL""")
def lexicon_join(spark, sf):
    return dialogue.lexicon_join(dialogue.tokenize_offsets(v.cues(spark, sf)), LEXICON.table(spark))


MATCH = """(heard = target OR h = t OR (least(length(h), length(t)) >= 3 AND
  CASE WHEN length(t) < length(h) THEN starts_with(h, t) ELSE starts_with(t, h) END))"""


@query("word_matches", "cues tokens", f"""
SELECT media_id, cue_idx, token_idx, {MATCH} AS matches FROM (SELECT *, regexp_replace(heard, '''s$', '') AS h,
    regexp_replace(target, '''s$', '') AS t FROM (SELECT media_id, cue_idx, token_idx, norm AS heard,
    CASE token_idx % 3 WHEN 0 THEN norm || '''s' WHEN 1 THEN norm[1:3] ELSE 'that' END AS target FROM tokens WHERE norm <> ''))""")
def word_matches(spark, sf):
    norm = F.col("norm")
    target = v._pick(F.col("token_idx") % 3, [(0, F.concat(norm, F.lit("'s"))), (1, F.substring(norm, 1, 3)), (2, F.lit("that"))])
    return dialogue.tokenize_offsets(v.cues(spark, sf), columns=("norm",)).where("norm <> ''").select(
        "media_id", "cue_idx", "token_idx", tx.word_matches(norm, target).alias("matches"))


_TYPE = "coalesce(nullif(regexp_extract(reasoning, '^\\[([^\\]]+)\\]', 1), ''), category)"


@query("finding_type", "findings", f"SELECT id, {_TYPE} AS type FROM findings")
def finding_type(spark, sf):
    return v.findings(spark, sf).select("id", tx.finding_type(F.col("reasoning"), F.col("category")).alias("type"))


@query("strip_policy_note", "findings", "SELECT id, regexp_replace(reasoning, ';?\\s*policy:.*$', '') AS note FROM findings")
def strip_policy_note(spark, sf):
    return v.findings(spark, sf).select("id", tx.strip_policy_note(F.col("reasoning")).alias("note"))


@query("fuzzy_match", "files", """
SELECT file_id, CASE WHEN starts_with(name, 'f1 (') THEN 0 WHEN contains(name, 'f1 (') THEN 1 ELSE 2 END AS rank
FROM (SELECT file_id, lower(split_part(path, '/', -1)) AS name FROM files) WHERE regexp_matches(name, 'f.*1.* .*[(]')""")
def fuzzy_match(spark, sf):
    named = v.files(spark, sf).withColumn("name", F.lower(library.file_name(F.col("path"))))
    return named.where(tx.fuzzy_match("f1 (", F.col("name"))).select("file_id", tx.match_rank("f1 (", F.col("name")).alias("rank"))


@query("base_name_key", "files", "SELECT file_id, lower(split_part(path, '/', -1)) AS name FROM files")
def base_name_key(spark, sf):
    mixed = F.when(F.col("file_id") % 2 == 0, F.replace("path", F.lit("/"), F.lit("\\"))).otherwise(F.col("path"))
    return v.files(spark, sf).select("file_id", tx.base_name_key(mixed).alias("name"))


@query("prompt_digest", "", "SELECT doc_id, sha256(text)[1:16] AS digest FROM documents")
def prompt_digest(spark, sf):
    return v.table(spark, sf, "documents").select("doc_id", tx.prompt_digest(F.col("text")).alias("digest"))


@query("quick_fingerprint", "", """
SELECT page_id, 'quickhash:' || sha256(encode(n::VARCHAR) || unhex(raw[1:128] || raw[2 * greatest(n // 2 - 32, 0) + 1 : 2 * greatest(n // 2 - 32, 0) + 128] ||
  raw[2 * greatest(n - 64, 0) + 1 : 2 * greatest(n - 64, 0) + 128])) AS fingerprint
FROM (SELECT page_id, hex(encode(html)) AS raw, octet_length(encode(html)) AS n FROM pages)""")
def quick_fingerprint(spark, sf):
    return v.table(spark, sf, "pages").select("page_id", tx.quick_fingerprint(F.encode("html", "utf-8"), 64).alias("fingerprint"))


# -- policy and review ------------------------------------------------------------------------------

CLASSIFY = """CASE WHEN sex_act THEN 'sexual_activity' WHEN female_topless OR buttocks_or_genitals THEN 'nudity'
  WHEN kissing_sexual THEN 'intense_kissing' WHEN underwear_only THEN 'suggestive'
  WHEN male_shirtless AND sexualised_framing THEN 'suggestive' WHEN male_shirtless THEN NULL
  WHEN sexualised_framing THEN 'suggestive' {} END"""
_SAMPLE_KEY = ["media_id", "shot_index", "at_ms", "description"]


@query("classify_policy", "samples", f"""
SELECT media_id, shot_index, at_ms, description, {CLASSIFY.format('')} AS category,
  {CLASSIFY.format("WHEN kissing THEN 'intense_kissing'")} AS strict_category FROM samples""")
def classify_policy(spark, sf):
    return v.samples(spark, sf).select(*_SAMPLE_KEY, po.Policy().classify().alias("category"),
                                       po.Policy(flag_any_kissing=True).classify().alias("strict_category"))


@query("is_tentative", "findings", "SELECT id, category = 'suggestive' AS tentative FROM findings")
def is_tentative(spark, sf):
    return v.findings(spark, sf).select("id", po.Policy().is_tentative(F.col("category")).alias("tentative"))


@query("severity_rank", "findings", """
SELECT id, CASE category WHEN 'sexual_activity' THEN 3 WHEN 'nudity' THEN 2 WHEN 'intense_kissing' THEN 1 ELSE 0 END AS severity,
  CASE category WHEN 'nudity' THEN 5 WHEN 'suggestive' THEN 2 WHEN 'profanity' THEN 1 ELSE 0 END AS merge_severity FROM findings""")
def severity_rank(spark, sf):
    return v.findings(spark, sf).select("id", po.severity(F.col("category")).alias("severity"), po.merge_severity(F.col("category")).alias("merge_severity"))


@query("map_category", "verdicts", """
SELECT media_id, seq, CASE upper(category) WHEN 'NUDITY' THEN 'nudity' WHEN 'PARTIAL_NUDITY' THEN 'nudity' WHEN 'KISSING' THEN 'intense_kissing'
  WHEN 'COMPOSITE' THEN 'sexual_activity' ELSE coalesce(lower(category), 'unknown') END AS category FROM verdicts""")
def map_category(spark, sf):
    return v.verdicts(spark, sf).select("media_id", "seq", po.map_category(F.col("category")).alias("category"))


@query("is_visual", "findings", "SELECT id, engine IN ('vlm', 'pureframe') OR category <> 'profanity' AS visual FROM findings")
def is_visual(spark, sf):
    return v.findings(spark, sf).select("id", po.is_visual(F.col("engine"), F.col("category")).alias("visual"))


@query("decision_state", "findings", """
SELECT id, CASE id % 3 WHEN 0 THEN 'cut' WHEN 1 THEN 'leave' ELSE 'undecided' END AS state FROM findings""")
def decision_state(spark, sf):
    return v.findings(spark, sf).select("id", rv.decision_state(F.col("approved")).alias("state"))


@query("review_state", "findings", """
SELECT media_id, CASE WHEN media_id % 5 = 0 THEN 'unanalyzed' WHEN u = 0 THEN 'reviewed' WHEN u = n THEN 'ready' ELSE 'in_progress' END AS state
FROM (SELECT media_id, count(*) AS n, count(*) FILTER (id % 3 = 2 AND media_id % 3 > 0 OR media_id % 3 = 2) AS u FROM findings GROUP BY media_id)""")
def review_state(spark, sf):
    left = F.col("approved").isNull() & (F.col("media_id") % 3 > 0) | (F.col("media_id") % 3 == 2)
    counts = v.findings(spark, sf).groupBy("media_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(left).alias("u"))
    return counts.select("media_id", rv.review_state(F.col("media_id") % 5 != 0, F.col("n"), F.col("u")).alias("state"))


@query("approved_filter", "findings", """
SELECT id, approved IS TRUE AS acts, approved IS DISTINCT FROM false AS renders FROM findings WHERE approved IS DISTINCT FROM false""")
def approved_filter(spark, sf):
    approved = F.col("approved")
    return v.findings(spark, sf).where(rv.not_rejected(approved)).select(
        "id", rv.is_approved(approved).alias("acts"), rv.not_rejected(approved).alias("renders"))


@query("skip_export", "findings", """
SELECT media_id, id, start_ms * 10000 AS start_ticks, end_ms * 10000 AS end_ticks FROM findings WHERE action = 'skip' AND end_ms > start_ms""")
def skip_export(spark, sf):
    shouted = v.findings(spark, sf).withColumn("action", F.when(F.col("id") % 8 == 0, F.upper("action")).otherwise(F.col("action")))
    return shouted.where(rv.is_playback_skip(F.col("action"), F.col("start_ms"), F.col("end_ms"))).select(
        "media_id", "id", tf.ms_to_ticks(F.col("start_ms")).alias("start_ticks"), tf.ms_to_ticks(F.col("end_ms")).alias("end_ticks"))


@query("skip_export_rest", "findings", """
SELECT media_id, count(*) FILTER (NOT (action = 'skip' AND end_ms > start_ms)) AS rest FROM findings GROUP BY media_id""")
def skip_export_rest(spark, sf):
    return v.findings(spark, sf).groupBy("media_id").agg(F.count_if(
        ~rv.is_playback_skip(F.col("action"), F.col("start_ms"), F.col("end_ms"))).alias("rest"))


# -- schedule ---------------------------------------------------------------------------------------

ALLOWED = """
gated AS (SELECT e.event_id, e.ts, (d.enabled AND (d.start_min = d.end_min OR d.start_min < d.end_min AND m >= d.start_min AND m < d.end_min
    OR d.start_min > d.end_min AND m >= d.start_min)) OR (y.enabled AND y.start_min > y.end_min AND m < y.end_min) AS allowed
  FROM (SELECT event_id, ts, isodow(w) - 1 AS dow, hour(w) * 60 + minute(w) AS m
        FROM (SELECT event_id, ts, ts - INTERVAL 7 HOUR AS w FROM events)) e
  JOIN schedule d ON d.dow = e.dow JOIN schedule y ON y.dow = (e.dow + 6) % 7)"""
v.SQL["gated"] = ALLOWED


@query("schedule_allowed", "schedule gated", "SELECT event_id, allowed FROM gated")
def schedule_allowed(spark, sf):
    return v.instants(spark, sf).select("event_id", sc.schedule_allowed(F.col("ts"), v.SCHEDULE).alias("allowed"))


@query("schedule_normalize", "", """
SELECT dow, coalesce(bool_or(enabled), false) AS enabled, coalesce(min(least(greatest(a, 0), 1439)), 0)::INT AS start_min,
  coalesce(min(least(greatest(b, 0), 1439)), 0)::INT AS end_min
FROM (SELECT unnest(range(7))::INT AS dow) LEFT JOIN (SELECT n_regionkey::INT AS dow, true AS enabled, min(n_nationkey * 700 - 500) AS a,
  min(n_nationkey * 700 - 500) + 900 AS b FROM nation GROUP BY n_regionkey) USING (dow) GROUP BY dow""")
def schedule_normalize(spark, sf):
    start = F.col("n_nationkey") * 700 - 500
    days = v.table(spark, sf, "nation").select(F.col("n_regionkey").cast("int").alias("dow"), F.lit(True).alias("enabled"),
                                               start.alias("start_min"), (start + 900).alias("end_min"))
    return sc.schedule_normalize(days)


# -- generators -------------------------------------------------------------------------------------

@query("sample_times", "shots_s", """
SELECT media_id, shot_index, i::INT AS sample_idx, CASE WHEN span <= 0 THEN start_s WHEN n = 1 THEN start_s + span / 2
  ELSE start_s + least(0.25::DOUBLE, span / 10) + (span - 2 * least(0.25::DOUBLE, span / 10)) * i / (n - 1) END AS at_s
FROM (SELECT *, unnest(range(n)) AS i FROM (SELECT media_id, shot_index, start_s, end_s - start_s AS span, CASE WHEN end_s - start_s <= 0 THEN 1 ELSE
  greatest(1, floor((end_s - start_s) / 2.5::DOUBLE)::BIGINT + CASE WHEN end_s - start_s > 2.5::DOUBLE THEN 1 ELSE 0 END, 2) END AS n FROM shots_s))""")
def sample_times(spark, sf):
    return visual.sample_plan(v.shots_s(spark, sf))


@query("keyframe_indices", "shots_s", """
SELECT media_id, shot_index, unnest(list_distinct(CASE WHEN n <= 5 THEN range(start_frame, end_frame) ELSE
  [start_frame, floor(start_frame + (n - 1) / 4.0::DOUBLE)::BIGINT, floor(start_frame + 2 * ((n - 1) / 4.0::DOUBLE))::BIGINT,
   floor(start_frame + 3 * ((n - 1) / 4.0::DOUBLE))::BIGINT, end_frame - 1] END)) AS frame
FROM (SELECT *, end_frame - start_frame AS n FROM shots_s)""")
def keyframe_indices(spark, sf):
    return v.shots_s(spark, sf).select("media_id", "shot_index", F.explode(
        visual.keyframe_indices(F.col("start_frame"), F.col("end_frame"), 5)).alias("frame"))


_EST = """
est AS (SELECT media_id, cue_idx, token_idx, token, start_ms, end_ms, start_ms + greatest(end_ms - start_ms, 240) * char_offset // greatest(length(text), 1) AS a,
    start_ms + greatest(end_ms - start_ms, 240) * char_offset // greatest(length(text), 1) +
    greatest(greatest(end_ms - start_ms, 240) * length(token) // greatest(length(text), 1), 240) AS b
  FROM tokens JOIN cues USING (media_id, cue_idx))"""
v.SQL["est"] = _EST


def _placed(spark, sf):
    rows = dialogue.tokenize_offsets(v.cues(spark, sf).withColumn("n", F.length("text").cast("bigint")), "start_ms", "end_ms", "n",
                                     columns=("char_offset", "word_len"))
    a, b = dialogue.estimate_span(F.col("start_ms"), F.col("end_ms"), F.col("n"), F.col("char_offset"), F.col("word_len"))
    return rows.select("media_id", "cue_idx", "token_idx", "start_ms", "end_ms", a.alias("a"), b.alias("b"))


@query("estimate_word_span", "cues tokens est", "SELECT media_id, cue_idx, token_idx, a AS from_ms, b AS to_ms FROM est")
def estimate_word_span(spark, sf):
    return _placed(spark, sf).select("media_id", "cue_idx", "token_idx", F.col("a").alias("from_ms"), F.col("b").alias("to_ms"))


@query("clamp_word_span", "cues tokens est", """
SELECT media_id, cue_idx, token_idx, CASE WHEN a BETWEEN start_ms - 1500 AND end_ms + 1500 THEN a END AS from_ms,
  CASE WHEN a BETWEEN start_ms - 1500 AND end_ms + 1500 THEN CASE WHEN least(b, a + 1500) <= a THEN a + 240 ELSE least(b, a + 1500) END END AS to_ms
FROM (SELECT media_id, cue_idx, token_idx, start_ms, end_ms, a + token_idx % 7 * 700 - 1800 AS a, b + token_idx % 5 * 900 - 1500 AS b FROM est)""")
def clamp_word_span(spark, sf):
    i = F.col("token_idx")
    a, b = dialogue.clamp_span(F.col("start_ms"), F.col("end_ms"), F.col("a") + i % 7 * 700 - 1800, F.col("b") + i % 5 * 900 - 1500)
    return _placed(spark, sf).select("media_id", "cue_idx", "token_idx", a.alias("from_ms"), b.alias("to_ms"))


@query("window_word_mute", "cues tokens est", """
SELECT media_id, cue_idx, token_idx, greatest(a - 70, 0) AS from_ms, least(greatest(b, a + 240), end_ms + 1000) + 70 AS to_ms
FROM (SELECT media_id, cue_idx, token_idx, end_ms, greatest(start_ms - 1000, a + token_idx % 7 * 700 - 1800) AS a, b + token_idx % 5 * 900 - 1500 AS b FROM est)""")
def window_word_mute(spark, sf):
    i = F.col("token_idx")
    a, b = dialogue.mute_window(F.col("start_ms"), F.col("end_ms"), F.col("a") + i % 7 * 700 - 1800, F.col("b") + i % 5 * 900 - 1500)
    return _placed(spark, sf).select("media_id", "cue_idx", "token_idx", a.alias("from_ms"), b.alias("to_ms"))


@query("first_wins_dedupe", "files", """
SELECT name, arg_min(path, file_id) AS path, min(file_id) AS file_id FROM (SELECT file_id, path, lower(split_part(path, '/', -1)) AS name FROM files) GROUP BY name""")
def first_wins_dedupe(spark, sf):
    named = v.files(spark, sf).select(F.lower(library.file_name(F.col("path"))).alias("name"), "path", "file_id")
    return reconcile.unique_first(named, ["name"], ["file_id"])
