"""Readers, writers, streams inside a container, and audio samples."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from spanweave.functions.text import collapse_space
from spanweave.functions.timefmt import ms_to_ts
from spanweave.operators import media as md
from spanweave.session import scratch_path
from spanweave.sources import readers as rd
from spanweave.sources import sinks as sk
from workload import views as v
from workload.registry import query
from workload.review_queries import _COLS
from workload.scalar_queries import stamp

SQL = v.SQL


@query("fingerprint_files", "", """
WITH files AS (SELECT source, encode(string_agg(coalesce(text, '') || chr(10), '' ORDER BY doc_id)) AS content FROM documents GROUP BY source),
sized AS (SELECT source, hex(content) AS raw, octet_length(content) AS n FROM files)
SELECT source, 'quickhash:' || sha256(encode(n::VARCHAR) || unhex(raw[1:8192] || raw[2 * greatest(n // 2 - 2048, 0) + 1 : 2 * greatest(n // 2 - 2048, 0) + 8192] ||
  raw[2 * greatest(n - 4096, 0) + 1 : 2 * greatest(n - 4096, 0) + 8192])) AS fingerprint FROM sized""")
def fingerprint_files(spark, sf):
    """The documents of each source written to a file, which is fingerprinted where it lies."""
    folder = scratch_path(spark, "films")
    docs = v.table(spark, sf, "documents").select("source", "doc_id", F.coalesce("text", F.lit("")).alias("value"))
    docs.repartition("source").sortWithinPartitions("source", "doc_id").drop("doc_id").write.partitionBy("source").text(folder)
    files = rd.list_files(spark, [folder])
    source = F.regexp_extract("path", "/source=([^/]*)/", 1)
    return rd.fingerprint_files(files, 4096).select(F.when(source != "__HIVE_DEFAULT_PARTITION__", source).alias("source"), "fingerprint")

# -- documents --------------------------------------------------------------------------------------


def srt_text(spark, sf):
    """Each document as a subtitle file: a numbered block per line, in italics."""
    def block(line, i):
        at = i.cast("bigint") * 3000
        return F.concat((i + 1).cast("string"), F.lit("\n"), ms_to_ts(at), F.lit(" --> "), ms_to_ts(at + 2000), F.lit("\n<i>"), line, F.lit("</i>\n"))
    return v.table(spark, sf, "documents").select(
        F.col("doc_id").alias("media_id"), F.array_join(F.transform(F.split("text", "\n"), block), "\n").alias("text"))


_CLEANED = v._space_sql("regexp_replace(regexp_replace(replace(replace('<i>' || line || '</i>', chr(12), ' '), chr(11), ' '), '<[^>]+>|[{][^}]*[}]', '', 'g'), "
                        "'[(][^)]*[)]|[[][^]]*[]]|^[A-Z][A-Z ''.]{1,20}:', ' ', 'g')")


@query("scan_srt_cues", "cues", f"""
SELECT media_id, cue_idx::BIGINT AS cue_idx, 3000 * cue_idx AS start_ms, 3000 * cue_idx + 2000 AS end_ms, {_CLEANED} AS text FROM cue_lines WHERE {_CLEANED} <> ''""")
def scan_srt_cues(spark, sf):
    return rd.parse_srt(srt_text(spark, sf))


@query("scan_srt_files", "cues", f"""
SELECT source, shelf, row_number - 1 AS cue_idx, start_ms, start_ms + 2000 AS end_ms, text FROM (
  SELECT d.source, d.doc_id // 4096 AS shelf, row_number() OVER (PARTITION BY d.source, d.doc_id // 4096 ORDER BY c.media_id, c.cue_idx) AS row_number,
    3000 * c.cue_idx AS start_ms, {_CLEANED} AS text FROM cue_lines c JOIN documents d ON d.doc_id = c.media_id) WHERE text <> ''""")
def scan_srt_files(spark, sf):
    """The documents as subtitle files, one per source and shelf of 4,096 ids, read in splits."""
    folder = scratch_path(spark, "subtitles")
    docs = v.table(spark, sf, "documents").select(F.col("doc_id").alias("media_id"), "source", F.expr("doc_id div 4096").alias("shelf"))
    files = srt_text(spark, sf).where("text IS NOT NULL").join(docs, "media_id").repartition("source", "shelf").sortWithinPartitions("source", "shelf", "media_id")
    files.select("source", "shelf", F.col("text").alias("value")).write.partitionBy("source", "shelf").text(folder)
    part = r"/source=([^/]*)/shelf=(\d+)/"
    return rd.read_srt(spark, folder, ".txt").select(
        F.regexp_extract("path", part, 1).alias("source"), F.regexp_extract("path", part, 2).cast("bigint").alias("shelf"), "cue_idx", "start_ms", "end_ms", "text")


@query("scan_transcript_words", "words", "SELECT media_id, seg_idx, word_idx, start_s, end_s, word, probability, seg_text FROM words")
def scan_transcript_words(spark, sf):
    """Transcript documents written as JSON and parsed back."""
    docs = rd.in_small_parts(v.table(spark, sf, "documents").select("doc_id", "text")).select(
        F.col("doc_id").cast("bigint").alias("media_id"), F.transform(F.split(F.make_valid_utf8("text"), "\n"), collapse_space).alias("lines"))
    return rd.parse_transcripts(docs.mapInArrow(_transcripts(), "media_id bigint, json string"))


def _transcripts():
    """Lists of lines as transcripts, a segment every three seconds and a word every 120 ms, with a document's JSON made of whole columns."""
    def joined(items, counts, between=","):
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), items)
        return pc.binary_join(lists, between)

    def numbers(values):
        return pc.cast(pa.array(values), pa.string())

    def documents(ids, lists):
        n_lines = pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64)
        text = pc.replace_substring(pc.replace_substring(lists.flatten(), "\\", "\\\\"), '"', '\\"')
        if pc.any(pc.match_substring_regex(text, r"[\x00-\x1f]")).as_py():
            for code in range(32):
                text = pc.replace_substring(text, chr(code), f"\\u{code:04x}")
        owner = np.repeat(np.arange(len(n_lines)), n_lines)
        line_at = (np.arange(len(owner)) - (np.cumsum(n_lines) - n_lines)[owner]) * 3000
        split = pc.split_pattern(text, " ")
        counts = pc.list_value_length(split).to_numpy().astype(np.int64)
        line = np.repeat(np.arange(len(counts)), counts)
        place = np.arange(len(line)) - (np.cumsum(counts) - counts)[line]
        start = (line_at[line] + place * 120) / 1000
        share = np.fmod(ids.to_numpy()[owner][line] * 7 + place, 100) / 100
        words = joined(pc.binary_join_element_wise('{"start":', numbers(start), ',"end":', numbers(start + 0.1), ',"word":"', split.flatten(),
                                                   '","probability":', numbers(share), "}", ""), counts)
        # A blank line has no words.
        listed = pc.if_else(pc.equal(text, ""), "", pc.binary_join_element_wise(',"words":[', words, "]", ""))
        segments = pc.binary_join_element_wise('{"start":', numbers(line_at / 1000), ',"end":', numbers(line_at / 1000 + 2), ',"text":"', text, '"', listed, "}", "")
        whole = pc.binary_join_element_wise('{"model":"base","duration":1.0,"segments":[', joined(segments, n_lines), "]}", "")
        return pa.RecordBatch.from_arrays([ids, whole], names=["media_id", "json"])

    def run(batches):
        for batch in batches:
            few = max(1, min(batch.num_rows, batch.num_rows * (1 << 20) // max(batch.nbytes, 1)))
            for at in range(0, batch.num_rows, few):
                yield documents(*batch.slice(at, few).columns)

    return run


def _timelines(spark, sf):
    return sk.timeline_json(sk.nest_timeline(v.findings(spark, sf)))


@query("scan_timelines", "findings", f"SELECT {_COLS} FROM findings")
def scan_timelines(spark, sf):
    return rd.parse_timelines(_timelines(spark, sf))[0]


@query("scan_timeline_headers", "findings", "SELECT media_id, NULL::VARCHAR AS fingerprint, max(id) + 1 AS next_segment_id FROM findings GROUP BY media_id")
def scan_timeline_headers(spark, sf):
    return rd.parse_timelines(_timelines(spark, sf))[1]


@query("nest_timeline", "findings", """
SELECT media_id, (row_number() OVER (PARTITION BY media_id ORDER BY start_ms, id) - 1) // 25 AS page, start_ms, id,
  max(id) OVER (PARTITION BY media_id) + 1 AS next_segment_id FROM findings""")
def nest_timeline(spark, sf):
    """Pages of 25, unfolded again; ``pos`` inside a page follows the start."""
    nested = sk.nest_timeline(v.findings(spark, sf), page=25)
    return nested.select("media_id", "page", "next_segment_id", F.explode("segments").alias("s")).select(
        "media_id", "page", F.col("s.startMs").alias("start_ms"), "s.id", "next_segment_id")


def _plan_docs(spark, sf):
    """A customer's orders as a plan: a shot each, and one verdict or two, the first with boxes."""
    key, at = F.col("o_orderkey"), F.col("o_orderkey") % 200 * 31.0
    shot = F.struct(key.alias("index"), (key * 10).alias("start_frame"), (key * 10 + 9).alias("end_frame"), at.alias("start_time"), (at + 7.25).alias("end_time"))
    box = lambda i: F.struct((key * 10 + i).alias("frame_idx"), F.lit(i).alias("x1"), F.lit(20).alias("y1"), (key % 700).alias("x2"), F.lit(90).alias("y2"))
    boxes = F.array(box(0), box(1))

    def verdict(category, boxes):
        return F.struct(key.alias("shot_index"), v._pick(F.col("o_orderstatus"), [("F", "NONE"), ("O", "BLACK_BOX")]).alias("action"),
                        F.lit(category).alias("category"), F.lit(0.75).alias("confidence"), F.col("o_orderpriority").alias("reasoning"), boxes.alias("boxes"))

    first, second = verdict("KISSING", boxes), verdict("NUDITY", F.slice(boxes, 1, 0))
    order = F.struct(key.alias("k"), shot.alias("shot"), F.when(key % 2 == 0, F.array(first)).otherwise(F.array(first, second)).alias("verdicts"))
    plans = v.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("media_id")).agg(F.array_sort(F.collect_list(order)).alias("o"))
    return plans.select("media_id", F.to_json(F.struct(F.col("o.shot").alias("shots"), F.flatten("o.verdicts").alias("verdicts"))).alias("json"))


@query("scan_detection_plan", "", """
SELECT o_custkey AS media_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey, second) - 1 AS seq, o_orderkey AS shot_index,
  o_orderkey % 200 * 31000 AS start_ms, o_orderkey % 200 * 31000 + 7250 AS end_ms, CASE o_orderstatus WHEN 'F' THEN 'NONE' WHEN 'O' THEN 'BLACK_BOX' END AS action,
  CASE second WHEN 0 THEN 'KISSING' ELSE 'NUDITY' END AS category, 0.75::DOUBLE AS confidence, o_orderpriority AS reasoning,
  CASE second WHEN 1 THEN '[]' ELSE '[{"frame_idx":' || o_orderkey * 10 || ',"x1":0,"y1":20,"x2":' || o_orderkey % 700 || ',"y2":90},{"frame_idx":' ||
    (o_orderkey * 10 + 1) || ',"x1":1,"y1":20,"x2":' || o_orderkey % 700 || ',"y2":90}]' END AS boxes
FROM orders, (SELECT unnest([0, 1]) AS second) WHERE second <= o_orderkey % 2""")
def scan_detection_plan(spark, sf):
    shots, verdicts = rd.parse_plans(_plan_docs(spark, sf))
    return verdicts.withColumn("boxes", F.to_json("boxes")).join(shots.select("media_id", "shot_index", "start_ms", "end_ms"), ["media_id", "shot_index"])


@query("scan_shots", "shots_s", "SELECT media_id, shot_index, start_frame, end_frame, start_s, end_s FROM shots_s")
def scan_shots(spark, sf):
    """All shots of a media in one document."""
    shot = F.struct(F.col("shot_index").alias("index"), "start_frame", "end_frame", "start_s", "end_s")
    listed = v.shots_s(spark, sf).groupBy("media_id").agg(F.to_json(F.array_sort(F.collect_list(shot))).alias("json"))
    return rd.parse_shots(listed)


@query("format_srt", "cues", f"""
SELECT media_id, n, n || chr(10) || {stamp('start_ms')} || ' --> ' || {stamp('end_ms')} || chr(10) || text || chr(10) AS block
FROM (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY cue_idx) AS n FROM cues)""")
def format_srt(spark, sf):
    return sk.format_srt(v.cues(spark, sf))


# -- container and audio ----------------------------------------------------------------------------

@query("pick_text_stream", "streams", """
SELECT media_id, first(index ORDER BY language <> 'eng', index) AS index FROM streams WHERE codec = 'subrip' GROUP BY media_id""")
def pick_text_stream(spark, sf):
    return md.pick_text_stream(v.streams(spark, sf))


@query("pick_image_stream", "streams", """
SELECT media_id, CASE WHEN first(packets ORDER BY language <> 'eng', packets DESC, index) > 50 THEN first(index ORDER BY language <> 'eng', packets DESC, index) END AS index
FROM streams WHERE codec <> 'subrip' GROUP BY media_id""")
def pick_image_stream(spark, sf):
    return md.pick_image_stream(v.streams(spark, sf))


@query("packet_times", "findings", """
SELECT id, trunc((start_ms / 1000.0::DOUBLE) * 1000)::BIGINT AS start_ms, trunc((start_ms / 1000.0::DOUBLE) * 1000)::BIGINT + CASE id % 4 WHEN 0 THEN 300 WHEN 1 THEN 300 WHEN 2 THEN 300
  ELSE trunc(confidence * 1000)::BIGINT + CASE WHEN confidence = 0 THEN 300 ELSE 0 END END AS end_ms FROM findings WHERE id % 10 <> 9""")
def packet_times(spark, sf):
    ident = F.col("id")
    packets = v.findings(spark, sf).select(
        "id", F.when(ident % 10 == 9, "N/A").otherwise((F.col("start_ms") / 1000).cast("string")).alias("pts_time"),
        v._pick(ident % 4, [(0, F.lit("")), (1, F.lit("0.000")), (2, F.lit("N/A")), (3, F.col("confidence").cast("string"))]).alias("duration_time"))
    return md.packet_times(packets)


SQL["frames"] = """
frames AS (SELECT media_id, start_ms AS t_ms, CASE WHEN cue_idx % 11 = 5 THEN '' ELSE text END AS text FROM cues
  UNION ALL SELECT media_id, start_ms + (cue_idx * 37 % 2999) * 3 + 1, NULL FROM cues WHERE cue_idx % 3 <> 0)"""


@query("cue_end_from_blanks", "cues frames", """
SELECT media_id, c.t_ms AS start_ms, least(greatest(coalesce(blank_ms, c.t_ms + 7000), c.t_ms + 300), c.t_ms + 7000) AS end_ms, text FROM frames c LEFT JOIN (
  SELECT media_id, of, max(t_ms) AS blank_ms FROM (SELECT *, max(CASE WHEN text <> '' THEN t_ms END) OVER (PARTITION BY media_id ORDER BY t_ms) AS of FROM frames)
  WHERE text IS NULL GROUP BY media_id, of) b USING (media_id) WHERE text <> '' AND (b.of = c.t_ms) UNION ALL
SELECT media_id, t_ms, t_ms + 7000, text FROM frames c WHERE text <> '' AND NOT EXISTS (SELECT 1 FROM (
  SELECT media_id, of FROM (SELECT *, max(CASE WHEN text <> '' THEN t_ms END) OVER (PARTITION BY media_id ORDER BY t_ms) AS of FROM frames) WHERE text IS NULL) b
  WHERE b.media_id = c.media_id AND b.of = c.t_ms)""")
def cue_end_from_blanks(spark, sf):
    cues = v.cues(spark, sf)
    shown = cues.select("media_id", F.col("start_ms").alias("t_ms"), F.when(F.col("cue_idx") % 11 == 5, "").otherwise(F.col("text")).alias("text"))
    blank = cues.where("cue_idx % 3 <> 0").select("media_id", (F.col("start_ms") + F.col("cue_idx") * 37 % 2999 * 3 + 1).alias("t_ms"), F.lit(None).cast("string").alias("text"))
    return md.cue_end_from_blanks(shown.unionByName(blank))


@query("peaks", "pcm", """
WITH sized AS (SELECT media_id, count(*) AS n, round_even((0.5 + media_id % 7 * 0.25) * 40, 0)::BIGINT AS b FROM pcm GROUP BY media_id)
SELECT media_id, sample_idx // (n // b) AS bucket_idx, round_even(max(abs(amplitude)) / 32768.0::DOUBLE, 3) AS peak FROM pcm JOIN sized USING (media_id)
WHERE n >= b AND sample_idx // (n // b) < b GROUP BY ALL UNION ALL SELECT media_id, unnest(range(b)), 0.0 FROM sized WHERE n < b""")
def peaks(spark, sf):
    windows = v.table(spark, sf, "embeddings").select(F.col("vec_id").alias("media_id"), (F.col("vec_id") % 7 * 0.25 + 0.5).cast("double").alias("duration_s"))
    return md.peaks(v.pcm(spark, sf), windows)


SQL["wave"] = """
wave AS (SELECT vec_id AS media_id, i - 1 AS sample_idx, embedding[i]::DOUBLE * 8 AS x FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings))"""
_SUBTRACT = """
SELECT media_id, sample_idx, least(greatest(CASE WHEN sample_idx BETWEEN 10 AND 29 AND media_id % 2 = 0 OR sample_idx >= 40 THEN x - x / 4 ELSE x END, -1.0), 1.0)::DOUBLE AS amplitude FROM wave"""


def _audio(spark, sf):
    long = v.table(spark, sf, "embeddings").select(F.col("vec_id").alias("media_id"), F.posexplode("embedding").alias("i", "x")).select(
        "media_id", F.col("i").cast("bigint").alias("sample_idx"), (F.col("x").cast("double") * 8).alias("amplitude"))
    span = F.struct(F.lit(10).cast("bigint").alias("a"), F.lit(20).cast("bigint").alias("b"))
    pieces = F.array_compact(F.array(
        F.when(F.col("vec_id") % 2 == 0, span), F.when(F.col("vec_id") % 2 == 0, F.struct(F.lit(15).cast("bigint").alias("a"), F.lit(30).cast("bigint").alias("b"))),
        F.struct(F.lit(40).cast("bigint").alias("a"), F.size("embedding").cast("bigint").alias("b"))))
    spans = v.table(spark, sf, "embeddings").select(F.col("vec_id").alias("media_id"), F.explode(pieces).alias("p")).select(
        "media_id", F.col("p.a").alias("from_idx"), F.col("p.b").alias("to_idx"))
    return long, spans


@query("span_subtract", "wave", _SUBTRACT)
def span_subtract(spark, sf):
    mix, spans = _audio(spark, sf)
    return md.span_subtract(mix, mix.withColumn("amplitude", F.col("amplitude") / 4), spans)


def _load_quarter():
    return lambda window, rate: window / 4


@query("separator_hook", "wave", _SUBTRACT)
def separator_hook(spark, sf):
    """The same, with the stem coming from a user's separator."""
    mix, spans = _audio(spark, sf)
    windows = v.table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("media_id"), F.lit(0).cast("bigint").alias("window_id"), F.lit(0).cast("bigint").alias("from_idx"),
        F.transform("embedding", lambda x: x.cast("double") * 8).alias("samples"))
    return md.span_subtract(mix, md.separate_stems(windows, _load_quarter, 8000), spans)
