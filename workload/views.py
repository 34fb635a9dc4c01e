"""The library's tables derived from the benchmark tables, in Spark and as DuckDB text.

Every view is a projection, so a view adds no shuffle of its own to the plan under test.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanweave.functions.schedule import DayWindow, Schedule
from spanweave.functions.text import collapse_space, not_blank


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    """The documents, on every core: a small file may come as a single split, a large table does not."""
    docs, cores = table(spark, sf, "documents"), spark.sparkContext.defaultParallelism
    return docs.repartition(cores, "doc_id") if docs.rdd.getNumPartitions() < cores else docs


_SPACE = (r"[\t\n\x0b\x0c\r \x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}"
          r"\x{3000}]+")


def _space_sql(text: str) -> str:
    return f"trim(regexp_replace({text}, '{_SPACE}', ' ', 'g'))"


SQL: dict[str, str] = {}

# -- text -------------------------------------------------------------------------------------------


def cues(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of documents, three seconds apart; blank ones are no cues."""
    lines = documents(spark, sf).select(
        F.col("doc_id").alias("media_id"), F.posexplode(F.split("text", "\n")).alias("i", "line"))
    # Blank lines go by a test of their own, or the text would be made once to be tested and once to be kept.
    return lines.where(not_blank(F.col("line"))).select(
        "media_id", F.col("i").cast("bigint").alias("cue_idx"), collapse_space(F.col("line")).alias("text")).select(
            "media_id", "cue_idx", (F.col("cue_idx") * 3000).alias("start_ms"),
            (F.col("cue_idx") * 3000 + F.least(F.length("text") * 40 + 300, F.lit(2900))).cast("bigint").alias("end_ms"),
            "text")


SQL["cues"] = f"""
cue_lines AS (SELECT doc_id AS media_id, unnest(string_split(text, chr(10))) AS line,
    unnest(range(len(string_split(text, chr(10))))) AS cue_idx FROM documents),
cues AS (SELECT media_id, cue_idx, 3000 * cue_idx AS start_ms,
    3000 * cue_idx + least(300 + 40 * length(text), 2900) AS end_ms, text
  FROM (SELECT media_id, cue_idx::BIGINT AS cue_idx, {_space_sql('line')} AS text FROM cue_lines) WHERE text <> '')"""


def words(spark: SparkSession, sf: str) -> DataFrame:
    """A transcript: cue tokens, 120 ms apart."""
    tokens = cues(spark, sf).select("media_id", "cue_idx", "start_ms", "text", F.posexplode(F.split("text", " ")).alias("i", "word"))
    at = (F.col("start_ms") + F.col("i") * 120) / 1000
    return tokens.select(
        "media_id", F.col("cue_idx").alias("seg_idx"), F.col("i").cast("bigint").alias("word_idx"),
        at.alias("start_s"), (at + 0.1).alias("end_s"), "word",
        (((F.col("media_id") * 7 + F.col("i")) % 100) / 100).alias("probability"), F.col("text").alias("seg_text"))


SQL["words"] = SQL["cues"] + """,
words AS (SELECT media_id, seg_idx, i AS word_idx, (start_ms + 120 * i) / 1000.0::DOUBLE AS start_s,
    (start_ms + 120 * i) / 1000.0::DOUBLE + 0.1::DOUBLE AS end_s, word, ((media_id * 7 + i) % 100) / 100.0::DOUBLE AS probability,
    text AS seg_text
  FROM (SELECT media_id, cue_idx AS seg_idx, start_ms, text, unnest(string_split(text, ' ')) AS word,
        unnest(range(len(string_split(text, ' '))))::BIGINT AS i FROM cues))"""

# -- findings ---------------------------------------------------------------------------------------

_CATEGORY = {"error": "nudity", "purchase": "sexual_activity", "view": "intense_kissing", "click": "suggestive",
             "signup": "profanity"}


def _pick(column, options):
    out = None
    for value, result in options:
        out = F.when(column == value, result) if out is None else out.when(column == value, result)
    return out


def findings(spark: SparkSession, sf: str) -> DataFrame:
    """Events as findings: a user is a media, an event a span beginning at its instant."""
    e = table(spark, sf, "events")
    ident, kind = F.col("event_id"), F.col("event_type")
    start = F.timestamp_diff("MILLISECOND", F.lit("2024-01-01").cast("timestamp_ntz"), F.col("ts").cast("timestamp_ntz"))
    shot = F.get_json_object("props", "$.k").cast("bigint")
    return e.select(
        F.col("user_id").alias("media_id"), ident.alias("id"), start.alias("start_ms"),
        (start + F.floor(F.col("value") * 100 + 0.5) * 6000).cast("bigint").alias("end_ms"),
        _pick(kind, _CATEGORY.items()).alias("category"), ((ident % 100) / 100).alias("confidence"),
        F.when(kind == "signup", "subtitles").when(kind == "purchase", "pureframe").otherwise("vlm").alias("engine"),
        _pick(ident % 4, [(0, "skip"), (1, "mute"), (2, "blur"), (3, "voice")]).alias("action"),
        _pick(ident % 3, [(0, True), (1, False)]).alias("approved"),
        F.when(kind == "signup", F.concat(F.lit("[w"), (ident % 5).cast("string"), F.lit("] heard")))
        .otherwise(F.concat(F.lit("seen "), shot.cast("string"), F.lit("; policy: default"))).alias("reasoning"),
        F.when(ident % 5 != 0, F.concat(F.lit("shot-"), shot.cast("string"))).alias("engine_ref"))


SQL["findings"] = """
findings AS (SELECT user_id AS media_id, event_id AS id, start_ms,
    start_ms + floor(value * 100 + 0.5)::BIGINT * 6000 AS end_ms,
    CASE event_type WHEN 'error' THEN 'nudity' WHEN 'purchase' THEN 'sexual_activity' WHEN 'view' THEN 'intense_kissing'
      WHEN 'click' THEN 'suggestive' WHEN 'signup' THEN 'profanity' END AS category,
    (event_id % 100) / 100.0::DOUBLE AS confidence,
    CASE event_type WHEN 'signup' THEN 'subtitles' WHEN 'purchase' THEN 'pureframe' ELSE 'vlm' END AS engine,
    CASE event_id % 4 WHEN 0 THEN 'skip' WHEN 1 THEN 'mute' WHEN 2 THEN 'blur' ELSE 'voice' END AS action,
    CASE event_id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS approved,
    CASE WHEN event_type = 'signup' THEN '[w' || (event_id % 5) || '] heard'
      ELSE 'seen ' || k || '; policy: default' END AS reasoning,
    CASE WHEN event_id % 5 <> 0 THEN 'shot-' || k END AS engine_ref
  FROM (SELECT *, epoch_us(ts) // 1000 - 1704067200000 AS start_ms, (props::JSON->>'$.k')::BIGINT AS k FROM events))"""


def media(spark: SparkSession, sf: str) -> DataFrame:
    """Every media with findings, a month long, so that each has a tail."""
    return table(spark, sf, "events").select(F.col("user_id").alias("media_id")).distinct().withColumn(
        "duration_ms", F.lit(2_678_400_000))


SQL["media"] = "media AS (SELECT DISTINCT user_id AS media_id, 2678400000::BIGINT AS duration_ms FROM events)"


def flags(spark: SparkSession, sf: str) -> DataFrame:
    """Playback positions: the instants of all events."""
    return findings(spark, sf).select("media_id", F.col("start_ms").alias("t_ms"), F.col("id").alias("flag_id"))


SQL["flags"] = "flags AS (SELECT media_id, start_ms AS t_ms, id AS flag_id FROM findings)"


def windows(spark: SparkSession, sf: str, half_ms: int = 10_800_000) -> DataFrame:
    """Three hours either side of a flag."""
    return flags(spark, sf).select(
        F.col("flag_id").alias("window_id"), "media_id", F.greatest(F.col("t_ms") - half_ms, F.lit(0)).alias("win_start"),
        (F.col("t_ms") + half_ms).alias("win_end"), F.col("flag_id").alias("selected_id"))


SQL["windows"] = SQL["flags"] + """,
windows AS (SELECT flag_id AS window_id, media_id, greatest(t_ms - 10800000, 0) AS win_start, t_ms + 10800000 AS win_end,
    flag_id AS selected_id FROM flags)"""


def prior(spark: SparkSession, sf: str) -> DataFrame:
    return findings(spark, sf).where("id % 2 = 0")


def fresh(spark: SparkSession, sf: str) -> DataFrame:
    """The other half as a new detector run: undecided, not yet numbered."""
    return findings(spark, sf).where("id % 2 = 1").withColumns(
        {"seq": F.col("id"), "approved": F.lit(None).cast("boolean")}).drop("id")


SQL["prior_fresh"] = """
prior AS (SELECT * FROM findings WHERE id % 2 = 0),
fresh AS (SELECT * EXCLUDE (id) REPLACE (NULL::BOOLEAN AS approved), id AS seq FROM findings WHERE id % 2 = 1)"""


def edits(spark: SparkSession, sf: str) -> DataFrame:
    """Partial updates of every seventh finding, two for every twenty-first."""
    base = findings(spark, sf).where("id % 7 = 0")
    kinds = F.array(F.array(F.lit("approved")), F.array(F.lit("start_ms"), F.lit("end_ms")),
                    F.array(F.lit("action"), F.lit("category")), F.array(F.lit("reasoning"), F.lit("approved")))
    n = F.explode(F.when(F.col("id") % 21 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    rows = base.withColumn("n", n)
    return rows.select(
        "media_id", "id", (F.col("id") * 2 + F.col("n")).alias("seq"), F.get(kinds, ((F.col("id") + F.col("n")) % 4).cast("int")).alias("fields_sent"),
        F.when(F.col("id") % 2 == 0, True).alias("approved"), (F.col("end_ms") + 1000).alias("start_ms"),
        (F.col("start_ms") - 5000).alias("end_ms"), F.when(F.col("id") % 8 != 2, "blur").alias("action"),
        F.lit(None).cast("string").alias("reasoning"), F.lit("gore").alias("category"))


SQL["edits"] = """
edits AS (SELECT media_id, id, id * 2 + n AS seq, (id + n) % 4 AS kind, CASE WHEN id % 2 = 0 THEN true END AS approved,
    end_ms + 1000 AS start_ms, start_ms - 5000 AS end_ms, CASE WHEN id % 8 <> 2 THEN 'blur' END AS action
  FROM findings, (SELECT unnest([0, 1]) AS n) WHERE id % 7 = 0 AND (n = 0 OR id % 21 = 0))"""


def picks(spark: SparkSession, sf: str) -> DataFrame:
    """Selections for merging: up to three findings that share a quotient of their start."""
    return findings(spark, sf).where("id % 4 < 3").select(
        "media_id", F.expr("start_ms div 86400000").alias("merge_id"), "id")


SQL["picks"] = "picks AS (SELECT media_id, start_ms // 86400000 AS merge_id, id FROM findings WHERE id % 4 < 3)"

# -- shots ------------------------------------------------------------------------------------------


def shots(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as shots, two hundred to a media, one every 31 seconds."""
    return table(spark, sf, "orders").select(
        F.expr("o_orderkey div 200").alias("media_id"), (F.col("o_orderkey") % 200).alias("shot_index"),
        (F.col("o_orderkey") % 200 * 31000).alias("start_ms"),
        (F.col("o_orderkey") % 200 * 31000 + 500 + F.floor("o_totalprice") % 30000).alias("end_ms"))


SQL["shots"] = """
shots AS (SELECT o_orderkey // 200 AS media_id, o_orderkey % 200 AS shot_index, o_orderkey % 200 * 31000 AS start_ms,
    o_orderkey % 200 * 31000 + 500 + floor(o_totalprice)::BIGINT % 30000 AS end_ms FROM orders)"""


def shots_s(spark: SparkSession, sf: str) -> DataFrame:
    """The same shots as a shot detector writes them: frames and seconds."""
    return shots(spark, sf).select(
        "media_id", "shot_index", F.expr("start_ms div 40").alias("start_frame"), F.expr("end_ms div 40").alias("end_frame"),
        (F.col("start_ms") / 1000).alias("start_s"), (F.col("end_ms") / 1000).alias("end_s"))


SQL["shots_s"] = SQL["shots"] + """,
shots_s AS (SELECT media_id, shot_index, start_ms // 40 AS start_frame, end_ms // 40 AS end_frame,
    start_ms / 1000.0::DOUBLE AS start_s, end_ms / 1000.0::DOUBLE AS end_s FROM shots)"""


def durations(spark: SparkSession, sf: str) -> DataFrame:
    """True runtimes that stretch the shots of a media by 0.90 to 1.69; every eleventh media has no shots yet."""
    return table(spark, sf, "orders").select(F.expr("o_orderkey div 200").alias("m")).distinct().select(
        F.explode(F.array(F.col("m"), F.when(F.col("m") % 11 == 0, F.lit(-1) - F.col("m")))).alias("media_id")).where(
            "media_id is not null").withColumn(
                "duration_s", (F.abs("media_id") % 80 + 90) * 62.0)


SQL["durations"] = """
durations AS (SELECT m AS media_id, (abs(m) % 80 + 90) * 62.0::DOUBLE AS duration_s
  FROM (SELECT DISTINCT o_orderkey // 200 AS m FROM orders
        UNION SELECT DISTINCT -1 - o_orderkey // 200 FROM orders WHERE (o_orderkey // 200) % 11 = 0))"""

_OBSERVED = {
    "female_topless": ("l_partkey", 29), "buttocks_or_genitals": ("l_partkey", 31), "underwear_only": ("l_suppkey", 11),
    "male_shirtless": ("l_suppkey", 7), "sex_act": ("l_partkey", 97), "kissing": ("l_suppkey", 5),
    "kissing_sexual": ("l_partkey", 23), "sexualised_framing": ("l_partkey", 13)}


def samples(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as sampled frames with eight observations."""
    return table(spark, sf, "lineitem").select(
        F.expr("l_orderkey div 200").alias("media_id"), (F.col("l_orderkey") % 200).alias("shot_index"),
        (F.col("l_orderkey") % 200 * 31000 + F.col("l_linenumber") * 100).cast("bigint").alias("at_ms"),
        *[(F.col(c) % m == 0).alias(n) for n, (c, m) in _OBSERVED.items()],
        F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("description"))


SQL["samples"] = """
samples AS (SELECT l_orderkey // 200 AS media_id, l_orderkey % 200 AS shot_index,
    l_orderkey % 200 * 31000 + 100 * l_linenumber AS at_ms, """ + ", ".join(
        f"{c} % {m} = 0 AS {n}" for n, (c, m) in _OBSERVED.items()) + """,
    'part ' || l_partkey AS description FROM lineitem)"""


def verdicts(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as verdicts on shots; one in a hundred names a shot that does not exist."""
    item = table(spark, sf, "lineitem")
    number = F.col("l_linenumber")
    cents = F.floor(F.col("l_extendedprice") * 100 + 0.5)
    seq = (F.col("l_orderkey") % 200 * 10 + F.col("l_linenumber")) * 100_000_000 + cents % 100_000_000
    return item.select(
        F.expr("l_orderkey div 200").alias("media_id"), seq.alias("seq"),
        (F.col("l_orderkey") % 200 + F.when(F.col("l_partkey") % 100 == 0, 1000).otherwise(0)).alias("shot_index"),
        _pick(F.col("l_returnflag"), [("A", "FULL_FRAME_BLUR"), ("R", "BLACK_BOX")]).alias("flagged"),
        _pick(number, [(1, "NUDITY"), (2, "PARTIAL_NUDITY"), (3, "KISSING"), (4, "COMPOSITE"), (5, "Other")]).alias("category"),
        F.col("l_discount").alias("confidence")).withColumn(
            "action", F.when(F.col("flagged").isNull() & (F.col("seq") % 2 == 0), "NONE").otherwise(F.col("flagged"))).drop("flagged")


SQL["verdicts"] = """
verdicts AS (SELECT media_id, seq, shot_index, CASE WHEN flagged IS NULL AND seq % 2 = 0 THEN 'NONE' ELSE flagged END AS action,
    category, confidence FROM (SELECT l_orderkey // 200 AS media_id,
    (l_orderkey % 200 * 10 + l_linenumber) * 100000000 + floor(l_extendedprice * 100 + 0.5)::BIGINT % 100000000 AS seq,
    l_orderkey % 200 + CASE WHEN l_partkey % 100 = 0 THEN 1000 ELSE 0 END AS shot_index,
    CASE l_returnflag WHEN 'A' THEN 'FULL_FRAME_BLUR' WHEN 'R' THEN 'BLACK_BOX' END AS flagged,
    CASE l_linenumber WHEN 1 THEN 'NUDITY' WHEN 2 THEN 'PARTIAL_NUDITY' WHEN 3 THEN 'KISSING' WHEN 4 THEN 'COMPOSITE'
      WHEN 5 THEN 'Other' END AS category, l_discount AS confidence FROM lineitem))"""

# -- jobs and files ---------------------------------------------------------------------------------

_STATUS = ("queued", "running", "completed", "failed", "cancelled", "rendering", "rendered")
_ENGINE = ("vlm", "subtitles", "whisper", "pureframe", "render")


def jobs(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as jobs on five hundred films."""
    key = F.col("o_orderkey")
    return table(spark, sf, "orders").select(
        key.cast("string").alias("id"), F.concat(F.lit("/lib/Film "), (F.col("o_custkey") % 500).cast("string"), F.lit(".mkv")).alias("media_path"),
        _pick(F.substring("o_orderpriority", 1, 1), [(str(i + 1), e) for i, e in enumerate(_ENGINE)]).alias("engine"),
        _pick(key % 7, list(enumerate(_STATUS))).alias("status"), F.col("o_orderdate").cast("timestamp").alias("created_at"),
        F.when(key % 3 != 0, key % 1000).alias("queue_position"),
        F.concat(F.lit("fp-"), (F.col("o_custkey") % 97).cast("string")).alias("fingerprint"))


SQL["jobs"] = """
jobs AS (SELECT o_orderkey::VARCHAR AS id, '/lib/Film ' || (o_custkey % 500) || '.mkv' AS media_path,
    ['vlm', 'subtitles', 'whisper', 'pureframe', 'render'][o_orderpriority[1]::INT] AS engine,
    ['queued', 'running', 'completed', 'failed', 'cancelled', 'rendering', 'rendered'][o_orderkey % 7 + 1] AS status,
    o_orderdate AS created_at, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey % 1000 END AS queue_position,
    'fp-' || (o_custkey % 97) AS fingerprint FROM orders)"""


def files(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as files: films, rendered copies, timelines and subtitles under three roots."""
    key = F.col("p_partkey")
    group = F.expr("p_partkey div 4")
    ending = _pick(key % 4, [(0, ".mkv"), (1, ".MP4"), (2, ".timeline.json"), (3, ".en.srt")])
    return table(spark, sf, "part").select(
        key.alias("file_id"), (F.col("p_size") % 3).cast("bigint").alias("root_idx"), F.concat(
            F.lit("/root"), (F.col("p_size") % 3).cast("string"), F.lit("/"), F.replace(F.col("p_brand"), F.lit("#"), F.lit("")), F.lit("/Film "),
            (group % 997).cast("string"), F.lit(" ("), (group % 70 + 1950).cast("string"), F.lit(")"),
            F.when(key % 17 == 0, " (Clean)").otherwise(""), ending).alias("path"))


SQL["files"] = """
files AS (SELECT p_partkey AS file_id, (p_size % 3)::BIGINT AS root_idx, '/root' || (p_size % 3) || '/' || replace(p_brand, '#', '') ||
    '/Film ' || ((p_partkey // 4) % 997) || ' (' || ((p_partkey // 4) % 70 + 1950) || ')' ||
    CASE WHEN p_partkey % 17 = 0 THEN ' (Clean)' ELSE '' END ||
    ['.mkv', '.MP4', '.timeline.json', '.en.srt'][p_partkey % 4 + 1] AS path FROM part)"""


def streams(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("s_suppkey")
    return table(spark, sf, "supplier").select(
        F.col("s_nationkey").cast("bigint").alias("media_id"), key.alias("index"),
        _pick(key % 3, [(0, "dvd_subtitle"), (1, "subrip"), (2, "hdmv_pgs_subtitle")]).alias("codec"),
        F.when(key % 2 == 0, "eng").otherwise("spa").alias("language"), (F.floor(F.abs("s_acctbal")) % 1500).alias("packets"))


SQL["streams"] = """
streams AS (SELECT s_nationkey::BIGINT AS media_id, s_suppkey AS index, ['dvd_subtitle', 'subrip', 'hdmv_pgs_subtitle'][s_suppkey % 3 + 1] AS codec,
    CASE WHEN s_suppkey % 2 = 0 THEN 'eng' ELSE 'spa' END AS language, floor(abs(s_acctbal))::BIGINT % 1500 AS packets FROM supplier)"""


def pcm(spark: SparkSession, sf: str, scale: int = 32767) -> DataFrame:
    """Embedding components as audio samples."""
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("media_id"), F.posexplode("embedding").alias("i", "x")).select(
            "media_id", F.col("i").cast("bigint").alias("sample_idx"), F.floor(F.col("x").cast("double") * scale).cast("bigint").alias("amplitude"))


SQL["pcm"] = """
pcm AS (SELECT media_id, i - 1 AS sample_idx, floor(e[i]::DOUBLE * 32767)::BIGINT AS amplitude
  FROM (SELECT vec_id AS media_id, embedding AS e, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings))"""

# -- instants ---------------------------------------------------------------------------------------


def instants(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"))


#: Monday 23:00 to 07:00, Tuesday to Friday 02:00 to 07:00, Saturday all day, Sunday off.
SCHEDULE = Schedule.of(True, [DayWindow(True, 1380, 420)] + [DayWindow(True, 120, 420)] * 4
                       + [DayWindow(True, 0, 0), DayWindow(False, 0, 0)], "America/Denver")
SQL["schedule"] = """
schedule(dow, enabled, start_min, end_min) AS (VALUES (0, true, 1380, 420), (1, true, 120, 420), (2, true, 120, 420),
  (3, true, 120, 420), (4, true, 120, 420), (5, true, 0, 0), (6, false, 0, 0))"""


def ticks(spark: SparkSession, sf: str) -> DataFrame:
    """Progress reports: a user is a job, big errors cancel it."""
    return table(spark, sf, "events").select(
        F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), ((F.col("event_id") % 997) / 997).alias("fraction"),
        F.col("event_type").alias("stage"), F.col("ts").cast("timestamp").alias("ts"),
        F.when((F.col("event_type") == "error") & (F.col("value") > 150), "cancelled").otherwise("running").alias("status"))


SQL["ticks"] = """
ticks AS (SELECT user_id AS job_id, event_id AS seq, (event_id % 997) / 997.0::DOUBLE AS fraction, event_type AS stage, ts,
    CASE WHEN event_type = 'error' AND value > 150 THEN 'cancelled' ELSE 'running' END AS status FROM events)"""


def polls(spark: SparkSession, sf: str) -> DataFrame:
    """Requests for films without a timeline, seconds on a shrunken clock."""
    return table(spark, sf, "events").select(
        F.concat(F.lit("film"), (F.col("user_id") % 20).cast("string")).alias("path"),
        F.expr("timestampdiff(SECOND, timestamp_ntz'2024-01-01', cast(ts as timestamp_ntz)) div 100").alias("t_s"), F.col("event_id").alias("poll_id"))


SQL["polls"] = """
polls AS (SELECT 'film' || (user_id % 20) AS path, (epoch_us(ts) // 1000000 - 1704067200) // 100 AS t_s, event_id AS poll_id FROM events)"""
