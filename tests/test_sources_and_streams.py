"""Files in, files out, and streams in several batches."""

import random
import re

import pyarrow.parquet as pq
import pytest
from conftest import rows
from pyspark.sql import functions as F

from spanweave.operators import intervals as iv
from spanweave.schema import FINDING, FINDING_COLUMNS, TRANSCRIPT_JSON
from spanweave.sources import readers as rd
from spanweave.sources import sinks as sk
from spanweave.streaming import findings as sf_
from spanweave.streaming import jobs as sj
from spanweave.streaming.state import KeyedLog
from workload.source_queries import scan_transcript_words

SRT = """1
00:00:01,000 --> 00:00:02,000
<i>Hello</i> there

2
00:00:03,000 --> 00:00:04,000
(EXPLOSION)

3
00:00:05,000 --> 00:00:06,500
TONY: Watch
out

junk
"""


def test_srt_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "film.srt").write_bytes(SRT.replace("\n", "\r\n").encode())
    docs = rd.read_documents(spark, str(tmp_path), ".srt")
    cues = rd.parse_srt(docs, "path")
    assert rows(cues, "start_ms", "end_ms", "text") == [(1000, 2000, "Hello there"), (5000, 6500, "Watch out")]
    assert rd.list_files(spark, [str(tmp_path)]).count() == 1
    numbered = cues.withColumn("media_id", F.lit(3).cast("long"))
    sk.write_srt(numbered, str(tmp_path / "out"))
    again = spark.read.text(str(tmp_path / "out"), wholetext=True)
    assert rows(rd.parse_srt(again.withColumnRenamed("value", "text"), "media_id"), "start_ms", "text") == [(1000, "Hello there"), (5000, "Watch out")]


def cues_of(data: bytes) -> list[tuple]:
    """Start and text of the cues of a file, by its definition."""
    text = data.decode(errors="replace").replace("\r\n", "\n").replace("\r", "\n")
    if "â€" in text or "Ã" in text:
        try:
            text = text.encode("cp1252").decode()
        except UnicodeError:
            pass
    found = []
    for number, block in enumerate(re.split(r"\n\s*\n", text)):
        lines = [line for line in block.splitlines() if line.strip()]
        if len(lines) > 1 and "-->" in lines[1] and (said := " ".join(" ".join(lines[2:]).split())):
            minute, second = re.search(r"(\d\d):(\d\d),", lines[1]).groups()
            found.append((number, (int(minute) * 60 + int(second)) * 1000, said))
    return found


def test_srt_files_in_splits(spark, tmp_path):
    """Files that many tasks read give the cues of the whole text: blank lines of all kinds, bytes that are no UTF-8, garbled files."""
    rng, want = random.Random(6), {}
    ends, blanks = ["\n", "\r\n", "\r"], ["", " ", "\t\x0b", "\u3000 ", "\x1c"]
    for f in range(24):
        end, parts = ends[f % 3], [""] * rng.randrange(4) if f % 2 else []
        for i in range(rng.randrange(60)):
            said = rng.choice(["Hello there", "two\u2028lines", "caf\u00e9 \u2026", "\U0001f600 x", "a\x0cb", "-->", ""])
            stamp = f"00:{i:02d}:01,000 --> 00:{i:02d}:02,000"
            parts += rng.choice([[str(i), stamp, said], [str(i), stamp, said, "more"], [stamp, said], [str(i)], ["", str(i), stamp, said]])
            parts += [rng.choice(blanks) for _ in range(rng.randrange(1, 4))]
        data = end.join(parts).encode()
        if f % 4 == 1:
            data = data.replace(b"Hello", b"H\xff\xe2\x82llo\xf0\x9f")
        if f % 4 == 2:  # read as code page 1252 and written again; some with a character that has no place in it
            data = end.join(["1", "00:00:01,000 --> 00:00:02,000", "don\u2019t caf\u00e9", ""] * 5).encode().decode("cp1252").encode()
            data += "\u3042".encode() if f % 8 == 2 else b""
        (tmp_path / f"film {f}.srt").write_bytes(data)
        want[f] = cues_of(data)
    (tmp_path / "empty.srt").write_bytes(b"")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("97", "1024", before):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            cues = rd.read_srt(spark, str(tmp_path)).withColumn("film", F.regexp_extract("path", r"film%20(\d+)", 1).cast("int"))
            assert rows(cues, "film", "cue_idx", "start_ms", "text") == sorted((f, *c) for f, found in want.items() for c in found)
        assert rd.read_srt(spark, str(tmp_path), "empty.srt").count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sum(map(len, want.values())) > 250


def test_srt_blocks_are_joined_where_they_are_read(spark, tmp_path):
    """Lines are not shuffled: only the blocks at both ends of a chunk are. Chunks of one to three lines are put together again."""
    data = "\n\n".join(["", "", *[f"{i}\n00:00:0{i % 10},000 --> 00:00:0{i % 10},500\nline {i}\nmore" + " \n" * (i % 4) for i in range(40)]]).encode()
    (tmp_path / "film.srt").write_bytes(data)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for few in ("1", "2", "3", before):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", few)
            assert rows(rd.read_srt(spark, str(tmp_path)), "cue_idx", "start_ms", "text") == sorted(cues_of(data))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    plan = rd.read_srt(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(path") == 1 and "Window" not in plan


def test_timeline_documents(spark):
    found = spark.createDataFrame([(1, i, 100 * (i % 3), 500, "gore", 0.5, "vlm", "blur", None, None, None) for i in range(1, 8)], FINDING)
    docs = sk.timeline_json(sk.nest_timeline(found, page=3))
    assert docs.count() == 3
    back, headers = rd.parse_timelines(docs)
    assert rows(back) == rows(found) and headers.select("next_segment_id").distinct().collect() == [(8,)]
    bare = spark.createDataFrame([(1, '{"mediaFingerprint": "f", "segments": [{"id": 1, "startMs": 0, "endMs": 1, "category": "x", "confidence": 1, "engine": "e"}]}')],
                                 "media_id long, json string")
    one, head = rd.parse_timelines(bare)
    assert head.first().next_segment_id == 0 and (one.first().action, one.first().approved) == ("blur", None)


@pytest.fixture
def arriving(spark, tmp_path):
    """A table as a stream of three files, one per batch."""
    def make(df, order):
        folder = str(tmp_path / "in")
        for part in range(3):
            df.where(F.col(order) % 3 == part if order == "seq_mix" else F.col("part") == part).coalesce(1).write.mode("append").parquet(folder)
        return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder), str(tmp_path / "out"), str(tmp_path / "cp")
    return make


def test_alerts_over_batches(spark, arriving):
    ticks = spark.range(300).selectExpr("cast(id % 4 as bigint) as job_id", "id as seq", "(id div 4) / 75.0D as fraction",
                                        "concat('s', id div 40) as stage", "if(id % 97 = 96, 'cancelled', 'running') as status", "cast(id div 100 as int) as part")
    stream, out, checkpoint = arriving(ticks, "part")
    sj.stream_decile_alerts(stream, out, checkpoint)
    assert rows(spark.read.parquet(f"{out}/alerts").drop("epoch")) == rows(sj.decile_alerts(ticks)[0])
    sj.stream_progress_state(stream, out + "p", checkpoint + "p")
    state = KeyedLog(spark, out + "p", ["job_id"]).before(3)
    assert rows(state) == rows(sj.progress_state(ticks)) and state.where("status = 'cancelled'").count() > 0


def test_suppression_over_batches(spark, arriving):
    polls = spark.range(400).selectExpr("concat('f', id % 3) as path", "id * 7 div 4 as t_s", "cast(id div 134 as int) as part")
    polls = polls.unionByName(polls.where("path = 'f0'"))
    stream, out, checkpoint = arriving(polls, "part")
    sj.stream_miss_suppression(stream, out, checkpoint)
    want = []
    for path in ("f0", "f1", "f2"):
        last = None
        for t in sorted(r.t_s for r in polls.where(F.col("path") == path).collect()):
            if last is None or t - last >= 30:
                want.append((path, t))
                last = t
    assert rows(sj.miss_rechecks(polls)) == sorted(want)
    assert rows(spark.read.parquet(f"{out}/rechecks").drop("epoch")) == sorted(want)


def test_suppression_of_a_standing_service(spark):
    """Runs over many blocks, pauses that end at, in and beyond a block, and times before the clock's zero."""
    import random

    dice, times, t = random.Random(7), [], -500_000
    while len(times) < 20_000:
        times.append(t)
        t += dice.choice((1, 1, 2, 7, 29, 30, 31, 1)) if dice.random() < 0.999 else dice.choice((1919, 1920, 4000, 130_000, 300_000))
    want, last = [], None
    for t in times:
        if last is None or t - last >= 30:
            want.append(t)
            last = t
    polls = spark.createDataFrame([("film", t) for t in times], "path string, t_s bigint")
    got = sj.miss_rechecks(polls.unionByName(polls))
    assert [r.t_s for r in got.orderBy("t_s").collect()] == want


def test_flags_go_on_numbering(spark, arriving):
    flags = spark.range(30).selectExpr("id % 2 as media_id", "id * 1000 as t_ms", "id as seq", "cast(id div 10 as int) as part")
    stream, out, checkpoint = arriving(flags, "part")
    sj.stream_flag_moments(stream, out, checkpoint, floors=spark.createDataFrame([(1, 40)], "media_id bigint, next_segment_id bigint"))
    made = spark.read.parquet(f"{out}/findings")
    assert rows(made.where("media_id = 0"), "id") == [(i,) for i in range(1, 16)]
    assert rows(made.where("media_id = 1"), "id") == [(i,) for i in range(40, 55)]
    assert set(FINDING_COLUMNS) <= set(made.columns) and made.where("engine <> 'manual' or approved is not true").count() == 0
    assert made.agg(F.min("start_ms")).first()[0] == 0


def test_bursts_of_films_that_arrive_late(spark, arriving):
    hits = spark.range(90).selectExpr("id % 2 as media_id", "id * 400 + if(id > 40, 60000, 0) as start_ms", "id * 400 + 300 + if(id > 40, 60000, 0) as end_ms", "'w' as word",
                                      "1.0D as confidence", "concat('c', id % 3) as context", "id as seq", "cast(id div 30 as int) as part")
    # Film 7 starts at zero when the others have played for long; film 1 gets hits before those it has.
    late = hits.where("part = 0").selectExpr("7L as media_id", "start_ms", "end_ms", "word", "confidence", "context", "seq", "2 as part")
    hits = hits.unionByName(late).unionByName(hits.where("part = 0 and media_id = 1").selectExpr(
        "media_id", "start_ms - 5000 as start_ms", "end_ms - 5000 as end_ms", "'early' as word", "confidence", "context", "seq + 1000 as seq", "2 as part"))
    stream, out, checkpoint = arriving(hits, "part")
    log = sf_.stream_merge_hits(stream, out, checkpoint)
    assert rows(log.latest().select(sorted(log.latest().columns))) == rows(iv.merge_hits(hits).select(sorted(log.latest().columns)))


def test_reanalysis_over_batches(spark, arriving):
    prior = spark.createDataFrame([(m, i, i * 10, i * 10 + 5, "gore", 0.5, "vlm", "blur", True, "r", f"shot-{i}") for m in (1, 2, 3) for i in (1, 2)], FINDING)
    fresh = prior.where("media_id < 3").withColumns({"seq": F.col("id"), "approved": F.lit(None).cast("boolean"), "part": (F.col("media_id") - 1).cast("int")}).drop("id")
    fresh = fresh.unionByName(fresh.where("media_id = 1").withColumn("part", F.lit(2)))
    stream, out, checkpoint = arriving(fresh, "part")
    log = sf_.stream_incremental_reanalysis(stream.drop("part"), prior, out, checkpoint)
    table = log.before(3)
    # Each run replaced the detector's findings and carried the decisions; media 3 was never touched.
    assert rows(table, "media_id", "engine_ref", "approved") == [(m, f"shot-{i}", True) for m in (1, 2) for i in (1, 2)]
    # The second run on media 1 gave new ids again.
    assert rows(table, "media_id", "id") == [(1, 5), (1, 6), (2, 3), (2, 4)]


def test_snapshots(spark, tmp_path):
    log = KeyedLog(spark, str(tmp_path / "log"), ["k"], every=2)
    for epoch in range(5):
        log.write(epoch, spark.createDataFrame([(epoch % 3, epoch)], "k int, v int"))
    assert rows(log.before(5)) == [(0, 3), (1, 4), (2, 2)]


def test_transcripts_refused_by_the_fast_reader_are_read_as_before(spark):
    word = '{"start":0.5,"end":1,"word":"%s","probability":0.25}'
    plain = '{"segments":[{"text":"a \\"b\\"","words":[%s,null,%s]},null,{"text":"c"},{"text":"d","words":[%s]}],"other":{"words":1}}' % tuple(word % w for w in ("a", "\\\\", "d"))
    docs = ["", plain, "{'segments':[{'text':'e','words':[{'word':'e'}]}]}", '{"segments":[{"text":7,"words":[{"word":7}]}]}', "[" + plain + "]", plain + "}", None,
            '{"segments":[]}, "doc":{"segments":[]}', plain + '}\n{"at":9,"doc":' + plain, '{"duration":"x","segments":[{"text":"f","words":[{"word":"f"}]}]}', plain.replace(",", ",\n"),
            '{"segments":[{"words":[{"start":1e999,"word":"\\ud800"}]}]}', "null", '{"segments":null}']
    df = spark.createDataFrame(list(enumerate(docs)), "media_id bigint, json string")
    old = df.select("media_id", F.posexplode(F.from_json("json", TRANSCRIPT_JSON)["segments"]).alias("seg_idx", "s")).select(
        "media_id", "seg_idx", "s.text", F.posexplode("s.words").alias("word_idx", "w")).select(
            "media_id", "seg_idx", "word_idx", "w.start", "w.end", "w.word", "w.probability", "text")
    found = rd.parse_transcripts(df)
    assert rows(found) == rows(old) and len(rows(found)) > 10
    read = rows(df.where("json is not null").withColumn("plain", F.lit(True)).mapInArrow(rd._segment_reader("media_id"), "media_id bigint, json string, seg_idx bigint, seg_text string, "
                "words array<struct<start: double, `end`: double, word: string, probability: double>>"), "media_id", "json")
    # The strict documents do not come back as JSON.
    assert {m for m, json in read if json is None} == {1, 10}


def test_words_of_transcripts_are_written_with_the_text_of_a_segment_once(spark, tmp_path):
    draw = random.Random(7)
    texts = ["\n".join(" ".join(f"{draw.getrandbits(24):x}" for _ in range(200)) for _ in range(10)) for _ in range(300)] + [None, "", "  a\n\n b  c "]
    given = [(i // 2, text) for i, text in enumerate(texts)]
    spark.createDataFrame(given, "doc_id bigint, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    out = scan_transcript_words(spark, str(tmp_path))
    out.write.parquet(f"{tmp_path}/out")
    spoken = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_idx", "word"))), lambda w: w["word"]), " ")
    found = spark.read.parquet(f"{tmp_path}/out").groupBy("media_id", "seg_idx", "seg_text").agg(spoken)
    lines = [(key, i, " ".join(line.split())) for key, text in given for i, line in enumerate((text or "").split("\n"))]
    assert rows(found) == sorted((*line, line[2]) for line in lines if line[2])
    # Only texts that have outgrown the dictionary of their file are written plainly.
    files = [pq.ParquetFile(path).metadata for path in (tmp_path / "out").glob("*.parquet")]
    chunks = [m.row_group(g).column(m.schema.names.index("seg_text")) for m in files for g in range(m.num_row_groups)]
    assert not any("PLAIN" in c.encodings for c in chunks)
    assert sum(len(text or "") for text in texts) > 4 * rd.PART and len(chunks) > 4
