"""Interval algebra against brute force, with one media holding most rows."""

import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from spanweave.operators import intervals as iv
from spanweave.operators import scan
from spanweave.operators.scan import Along, Running, block_of

SPAN = "media_id long, id long, start_ms long, end_ms long, approved boolean, action string"


@pytest.fixture(scope="module")
def spans(spark):
    """A third of all spans in one media, many of them copies, across many blocks."""
    rng = random.Random(5)
    out = []
    for i in range(600):
        media = 7 if i % 3 == 0 else rng.randrange(20)
        start = rng.choice([0, 3_600_000, rng.randrange(40_000_000)])
        out.append((media, i, start, start + rng.choice([0, 5, 90_000, rng.randrange(4_000_000)]), rng.choice([True, False, None]), "skip"))
    return out, spark.createDataFrame(out, SPAN)


def union(spans, gap=0):
    merged = []
    for a, b in sorted(spans):
        if merged and a - merged[-1][1] <= gap:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    return merged


def by_media(spans):
    out = {}
    for s in spans:
        out.setdefault(s[0], []).append(s)
    return out


@pytest.mark.parametrize("gap", [0, 750])
def test_merge(spans, gap):
    data, df = spans
    want = sorted((m, a, b) for m, group in by_media(data).items() for a, b in union([(s[2], s[3]) for s in group], gap))
    assert rows(iv.merge_spans(df, gap_ms=gap), "media_id", "start_ms", "end_ms") == want


def test_keep_tiles_the_runtime(spark, spans):
    data, df = spans
    media = spark.createDataFrame([(m, 60_000_000) for m in range(25)], "media_id long, duration_ms long")
    keeps, cuts = by_media(rows(iv.keep_intervals(df, media))), by_media(rows(iv.merge_spans(df)))
    for m in range(25):
        pieces = sorted([k[1:] for k in keeps.get(m, [])] + [c[1:] for c in cuts.get(m, []) if c[1] < c[2]])
        at = 0
        for a, b in pieces:
            assert a == at
            at = b
        assert at == 60_000_000


def test_map_round_trip(spark, spans):
    data, df = spans
    media = spark.createDataFrame([(m, 60_000_000) for m in range(25)], "media_id long, duration_ms long")
    mapping = iv.time_map(iv.keep_intervals(df, media))
    points = mapping.selectExpr("media_id", "clip_ms + len_ms div 2 + 2 as out_ms", "rel_ms + len_ms div 2 + 2 as want").where("len_ms > 10")
    back = iv.map_output_to_source(points, mapping.select("media_id", "rel_ms", "clip_ms", "len_ms"))
    assert back.where("source_ms <> want").count() == 0 and back.count() > 30


def test_coverage_and_nearest(spark, spans):
    data, df = spans
    rng = random.Random(9)
    windows = []
    for i in range(120):
        a = rng.choice([0, 3_600_000, rng.randrange(40_000_000)])
        windows.append((i, rng.choice([7, rng.randrange(22)]), a, a + rng.choice([10, 3_000_000]), i))
    wdf = spark.createDataFrame(windows, "window_id long, media_id long, win_start long, win_end long, selected_id long")
    groups, want = by_media(data), []
    for w, m, a, b, _ in windows:
        hit = [(s[2], s[3]) for s in groups.get(m, []) if s[4] is True and s[3] > a and s[2] < b]
        want.append((w, m, len(hit), sum(y - x for x, y in union(hit))))
    assert rows(iv.coverage_ms(df, wdf), "window_id", "media_id", "regions", "removed_ms") == want
    pairs = sorted((w, s[1]) for w, m, a, b, _ in windows for s in groups.get(m, [])
                   if s[3] > a and s[2] < b and min(s[3], b) - max(s[2], a) > 20)
    assert rows(iv.window_overlap(df, wdf), "window_id", "id") == pairs

    want = []
    for w, m, a, b, _ in windows:
        group = sorted(groups.get(m, []), key=lambda s: (s[2], s[1]))
        inside = sorted((s for s in group if s[2] <= b <= s[3]), key=lambda s: s[3] - s[2])
        near = inside[0] if inside else min(group, key=lambda s: min(abs(b - s[2]), abs(b - s[3])), default=None)
        want.append((w, near and near[1]))
    asked = wdf.selectExpr("window_id", "media_id", "win_end as t_ms")
    assert rows(iv.nearest_finding(df, asked), "window_id", "finding_id") == want


def test_bursts(spark):
    df = spark.createDataFrame([
        (1, 1000, 1500, "a", 0.9, "one two", 1), (1, 1900, 2400, "b", 0.8, "two", 2), (1, 2500, 2600, "c", 0.95, "three", 3),
        (1, 9000, 9500, "d", 0.7, "four", 4), (1, 10250, 10300, "e", 0.7, "four", 5)],
        "media_id long, start_ms long, end_ms long, word string, confidence double, context string, seq long")
    assert rows(iv.merge_hits(df), "start_ms", "end_ms", "word", "confidence", "context") == [
        (1000, 2600, "a, b, c", 0.8, "one two … three"), (9000, 10300, "d, e", 0.7, "four")]


def test_running_levels_and_rank(spark):
    rng = random.Random(3)
    data = [(rng.choice(["hot", "x"]), i, rng.randrange(100)) for i in range(500)]
    rng.shuffle(data)
    df = spark.createDataFrame(data, "k string, i long, n long")
    levels = [("i", block_of("i", 64)), ("i", block_of("i", 8))]
    got = scan.running(df, ["k"], ["i"], levels, s=Running("sum", df.n), m=Running("max", df.n, True), p=Running("last", df.i))
    want, state = [], {}
    for k, i, n in sorted(data, key=lambda r: r[1]):
        s, m, p = state.get(k, (0, -1, None))
        want.append((k, i, n, s, max(m, n), p))
        state[k] = (s + n, max(m, n), i)
    assert rows(got, "k", "i", "n", "s", "m", "p") == sorted(want)
    ranked = rows(scan.global_rank(df, [Along(F.col("n"), descending=True), Along(F.col("i"))], "r"), "r", "n", "i")
    assert [(n, i) for _, n, i in ranked] == sorted(((n, i) for _, i, n in data), key=lambda t: (-t[0], t[1]))
    assert [r for r, _, _ in ranked] == list(range(1, 501))


def test_rank_by_split_points(spark):
    """Nulls at either end, a value that a third of the rows have, copies of a row, and a sketch that has points."""
    rng = random.Random(8)
    data = [(rng.choice([None, 7, rng.randrange(-50, 50)]) if i % 3 else 7, rng.choice([None, "b", "a", "Z"]), i if i % 50 else 0) for i in range(6000)]
    df = spark.createDataFrame(data, "p long, s string, i long")
    ranked = scan.global_rank(df, [Along(F.col("p"), nulls_last=True), Along(F.col("s"), descending=True), Along(F.col("i"))], "r")

    def place(row):
        p, s, i = row
        return (p is None, p or 0), (s is not None, -ord(s) if s else 0), i

    got = rows(ranked, "r", "p", "s", "i")
    assert [g[0] for g in got] == list(range(1, len(data) + 1))
    assert [g[1:] for g in got] == sorted(data, key=place)
    assert rows(ranked.repartition(3), "r", "p", "s", "i") == rows(scan.global_rank(df.repartition(11, "s"), [Along(F.col("p"), nulls_last=True), Along(F.col("s"), descending=True), Along(F.col("i"))], "r"), "r", "p", "s", "i")
    held = scan.global_rank(df, [Along(F.col("i"))], "r").groupBy(F.spark_partition_id()).count()
    assert held.count() > 1  # the ranges share the work
    assert scan.global_rank(df.where("i < 0"), [Along(F.col("i"))], "r").columns == ["p", "s", "i", "r"]
    assert scan.global_rank(df.where("i < 0"), [Along(F.col("i"))], "r").count() == 0
    assert rows(scan.global_rank(df.where("i = 1"), [Along(F.col("i"))], "r"), "r", "i") == [(1, 1)]


def test_a_long_burst_holds_each_context_once(spark):
    hits = spark.range(100_000).selectExpr(
        "1L as media_id", "id * 100 as start_ms", "id * 100 + 50 as end_ms", "'w' as word", "1.0D as confidence", "if(id % 11 = 10, null, concat('said ', id % 11)) as context", "id as seq")
    burst = iv.merge_bursts(iv.hit_bursts(hits)).collect()
    assert len(burst) == 1 and len(burst[0].words) == 100_000
    assert [c.context for c in burst[0].contexts] == [*[f"said {i}" for i in range(10)], ""]
    named = iv.merge_hits(hits).first()
    assert named.context == " … ".join(f"said {i}" for i in range(10)) and named.word.count("w") == 100_000


def test_bursts_against_a_fold(spark):
    rng = random.Random(4)
    made = [(m, rng.randrange(0, 20_000, 250), w, rng.choice([None, "", "a", "a b", "b … a", "c", "b c"]), i) for i, (m, w) in enumerate((rng.randrange(3), rng.choice("xyz")) for _ in range(150))]
    hits = spark.createDataFrame([(m, t, t + 100, w, 0.5, c, i % 40) for m, t, w, c, i in made],
                                 "media_id long, start_ms long, end_ms long, word string, confidence double, context string, seq long")
    want, last = [], {}
    for m, t, i, w, c in sorted((m, t, i % 40, w, c or "") for m, t, w, c, i in made):
        if m in last and t - last[m][2] <= 300:
            open_ = last[m]
            open_[2], open_[3] = t + 100, f"{open_[3]}, {w}"
            open_[4] = open_[4] if c in open_[4] else f"{open_[4]} … {c}"
        else:
            want.append([m, t, t + 100, w, c])
            last[m] = want[-1]
    assert rows(iv.merge_hits(hits, gap_ms=300), "media_id", "start_ms", "end_ms", "word", "context") == sorted(map(tuple, want))


def test_frames_of_shots_that_overlap_and_of_those_that_do_not(spark):
    from spanweave.operators import visual
    shots = [(1, 0, 0, 5), (1, 1, 5, 9), (1, 2, 7, 12), (1, 3, 20, 23), (1, 4, 0, 40), (2, 0, 3, 3), (2, 1, 3, 6)]
    acts = [(1, 0, 1, "BLACK_BOX", [0, 0, 4, 9]), (1, 0, 2, "FULL_FRAME_BLUR", []), (1, 0, 3, "BLACK_BOX", [1]), (1, 1, 4, "BLACK_BOX", [8]),
            (1, 2, 5, "FULL_FRAME_BLUR", []), (1, 2, 6, "BLACK_BOX", [7, 8]), (1, 3, 7, "BLACK_BOX", [21]), (1, 4, 8, "NONE", [22]), (2, 1, 9, "BLACK_BOX", [4, 4])]
    boxes = "array<struct<frame_idx bigint, x1 bigint, y1 bigint, x2 bigint, y2 bigint>>"
    verdicts = spark.createDataFrame([(m, s, q, a, [(f, 0, 0, 1, 1) for f in b]) for m, s, q, a, b in acts], f"media_id bigint, shot_index bigint, seq bigint, action string, boxes {boxes}")
    table = spark.createDataFrame(shots, "media_id bigint, shot_index bigint, start_frame bigint, end_frame bigint")
    spans, want = {(m, s): range(a, b) for m, s, a, b in shots}, []
    for m, f in sorted({(m, f) for m, s, _, a, _ in acts if a != "NONE" for f in spans[m, s]}):
        here = [(q, a, b) for n, s, q, a, b in acts if n == m and a != "NONE" and f in spans[m, s]]
        full = min((q for q, a, _ in here if a == "FULL_FRAME_BLUR"), default=None)
        seqs = [q for q, a, b in here if a == "BLACK_BOX" for x in b if x == f and (full is None or q < full)]
        want += [(m, f, "BLACK_BOX" if full is None else "FULL_FRAME_BLUR", q, i + 1) for i, q in enumerate(sorted(seqs) or [None])]
    found = visual.frame_action_join(verdicts, table)
    order = lambda r: (r[0], r[1], r[4])
    assert sorted((tuple(r) for r in found.select("media_id", "frame", "action", "seq", "nth").collect()), key=order) == sorted(want, key=order)


def test_events_are_read_once_for_their_marks_and_once_for_their_cues(spark, tmp_path):
    from spanweave.operators import media as md
    events = [(1, 0, "a"), (1, 500, None), (1, 900, None), (1, 4000, "b"), (1, 5000, ""), (2, 100, None), (2, 3_700_000, "c"), (2, 3_700_100, None)]
    spark.createDataFrame(events, "media_id long, t_ms long, text string").write.parquet(str(tmp_path / "rendered"))
    found = md.cue_end_from_blanks(spark.read.parquet(str(tmp_path / "rendered")))
    assert rows(found) == [(1, 0, 900, "a"), (1, 4000, 11000, "b"), (2, 3_700_000, 3_700_300, "c")]
    assert found._jdf.queryExecution().optimizedPlan().collectLeaves().mkString().count("text#") == 1
