"""Aligned ranges, interval joins, edits and bursts against brute force, with skew, long spans and odd orders."""

import hashlib
import random
from datetime import date

import pytest
from conftest import rows
from pyspark.sql import functions as F

from spanweave.functions.text import quick_fingerprint
from spanweave.operators import dialogue
from spanweave.operators import intervals as iv
from spanweave.operators import ranges
from spanweave.operators import reconcile as rc
from spanweave.operators.ranges import best_holder, with_ranges
from spanweave.schema import FINDING
from spanweave.sources.readers import fingerprint_files, list_files
from spanweave.streaming.state import TieredRuns

SPAN = "media_id long, id long, start_ms long, end_ms long, approved boolean, action string"


def test_aligned_ranges_tile_their_range(spark):
    rng = random.Random(1)
    asked = [(a, a + rng.choice([-3, 0, 1, 2, rng.randrange(5000)])) for a in (rng.randrange(-4000, 4000) for _ in range(300))] + [(0, 1 << 50), (5, 1 << 45)]
    found = {}
    for a, b, level, node in rows(with_ranges(spark.createDataFrame(asked, "a long, b long").distinct(), F.col("a"), F.col("b")), "a", "b", "__level", "__node"):
        assert level % 2 == 0
        found.setdefault((a, b), []).append((node << level, (node + 1) << level))
    for a, b in asked:
        pieces = sorted(found.get((a, b), []))
        if b <= a:
            assert not pieces
        else:
            assert len(pieces) <= 6 * 32 and pieces[0][0] == a and pieces[-1][1] == b and all(x[1] == y[0] for x, y in zip(pieces, pieces[1:]))


@pytest.fixture(scope="module")
def crowd(spark):
    """A third of the findings in one media and one hour, some far longer than all else."""
    rng = random.Random(7)
    out = []
    for i in range(500):
        start = rng.randrange(3_600_000) if i % 3 == 0 else rng.randrange(30_000_000)
        length = rng.choice([0, 1, 20, 50, 4_000, rng.randrange(3_000_000)])
        out.append((7 if i % 3 == 0 else rng.randrange(9), i, start, start + length, rng.choice([True, False, None]), rng.choice(["skip", "mute", "voice", "blur", "none"])))
    out += [(7, 1000, 0, 1 << 44, True, "skip"), (7, 1001, 10, 5, True, "skip")]
    windows = [(w, rng.choice([7, rng.randrange(9)]), a, a + rng.choice([0, 1, 50, 600_000, 5_000_000]), rng.randrange(500)) for w, a in enumerate(rng.randrange(30_000_000) for _ in range(120))]
    return out, spark.createDataFrame(out, SPAN), windows, spark.createDataFrame(windows, "window_id long, media_id long, win_start long, win_end long, selected_id long")


def test_window_overlap_forms_no_other_pairs(crowd):
    data, df, windows, wdf = crowd
    want = []
    for w, m, a, b, _ in windows:
        for media, i, s, e, *_ in data:
            if media == m and e >= s and e > a and s < b and min(e, b) - a - max(s - a, 0) > 20:
                want.append((w, i, max(s - a, 0), min(e, b) - a))
    found = iv.window_overlap(df, wdf)
    assert rows(found, "window_id", "id", "rel_start", "rel_end") == sorted(want)
    assert "__level" not in found.columns and found.select("window_id", "id").distinct().count() == len(want)


def test_plans_of_windows(crowd):
    data, df, windows, wdf = crowd
    plan = {"skip": "cuts", "mute": "mutes", "voice": "voices", "blur": "blurs"}
    want = sorted((w, i, plan[act], max(s, a), min(e, b)) for w, m, a, b, chosen in windows for media, i, s, e, ok, act in data
                  if media == m and s <= e and e > a and s < b and (ok or i == chosen) and act in plan)
    assert rows(iv.time_bucket_split(df, wdf), "window_id", "id", "plan", "from_ms", "to_ms") == want


def test_coverage_in_one_scan(crowd):
    data, df, windows, wdf = crowd
    want = []
    for w, m, a, b, _ in windows:
        inside = sorted((s, e) for media, _, s, e, ok, _ in data if media == m and ok and s <= e and e > a and s < b)
        merged = []
        for s, e in inside:
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        if b > a:
            want.append((w, len(inside), sum(e - s for s, e in merged)))
    got = [r for r in rows(iv.coverage_ms(df, wdf), "window_id", "regions", "removed_ms") if r[0] in {x[0] for x in want}]
    assert got == sorted(want)


def test_holder_of_any_length(spark, crowd):
    data, df, _, _ = crowd
    points = [(7, t) for t in (0, 4, 5, 10, 1 << 43, (1 << 44) - 1, 1 << 44, (1 << 44) + 1, -3)] + [(3, 5_000_000)]
    asked = spark.createDataFrame(points, "media_id long, t_ms long")
    got = {(r.media_id, r.t_ms): r.best.id for r in best_holder(df, asked, ["media_id"], df.start_ms, df.end_ms + 1, "t_ms", F.struct("start_ms", "id")).collect()}
    want = {}
    for m, t in points:
        held = [(s, i) for media, i, s, e, *_ in data if media == m and s <= t <= e]
        if held:
            want[m, t] = min(held)[1]
    assert got == want


def folded(a, b, edits):
    for sent, x, y in edits:
        a, b = (max(x, 0) if "start_ms" in sent and x is not None else a), (max(y, 0) if "end_ms" in sent and y is not None else b)
        a, b = min(a, b), max(a, b)
    return a, b


@pytest.mark.parametrize("n, ids, spread", [(4000, 700, 3), (30_000, 2, 1_000_003)])
def test_edits_compose_as_they_fold(spark, n, ids, spread):
    """Runs of edits in any number per finding; orders below zero and with gaps, equal edits sent again."""
    rng = random.Random(n)
    findings = [(1, i, *rng.sample(range(1000), 2), "gore", 0.5, "vlm", "blur", None, "r", None) for i in range(ids + 2)]
    edits = []
    for k in range(n):
        sent = rng.choice([["start_ms"], ["end_ms"], ["start_ms", "end_ms"], ["approved"], ["start_ms", "action"], []])
        edits.append((1, rng.randrange(ids), (k - n // 2) * spread, sent, rng.choice([None, rng.randrange(-50, 1000)]), rng.choice([None, rng.randrange(1000)]), "skip", True))
    last = (n - n // 2) * spread + 5
    edits += [(1, 0, last, ["start_ms"], 400, None, "skip", True)] * 3
    by_id = {}
    for e in sorted(edits, key=lambda e: e[2]):
        by_id.setdefault(e[1], []).append((e[3], e[4], e[5]))
    rng.shuffle(edits)
    df = spark.createDataFrame(edits, "media_id long, id long, seq long, fields_sent array<string>, start_ms long, end_ms long, action string, approved boolean").repartition(4)
    got = {r.id: (r.start_ms, r.end_ms) for r in rc.apply_edits(spark.createDataFrame(findings, FINDING), df).collect()}
    assert got == {f[1]: folded(f[2], f[3], by_id[f[1]]) if f[1] in by_id else (f[2], f[3]) for f in findings}


def test_first_holder_of_many_cuts_in_an_hour(spark):
    """Thousands of findings and cuts in one hour of one media, as look-ups."""
    findings = spark.range(5000).selectExpr("1L as media_id", "id", "id * 300 as start_ms", "id * 300 + 900000 as end_ms", "'gore' as category", "0.5D as confidence",
                                            "'vlm' as engine", "'skip' as action", "cast(null as boolean) as approved", "'r' as reasoning", "cast(null as string) as engine_ref")
    cuts = spark.range(3000).selectExpr("1L as media_id", "id * 700 + 13 as t_ms")
    out = rc.split_findings(findings, cuts)
    assert out.count() == 5000 + 2999  # no cut but the first lies too close to an edge of every finding
    first = {i: (s, e) for i, s, e in rows(out.where("id < 5000"), "id", "start_ms", "end_ms")}
    assert first[0] == (0, 713) and first[4999] == (4999 * 300, 4999 * 300 + 900000)


def test_prefixes_are_looked_up_at_their_lengths(spark):
    lexicon = spark.createDataFrame([(f"p{i:04}", "extra", "prefix") for i in range(2000)] + [("p", "mild", "exact"), ("fu", "strong", "prefix"), ("x" * 300, "strong", "prefix")],
                                    "word string, tier string, match_kind string")
    words = ["p", "p0007", "p0007" + "z" * 2_000_000, "p00", "fun", "f", "", "x" * 299, "x" * 1_000_000]
    tokens = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "token_idx long, norm string")
    assert rows(dialogue.lexicon_join(tokens, lexicon), "token_idx", "tier") == [(0, "mild"), (1, "extra"), (2, "extra"), (4, "strong"), (8, "strong")]


def test_runs_of_bursts_cost_what_arrives(spark, tmp_path):
    """Any order of arrival; an epoch reads nothing of the past but for the runs that it compacts, and readers meet few runs."""
    rng = random.Random(4)
    hits = [(rng.choice([1, 1, 2]), s, s + 400, "w", 0.5 + rng.random() / 2, f"c{rng.randrange(3)}", i) for i, s in enumerate(rng.randrange(60_000) for _ in range(90))]
    df = spark.createDataFrame(hits, "media_id long, start_ms long, end_ms long, word string, confidence double, context string, seq long")
    read = []

    def merge(bursts):
        read.append(len(bursts.inputFiles()))
        return iv.merge_bursts(bursts).coalesce(1)

    runs = TieredRuns(spark, str(tmp_path / "runs"), merge, lambda b: iv.named_bursts(iv.merge_bursts(b)), fan=3)
    for epoch in range(20):
        read.clear()
        runs.write(epoch, iv.hit_bursts(df.where(df.seq % 20 == epoch)))
        assert read[0] == 0 and max(read) <= 3 and len(read) == 1 + sum((epoch + 1) % 3 ** k == 0 for k in (1, 2))
    for epoch in (0, 1, 8, 12, 19):
        want = iv.merge_hits(df.where(df.seq % 20 <= epoch))
        assert rows(runs.latest(epoch)) == rows(want.select(runs.latest(epoch).columns)) and len(runs.runs(epoch)) <= 2 * 3
    runs.write(19, iv.hit_bursts(df.where(df.seq % 20 == 19)))  # again, as after a failure
    assert runs.last_epoch() == 19 and rows(runs.latest()) == rows(iv.merge_hits(df).select(runs.latest().columns))
    assert [len(runs.runs(e)) for e in (26, 27, 199)] == [1, 2, 2 + 0 + 1 + 1 + 2]
    assert TieredRuns(spark, str(tmp_path / "none"), merge).last_epoch() is None


def test_fingerprints_of_files_in_place(spark, tmp_path):
    small = {"empty.mkv": b"", "one.mkv": b"x", "chunk.mkv": bytes(range(64)), "odd name %20.mkv": bytes(range(200)) * 3}
    for name, content in small.items():
        (tmp_path / name).write_bytes(content)
    # Spark's listing leaves out empty files.
    empty = spark.createDataFrame([(str(tmp_path / "empty.mkv"), 0)], "path string, length long")
    listed = list_files(spark, [str(tmp_path)], "*.mkv").select("path", "length").unionByName(empty).withColumn("clash", F.lit(date(2024, 1, 1)))
    got = {p.rsplit("/", 1)[1]: f for p, f in rows(fingerprint_files(listed, 64))}
    contents = spark.createDataFrame(list(small.items()), "name string, content binary")
    assert got == dict(rows(contents.select("name", quick_fingerprint(F.col("content"), 64))))
    huge = tmp_path / "huge.bin"  # 5 GB with holes: what is not read costs nothing
    size = 5 * 1000 ** 3
    with huge.open("wb") as f:
        for at, mark in ((0, b"head"), (size // 2, b"middle"), (size - 4, b"tail")):
            f.seek(at)
            f.write(mark)
    asked = spark.createDataFrame([(f"file://{huge}", size), (str(huge), size), ("/none/x.mkv", 5), (None, 1)], "path string, length long")
    digest, chunk = hashlib.sha256(str(size).encode()), 8 << 20
    with huge.open("rb") as f:
        for at in (0, size // 2 - chunk // 2, size - chunk):
            f.seek(at)
            digest.update(f.read(chunk))
    want = f"quickhash:{digest.hexdigest()}"
    assert rows(fingerprint_files(asked)) == sorted([(None, None), ("/none/x.mkv", None), (str(huge), want), (f"file://{huge}", want)], key=lambda r: (r[0] is not None, r[0] or ""))


def test_ranges_unfold_to_no_more_rows_than_they_hold_points(spark):
    """Long spans over few points: neither many ranges, nor a plan that sends what they unfold to every task."""
    spans = spark.range(200).selectExpr("id % 3 AS media_id", "id * 50 + 1 AS start_ms", "id * 50 + 99999999 AS end_ms", "id")
    points = spark.createDataFrame([(m, t) for m in range(3) for t in (7, 5000, 2_000_000)], "media_id bigint, t_ms bigint")
    held, _ = ranges.placed_ranges(spans, points, ["media_id"], F.col("start_ms"), F.col("end_ms"), F.col("t_ms"))
    assert held.count() <= 200 * 3
    want = sorted((m, t, i) for m in range(3) for t in (7, 5000, 2_000_000) for i in range(200) if i % 3 == m and i * 50 + 1 <= t < i * 50 + 99999999)
    pairs = ranges.held_pairs(spans, points, ["media_id"], F.col("start_ms"), F.col("end_ms"), F.col("t_ms"))
    assert rows(pairs, "media_id", "t_ms", "id") == want
    best = ranges.best_holder(spans, points, ["media_id"], F.col("start_ms"), F.col("end_ms"), "t_ms", F.col("id"))
    least = {(m, t): i for m, t, i in reversed(want)}
    assert rows(best, "media_id", "t_ms", "best") == sorted((m, t, i) for (m, t), i in least.items())
    assert any("SortMergeJoin" in line and "__level" in line for line in pairs._jdf.queryExecution().executedPlan().toString().splitlines())


def test_words_without_a_normal_form_are_normalised_by_spelling(spark):
    lexicon = spark.createDataFrame([("that", "extra", "exact"), ("fu", "strong", "prefix")], "word string, tier string, match_kind string")
    words = ["That,", "that", "'that'", "FUn!", "f.u", "tha", "", "123", None, "That,"]
    tokens = spark.createDataFrame(list(enumerate(words)), "token_idx long, word string")
    assert rows(dialogue.lexicon_join(tokens, lexicon), "token_idx", "word", "tier") == [
        (0, "That,", "extra"), (1, "that", "extra"), (2, "'that'", "extra"), (3, "FUn!", "strong"), (4, "f.u", "strong"), (9, "That,", "extra")]
