"""Expected values for the column functions."""

import hashlib
import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from spanweave.functions import schedule as sc
from spanweave.functions import text as tx
from spanweave.functions import timefmt as tf
from spanweave.functions.lexicon import Lexicon
from spanweave.functions.policy import OBSERVATIONS, Policy
from spanweave.operators import visual
from workload import views


def apply(spark, values, fn, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.out for r in df.select("i", fn(F.col("v")).alias("out")).orderBy("i").collect()]


def test_times(spark):
    assert apply(spark, ["00:01:02,345", " 1:0:0.5 ", "1:2", "a:b:c,d"], tf.ts_to_ms) == [62345, 3600005, None, None]
    assert apply(spark, [3723004, -5], tf.ms_to_ts, "long") == ["01:02:03,004", "00:00:00,000"]
    assert apply(spark, ["1:02:03.5", "2:03", "7.25", "", "x", "-4", "12abc"], tf.parse_time) == [3723500, 123000, 7250, None, None, 0, 12000]
    assert apply(spark, [4.2, 0.25, 0.35, 59.96, 192.0, 3840.0], tf.fmt_duration, "double") == [
        f"{4.2:.1f}s", f"{0.25:.1f}s", f"{0.35:.1f}s", f"{59.96:.1f}s", "3m12s", "1h04m"]
    spans = apply(spark, ["1-2,x,3-4,5", "", None, "7--8"], tf.parse_spans)
    assert [[tuple(s) for s in one] for one in spans] == [[(1, 2), (3, 4)], [], [], [(7, -8)]]
    near = [i / 1000 for i in range(0, 60000, 7)]
    assert apply(spark, near, tf.fixed_two, "double") == [f"{x:.2f}" for x in near]


def test_text(spark):
    assert apply(spark, ["<i>Hi</i> (SIGHS) there", "TONY: go {x}", "[MUSIC]"], tx.clean_cue_text) == ["Hi there", "go", ""]
    assert apply(spark, ["F**king!", "'Tis", "Éass", "Don't"], tx.normalize_word) == ["fking", "tis", "ass", "don't"]
    assert apply(spark, ["Godâ€™s", "fine", "cafÃ©", "Ã alone ☃"], tx.repair_mojibake) == ["God’s", "fine", "café", "Ã alone ☃"]
    assert apply(spark, ["|'m here", "s0me", "“x” ‘y’", "a\nb -—", "100 l like"], tx.ocr_cleanup) == [
        "I'm here", "some", "\"x\" 'y'", "a b", "100 I like"]
    pairs = [("god's", "god", True), ("asses", "ass", True), ("damn", "damnit", True), ("horse", "whore", False), ("go", "god", False)]
    df = spark.createDataFrame(pairs, "h string, t string, want boolean")
    assert df.where(tx.word_matches(F.col("h"), F.col("t")) != F.col("want")).count() == 0
    assert df.where(F.col("want") & (tx.match_key(F.col("h")) != tx.match_key(F.col("t")))).count() == 0


def test_token_offsets_of_a_long_line(spark):
    words = [("w" * (i % 7 + 1)) for i in range(3001)]
    line = " ".join(words)
    got = apply(spark, [line], lambda c: tx.token_offsets(F.split(c, " ")))[0]
    at = 0
    for word, pair in zip(words, got):
        assert (pair["token"], pair["offset"]) == (word, at)
        at += len(word) + 1


def test_fingerprint(spark):
    data = bytes(range(256)) * 5
    size, chunk = len(data), 100
    want = hashlib.sha256(str(size).encode())
    for at in (0, max(0, size // 2 - chunk // 2), max(0, size - chunk)):
        want.update(data[at:at + chunk])
    df = spark.createDataFrame([(bytearray(data),)], "v binary")
    assert df.select(tx.quick_fingerprint(F.col("v"), chunk)).first()[0] == "quickhash:" + want.hexdigest()


def test_lexicon(spark):
    lex = Lexicon.of()
    assert apply(spark, ["bullshitting", "ship", "class", "hello", "assistant", "stupid", "god", ""], lex.tier) == [
        "strong"] + [None] * 7
    wide = Lexicon.of(True, True, ["Heck"])
    assert apply(spark, ["stupid", "god", "heck"], wide.tier) == ["mild", "blasphemy", "extra"]


@pytest.mark.parametrize("seen, policy, want", [
    (["sex_act", "female_topless"], Policy(), "sexual_activity"), (["buttocks_or_genitals"], Policy(), "nudity"),
    (["male_shirtless"], Policy(), None), (["male_shirtless"], Policy(flag_male_shirtless=True), "suggestive"),
    (["male_shirtless", "sexualised_framing"], Policy(), "suggestive"), (["kissing"], Policy(), None),
    (["male_shirtless", "kissing"], Policy(flag_any_kissing=True), None), (["kissing"], Policy(flag_any_kissing=True), "intense_kissing"),
    (["underwear_only"], Policy(), "suggestive"), (["underwear_only"], Policy(flag_underwear=False), None)])
def test_policy(spark, seen, policy, want):
    df = spark.range(1).select(*[F.lit(name in seen).alias(name) for name in OBSERVATIONS])
    assert df.select(policy.classify()).first()[0] == want


def test_schedule(spark):
    week = [sc.DayWindow(True, 1380, 420), sc.DayWindow(True, 120, 420), sc.DayWindow(), sc.DayWindow(True, 120, 420), sc.DayWindow(True, 120, 420),
            sc.DayWindow(True, 5, 5), sc.DayWindow()]
    plan = sc.Schedule.of(True, week)
    # 2024-01-01 was a Monday.
    cases = {"2024-01-01 22:59": False, "2024-01-01 23:00": True, "2024-01-02 01:00": True, "2024-01-02 07:00": False, "2024-01-03 03:00": False,
             "2024-01-06 13:00": True, "2024-01-07 13:00": False}
    out = apply(spark, list(cases), lambda c: sc.schedule_allowed(F.to_timestamp(c), plan))
    assert out == list(cases.values())
    denver = sc.Schedule.of(True, week, "America/Denver")
    assert apply(spark, ["2024-01-02 06:00"], lambda c: sc.schedule_allowed(F.to_timestamp(c), denver)) == [True]  # Monday 23:00
    assert apply(spark, ["2024-01-03 03:00"], lambda c: sc.schedule_allowed(F.to_timestamp(c), sc.Schedule.of(False, []))) == [True]
    assert sc.Schedule.of(True, [sc.DayWindow(True, -5, 9999)], "No/Zone") == sc.Schedule.of(True, [sc.DayWindow(True, 0, 1439)])


def test_sampling(spark):
    df = spark.createDataFrame([(0.0, 2.0), (0.0, 25.0), (3.0, 3.0)], "a double, b double")
    got = [r[0] for r in df.select(visual.sample_times(F.col("a"), F.col("b"))).collect()]
    assert got[0] == [1.0] and len(got[1]) == 11 and got[2] == [3.0]
    frames = spark.createDataFrame([(0, 101), (5, 8)], "a long, b long").select(visual.keyframe_indices(F.col("a"), F.col("b"), 3))
    assert [r[0] for r in frames.collect()] == [[0, 50, 100], [5, 6, 7]]
    assert rows(spark.range(2)) == [(0,), (1,)]


def test_words_of_a_line(spark):
    """Normalising a line gives what normalising its words gives."""
    rng = random.Random(2)
    lines = [" ".join("".join(rng.choice("aB'’0-éİKΣ") for _ in range(rng.randrange(1, 6))) for _ in range(rng.randrange(1, 9))) for _ in range(400)]
    lines += ["'", "''' a '' 'b' c'd", "'" * 200_000 + "x" + "'" * 200_000 + "y z'", "a" + "'" * 300_000 + "b", "", "a  b "]
    df = spark.createDataFrame([(line,) for line in lines], "line string")
    one = F.transform(F.split("line", " "), lambda w: tx.normalize_word(w))
    assert df.select((tx.normalize_words(F.col("line")) == one).alias("same")).where("NOT same").count() == 0


def test_single_spacing_is_one_pass(spark, tmp_path):
    """Any white space collapses as by the pattern, and the text of a cue is made once, not again to see whether it is blank."""
    odd = [chr(c) for c in range(0x3001) if chr(c).isspace()]
    texts = [f"{a}x{a}{b} y z{b}" for a in odd for b in (" ", a)] + ["", " ", "\u3000\t", "plain text", "é  é", "é é"]
    assert apply(spark, texts, tx.collapse_space) == [" ".join(t.split()) for t in texts]
    assert apply(spark, texts, tx.not_blank) == [bool(t.split()) for t in texts]
    spark.createDataFrame([(1, "a b\n\n c\t")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    cues = views.cues(spark, str(tmp_path))
    assert [(r.cue_idx, r.text) for r in cues.orderBy("cue_idx").collect()] == [(0, "a b"), (2, "c")]
    assert cues._jdf.queryExecution().executedPlan().toString().count("regexp_replace") == 1


def test_offsets_at_the_edges_of_chunks(spark):
    lines = [" ".join("w" * (i % 5) for i in range(n)) for n in (1, 31, 32, 33, 64, 65, 200)]
    got = apply(spark, lines, lambda c: tx.offsets_of(F.split(c, " ")))
    assert got == [[sum(len(t) + 1 for t in line.split(" ")[:i]) for i in range(line.count(" ") + 1)] for line in lines]
    assert apply(spark, ["god's", "gods", "'s", None], tx.strip_possessive, "string") == ["god", "gods", "", None]


def test_tokens_of_odd_lines_in_one_pass_over_arrays(spark):
    from spanweave.operators.dialogue import tokenize_offsets

    lines = ["'Tis o'clock' ''x'' '", "Kİng Été \U0001f600s  a", " a  b ", "x" * 70_000 + " " + "y z " * 70_000 + "end", "Kelvin"]
    cues = spark.createDataFrame([(1, i, 10 * i, s) for i, s in enumerate([*lines, "", None])], "media_id bigint, cue_idx bigint, start_ms bigint, text string")
    got = tokenize_offsets(cues, "start_ms", columns=("token", "norm", "char_offset", "word_len"))
    rows = got.withColumn("same", F.col("norm") == tx.normalize_word(F.col("token"))).collect()
    want = []
    for i, line in enumerate(lines):
        at = 0
        for j, token in enumerate(line.split(" ")):
            want.append((i, j, 10 * i, token, at, len(token)))
            at += len(token) + 1
    assert sorted((r.cue_idx, r.token_idx, r.start_ms, r.token, r.char_offset, r.word_len) for r in rows) == want
    assert all(r.same for r in rows)
    assert tokenize_offsets(cues, columns=("norm",)).columns == ["media_id", "cue_idx", "token_idx", "norm"]


def test_only_listed_tokens_leave_the_batch(spark):
    from spanweave.operators.dialogue import flagged_words, tokenize_offsets

    lines = ["Oh 'shit', Bullshitter! god's GOD", "nothing here", "damn", "\u212aelvin hell's fuckwit Hate"]
    cues = spark.createDataFrame([(1, i, 10 * i, 10 * i + 5, s) for i, s in enumerate([*lines, "", None])],
                                 "media_id bigint, cue_idx bigint, start_ms bigint, end_ms bigint, text string")
    for lexicon in (Lexicon.of(), Lexicon.of(True, True, ["oh", ""])):
        every = tokenize_offsets(cues, "text", columns=("norm", "char_offset", "word_len", "n_words"))
        want = rows(every.where(lexicon.flags(F.col("norm"))), "cue_idx", "token_idx", "norm", "char_offset", "word_len", "n_words", "text")
        found = flagged_words(cues, lexicon)
        assert rows(found, "cue_idx", "token_idx", "key", "char_offset", "word_len", "n_words", "text") == want and len(want) >= 4
        assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()


def test_white_space_around_misreadings(spark):
    odd = ["\u3000l a\u00a0 \u2003b\t\tc ", " x\x1cy\x85", "| 'l' al l|| 0a0b0c0 ", "\u2028 \n", " a  b   c "]
    assert apply(spark, odd, tx.ocr_cleanup) == ["I a b c", "x y", "I 'I' al l|I 0aoboc0", "", "a b c"]
    # A single plain space is no run, so a line of words has nothing to replace.
    assert apply(spark, ["a b c d"], lambda c: F.size(F.regexp_extract_all(c, F.lit(tx._RUN), F.lit(0))), "string") == [0]
