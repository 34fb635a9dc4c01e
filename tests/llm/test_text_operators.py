"""Tokens, packing, lines, SimHash and rules against plain Python, on texts with every awkward case."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")
import public_tokenizers
import xxhash
from tokenizers import Tokenizer

from spanweave.llm import bpe, line_dedup, ngram_quality, packing, simhash

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
SHARED = "This Subtitle line is shared by a good many films, says nobody at all."
LONG = " ".join(f"word{i % 977} and" for i in range(60_000))


def texts():
    rng = random.Random(5)
    words = "the of and thereon Haus müde garçon über ñandú 12 x, y. <|endoftext|> it's".split()
    some = [" ".join(rng.choices(words, k=rng.randint(1, 60))) for _ in range(40)]
    lines = ["\n".join(rng.sample([SHARED, SHARED.lower(), f"  {SHARED}\t", "short", "", "A Ñ" + SHARED, "a ñ" + SHARED, f"only here {i}"], 5)) for i in range(12)]
    odd = [None, "", " ", "\n", "  a\n\n b  ", "\x1c\x85x", "<|endoftext|><|endoftext|>", "a" * 3000, "漢字🙂 é́", "x\ry\fz", LONG, "一 二"]
    return some + lines + odd + [some[0], some[0], some[0] + " x"]


@pytest.fixture(scope="module")
def scripts(spark):
    rows = [(i, t, "en" if i % 3 else None, "clash", 1) for i, t in enumerate(texts())]
    rows += [rows[3], (None, "no id here " + SHARED, "de", "clash", 1), (7, "another text of an id " + SHARED, "en", "clash", 1)]
    return spark.createDataFrame(rows, "media_id bigint, text string, lang string, token_ids string, closed int").repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "media_id bigint, text string, lang string")


def pairs(df):
    return [(r.media_id, r.text or "") for r in df.select("media_id", "text").collect()]


def order(x):
    return (x[0] is None, x[0] or 0, *map(str, x[1:]))


def test_bpe_is_the_library_and_round_trips(scripts, empty):
    library = Tokenizer.from_file(TOKENIZER)
    got = bpe.decode_scripts(bpe.encode_scripts(scripts, TOKENIZER), TOKENIZER).collect()
    want = [(m, library.encode(t, add_special_tokens=False).ids, t) for m, t in pairs(scripts)]
    assert sorted(((r.media_id, list(r.token_ids), r.text) for r in got), key=order) == sorted(want, key=order)
    assert bpe.encode_scripts(empty, TOKENIZER).count() == 0


def test_bpe_on_random_strings():
    library, encode = Tokenizer.from_file(TOKENIZER), bpe.text_encoder(open(TOKENIZER).read())
    rng = random.Random(3)
    parts = list("ab 'sTHE  \n\t\r\x1c\x85​　éß漢🙂019,.!<|>") + ["<|endoftext|>", "   ", "'re", " \n", "\xa0", "ing", " there"]
    some = ["".join(rng.choices(parts, k=rng.randint(0, 40))) for _ in range(4000)]
    assert [np.frombuffer(x, "<i4").tolist() for x in encode(some)] == [e.ids for e in library.encode_batch(some, add_special_tokens=False)]


def test_decoding_broken_ids(spark):
    library = Tokenizer.from_file(TOKENIZER)
    ids = [[10, 250, 200], [], [50256], [187, 30000]]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(ids)] + [(9, None), (10, [99_999_999, None])], "media_id bigint, token_ids array<int>")
    got = {r.media_id: r.text for r in bpe.decode_scripts(df, TOKENIZER).collect()}
    assert [got[i] for i in range(4)] == [library.decode(x, skip_special_tokens=False) for x in ids]
    assert got[9] == "" and got[10] == ""


@pytest.mark.parametrize("window,limit", [(1024, 64), (16, 3)])
def test_packing_lays_each_id_once_without_gaps(scripts, window, limit):
    library = Tokenizer.from_file(TOKENIZER)
    rows = packing.pack_scripts(scripts, TOKENIZER, window, limit).collect()
    windows = defaultdict(list)
    for r in rows:
        windows[r.window_id].append((r.window_offset, r.length))
        assert r.length == len(r.token_ids) > 0
    for spans in windows.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= window
    made = defaultdict(Counter)
    for r in rows:
        for i, x in enumerate(r.token_ids):
            made[r.media_id, r.media_tokens][r.piece_start + i, x] += 1
    want = defaultdict(Counter)
    for m, t in pairs(scripts):
        ids = library.encode(t, add_special_tokens=False).ids + [0]
        for i, x in enumerate(ids):
            want[m, len(ids)][i, x] += 1
    assert made == want
    total, used = len(windows) * window, sum(r.length for r in rows)
    assert used > 0.9 * total


def test_packing_nothing(empty):
    assert packing.pack_scripts(empty, TOKENIZER).count() == 0


def key(line):
    bare = line.strip(" \t\n\x0b\x0c\r")
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in bare)


def test_line_dedup_against_brute_force(scripts, empty):
    rows = pairs(scripts)
    holders = defaultdict(set)
    for m, t in rows:
        for line in t.split("\n"):
            if len(key(line)) >= 40:
                holders[key(line)].add(-1 if m is None else m)
    common = {k: max(h) for k, h in holders.items() if len(h) >= 5}
    assert common

    def kept(m, t):
        lines = t.split("\n")
        stay = [x for x in lines if key(x) not in common or common[key(x)] == (-1 if m is None else m)]
        return m, len(lines), len(lines) - len(stay), "\n".join(stay)

    got = line_dedup.drop_lines(scripts, line_dedup.line_keep_bitmaps(scripts), "closed").collect()
    assert sorted(((r.media_id, r.n_lines, r.n_dropped, r.text) for r in got), key=order) == sorted((kept(*x) for x in rows), key=order)
    assert line_dedup.line_keep_bitmaps(empty).count() == 0


def test_long_bitmaps(spark):
    shared = [f"line number {i:04d} of the credits that everybody repeats" for i in range(300)]
    rows = [(m, "\n".join(x for i, x in enumerate(shared) if (i + m) % 7)) for m in range(8)]
    df = spark.createDataFrame(rows, "media_id bigint, text string")
    seen, want = set(), {}
    for m, t in reversed(rows):  # the largest id keeps a line that five or more have
        lines = t.split("\n")
        want[m] = "\n".join(x for x in lines if x not in seen)
        seen.update(lines)
    assert {r.media_id: r.text for r in line_dedup.drop_lines(df, line_dedup.line_keep_bitmaps(df)).collect()} == want


def brute_print(text, k=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + k]) for i in range(len(words) - k + 1)] if len(words) >= k else [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    """Smallest member of each print's component under two differing bits."""
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    some = sorted(prints)
    for i, a in enumerate(some):
        for b in some[:i]:
            if (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    return {p: find(p) for p in prints}


def test_simhash_against_brute_force(scripts, empty):
    rows = [(m, t) for m, t in pairs(scripts) if len(t) < 10_000]
    prints = {t: brute_print(t) for _, t in rows}
    of = brute_components(set(prints.values()))
    least = {}
    for m, t in rows:
        if m is not None:
            c = of[prints[t]]
            least[c] = min(m, least.get(c, m))
    want = [(m, prints[t], least.get(of[prints[t]])) for m, t in rows]
    got = simhash.near_duplicates(scripts.where("text is null or length(text) < 10000")).collect()
    assert sorted(((r.media_id, r.fingerprint % 2 ** 64, r.component_id) for r in got), key=order) == sorted(want, key=order)
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("crowd", [simhash.CROWD, 20])
def test_links_connect_all_close_prints(spark, monkeypatch, crowd):
    monkeypatch.setattr(simhash, "CROWD", crowd)
    if crowd == 20:
        monkeypatch.setattr(simhash, "_CHUNK", 16)
    rng = random.Random(11)
    prints = set()
    for _ in range(12):
        centre = rng.getrandbits(64)
        bits = rng.sample(range(64), 9)
        for _ in range(60):
            prints.add(centre ^ sum(1 << b for b in bits if rng.random() < 0.3))
    prints |= {rng.getrandbits(64) for _ in range(300)}
    df = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fingerprint bigint")
    edges = [(r.a % 2 ** 64, r.b % 2 ** 64) for r in simhash.links(df).collect()]
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        root[find(a)] = find(b)
    groups, want = defaultdict(set), defaultdict(set)
    for p in prints:
        groups[find(p)].add(p)
    for p, c in brute_components(prints).items():
        want[c].add(p)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))
    assert len(edges) < 12 * len(prints)


def test_anchors_cover():
    rng = np.random.default_rng(2)
    half = rng.integers(0, 1 << 32, 3000, dtype=np.uint64)
    table = simhash.anchors(half)
    assert np.bitwise_count(table ^ half[:, None]).max() <= 2
    assert np.bitwise_count(table[:, 0] ^ half).max() <= 1
    flipped = half ^ (np.uint64(1) << rng.integers(0, 32, 3000).astype(np.uint64))
    assert (simhash.anchors(flipped) == table[:, :1]).any(axis=1).all()


def brute_rules(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    seen, inside = Counter(windows), set()
    for i, w in enumerate(windows):
        if seen[w] > 1:
            inside.update(range(i, i + 5))
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside)


def brute_model(rows):
    """Interpolated modified Kneser-Ney over bytes, from the definition; rows of one language."""
    n = ngram_quality.ORDER
    counts = {n: Counter()}
    for t in rows:
        data = bytes(n - 1) + t.encode()
        counts[n].update(data[i:i + n] for i in range(len(data) - n + 1))
    for k in range(n - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    cut, followers = {}, {}
    for k, c in counts.items():
        t = Counter(c.values())
        y = t[1] / (t[1] + 2 * t[2]) if t[1] and t[2] else 0
        d = [1 - 2 * y * t[2] / t[1] if t[1] and t[2] else 0.75, 2 - 3 * y * t[3] / t[2] if t[1] and t[2] and t[3] else 0.75,
             3 - 4 * y * t[4] / t[3] if t[1] and t[2] and t[3] and t[4] else 0.75]
        cut[k] = [min(max(x, 0.1), m) for x, m in zip(d, (0.95, 1.9, 2.85))]
        followers[k] = defaultdict(list)
        for g, m in c.items():
            followers[k][g[:-1]].append(m)

    def p(g):
        k = len(g)
        if k == 0:
            return 1 / 257
        f = followers[k].get(g[:-1])
        if not f:
            return p(g[1:])
        d, total, m = cut[k], sum(f), counts[k].get(g, 0)
        gamma = min(sum(d[min(x, 3) - 1] for x in f) / total, 1)
        return (max(m - d[min(m, 3) - 1], 0) if m else 0) / total + gamma * p(g[1:])

    def score(t):
        data = bytes(n - 1) + t.encode()
        return -sum(math.log(p(data[i:i + n])) for i in range(len(data) - n + 1)) / len(t.encode()) if t else None
    return score


def test_rules_and_perplexity_against_brute_force(scripts, empty):
    small = scripts.where("text is null or length(text) < 10000")
    given = [(r.media_id, r.text or "", r.lang) for r in small.collect()]
    models = {lang: brute_model([t for _, t, x in given if x == lang]) for lang in {x for *_, x in given}}
    got = {(r.media_id, r.lang, r.n_words, r.n_symbols, r.log_ppl and round(r.log_ppl, 3)): r for r in ngram_quality.judge_scripts(small).collect()}
    for m, t, lang in given:
        want = models[lang](t)
        words, chars, symbols, dup, repeated = brute_rules(t)
        r = got[m, lang, words, symbols, want and round(want, 3)]
        assert (r.word_chars, r.n_dup_lines, r.n_repeat_words) == (chars, dup, repeated)
        assert r.base_failed == (words < 10 or 100 * repeated > 20 * words)
        assert not (r.kept and r.base_failed)
    assert any(r.kept for r in got.values())
    assert ngram_quality.judge_scripts(empty).count() == 0


def test_a_small_language_keeps_its_grams_beside_a_large_one(spark, monkeypatch):
    monkeypatch.setattr(ngram_quality, "BLOCK", 1000)
    rng = random.Random(2)
    few = [" ".join(rng.choices("agua río casa película escena habla otra vez niño".split(), k=30)) for _ in range(12)]
    rows = [(i, t, "es") for i, t in enumerate(few)] + [(100 + i, "the river runs by the house " * 4000, "en") for i in range(12)]
    got = {r.media_id: r.log_ppl for r in ngram_quality.judge_scripts(spark.createDataFrame(rows, "media_id int, text string, lang string").repartition(3)).collect()}
    model = brute_model(few)
    assert [round(got[i], 6) for i in range(12)] == [round(model(t), 6) for t in few]


def test_perplexity_band_rejects_what_is_unlike_its_language(spark):
    rng = random.Random(1)
    words = "the of and there on house water river film scene talks again".split()
    rows = [(i, " ".join(rng.choices(words, k=80)), "en") for i in range(200)]
    rows += [(900, "".join(chr(rng.randint(0x4E00, 0x9000)) + " " for _ in range(300)), "en"), (901, "the the " * 3 + " ".join(rng.choices(words, k=60)), "en")]
    got = {r.media_id: r for r in ngram_quality.judge_scripts(spark.createDataFrame(rows, "media_id int, text string, lang string")).collect()}
    assert not got[900].base_failed and not got[900].kept and got[901].kept
    assert sum(got[i].kept for i in range(200)) == 200


def test_band_rejects_junk_that_passes_the_base_rules(spark):
    rng = random.Random(4)
    words = "the of and there on house water river film scene talks again".split()
    rows = [(i, " ".join(rng.choices(words, k=rng.choice([40, 80, 300]))), "en") for i in range(200)]
    rows += [(300 + i, " ".join(w + rng.choice(["", "", "", "***", "$$"]) for w in rng.choices(words, k=80)), "en") for i in range(10)]
    rows += [(400 + i, "spam spam " * 200, "en") for i in range(300)]
    df = spark.createDataFrame(rows, "media_id int, text string, lang string")
    got = {r.media_id: r for r in ngram_quality.judge_scripts(df, passing_only=True).collect()}
    assert not any(got[300 + i].base_failed or got[300 + i].kept for i in range(10)) and got[400].base_failed and got[400].log_ppl is None
    assert sum(got[i].kept for i in range(200)) >= 190


def test_long_text_rules():
    assert ngram_quality.rule_counts(LONG) == brute_rules(LONG)
