"""Collocations against plain Python: spills and bursts at every turn, slices, nulls, repeated rows, ties."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from spanweave.llm import collocations
from spanweave.llm.collocations import HatTrie, PhraseCounter

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def texts():
    rng = random.Random(3)
    words = ["No", "no", "way", "of", "the", "Rings", "Éa", "éa", "12", "it's", "x\x00y", "\x1cz"]
    lines = [" ".join(rng.choices(words, k=rng.randint(1, 12))) + rng.choice([".", ",", "\n", "\r", "\x0b", "", " "]) for _ in range(400)]
    rows = [("".join(lines[i:i + 8]), rng.choice(["en", "de", None])) for i in range(0, 400, 8)]
    rows += [(None, "en"), ("", None), ("  \t ", "de"), (".,;:!?", "en"), ("lord of the rings " * 40, "en"), ("and", "fr"), ("lord\tof  the rings, " * 4, None)]
    return rows + rows[:3]


def brute(rows, least, top):
    counts, totals = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            words = re.findall(r"[^ \t]+", piece)
            totals[lang] += len(words)
            for i in range(len(words)):
                for k in range(1, min(5, len(words) - i) + 1):
                    counts[lang][tuple(words[i:i + k])] += 1
    out = []
    for lang, found in counts.items():
        cands = {p: a for p, a in found.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in cands.items():
            if any(b >= a for q, b in cands.items() if len(q) > len(p) and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1))):
                continue
            score, k = min((1000 * a * totals[lang] // (found[p[:k]] * found[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), found[p[:k]], found[p[k:]]))
        out += [(lang, i, r[2].decode(), -r[1], r[3], r[4], totals[lang], -r[0]) for i, r in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize("top, held, burst", [(2000, 300_000, 4096), (7, 30, 3)])
def test_collocations_by_brute_force(spark, monkeypatch, top, held, burst):
    if held < 100:
        for name, value in (("_ROWS", 7), ("_STRIPS", 5), ("KNOWN", 4)):
            monkeypatch.setattr(collocations, name, value)
    rows = texts()
    df = spark.createDataFrame([(i % 9, t, lang, "clash", 1, 2) for i, (t, lang) in enumerate(rows)],
                               "media_id bigint, text string, lang string, phrase string, n int, prefix int").repartition(3)
    found = collocations.mine_collocations(df, min_count=3, top=top, held=held, burst=burst)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, found.collect())) == brute(rows, 3, top)


def test_no_texts_no_collocations(spark):
    empty = spark.createDataFrame([], "media_id bigint, text string, lang string")
    assert collocations.mine_collocations(empty, min_count=1).count() == 0


def counted(counter, texts):
    total = Counter()
    for run in counter.feed("en", texts):
        assert run == sorted(run)
        for _, phrase, n in run:
            total[phrase] += n
    for _, phrase, n in counter.run():
        total[phrase] += n
    return total


def test_long_text_in_slices_loses_no_phrase(monkeypatch):
    rng = random.Random(1)
    words = [rng.choice([b"a", b"bb", b"ccc", b"d."]) for _ in range(3000)] + [b"w" * 500, b"a", b"bb"]
    text = b" ".join(words)
    for lengths in ((1,), (2,), (4, 5)):
        whole = counted(PhraseCounter(lengths, {}), [text])
        monkeypatch.setattr(collocations, "_SLICE", 64)
        monkeypatch.setattr(collocations, "KNOWN", 1)
        assert counted(PhraseCounter(lengths, {}, held=10, burst=2), [text]) == whole
        monkeypatch.undo()
    assert sum(counted(PhraseCounter((1,), {}), [text]).values()) == len(words)


def test_equal_digests_do_not_mix_counts(monkeypatch):
    text = b"a b c a b. b c a, c a"
    want = counted(PhraseCounter((1, 2, 3), {}), [text])
    monkeypatch.setattr(collocations, "_longer", lambda before, word: before * np.uint64(0))
    assert counted(PhraseCounter((1, 2, 3), {}), [text]) == want


def test_trie_bursts_and_spills_whole_subtrees():
    rng, trie, want = random.Random(2), HatTrie(burst=2), Counter()
    for _ in range(3000):
        phrase = tuple(rng.randrange(6) for _ in range(rng.randint(1, 5)))
        trie.add(phrase, 2)
        want[phrase] += 2
    assert trie.size == len(want)
    spilled = dict(trie.spill(len(want) // 2))
    left = dict(trie.spill(0))
    assert {p[0] for p in spilled}.isdisjoint(p[0] for p in left) and len(left) <= len(want) // 2
    assert {**spilled, **left} == want and trie.size == 0
