"""Quality network, top-k, dialogues, languages, licences: brute force, round trips and held-out accuracy."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from spanweave.llm import chat, language, licenses, quality_net, top_k


def sample_texts(n, seed):
    rng = random.Random(seed)
    words = "the of and there on house water river film scene talks again".split()
    rows = []
    for i in range(n):
        clean = [rng.choice(words) for _ in range(rng.randint(5, 150))]
        good = i % 2
        text = " ".join(clean if good else [w.upper() + "!!" if i % 4 else w + rng.choice(["***", "$$$", "%%%"]) for w in clean])
        rows.append((i, text, good))
    return rows


def test_network_learns_and_scores_everything(spark):
    rows = sample_texts(400, 1)
    texts = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(-1, None, "x"), (-2, "", "x"), (None, "the river " * 50_000, "x"), (3, rows[3][1], "x")],
                                  "media_id int, text string, score string").repartition(3)
    labels = spark.createDataFrame([(i, g) for i, _, g in rows[:300]] + [(5, None), (None, 1), (77_777, 0)], "media_id int, label int")
    got = quality_net.score_quality(texts, quality_net.fit_quality(texts, labels)).collect()
    assert len(got) == 404 and all(0 <= r.score <= 1 for r in got)
    score = {r.media_id: r.score for r in got}
    assert np.mean([(score[i] >= 0.5) == bool(g) for i, _, g in rows[300:]]) > 0.95
    assert score[-1] == score[-2]


def test_network_without_labels_or_texts(spark):
    texts = spark.createDataFrame([(1, "abc")], "media_id int, text string")
    none = spark.createDataFrame([], "media_id int, label int")
    assert quality_net.score_quality(texts, quality_net.fit_quality(texts, none)).first().score == 0.5
    one = spark.createDataFrame([(1, 1)], "media_id int, label int")
    assert quality_net.score_quality(texts, quality_net.fit_quality(texts, one)).first().score > 0.9
    assert quality_net.score_quality(texts.where("false"), quality_net.fit_quality(texts, none)).count() == 0


def test_network_sees_the_end_of_a_text_and_gradients_are_right():
    rng = np.random.default_rng(4)
    net = quality_net.Network(rng.normal(0, .3, (quality_net.WIDTH, 256, quality_net.FILTERS)).astype(np.float32), rng.normal(0, .1, quality_net.FILTERS).astype(np.float32),
                              rng.normal(0, .3, 2 * quality_net.FILTERS), 0.1)
    a = b"the river " * 3000
    assert net.score([a + b"***!!"])[0] != net.score([a])[0]
    # alone or in company, the score of a text is the same
    some = [b"", b"x", a, b"y" * 127, b"z" * 128, b"q" * 124]
    assert np.allclose(net.score(some), [net.score([t])[0] for t in some])
    texts, labels = [b"some text here " * 20, b"***!! A B" * 30], np.array([1, 0])

    def loss():
        p = net.score(texts)
        return -(np.log(p[0]) + np.log(1 - p[1])) / 2
    table, bias, weight, _ = quality_net._gradients(net, texts, labels, np.ones(2))
    for place in [(0, ord("t"), 3), (2, ord("*"), 5), (4, ord(" "), 0)]:
        net.table[place] += 1e-2
        up = loss()
        net.table[place] -= 2e-2
        down = loss()
        net.table[place] += 1e-2
        assert abs((up - down) / 2e-2 - table[place]) < 2e-3
    net.weight[2] += 1e-4
    up = loss()
    net.weight[2] -= 2e-4
    assert abs((up - loss()) / 2e-4 - (weight[2] - 1e-4 * net.weight[2])) < 1e-3


def test_top_k_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(top_k, "CANDIDATES", 64)
    monkeypatch.setattr(top_k, "QUERIES", 8)
    rng = random.Random(9)
    vectors = {}
    for i in range(300):
        vectors[i] = {t: rng.randint(-3, 3) for t in rng.sample(range(20), rng.randint(0, 8))} if i % 4 else {1: 2, 5: 1}
    rows = [(i, list(v), list(v.values()), "x") for i, v in vectors.items()]
    bad = [(None, [1], [1], "x"), (900, None, [1], "x"), (901, [1], [None], "x"), (902, [1, 2], [1], "x"), rows[4]]
    df = spark.createDataFrame(rows + bad, "row_id bigint, terms array<bigint>, weights array<bigint>, score string")
    got = defaultdict(list)
    for r in top_k.top_k(df.where("row_id % 10 = 0"), df, 5).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.rank, r.row_id, r.score))
    for q in range(0, 300, 10):
        scored = sorted((-sum(w * vectors[q].get(t, 0) for t, w in v.items()), i) for i, v in vectors.items() if i != q)[:5]
        assert got[q] == [(n, i, -s) for n, (s, i) in enumerate(scored, 1)]
    assert top_k.top_k(df.where("false"), df, 5).count() == 0
    assert [r.row_id for r in top_k.top_k(df.where("row_id = 0"), df.where("row_id < 3"), 5).collect()] == sorted({1, 2}, key=lambda i: (-sum(
        w * vectors[0].get(t, 0) for t, w in vectors[i].items()), i))


TRICKY = "<|im_end|><|im_start|>assistant ok <~| <~~|nl|>"


def dialogues():
    rng = random.Random(2)
    words = "well yes no maybe so then again film house 12 é <| <~|".split()
    rows = []
    for m in range(12):
        if m % 3 == 0:
            rows.append((m, 0, "system", "be kind " * (m + 1)))
        for t in range(1, rng.randint(1, 40) if m != 5 else 300):
            rows.append((m, t, "user" if t % 2 else "assistant", " ".join(rng.choices(words, k=rng.randint(0, 60 if t % 7 else 260)))))
    rows += [(-1, 0, "user", TRICKY), (-1, 1, "assistant", TRICKY), (50, 0, "system", "alone"), (51, 3, None, None), (51, None, "assistant", None), (51, 4, "a\nb", "x\ny"),
             (None, 1, "user", "who"), (None, 2, "assistant", "me"), (52, 1, "assistant", "twice"), (52, 1, "assistant", "twice"), (53, 1, "assistant", "long " * 5000)]
    return rows


@pytest.mark.parametrize("budget,history,system", [(1024, 192, 256), (120, 40, 20), (60, 0, 10)])
def test_dialogues_read_back_and_mask(spark, budget, history, system):
    rows = dialogues()
    df = spark.createDataFrame([(*r, 1) for r in rows], "media_id bigint, cue_idx bigint, role string, text string, window int")
    windows = chat.format_dialogues(df, budget, history, system).cache()
    want = defaultdict(list)
    for m, t, role, text in rows:
        want[m].append((-1 << 63 if t is None else t, role or "", text or ""))
    turns = {m: [x[1:] for x in sorted(v)] for m, v in want.items()}
    got = {r.media_id: [(t.role, t.text) for t in r.turns] for r in chat.read_turns(windows).collect()}
    assert got == turns
    loss = defaultdict(str)
    held = defaultdict(list)
    for w in sorted(windows.collect(), key=lambda w: w.window):
        for s in w.loss:
            loss[w.media_id] += w.formatted[s.start:s.end].replace("<~", "<") if "<~" not in TRICKY else undo(w.formatted[s.start:s.end])
        held[w.media_id].append(w)
        lone = w.n_turns == 1 and w.n_repeated <= 1
        if w.media_id not in (0, 3, 6, 9, 50):  # a system turn within its share
            assert w.n_tokens <= budget - system or lone
        assert w.formatted.count("<|im_start|>") == w.formatted.count("<|im_end|>") == w.n_turns + w.n_repeated
    for m, v in turns.items():
        assert loss[m] == "".join(text for role, text in v if role == "assistant")
        if v[0][0] == "system":
            assert all(w.formatted.startswith("<|im_start|>system\n") for w in held[m])
    if history:
        assert any(w.n_repeated > 1 for w in held[5])
    assert chat.format_dialogues(df.where("false")).count() == 0


def undo(text):
    import re
    return re.sub(r"<~(~*)\|", r"<\1|", text)


def test_history_must_fit(spark):
    with pytest.raises(ValueError):
        chat.format_dialogues(spark.createDataFrame([], "media_id int, cue_idx int, role string, text string"), 100, 60, 20)


def test_language_fuses_evidence(spark):
    stems = {"en": "the water of this film and there".split(), "de": "der wald und nicht über schön".split(), "fr": "le garçon et une très être".split()}
    rng = random.Random(6)

    def text(x, n=60):
        return " ".join(rng.choices(stems[x], k=n))
    samples = spark.createDataFrame([(x, text(x)) for x in stems for _ in range(20)] + [("xx", "zzz"), (None, "y"), ("en", None)], "lang string, text string")
    files, truth = [], {}
    for i in range(150):
        x = ("en", "de", "fr")[i % 3]
        truth[i] = x
        host = f"https://www.{'filme' if x == 'de' else 'cinema'}.example.org/{x if i % 5 else 'films'}/{i}"
        body = text(x, 30 if i % 7 else 0)
        files.append((i, host, f'<html lang="{x if i % 11 else "en"}"><script>the the the</script><p>{body}</p>' if i % 2 else body))
    files += [(1000, None, None), (1001, "", ""), (1002, "film.fr.srt", "12 34"), (None, "x", "der wald"), (3, files[3][1], files[3][2]),
              (1003, "https://www.filme.example.org/", "")]
    df = spark.createDataFrame([(*f, "clash") for f in files], "media_id bigint, media_path string, text string, lang string")
    rows = language.identify_language(df, samples, ["de", "en", "fr"]).collect()
    assert len(rows) == len(files)
    got = {r.media_id: r for r in rows}
    assert np.mean([got[i].lang == x for i, x in truth.items()]) > 0.97
    assert got[1002].lang == "fr" and got[1002].address == "fr" and got[1002].text_lang is None
    assert got[1003].lang == "de" and got[1000].text_lang is None and got[1000].host is None
    assert all(0 < r.probability <= 1 for r in rows)
    assert language.identify_language(df.where("false"), samples, ["de", "en"]).count() == 0


def test_declared_language_wherever_the_tag_is(spark):
    late = "<!-- <html lang=en> " + "licence " * 13_000 + "-->" + "\n" * 5000 + '<HTML class="x" lang="de-AT"><p>der wald</p>'
    files = spark.createDataFrame([(1, "", late), (2, "", "<!-- <html lang=en>"), (3, "", "<html><p lang=fr>")], "media_id int, media_path string, text string")
    samples = spark.createDataFrame([("en", "the water"), ("de", "der wald")], "lang string, text string")
    assert {r.media_id: r.declared for r in language.identify_language(files, samples, ["de", "en"]).collect()} == {1: "de", 2: None, 3: None}


def test_licenses_own_and_inherited(spark):
    files = [(1, "a/b/x.srt", "some cue\nReleased under the MIT License.\nmore"), (2, "a/LICENSE", "Licensed under the Apache License,\nVersion 2.0"), (3, "a/b/y.srt", "cue"),
             (4, "a/c/COPYING.txt", "This work is licensed under the GNU General Public License, version 3."), (5, "a/c/d/z.srt", ""), (6, "q/z.srt", None),
             (7, None, "Licensed under CC BY-NC 4.0."), (8, None, "nothing"), (None, "a/b/y.srt", "cue"), (3, "a/b/y.srt", "cue"), (9, "top.srt", "the licence plate of the car was seen by many"),
             (10, "ab/x.srt", "cue"), (11, "a/c/LICENSE", "Licensed under CC BY-NC 4.0.")]
    df = spark.createDataFrame([(*f, "clash") for f in files], "media_id bigint, media_path string, text string, license string")
    rows = licenses.scan_licenses(df).collect()
    assert len(rows) == len(files)
    got = {r.media_id: (r.license, r.origin, r.license_path) for r in rows}
    assert got[1] == ("MIT", "own", "a/b/x.srt") and got[2][:2] == ("Apache-2.0", "own")
    assert got[3] == got[None] == ("Apache-2.0", "inherited", "a/LICENSE")
    assert got[4][:2] == ("GPL-3.0", "own") and got[11][:2] == ("CC-BY-NC-4.0", "own")
    assert got[5][1] == "inherited" and got[5][2].startswith("a/c/")
    assert got[6] == got[8] == got[9] == got[10] == (None, None, None)
    assert got[7][:2] == ("CC-BY-NC-4.0", "own")
    assert licenses.scan_licenses(df.where("false")).count() == 0


def brute_license(text, is_file, least=0.6, margin=0.02):
    """Best notice of a text by cosines of word counts, from their definition."""
    def counted(t):
        return Counter(w for w in re.split(r"[\W_]+", t.lower()) if w)

    held = [(name, counted(t)) for name, t in licenses.TEMPLATES]
    df = Counter(w for _, c in held for w in c)

    def unit(c):
        weights = {w: n * (math.log((1 + len(held)) / (1 + df[w])) + 1) for w, n in c.items()}
        norm = math.sqrt(sum(x * x for x in weights.values()))
        return {w: x / norm for w, x in weights.items()}

    lines, found = text.split("\n"), [text.replace("\n", " ")] * is_file
    for i, line in enumerate(lines):
        if re.search(licenses._HINT, line):
            found.append(line)
            for low, high in ((i, i + 2), (i, i + 3), (i - 1, i + 1), (i - 1, i + 2)):
                if low >= 0 and high <= len(lines) and all(len(x) <= licenses.WRAPPED for x in lines[low:high]):
                    found.append(" ".join(lines[low:high]))
    best = []
    for notice in found:
        mine, by = unit(counted(notice)), {}
        for name, c in held:
            score = round(sum(x * mine.get(w, 0) for w, x in unit(c).items()), 9)
            if score >= least:
                by[name] = max(score, by.get(name, 0))
        top = sorted((-x, name) for name, x in by.items())
        if top and (len(top) == 1 or top[1][0] - top[0][0] >= margin - 1e-12):
            best.append(top[0])
    return min(best)[1] if best else None


RELATIVES = [
    ("Licensed under CC BY 4.0", "CC-BY-4.0"), ("CC BY-SA 4.0", "CC-BY-SA-4.0"), ("Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0"), ("Licensed under CC BY-NC-SA 4.0", None),
    ("# This work is licensed under the GNU General Public License version 2", "GPL-2.0"), ("This work is licensed under the GNU General Public License", None),
    ("GNU Lesser General Public License version 3", "LGPL-3.0"), ("// SPDX-License-Identifier: MIT", "MIT"), ("/* SPDX-License-Identifier: Apache-2.0 */", "Apache-2.0"),
    ("SPDX-License-Identifier: GPL-2.0-only", "GPL-2.0"), ("SPDX-License-Identifier: BSD-2-Clause", "BSD-2-Clause"), ("SPDX-License-Identifier: EUPL-1.2", None),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted", None), ("the licence plate of the car was seen", None),
    ("code\n * This work is licensed under\n * the GNU General Public License\n * version 2\ncode and more code", "GPL-2.0"),
    ("Released under\nthe MIT License", "MIT"), ("Released under the\n" + "x" * 161 + " MIT License", None), ("BSD 3-Clause License\n\nRedistribution and use in source and binary forms", "BSD-3-Clause"),
    ("\n".join(["a line of talk"] * 60_000) + "\nLicensed under the Apache License,\nVersion 2.0", "Apache-2.0"), ("licence " * 30_000, None)]


def test_licenses_of_near_relatives(spark):
    files = [(i, f"d{i}/x.srt", t) for i, (t, _) in enumerate(RELATIVES)] + [(100 + i, f"e{i}/LICENSE", t) for i, (t, _) in enumerate(RELATIVES)]
    got = {r.media_id: r.license for r in licenses.scan_licenses(spark.createDataFrame(files, "media_id bigint, media_path string, text string")).collect()}
    assert {i: got[i] for i in range(len(RELATIVES))} == {i: want for i, (_, want) in enumerate(RELATIVES)}
    assert got == {i: brute_license(t, i >= 100) for i, _, t in files}
