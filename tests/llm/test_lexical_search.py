"""Ranked search against plain Python: exact scores, ties, nulls, repeated rows and queries, blocks that are passed over."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from spanweave.llm import lexical_search
from spanweave.llm.lexical_search import Shard

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(scripts, queries, k):
    held = [(m, Counter(terms(t))) for m, t in scripts]
    held = [(m, c) for m, c in held if c]
    n_texts, total = len(held), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for q, text in set(queries):
        scored = []
        for m, c in held:
            norm = 100 - 75 + 75 * c.total() * n_texts // total
            score = sum(math.floor(1000 * math.log((2 * n_texts + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 8 * norm)) for t in terms(text) if t in c)
            if score > 0:
                scored.append((-score, m is None, m or 0))
        out += [(q, i, None if none else m, -s) for i, (s, none, m) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def records():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(60)] + ["The", "the", "Éa", "éa", "12", "漢字", "it's", "a_b", "x-y"]
    weights = [1 / (i + 1) for i in range(len(words))]
    texts = [" ".join(rng.choices(words, weights, k=rng.randint(1, 40))) for _ in range(300)]
    scripts = [(i, t) for i, t in enumerate(texts)] + [(None, texts[5]), (None, texts[5]), (3, texts[3]), (3, "another w1"), (900, None), (901, ""), (902, " .;_")]
    scripts += [(1000 + i, texts[7]) for i in range(30)] + [(2000, "w3 w4 " * 50_000)]
    queries = [(i, " ".join(rng.choices(words, k=rng.randint(1, 12)))) for i in range(12)]
    return scripts, queries + [queries[0], (0, "w9 w9 w9"), (50, None), (51, ""), (52, "nowhere"), (53, texts[7]), (54, "the THE the"), (None, "w1 éa")]


@pytest.mark.parametrize("group, shard, block", [(512, 2048, 32), (3, 40, 3)])
def test_ranking_by_brute_force(spark, monkeypatch, group, shard, block):
    for name, value in (("QUERIES", group), ("SHARD", shard), ("BLOCK", block)):
        monkeypatch.setattr(lexical_search, name, value)
    scripts, queries = records()
    texts = spark.createDataFrame([(m, t, "clash", 1, 2) for m, t in scripts], "media_id bigint, text string, query string, n int, score int").repartition(3)
    asked = spark.createDataFrame([(q, t, 5) for q, t in queries], "query_id bigint, text string, media_id int")
    found = lexical_search.rank_scripts(texts, asked, k=5)
    assert found.columns == ["query_id", "rank", "media_id", "score"]
    assert sorted(map(tuple, found.collect()), key=str) == brute(scripts, queries, 5)


def test_empty_tables(spark):
    texts = spark.createDataFrame([(1, "w1")], "media_id bigint, text string")
    asked = texts.withColumnRenamed("media_id", "query_id")
    assert lexical_search.rank_scripts(texts.limit(0), asked).count() == 0
    assert lexical_search.rank_scripts(texts, asked.limit(0)).count() == 0


def test_terms_of_columns_and_of_tasks_are_the_same(spark):
    texts = ["", "A b\x00c\x7fd", "it's 12_x {y} [z] `q` @R", "Éa\u0085b c", "퟿漢字 🙂a", "".join(map(chr, range(200)))]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").orderBy("i")
    got = [r.t for r in df.select(lexical_search.term_array(df.text).alias("t")).collect()]
    assert got == [terms(t) for t in texts] == [[x.decode() for x in lexical_search.terms_of(t)] for t in texts]


def test_blocks_are_passed_over_without_loss():
    rng = np.random.default_rng(0)
    topics = rng.integers(0, 12, 1500)
    impacts = (rng.integers(1, 100_000, (1500, 60)) * (rng.random((1500, 60)) < 0.05)).astype(np.int32)
    for i, t in enumerate(topics):  # texts of one topic share its terms
        impacts[i, t * 5:t * 5 + 5] = rng.integers(200_000, 900_000, 5)
    shard, passed = Shard(impacts), 0
    for _ in range(40):
        terms = rng.integers(0, 60, 6)
        weights = np.random.default_rng(9).integers(1, 9000, 60)[terms]
        score = impacts[:, terms].astype(np.int64) @ weights
        found, got, over = shard.best(terms, weights, 10, 1)
        order = np.lexsort((np.arange(len(score)), -score))[:10]
        kept = sorted(zip((-got).tolist(), found.tolist()))[:10]
        assert kept == [(-int(score[i]), int(i)) for i in order if score[i] > 0]
        passed += over
    assert passed > 0
    for term, (blocks, summary) in shard.blocks.items():
        assert sorted(np.concatenate(blocks).tolist()) == np.flatnonzero(impacts[:, term]).tolist()
        for b, s in zip(blocks, summary):
            assert (s.astype(np.int64) * shard.step >= impacts[b].max(axis=0)).all()
