"""Near duplicates by shingles against all pairs, on small tables."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from spanweave.llm.resemblance import resembling_groups, shingle_set
from spanweave.llm.simhash import fingerprint, shingle_digests

WORDS = [a + b for a in ("th", "er", "on", "wat", "riv", "lo", "st", "gr") for b in ("e", "an", "ing", "er", "ost", "ain")]


def keyed(df):
    return df.withColumns({"k": F.xxhash64("media_id", "text"), "l": F.xxhash64(F.lit(1), F.col("media_id"), F.col("text"))})


def groups_of(rows):
    """Partition of (id, text) rows by a union over all pairs."""
    sets = [set(shingle_set(shingle_digests(t or "", 5)).tolist()) for _, t in rows]
    prints = [fingerprint(t or "", 5) for _, t in rows]
    above = list(range(len(rows)))

    def root(x):
        while above[x] != x:
            x = above[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        common = len(sets[i] & sets[j])
        if bin(prints[i] ^ prints[j]).count("1") <= 2 or common and common >= 0.8 * len(sets[i] | sets[j]):
            above[max(root(i), root(j))] = min(root(i), root(j))
    found = {}
    for i, (m, _) in enumerate(rows):
        found.setdefault(root(i), []).append(m)
    return sorted(sorted(g, key=str) for g in found.values())


def found_by(spark, rows):
    df = spark.createDataFrame([(m, t, "x", 1) for m, t in rows], "media_id bigint, text string, fingerprint string, root int")
    out = {}
    for r in resembling_groups(keyed(df), ("k", "l")).collect():
        out.setdefault(r.root, []).append(r.media_id)
    return sorted(sorted(g, key=str) for g in out.values())


def edited(rng, text, share):
    words = text.split()
    for i in rng.sample(range(len(words)), round(len(words) * share)):
        words[i] = rng.choice(WORDS) + "x"
    return " ".join(words)


def test_groups_equal_all_pairs(spark):
    rng = random.Random(3)
    passage = " ".join(rng.choices(WORDS, k=60))
    rows = []
    for i in range(40):
        base = " ".join(rng.choices(WORDS, k=rng.choice([12, 60, 150, 400])))
        base = f"{base} {passage}" if i % 3 == 0 else base
        rows.append((len(rows), base))
        # 1 % of the words gives a similarity near 0.9, 4 % one near 0.7
        rows += [(len(rows) + k, edited(rng, base, share)) for k, share in enumerate(rng.choices([0.0, 0.01, 0.02, 0.04, 0.3], k=4))]
    rows += [(len(rows) + k, edited(rng, rows[0][1], 0.01)) for k in range(60)]
    rows += [(900, None), (901, ""), (902, " \n"), (903, "one two"), (904, "ONE\ttwo"), (None, rows[5][1]), rows[7], rows[7],
             (905, " ".join(rng.choices(WORDS, k=20_000)))]
    rows.append((906, edited(rng, rows[-1][1], 0.015)))
    assert found_by(spark, rows) == groups_of(rows)


def test_empty_table(spark):
    assert found_by(spark, [])  == []


@pytest.mark.parametrize("edits, linked", [(1, True), (3, False)])
def test_the_bound_of_similarity(spark, edits, linked):
    """54 words have 50 shingles; a new word in the middle replaces five: 45 of 55 in common, three words 35 of 65."""
    words = [f"w{i}" for i in range(54)]
    other = list(words)
    for e in range(edits):
        other[10 + 12 * e] = "new"
    assert len(found_by(spark, [(1, " ".join(words)), (2, " ".join(other))])) == (1 if linked else 2)


@pytest.mark.parametrize("members", [600])
def test_family_below_the_threshold_keeps_its_pairs(spark, members):
    """Texts that share most of a template: any two at 0.78, and each with one partner just above 0.8. All pairs come together."""
    rng = random.Random(8)
    fresh = iter(range(10 ** 9))

    def own(n):
        return [f"w{next(fresh)}" for _ in range(n)]

    template = [f"t{i}" for i in range(354)]
    rows = []
    for pair in range(members // 2):
        both = own(12)
        for _ in range(2):
            rows.append((len(rows), " ".join(template + both + own(38))))
    rng.shuffle(rows)
    sets = {m: set(shingle_set(shingle_digests(t, 5)).tolist()) for m, t in rows}
    for a, b in [(0, 1), (0, 2), (4, 5), (5, 9)]:
        alike = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
        assert (alike >= 0.8) == (a // 2 == b // 2) and alike > 0.77
    found = found_by(spark, rows)
    assert found == groups_of(rows)  # fingerprints within two bits join some of the pairs
    assert sum(len(g) == 2 and g[0] // 2 == g[1] // 2 for g in found) > members // 3
