"""The registered queries on the benchmark tables, and the pipeline on planted rows."""

import os
import random

import pytest

pytest.importorskip("public_tokenizers")
from oracle import compare, connect

import corpus_pipeline
from spanweave.llm.queries import ORACLES, QUERIES

SF_DIR = os.environ.get("SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(SF_DIR):
        pytest.skip("no benchmark tables")
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_sql(spark, duck, name):
    assert compare(spark, duck, name, QUERIES[name], ORACLES[name], SF_DIR) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_covers_its_table(spark, duck, name):
    rows = QUERIES[name](spark, SF_DIR).collect()
    key = {"op5_chat": "conv_id", "op7_language": "page_id"}.get(name, "doc_id")
    table = {"op5_chat": "conversations", "op7_language": "pages"}.get(name, "documents")
    ids = {r[0] for r in duck.sql(f"SELECT DISTINCT {key} FROM {table}").fetchall()} | ({-1} if name == "op5_chat" else set())
    assert {r[key] for r in rows} == ids


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    """Clean texts, exact copies, copies with another case, junk, shared lines, awkward rows, and a foreign column."""
    rng = random.Random(8)
    words = [a + b for a in ("th", "er", "on", "wat", "riv", "lo") for b in ("e", "an", "ing", "er", "ost")]
    clean = [" ".join(rng.choices(words, k=rng.randint(60, 200))).capitalize() + "." for _ in range(120)]
    line = "this line about the film is one that many of the texts do share"
    rows = [(i, f"{t}\n{line}" if i < 20 else t, "en", "s", len(t), "x") for i, t in enumerate(clean)]
    rows += [(200 + i, clean[50], "en", "s", 1, "x") for i in range(30)] + [(300, clean[60].upper(), "en", "s", 1, "x"), (301, clean[60].lower(), "en", "s", 1, "x")]
    rows += [(400 + i, " ".join(w + rng.choice(["***", "$$$", "%%%", "###"]) for w in rng.choices(words, k=100)), "en", "s", 1, "x") for i in range(60)]
    rows += [(500, "spam spam " * 200, "en", "s", 1, "x"), (501, "short", "en", "s", 5, "x"), (502, None, None, None, None, None), (503, "", "en", "s", 0, "x"), rows[70], (None, clean[61] + " but for an end without any id", "en", "s", 1, "x")]
    folder = str(tmp_path_factory.mktemp("planted"))
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, score string").write.parquet(f"{folder}/documents.parquet")
    labels = [(i, 1, 0) for i in range(120)] + [(400 + i, 0, 0) for i in range(60)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, clean, line


def test_pipeline_keeps_clean_and_drops_planted(spark, planted, tmp_path):
    folder, clean, line = planted
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    left = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        left[name] = [r.doc_id for r in docs.select("doc_id").collect()]
    assert not {500, 501, 502, 503} & set(left["quality_rules"])
    assert set(range(120)) <= set(left["quality_rules"])
    assert not set(range(400, 460)) & set(left["quality_classifier"]) and set(range(120)) <= set(left["quality_classifier"])
    rows = {r.doc_id: r for r in docs.collect()}
    assert set(range(120)) <= set(rows) and len(left["near_dedup"]) == len(rows)
    # the one line of 50 and its copies stays in the last of them, and the first stands for those it leaves empty
    assert set(rows) - {None} == set(range(120)) | {229} and rows[50].text == "" and rows[229].text == clean[50]
    assert all(rows[i].text == clean[i] and rows[i].n_chars == len(clean[i]) for i in range(19)) and rows[19].text == f"{clean[19]}\n{line}"
    assert rows[3].score == "x"
    pieces = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in pieces} == set(rows)
    assert sum(r.length for r in pieces) == sum({r.doc_id: r.doc_tokens for r in pieces}.values())


def test_pipeline_on_an_empty_table(spark, planted, tmp_path):
    folder, *_ = planted
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("false")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
    assert docs.count() == 0
