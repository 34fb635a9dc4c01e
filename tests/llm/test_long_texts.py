"""Texts that once ended a job or flooded the driver: long blank runs, ids with many rows, long and odd token lists."""

import time

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")
import public_tokenizers
from tokenizers import Tokenizer

from spanweave.llm import bpe, language, packing, quality_net

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def test_packing_takes_long_blank_runs(spark):
    texts = [("a" if i % 2 else "") + blank * 2_000_000 + ("z" if i % 3 else "") for i, blank in enumerate(" \t\n")] + [" " * 2_000_000 + "word  x"]
    pieces = packing.pack_scripts(spark.createDataFrame(list(enumerate(texts)), "media_id bigint, text string").repartition(2), TOKENIZER).collect()
    library = Tokenizer.from_file(TOKENIZER)
    for i, text in enumerate(texts):
        own = sorted((p for p in pieces if p.media_id == i), key=lambda p: p.piece_start)
        assert [x for p in own for x in p.token_ids] == [*library.encode(text, add_special_tokens=False).ids, 0]


def test_decoding_tables_of_any_ids(spark, monkeypatch):
    monkeypatch.setattr(bpe, "_IDS", 7)
    library = Tokenizer.from_file(TOKENIZER)
    ids = [library.encode(t, add_special_tokens=False).ids for t in ("", "Haus \u00e9a <|endoftext|> x", "\u6f22\u5b57" * 30, "a", "b c")]
    rows = [(i, x) for i, x in enumerate(ids)] + [(10, None), (11, []), (12, [None, ids[1][0], -5, 10 ** 6, 2 ** 31 - 1, None]), (13, [library.token_to_id("\u00c3")])]
    df = spark.createDataFrame(rows, "media_id bigint, token_ids array<int>").coalesce(1)
    got = {r.media_id: r.text for r in bpe.decode_scripts(df, TOKENIZER).collect()}
    assert [got[i] for i in range(5)] == [library.decode(x, skip_special_tokens=False) for x in ids]
    assert (got[10], got[11], got[12], got[13]) == ("", "", library.decode(ids[1][:1]), "\ufffd")
    dense = df.where("token_ids IS NOT NULL AND media_id < 5")
    assert {r.media_id: r.text for r in bpe.decode_scripts(dense, TOKENIZER).collect()} == {i: got[i] for i in range(5)}


def test_training_sample_has_a_text_per_id(spark):
    texts = spark.createDataFrame([(1, f"text {i}") for i in range(500)] + [(2, "x"), (2, None), (3, "y" * 9000), (None, "z")], "media_id bigint, text string").repartition(4)
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 1), (3, 0), (3, 0), (4, 1), (5, 7), (None, 1)], "media_id bigint, label int")
    rows = {r.media_id: (r.text_slices, r.label) for r in quality_net.training_sample(texts, labels).collect()}
    assert set(rows) == {1, 2, 3} and rows[1][1] == 0 and rows[1][0][0].startswith("text ")
    assert rows[3] == (["y" * quality_net.TRAIN_CHARS] * quality_net.TRAIN_SLICES, 0) and len(rows[2][0]) == 1
    again = {r.media_id: (r.text_slices, r.label) for r in quality_net.training_sample(texts.repartition(7), labels).collect()}
    assert again == rows and isinstance(quality_net.fit_quality(texts, labels).table, np.ndarray)


def test_markup_that_never_closes_is_read_once():
    started = time.time()
    for odd in ("<script>", "<!--", "<", "<style x", "<a href='", "</script", "&a"):
        language.plain_text(odd * 300_000)
        language.declared_language(odd * 300_000)
    assert time.time() - started < 30
    assert language.plain_text("a<script>x<b></script>b<!-- <p> -->c<p q='1'>d&amp;e").split() == ["a", "b", "c", "d", "e"]
    assert language.plain_text("a<script>never closed <p>b</p>").split() == ["a"]
    for tag, code in (('data-lang="fr" lang="de"', "de"), ("xml:lang='es'", "es"), ("LANG=fr-CA", "fr"), ("hreflang=fr", ""), ("", "")):
        assert language.declared_language(f"<!-- <html lang=xx> --><html {tag}>") == code


def test_texts_of_the_language_model_are_not_shuffled_to_their_grams(spark):
    from spanweave.llm import ngram_quality
    texts = spark.createDataFrame([(i, f"some words of text number {i} for a model of bytes " * 3, "en") for i in range(50)], "media_id long, text string, lang string")
    plan = ngram_quality.score_scripts(texts)._jdf.queryExecution().executedPlan().toString()
    beside = plan[plan.index("FlatMapCoGroupsInArrow"):plan.index("ReadSchema: struct<block:bigint,texts:binary>")]
    assert "Exchange" not in beside and "Bucketed: true" in beside
