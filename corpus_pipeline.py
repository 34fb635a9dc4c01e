"""Documents to packed training sequences: rules, classifier, shared lines, near duplicates, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanweave.llm import line_dedup, ngram_quality, packing, quality_net, resemblance
from spanweave.llm.queries import QUALITY, packed_pieces, quality_labels, tokenizer
from spanweave.session import scratch_path


def _scripts(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """Documents as texts of media, and placeholders for their other columns, which can't clash with an operator's."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    names = [f"__c{i}" for i in range(len(others))]
    return docs.select(F.col("doc_id").alias("media_id"), "text", *[F.col(f"`{c}`").alias(n) for c, n in zip(others, names)]), names


def _documents(df: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` from a table of media."""
    others = iter(range(len(docs.columns)))
    back = {"doc_id": "media_id", "text": "text"}
    return df.select(*[F.col(back[c] if c in back else f"__c{next(others)}").alias(c) for c in docs.columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rule counts and the perplexity band of their language. Rows with equal id and text
    share a verdict."""
    scripts, _ = _scripts(docs)
    judged = ngram_quality.judge_scripts(docs.select(F.col("doc_id").alias("media_id"), "text", "lang"), passing_only=True)
    gone = judged.where("NOT kept").select("media_id", "text_key").distinct()
    key = F.xxhash64(F.coalesce("text", F.lit("")))
    same = F.col("s.media_id").eqNullSafe(F.col("g.media_id")) & (key == F.col("g.text_key"))
    return _documents(scripts.alias("s").join(gone.alias("g"), same, "left_anti"), docs)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network takes for good, learned from the labels of documents that are still there."""
    scripts, others = _scripts(docs)
    network = quality_net.fit_quality(scripts, quality_labels(spark, sf_dir))
    return _documents(quality_net.score_quality(scripts, network, "text", *others).where(F.col("score") >= QUALITY), docs)


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that five or more share, but for the last of them. ``n_chars`` follows the text."""
    scripts, others = _scripts(docs)
    done = _documents(line_dedup.drop_lines(scripts, line_dedup.line_keep_bitmaps(scripts), *others), docs)
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return done


def near_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, by fingerprint or by shingles: the one with the smallest id, and
    of its rows one."""
    scripts, others = _scripts(docs)
    # Two hashes name a row by id and text; neither is ever null.
    keyed = scripts.withColumns({"__k": F.xxhash64("media_id", "text"), "__l": F.xxhash64(F.lit(1), F.col("media_id"), F.col("text"))})
    found = resemblance.resembling_groups(keyed, ("__k", "__l"), SHINGLE, SIMILARITY)
    first = F.struct(F.col("media_id").isNull().alias("n"), "media_id", "__k", "__l")
    keepers = found.groupBy("root").agg(F.min(first).alias("f")).select("f.__k", "f.__l")
    return _documents(keyed.join(keepers, ["__k", "__l"], "left_semi").dropDuplicates(["__k", "__l"]), docs)


#: Words in a shingle of near duplicates, and the share of shingles that they have in common.
SHINGLE, SIMILARITY = 5, 0.8


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 1024 tokens."""
    return packed_pieces(packing.pack_scripts(docs.withColumnRenamed("doc_id", "media_id"), tokenizer()))


STAGES = [("quality_rules", quality_rules), ("quality_classifier", quality_classifier), ("line_dedup", line_deduplication),
          ("near_dedup", near_deduplication), ("packing", packed)]

#: SQL can express neither the language model nor the network, so the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each is written to the shared folder and read again by the next."""
    folder = scratch_path(spark, "corpus")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)

