"""Language of text files by Bayesian fusion of what they say with what is said about them."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from spanweave.llm.common import column_of, importable, map_batches, portions, texts_of
from spanweave.session import stage

#: Buckets of hashed letter trigrams.
BUCKETS = 1 << 14
#: A page's text weighs as so many independent trigrams at most, since neighbours are not independent.
TEXT_WEIGHT = 60.0
#: Pseudo-counts by which a host leans on its domain and a domain on all hosts, and of each evidence table.
HOST_LEAN, DOMAIN_LEAN, SMOOTHING = 8.0, 16.0, 2.0

#: What is no text; an unclosed script, style or comment reaches to the end, so each character is read once.
_BLOCKS = re.compile(r"(?is)<(script|style)\b(?:.*?</\1\s*>|.*)|<!--(?:.*?-->|.*)|<[^<>]*>|&\w+;")
#: The first <html> tag, or what it can't be in; an unclosed comment reaches to the end.
_ROOT = re.compile(r"(?is)<!--(?:.*?-->|.*)|<html\b([^>]*)")
_DECLARED = re.compile(r"""(?i)(?<![\w-])lang\s*=\s*["']?([a-z]{2,3})\b""")
_HOST = re.compile(r"(?i)^[a-z][a-z0-9+.-]*://([^/?#:]*)")
_CODE = re.compile(r"(?:^|[/._-])([a-z]{2,3})(?=[/._?#-]|$)")


def trigrams(text: str) -> np.ndarray:
    """Buckets of the letter trigrams of a text, words set apart by one space."""
    letters = " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())
    codes = np.frombuffer(f" {letters} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if len(codes) < 3:
        return np.zeros(0, np.int64)
    mixed = (codes[:-2] * np.uint64(0x9E3779B1) ^ codes[1:-1] * np.uint64(0x85EBCA77) ^ codes[2:] * np.uint64(0xC2B2AE3D)) * np.uint64(0x27D4EB2F165667C5)
    return (mixed >> np.uint64(50)).astype(np.int64) & (BUCKETS - 1)


def plain_text(markup: str) -> str:
    return _BLOCKS.sub(" ", markup) if "<" in markup else markup


def declared_language(markup: str) -> str:
    """The code that the first <html> tag outside comments declares, wherever it stands; each character is read once."""
    for found in _ROOT.finditer(markup):
        if found.group(1) is not None:
            code = _DECLARED.search(found.group(1))
            return code.group(1).lower() if code else ""
    return ""


def host_of(address: str) -> str:
    found = _HOST.match(address)
    return found.group(1).lower() if found else ""


def address_code(address: str, languages: list[str]) -> str:
    """The language code that an address ends its host, a folder or a suffix with; the last one counts."""
    host = _HOST.match(address)
    path = address[host.end():] if host else address
    codes = [c for c in _CODE.findall(path.lower().split("?")[0].split("#")[0]) if c in languages]
    return codes[-1] if codes else ""


def trigram_counts(samples: DataFrame, languages: list[str]) -> DataFrame:
    """``lang``, ``bucket``, ``n`` over all labelled texts in one of the languages; tasks add up before they send."""

    def run(batches):
        total = {x: np.zeros(BUCKETS, np.int64) for x in languages}
        for batch in portions(batches):
            for lang, text in zip(column_of(batch, "lang").to_pylist(), texts_of(batch)):
                if lang in total:
                    total[lang] += np.bincount(trigrams(text), minlength=BUCKETS)
        for lang, n in total.items():
            seen = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(seen), pa.string()), pa.array(seen), pa.array(n[seen])], names=["lang", "bucket", "n"])

    schema = StructType([StructField("lang", StringType()), StructField("bucket", LongType()), StructField("n", LongType())])
    return importable(samples).select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema).groupBy(
        "lang", "bucket").agg(F.sum("n").alias("n"))


def text_model(samples: DataFrame, languages: list[str]) -> np.ndarray:
    """Log probability of each bucket per language: ``BUCKETS`` numbers each, whatever the number of samples."""
    table = np.full((len(languages), BUCKETS), 0.5)
    for row in trigram_counts(samples, languages).toArrow().to_pandas().itertuples():
        table[languages.index(row.lang), row.bucket] += row.n
    return np.log(table / table.sum(axis=1, keepdims=True))


def identify_language(files: DataFrame, samples: DataFrame, languages: list[str]) -> DataFrame:
    """The language of each text file, with its probability and the evidence.

    ``files``: ``media_id``, ``media_path`` (path or URL of a subtitle file or page), ``text`` (plain or markup).
    ``samples``: ``lang``, ``text``; texts in other than ``languages`` (a short list of codes) are left out. Other columns
    are left out. Result, one row per input row: ``media_id``, ``lang``, ``probability``, ``text_lang`` (by the text
    alone, null where it has no letters), ``declared`` and ``address`` (codes, null where missing), ``host``.

    Four independent sources: the text under a trigram model; the language that markup declares and the code in the
    address, each by how often it goes with what texts say, over all files; and a prior from the host, which leans on
    its domain, and that on all hosts. Counts are the text's probabilities added up by grouped aggregation. A file
    without any evidence gets the most frequent language. Ties go to the earlier code in ``languages``.
    """
    k = len(languages)
    model = files.sparkSession.sparkContext.broadcast(text_model(samples, languages))

    def score(batches):
        for batch in batches:
            paths = [p or "" for p in column_of(batch, "media_path").to_pylist()]
            rows, declared = [], []
            for text in texts_of(batch):
                buckets = trigrams(plain_text(text))
                n = np.bincount(buckets, minlength=BUCKETS).astype(np.float64)
                logs = model.value @ n if len(buckets) else np.zeros(k)
                logs = logs * min(1.0, TEXT_WEIGHT / max(len(buckets), 1))
                rows.append(np.exp(logs - logs.max()) if len(buckets) else np.ones(k))
                declared.append(declared_language(text))
            p = np.array(rows, np.float64).reshape(-1, k)
            p /= p.sum(axis=1, keepdims=True)
            hosts = [host_of(a) for a in paths]
            yield pa.RecordBatch.from_arrays(
                [column_of(batch, "media_id"), pa.array(p.tolist(), pa.list_(pa.float64())), pa.array(declared, pa.string()),
                 pa.array([address_code(a, languages) for a in paths], pa.string()), pa.array(hosts, pa.string())],
                names=["media_id", "p", "declared", "address", "host"])

    seen = stage(map_batches(
        files.select("media_id", F.col("media_path").cast("string").alias("media_path"), F.col("text").cast("string").alias("text")), score,
        StructField("p", ArrayType(DoubleType())), *[StructField(c, StringType()) for c in ("declared", "address", "host")]))
    domain = F.array_join(F.slice(F.split("host", r"\."), F.greatest(F.lit(1), F.size(F.split("host", r"\.")) - 2 + 1), 2), ".")
    seen = seen.withColumn("domain", F.when(F.col("host") == "", "").otherwise(domain))
    sums = [F.sum(F.get("p", F.lit(i))).alias(f"n{i}") for i in range(k)]
    vector = lambda: F.array(*[F.col(f"n{i}") for i in range(k)])

    every = seen.agg(*sums).select(F.transform(vector(), lambda n: (F.coalesce(n, F.lit(0.0)) + SMOOTHING) / 1.0).alias("n"))
    total = F.aggregate("n", F.lit(0.0), lambda a, b: a + b)
    share = every.select(F.transform("n", lambda n: n / total).alias("all_p"))
    domains = seen.groupBy("domain").agg(*sums).select("domain", vector().alias("n")).crossJoin(F.broadcast(share)).select(  # one row
        "domain", "all_p", F.transform(F.arrays_zip("n", "all_p"), lambda z: (z["n"] + DOMAIN_LEAN * z["all_p"]) / (F.aggregate("n", F.lit(DOMAIN_LEAN), lambda a, b: a + b))).alias("domain_p"))
    hosts = seen.groupBy("host", "domain").agg(*sums).select("host", "domain", vector().alias("n")).join(domains, "domain").select(
        "host", "all_p", F.transform(F.arrays_zip("n", "domain_p"), lambda z: (z["n"] + HOST_LEAN * z["domain_p"]) / (F.aggregate("n", F.lit(HOST_LEAN), lambda a, b: a + b))).alias("host_p"))

    def likelihood(column):
        """Per value, how likely each language goes with it, next to how likely it goes with any; 1 if missing."""
        values = seen.where(F.col(column) != "").groupBy(column).agg(*sums).select(column, vector().alias("n")).crossJoin(F.broadcast(share))
        return values.select(column, F.transform(F.arrays_zip("n", "all_p"), lambda z: (z["n"] + SMOOTHING * z["all_p"]) / z["all_p"]).alias(f"{column}_l"))

    joined = seen.join(hosts, "host").join(likelihood("declared"), "declared", "left").join(likelihood("address"), "address", "left")
    ones = F.array_repeat(F.lit(1.0), k)
    joined = joined.withColumns({c: F.coalesce(c, ones) for c in ("declared_l", "address_l")})
    # The text's p holds a uniform prior, the host's is the prior; ratios leave out what all languages share.
    fused = F.transform(F.arrays_zip("p", "host_p", "declared_l", "address_l"), lambda z: F.greatest(z["p"], F.lit(1e-12)) * z["host_p"] * z["declared_l"] * z["address_l"])
    codes = F.array(*[F.lit(x) for x in languages])
    best = lambda column: F.get(codes, (F.array_position(column, F.array_max(column)) - 1).cast("int"))
    result = joined.withColumn("fused", fused)
    flat = F.array_max("p") - F.array_min("p") < 1e-12
    return result.select(
        "media_id", best(F.col("fused")).alias("lang"), (F.array_max("fused") / F.aggregate("fused", F.lit(0.0), lambda a, b: a + b)).alias("probability"),
        F.when(~flat, best(F.col("p"))).alias("text_lang"), F.nullif(F.col("declared"), F.lit("")).alias("declared"),
        F.nullif(F.col("address"), F.lit("")).alias("address"), F.nullif(F.col("host"), F.lit("")).alias("host"))
