"""Writers: subtitle text, nested timelines and keyed upserts."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanweave.functions.timefmt import idiv, ms_to_ts
from spanweave.operators.jobs import upsert_latest
from spanweave.operators.scan import Running, id_blocks, row_rank, running, time_blocks
from spanweave.session import stage

MEDIA = "media_id"
#: Findings per timeline document; films have far fewer, and a catch-all media is paged.
PAGE = 10_000


def format_srt(cues: DataFrame) -> DataFrame:
    """Numbered subtitle blocks per film. One row per block, so a film is never one value."""
    ranked = row_rank(cues, [MEDIA], ["cue_idx"], id_blocks("cue_idx"), "n")
    return ranked.select(MEDIA, "n", F.concat(
        F.col("n").cast("string"), F.lit("\n"), ms_to_ts(F.col("start_ms")), F.lit(" --> "),
        ms_to_ts(F.col("end_ms")), F.lit("\n"), F.col("text"), F.lit("\n")).alias("block"))


def write_srt(cues: DataFrame, path: str) -> None:
    """Subtitle files below ``path/media_id=...``; blocks keep their order within and across part files."""
    blocks = format_srt(cues)
    (blocks.repartitionByRange(MEDIA, "n").sortWithinPartitions(MEDIA, "n").select(MEDIA, "block")
     .write.mode("overwrite").partitionBy(MEDIA).text(path))


def nest_timeline(findings: DataFrame, headers: DataFrame | None = None, page: int = PAGE) -> DataFrame:
    """One timeline document per film in start order, with the next free id.

    A film beyond ``page`` findings continues in further pages, each a row of its own, so nothing is cut
    and no group is collected without a bound. ``headers`` (``media_id``, ``fingerprint``, ``next_segment_id``): the next
    id never falls below theirs, and a film of theirs without findings has an empty document.
    """
    # Equal starts are numbered by id: positions come from per-start counts plus a rank inside the start.
    starts = row_rank_of_starts(findings)
    spec = Window.partitionBy(MEDIA, "start_ms", "__slot").orderBy("id")
    slot = idiv(F.col("id"), page)
    slots = findings.groupBy(MEDIA, "start_ms", slot.alias("__slot")).agg(F.count(F.lit(1)).alias("n"))
    before_slot = slots.withColumn("__before", F.coalesce(F.sum("n").over(
        Window.partitionBy(MEDIA, "start_ms").orderBy("__slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    placed = (findings.withColumn("__slot", slot).join(starts, [MEDIA, "start_ms"])
              .join(before_slot.drop("n"), [MEDIA, "start_ms", "__slot"])
              .withColumn("__pos", F.col("__start") + F.col("__before") + F.row_number().over(spec) - 1))
    segment = F.struct(
        F.col("id"), F.col("start_ms").alias("startMs"), F.col("end_ms").alias("endMs"), "category", "confidence",
        "engine", F.col("action").alias("recommendedAction"), "approved", "reasoning",
        F.col("engine_ref").alias("engineRef"))
    pages = placed.groupBy(MEDIA, idiv(F.col("__pos"), page).alias("page")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("__pos", segment.alias("s")))), lambda x: x["s"]).alias("segments"))
    top = findings.groupBy(MEDIA).agg((F.max("id") + 1).alias("next_segment_id"))
    out = pages.join(top, MEDIA)
    if headers is not None:
        mark = F.max("next_segment_id") if "next_segment_id" in headers.columns else F.lit(None).cast("bigint")
        known = headers.groupBy(MEDIA).agg(F.max("fingerprint").alias("fingerprint"), mark.alias("__mark"))
        return out.join(known, MEDIA, "full").select(
            MEDIA, F.coalesce("page", F.lit(0)).cast(out.schema["page"].dataType).alias("page"),
            F.coalesce("segments", F.array().cast(out.schema["segments"].dataType)).alias("segments"),
            F.greatest(F.coalesce("next_segment_id", F.lit(1)), F.coalesce("__mark", F.lit(0))).alias("next_segment_id"), "fingerprint")
    return out.withColumn("fingerprint", F.lit(None).cast("string"))


def row_rank_of_starts(findings: DataFrame) -> DataFrame:
    """Findings before each distinct start of a media."""
    counts = findings.groupBy(MEDIA, "start_ms").agg(F.count(F.lit(1)).alias("n"))
    return running(counts, [MEDIA], ["start_ms"], time_blocks(), __start=Running("sum", F.col("n"))).drop("n")


def timeline_json(nested: DataFrame) -> DataFrame:
    """Nested timelines as JSON text."""
    return nested.select(MEDIA, "page", F.to_json(F.struct(
        F.lit(1).alias("schemaVersion"), F.col("fingerprint").alias("mediaFingerprint"),
        F.col("next_segment_id").alias("nextSegmentId"), "segments"),
        {"ignoreNullFields": "false"}).alias("json"))


def write_timelines(findings: DataFrame, path: str, headers: DataFrame | None = None) -> None:
    timeline_json(nest_timeline(findings, headers)).write.mode("overwrite").parquet(path)


class BucketedTable:
    """A keyed table in hash buckets, of which a change rewrites those that hold its keys.

    Files of a change go to a new folder; a manifest then names the folder of each bucket, and readers follow the newest manifest. A change
    that fails before it leaves the earlier version as it was, and one that loses a race to another fails. Each bucket lies whole in one
    folder, so nothing needs compacting. ``buckets`` stays as the first change set it; a bucket should fit in a task.
    Folders that no manifest names any more are left to the retention policy. No column may be called ``bucket``.
    """

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], order: Sequence[str], buckets: int = 64):
        self.spark, self.path, self.keys, self.order, self.buckets = spark, path, list(keys), list(order), buckets

    def _manifest(self) -> tuple[int, dict[int, str]]:
        """Newest version (0: none) and the folder of each bucket: as many rows as there are buckets."""
        try:
            all_of_them = self.spark.read.schema("buckets int, bucket int, folder string, version long").json(f"{self.path}/manifest")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return 0, {}
        version = all_of_them.agg(F.max("version")).first()[0] or 0
        rows = all_of_them.where(F.col("version") == version).collect()
        if any(r.buckets != self.buckets for r in rows):
            raise ValueError(f"the table has {rows[0].buckets} buckets, not {self.buckets}")
        return version, {r.bucket: r.folder for r in rows}

    def _read(self, held: dict[int, str]) -> DataFrame | None:
        paths = [f"{self.path}/data/{folder}/bucket={b}" for b, folder in sorted(held.items())]
        return self.spark.read.parquet(*paths) if paths else None

    def read(self) -> DataFrame | None:
        """The newest version; None before the first row."""
        return self._read(self._manifest()[1])

    def upsert(self, changes: DataFrame) -> list[int]:
        """Take in new rows: per key the last by ``order`` stays, a change before an earlier row of equal order. Buckets rewritten."""
        if "bucket" in (c.lower() for c in changes.columns):
            raise ValueError("a column is called bucket")
        version, held = self._manifest()
        changes = stage(changes)
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        touched = sorted(r[0] for r in changes.select(bucket).distinct().collect())  # at most as many as buckets
        if not touched:
            return touched
        rows = changes.withColumn("__new", F.lit(True))
        earlier = self._read({b: held[b] for b in touched if b in held})
        if earlier is not None:
            rows = rows.unionByName(earlier.withColumn("__new", F.lit(False)))
        merged = upsert_latest(rows, self.keys, [*self.order, "__new"]).drop("__new").withColumn("bucket", bucket)
        folder = uuid.uuid4().hex
        merged.repartition(len(touched), "bucket").write.partitionBy("bucket").parquet(f"{self.path}/data/{folder}")
        named = [(self.buckets, b, f) for b, f in sorted((held | dict.fromkeys(touched, folder)).items())]
        manifest = self.spark.createDataFrame(named, "buckets int, bucket int, folder string")
        manifest.coalesce(1).write.json(f"{self.path}/manifest/version={version + 1}")
        return touched
