"""Subtitles, transcripts, timelines, detection plans, shot lists and file listings."""

from __future__ import annotations

import fnmatch
import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import pyarrow.json as pj
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from spanweave.functions.text import SPACE, clean_cue_text, mojibake, repair_mojibake
from spanweave.functions.timefmt import ts_to_ms
from spanweave.schema import PLAN_JSON, SHOTS_JSON, TIMELINE_JSON, TRANSCRIPT_JSON
from spanweave.session import scratch_path, stage

MEDIA = "media_id"
#: Whatever ends a line in text.
LINE_END = r"[\n\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"


def read_documents(spark: SparkSession, path: str, suffix: str = "") -> DataFrame:
    """Whole text files as (path, text), one film's file per row."""
    reader = spark.read.option("recursiveFileLookup", True)
    if suffix:
        reader = reader.option("pathGlobFilter", f"*{suffix}")
    return reader.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def parse_srt(documents: DataFrame, key: str = MEDIA, strip_sound_cues: bool = True) -> DataFrame:
    """Subtitle text (``text``) to cue rows."""
    text = F.regexp_replace(repair_mojibake(F.col("text")), r"\r\n?", "\n")
    return _cues(documents.select(key, F.posexplode(F.split(text, rf"\n{SPACE}*\n")).alias("block_idx", "block")), key, strip_sound_cues)


def _cues(blocks: DataFrame, key: str, strip_sound_cues: bool) -> DataFrame:
    """Cue rows of numbered blocks."""
    lines = F.filter(F.split("block", LINE_END), lambda x: ~x.rlike(rf"\A{SPACE}*\z"))
    stamped = blocks.select(key, "block_idx", lines.alias("lines")).where(
        (F.size("lines") >= 2) & F.get("lines", F.lit(1)).contains("-->"))
    times = F.split(F.get("lines", F.lit(1)), "-->")
    spoken = F.array_join(F.slice("lines", F.lit(3), F.greatest(F.size("lines") - 2, F.lit(0))), " ")
    cues = stamped.select(
        key, "block_idx", ts_to_ms(F.get(times, F.lit(0))).alias("start_ms"),
        ts_to_ms(F.get(times, F.lit(1))).alias("end_ms"), clean_cue_text(spoken, strip_sound_cues).alias("text"))
    return cues.where("text <> ''").select(
        key, F.col("block_idx").cast("bigint").alias("cue_idx"), "start_ms", "end_ms", "text")


def read_srt(spark: SparkSession, path: str, suffix: str = ".srt", strip_sound_cues: bool = True) -> DataFrame:
    """Subtitle files of any length to cue rows: ``path`` and the columns of ``parse_srt``, equal to what it gives for each file.

    A file is read by as many tasks as it has splits, line by line. A block begins at a line with text behind a blank one; its number is
    a running count over the lines of the file. A task joins the lines of its blocks as they come, in chunks of a batch; a table with a row per
    chunk tells where its numbers start, and only the first and last block of a chunk are shuffled, to meet their other pieces.
    Bytes that are no UTF-8 become replacement characters, as a lenient decoder makes them. Garbled text is repaired if the whole file
    allows it, as ``repair_mojibake`` does with a text. A byte order mark at the top is dropped. Empty files have no cues.
    Only a block is gathered into one row. The chunks and their blocks are staged, so that every reader sees the same splits.
    """
    reader = spark.read.option("recursiveFileLookup", True)
    if suffix:
        reader = reader.option("pathGlobFilter", f"*{suffix}")
    lines = reader.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("split"),
                                     F.make_valid_utf8("value").alias("line"))
    garbled, encodable, decoded = mojibake(F.col("line"))
    fit = F.bool_and(encodable & F.coalesce(F.is_valid_utf8(decoded), F.lit(False)))
    suspects = lines.where(garbled).select("path").distinct()
    repairable = stage(lines.join(F.broadcast(stage(suspects)), "path", "left_semi").groupBy("path").agg(fit.alias("all")).where("all").select(
        "path", F.lit(True).alias("repair")))
    lines = lines.join(F.broadcast(repairable), "path", "left").withColumn("line", F.when(F.col("repair"), decoded).otherwise(F.col("line")))
    read = stage(lines.select("path", "split", F.col("line").rlike(rf"\A{SPACE}*\z").alias("blank"), "line").transform(_chunks_of))

    along = Window.partitionBy("path").orderBy("split", "chunk")
    earlier = along.rowsBetween(Window.unboundedPreceding, -1)
    chunks = read.where("line IS NULL").withColumns({
        "after": F.coalesce(F.lag("last_blank").over(along), F.lit(False)), "n": F.coalesce(F.sum("lines").over(earlier), F.lit(0))})
    # A single blank line at the top has no line end in front of it, so it begins no block.
    chunks = chunks.withColumn("own", (~F.col("first_blank") & F.col("after") & (F.col("n") >= 2)).cast("bigint"))
    chunks = stage(chunks.select("chunk", "path", "split", (F.coalesce(F.sum(F.col("begins") + F.col("own")).over(earlier), F.lit(0)) + F.col("own")).alias("first")))
    pieces = read.where("line IS NOT NULL").select("chunk", "block", "edge", "line").join(chunks, "chunk").select(
        "path", (F.col("first") + F.col("block")).alias("block_idx"), "edge", "split", "chunk", "line")
    held = F.array_sort(F.collect_list(F.struct("split", "chunk", "line")))
    edges = pieces.where("edge").groupBy("path", "block_idx").agg(F.array_join(F.transform(held, lambda x: x["line"]), "\n").alias("block"))
    whole = pieces.where("NOT edge").select("path", "block_idx", F.col("line").alias("block"))
    return _cues(whole.unionByName(edges), "path", strip_sound_cues)


#: Rows of a task that reads lines: one per chunk, and one per piece of a block in it (``line`` is its text).
_CHUNK = ("chunk bigint, path string, split bigint, lines bigint, begins bigint, first_blank boolean, last_blank boolean, "
          "block bigint, edge boolean, line string")


def _chunks_of(lines: DataFrame) -> DataFrame:
    """Lines (``path``, ``split``, ``blank``, ``line``) in the order of the file to chunks and the pieces of their blocks.

    A chunk is what a batch holds of a split. Blocks are counted from 0 within it, as if its first line began none.
    """
    def run(batches):
        number, last = TaskContext.get().partitionId() << 32, None
        schema = pa.schema([("chunk", pa.int64()), ("path", pa.string()), ("split", pa.int64()), ("lines", pa.int64()), ("begins", pa.int64()),
                            ("first_blank", pa.bool_()), ("last_blank", pa.bool_()), ("block", pa.int64()), ("edge", pa.bool_()), ("line", pa.string())])
        for batch in batches:
            paths, splits = batch.column(0).dictionary_encode(), batch.column(1).to_numpy()
            files = paths.indices.to_numpy()
            cuts = np.flatnonzero((np.diff(files) != 0) | (np.diff(splits) != 0)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, batch.num_rows]):
                if lo == hi:
                    continue
                place = paths.dictionary[int(files[lo])].as_py(), int(splits[lo])
                blank = batch.column(2).slice(lo, hi - lo).to_numpy(zero_copy_only=False)
                begins = np.concatenate([[False], ~blank[1:] & blank[:-1]])
                if place != last and place[1] == 0:  # the top of the file
                    begins[1:2] = False
                last = place
                spoken = np.flatnonzero(~blank)
                block = np.cumsum(begins)[spoken]
                firsts = np.flatnonzero(np.diff(block, prepend=-1))
                texts = pa.LargeListArray.from_arrays(np.append(firsts, len(spoken)), batch.column(3).take(pa.array(lo + spoken)))
                count, blocks, n = int(begins.sum()), block[firsts], len(firsts)
                yield pa.RecordBatch.from_pylist([{"chunk": number, "path": place[0], "split": place[1], "lines": hi - lo, "begins": count,
                                                   "first_blank": bool(blank[0]), "last_blank": bool(blank[-1])}], schema)
                if n:
                    made = {"chunk": pa.array(np.full(n, number)), "block": pa.array(blocks), "edge": pa.array((blocks == 0) | (blocks == count)),
                            "line": pc.binary_join(texts, "\n")}
                    yield pa.RecordBatch.from_arrays([made.get(f.name, pa.nulls(n, f.type)) for f in schema], schema=schema)
                number += 1

    return lines.mapInArrow(run, _CHUNK)


#: Bytes of text in a part that is made for results which repeat it. A Parquet file holds a text once while its distinct
#: texts fit a dictionary of 1 MB, and from there on in every row that has it.
PART = 3 << 18


def in_small_parts(documents: DataFrame, column: str = "text", limit: int = PART) -> DataFrame:
    """The same rows, dealt evenly over parts of about ``limit`` bytes of ``column``, the longest first in each.

    For results that repeat a text in many rows, as the words of a transcript do with that of their segment: each part is written
    as a file whose texts fit its dictionary. Where they don't, as with a document of more than 1 MB, those that come last take their
    room in every row, so the longest documents come first. ``documents`` are read once more, when this is called, to add up their bytes.
    """
    size = documents.agg(F.sum(F.octet_length(column))).first()[0] or 0
    return documents.repartition(size // limit + 1).sortWithinPartitions(F.desc(F.octet_length(column)))


_WORDS = pa.list_(pa.struct([("start", pa.float64()), ("end", pa.float64()), ("word", pa.string()), ("probability", pa.float64())]))
_SEGMENTS = pa.list_(pa.struct([("start", pa.float64()), ("end", pa.float64()), ("text", pa.string()), ("words", _WORDS)]))
#: The fields of ``TRANSCRIPT_JSON``, in an object that numbers the document.
_NUMBERED = pa.schema([("at", pa.int64()), ("doc", pa.struct([("model", pa.string()), ("duration", pa.float64()), ("segments", _SEGMENTS)]))])
#: Bytes of JSON that are read at a time.
_PARSED = 4 << 20


def _segment_reader(key: str):
    """What ``parse_transcripts`` runs in a task."""
    names, limit = [key, "json", "seg_idx", "seg_text", "words"], _PARSED
    kinds = [pa.string(), pa.int64(), pa.string(), _WORDS]

    def segments_of(documents: list[bytes]) -> pa.ListArray | None:
        """The segments of JSON documents; none unless Arrow reads each as one object with fields of the types expected."""
        lines = b"".join(b'{"at":%d,"doc":%s}\n' % numbered for numbered in enumerate(documents))
        try:
            read = pj.read_json(pa.BufferReader(lines), pj.ReadOptions(use_threads=False, block_size=len(lines) + 1),
                                pj.ParseOptions(explicit_schema=_NUMBERED, newlines_in_values=True, unexpected_field_behavior="ignore"))
        except pa.ArrowInvalid:
            return None
        if read["at"].to_pylist() != list(range(len(documents))):
            return None
        return read["doc"].combine_chunks().flatten()[2]

    def read(keys: pa.Array, texts: pa.Array, plain: pa.Array) -> Iterator[pa.RecordBatch]:
        segments = segments_of(texts.cast(pa.binary()).to_pylist()) if pc.all(plain).as_py() else None
        if segments is not None:
            counts = pc.fill_null(pc.list_value_length(segments), 0).to_numpy().astype(np.int64)
            owner = np.repeat(np.arange(len(counts)), counts)
            place = np.arange(len(owner)) - (np.cumsum(counts) - counts)[owner]
            _, _, text, words = segments.flatten().flatten()
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(owner)), pa.nulls(len(owner), pa.string()), pa.array(place), text, words], names=names)
        elif len(keys) > 1:
            half = len(keys) // 2
            yield from read(keys[:half], texts[:half], plain[:half])
            yield from read(keys[half:], texts[half:], plain[half:])
        else:
            yield pa.RecordBatch.from_arrays([keys, texts, *[pa.nulls(1, kind) for kind in kinds[1:]]], names=names)

    def run(batches):
        for batch in batches:
            few = max(1, min(batch.num_rows, batch.num_rows * limit // max(batch.nbytes, 1)))
            for at in range(0, batch.num_rows, few):
                yield from read(*batch.slice(at, few).columns)

    return run


def parse_transcripts(documents: DataFrame, key: str = MEDIA) -> DataFrame:
    """Transcript JSON (``json``) to one row per word with its segment's text.

    Documents are read some megabytes at a time by Arrow's reader. What that refuses, as fields of other types or JSON that is
    not strict, comes back as it was and goes through ``from_json``, which decides what can be read of it.
    """
    given = documents.where("json IS NOT NULL").select(key, "json", F.is_valid_utf8("json").alias("plain"))
    schema = StructType([given.schema[key], *StructType.fromDDL(
        "json string, seg_idx bigint, seg_text string, words array<struct<start: double, `end`: double, word: string, probability: double>>")])
    read, refused = given.mapInArrow(_segment_reader(key), schema), F.col("json").isNotNull()
    both = read.select("*", F.posexplode_outer(F.when(refused, F.from_json("json", TRANSCRIPT_JSON)["segments"])).alias("i", "s"))
    segments = both.select(key, F.when(refused, F.col("i").cast("bigint")).otherwise(F.col("seg_idx")).alias("seg_idx"),
                           F.when(refused, F.col("s.text")).otherwise(F.col("seg_text")).alias("seg_text"),
                           F.when(refused, F.col("s.words")).otherwise(F.col("words")).alias("words"))
    words = segments.select(key, "seg_idx", "seg_text", F.posexplode("words").alias("word_idx", "w"))
    return words.select(key, "seg_idx", F.col("word_idx").cast("bigint").alias("word_idx"), F.col("w.start").alias("start_s"), F.col("w.end").alias("end_s"),
                        F.col("w.word").alias("word"), F.col("w.probability").alias("probability"), "seg_text")


def parse_timelines(documents: DataFrame, key: str = MEDIA) -> tuple[DataFrame, DataFrame]:
    """Timeline JSON to findings and one header row per media, however many pages it has; an absent next id reads as 0."""
    doc = documents.select(key, F.from_json("json", TIMELINE_JSON).alias("d"))
    findings = doc.select(key, F.explode("d.segments").alias("s")).select(
        key, "s.id", F.col("s.startMs").alias("start_ms"), F.col("s.endMs").alias("end_ms"), "s.category",
        "s.confidence", "s.engine", F.coalesce("s.recommendedAction", F.lit("blur")).alias("action"), "s.approved",
        "s.reasoning", F.col("s.engineRef").alias("engine_ref"))
    headers = doc.groupBy(key).agg(F.max("d.mediaFingerprint").alias("fingerprint"),
                                   F.max(F.coalesce("d.nextSegmentId", F.lit(0))).alias("next_segment_id"))
    return findings, headers


def parse_plans(documents: DataFrame, key: str = MEDIA) -> tuple[DataFrame, DataFrame]:
    """Detection-plan JSON to shots (in seconds and ms) and verdicts in order."""
    doc = documents.select(key, F.from_json("json", PLAN_JSON).alias("d"))
    shots = doc.select(key, F.inline("d.shots")).select(
        key, F.col("index").alias("shot_index"), "start_frame", "end_frame",
        (F.col("start_time") * 1000).cast("bigint").alias("start_ms"),
        (F.col("end_time") * 1000).cast("bigint").alias("end_ms"))
    verdicts = doc.select(key, F.posexplode("d.verdicts").alias("seq", "v")).select(
        key, F.col("seq").cast("bigint").alias("seq"), "v.shot_index", "v.action", "v.category", "v.confidence",
        "v.reasoning", "v.boxes")
    return shots, verdicts


def parse_shots(documents: DataFrame, key: str = MEDIA) -> DataFrame:
    """Shot-list JSON to shot rows."""
    return documents.select(key, F.inline(F.from_json("json", SHOTS_JSON))).withColumnRenamed("index", "shot_index")


#: Bytes of each of the three pieces of a file that its fingerprint is made of.
FINGERPRINT_CHUNK = 8 * 1024 * 1024


def _opened(path: str) -> tuple[pa.fs.FileSystem, str]:
    """The store of a path and the path in it. Names are taken as they are, so only the store itself is read as a URI."""
    scheme, _, rest = path.partition(":")
    if path.startswith("/") or scheme == "file":  # as Spark writes it, with one slash
        return pa.fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    host, _, name = rest.removeprefix("//").partition("/")
    store, base = pa.fs.FileSystem.from_uri(f"{scheme}://{host}/")
    return store, f"{base.rstrip('/')}/{name}"


def fingerprint_files(files: DataFrame, chunk: int = FINGERPRINT_CHUNK) -> DataFrame:
    """``path``, ``fingerprint`` of films by their ``path`` and ``length``: head, middle and tail are read in place.

    At most three times ``chunk`` bytes of a file are read, by position, in the task that has its row, however long it is; the result
    equals ``functions.text.quick_fingerprint`` of its content. Paths are as ``list_files`` gives them,
    in any store that Arrow opens, or plain ones.
    A file that is gone or can't be read has no fingerprint.
    """
    def fingerprint(path: str, length: int) -> str | None:
        try:
            store, at = _opened(path)
            digest = hashlib.sha256(str(length).encode())
            with store.open_input_file(at) as file:
                for offset in (0, length // 2 - chunk // 2, length - chunk):
                    digest.update(file.read_at(min(chunk, length), max(0, offset)))
            return f"quickhash:{digest.hexdigest()}"
        except (OSError, pa.ArrowInvalid):
            return None

    def run(batches):
        for batch in batches:
            paths, lengths = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("path", "length"))
            found = [None if p is None or n is None else fingerprint(p, n) for p, n in zip(paths, lengths)]
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(found, pa.string())], names=["path", "fingerprint"])

    known = files.select(F.col("path").cast("string").alias("path"), F.col("length").cast("bigint").alias("length"))
    return known.mapInArrow(run, "path string, fingerprint string")


def _listed_by_spark(spark: SparkSession, roots: list[str], glob: str | None) -> DataFrame:
    parts = []
    for i, root in enumerate(roots):
        reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
        if glob:
            reader = reader.option("pathGlobFilter", glob)
        parts.append(reader.load(root).select(F.lit(i).alias("root_idx"), "path", "length", "modificationTime"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _entries(folder: str) -> Iterator[tuple[str, bool, int | None, int | None]]:
    """Name, whether it is a folder, bytes and microseconds of change of what lies in a folder; links to folders are left out."""
    store, at = _opened(folder)
    if not isinstance(store, pa.fs.LocalFileSystem):
        for info in store.get_file_info(pa.fs.FileSelector(at)):
            changed = None if info.mtime_ns is None else info.mtime_ns // 1000
            yield info.base_name, info.type == pa.fs.FileType.Directory, info.size, changed
        return
    with os.scandir(at) as found:
        for entry in found:
            is_dir = entry.is_dir()
            if is_dir and entry.is_symlink():
                continue
            try:
                known = entry.stat()
            except OSError:  # a link to nothing is a file of unknown length
                known = None
            name = entry.name.encode(errors="surrogateescape").decode(errors="replace")
            yield name, is_dir, known and known.st_size, known and known.st_mtime_ns // 1000


#: Entries in one batch of a listing.
LISTED = 10_000
_ENTRY = "root_idx int, path string, length long, modificationTime timestamp, is_dir boolean"


def list_files(spark: SparkSession, roots: list[str], glob: str | None = None, hidden: bool = False) -> DataFrame:
    """Files below ordered roots, from listing metadata alone (contents are never read).

    Result: ``root_idx``, ``path``, ``length``, ``modificationTime``. Executors walk the folders level by level: the folders of a level are
    dealt over them and what lies in those is written to the shared folder, so the driver holds no listing and a lost executor costs the
    folders it had. One task lists one folder, in batches. A folder or root that is missing or can't be read has no
    files; links to folders are not followed; empty files count. Names that begin with a dot or underscore are left out,
    with all below them, unless ``hidden``. ``glob``: a pattern of ``*``, ``?`` and ``[]`` for names of files. Stores that Arrow
    doesn't open are listed by Spark, by its own rules.
    """
    default = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS")
    full = [f"file:{r}" if r.startswith("/") and default.startswith("file:") else default.rstrip("/") + r if r.startswith("/") else r for r in roots]
    try:
        tops = ["file:" + at if isinstance(store, pa.fs.LocalFileSystem) else r for r in full for store, at in [_opened(r)]]
    except (OSError, pa.ArrowInvalid, pa.ArrowNotImplementedError):
        return _listed_by_spark(spark, roots, glob)

    def batch_of(rows):
        root, path, length, changed, is_dir = zip(*rows)
        columns = [pa.array(root, pa.int32()), pa.array(path, pa.string()), pa.array(length, pa.int64()),
                   pa.array(changed, pa.timestamp("us", "UTC")), pa.array(is_dir, pa.bool_())]
        return pa.RecordBatch.from_arrays(columns, names=["root_idx", "path", "length", "modificationTime", "is_dir"])

    def run(batches):
        for batch in batches:
            for root, folder in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = []
                try:
                    for name, is_dir, length, changed in _entries(folder):
                        if (hidden or name[0] not in "._") and (is_dir or glob is None or fnmatch.fnmatchcase(name, glob)):
                            rows.append((root, f"{folder.rstrip('/')}/{name}", length, changed, is_dir))
                        if len(rows) == LISTED:
                            yield batch_of(rows)
                            rows = []
                except (OSError, pa.ArrowInvalid):
                    pass
                if rows:
                    yield batch_of(rows)

    base, levels = scratch_path(spark, "listing"), []
    folders = spark.createDataFrame(list(enumerate(tops)), "root_idx int, path string")
    while not folders.isEmpty():
        levels.append(f"{base}/level-{len(levels)}")
        dealt = folders.repartition(spark.sparkContext.defaultParallelism, "path")
        dealt.mapInArrow(run, _ENTRY).write.parquet(levels[-1])
        folders = spark.read.schema(_ENTRY).parquet(levels[-1]).where("is_dir").select("root_idx", "path")
    return spark.read.schema(_ENTRY).parquet(*levels).where("NOT is_dir").drop("is_dir")
