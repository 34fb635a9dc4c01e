"""Listings walked by executors, tables in hash buckets and the jobs that a library page shows."""

import os
from datetime import datetime

import pytest
from conftest import rows
from pyspark.sql import functions as F

from spanweave.operators import jobs as jb
from spanweave.sources.readers import list_files
from spanweave.sources.sinks import BucketedTable


def test_folders_are_walked(spark, tmp_path):
    one, two = tmp_path / "one", tmp_path / "two"
    deep = one / "a" / "b" / "c"
    deep.mkdir(parents=True)
    (one / ".trash" / "x").mkdir(parents=True)
    (two / "empty").mkdir(parents=True)
    for path, text in ((one / "Film.mkv", "12345"), (deep / "odd %20 name.mkv", ""), (deep / "x.srt", "1"), (one / ".hidden.mkv", "1"), (one / ".trash" / "x" / "y.mkv", "1"),
                       (two / "Film.mkv", "1")):
        path.write_text(text)
    (one / "a" / "again").symlink_to(one)  # followed, it would never end
    (two / "lost.mkv").symlink_to(tmp_path / "nowhere")
    os.utime(one / "Film.mkv", (86_400, 86_400))
    roots = [str(one), f"file://{two}", str(tmp_path / "missing")]
    listed = list_files(spark, roots)
    want = [(0, f"file:{one}/Film.mkv", 5), (0, f"file:{deep}/odd %20 name.mkv", 0), (0, f"file:{deep}/x.srt", 1), (1, f"file:{two}/Film.mkv", 1), (1, f"file:{two}/lost.mkv", None)]
    assert rows(listed, "root_idx", "path", "length") == sorted(want, key=lambda r: r[:2])
    assert listed.where(F.col("path").endswith("one/Film.mkv")).select("modificationTime").first()[0] == datetime.fromtimestamp(86_400)
    assert list_files(spark, roots, "*.mkv").count() == 4 and list_files(spark, roots, "*.mkv", hidden=True).count() == 6
    assert list_files(spark, roots[2:]).count() == list_files(spark, []).count() == 0


def test_folder_with_many_files(spark, tmp_path):
    for i in range(300):
        folder = tmp_path / f"f{i % 7}"
        folder.mkdir(exist_ok=True)
        (folder / f"{i}.mkv").touch()
    assert list_files(spark, [str(tmp_path), str(tmp_path)]).select("root_idx", "path").distinct().count() == 600


def test_a_change_rewrites_its_bucket(spark, tmp_path):
    table = BucketedTable(spark, str(tmp_path / "t"), ["id"], ["seq"], 8)
    assert table.read() is None and table.upsert(spark.range(0).withColumn("seq", F.lit(0))) == [] and table.read() is None
    first = spark.range(1000).select("id", F.lit("old").alias("status"), F.lit(1).alias("seq"))
    assert table.upsert(first) == list(range(8))
    before = {f for f in (tmp_path / "t" / "data").rglob("*.parquet")}
    earlier = table.read()
    change = spark.createDataFrame([(7, "late", 0), (7, "same", 1)], "id long, status string, seq int")
    assert len(table.upsert(change)) == 1  # a row of equal order replaces the stored one, an older one does not
    written = {f for f in (tmp_path / "t" / "data").rglob("*.parquet")} - before
    assert len({f.parent for f in written}) == 1 and sum(spark.read.parquet(str(f)).count() for f in written) < 300
    assert rows(table.read()) == [(i, "same" if i == 7 else "old", 1) for i in range(1000)] and earlier.count() == 1000
    assert rows(table.read().where("id = 7")) == [(7, "same", 1)]
    table.upsert(spark.createDataFrame([(None, "none", 1), (None, "none", 2), (5000, "new", 1)], "id long, status string, seq int"))
    assert rows(table.read().where("id IS NULL OR id > 999")) == [(None, "none", 2), (5000, "new", 1)]


def test_a_failed_change_leaves_the_table(spark, tmp_path):
    table = BucketedTable(spark, str(tmp_path / "t"), ["id"], ["seq"], 4)
    table.upsert(spark.range(20).withColumn("seq", F.lit(0)))
    with pytest.raises(Exception, match="broken"):
        table.upsert(spark.range(20).withColumn("seq", F.when(F.col("id") == 3, F.raise_error(F.lit("broken"))).otherwise(1)))
    assert rows(table.read()) == [(i, 0) for i in range(20)]
    with pytest.raises(ValueError, match="4 buckets"):
        BucketedTable(spark, str(tmp_path / "t"), ["id"], ["seq"], 5).read()
    with pytest.raises(ValueError, match="called bucket"):
        table.upsert(spark.range(1).withColumn("Bucket", F.lit(0)))


def test_status_shows_the_headline_and_all_in_flight(spark):
    at = [datetime(2024, 1, 1, h) for h in range(6)]
    jobs = spark.createDataFrame(
        [("a", "/x/Film.mkv", "vlm", "queued", at[5], 0.0, None, None), ("b", "/y/film.mkv", "whisper", "running", at[1], 0.5, "listen", None),
         ("c", "/x/film.mkv", "subtitles", "queued", at[4], 0.0, None, None), ("d", "/x/film.mkv", "render", "rendering", at[0], 0.1, "cut", None),
         ("e", "/x/film.mkv", "pureframe", "running", at[1], 0.2, "look", None), ("f", "/x/other.mkv", "vlm", "failed", at[2], 0.9, "end", "no disk"),
         ("g", "/x/other.mkv", "vlm", "completed", at[1], 1.0, "end", None)],
        "id string, media_path string, engine string, status string, created_at timestamp, progress double, stage string, error string")
    asked = spark.createDataFrame([(0, "p"), (1, "q"), (2, "p"), (3, "r")], "pos long, path string")
    resolved = spark.createDataFrame([("p", "/lib/FILM.mkv"), ("q", "/lib/Other.mkv"), ("r", None)], "path string, resolved_path string")
    counts = spark.createDataFrame([], "name string, total long, approved long, rejected long, pending long")
    status = jb.status_for_paths(asked, resolved, jobs, counts, counts.select("name"))
    assert rows(status, "pos", "job_id", "job_status", "job_progress", "job_stage", "job_error", "job_engine", "active") == [
        (0, "b", "running", 0.5, "listen", None, "whisper", 5), (1, "f", "failed", 0.9, "end", "no disk", "vlm", 0),
        (2, "b", "running", 0.5, "listen", None, "whisper", 5), (3, None, None, None, None, None, None, 0)]
    flying = jb.active_for_paths(asked, resolved, jobs)
    assert rows(flying, "pos", "place", "id") == [(p, i + 1, j) for p in (0, 2) for i, j in enumerate("bedac")]
    assert jb.active_for_paths(asked, resolved, jobs.where("false")).count() == 0
    bare = jb.status_for_paths(asked, resolved, jobs.drop("stage", "error"), counts, counts.select("name"))
    assert rows(bare.where("pos = 0"), "job_stage", "job_error") == [(None, None)]
