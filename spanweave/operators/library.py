"""Files, films and review reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanweave.functions.policy import lookup
from spanweave.functions.review import STATUS_ORDER, review_state
from spanweave.functions.text import (base_name_key, file_stem, file_suffix, finding_type, fuzzy_match,
                                      match_rank)

MEDIA = "media_id"
# Suffixes of films to analyse, and of films to list.
VIDEO_SUFFIXES = (".mkv", ".mp4", ".avi", ".m4v", ".webm", ".mov")
VIEW_SUFFIXES = (".mkv", ".mp4", ".m4v", ".avi", ".mov", ".ts", ".webm", ".wmv", ".mpg", ".mpeg")
# Subtitle files beside a film, most wanted first.
SUBTITLE_SUFFIXES = (".en.srt", ".eng.srt", ".srt")
#: Ending of the files that hold a film's timeline.
SIDECAR = ".timeline.json"


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def discover_media(files: DataFrame) -> DataFrame:
    """Distinct video paths; rendered copies are outputs and stay out."""
    name = file_name(F.col("path"))
    return files.where(file_suffix(name).isin(*VIDEO_SUFFIXES) & ~name.contains("(Clean)")).select("path").distinct()


def library_index(files: DataFrame, sidecar: str = SIDECAR) -> DataFrame:
    """Lower-cased file name to its first path over the ordered roots."""
    named = files.withColumn("name", F.lower(file_name(F.col("path"))))
    return named.where(~F.col("name").endswith(sidecar)).groupBy("name").agg(
        F.min(F.struct("root_idx", "path"))["path"].alias("path"))


def library_sidecars(files: DataFrame, sidecar: str = SIDECAR) -> DataFrame:
    """Lower-cased names of timeline files."""
    name = F.lower(file_name(F.col("path")))
    return files.select(name.alias("name")).where(F.col("name").endswith(sidecar)).distinct()


def preferred_sidecar_sub(media: DataFrame, files: DataFrame) -> DataFrame:
    """Per film path the first existing subtitle file beside it.

    A subtitle file may be any of three films' sidecar by its name, so each file is keyed by what remains
    of its path for every suffix it ends in, and joins films by equality.
    """
    lengths = [(i, s) for i, s in enumerate(SUBTITLE_SUFFIXES)]
    options = F.array_compact(F.array(*[
        F.when(F.col("path").endswith(s),
               F.struct(F.lit(i).alias("pref"), F.expr(f"left(path, length(path) - {len(s)})").alias("base")))
        for i, s in lengths]))
    subs = files.select("path", F.explode(options).alias("o")).select(
        F.col("path").alias("subtitle"), "o.pref", "o.base")
    films = media.select(F.col("path").alias("media_path")).distinct().withColumn(
        "base", F.regexp_replace("media_path", r"(?<=[^/])\.[^./]+\z", ""))
    return films.join(subs, "base").groupBy("media_path").agg(
        F.min(F.struct("pref", "subtitle"))["subtitle"].alias("subtitle"))


def resolve_path(requests: DataFrame, files: DataFrame) -> DataFrame:
    """Caller's path to a known one: itself, else by base name in the index, else null."""
    paths = requests.select("path").distinct().withColumn("name", base_name_key(F.col("path")))
    exact = files.select("path").distinct().withColumn("known", F.lit(True))
    index = library_index(files).withColumnRenamed("path", "indexed")
    return paths.join(exact, "path", "left").join(index, "name", "left").select(
        "path", F.when(F.col("known"), F.col("path")).otherwise(F.col("indexed")).alias("resolved_path"))


def _prefixes(name: Column, seps: str) -> Column:
    """Every leading part of a name that ends before one of the separators."""
    places = F.sequence(F.lit(1), F.length(name))
    cut = F.filter(places, lambda i: F.substring(name, i, F.lit(1)).isin(*seps))
    return F.transform(cut, lambda i: F.substring(name, F.lit(1), i - 1))


def _owner(files: DataFrame, stems: DataFrame, seps: str, whole: bool) -> DataFrame:
    low = F.lower("name")
    heads = _prefixes(low, seps)
    if whole:
        heads = F.array_append(heads, low)
    known = stems.groupBy(F.lower("stem").alias("head")).agg(F.min("stem").alias("stem"))
    tried = files.select("file_id", F.explode(F.array_distinct(heads)).alias("head"))
    best = tried.join(known, "head").groupBy("file_id").agg(
        F.max(F.struct(F.length("head").alias("n"), "stem"))["stem"].alias("owner"))
    return files.join(best, "file_id", "left")


def assign_owner(files: DataFrame, stems: DataFrame) -> DataFrame:
    """The longest film stem a file's name begins with, followed by a dot, or equals; null for orphans."""
    return _owner(files, stems, ".", True)


def assign_cleaned(files: DataFrame, stems: DataFrame) -> DataFrame:
    """Rendered copies and every stem they begin with, followed by a space or a dot."""
    known = stems.groupBy(F.lower("stem").alias("head")).agg(F.min("stem").alias("stem"))
    tried = files.select("file_id", "name", F.explode(F.array_distinct(_prefixes(F.lower("name"), " ."))).alias("head"))
    return tried.join(known, "head").select("file_id", "name", "stem")


def orphans_top20(files: DataFrame, stems: DataFrame, n: int = 20) -> tuple[DataFrame, DataFrame]:
    """The first orphans by name, and how many more there are."""
    lost = assign_owner(files, stems).where("owner is null").select("file_id", "name")
    rest = lost.agg(F.greatest(F.count(F.lit(1)) - n, F.lit(0)).alias("more"))
    return lost.orderBy("name", "file_id").limit(n), rest


def review_counts(findings: DataFrame, *by: str) -> DataFrame:
    keys = by or (MEDIA,)
    return findings.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("approved").eqNullSafe(F.lit(True))).alias("approved"),
        F.count_if(F.col("approved").eqNullSafe(F.lit(False))).alias("rejected"),
        F.count_if(F.col("approved").isNull()).alias("pending"))


def review_progress(findings: DataFrame) -> DataFrame:
    """Cut, left and undecided findings per film, with percentages."""
    counts = review_counts(findings)
    share = {f"{n}_pct": F.col(c) * 100 / F.greatest("total", F.lit(1))
             for n, c in (("cut", "approved"), ("leave", "rejected"), ("undecided", "pending"))}
    return counts.select(MEDIA, F.col("approved").alias("cut"), F.col("rejected").alias("leave"),
                         F.col("pending").alias("undecided"), *[c.alias(n) for n, c in share.items()])


def type_counts(findings: DataFrame) -> DataFrame:
    """Findings per display type, most frequent first."""
    kind = finding_type(F.col("reasoning"), F.col("category"))
    return findings.groupBy(MEDIA, kind.alias("type")).agg(F.count(F.lit(1)).alias("n")).orderBy(
        MEDIA, F.col("n").desc(), "type")


ACTIONS = ("blur", "mute", "skip", "voice")


def action_counts(findings: DataFrame) -> DataFrame:
    """Findings per recommended action, one column each; the fixed list keeps it one pass."""
    return findings.groupBy(MEDIA).agg(*[
        F.count_if(F.col("action") == a).alias(f"n_{a}") for a in ACTIONS])


def films(files: DataFrame, sidecar: str = SIDECAR) -> DataFrame:
    """Films of the library index, with collection and whether a timeline lies beside them."""
    index = library_index(files, sidecar).where(
        file_suffix(F.col("name")).isin(*VIEW_SUFFIXES) & ~F.col("name").contains("(clean)"))
    marks = library_sidecars(files, sidecar).select(
        F.expr(f"left(name, length(name) - {len(sidecar)})").alias("stem_key")).withColumn("analyzed", F.lit(True))
    return (index.withColumn("stem_key", file_stem(F.col("name"))).join(marks, "stem_key", "left")
            .select("path", "name", F.coalesce("analyzed", F.lit(False)).alias("analyzed"),
                    file_stem(file_name(F.col("path"))).alias("stem"),
                    F.coalesce(F.get(F.split("path", "/"), F.size(F.split("path", "/")) - 2), F.lit("")).alias("collection")))


def film_summary(film_rows: DataFrame, counts: DataFrame) -> DataFrame:
    """Findings, undecided ones and review state per film. ``counts``: (path, total, pending)."""
    zero = F.lit(0).cast("bigint")
    joined = film_rows.join(counts.select("path", "total", "pending"), "path", "left")
    found = joined.withColumns({
        "finding_count": F.when(F.col("analyzed"), F.coalesce("total", zero)).otherwise(zero),
        "undecided_count": F.when(F.col("analyzed"), F.coalesce("pending", zero)).otherwise(zero)})
    return found.select("path", "name", "stem", "collection", "analyzed", "finding_count", "undecided_count",
                        review_state(F.col("analyzed"), F.col("finding_count"), F.col("undecided_count")).alias("status"))


def library_matches(summary: DataFrame, query: str = "") -> tuple[DataFrame, list[Column]]:
    """Films a query finds (the analysed ones without a query) and the order they show in."""
    q = query.strip().lower()
    stem = F.lower("stem")
    if q:
        return summary.where(fuzzy_match(q, F.col("name"))), [match_rank(q, stem), stem, F.col("path")]
    return summary.where("analyzed"), [
        lookup(STATUS_ORDER, F.col("status"), 9), F.col("undecided_count").desc(), stem, F.col("path")]


def library_view(summary: DataFrame, query: str = "", limit: int = 50, offset: int = 0) -> tuple[DataFrame, DataFrame]:
    """A page of the work-list or of search results, and the total number of matches."""
    found, order = library_matches(summary, query)
    page = found.orderBy(*order).offset(max(0, offset)).limit(max(1, min(200, limit)))
    return page, found.agg(F.count(F.lit(1)).alias("total"))
