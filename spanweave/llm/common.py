"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import os
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: ASCII white space, as ``[\x20\x09-\x0D]``: what separates words everywhere in this package. ``bytes.split``
#: without an argument splits on exactly these six.
SPACES = " \t\n\x0b\x0c\r"


def scripts_of(df: DataFrame, *more: str) -> DataFrame:
    """``media_id``, ``text`` and the named columns alone, so that no other column of the input can clash."""
    return df.select("media_id", F.col("text").cast("string").alias("text"), *more)


def filled_text(df: DataFrame) -> DataFrame:
    """A null text counts as an empty one."""
    return df.withColumn("text", F.coalesce("text", F.lit("")))


def importable(df: DataFrame) -> DataFrame:
    """``df``, once Python workers can import this package: from where the driver has it, if they see that folder.

    A cluster that installs the package or ships it with ``--py-files`` needs no such help and is not harmed.
    """
    environment = df.sparkSession.sparkContext.environment
    root = str(Path(__file__).resolve().parents[2])
    paths = environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])
    return df


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
                *fields: StructField, keep: tuple[str, ...] = ("media_id",)) -> DataFrame:
    """``mapInArrow`` whose result has the kept input columns, typed as they come, and the new fields.

    ``fn`` gets batches of some megabytes, however many rows or bytes Spark sends at a time.
    """
    schema = StructType([*[StructField(c, df.schema[c].dataType) for c in keep], *fields])
    return importable(df).mapInArrow(lambda batches: fn(portions(batches)), schema)


def portions(batches: Iterator[pa.RecordBatch], limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in slices of about ``limit`` bytes; a larger row is a slice of its own."""
    for batch in batches:
        rows = max(1, min(batch.num_rows, batch.num_rows * limit // max(batch.nbytes, 1)))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def give_back() -> None:
    """Return what a worker has freed to the system, so that it stands idle beside the next stage with little."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim is not None:
        trim(0)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    return [t or "" for t in batch.column(batch.schema.get_field_index(column)).to_pylist()]


def column_of(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def row_key() -> Column:
    """Tells rows apart that share a media id: a digest of the text beside the id."""
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
