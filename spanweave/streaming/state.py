"""Versioned keyed state for ``foreachBatch``, kept as files in the shared folder."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: A full snapshot is written every so many epochs, so that reading state never touches more files.
SNAPSHOT_EVERY = 50


class KeyedLog:
    """Latest row per key after each epoch.

    An epoch writes its changed keys to a folder of its own, overwriting what a failed attempt left, so a
    retried batch gives the same state. Epoch numbers alone say which folders to read; nothing is listed.
    """

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], every: int = SNAPSHOT_EVERY):
        self.spark, self.path, self.keys, self.every = spark, path, list(keys), every

    def _folder(self, epoch: int) -> str:
        return f"{self.path}/epoch={epoch}"

    def before(self, epoch: int) -> DataFrame | None:
        """State the epoch starts from; None for the first."""
        if epoch == 0:
            return None
        base = (epoch - 1) // self.every * self.every
        parts = [self.spark.read.parquet(self._folder(e)).withColumn("__epoch", F.lit(e)) for e in range(base, epoch)]
        rows = parts[0]
        for part in parts[1:]:
            rows = rows.unionByName(part)
        if len(parts) == 1:
            return rows.drop("__epoch")
        # Keys are whole within an epoch, so a key's rows come from its latest epoch.
        last = rows.groupBy(*self.keys).agg(F.max("__epoch").alias("__epoch"))
        return rows.join(last, [*self.keys, "__epoch"], "left_semi").drop("__epoch")

    def at(self, epoch: int) -> DataFrame:
        """What an epoch has written."""
        return self.spark.read.parquet(self._folder(epoch))

    def latest(self) -> DataFrame:
        """The newest rows of each key over all epochs, for a reader that does not know the last one."""
        rows = self.spark.read.parquet(self.path)
        return rows.join(rows.groupBy(*self.keys).agg(F.max("epoch").alias("epoch")), [*self.keys, "epoch"], "left_semi").drop("epoch")

    def write(self, epoch: int, changed: DataFrame) -> None:
        rows = changed
        earlier = self.before(epoch) if epoch % self.every == 0 else None
        if earlier is not None:
            rows = changed.unionByName(earlier.join(changed.select(*self.keys).distinct(), self.keys, "left_anti"))
        rows.write.mode("overwrite").parquet(self._folder(epoch))


class TieredRuns:
    """A growing table whose parts ``merge`` makes fewer rows of, kept as runs of epochs.

    ``merge`` is associative: merging merged parts gives what merging all rows does. An epoch writes one run; when ``fan`` runs
    of a tier are there they become one of the next, so a row is rewritten once per tier and a reader meets fewer than ``fan`` runs
    of each. A run's name is the epochs it holds, so a retried epoch writes the same runs again and the last epoch tells which count.
    """

    def __init__(self, spark: SparkSession, path: str, merge: Callable[[DataFrame], DataFrame],
                 finish: Callable[[DataFrame], DataFrame] | None = None, fan: int = 16):
        self.spark, self.path, self.merge, self.finish, self.fan = spark, path, merge, finish or merge, fan

    def _folder(self, tier: int, run: int) -> str:
        return f"{self.path}/tier={tier}/run={run}"

    def write(self, epoch: int, rows: DataFrame) -> None:
        self.merge(rows).write.mode("overwrite").parquet(self._folder(0, epoch))
        tier, run = 0, epoch
        while run % self.fan == self.fan - 1:
            below = [self._folder(tier, r) for r in range(run - self.fan + 1, run + 1)]
            tier, run = tier + 1, run // self.fan
            self.merge(self.spark.read.parquet(*below)).write.mode("overwrite").parquet(self._folder(tier, run))

    def runs(self, epoch: int) -> list[str]:
        """The fewest runs that hold all epochs up to this one, oldest first."""
        out, tier, count = [], 0, epoch + 1  # runs of the tier that are complete
        while count:
            out += [self._folder(tier, r) for r in range(count - 1, count - count % self.fan - 1, -1)]
            tier, count = tier + 1, count // self.fan
        return out[::-1]

    def last_epoch(self) -> int | None:
        """The last epoch written, from the names of the first tier's folders."""
        context = self.spark.sparkContext
        root = context._jvm.org.apache.hadoop.fs.Path(f"{self.path}/tier=0")
        files = root.getFileSystem(context._jsc.hadoopConfiguration())
        if not files.exists(root):
            return None
        names = [s.getPath().getName() for s in files.listStatus(root)]
        return max((int(n[4:]) for n in names if n.startswith("run=")), default=None)

    def latest(self, epoch: int | None = None) -> DataFrame:
        """The finished rows up to an epoch, by default the last one written."""
        epoch = self.last_epoch() if epoch is None else epoch
        if epoch is None:
            raise ValueError(f"nothing has been written to {self.path}")
        return self.finish(self.spark.read.parquet(*self.runs(epoch)))


def write_epoch(df: DataFrame, path: str, epoch: int) -> None:
    """Append-only output, one folder per epoch, safe to repeat."""
    df.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")


def run_available(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str,
                  mode: str = "append") -> StreamingQuery:
    """Process everything that has arrived, then stop. Drop ``availableNow`` for a standing query."""
    query = (stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).foreachBatch(each).start())
    query.awaitTermination()
    return query
