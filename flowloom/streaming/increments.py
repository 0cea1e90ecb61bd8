"""Results of a stream as a table of mergeable increments.

Every micro-batch writes what it adds under its own number and overwrites that folder when it is retried, so nothing is
counted twice; no watermark is needed, so nothing is too late. Reading merges the increments. Compaction merges
finished ones into runs; a run names the batches it holds, so old and new files never count together.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


class IncrementTable:
    """``partial`` turns a micro-batch into mergeable rows, ``merge`` folds such rows into fewer of the same schema."""

    def __init__(self, spark: SparkSession, path: str, partial: Callable[[DataFrame], DataFrame], merge: Callable[[DataFrame], DataFrame]):
        self.spark, self.path, self.partial, self.merge = spark, path.rstrip("/"), partial, merge

    def write(self, batch: DataFrame, epoch: int) -> None:
        self.partial(batch).write.mode("overwrite").parquet(f"{self.path}/epoch={epoch}")

    def start(self, events: DataFrame, checkpoint: str, once: bool = True, compact_every: int = 64) -> StreamingQuery:
        """Keep the table from a stream; every ``compact_every`` batches finished increments are compacted."""
        def step(batch: DataFrame, epoch: int) -> None:
            self.write(batch, epoch)
            if compact_every and epoch and epoch % compact_every == 0:
                self.compact()

        writer = events.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 second")).start()

    def _folders(self) -> tuple[list[tuple[int, int, str]], list[tuple[int, str]]]:
        """Finished runs (first, last, path) and increments (epoch, path)."""
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        store = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        runs, singles = [], []
        for status in store.listStatus(root) if store.exists(root) else []:
            name = status.getPath().getName()
            if not store.exists(jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")):
                continue
            if run := re.fullmatch(r"run=(\d+)-(\d+)", name):
                runs.append((int(run[1]), int(run[2]), f"{self.path}/{name}"))
            elif single := re.fullmatch(r"epoch=(\d+)", name):
                singles.append((int(single[1]), f"{self.path}/{name}"))
        return sorted(runs, key=lambda r: (r[0], -r[1])), sorted(singles)

    def _parts(self) -> list[tuple[int, int, str]]:
        """Runs and increments that hold each batch once; the widest run wins."""
        runs, singles = self._folders()
        held, last = [], -1
        for run in runs:
            if run[0] > last:
                held.append(run)
                last = run[1]
        return held + [(epoch, epoch, path) for epoch, path in singles if not any(a <= epoch <= b for a, b, _ in held)]

    def read(self) -> DataFrame:
        """The merged table; raises if nothing was written yet."""
        parts = self._parts()
        if not parts:
            raise FileNotFoundError(self.path)
        return self.merge(self.spark.read.parquet(*(path for _, _, path in parts)))

    def compact(self, wide: int = 8) -> None:
        """Merge all increments but the newest, which may be retried, into a run, and ``wide`` or more runs into one.

        What a run replaced is deleted by the next compaction, so a reader that has listed it can finish.
        """
        runs, singles = self._folders()
        held = self._parts()
        done = [p for p in held if p[0] == p[1] and p[2].rsplit("/", 1)[-1].startswith("epoch=")]
        newest = max((epoch for epoch, _ in singles), default=-1)
        done = [p for p in done if p[0] != newest]
        older = [p for p in held if "/run=" in p[2]]
        take = (older if len(older) + 1 >= wide else []) + done
        stale = [path for _, _, path in runs if path not in {p[2] for p in held}]
        stale += [path for epoch, path in singles if epoch != newest and any(a <= epoch <= b for a, b, _ in older)]
        if len(take) > 1:
            first, last = min(p[0] for p in take), max(p[1] for p in take)
            self.merge(self.spark.read.parquet(*(path for _, _, path in take))).write.mode("overwrite").parquet(f"{self.path}/run={first}-{last}")
        for path in stale:
            place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)
