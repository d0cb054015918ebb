"""Orphan references over streams: the keyed state of operators.references, advanced by each micro-batch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from orefold.operators.references import STATE_SCHEMA, advance, orphans


class OrphanStream:
    """Keeps the state as one folder per micro-batch in a shared place; each batch writes the next one, so a lost executor or a
    restarted query goes on from the last complete state. A batch always reads the newest complete state before its own number, so a new
    object over the same folder and checkpoint, or a batch that is run again, gives the same result.

    The stream's rows have id, period, bits (as from deliveries: 1 for a declaration, 1 << (1 + n) for a reference by the n-th table) and
    gone (1: the declaration is deleted).
    """

    def __init__(self, spark: SparkSession, folder: str, tables: Sequence[str]) -> None:
        self.spark, self.folder, self.tables = spark, folder.rstrip("/"), list(tables)
        self.last: int | None = None

    def _newest(self, before: int | None = None) -> int | None:
        """The highest number of a completely written state, of those below `before` if given."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        fs = path(self.folder).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(path(self.folder)):
            return None
        names = [f.getPath().getName() for f in fs.listStatus(path(self.folder))]
        numbers = sorted((int(n[6:]) for n in names if n.startswith("state-") and n[6:].isdigit()), reverse=True)
        return next((k for k in numbers if (before is None or k < before) and fs.exists(path(f"{self.folder}/state-{k}/_SUCCESS"))), None)

    def _read(self, number: int) -> DataFrame:
        return self.spark.read.schema(STATE_SCHEMA).parquet(f"{self.folder}/state-{number}")

    def state(self) -> DataFrame:
        last = self._newest() if self.last is None else self.last
        return self.spark.createDataFrame([], STATE_SCHEMA) if last is None else self._read(last)

    def _batch(self, rows: DataFrame, batch: int) -> None:
        delivered = rows.where("gone = 0").groupBy("id", "period").agg(F.bit_or("bits").alias("bits"))
        before = self._newest(batch)
        nxt = advance(None if before is None else self._read(before), delivered, rows.where("gone = 1").select("id", "period").distinct())
        nxt.write.mode("overwrite").parquet(f"{self.folder}/state-{batch}")
        self.last = batch
        self._drop_before(before)

    def _drop_before(self, number: int | None) -> None:
        """Removes the states that no batch reads any more: those before the one that the batch just done would be run again from."""
        if number is None:
            return
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        fs = path(self.folder).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        for f in fs.listStatus(path(self.folder)):
            name = f.getPath().getName()
            if name.startswith("state-") and name[6:].isdigit() and int(name[6:]) < number:
                fs.delete(f.getPath(), True)

    def start(self, stream: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        return stream.writeStream.foreachBatch(self._batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

    def open_references(self) -> DataFrame:
        """The references that wait now."""
        return orphans(self.state(), self.tables)
