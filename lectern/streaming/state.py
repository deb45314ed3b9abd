"""Keyed state as streams: the latest patches of a key and the event that ended it, and tables that batches update.

``states`` keeps a key's fields and its end in a state store; ``Versions`` takes
the rows of each micro-batch into a table, so that a batch that is given again
after a failure changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class LatestPatches(StatefulProcessor):
    """Of each key: each field's value of the greatest ``at``, and its first terminal event (a cancelling one first, at the same moment).

    Rows may come in any order.
    """

    def __init__(self, terminal: list[str], cancel: str | None = None):
        self.terminal, self.cancel = terminal, cancel

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.fields = handle.getMapState("fields", "name string", "at long, value double")
        self.end = handle.getValueState("end", "at long, kind string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = {name[0]: tuple(value) for name, value in self.fields.iterator()}
        end, changed = tuple(self.end.get()) if self.end.exists() else None, {}
        rank = lambda e: (e[0], e[1] != self.cancel, e[1])
        for row in rows:
            if row.field is not None and row.value is not None and (row.field not in held or held[row.field][0] <= row.at):
                held[row.field] = changed[row.field] = (row.at, row.value)
            if row.kind in self.terminal or (self.cancel is not None and row.kind == self.cancel):
                end = min([end, (row.at, row.kind)] if end else [(row.at, row.kind)], key=rank)
        for name, value in changed.items():
            self.fields.updateValue((name,), value)
        if end:
            self.end.update(end)
        yield Row(key=key[0], fields={n: v for n, (_, v) in held.items()}, ended_at=end and end[0], ended=end and end[1])

    def close(self) -> None:
        pass


def states(rows: DataFrame, terminal: list[str], cancel: str | None = None) -> DataFrame:
    """key, fields, ended_at, ended of a stream of (key, at, kind, field, value): a row for each key that a batch touches."""
    kind = f"key {rows.schema['key'].dataType.simpleString()}, fields map<string, double>, ended_at long, ended string"
    return rows.groupBy("key").transformWithState(LatestPatches(terminal, cancel), kind, "Update", "None")


class Versions:
    """A table in versions, one for each batch that changed it; the last two are kept.

    A version is there once its writer has committed.  Batch n is put on the
    last version before n, so that it gives the same again however often it is
    applied.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path, schema
        self._root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        self._files = self._root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self._root, name)

    def committed(self) -> list[int]:
        if not self._files.exists(self._root):
            return []
        names = [f.getPath().getName() for f in self._files.listStatus(self._root)]
        return sorted(int(n[1:]) for n in names if n[0] == "v" and n[1:].isdigit() and self._files.exists(self._at(f"{n}/_SUCCESS")))

    def read(self, before: int | None = None) -> DataFrame:
        known = [v for v in self.committed() if before is None or v < before]
        if not known:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/v{known[-1]}")

    def apply(self, batch: DataFrame, number: int, merge) -> None:
        """Write merge(table, batch) as version ``number``, unless that is there."""
        if number in self.committed():
            return
        merge(self.read(number), batch).write.mode("overwrite").parquet(f"{self.path}/v{number}")
        for old in self.committed()[:-2]:
            self._files.delete(self._at(f"v{old}"), True)


def replaced(table: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """The table's rows, those of the batch's keys by the batch's."""
    return table.join(batch.select(key), key, "left_anti").unionByName(batch)


def kept_current(rows: DataFrame, table: Versions, checkpoint: str, key: str = "key") -> None:
    """Take what a stream has now into the table, from where the checkpoint left off."""
    spark = rows.sparkSession
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        run = lambda batch, number: table.apply(batch, number, lambda old, new: replaced(old, new, key))
        rows.writeStream.outputMode("update").foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)
