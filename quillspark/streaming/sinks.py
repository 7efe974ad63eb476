"""Keyed tables that streams write to, each batch exactly once: upserts, marks on some columns, and inserts if absent.

A table is a folder of deltas, one or more for each batch, and a ledger of the batches that count. A batch writes its
deltas and then its line in the ledger; one that died in between is written over when it is replayed, and one that is
replayed after its line was written changes nothing. Readers fold the deltas that the ledger knows, oldest first, by one
aggregation. Nothing that is there is rewritten; `compacted` folds a table into a new one.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

UPSERT, MARK, INSERT = "upsert", "mark", "insert"


@dataclass(frozen=True)
class Change:
    """Rows to write, and how.

    upsert: a row takes the place of the one of its key. mark: of rows that are there only `columns` change, others are
    added whole. insert: rows whose key is there are left out. Of several rows of one key the last in `order` counts (with
    insert the first; with no order any one).
    """

    rows: DataFrame
    kind: str = UPSERT
    columns: tuple[str, ...] = ()
    order: tuple[Column, ...] = field(default=())


class KeyedTable:
    """A table of one row a key, null being a key like others. path: a folder that driver and executors share.

    Its batches come in order, from one writer: a number that is not above the ledger's last is a replay.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType, key: list[str]) -> None:
        self.spark, self.path, self.key, self.schema = spark, path.rstrip("/"), key, schema
        self.columns = [f.name for f in schema]
        self._deltas = StructType([*schema.fields, StructField("_kind", StringType()), StructField("_batch", LongType()), StructField("_part", IntegerType())])

    def _files(self, folder: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}")
        return place, place.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def committed(self) -> list[int]:
        """The batches that count, in order."""
        place, files = self._files("ledger")
        names = [f.getPath().getName() for f in files.listStatus(place)] if files.exists(place) else []
        return sorted(int(n.partition("=")[2]) for n in names if n.startswith("batch="))

    def _commit(self, batch: int) -> None:
        place, files = self._files(f"ledger/batch={batch}")
        files.mkdirs(place.getParent())
        files.create(place, True).close()  # an empty file, there or not in one step

    def write(self, batch: int, *changes: Change) -> bool:
        """Write a batch, its changes one after another, unless the ledger has it: whether it was written."""
        if (done := self.committed()) and batch <= done[-1]:
            return False
        for part, change in enumerate(changes):
            self._write(self._one_a_key(change), batch, part, f"{MARK}:{','.join(change.columns)}" if change.kind == MARK else change.kind)
        self._commit(batch)
        return True

    def _one_a_key(self, change: Change) -> DataFrame:
        if not change.order:
            return change.rows.select(*self.columns).dropDuplicates(self.key)
        others = [c for c in self.columns if c not in self.key]
        pick = (F.min_by if change.kind == INSERT else F.max_by)(F.struct(*others), F.struct(*change.order))
        return change.rows.groupBy(*self.key).agg(pick.alias("_row")).select(*self.key, "_row.*").select(*self.columns)

    def _write(self, rows: DataFrame, batch: int, part: int, kind: str) -> None:
        rows.withColumn("_kind", F.lit(kind)).write.mode("overwrite").parquet(f"{self.path}/deltas/_batch={batch}/_part={part}")

    def sink(self, stream: DataFrame, checkpoint: str, changes: Callable[[DataFrame], list[Change]], trigger: dict | None = None) -> StreamingQuery:
        """Write a stream to the table; changes: what each of its batches comes to."""

        def put(rows: DataFrame, batch: int) -> None:
            self.write(batch, *changes(rows))

        return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

    def deltas(self, after: int | None = None) -> DataFrame:
        """The rows of committed batches (above a number), with _kind, _batch and _part; other folders are not read."""
        wanted = [b for b in self.committed() if after is None or b > after]
        if not wanted:
            return self.spark.createDataFrame([], self._deltas)
        return self.spark.read.schema(self._deltas).option("basePath", f"{self.path}/deltas").parquet(*[f"{self.path}/deltas/_batch={b}" for b in wanted])

    def read(self) -> DataFrame:
        """One row a key: what the batches, one after another, come to. Combined before rows move, so no key is heavy."""
        rows, at = self.deltas(), F.struct("_batch", "_part")
        kinds = [r[0] for r in rows.select("_kind").distinct().collect()]  # as many as there are ways to write

        def last(column: str) -> Column:
            # Upserts set every column and marks their own; of rows that neither met, the first one of the key holds.
            sets = F.col("_kind").isin(UPSERT, *[k for k in kinds if k.startswith(f"{MARK}:") and column in k.partition(":")[2].split(",")])
            value = F.struct(F.col(column).alias("v"))
            return F.coalesce(F.max_by(F.when(sets, value), F.when(sets, at)), F.min_by(value, at))["v"].alias(column)

        return rows.groupBy(*self.key).agg(*[last(c) for c in self.columns if c not in self.key]).select(*self.columns)

    def compacted(self, path: str) -> KeyedTable:
        """A table in a new folder that holds the same rows in one delta, under the last batch's number."""
        new, done = type(self)(self.spark, path, self.schema, self.key), self.committed()
        if done:
            new._write(self.read(), done[-1], 0, UPSERT)
            new._commit(done[-1])
        return new


def embedding_changes(rows: DataFrame) -> list[Change]:
    """A batch of chunks: those with a vector or text anew, and marks of those skipped, which change the status alone.

    rows: the table's columns and `seq`, the order in which they came; of a chunk in one batch the last of either kind counts.
    """
    skipped, order = F.col("embedding_status") == "skipped_miscellaneous", (F.col("seq"),)
    return [Change(rows.filter(~skipped), order=order), Change(rows.filter(skipped), MARK, ("embedding_status",), order)]


def notification_changes(rows: DataFrame) -> list[Change]:
    """A batch of events: those that weren't told of before."""
    return [Change(rows, INSERT)]
