"""Duplicates by name on a stream that may bring files late, bring them again, or delete them: corrected rows are sent on.

Each name's state is its files and its head, the oldest live one. A file that is younger than the head is a
duplicate of it, and nothing else is looked at. An older one takes the head's place, and a deletion of the head gives it
to the next: then the rows of the name that this changes are emitted again. Whatever the order in which events come, the
last row of each file is what `rescan` says of the table as it is in the end.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from itertools import chain

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .sinks import Change

#: Rows of a frame that a task emits at once.
FRAME = 10_000
#: Groups that names are dealt to. Python gets a group's rows of a batch at once, since a call costs the time of many rows;
#: states lie by group, so a stream keeps the number that it began with.
GROUPS = 2048
_OUT = "document_id long, file_name string, processing_status string, is_duplicate boolean, duplicate_of string, version long"


def micros(time: str) -> Column:
    """A time as microseconds since 1970, since pandas holds none before 1677 or after 2262; no time comes after all others."""
    return F.coalesce(F.unix_micros(F.col(time).cast("timestamp")), F.lit(2**63 - 1))


def name_group() -> Column:
    return F.pmod(F.xxhash64("file_name"), F.lit(GROUPS)).cast("int").alias("name_group")


@contextmanager
def rocks(spark: SparkSession):
    """RocksDB as the state store, which stateful processors need, for streams that are started within."""
    name = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, old) if old else spark.conf.unset(name)


class Corrected(StatefulProcessor):
    """States of a group of names, which are kept for good: a copy or a deletion may come at any time.

    A name's files are numbered as they come, and `places` has their numbers, so that one name's files can be walked.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.names = handle.getMapState("names", "file_name string", "n long, version long, document_id long, ts long, file_path string")
        self.files = handle.getMapState("files", "file_name string, place long", "document_id long, ts long, file_path string, processing_status string, seq long")
        self.places = handle.getMapState("places", "file_name string, document_id long", "place long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        # Held as names that came, and numbers of files that came; a name's files are walked only if its head changes.
        held: dict[str | None, _Name] = {}
        for frame in rows:
            for r in frame.itertuples(index=False):
                if (name := held.get(r.file_name)) is None:
                    name = held[r.file_name] = _Name(self.names.getValue((r.file_name,)))
                self._take(name, r.file_name, int(r.document_id), int(r.ts), r.file_path, r.processing_status, int(r.seq))
        out = []
        for file_name, name in held.items():
            for row in self._changed(name, file_name):
                out.append(row)
                if len(out) == FRAME:
                    yield self._frame(out)
                    out = []
        if out:
            yield self._frame(out)

    def _take(self, name: _Name, file_name: str | None, doc: int, ts: int, path: str, status: str, seq: int) -> None:
        place = None
        if doc in name.touched:
            place, last, _ = name.touched[doc]
        elif name.known and (at := self.places.getValue((file_name, doc))):
            place = at[0]
            last = self.files.getValue((file_name, place))[4]
        if place is None:
            place, name.n = name.n, name.n + 1
            self.places.updateValue((file_name, doc), (place,))
        elif last >= seq:
            return  # an event that was overtaken
        self.files.updateValue((file_name, place), (doc, ts, path, status, seq))
        head = name.head
        name.touched[doc] = (place, seq, status != "Deleted")
        if status == "Deleted":
            name.lost |= head is not None and doc == head[0]
        elif head is None or (ts, doc) <= (head[1], head[0]):
            name.head = (doc, ts, path)
        elif doc == head[0]:
            name.lost = True  # the head itself came again with a later time

    def _changed(self, name: _Name, file_name: str | None) -> Iterator[tuple]:
        if not name.touched:
            return
        if name.lost:
            name.head = None
            for doc, ts, path, status, _ in map(self.files.getValue, ((file_name, i) for i in range(name.n))):
                if status != "Deleted" and (name.head is None or (ts, doc) < (name.head[1], name.head[0])):
                    name.head = (doc, ts, path)
        head, version = name.head, name.version + 1
        self.names.updateValue((file_name,), (name.n, version, *(head or (None, None, None))))
        changed = [(doc, live) for doc, (_, _, live) in name.touched.items()]
        if head != name.before:
            came = {place for place, _, _ in name.touched.values()}
            others = (self.files.getValue((file_name, i)) for i in range(name.known) if i not in came)
            changed = chain(changed, ((f[0], f[3] != "Deleted") for f in others))
        for doc, live in changed:
            copy = live and head is not None and doc != head[0]
            yield doc, file_name, "Deleted" if not live else "Duplicate" if copy else "Original", copy, head[2] if copy else None, version

    @staticmethod
    def _frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["document_id", "file_name", "processing_status", "is_duplicate", "duplicate_of", "version"])

    def close(self) -> None:
        pass


class _Name:
    """A name while a batch is at work: its head before and now, and of files that came their place, seq and whether they live."""

    def __init__(self, state: tuple | None) -> None:
        n, version, *head = state or (0, 0, None)
        self.known = self.n = n
        self.version, self.before, self.lost, self.touched = version, None if head[0] is None else tuple(head), False, {}
        self.head = self.before


def corrected(events: DataFrame) -> DataFrame:
    """What each file is, and again whenever that changes; `version` rises with each of a name's batches.

    events: document_id, file_name (a file keeps its name), file_path, processing_status, ts, and seq, by which the latest
    event of a file counts. Statuses other than Deleted are live.
    """
    rows = events.select(name_group(), "document_id", "file_name", "file_path", "processing_status", micros("ts").alias("ts"), F.col("seq").cast("long").alias("seq"))
    return rows.groupBy("name_group").transformWithStateInPandas(Corrected(), _OUT, "append", "none")


def latest_rows(rows: DataFrame) -> list[Change]:
    """A batch of corrections: of a file the last one counts."""
    return [Change(rows, order=(F.col("version"),))]
