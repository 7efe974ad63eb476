"""Documents below a folder as a Spark data source, for batches and streams: `spark.read.format("documents").load(path)`.

Rows: file_path, file_name, file_size, modified, content, text, chunks, elements, error, error_kind, as `files.extracted`
has them. A schema of some of these columns reads no more than they need: files are opened only for content, and parsed
only for what is found in it. A file that can't be read or parsed is a row with an error; the others aren't touched by it.

Options: path (anything that pyarrow reaches from driver and executors); bytes: of a task's files together (128 MB); and
for streams settle: seconds (10) that a file must be old, so that all files of one moment are there when it is taken.
Files are listed on the driver, path, size and time alone, as Spark's own file sources do.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from ..functions.chunking import CHUNK_TYPE
from . import docx
from .files import attempted

NAME = "documents"
#: Columns and their types, as Spark writes them.
COLUMNS = {"file_path": "string", "file_name": "string", "file_size": "bigint", "modified": "timestamp", "content": "binary", "text": "string", "chunks": CHUNK_TYPE, "elements": docx.ELEMENTS, "error": "string", "error_kind": "string"}
_PARSED = ("text", "chunks", "elements", "error", "error_kind")


@dataclass(frozen=True, order=True)
class File:
    """Files in the order in which a stream takes them."""

    at: int  # nanoseconds
    path: str
    size: int


@dataclass
class Files(InputPartition):
    files: list[File]


def listed(uri: str) -> list[File]:
    """Every file below a folder; hidden ones and those of writers (_ or . before the name) are left out."""
    system, path = pafs.FileSystem.from_uri(uri)
    found = system.get_file_info(pafs.FileSelector(path, recursive=True, allow_not_found=True))
    return sorted(File(f.mtime_ns or 0, f.path, f.size or 0) for f in found if f.type == pafs.FileType.File and not f.base_name.startswith((".", "_")))


def packed(files: list[File], limit: int) -> list[Files]:
    """Files in order, together as long as they hold no more than limit bytes; a larger file is alone."""
    out, held = [], limit + 1
    for f in files:
        if held + f.size > limit:
            out.append(Files([]))
            held = 0
        out[-1].files.append(f)
        held += f.size
    return out


class _Reading:
    def __init__(self, schema: StructType, options: dict) -> None:
        for field in schema:
            if COLUMNS.get(field.name) != field.dataType.simpleString():
                raise ValueError(f"no column {field.name} of type {field.dataType.simpleString()}")
        if not options.get("path"):
            raise ValueError("the source needs a path")
        path = options["path"]
        self.columns, self.path = schema.names, path if "://" in path or path.startswith("file:") else f"file://{path}"
        self.limit, self.settle = int(options.get("bytes", 128 << 20)), float(options.get("settle", 10))

    def rows(self, files: list[File]) -> Iterator[tuple]:
        system, _ = pafs.FileSystem.from_uri(self.path)
        parse = any(c in _PARSED for c in self.columns)
        for f in files:
            name = f.path.rpartition("/")[2]
            row = {"file_path": f.path, "file_name": name, "file_size": f.size, "modified": datetime.fromtimestamp(f.at / 1e9, UTC), "content": None}
            if parse or "content" in self.columns:
                try:
                    with system.open_input_stream(f.path) as stream:
                        row["content"] = stream.read()
                except OSError as e:
                    row |= dict(zip(_PARSED, ("", [], None, f"{type(e).__name__}: {e}", "failed"), strict=True))
            if parse and row["content"] is not None:
                row |= dict(zip(_PARSED, attempted(name, row["content"]), strict=True))
            yield tuple(row[c] for c in self.columns)


class Reader(_Reading, DataSourceReader):
    def partitions(self) -> list[Files]:
        return packed(listed(self.path), self.limit) or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        return self.rows(partition.files)


class StreamReader(_Reading, DataSourceStreamReader):
    """An offset is the last file taken, by time and path. A file that is written again comes again, by its new time;
    one that is moved in with an old time, before the offset, is never seen."""

    def initialOffset(self) -> dict:  # noqa: N802
        return {"at": -1, "path": ""}

    def latestOffset(self) -> dict:  # noqa: N802
        old = (time.time() - self.settle) * 1e9
        files = [f for f in listed(self.path) if f.at <= old]
        return {"at": files[-1].at, "path": files[-1].path} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Files]:
        inside = [f for f in listed(self.path) if (start["at"], start["path"]) < (f.at, f.path) <= (end["at"], end["path"])]
        return packed(inside, self.limit) or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        return self.rows(partition.files)


class Documents(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return ", ".join(f"{name} {kind}" for name, kind in COLUMNS.items())

    def reader(self, schema: StructType) -> Reader:
        return Reader(schema, self.options)

    def streamReader(self, schema: StructType) -> StreamReader:  # noqa: N802
        return StreamReader(schema, self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Documents)
