"""Dashboards kept up to date by signed counts of what changes, and read without the document table.

A change says what a row was before and what it is after (null where there is none), as an UPDATE's output of its deleted
and inserted rows does. Each takes one from the cell of its old row and adds one to that of its new row. A cell is a
status, a source and a quarter of an hour, so that its days are exact in every time zone. Cells of a batch are
summed before they are written; what a table of cells says is their sum, in whatever order batches come.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import relational as R
from .sinks import Change, KeyedTable

CELL = ["processing_status", "source_type", "current_timestamp_ist"]
SLOT = 900  # seconds
_CELLS = "processing_status string, source_type string, current_timestamp_ist timestamp_ntz, n long"


class CellTable(KeyedTable):
    """Cells with how many rows each holds: the sum of all batches; cells that hold none don't appear."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType | None = None, key: list[str] | None = None) -> None:
        super().__init__(spark, path, schema or StructType.fromDDL(_CELLS), key or CELL)

    def read(self) -> DataFrame:
        return self.deltas().groupBy(*self.key).agg(F.sum("n").alias("n")).filter("n <> 0")


def image() -> Column:
    """Of a document's row, what dashboards look at."""
    return F.struct(*CELL)


def changes(before: DataFrame | None, after: DataFrame | None) -> DataFrame:
    """Changes from one state of some rows to another; rows that stay as they are make none.

    before, after: document_id (unique in each) and the columns of a cell; None stands for no rows.
    """
    if before is None or after is None:
        rows = (after if before is None else before).select(image().alias("row"))
        none = F.lit(None).cast(rows.schema["row"].dataType)
        return rows.select((none if before is None else F.col("row")).alias("before"), (F.col("row") if before is None else none).alias("after"))
    old, new = before.select("document_id", image().alias("before")), after.select("document_id", image().alias("after"))
    return old.join(new, "document_id", "full_outer").filter(~F.col("before").eqNullSafe(F.col("after"))).select("before", "after")


def cells(changed: DataFrame) -> DataFrame:
    """Signed counts of a batch of changes, one row a cell. Combined before rows move, so no cell is heavy."""
    sides = F.array(F.struct(F.col("before").alias("row"), F.lit(-1).alias("by")), F.struct(F.col("after").alias("row"), F.lit(1).alias("by")))
    rows = changed.select(F.explode(sides).alias("x")).filter("x.row IS NOT NULL").select("x.row.*", "x.by")
    at = F.col("current_timestamp_ist")
    # Both ways by the session's zone, in which a row's time is read by `stats_by_day` too.
    slot = F.timestamp_seconds(F.floor(F.unix_timestamp(at.cast("timestamp")) / SLOT) * SLOT).cast("timestamp_ntz")
    return rows.withColumn("current_timestamp_ist", slot).groupBy(*CELL).agg(F.sum("by").alias("n")).filter("n <> 0")


def cell_changes(changed: DataFrame) -> list[Change]:
    return [Change(cells(changed))]


def files_summary(table: CellTable) -> DataFrame:
    return R.files_summary(table.read(), "n")


def sources(table: CellTable) -> DataFrame:
    return R.sources(table.read(), "n")


def stats_totals(table: CellTable) -> DataFrame:
    return R.stats_totals(table.read(), "n")


def stats_by_source(table: CellTable) -> DataFrame:
    return R.stats_by_source(table.read(), "n")


def stats_by_day(table: CellTable, as_of: str, zone: str = "Asia/Kolkata", days: int = 30) -> DataFrame:
    """as_of: the start of a quarter of an hour, since cells are no finer."""
    at = datetime.fromisoformat(as_of)
    if (at - datetime(at.year, at.month, at.day)).total_seconds() % SLOT:
        raise ValueError("as_of must be the start of a quarter of an hour")
    return R.stats_by_day(table.read(), as_of, zone, days, "n")
