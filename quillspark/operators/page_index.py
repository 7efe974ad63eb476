"""Deep pages of an ordered list by position: the list lies in ranges of its order, and a directory counts their rows.

A page is found in the directory by sums of the counts before each range; only the files of the ranges that it touches
are read, and only their rows are sorted, however deep the page is. OFFSET sorts and passes over all rows before it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from .relational import total

#: Rows of a range, about; a table of 10^11 rows has 10^5 ranges.
RANGE = 1_000_000
_RANGES = 8  # at least


@dataclass(frozen=True)
class PageIndex:
    """An ordered list in a folder that driver and executors share.

    The order must end in a unique column, else equal rows could change places between pages; with that, ranges are about
    equal whatever the values, since no two rows have the same place. Nulls are where the order puts them. The list is as
    it was when the index was built. Columns may have any name but `_range`.
    """

    spark: SparkSession
    path: str
    schema: StructType
    order: tuple[Column, ...]

    @classmethod
    def build(cls, rows: DataFrame, order: list[Column], path: str, ranges: int | None = None) -> PageIndex:
        spark, path = rows.sparkSession, path.rstrip("/")
        if ranges is None:
            ranges = max(-(-total(rows).first()[0] // RANGE), _RANGES)
        parted = rows.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id()).sortWithinPartitions("_range", *order)
        # The range is told by its partition, and that by bounds sampled once; a task that is repeated gets the same rows.
        parted.write.partitionBy("_range").parquet(f"{path}/rows")
        sizes = spark.read.schema(StructType([*rows.schema, StructField("_range", IntegerType())])).parquet(f"{path}/rows").groupBy("_range").agg(F.count(F.lit(1)).alias("n"))
        before = F.sum("n").over(Window.orderBy("_range")) - F.col("n")  # one row a range
        sizes.select("_range", "n", before.alias("before")).coalesce(1).write.parquet(f"{path}/directory")
        return cls(spark, path, rows.schema, tuple(order))

    def directory(self) -> DataFrame:
        """Ranges in order, with their numbers of rows and of the rows before them."""
        return self.spark.read.schema("_range INT, n BIGINT, before BIGINT").parquet(f"{self.path}/directory")

    def total(self) -> DataFrame:
        return self.directory().agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))

    def page(self, limit: int, offset: int = 0) -> DataFrame:
        """The rows from `offset` on, `limit` at most, in order; none beyond the end."""
        touched = self.directory().filter((F.col("before") < offset + limit) & (F.col("before") + F.col("n") > offset))
        found = touched.orderBy("_range").collect()  # as many as the page spans
        if limit <= 0 or not found:
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(self.schema).parquet(*[f"{self.path}/rows/_range={r._range}" for r in found])
        rows = rows.orderBy(*self.order)
        skipped = offset - found[0].before
        return (rows.offset(skipped) if skipped else rows).limit(limit)
