"""Substring search by an inverted index of trigrams.

Each three letters that occur in a column, in lower case, have posting lists: the keys of the rows that hold them, in
blocks of keys so that no list of a very common trigram is one row's. Lists are sorted and lie in files that are ranges of
(column, trigram); a small directory tells each file's range. A search reads the lists of its pattern's trigrams alone,
intersects them block by block, and verifies what is left with `ilike` on the rows themselves.

An index is a folder of segments. New rows are added as a further segment; a changed text is added anew under its key, and
stale or repeated entries do no harm, as hits are verified. `compacted` folds the segments into one.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys of a posting list at most, about; and letters of a gram.
BLOCK_KEYS, GRAM = 50_000, 3


def grams(text: Column) -> Column:
    """The distinct grams of a text in lower case; none of a shorter text or null."""
    low = F.lower(text)
    count = F.length(low) - (GRAM - 1)
    return F.when(count > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), count), lambda i: F.substring(low, i, F.lit(GRAM))))).otherwise(F.array().cast("array<string>"))


def postings(rows: DataFrame, key: str, columns: list[str], blocks: int) -> DataFrame:
    """column, gram, block and the sorted keys of a list. Null texts and null keys are in none."""
    texts = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("text")) for c in columns])
    each = rows.filter(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.explode(texts).alias("x"))
    each = each.select(F.col("x.column").alias("column"), F.explode(grams(F.col("x.text"))).alias("gram"), F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int").alias("block"), "key")
    return each.groupBy("column", "gram", "block").agg(F.sort_array(F.collect_set("key")).alias("keys"))


def _write(lists: DataFrame, path: str) -> None:
    """One more segment: files are ranges of (column, gram, block), with the first and last gram of each in its directory."""
    place = f"{path}/segments/segment={uuid.uuid4().hex}"
    ranged = lists.repartitionByRange("column", "gram", "block").withColumn("part", F.spark_partition_id()).sortWithinPartitions("column", "gram", "block")
    ranged.write.partitionBy("part").parquet(f"{place}/lists")
    spark = lists.sparkSession
    at = F.struct("column", "gram")
    spark.read.schema("column string, gram string, part int").parquet(f"{place}/lists").groupBy("part").agg(F.min(at).alias("first"), F.max(at).alias("last")).coalesce(1).write.parquet(f"{place}/ranges")


def blocks_for(rows: int) -> int:
    return max(1, -(-rows // BLOCK_KEYS))


class TextIndex:
    """An index of some columns of a table with unique keys, in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str, blocks: int, columns: list[str], key_type: str) -> None:
        self.spark, self.path, self.blocks, self.columns, self.key_type = spark, path, blocks, columns, key_type

    @staticmethod
    def build(rows: DataFrame, key: str, columns: list[str], path: str, blocks: int | None = None) -> TextIndex:
        index = TextIndex(rows.sparkSession, path, blocks or blocks_for(rows.count()), columns, rows.schema[key].dataType.simpleString())
        index.add(rows, key)
        return index

    def add(self, rows: DataFrame, key: str) -> None:
        """Index further rows, or rows whose texts have changed."""
        _write(postings(rows, key, self.columns, self.blocks), self.path)

    def compacted(self, path: str) -> TextIndex:
        """The same index as one segment in a new folder."""
        whole = reduce(DataFrame.unionByName, map(self._lists, self._segments())).groupBy("column", "gram", "block").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("keys")))).alias("keys"))
        _write(whole, path)
        return TextIndex(self.spark, path, self.blocks, self.columns, self.key_type)

    def _lists(self, segment: str) -> DataFrame:
        return self.spark.read.schema(f"column string, gram string, block int, keys array<{self.key_type}>, part int").parquet(f"{segment}/lists")

    def _segments(self) -> list[str]:
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(f"{self.path}/segments")
        files = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return sorted(str(s.getPath()) for s in files.listStatus(root))

    def _grams_of(self, pattern: str) -> list[str]:
        """The grams that every text like %pattern% holds: those of its runs without wildcards, in lower case as ilike has it."""
        low = self.spark.range(1).select(F.lower(F.lit(f"%{pattern}%"))).first()[0]
        runs, run, at = [], "", 0
        while at < len(low):
            if low[at] in "%_\\":
                runs.append(run)
                run, at = "", at + (2 if low[at] == "\\" else 1)
            else:
                run, at = run + low[at], at + 1
        return sorted({r[i : i + GRAM] for r in [*runs, run] for i in range(len(r) - GRAM + 1)})

    def lists(self, column: str, wanted: list[str]) -> DataFrame:
        """The posting lists of some grams of a column, of all segments: only files whose range holds one are read."""
        found = []
        for segment in self._segments():
            hit = reduce(lambda a, b: a | b, [(F.struct(F.lit(column), F.lit(g)) >= F.col("first")) & (F.struct(F.lit(column), F.lit(g)) <= F.col("last")) for g in wanted])
            parts = [r.part for r in self.spark.read.parquet(f"{segment}/ranges").filter(hit).select("part").collect()]  # at most a file a gram, or the few that share one
            found.append(self._lists(segment).filter(F.col("part").isin(parts) & (F.col("column") == column) & F.col("gram").isin(wanted)).select("gram", "block", "keys"))
        return reduce(DataFrame.unionByName, found)

    def candidates(self, pattern: str, column: str) -> DataFrame | None:
        """The keys of rows that hold all grams of a pattern; None where it has none, so that all rows are candidates."""
        wanted = self._grams_of(pattern)
        if not wanted:
            return None
        # A gram's lists in several segments are one list; a block's lists are then intersected.
        by_gram = self.lists(column, wanted).groupBy("block", "gram").agg(F.array_distinct(F.flatten(F.collect_list("keys"))).alias("keys"))
        blocks = by_gram.groupBy("block").agg(F.collect_list("keys").alias("lists")).filter(F.size("lists") == len(wanted))
        common = F.aggregate(F.slice("lists", F.lit(2), F.greatest(F.size("lists") - 1, F.lit(0))), F.element_at("lists", 1), F.array_intersect)
        return blocks.select(F.explode(common).alias("key"))

    def search(self, rows: DataFrame, key: str, pattern: str, columns: list[str] | None = None) -> DataFrame:
        """Rows of the table of which a column is like %pattern%, in any case; % and _ in the pattern are wildcards.

        Equal to filtering all rows by `ilike`, which is what a pattern without three letters in a row comes to. Null
        texts match nothing; rows with a null key are found by such patterns only.
        """
        columns = columns or self.columns
        like = reduce(lambda a, b: a | b, [F.col(c).ilike(f"%{pattern}%") for c in columns])
        found = [self.candidates(pattern, c) for c in columns]
        if any(f is None for f in found):
            return rows.filter(like)
        keys = reduce(DataFrame.unionByName, found).distinct()
        return rows.join(keys.withColumnRenamed("key", "_key"), F.col(key) == F.col("_key"), "left_semi").filter(like)
