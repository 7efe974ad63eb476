"""Top-k vector search by an inverted file: vectors lie in the cells of k-means centres, and a search reads few cells.

Centres are trained by distributed Lloyd steps on unit vectors: each task adds up the vectors it assigns, and only sums
move. A search for several query vectors at once takes the cells nearest to each, computes exact similarities in them, and
keeps the best k of each task and then of all. With `exact` it goes on: a cell's radius bounds how similar a vector in it
can be, and the cells that could still hold a better one are read as well, so that the result is that of a full scan.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import place

#: Bounds: numbers in all centres (they are broadcast: 32 MB of doubles), rows of a file, queries taken at once.
MOST_NUMBERS, FILE_ROWS, QUERIES = 1 << 22, 1_000_000, 1024
#: Decimals of a similarity: two copies of a vector are equally similar, however their products are added up.
DECIMALS = 12


def _matrix(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the vectors that have `dims` numbers and a length, those vectors as unit vectors, and as they are."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(sizes == dims)
    rows = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
    with np.errstate(over="ignore", invalid="ignore"):
        norms = np.sqrt((rows * rows).sum(1))
    good = np.isfinite(norms) & (norms > 0)
    return at[good], rows[good] / norms[good, None], norms[good]


def _nearest(rows: np.ndarray, centres: np.ndarray, slice_rows: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """The centre most similar to each row, the first of equal ones, and how similar it is."""
    best, value = np.zeros(len(rows), np.int64), np.zeros(len(rows))
    for i in range(0, len(rows), slice_rows):
        found = rows[i : i + slice_rows] @ centres.T
        best[i : i + slice_rows] = found.argmax(1)
        value[i : i + slice_rows] = found.max(1)
    return best, value


def cells_for(rows: int, dims: int) -> int:
    """About the root of the number of vectors, within the bound."""
    return max(1, min(math.isqrt(max(rows, 1)), MOST_NUMBERS // max(dims, 1)))


def train(vectors: DataFrame, key: str, vector: str, dims: int, cells: int, steps: int = 6) -> np.ndarray:
    """Centres as unit vectors, one a row: at first the vectors of the least hashes of their keys, then `steps` Lloyd steps.

    A centre to which no vector is assigned stays. Vectors of another size, of no length or null are left out.
    """
    if cells * dims > MOST_NUMBERS:
        raise ValueError(f"{cells} centres of {dims} numbers are over the bound of {MOST_NUMBERS} numbers")
    spark = vectors.sparkSession
    rows = vectors.filter(F.size(vector) == dims).select(F.xxhash64(F.col(key).cast("string")).alias("h"), F.col(vector).alias("v"))
    first = rows.orderBy("h").limit(cells).toArrow()
    _, centres, _ = _matrix(first.column("v"), dims)
    for _ in range(steps if len(centres) else 0):
        shared = spark.sparkContext.broadcast(centres)

        def added(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            sums, counts = np.zeros_like(shared.value), np.zeros(len(shared.value), np.int64)
            for batch in batches:
                _, unit, _ = _matrix(batch.column("v"), dims)
                cell, _ = _nearest(unit, shared.value)
                order = np.argsort(cell, kind="stable")
                used, start = np.unique(cell[order], return_index=True)
                if len(used):
                    sums[used] += np.add.reduceat(unit[order], start, axis=0)
                    counts += np.bincount(cell, minlength=len(counts))
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(list(sums[at]), pa.list_(pa.float64()))], ["cell", "sums"])

        tasks = rows.select("v").mapInArrow(added, "cell int, sums array<double>")
        # Sums are added number by number, so that no task holds all tasks' sums of a cell.
        each = tasks.select("cell", F.posexplode("sums").alias("d", "x")).groupBy("cell", "d").agg(F.sum("x").alias("x")).toArrow()
        moved, counted = np.zeros_like(centres), np.zeros(len(centres), bool)
        at = each.column("cell").to_numpy()
        moved[at, each.column("d").to_numpy()] = each.column("x").to_numpy()
        counted[at] = True
        norms = np.sqrt((moved * moved).sum(1))
        good = counted & (norms > 0)
        centres = np.where(good[:, None], moved / np.where(norms > 0, norms, 1)[:, None], centres)
        shared.unpersist()
    return centres


class VectorIndex:
    """Vectors by cell, in a folder that driver and executors share, with each cell's size and radius."""

    def __init__(self, spark: SparkSession, path: str, key: str, vector: str, dims: int, schema: StructType, centres: np.ndarray, least: dict[int, float]) -> None:
        self.spark, self.path, self.key, self.vector, self.dims = spark, path, key, vector, dims
        self.schema, self.centres = schema, centres
        #: Of each cell that holds vectors, the least similarity of one to its centre.
        self.least = least

    @staticmethod
    def build(vectors: DataFrame, key: str, vector: str, path: str, cells: int | None = None, steps: int = 6) -> VectorIndex:
        """Index all rows that have a vector of the usual size (that of most rows) and some length; the others are in no result.

        Keys are unique. Other columns come along. Very full cells, as of copies of one vector, are dealt over files.
        """
        spark = vectors.sparkSession
        usual = vectors.filter(F.size(vector) > 0).groupBy(F.size(vector).alias("d")).count().orderBy(F.col("count").desc(), "d").first()
        dims, rows = (usual["d"], usual["count"]) if usual else (1, 0)
        cells = cells or cells_for(rows, dims)
        centres = train(vectors, key, vector, dims, cells, steps)
        shared = spark.sparkContext.broadcast(centres)
        columns = [c for c in vectors.columns if c not in ("_cell", "_near")]

        def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at, unit, _ = _matrix(batch.column(vector), dims)
                cell, near = _nearest(unit, shared.value)
                kept = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(cell, pa.int32()), pa.array(near)], [*columns, "_cell", "_near"])

        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.select(columns).schema)
        placed = vectors.select(columns).mapInArrow(assigned, f"{schema}, _cell int, _near double")
        share = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(max(1, rows // FILE_ROWS)))
        placed.repartition("_cell", share).write.partitionBy("_cell").parquet(path)
        stored = spark.read.schema(f"{schema}, _near double, _cell int").parquet(path)
        least = {r["_cell"]: r["near"] for r in stored.groupBy("_cell").agg(F.min("_near").alias("near")).collect()} if rows else {}  # a row a cell
        return VectorIndex(spark, path, key, vector, dims, stored.schema, centres, least)

    def _rows(self, cells: list[int]) -> DataFrame:
        """The vectors of some cells; the others' folders are not read."""
        return self.spark.read.schema(self.schema).parquet(self.path).filter(F.col("_cell").isin([int(c) for c in cells]))

    def _scan(self, queries: np.ndarray, numbers: list[int], asked: np.ndarray, k: int) -> DataFrame:
        """query, key and similarity: the best k of each task for each query, in the cells that it asks for (queries x cells)."""
        shared = self.spark.sparkContext.broadcast((queries, asked))
        ids, key = np.asarray(numbers, np.int64), self.key
        key_type = self.schema[key].dataType.simpleString()
        vector, dims = self.vector, self.dims

        def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            queries, asked = shared.value
            kept: list = [None] * len(queries)
            for batch in batches:
                at, unit, _ = _matrix(batch.column(vector), dims)
                cells = batch.column("_cell").to_numpy()[at]
                keys = batch.column(key).take(pa.array(at))
                for cell in np.unique(cells):
                    mine, inside = np.flatnonzero(asked[:, cell]), np.flatnonzero(cells == cell)
                    found = np.round(queries[mine] @ unit[inside].T, DECIMALS)
                    for q, row in zip(mine, found, strict=True):
                        # Rows as similar as the last one kept stay in, so that ties are settled by key at the end.
                        top = np.arange(len(row)) if len(row) <= k else np.flatnonzero(row >= np.partition(row, len(row) - k)[len(row) - k])
                        table = pa.table({"key": keys.take(pa.array(inside[top])), "similarity": row[top]})
                        table = table if kept[q] is None else pa.concat_tables([kept[q], table])
                        kept[q] = table.sort_by([("similarity", "descending"), ("key", "ascending")]).slice(0, k)
            for q, table in enumerate(kept):
                if table is not None:
                    table = table.combine_chunks()
                    yield from table.append_column("query", pa.array(np.full(len(table), ids[q]))).select(["query", "key", "similarity"]).to_batches()

        rows = self._rows(sorted(np.flatnonzero(asked.any(0)))).select(key, vector, "_cell")
        # Written, since it is read twice: at most k rows a query and task.
        schema, out = f"query long, key {key_type}, similarity double", place(self.spark, "nearest")
        rows.mapInArrow(best, schema).write.parquet(out)
        return self.spark.read.schema(schema).parquet(out)

    def search(self, queries: DataFrame, query_id: str, query_vector: str, k: int = 20, probes: int = 8, exact: bool = False) -> DataFrame:
        """query, rank, key and similarity of the k vectors most similar to each query; of equally similar ones the smaller key.

        queries: unique whole numbers and vectors, taken `QUERIES` at a time against the cells that these ask for. A query
        without a vector of the index's size gets no rows. probes: cells that a query looks into. exact: all cells that
        could hold one of the k best.
        """
        rows = queries.filter(F.size(query_vector) == self.dims).select(F.col(query_id).cast("long").alias("query"), F.col(query_vector).alias("v"))
        found = None
        for ids, unit in self._blocks(rows):
            part = self._block(unit, ids, k, probes, exact)
            found = part if found is None else found.unionByName(part)
        if found is None:
            key_type = self.schema[self.key].dataType.simpleString()
            return self.spark.createDataFrame([], f"query long, rank int, `{self.key}` {key_type}, similarity double")
        w = Window.partitionBy("query").orderBy(F.col("similarity").desc(), "key")
        best = found.dropDuplicates(["query", "key"]).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
        return best.select("query", "rank", F.col("key").alias(self.key), "similarity")

    def probes_for(self, recall: float = 0.95, sample: int = 100, k: int = 20) -> int:
        """How many cells a query must look into to find this share of its k best, as measured on stored vectors.

        Those of the `sample` least hashes of their keys are looked for exactly; what counts is how near, among all cells,
        those of their true neighbours are.
        """
        if not self.least:
            return 1
        every = self._rows(sorted(self.least))
        some = every.orderBy(F.xxhash64(F.col(self.key).cast("string")), self.key).limit(sample).select(F.monotonically_increasing_id().alias("_query"), self.key, self.vector)
        some = self.spark.createDataFrame(some.toArrow())  # `sample` rows, numbered once
        true = self.search(some, "_query", self.vector, k, 1, exact=True).select("query", self.key)
        met = true.join(every.select(self.key, "_cell"), self.key).select("query", "_cell").toArrow()  # k rows a query
        ids, at = some.select("_query").toArrow().column("_query").to_numpy(), {}
        _, unit, _ = _matrix(some.select(self.vector).toArrow().column(self.vector), self.dims)
        filled = np.array(sorted(self.least))
        for i, near in zip(ids, unit @ self.centres[filled].T, strict=True):
            at[i] = {int(c): n for n, c in enumerate(filled[np.argsort(-near, kind="stable")])}
        ranks = sorted(at[q][c] for q, c in zip(met.column("query").to_pylist(), met.column("_cell").to_pylist(), strict=True))
        return ranks[min(len(ranks) - 1, math.ceil(recall * len(ranks)) - 1)] + 1

    def _blocks(self, rows: DataFrame) -> Iterator[tuple[list[int], np.ndarray]]:
        """The queries in blocks, each fetched when its turn comes."""
        last = None
        while self.least:
            block = (rows if last is None else rows.filter(F.col("query") > last)).orderBy("query").limit(QUERIES).toArrow()
            if not len(block):
                return
            ids = block.column("query").to_pylist()
            at, unit, _ = _matrix(block.column("v"), self.dims)
            last = ids[-1]
            if len(at):
                yield [ids[i] for i in at], unit

    def _block(self, unit: np.ndarray, ids: list[int], k: int, probes: int, exact: bool) -> DataFrame:
        filled = np.array(sorted(self.least))
        near = unit @ self.centres[filled].T
        asked = np.zeros((len(unit), len(self.centres)), bool)
        first = np.argsort(-near, axis=1, kind="stable")[:, :probes]
        np.put_along_axis(asked, filled[first], True, axis=1)
        found = self._scan(unit, ids, asked, k)
        if not exact:
            return found
        # The angle to a vector of a cell is at least that to its centre less the cell's widest.
        kth = {r["query"]: r["worst"] for r in self._worst(found, k).collect()}  # a row a query of the block
        bound = np.array([kth.get(q, -2.0) for q in ids])
        radius = np.arccos(np.clip([self.least[c] for c in filled], -1, 1))
        angle = np.maximum(np.arccos(np.clip(near, -1, 1)) - radius - 1e-6, 0)
        more = np.zeros_like(asked)
        more[:, filled] = np.cos(angle) >= bound[:, None] - 1e-9
        more &= ~asked
        return found.unionByName(self._scan(unit, ids, more, k)) if more.any() else found

    @staticmethod
    def _worst(found: DataFrame, k: int) -> DataFrame:
        """Of each query with k rows the similarity of its k-th."""
        w = Window.partitionBy("query").orderBy(F.col("similarity").desc(), "key")
        return found.withColumn("n", F.row_number().over(w)).filter(F.col("n") == k).select("query", F.col("similarity").alias("worst"))
