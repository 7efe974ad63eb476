import random
import uuid

import pytest
from pyspark.sql import functions as F

from quillspark.operators import page_index
from quillspark.operators import relational as R
from quillspark.operators.page_index import PageIndex
from quillspark.plans import fixtures as X
from quillspark.plans.queries import QUERIES
from quillspark.session import place
from quillspark.sources import tables as T


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# ---- pages by position


@pytest.fixture(scope="module")
def listed(spark):
    r = random.Random(3)
    rows = [(i, r.choice([None, "a", "b", "ä", ""]), r.choice([None, 1, 2])) for i in range(300)]
    rows += [(1000 + i, "a", 1) for i in range(200)]  # a third of all has one value
    df = spark.createDataFrame(rows, "id long, name string, before int").repartition(5)
    order = [F.col("name").desc_nulls_last(), F.col("before").asc_nulls_first(), F.col("id").desc()]
    return df, order, [tuple(x) for x in df.orderBy(*order).collect()]


def test_pages_are_those_of_the_sorted_list(spark, listed):
    df, order, want = listed
    index = PageIndex.build(df, order, place(spark, "p"), 7)
    assert index.total().first()[0] == 500
    for limit, offset in [(1, 0), (20, 0), (20, 333), (500, 0), (600, 250), (3, 499), (5, 500), (5, 9999), (0, 3)]:
        assert [tuple(x) for x in index.page(limit, offset).collect()] == want[offset : offset + limit], (limit, offset)


def test_ranges_are_even_and_a_page_reads_those_it_spans(spark, listed):
    df, order, _ = listed
    index = PageIndex.build(df, order, place(spark, "p"), 10)
    sizes = [r.n for r in index.directory().orderBy("_range").collect()]
    assert len(sizes) == 10 and max(sizes) <= 2 * 50
    files = index.page(5, sizes[0] + sizes[1] + 3).inputFiles()
    assert files and {f.split("_range=")[1].split("/")[0] for f in files} == {"2"}
    files = index.page(5, sizes[0] + sizes[1] - 2).inputFiles()
    assert {f.split("_range=")[1].split("/")[0] for f in files} == {"1", "2"}


def test_no_rows_and_few_rows(spark, listed, monkeypatch):
    df, order, want = listed
    none = PageIndex.build(df.filter("id < 0"), order, place(spark, "p"))
    assert none.page(5).collect() == [] and none.page(5).columns == df.columns and none.total().first()[0] == 0
    one = PageIndex.build(df.filter("id = 7"), order, place(spark, "p"))
    assert [r.id for r in one.page(5).collect()] == [7]
    monkeypatch.setattr(page_index, "RANGE", 25)
    assert PageIndex.build(df, order, place(spark, "p")).directory().count() == 20


# ---- buckets


@pytest.fixture
def no_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


@pytest.mark.parametrize("name", ["files_all_latest_class", "pending_review"])
def test_no_row_moves_to_its_document(spark, sf_dir, no_broadcast, name):
    assert "hashpartitioning(document_id" in plan(QUERIES[name](spark, sf_dir))
    laid = plan(QUERIES[f"{name}_bucketed"](spark, sf_dir))
    assert "Exchange hashpartitioning" not in laid and laid.count("rangepartitioning") == 1


def one_bucket(df):
    """Whether one file is left to be read; Spark doesn't print that where it uses buckets for nothing else."""
    spark, name = df.sparkSession, "spark.sql.files.maxPartitionBytes"
    old = spark.conf.get(name)
    spark.conf.set(name, "4194305")  # the cost of opening a file and one byte, so that files aren't read together
    try:
        return df.rdd.getNumPartitions() <= 2  # a table that was appended to twice has two files a bucket
    finally:
        spark.conf.set(name, old)


def test_a_look_up_reads_one_bucket(spark, sf_dir):
    table = T.bucketed(X.documents(spark, sf_dir), "documents", buckets=8)
    assert len(table.inputFiles()) == 8
    assert one_bucket(R.by_id(table, 34)) and not one_bucket(table.filter("file_size = 34"))
    assert [r.document_id for r in R.by_id(table, 34).collect()] == [34]


def test_tables_are_created_in_buckets_and_appended_to(spark):
    database = f"b{uuid.uuid4().hex}"
    T.create_tables(spark, database, buckets=4)
    try:
        for start in (0, 50):
            T.append(spark.range(start, start + 50).coalesce(1).select(F.col("id").alias("document_id"), F.concat(F.lit("f"), F.col("id")).alias("file_name")), database, "document_metadata")
        table = spark.table(f"{database}.document_metadata")
        assert table.count() == 100
        assert one_bucket(table.filter("document_id = 7")) and not one_bucket(table.filter("file_name = 'f7'"))
        assert [r.file_name for r in table.filter("document_id = 7").collect()] == ["f7"]
        assert "Exchange hashpartitioning" not in plan(table.groupBy("document_id").count())
    finally:
        spark.sql(f"DROP DATABASE {database} CASCADE")
