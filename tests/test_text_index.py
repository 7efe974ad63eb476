import random

import pytest
from pyspark.sql import functions as F

from quillspark.operators.text_index import TextIndex, grams

NAMES = ["Invoice_2024.pdf", "invoice 2024.PDF", "INVOICE%2024", "a_b", "ab", "", None, "Ünïcode ÄÖÜ", "ΑΣ ΑΣΒ", "back\\slash_x", "100% sure", "x" * 5000 + "needle", "\U0001f600\U0001f600\U0001f600", "ınvoıce İnvoice"]
PATTERNS = ["invoice", "INVOICE_2024", "invoice%2024", "inv_ice", "a_b", "ab", "", "%", "_", "äöü", "ΑΣ", "ας", "slash\\_x", "100\\% s", "NEEDLE", "\U0001f600\U0001f600\U0001f600", "zzz", "2024.pdf", "e_2%4", "i̇nvo", "x" * 40]


@pytest.fixture(scope="module")
def rows(spark):
    r = random.Random(3)
    names = NAMES + ["".join(r.choice("invoce 2_%.") for _ in range(r.randrange(30))) for _ in range(300)]
    return spark.createDataFrame([(f"k{i}", n, names[-i - 1]) for i, n in enumerate(names)] + [(None, "invoice", "x")], "id string, name string, path string").cache()


@pytest.fixture(scope="module")
def index(rows, tmp_path_factory):
    return TextIndex.build(rows, "id", ["name", "path"], f"file://{tmp_path_factory.mktemp('index')}/i", blocks=3)


def like(rows, pattern, columns):
    cond = F.lit(False)
    for c in columns:
        cond = cond | F.coalesce(F.col(c).ilike(f"%{pattern}%"), F.lit(False))
    return sorted(tuple(r) for r in rows.filter(cond & F.col("id").isNotNull()).collect())


@pytest.mark.parametrize("pattern", PATTERNS)
@pytest.mark.parametrize("columns", [["name"], ["name", "path"]])
def test_search_equals_ilike(rows, index, pattern, columns):
    got = sorted(tuple(r) for r in index.search(rows.filter("id IS NOT NULL"), "id", pattern, columns).collect())
    assert got == like(rows, pattern, columns)


def test_segments_changes_and_compaction(spark, tmp_path):
    base = spark.createDataFrame([(1, "alpha report"), (2, "beta report")], "id long, name string")
    index = TextIndex.build(base, "id", ["name"], f"file://{tmp_path}/i", blocks=1)
    now = spark.createDataFrame([(1, "gamma invoice"), (2, "beta report"), (3, "alpha invoice"), (4, None)], "id long, name string")
    index.add(now.filter("id <> 2"), "id")
    index.add(now.filter("id = 3"), "id")
    whole = index.compacted(f"file://{tmp_path}/j")
    assert len(whole._segments()) == 1 and len(index._segments()) == 3
    for i in (index, whole):
        find = lambda p, i=i: sorted(r.id for r in i.search(now, "id", p).collect())
        assert (find("alpha"), find("report"), find("INVOICE"), find("gamma"), find("o")) == ([3], [2], [1, 3], [1], [1, 2, 3])
    # Each key once in a list, whatever the segments held.
    assert whole.lists("name", ["alp"]).select("keys").collect()[0][0] == [1, 3]


def test_empty_table(spark, tmp_path):
    none = spark.createDataFrame([], "id long, name string")
    index = TextIndex.build(none, "id", ["name"], f"file://{tmp_path}/i")
    assert index.search(none, "id", "abc").collect() == [] and index.search(none, "id", "a").collect() == []


def test_a_search_reads_the_lists_asked_for(spark, tmp_path):
    rows = spark.range(3000).select("id", F.md5(F.col("id").cast("string").cast("binary")).alias("name"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so small an index would be one file
    try:
        index = TextIndex.build(rows, "id", ["name"], f"file://{tmp_path}/i", blocks=2)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    lists = index.lists("name", ["abc"])
    plan = lists._jdf.queryExecution().executedPlan().toString()
    filters = plan[plan.index("PartitionFilters") :].split("\n")[0]
    assert "part" in filters.split("PushedFilters")[0] and "EqualTo(gram,abc)" in filters
    ranges = spark.read.parquet(f"{index._segments()[0]}/ranges").collect()
    assert len(ranges) == 4 == spark.read.parquet(f"{index._segments()[0]}/lists").select("part").distinct().count()
    # Ranges don't overlap but at their ends, and one part of four holds the gram.
    spans = sorted((r.first, r.last) for r in ranges)
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False))
    assert sum(r.first <= ("name", "abc") <= r.last for r in ranges) <= 2
    assert {r.gram for r in lists.collect()} == {"abc"} and {r.block for r in lists.collect()} == {0, 1}


def test_grams(spark):
    got = spark.createDataFrame([("AbcABC",), ("ab",), (None,), ("",), ("äÖü",)], "t string").select(grams(F.col("t"))).collect()
    assert [r[0] for r in got] == [["abc", "bca", "cab"], [], [], [], ["äöü"]]
