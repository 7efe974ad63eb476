import random

import pytest
from pyspark.sql import functions as F

from quillspark.operators import page_layout as L
from quillspark.sources import pdf

BLOCKS = "doc_id long, page int, block_no int, height double, x0 double, y0 double, x1 double, y1 double, text string"
TABLES = "doc_id long, page int, table_no int, x0 double, y0 double, x1 double, y1 double, rows array<array<string>>"


def frames(spark, docs):
    blocks = [(d, p, k, float(page.height), *map(float, b[:4]), b[4]) for d, pages in docs.items() for p, page in enumerate(pages) for k, b in enumerate(page.blocks)]
    tables = [(d, p, k, *map(float, box), rows) for d, pages in docs.items() for p, page in enumerate(pages) for k, (box, rows) in enumerate(page.tables)]
    return spark.createDataFrame(blocks, BLOCKS).repartition(3), spark.createDataFrame(tables, TABLES)


def page(r):
    """Blocks down a page, with margins, numbers, heads that repeat, hyphens, odd blanks and boxes of any size."""
    blocks, y = [], r.choice([10, 60, 66, 71])
    while y < 1000:
        high = r.choice([5, 10, 15])
        text = r.choice(["Head", "Company", " 7 ", "Page 3", "- 4 -", "word-\n  part of", "Über uns", "", "  ", "1", "/ 2", "two\nlines", f"text {r.randrange(50)}", "٣"])
        blocks.append((x := r.choice([0, 95, 100, 250]), y, x + r.choice([5, 100, 300]), y + high, text))
        y += high + r.choice([0, 5, 8, 9, 30])
    tables = []
    for _ in range(r.randrange(3)):
        x, top = r.choice([-40000, 0, 100, 260]), r.randrange(900)
        tables.append(((x, top, r.choice([x + 40, 300, 50000]), top + r.choice([0, 10, 150])), r.choice([[["a", "b"]], [["Item", "Price"], ["x", "3"]], [], [["", None]]])))
    return pdf.Page(1000, blocks, tables)


def by_rows(spark, docs):
    blocks, tables = frames(spark, docs)
    texts = {r.doc_id: r.text for r in L.plain_text(blocks).collect()}
    chunks = {}
    for r in sorted(L.sections(blocks, tables).collect()):
        assert r.chunk_index == len(chunks.setdefault(r.doc_id, []))
        chunks[r.doc_id].append((r.text, r.chunk_type))
    return texts, chunks


def by_document(docs):
    texts = {d: t for d, pages in docs.items() if (t := pdf.plain_text(pages))}
    chunks = {d: c for d, pages in docs.items() if (c := [(x["text"], x["chunk_type"]) for x in pdf.sections(pages)])}
    return texts, chunks


@pytest.mark.parametrize("seed", range(3))
def test_equal_to_the_rules_for_one_document(spark, seed):
    r = random.Random(seed)
    docs = {d: [page(r) for _ in range(r.randrange(4))] for d in range(25)}
    head = (0, 96, 90, 99, "Same head")
    for pages in list(docs.values())[::3]:
        for p in pages:
            p.blocks.insert(0, head)
    assert by_rows(spark, docs) == by_document(docs)


def test_pairs_of_boxes_come_once(spark):
    r = random.Random(1)
    box = lambda k: (0, k, *(lambda x, y: (x, y, x + r.choice([0, 1, 99, 100, 250]), y + r.choice([1, 100, 333])))(r.choice([-50, 0, 100, 14990, 20000]), r.randrange(-200, 400)))
    a, b = [box(k) for k in range(60)], [box(k) for k in range(60)]
    schema = "page int, k int, x0 int, y0 int, x1 int, y1 int"
    got = [(x.k, x.b_k) for x in L.overlaps(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), ["page"]).collect()]
    want = [(x[1], y[1]) for x in a for y in b if pdf.overlap(x[2:], y[2:])]
    assert sorted(got) == sorted(want) and want


def test_nulls_and_no_rows(spark):
    blocks = spark.createDataFrame([(1, 0, 0, 1000.0, 0.0, 100.0, 9.0, 110.0, None), (1, 0, 1, 1000.0, None, None, None, None, "lost"), (1, 0, 2, 1000.0, 0.0, 100.0, 9.0, 110.0, "here")], BLOCKS)
    tables = spark.createDataFrame([(1, 0, 0, None, None, None, None, [["a", "b"]]), (2, 0, 0, 0.0, 0.0, 1.0, 1.0, None)], TABLES)
    assert [tuple(r) for r in L.plain_text(blocks).collect()] == [(1, "here")]
    assert sorted(map(tuple, L.sections(blocks.withColumn("_cx", F.lit(1)), tables).collect())) == [(1, 0, "here", "text"), (1, 1, "a: b.", "table")]
    assert L.sections(blocks.filter("false"), tables.filter("false")).count() == 0


def test_boxes_meet_by_key(spark):
    blocks, tables = frames(spark, {1: [page(random.Random(2))]})
    plan = L.sections(blocks, tables)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
