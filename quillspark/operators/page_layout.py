"""Text of laid-out pages from rows of blocks and tables, over any number of documents at once.

blocks: doc_id, page (from 0), block_no (the order on a page), height of the page, x0, y0, x1, y1, text. tables: doc_id,
page, table_no, x0, y0, x1, y1, rows (array<array<string>>). Blocks without a text or a place are left out, tables without
a place hide nothing, and other columns are dropped. (doc_id, page, block_no) and (doc_id, page, table_no) are unique.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.chunking import table_sentences
from ..functions.text import PAGE_NUMBER
from ..sources.pdf import BOTTOM, GAP, TOP
from .relational import numbered

#: Side of a grid cell in points, and how far cells reach; boxes beyond that count to the outermost ones.
CELL, REACH = 100, 15_000
_BOX = ("x0", "y0", "x1", "y1")
_PLACE = ["doc_id", "page"]
_BLANK = r"[\s\x1C-\x1F\x85]"


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, f"(?U)^{_BLANK}+|{_BLANK}+$", "")


def _is_number(text: Column) -> Column:
    return text.rlike(f"(?U){PAGE_NUMBER}")


def _cell(at: Column) -> Column:
    return F.floor(F.greatest(F.lit(-REACH), F.least(F.lit(REACH), at)) / CELL)


def overlaps(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """Pairs of boxes of one page of which each begins before the other ends, on both axes (so a line within a box counts).

    All columns of a, and those of b that `on` doesn't name as b_…. Boxes without a place meet none.

    They meet in the cells of a grid that both touch, by an equi-join; a pair counts in one of them alone, that of the
    upper left corner of what they share, so that no pair comes twice.
    """

    def in_cells(rows: DataFrame) -> DataFrame:
        across = rows.withColumn("_cx", F.explode(F.sequence(_cell(F.col("x0")), _cell(F.col("x1")))))
        return across.withColumn("_cy", F.explode(F.sequence(_cell(F.col("y0")), _cell(F.col("y1")))))

    others = in_cells(b).select(*on, "_cx", "_cy", *[F.col(c).alias(f"b_{c}") for c in b.columns if c not in on])
    pairs = in_cells(a).join(others, [*on, "_cx", "_cy"])
    c, left, top = F.col, F.greatest("x0", "b_x0"), F.greatest("y0", "b_y0")
    shared = (c("x0") < c("b_x1")) & (c("b_x0") < c("x1")) & (c("y0") < c("b_y1")) & (c("b_y0") < c("y1"))
    return pairs.filter(shared & (F.col("_cx") == _cell(left)) & (F.col("_cy") == _cell(top))).drop("_cx", "_cy")


def repeated(blocks: DataFrame) -> DataFrame:
    """doc_id and text of what stands at the same height (to 10 points) on a document's first two pages.

    Of several blocks of a page at one height the last counts. One aggregation after another, without a join.
    """
    rows = blocks.filter("page < 2").withColumn("text", stripped(F.col("text"))).filter((F.col("text") != "") & ~_is_number(F.col("text")))
    lines = rows.groupBy(*_PLACE, F.bround("y0", -1).alias("y")).agg(F.max_by("text", "block_no").alias("text"))
    return lines.groupBy("doc_id", "y", "text").agg(F.count(F.lit(1)).alias("n")).filter("n = 2").select("doc_id", "text").distinct()


def kept(blocks: DataFrame) -> DataFrame:
    """The blocks of a page's body, as one line each: no margins, no page numbers, nothing that pages repeat."""
    text = F.col("text")
    body = blocks.select(*_PLACE, "block_no", "height", *_BOX, stripped(text).alias("text")).filter((text != "") & (F.col("y1") > F.col("height") * TOP) & (F.col("y0") < F.col("height") * BOTTOM) & ~_is_number(text))
    rows = body.join(repeated(blocks), ["doc_id", "text"], "left_anti")
    line = F.regexp_replace(F.regexp_replace(text, r"(?U)(\w)-\s*\n\s*(\w)", "$1$2"), f"(?U){_BLANK}+", " ")
    return rows.withColumn("text", line)


def _joined(order: str, by: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "text"))), lambda x: x["text"]), by)


def plain_text(blocks: DataFrame) -> DataFrame:
    """doc_id, text: blocks on lines of their own, an empty line between pages. Documents without any text have no row."""
    pages = kept(blocks).groupBy(*_PLACE).agg(_joined("block_no", "\n").alias("text"))
    return pages.groupBy("doc_id").agg(_joined("page", "\n\n").alias("text"))


def paragraphs(blocks: DataFrame) -> DataFrame:
    """doc_id, page, no, text: blocks of a page in order, parted wherever the gap to the block before is wide."""
    w = Window.partitionBy(*_PLACE).orderBy("block_no")
    last = F.lag("y1").over(w)
    starts = blocks.withColumn("_start", (last.isNull() | (F.col("y0") - last > GAP)).cast("int"))
    islands = starts.withColumn("no", F.sum("_start").over(w))
    return islands.groupBy(*_PLACE, "no").agg(_joined("block_no", " ").alias("text"))


def sections(blocks: DataFrame, tables: DataFrame) -> DataFrame:
    """doc_id, chunk_index (from 0), text, chunk_type: of each page its paragraphs, then its tables as sentences.

    Blocks that a table covers in part are left to the table.
    """
    body, key = kept(blocks), [*_PLACE, "block_no"]
    hidden = overlaps(body.select(*key, *_BOX), tables.select(*_PLACE, *_BOX), _PLACE).select(*key)
    said = paragraphs(body.join(hidden, key, "left_anti")).filter(~_is_number(F.col("text"))).select(*_PLACE, F.lit(0).alias("kind"), F.col("no").cast("long").alias("no"), "text")
    told = tables.select(*_PLACE, F.lit(1).alias("kind"), F.col("table_no").cast("long").alias("no"), table_sentences(F.col("rows")).alias("text")).filter("text <> ''")
    rows = numbered(said.unionByName(told), "doc_id", {"page": F.col("page")}, ["kind", "no"], "chunk_index")
    return rows.select("doc_id", (F.col("chunk_index") - 1).alias("chunk_index"), "text", F.when(F.col("kind") == 0, "text").otherwise("table").alias("chunk_type"))
