"""DOCX files read with the standard library: paragraphs, tables and their order, styles and merged cells."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.chunking import CHUNK_TYPE, table_text, unstacked
from ..functions.text import heading_level, heading_path

ELEMENTS = "array<struct<kind:string,style:string,text:string,lines:array<string>>>"

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def _text(paragraph: ElementTree.Element) -> str:
    out = []
    for e in paragraph.iter():
        if e.tag == f"{_W}t":
            out.append(e.text or "")
        elif e.tag == f"{_W}tab" and f"{_W}val" not in e.attrib:
            out.append("\t")
        elif e.tag in (f"{_W}br", f"{_W}cr"):
            out.append("\n")
    return "".join(out)


def _cells(table: ElementTree.Element) -> list[list[str]]:
    """Rows of cell texts; a cell that spans columns or rows is repeated in each."""
    rows: list[list[str]] = []
    for tr in table.findall(f"{_W}tr"):
        row: list[str] = []
        for tc in tr.findall(f"{_W}tc"):
            said = tc.find(f"{_W}tcPr")
            span = said.find(f"{_W}gridSpan") if said is not None else None
            merge = said.find(f"{_W}vMerge") if said is not None else None
            text = "\n".join(_text(p) for p in tc.findall(f"{_W}p"))
            if merge is not None and merge.get(f"{_W}val", "continue") == "continue" and rows and len(row) < len(rows[-1]):
                text = rows[-1][len(row)]
            row += [text] * int(span.get(f"{_W}val", "1") if span is not None else 1)
        rows.append(row)
    return rows


def body(data: bytes) -> Iterator[tuple[str, str, str | list[list[str]]]]:
    """("paragraph", style name, text) and ("table", "", rows), in the order of the document."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
        styles = {}
        if "word/styles.xml" in z.namelist():
            for s in ElementTree.fromstring(z.read("word/styles.xml")).findall(f"{_W}style"):
                name = s.find(f"{_W}name")
                styles[s.get(f"{_W}styleId")] = name.get(f"{_W}val") if name is not None else ""
    for e in root.find(f"{_W}body"):
        if e.tag == f"{_W}p":
            style = e.find(f"{_W}pPr/{_W}pStyle")
            key = style.get(f"{_W}val") if style is not None else ""
            yield "paragraph", styles.get(key) or key or "", _text(e)
        elif e.tag == f"{_W}tbl":
            yield "table", "", _cells(e)


def elements(data: bytes) -> list[dict]:
    """What a file holds, in order: paragraphs with their style, tables as sentences and as lines."""
    out = []
    for kind, style, what in body(data):
        if kind == "paragraph":
            out.append({"kind": kind, "style": style, "text": what.strip(), "lines": []})
        else:
            rows = dict.fromkeys(tuple(map(str.strip, r)) for r in what)
            out.append({"kind": kind, "style": "", "text": table_text(unstacked(what)), "lines": [" | ".join(filter(None, r)) for r in rows]})
    return out


def plain_text(found: Column) -> Column:
    """Of elements: the paragraphs, then the rows of all tables with " | " between cells; a row that its table repeats
    counts once."""
    paragraphs = F.transform(F.filter(found, lambda e: e["kind"] == "paragraph"), lambda e: e["text"])
    rows = F.flatten(F.transform(found, lambda e: e["lines"]))
    return F.array_join(F.filter(F.concat(paragraphs, rows), lambda x: x != ""), "\n")


def sections(found: Column) -> Column:
    """Of elements, raw chunks: the paragraphs under a heading, and each table as sentences, with the headings above them.

    The elements are folded in order; a heading of some depth replaces those of its depth and deeper.
    """
    texts = F.array().cast("array<string>")
    chunk = lambda text, headings, kind: F.struct(text.alias("text"), heading_path(headings).alias("heading_context"), F.lit(kind).alias("chunk_type"))
    filled = lambda c: F.filter(F.array(c), lambda x: x["text"] != "")

    def ended(so_far: Column) -> Column:
        return F.concat(so_far["chunks"], filled(chunk(F.array_join(so_far["held"], "\n"), so_far["headings"], "text")))

    def step(so_far: Column, e: Column) -> Column:
        depth = F.when(e["kind"] == "paragraph", heading_level(e["style"])).otherwise(F.lit(-1))
        headings = F.when(depth > 0, F.concat(F.slice(so_far["headings"], F.lit(1), depth - 1), F.array(e["text"]))).otherwise(so_far["headings"])
        held = F.when(depth == 0, F.concat(so_far["held"], F.filter(F.array(e["text"]), lambda t: t != ""))).otherwise(texts)
        chunks = F.when(depth == 0, so_far["chunks"]).when(depth > 0, ended(so_far)).otherwise(F.concat(ended(so_far), filled(chunk(e["text"], so_far["headings"], "table"))))
        return F.struct(headings.alias("headings"), held.alias("held"), chunks.alias("chunks"))

    start = F.struct(texts.alias("headings"), texts.alias("held"), F.array().cast(CHUNK_TYPE).alias("chunks"))
    return F.aggregate(found, start, step, ended)
