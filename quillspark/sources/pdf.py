"""PDF pages: layout rules over text blocks, and a reader for where PyMuPDF is installed.

A page is its height, its text blocks (x0, y0, x1, y1, text) from top to bottom, and its tables (box, rows).
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from ..functions.chunking import table_text
from ..functions.text import PAGE_NUMBER

# Margins that hold headers and footers, the gap in points that parts paragraphs.
TOP, BOTTOM, GAP = 0.07, 0.93, 8
_NUMBER = re.compile(PAGE_NUMBER)


@dataclass
class Page:
    height: float
    blocks: list[tuple[float, float, float, float, str]]
    tables: list[tuple[tuple[float, float, float, float], list]] = field(default_factory=list)


def available() -> bool:
    try:
        import fitz  # noqa: F401
    except ImportError:
        return False
    return True


def pages(data: bytes) -> list[Page]:
    if not available():
        raise RuntimeError("reading PDF needs PyMuPDF, which is not installed")
    import fitz

    out = []
    with fitz.open(stream=data, filetype="pdf") as doc:
        for p in doc:
            try:
                tables = [(tuple(t.bbox), t.extract()) for t in p.find_tables().tables]
            except Exception:
                tables = []
            out.append(Page(p.rect.height, [tuple(b[:5]) for b in p.get_text("blocks", sort=True) if len(b) < 7 or b[6] == 0], tables))
    return out


def overlap(a: tuple, b: tuple) -> bool:
    return a[0] < b[2] and b[0] < a[2] and a[1] < b[3] and b[1] < a[3]


def repeated(pages: list[Page]) -> set[str]:
    """Texts that stand at the same height (to 10 points) on the first two pages."""
    by_height = [{round(b[1], -1): t for b in p.blocks if (t := b[4].strip()) and not _NUMBER.match(t)} for p in pages[:2]]
    return {t for y, t in by_height[0].items() if by_height[1].get(y) == t} if len(by_height) == 2 else set()


def _kept(page: Page, skip: set[str], within: bool) -> list[tuple[float, float, str]]:
    out = []
    for x0, y0, x1, y1, text in page.blocks:
        text = text.strip()
        if not text or y1 <= page.height * TOP or y0 >= page.height * BOTTOM or text in skip or _NUMBER.match(text):
            continue
        if not within and any(overlap((x0, y0, x1, y1), box) for box, _ in page.tables):
            continue
        out.append((y0, y1, re.sub(r"\s+", " ", re.sub(r"(\w)-\s*\n\s*(\w)", r"\1\2", text)).strip()))
    return out


def plain_text(pages: list[Page]) -> str:
    skip = repeated(pages)
    texts = ["\n".join(t for _, _, t in _kept(p, skip, True)) for p in pages]
    return "\n\n".join(t for t in texts if t)


def sections(pages: list[Page]) -> list[dict]:
    """Raw chunks: paragraphs by gaps between blocks, then the page's tables as sentences."""
    skip, out = repeated(pages), []
    for p in pages:
        paragraphs: list[list[str]] = []
        last = None
        for y0, y1, text in _kept(p, skip, False):
            if last is None or y0 - last > GAP:
                paragraphs.append([])
            paragraphs[-1].append(text)
            last = y1
        texts = [" ".join(x).strip() for x in paragraphs]
        out += [{"text": t, "heading_context": "", "chunk_type": "text"} for t in texts if t and not _NUMBER.match(t)]
        out += [{"text": t, "heading_context": "", "chunk_type": "table"} for _, rows in p.tables if (t := table_text(rows))]
    return out
