import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from quillspark.llm import collocations as C
from quillspark.llm.queries import ORACLE_SQL, QUERIES
from tests.compare import duck, duck_rows, spark_rows

COLUMNS = "doc_id long, text string, lang string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plainly(docs, longest=4, least=30, covered=80, top=2000, factor=2_000_000):
    counts = defaultdict(Counter)
    for text, lang in docs:
        for piece in re.split(r"[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            w = re.findall(r"[^ \t]+", piece)
            counts[lang if lang is not None else "und"].update(tuple(w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    rows = []
    for lang, f in counts.items():
        found = {w: a for w, a in f.items() if len(w) > 1 and a >= least}
        longer = Counter()
        for w, a in found.items():
            for i in range(len(w)):
                for j in range(i + 2, len(w) + 1):
                    if j - i < len(w):
                        longer[w[i:j]] = max(longer[w[i:j]], a)
        scores = []
        for w, a in found.items():
            if 100 * longer[w] < covered * a:
                score, k = min((factor * a // (f[w[:k]] + f[w[k:]]), k) for k in range(1, len(w)))
                scores.append((-score, -a, " ".join(w).encode(), f[w[:k]], f[w[k:]]))
        n = sum(c for w, c in f.items() if len(w) == 1)
        rows += [(lang, i, p.decode(), -a, x, y, n, -s) for i, (s, a, p, x, y) in enumerate(sorted(scores)[:top], 1)]
    return sorted(rows)


def mine(spark, docs, **options):
    rows = spark.createDataFrame([(i, *r) for i, r in enumerate(docs)], COLUMNS)
    return sorted(tuple(r) for r in C.collocations(rows.withColumnRenamed("doc_id", "phrase").selectExpr("*", "1 AS n", "'x' AS word"), **options).collect())


def corpus(seed, n=120, words=12):
    r = random.Random(seed)
    names = [*"abcdefgh", "É", "é", "naïve", "\x00", "日本", "x-y", "Zz", "q q"][:words]
    marks = [" "] * 8 + ["  ", "\t", ". ", "\n", ", ", "?!", "\x0b", ""]
    return [("".join(r.choice(names[: 1 + int(words * r.random() ** 2)]) + r.choice(marks) for _ in range(r.randrange(60))), r.choice(["en", "fr", None, "und"])) for _ in range(n)]


@pytest.mark.parametrize("seed", range(3))
def test_against_plain_counting(spark, seed):
    docs = corpus(seed, 600) + [("", "en"), (None, "fr"), ("...", "xx"), ("alone", "yy")]
    docs += docs[:20]
    got = mine(spark, docs)
    assert got == plainly(docs) and len(got) > 50


@pytest.mark.parametrize("options", [{"size": 1}, {"size": 7}, {"share": 5}, {"size": 3, "share": 1}])
def test_any_routing_counts_the_same(spark, options):
    docs = corpus(9)
    assert mine(spark, docs, **options) == plainly(docs)


@pytest.mark.parametrize("options", [{"longest": 2}, {"longest": 3, "least": 5}, {"longest": 5, "least": 12}, {"covered": 20}, {"covered": 101, "top": 7}, {"factor": 10**17}])
def test_settings(spark, options):
    docs = corpus(5)
    assert mine(spark, docs, **options) == plainly(docs, **options)


def test_blocks_of_a_long_text_overlap(spark, monkeypatch):
    """Blocks of very few words, and of texts in one batch, lose and repeat nothing."""
    docs = corpus(3, 60)
    want = plainly(docs)
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"lang": ["en"], "text": [" ".join(f"w{i % 7}" for i in range(100))]})
    monkeypatch.setattr(C, "BLOCK", 9)
    assert [(b.low, b.high, len(b.codes)) for b in C.blocks(iter([batch]), 3)][:3] == [(0, 9, 12), (3, 12, 15), (3, 12, 15)]
    total = Counter()
    for b in C.blocks(iter([batch]), 3):
        total.update(int(c) for c in b.codes[b.low : b.high])
    assert sum(total.values()) == 100
    monkeypatch.undo()
    assert mine(spark, docs) == want


def test_a_very_long_text(spark):
    r = random.Random(1)
    text = " ".join(r.choice("ab") + str(int(40 * r.random() ** 3)) + r.choice([",", "", "", ""]) for _ in range(300_000))
    docs = [(text, "en"), (text[:1000], "en")]
    assert mine(spark, docs) == plainly(docs)


def test_each_occurrence_has_one_owner(spark):
    """A phrase's pivot is its rarest word: the rarer `b` owns all of `a b`, none is routed to the frequent `a`."""
    docs = spark.createDataFrame([(0, "a b a a a. a b a a", "en")] * 30, COLUMNS).select("lang", "text")
    counts = C.word_counts(docs, 30)
    table = C.levels(counts, 30)
    parts = C.fragments(docs, table, 4, 30, 1000)
    rows = {(r.pivot, r.at, r.fragment) for r in parts.groupBy("pivot", "at", "fragment").count().collect()}
    assert ("b", 1, "a b a a a") in rows and all("b" not in f.split() for p, _, f in rows if p == "a")
    assert np.count_nonzero(table) == 2


def test_empty_table(spark):
    assert mine(spark, []) == [] and mine(spark, [(None, None), ("", "en")]) == []


def test_query(spark, sf_dir):
    assert spark_rows(QUERIES["op11_collocations"](spark, sf_dir)) == duck_rows(duck(sf_dir), ORACLE_SQL["op11_collocations"])
