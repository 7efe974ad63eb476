import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from quillspark.llm.decontamination import decontaminate_report, remove_documents, remove_spans


def _words(x):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in x or ""))


def _brute(rows, items, width=10):
    grams = {}
    for item, x in items:
        w = _words(x)
        n = min(width, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            grams.setdefault(tuple(w[i : i + n]), set()).add(item)
    out = []
    for i, x in rows:
        w, hit, names = _words(x), set(), set()
        for n in {len(g) for g in grams}:
            for k in range(len(w) - n + 1):
                if (g := tuple(w[k : k + n])) in grams:
                    hit.update(range(k, k + n))
                    names |= grams[g]
        out.append((i, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def _corpus(seed):
    rng = random.Random(seed)
    vocabulary = ["a", "B", "c1", "É", "é", "ß", "the", "Of", "漢"]
    text = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", ", ", "-", "\n"]) for _ in range(n))
    items = [(str(i), text(rng.choice([0, 1, 4, 9, 10, 11, 30]))) for i in range(12)] + [("10", "only here once upon a time")]
    rows = [(i, rng.choice([text(rng.randrange(60)), text(5) + rng.choice(items)[1].upper() + text(5), rng.choice(items)[1]])) for i in range(80)]
    return rows, items


def _frames(spark, rows, items):
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string")


@pytest.mark.parametrize(("seed", "set_bytes"), [(1, 1 << 24), (2, 60), (3, 1)])
def test_against_brute_force(spark, seed, set_bytes):
    rows, items = _corpus(seed)
    docs, benchmark = _frames(spark, rows, items)
    assert sorted(map(tuple, decontaminate_report(docs, benchmark, set_bytes=set_bytes).collect()), key=repr) == _brute(rows, items)


def test_nulls_repeats_clashes_long_and_empty(spark):
    rows = [(1, None), (1, None), (None, "one two"), (2, ""), (3, "x " * 200_000 + "one, TWO"), (4, "!!!")]
    items = [("b", "One two"), ("a", "one two"), ("a", "one two"), (None, "x x"), ("c", None), ("d", "..")]
    docs, benchmark = _frames(spark, rows, items)
    docs = docs.withColumn("hit", F.lit("h")).withColumn("items", F.lit(1)).withColumn("n_words", F.lit(2))
    assert sorted(map(tuple, decontaminate_report(docs, benchmark).collect()), key=repr) == _brute(rows, [i for i in items if i[0] and i[1]])
    assert decontaminate_report(docs.limit(0), benchmark).count() == 0
    assert decontaminate_report(docs, benchmark.limit(0)).filter("contaminated").count() == 0
    kept = remove_documents(docs, benchmark)
    assert kept.columns == docs.columns and sorted((r.doc_id for r in kept.collect()), key=repr) == [1, 1, 2, 4]


def test_removal(spark):
    item = "one two three four five six seven eight nine ten"
    rows = [(1, f"Before it. {item.title()}! After."), (2, "clean text")]
    docs, benchmark = _frames(spark, rows, [("i", item)])
    assert {r.doc_id: r.text for r in remove_spans(docs, benchmark).collect()} == {1: "Before it. ! After.", 2: "clean text"}
    assert [r.doc_id for r in remove_documents(docs, benchmark).collect()] == [2]
    assert remove_documents(docs, benchmark, max_share=0.9).count() == 2 and remove_documents(docs, benchmark, max_share=0.5).count() == 1
