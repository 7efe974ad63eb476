import random
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillspark.functions import automaton as A
from quillspark.functions import scoring
from quillspark.plans import fixtures as X

WORD = __import__("regex").compile(A._WORD)


def holds(text, pattern, bounded):
    """By trying every place."""
    word = lambda c: WORD.match(c) is not None
    at = text.find(pattern)
    while pattern and at >= 0:
        end = at + len(pattern)
        left = at > 0 and word(text[at - 1])
        right = end < len(text) and word(text[end])
        if not bounded or (left != word(pattern[0]) and right != word(pattern[-1])):
            return True
        at = text.find(pattern, at + 1)
    return False


def matched(matcher, texts):
    out = set()
    for low, data, offsets in A.laid_out(pa.array(texts, pa.string())):
        text, pattern = matcher.found(data, offsets)
        out |= {(low + int(t), int(p)) for t, p in zip(text, pattern, strict=True)}
    return out


@pytest.mark.parametrize("letters", ["ab", "abc ", "aé ß\U0001f600", "ab_-.", "áb ‍"])
@pytest.mark.parametrize("table", [A.TABLE, 200])
def test_against_every_place(letters, table, monkeypatch):
    monkeypatch.setattr(A, "TABLE", table)
    r = random.Random(letters)
    word = lambda n: "".join(r.choice(letters) for _ in range(n))
    patterns = sorted({word(r.randint(1, 6)) for _ in range(60)})
    bounded = [r.random() < 0.5 for _ in patterns]
    matcher = A.Matcher(patterns, bounded)
    assert (len(matcher.automata) > 1) == (table == 200)
    texts = [word(r.choice((0, 1, 3, 20, 400))) for _ in range(150)] + [None, "", word(9000), *patterns]
    want = {(i, k) for i, t in enumerate(texts) for k, p in enumerate(patterns) if holds(t or "", p, bounded[k])}
    assert matched(matcher, texts) == want


def test_groups_of_texts_and_long_patterns(monkeypatch):
    r = random.Random(2)
    texts = ["".join(r.choice("xy ") for _ in range(r.randrange(300))) for _ in range(80)]
    patterns = [texts[3][5:200], texts[9][:150], "x", "xyxy", "y x", "zz"]
    matcher = A.Matcher(patterns, [False] * len(patterns))
    want = {(i, k) for i, t in enumerate(texts) for k, p in enumerate(patterns) if p in t and p}
    for limit in (1, 100, 1 << 20):
        out = set()
        for low, data, offsets in A.laid_out(pa.array(texts), limit):
            t, p = matcher.found(data, offsets)
            out |= set(zip((low + t).tolist(), p.tolist(), strict=True))
        assert out == want
    sliced = pa.array(texts).slice(7, 20)
    assert [bytes(d).decode() for _, d, o in A.laid_out(sliced, 1)] == texts[7:27]


def test_no_patterns_and_no_texts():
    assert matched(A.Matcher([], []), ["a", ""]) == set() and matched(A.Matcher([""], [False]), ["a"]) == set()
    assert matched(A.Matcher(["a"], [True]), []) == set() == matched(A.Matcher(["a"], [False]), ["", None])


RULES = {"A": {"keywords": ["alpha", "é", "two words", "c++", "alpha", "e-mail", ""], "sentences": ["lph", "", "of the"], "filename_patterns": []}, "B": {"keywords": ["Ümlaut", "beta_1"], "sentences": ["ALPHA", "alpha"]}, "C": {}}
TEXTS = ["Alpha of the c++ x", "alphabet é.", "two words, E-Mail", "c++beta_1", "ÜMLAUT é", "", None, "...", "an e-mail-e", "café é", "x" * 70_000 + " alpha", "xc++y c++"]


def test_signals_equal_the_expressions(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "id long, text string")
    rules = scoring.Rules.of(RULES)
    got = rows.select("id", scoring.matched_signals(F.col("text"), rules).alias("m"), scoring.text_signals(F.col("text"), rules).alias("t")).collect()
    assert {r.id: r.m for r in got} == {r.id: r.t for r in got}
    assert scoring.Rules.of({}).categories == {} and rows.select(scoring.matched_signals(F.col("text"), scoring.Rules.of({}))).distinct().collect()[0][0] == []


def test_ten_thousand_patterns_take_no_longer(spark, sf_dir):
    """Within twice the time of 45, and what they find is what a search for each finds."""
    texts = [r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.lower("text").alias("text")).collect()] * 8
    few = [(w, b) for kinds in X.CORPUS_RULES.values() for k, b in (("keywords", True), ("sentences", False)) for w in kinds[k]]
    r, many = random.Random(4), {}
    while len(many) < 10_000:
        t = r.choice(texts)
        at = r.randrange(max(len(t), 1))
        many.setdefault(t[at : at + r.randint(6, 20)] if r.random() < 0.3 else "".join(r.choice("etaonrishd lu") for _ in range(r.randint(6, 16))), r.random() < 0.5)
    many.pop("", None)
    took = []
    for patterns in (few, list(many.items())):
        matcher = A.Matcher([p for p, _ in patterns], [b for _, b in patterns])
        matched(matcher, texts[:20])
        best = np.inf
        for _ in range(3):
            start = time.perf_counter()
            found = matched(matcher, texts)
            best = min(best, time.perf_counter() - start)
        took.append(best)
    assert took[1] < 2 * took[0], took
    names = list(many)
    for k in r.sample(range(len(names)), 300):
        assert {t for t, p in found if p == k} == {i for i, t in enumerate(texts) if holds(t, names[k], many[names[k]])}, names[k]


def test_large_rule_sets_take_the_automaton(spark):
    rules = scoring.Rules.of({"A": {"keywords": [f"w{i}" for i in range(scoring.MANY + 1)], "sentences": []}})
    rows = spark.createDataFrame([("w5 w300 w999",)], "text string").select(scoring.text_signals(F.col("text"), rules).alias("x"))
    assert "ArrowEvalPython" in rows._jdf.queryExecution().executedPlan().toString() and rows.collect()[0].x[0].keywords == 2
