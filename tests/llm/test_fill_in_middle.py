import hashlib
import re

import pytest

from quillspark.llm import fill_in_middle as M
from quillspark.llm.queries import ORACLE_SQL, QUERIES
from tests.compare import duck, duck_rows, spark_rows

COLUMNS = "doc_id long, text string"
TEXTS = ["one\ntwo\nthree\n\nfour", "", None, "\n\n\n", "no end", "a <P> b\nc", "ä\U0001f600\nß\n<\nP>", "x\n" * 20_000 + "end", "same\nrow\n", "same\nrow\n", "<\n<S\n>P>\n<M\n"]


def plainly(doc_id, text, seed=7, percent=100, spm=50):
    """The same by another way: lists of lines."""
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = [int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[i : i + 8], 16) for i in (0, 8, 16, 24)]
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= percent:
        return doc_id, len(units), "plain", None, None, sha(text), sha(text)
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    form, out = ("spm", f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < spm else ("psm", f"<P>{p}<S>{s}<M>{m}")
    return doc_id, len(units), form, len(p), len(m), sha(out), sha(text)


def test_against_plain_python(spark):
    rows = [(i - 3, t) for i, t in enumerate(TEXTS)] + [(None, "a\nb\n"), (9 << 40, "a\nb\n"), (5, TEXTS[8])]
    docs = spark.createDataFrame(rows, COLUMNS).selectExpr("text", "doc_id", "'x' AS form", "1 AS output", "2L AS n")
    got = [tuple(r) for r in M.fill_in_middle_report(docs).collect()]
    assert sorted(got, key=repr) == sorted((plainly(*r) for r in rows), key=repr)
    assert {"plain", "psm", "spm"} == {r[2] for r in got}


@pytest.mark.parametrize("percent, spm", [(0, 50), (40, 0), (100, 100)])
def test_settings(spark, percent, spm):
    rows = [(i, f"line {i}\n" * (i % 5) + "end") for i in range(200)]
    s = M.Settings(seed=3, percent=percent, spm_percent=spm)
    out = M.fill_in_middle(spark.createDataFrame(rows, COLUMNS), s)
    got = sorted(tuple(r) for r in M.restored(out, s).drop("text").collect())
    assert got == sorted(plainly(*r, 3, percent, spm) for r in rows)
    assert {r.doc_id: r.text for r in M.restored(out, s).collect()} == dict(rows)


def test_other_units_and_sentinels(spark):
    s = M.Settings(units=r"\w+\W*|\W+", prefix="[pre]", suffix="[suf]", middle="[mid]")
    rows = [(i, f"word, {i} and <P> more " * 3) for i in range(40)]
    out = M.fill_in_middle(spark.createDataFrame(rows, COLUMNS), s)
    assert {r.doc_id: r.text for r in M.restored(out, s).collect()} == dict(rows)
    assert all(r.n == 15 and r.form != "plain" for r in out.collect())


@pytest.mark.parametrize("marks", [("<A>", "<A>", "<B>"), ("", "<S>", "<M>"), ("aba", "<S>", "<M>"), ("<P", "<P>", "<M>"), ("xy", "yz", "<M>")])
def test_sentinels_that_overlap_are_refused(marks):
    with pytest.raises(ValueError):
        M.Settings(prefix=marks[0], suffix=marks[1], middle=marks[2])


def test_empty_table(spark):
    assert M.fill_in_middle_report(spark.createDataFrame([], COLUMNS)).collect() == []


def test_no_shuffle(spark, sf_dir):
    plan = QUERIES["op12_fill_in_middle"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "ArrowEvalPython" in plan


def test_query(spark, sf_dir):
    assert spark_rows(QUERIES["op12_fill_in_middle"](spark, sf_dir)) == duck_rows(duck(sf_dir), ORACLE_SQL["op12_fill_in_middle"])
