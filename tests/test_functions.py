import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.functions import chunking, scoring, text, vectors


def one(spark, column, **values):
    df = spark.range(1)
    for k, v in values.items():
        df = df.withColumn(k, F.lit(v) if not isinstance(v, tuple) else F.lit(v[0]).cast(v[1]))
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("raw", "want"),
    [("don’t", "dont"), ("a—b", "ab"), ("Café", "Caf"), ("CafÃ©", "Café"), ("har-\nbour", "harbour"), ("a-\nb-\nc", "ab-\nc"), ("a\n\n\n\n\nb", "a\n\n\nb"), ("x \t y", "x y"), ("a\x00b", "ab"), ("", ""), (None, None)],
)
def test_clean_reference(spark, raw, want):
    assert one(spark, text.clean_text(F.col("t")), t=(raw, "string")) == want


def test_clean_safe_keeps_accents(spark):
    assert one(spark, text.clean_text(F.col("t"), "safe"), t="Café — don’t…") == "Café - don't..."
    assert one(spark, text.clean_text(F.col("t"), "safe"), t="CafÃ©") == "Café"


@pytest.mark.parametrize(
    ("path", "key"),
    [(f"/{text.CONTAINER}/Outlook/g_A/stem/A.pdf", "Outlook/g_A/A.pdf"), ("manual_upload/guid_w.pdf", "manual_upload/guid_w.pdf"), (f"{text.CONTAINER}/manual_upload/g_r/r.pdf", "manual_upload/g_r/r.pdf")],
)
def test_paths(spark, path, key):
    assert one(spark, text.source_key(F.col("p")), p=path) == key
    assert one(spark, text.output_key(F.lit("Contracts"), F.col("p")), p=path) == f"DIC/Contracts/{key}"


def test_times_and_folders(spark):
    at = lambda t: F.lit(t).cast("timestamp_ntz")
    assert [one(spark, f(at(t))) for t in ("2024-01-02 03:04:05", "2024-01-02 03:04:05.12") for f in (text.iso_text, text.timestamp_text)] == ["2024-01-02T03:04:05", "2024-01-02 03:04:05", "2024-01-02T03:04:05.120000", "2024-01-02 03:04:05.12"]
    assert one(spark, text.guid_folder(F.lit("/Outlook/g_1/x/a.pdf"))) == "g_1" and one(spark, text.guid_folder(F.lit("manual_upload/a.pdf"))) is None


def test_rules_count_words_of_any_form(spark):
    rules = scoring.Rules.of({"A": {"keywords": ["Été", "c++", "naïve", "x_1", "two words", "twice", "twice"]}, "B": {}})
    assert [tuple(x) for x in one(spark, scoring.text_signals(F.lit("ÉTÉ, c++-naïve x_1 x_12 two words; twice"), rules))] == [("A", 0, 6, 0), ("B", 1, 0, 0)]
    assert one(spark, scoring.all_scores(scoring.signals(F.lit("x_1"), F.lit(None).cast("string"), rules))) == '{"A":4.0,"B":0.0}'
    assert [x.keywords for x in one(spark, scoring.text_signals(F.lit(None).cast("string"), scoring.Rules.of({"A": {}})))] == [0]


def test_names(spark):
    df = spark.createDataFrame([("a.b.PDF", ".pdf", "a.b"), ("x", "", "x"), (".hidden", "", ".hidden"), ("dir.d/y.docx", ".docx", "y")], "n string, s string, t string")
    assert all(r.s == r.s2 and r.t == r.t2 for r in df.select("*", text.suffix(F.col("n")).alias("s2"), text.stem(F.col("n")).alias("t2")).collect())
    assert one(spark, text.tags(F.col("t")), t=" a, ,b ,") == ["a", "b"]
    with pytest.raises(Exception, match="unsupported file type"):
        one(spark, text.supported(F.col("n")), n="x.doc")


@pytest.mark.parametrize(("line", "is_number"), [("12", True), ("Page 3", True), ("- 3 -", True), ("1/10", True), ("Pg. 5", True), ("Page three", False), ("12 men", False)])
def test_page_numbers(spark, line, is_number):
    assert one(spark, text.page_number(F.col("x1")), x1=line) is is_number


def test_headings(spark):
    assert [one(spark, text.heading_level(F.lit(s))) for s in ("Heading 2", "heading 11", "Title", "Normal", "")] == [2, 11, 1, 0, 0]
    assert one(spark, text.heading_path(F.array(*map(F.lit, ["a", "", "b", "c"])))) == "a > b"
    assert len(one(spark, text.heading_path(F.array(F.lit("x" * 200))))) == 120


@pytest.mark.parametrize(("rule", "ai", "agree", "score", "category", "status"), [(40, 90, True, 72.5, "Contracts", "auto_classified"), (60, 60, False, 45.0, "Invoices", "soft_flag"), (60, 50, False, 45.0, "Contracts", "soft_flag"), (20, 30, False, 22.5, "Invoices", "hard_stop")])
def test_combine(spark, rule, ai, agree, score, category, status):
    r = one(spark, scoring.combine(F.lit(float(rule)), F.lit("Contracts"), F.lit(float(ai)), F.lit("Contracts" if agree else "Invoices")))
    assert (r.combined_score, r.final_category, r.status, r.categories_agreed) == (score, category, status, agree)


@pytest.mark.parametrize(
    ("rule", "category", "ai", "ai_category", "empty", "want"),
    [
        (0.0, "Contracts", 50.0, "Invoices", False, ("rule_only", "auto_miscellaneous", "Miscellaneous", 0.0)),
        (70.0, "Contracts", None, None, False, ("rule_only", "auto_classified", "Contracts", 70.0)),
        (68.0, "Contracts", None, None, False, ("rule_and_ai", "soft_flag", "Contracts", 68.0)),
        (30.0, "Contracts", None, None, False, ("rule_and_ai", "hard_stop", "Contracts", 30.0)),
        (30.0, "Contracts", 88.0, "Miscellaneous", False, ("rule_and_ai", "auto_miscellaneous", "Miscellaneous", 88.0)),
        (60.0, "Invoices", None, None, True, ("rule_and_ai", "soft_flag", "Invoices", 45.0)),
        (60.0, "Contracts", None, None, True, ("rule_and_ai", "hard_stop", "Contracts", 21.0)),
    ],
)
def test_route(spark, rule, category, ai, ai_category, empty, want):
    r = one(spark, scoring.route(F.lit(rule), F.lit(category), F.lit(ai).cast("double"), F.lit(ai_category).cast("string"), F.lit("why"), F.lit(empty)))
    assert (r.classification_tier, r.classification_status, r.final_category, r.combined_confidence_score) == want


def test_rules(spark):
    rules = scoring.Rules.of({"A": {"keywords": ["audit", "soc 2"], "sentences": ["we agree"], "filename_patterns": [r"\binv[_-]?\d+\b", "("]}, "B": {"keywords": ["audit"], "filename_patterns": [r"\binvoice\b"]}})
    score = lambda t, n: {x.category: (x.keywords, x.sentences, x.filenames, x.raw, x.score) for x in one(spark, scoring.signals(F.lit(t), F.lit(n), rules))}
    assert score("An AUDIT of soc 27; We Agree", "inv123.pdf")["A"] == (2, 1, 1, 19, 38.0)
    assert score("auditorium éaudit", "inv_123.pdf")["A"] == (0, 0, 0, 0, 0.0)
    assert score("", "Invoice_9.pdf")["B"] == (0, 0, 1, 10, 20.0)
    assert one(spark, scoring.winner(scoring.signals(F.lit("audit"), F.lit(""), rules))).category == "A"
    assert one(spark, scoring.winner(scoring.signals(F.lit(""), F.lit(""), rules))).category == "A"


def test_validated(spark):
    got = [tuple(one(spark, scoring.validated(F.lit(c).cast("string"), F.lit(s).cast("string")))) for c, s in (("Invoices", "130"), ("Sports", "50"), (None, None), ("Invoices", "high"), ("Miscellaneous", "-3"))]
    assert got == [("Invoices", 100.0), ("Contracts", 30.0), ("Contracts", 0.0), ("Invoices", 0.0), ("Miscellaneous", 0.0)]


@pytest.mark.parametrize(
    ("table", "want"),
    [
        ([["Freight", "$75"], ["Duty (4%)", "$3"]], "Freight: $75. Duty (4%): $3."),
        ([["Part", "Count", "Each", "Sum"], ["Brass hinge", "12", "$4", "$48"]], "Part: Brass hinge, Count: 12, Each: $4, Sum: $48."),
        ([["Ticket:", "T-77", "Opened:", "3-Mar-2031"]], "Ticket: T-77, Opened: 3-Mar-2031."),
        ([["Weight:", "$7", "Fee:", "$1"]], "Weight:, $7, Fee:, $1."),
        ([["a", "b"], ["", None]], "a: b."),
        ([], ""),
        (None, ""),
    ],
)
def test_tables(table, want):
    assert chunking.table_text(table) == want


def test_stacked_cells():
    assert chunking.table_text(chunking.unstacked([["GATE\nB 12", "SEAT\n14 C\naisle"]])) == "GATE: B 12. SEAT: 14 C aisle."
    assert chunking.unstacked([["a", "a", "b\nc"], ["a", "a", "b\nc"], ["", ""]]) == [["a", "b c"]]


def _section(text, kind="text"):
    return {"text": text, "heading_context": "", "chunk_type": kind}


def test_chunks():
    texts = lambda *raw: [c["text"] for c in chunking.normalised(list(raw))]
    long = "x" * 2000
    assert [len(t) for t in texts(_section(long))] == [800, 800, 700]
    assert texts(_section("a" * 100), _section("b" * 50)) == ["a" * 100 + "\n" + "b" * 50]
    assert texts(_section("t" * 100, "table"), _section("b" * 50)) == ["t" * 100, "b" * 50]
    assert texts(_section("a" * 100), _section("t" * 50, "table")) == ["a" * 100, "t" * 50]
    assert texts(_section("b" * 50)) == ["b" * 50]
    assert [len(t) for t in texts(_section("a" * 800), _section("b" * 79))] == [880]
    assert texts(_section("  "), {"text": None}) == []
    assert texts(_section("p" * 500 + "\n\n" + "q" * 500)) == ["p" * 500, "q" * 500]


def test_windows_agree(spark):
    for n in (0, 1, 800, 801, 1450, 1451, 2000, 5000):
        t = "".join(chr(97 + k % 26) for k in range(n))
        assert one(spark, chunking.char_windows(F.col("t")), t=t) == chunking.windows(t)


def test_cosine(spark):
    rows = [([1.0, 0.0], [1.0, 0.0]), ([0.0, 0.0], [1.0, 0.0]), (None, [1.0, 0.0]), ([1.0, 2.0, 3.0], [1.0, 0.0]), ([3.0, 4.0], [1.0, 0.0])]
    df = spark.createDataFrame(rows, "a array<float>, b array<float>")
    got = df.select(vectors.cosine(F.col("a"), F.col("b")).alias("x"), vectors.cosine_to([1.0, 0.0], F.col("a")).alias("y")).collect()
    for (x, y), want in zip(got, [1.0, None, None, None, 0.6], strict=True):
        assert (x is None and y is None) if want is None else (abs(x - want) < 1e-9 and abs(y - want) < 1e-9)
    half = df.select(vectors.half_precision(F.col("b")).alias("h")).first().h
    assert half == [np.float16(1.0), 0.0]
    assert [r[0] for r in df.select(vectors.right_size(F.col("b"), 2)).collect()] == [True] * 5


def test_cleaning_of_the_tables_against_plain_python(spark, sf_dir):
    """`safe` cleaning step by step in Python over every document, with broken lines and marks put in."""
    import re
    import unicodedata

    def cleaned(t):
        try:
            t = t.encode("latin-1").decode("utf-8")
        except UnicodeError:
            pass
        t = unicodedata.normalize("NFC", re.sub("\u00c2(?=\\s|[^\x00-\x7f])", "", t))
        t = "".join(c for c in t if c in "\t\n\r" or (ord(c) >= 32 and ord(c) != 127))
        t = re.sub(r"(\w)-\s*\n\s*(\w)", r"\1\2", t)
        t = "\n".join(line.strip() for line in re.sub(r"[ \t]+", " ", t).split("\n"))
        t = re.sub(r"\n{4,}", "\n\n\n", t)
        for a, b in ("\u2018'", "\u2019'", '\u201c"', '\u201d"', "\u2014-", "\u2013-"):
            t = t.replace(a, b)
        return t.replace("\u2026", "...").strip()

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    dirty = F.replace(F.replace(F.replace("text", F.lit("e "), F.lit("e  \t")), F.lit(". "), F.lit(".\x01\n\n\n\n\n \n")), F.lit("tion"), F.lit("ti-\n on\u2019\u2026"))
    rows = docs.select(dirty.alias("raw")).select("raw", text.clean_text(F.col("raw"), "safe").alias("x"), text.clean_text(F.col("raw"), "reference").alias("y")).collect()
    assert rows and all(r.x == cleaned(r.raw) for r in rows)
    # On texts of ASCII alone both modes agree.
    plain = [r for r in rows if r.raw.isascii()]
    assert all(r.x == r.y for r in plain)


def test_chunks_of_the_tables_hold_every_word_once(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", chunking.chunks(chunking.sections(F.col("text"))).alias("c"))
    for r in docs.collect():
        found = [c.text for c in r.c]
        # Only a first chunk may be small: later ones join the chunk before them.
        assert all(found) and all(len(t) >= chunking.SMALL for t in found[1:]), r.doc_id
        words = r.text.split()
        if max(map(len, re.split(r"(?<=[.!?])\s+", r.text))) <= chunking.SIZE:  # no sentence is cut into windows
            assert " ".join(found).split() == words
