import datetime as dt

from pyspark.sql import functions as F

from quillspark import providers
from quillspark.operators import relational as R
from quillspark.operators import retrieval as V

T0 = dt.datetime(2024, 1, 1)
DOCS = "document_id long, file_name string, file_path string, processing_status string, is_duplicate boolean, duplicate_of string, source_type string, file_size long, current_timestamp_ist timestamp_ntz, processed_at timestamp_ntz"
CLS = "classification_id long, document_id long, classification_status string, document_type string, combined_confidence_score double, confidence_score double, classification_tier string, output_document_path string, human_decision boolean, reviewed_by string, current_timestamp_ist timestamp_ntz"


def docs(spark, *rows):
    full = [(i, name, f"/p/{i}", status, status == "Duplicate", None, source, 1, T0 + dt.timedelta(hours=hour), None) for i, name, status, source, hour in rows]
    return spark.createDataFrame(full, DOCS)


def cls(spark, *rows):
    return spark.createDataFrame([(i, d, s, t, c, c, "rule_only", None, None, None, T0 + dt.timedelta(hours=i)) for i, d, s, t, c in rows], CLS)


def test_rescan(spark):
    d = docs(spark, (1, "a", "Ingested", None, 0), (2, "a", "In Progress", None, 1), (3, "b", "Duplicate", None, 2), (4, "c", "Deleted", None, 3), (5, "c", "Duplicate", None, 4), (6, "c2", "Deleted", None, 3), (7, "c2", "Ingested", None, 4), (9, "t", "Ingested", None, 5), (8, "t", "Ingested", None, 5), (10, "A", "Ingested", None, 9))
    got = {r.document_id: (r.processing_status, r.is_duplicate, r.duplicate_of) for r in R.rescan(d).collect()}
    assert got == {1: ("Original", False, None), 2: ("Duplicate", True, "/p/1"), 3: ("Duplicate", True, None), 4: ("Deleted", False, None), 5: ("Duplicate", True, None), 6: ("Deleted", False, None), 7: ("Original", False, None), 8: ("Original", False, None), 9: ("Duplicate", True, "/p/8"), 10: ("Original", False, None)}
    assert tuple(R.rescan_counts(d).first()) == (2, 2, 4)
    assert tuple(R.rescan_counts(d.limit(0)).first()) == (0, 0, 0)


def test_arrivals(spark):
    d = docs(spark, (1, "a", "Deleted", None, 0), (2, "a", "Ingested", None, 1), (3, "a", "Ingested", None, 2))
    assert {r.document_id: r.duplicate_of for r in R.arrivals(d).collect()} == {1: None, 2: None, 3: "/p/2"}


def test_groups_count_stale_marks(spark):
    d = docs(spark, (1, "a", "Original", "Outlook", 0), (2, "a", "Duplicate", "", 1), (3, "b", "Duplicate", None, 2), (4, "c", "Original", None, 0), (5, "c", "Original", None, 0))
    assert sorted((r.file_name, r.copy_count, r.sources) for r in R.duplicate_groups(d).collect()) == [("a", 2, ["Outlook"]), ("b", 1, [])]


def test_pages_and_filters(spark):
    d = docs(spark, *[(i, f"f{i}", "Original", "Outlook" if i % 2 else None, 0) for i in range(10)])
    pages = [[r.document_id for r in R.page(d, [F.col("current_timestamp_ist").desc(), F.col("document_id")], 4, k).collect()] for k in (0, 4, 8)]
    assert sum(pages, []) == list(range(10))
    assert R.where(d, source_type="").count() == 10 and R.where(d, source_type="Outlook").count() == 5
    assert R.real(" None ") is None and R.real("Invoices") == "Invoices"
    assert R.deleted(d.withColumn("processing_status", F.lit("Deleted")), name="F1").count() == 1


def test_visibility(spark):
    d = docs(spark, (1, "a", "Original", None, 0), (2, "b", "Original", "manual_upload", 0), (3, "c", "Original", "Outlook", 0), (4, "d", "Deleted", "Outlook", 0), (5, "e", "Original", "manual_upload", 0))
    own = spark.createDataFrame([(2, "u1"), (5, "u2")], "document_id long, user_id string")
    ids = lambda df: sorted(r.document_id for r in df.collect())
    assert ids(R.visible(d, own, "u1")) == [2, 3] and ids(R.visible(d, own, admin=True)) == [1, 2, 3, 5]


def test_notifications(spark):
    d = docs(spark, (1, "a.pdf", "Original", "manual_upload", 0), (2, "b", "Original", "Outlook", 0), (3, "c", "Original", "manual_upload", 0))
    own = spark.createDataFrame([(1, "u1"), (2, "u1"), (3, None)], "document_id long, user_id string")
    c = cls(spark, (1, 1, "soft_flag", "Contracts", 62.5), (1, 1, "hard_stop", "Contracts", 12.0), (2, 1, "human_approved", "Contracts", 1.0), (3, 1, "auto_miscellaneous", "Miscellaneous", 0.0), (4, 2, "soft_flag", "Contracts", 50.0), (5, 3, "soft_flag", "Contracts", 50.0))
    events = R.notification_events(c, d, own)
    assert sorted((r.classification_id, r.notification_type) for r in events.collect()) == [(1, "document_in_review"), (2, "document_approved")]
    one = R.notification_events(c.filter("classification_status = 'soft_flag'"), d, own).first()
    assert "(confidence 62%)" in one.message
    assert R.pending_notifications(events, events.filter("classification_id = 1")).count() == 1


def test_review(spark):
    d, c = docs(spark, (1, "a.pdf", "Original", "Outlook", 0)), cls(spark, (1, 1, "soft_flag", "Contracts", 50.0), (2, 1, "hard_stop", "Contracts", 5.0), (3, 1, "hard_stop", "Contracts", 5.0), (4, 1, "auto_classified", "Contracts", 90.0))
    decisions = spark.createDataFrame([(1, True, "r", "Invoices"), (2, True, "r", "Nonsense"), (3, False, "r", "Invoices"), (4, True, "r", None)], "classification_id long, human_decision boolean, reviewed_by string, override_category string")
    got = {r.classification_id: (r.document_type, r.classification_status) for r in R.review(c, d, decisions).collect()}
    assert got == {1: ("Invoices", "human_approved"), 2: ("Contracts", "human_approved"), 3: ("Miscellaneous", "human_rejected")}
    order = [r.classification_id for r in R.pending_review(c.withColumn("combined_confidence_score", F.when(F.col("classification_id") != 3, F.col("combined_confidence_score"))), d).collect()]
    assert order == [3, 1, 2]


def test_upserts(spark):
    old = spark.createDataFrame([(1, 0, "a", "generated"), (1, 1, None, None)], "d long, c int, t string, s string")
    new = spark.createDataFrame([(1, 0, "b", "x"), (1, 1, "c", "y"), (2, 0, "n", "z")], "d long, c int, t string, s string")
    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    assert rows(R.upsert(old, new, ["d", "c"])) == [(1, 0, "b", "x"), (1, 1, "c", "y"), (2, 0, "n", "z")]
    assert rows(R.upsert(old.limit(1), new, ["d", "c"], ["s"]))[0] == (1, 0, "a", "x")
    assert rows(R.insert_missing(old, new, ["d", "c"])) == [(2, 0, "n", "z")]


def test_search_counts_each_classification_and_falls_back(spark):
    d = docs(spark, (1, "a", "Original", "Outlook", 0), (2, "b", "Original", "Outlook", 0))
    e = spark.createDataFrame([(1, 1, 0, " x\ny ", [1.0, 0.0], "generated"), (2, 2, 0, "z", [0.6, 0.8], "generated"), (3, 2, 1, "w", [0.0, 0.0], "generated"), (4, 1, 1, "v", None, "failed")], "embedding_id long, document_id long, chunk_index int, chunk_text string, embedding array<float>, embedding_status string")
    q = spark.createDataFrame([([1.0, 0.0],)], "query array<float>")
    c = cls(spark, (1, 1, "auto_classified", "Contracts", 90.0), (2, 1, "human_approved", "Invoices", 90.0), (3, 2, "hard_stop", "Contracts", 1.0))
    assert V.eligible(e, d, c).count() == 2
    got = V.search(e, d, c, q).collect()
    assert [(r.rank, r.document_id, r.similarity_score, r.excerpt) for r in got] == [(1, 1, 1.0, "x y")]
    back = V.search(e, d, c, q, document_type="Nothing").collect()
    assert [(r.document_id, r.classification_status) for r in back] == [(1, "Original"), (2, "Original")]
    assert "[Source: a | Category: Contracts]\nx y" == V.context(V.search(e, d, c, q)).first()[0]


def test_embedding_in_batches(spark):
    class Half(providers.HashEmbedder):
        def embed(self, texts):
            if any("bad" in t for t in texts):
                raise RuntimeError
            return super().embed(texts)

    df = spark.createDataFrame([(i, f"text {i}" if i != 7 else "bad") for i in range(10)], "i long, chunk_text string").coalesce(1)
    got = {r.i: (r.embedding_status, r.embedding is None) for r in providers.embedded(df, Half, batch=4).collect()}
    assert {i for i, (s, _) in got.items() if s == "failed"} == {4, 5, 6, 7} and all((s == "failed") == n for s, n in got.values())
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise RuntimeError
        return 5

    assert providers.retried(flaky, wait=0)() == 5


def test_a_hot_name_is_numbered_in_pieces(spark):
    d = docs(spark, *[(i, "a" if i % 4 else None, "Original" if i == 1 else "Duplicate", None, (i * 37) % 100) for i in range(1, 60)])
    got = {r.document_id: r.copy_no for r in R.numbered(d, "file_name", {"marked": F.col("is_duplicate"), "day": F.date_trunc("day", "current_timestamp_ist")}, ["current_timestamp_ist", "document_id"], "copy_no").collect()}
    rows = [(i % 4 == 0, i != 1, (i * 37) % 100, i) for i in range(1, 60)]
    for none in (False, True):
        mine = sorted(r[1:] for r in rows if r[0] is none)
        assert [got[i] for _, _, i in mine] == list(range(1, len(mine) + 1))
    # Nameless files are files of one name.
    assert {r.duplicate_of for r in R.arrivals(d.filter("file_name IS NULL")).collect()} == {None, "/p/52"}
    assert {r.duplicate_of for r in R.rescan(d.filter("file_name IS NULL")).collect()} == {None, "/p/52"}


def test_answers(spark):
    d = docs(spark, *[(i, f"f{i}", "Original", None, 0) for i in range(10)])
    answer = lambda *at: tuple(R.answer(d, [F.col("document_id").desc()], F.col("document_id"), *at).first())
    assert answer(4) == (10, 4, 0, True, [9, 8, 7, 6]) and answer(4, 6) == (10, 4, 6, False, [3, 2, 1, 0]) and answer(4, 20) == (10, 4, 20, False, [])
    assert [r.document_id for r in R.by_id(d, 3).collect()] == [3]
    assert R.by_id(d.withColumn("is_duplicate", F.lit(True)), 3, originals=True).count() == 0


def test_health_and_seed(spark):
    services = spark.createDataFrame([("a", "healthy"), ("b", "degraded"), ("c", None)], "name string, status string")
    assert tuple(R.health(services).first()) == ("degraded", 3, 2)
    assert tuple(R.health(services.filter("name = 'a'")).first()) == ("healthy", 1, 0)
    assert tuple(R.health(services.limit(0)).first()) == ("healthy", 0, 0)
    users = spark.createDataFrame([("u",)], "user_id string")
    assert R.seed(users.limit(0), users).count() == 1 and R.seed(users, users).count() == 0


def test_shared_folder_is_never_the_drivers_own_on_a_cluster():
    import pytest

    from quillspark import session

    class Context:
        master = "spark://host:7077"

        def getConf(self):  # noqa: N802
            return {}

        def getCheckpointDir(self):  # noqa: N802
            return None

    class Session:
        sparkContext = Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(Session())
