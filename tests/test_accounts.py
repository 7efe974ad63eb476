from pyspark.sql import functions as F

from quillspark import providers
from quillspark.functions import tokens as K
from quillspark.operators import accounts as A
from quillspark.operators import embedding as E
from quillspark.sources import tables as S


def test_tokens():
    t = K.jwt({"sub": "u1"}, "secret", 60, now=1000)
    assert K.jwt_claims(t, "secret", now=1059)["sub"] == "u1"
    assert K.jwt_claims(t, "secret", now=1061) is None and K.jwt_claims(t, "other", now=1001) is None
    assert K.jwt_claims("x.y", "secret") is None and K.jwt_claims(t[:-2], "secret", now=1001) is None
    kept = K.hashed_password("pw")
    assert K.right_password("pw", kept) and not K.right_password("no", kept) and not K.right_password("pw", "broken")


def test_users_and_keys(spark):
    users = spark.createDataFrame([("1", "a@x.org", "A", "admin", True)], "user_id string, email string, full_name string, role string, is_active boolean")
    new = spark.createDataFrame([(" B@X.org ", "B", "user"), ("A@x.org", "again", "user"), ("c@x.org", "C", "king")], "email string, full_name string, role string")
    made = A.create_users(users, new)
    assert [(r.email, r.role) for r in made.collect()] == [("b@x.org", "user")]
    assert A.deactivate(users.unionByName(made), "1").filter("is_active").count() == 1
    keys = A.create_key(spark, "k", "1", "s3cret", "2024-01-02 00:00:00").unionByName(A.create_key(spark, "k2", "1", "other"))
    find = lambda t, s, now="2024-01-01": t.transform(lambda x: A.find_key(x, s, now)).count()
    assert (find(keys, "s3cret"), find(keys, "s3cret", "2024-01-03"), find(keys, "other", "2030-01-01"), find(keys, "none")) == (1, 0, 1, 0)
    gone = A.revoke_key(keys, A.find_key(keys, "other", "2024-01-01").first().key_id)
    assert find(gone, "other") == 0 and A.used_key(keys, "other", "2024-01-01").filter("last_used_at IS NOT NULL").count() == 1
    rows = spark.range(1).select(F.lit("1").alias("user_id"), K.token_hash(F.lit("t")).alias("token_hash"), F.lit(False).alias("is_revoked"), F.lit("2024-02-01").cast("timestamp").alias("expires_at"))
    assert A.open_tokens(rows, "t", "2024-01-01").count() == 1 and A.open_tokens(rows, "t", "2024-03-01").count() == 0
    assert A.open_tokens(A.revoke_tokens(rows, "1"), "t", "2024-01-01").count() == 0


def test_embedding_of_documents(spark):
    rows = [(1, "Contracts", [("some words here", "", "text")]), (2, "Miscellaneous", [("x", "", "text")]), (3, "Invoices", [])]
    docs = spark.createDataFrame(rows, "document_id long, final_category string, chunks array<struct<text:string,heading_context:string,chunk_type:string>>")
    got = E.embed_documents(docs, providers.HashEmbedder)
    assert sorted((r.document_id, r.chunk_index, r.embedding_status) for r in got.collect()) == [(1, 0, "generated"), (2, 0, "skipped_miscellaneous"), (3, 0, "failed")]
    assert E.report(got).filter("chunks_failed = 1").count() == 1
    cls = spark.createDataFrame([(1, None), (2, 9)], "document_id long, embedding_id long")
    assert {r.document_id: r.embedding_id for r in E.back_reference(cls, got.withColumn("embedding_id", F.col("document_id") * 10)).collect()} == {1: 10, 2: 9}


def test_tables_and_files(spark, tmp_path):
    S.create_tables(spark, "quill_test")
    S.create_tables(spark, "quill_test")
    before = spark.table("quill_test.users").count()
    S.append(spark.createDataFrame([("u", "e@x")], "user_id string, email string"), "quill_test", "users")
    assert spark.table("quill_test.users").count() == before + 1
    spark.sql("DROP DATABASE quill_test CASCADE")
    (tmp_path / "a").write_text("hello")
    S.copy_file(spark, str(tmp_path / "a"), str(tmp_path / "b"))
    assert (tmp_path / "b").read_text() == "hello" and S.delete_file(spark, str(tmp_path / "b")) and not S.delete_file(spark, str(tmp_path / "b"))
    assert S.content_type('a".pdf') == ("application/pdf", "a.pdf")


class Echo:
    def write(self, prompt, limit):
        return prompt[:limit]


class Broken:
    def write(self, prompt, limit):
        raise RuntimeError


def test_writers(monkeypatch):
    monkeypatch.setattr(providers.time, "sleep", lambda s: None)
    assert providers.hypothetical_answer(Broken(), "q") == "q" and providers.hypothetical_answer(Echo(), "q").endswith("q")
    assert providers.chunk_context(Broken(), "d", "c") == "" and providers.classify(Broken(), "t", "n", ("A",)) is None
    assert "Question: q" in providers.answer(Echo(), "q", "ctx") and "JSON" in providers.classify(Echo(), "t", "n", ("A",))
