import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

from quillspark.llm.token_counts import Counter, _encoding, suffix_sums, token_histogram, token_lengths, truncated_at

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


def test_counts_are_those_of_the_library(spark, sf_dir):
    count, encode = Counter(PATH).count, _encoding(PATH).encode_ordinary
    odd = ["", " ", "  a", "a  b", "a\n b", "a \nb", " a ", "a  b", "don't  we'll", "x\t\ty z", "é漢 字 😀 a", "a" * 3000, "1 22 333", "a.\nB c"]
    assert [count(x) for x in odd] == [len(encode(x)) for x in odd]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = {r.doc_id: len(encode(r.text)) for r in docs.collect()}
    assert {r.doc_id: r.n_tokens for r in token_lengths(docs, PATH).collect()} == want
    assert isinstance(_encoding(PATH), tiktoken.Encoding)


def test_histogram(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    lengths = [r.n_tokens for r in token_lengths(docs, PATH).collect()]
    h = token_histogram(docs, PATH)
    rows = h.collect()
    assert {r.n_tokens: r.n_docs for r in rows} == {n: lengths.count(n) for n in lengths}
    for r in rows:
        L = r.n_tokens
        longer = [n for n in lengths if n >= L]
        assert (r.docs_ge, r.tokens_ge) == (len(longer), sum(longer)) and r.docs_le == sum(n <= L for n in lengths)
        assert r.truncated_tokens == sum(min(n, L) for n in lengths) and r.lost_tokens == sum(lengths) - r.truncated_tokens
        assert abs(r.quantile - r.docs_le / len(lengths)) < 1e-12
    for L in (0, 1, 100, 101, 10**6):
        assert tuple(truncated_at(h, L).first()) == (sum(min(n, L) for n in lengths), sum(n > L for n in lengths))


def test_suffix_sums_over_levels(spark):
    keys = [0, 1, 5, 63, 64, 65, 4095, 4096, 300_000, 300_001]
    df = spark.createDataFrame([(k, k + 1) for k in keys], "k long, v long")
    got = {r.k: r.ge_v for r in suffix_sums(df, "k", ["v"]).collect()}
    assert got == {k: sum(x + 1 for x in keys if x >= k) for k in keys}


def test_nulls_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, None), (None, ""), (2, "a b"), (2, "a b")], "doc_id long, text string").withColumn("n_tokens", F.lit("x"))
    assert {r.n_tokens: (r.n_docs, r.docs_ge) for r in token_histogram(docs, PATH).collect()} == {0: (2, 4), 2: (2, 2)}
    assert token_histogram(docs.limit(0), PATH).count() == 0
