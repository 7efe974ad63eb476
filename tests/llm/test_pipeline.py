import hashlib
import re

from tokenizers import Tokenizer

import corpus_pipeline
from quillspark.llm.queries import QUERIES, vocabulary
from tests.llm.test_jaccard_join import _brute as near


def test_stages_against_brute_force(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tokenizer = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    words = lambda x: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in x))
    grams = set()
    for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect():
        w = words(r.text)
        n = min(10, len(w))
        grams |= {tuple(w[i : i + n]) for i in range(len(w) - n + 1 if w else 0)}
    before = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        if name != "encoding":
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        rows = docs.collect()
        if name == "encoding":
            sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
            ids = {i: tokenizer.encode(x, add_special_tokens=False).ids for i, x in before.items()}
            want = {i: (len(v), sha(" ".join(map(str, v))), sha(tokenizer.decode(v, skip_special_tokens=False))) for i, v in ids.items()}
            assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows} == want
            break
        after = {r.doc_id: r.text for r in rows}
        assert len(rows) == len(after) and all(before[i] == x for i, x in after.items())
        if name == "toxicity":
            assert 0 < len(before) - len(after) < 0.3 * len(before)
            scores = QUERIES["op5_toxicity"](spark, sf_dir).collect()
            assert set(after) == {r.doc_id for r in scores if not r.predicted}
        if name == "exact_dedup":
            first = {}
            for i in sorted(before):
                first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", before[i]), i)
            assert set(after) == set(first.values())
        if name == "near_dedup":
            assert set(after) == {c for _, c, _, _ in near(list(before.items()))}
        if name == "decontamination":
            held = lambda w: any(tuple(w[i : i + n]) in grams for n in {len(g) for g in grams} for i in range(len(w) - n + 1))
            assert set(after) == {i for i, x in before.items() if not held(words(x))}
        before = after


def test_empty_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0


def test_run(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).count() > 50


def test_nulls_repeats_and_clashing_columns_through_all_stages(spark, sf_dir):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)
    odd = spark.createDataFrame([(None, None), (None, "a b c"), (90001, None), (90002, ""), (90003, "one two"), (90003, "one two"), (90004, "One  two"), (90005, "long " * 50_000)], "doc_id long, text string")
    docs = docs.unionByName(odd, allowMissingColumns=True).withColumn("score", F.lit("s")).withColumn("sha", F.lit(1)).withColumn("kept_0", F.lit(2)).withColumn("hit", F.lit(3))
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != "encoding":
            assert docs.columns == columns
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    ids = [r.doc_id for r in docs.collect()]
    # Of the empty texts the smallest id stays, of the equal ones one row; classes of near copies keep their least.
    assert ids.count(90003) == 1 and 90001 in ids and 90002 not in ids and 90005 in ids
