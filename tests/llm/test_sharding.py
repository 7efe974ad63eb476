import random
from collections import Counter, defaultdict
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from quillspark.llm.sharding import kd_shards, shard


def _check(docs, rows, shards=8, near=0.02):
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    assert len(rows) == docs.count()
    size, slots, homes = Counter(), defaultdict(list), defaultdict(set)
    for r in rows:
        assert r["size"] == len(texts[r.doc_id].encode()) + 1 and r.text_crc32 == crc32(texts[r.doc_id].encode()) and r.law == "bytes"
        size[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
        homes[texts[r.doc_id]].add(r.shard)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert all(len(x) == 1 for x in homes.values()), "equal texts are never parted"
    if near:
        assert max(size.values()) - min(size[i] for i in range(shards)) <= near * sum(size.values())


def test_tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    _check(docs, shard(docs).collect(), near=0.04)


def test_nulls_ties_empty_and_clashing_columns(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "a", None), (3, "a", "y"), (4, "é" * 500, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string").withColumn("size", F.lit(7))
    _check(docs, shard(docs).collect(), near=None)
    assert shard(docs.limit(0)).count() == 0
    assert shard(docs.withColumn("doc_id", F.lit(None).cast("long"))).count() == 5


def test_hot_group_stays_whole(spark):
    docs = spark.range(900).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("hot " * 20)).otherwise(F.concat(F.lit("text " * 12), F.col("id").cast("string"))).alias("text"))
    rows = shard(docs).collect()
    _check(docs, rows, near=None)
    assert len({r.shard for r in rows}) == 8


@pytest.mark.parametrize("shards", [1, 3, 5])
def test_numbers_of_shards(spark, shards):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text " * 10), F.col("id").cast("string")).alias("text"))
    n = kd_shards(docs, shards).groupBy("shard").count().collect()
    assert len(n) == shards and max(r["count"] for r in n) - min(r["count"] for r in n) < 120


def test_main_path_is_native(spark, sf_dir):
    plan = shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_a_thousand_shards_by_target_bytes(spark):
    rng = random.Random(5)
    rows = [(i, "x" * rng.randrange(50, 400) + str(i), rng.choice(["en", "fr", "de"]), rng.choice("abcdef")) for i in range(20_000)]
    rows += [(20_000 + i, "the same text " * 20, "en", "a") for i in range(40)]  # one group that is larger than a shard
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    total = sum(len(r[1]) + 1 for r in rows)
    got = shard(docs, target_bytes=total // 999).collect()
    sizes, slots, where = {}, {}, {}
    for r in got:
        sizes[r.shard] = sizes.get(r.shard, 0) + r.size
        slots.setdefault(r.shard, []).append(r.slot)
        where.setdefault(r.doc_id if r.doc_id < 20_000 else -1, set()).add(r.shard)
    assert len(got) == len(rows) and sorted(sizes) == list(range(1000)) and all(len(x) == 1 for x in where.values())
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    large = where[-1].pop()
    rest = [n for k, n in sizes.items() if k != large]
    assert sizes[large] == 40 * 281 and max(rest) < 1.35 * total / 1000 and min(rest) > 0.65 * total / 1000


def test_very_long_texts_are_shards_of_their_own(spark):
    rows = [(1, "y" * 3_000_000), (2, "z" * 2_000_000), *[(i, f"w{i} " * 50) for i in range(3, 400)]]
    got = shard(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    by_shard = {}
    for r in got:
        by_shard.setdefault(r.shard, []).append(r)
    assert len(got) == len(rows) and len(by_shard) == 8
    assert sum(len(x) == 1 and x[0].doc_id in (1, 2) for x in by_shard.values()) == 2
    rest = [sum(r.size for r in x) for x in by_shard.values() if len(x) > 1]
    assert max(rest) < 1.1 * min(rest)
