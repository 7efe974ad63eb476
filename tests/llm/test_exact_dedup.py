import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from quillspark.llm.exact_dedup import Directory, _keyed, build_index, exact_dedup, keep_first, looked_up


def _brute(rows):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append(i)
    keep = {t: min((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    return sorted(((i, keep[norm(t)], len(groups[norm(t)]), i == keep[norm(t)], hashlib.sha256(norm(t).encode()).hexdigest()) for i, t in rows), key=repr)


def _rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("capacity", [1, 4, 256])
def test_against_brute_force(spark, capacity):
    rng = random.Random(capacity)
    rows = [(i, rng.choice(["hot text", f"text\t {rng.randrange(300)}", f"text {rng.randrange(300)}", f" {rng.randrange(50)}\r\n\v\f"])) for i in range(900)]
    assert _rows(exact_dedup(spark.createDataFrame(rows, "doc_id long, text string"), capacity=capacity)) == _brute(rows)


def test_nulls_repeats_clashes_long_and_empty(spark):
    long = "x y " * 300_000
    rows = [(1, None), (2, ""), (3, " "), (3, "\n"), (None, "a"), (None, "a"), (4, "a"), (None, "alone"), (5, long), (6, long.replace(" ", "\t")), (7, "é "), (7, "é "), (-8, "é ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit("k")).withColumn("keep_id", F.lit(1)).withColumn("sha", F.lit(1))
    assert _rows(exact_dedup(docs)) == _brute(rows)
    assert exact_dedup(docs.limit(0)).count() == 0
    kept = keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted([1, 3, 4, None, 5, -8], key=repr)


def test_directory_splits_and_doubles():
    rng, d = random.Random(3), Directory(capacity=4, skip=2)
    keys = [rng.getrandbits(62) for _ in range(2000)]
    for k in keys:
        d.insert(k, b"%d" % k, k, 1)
    assert all(d.bucket(k).chains[k] == [[b"%d" % k, k, 1]] for k in keys)
    found = list(dict.fromkeys(d.slots))
    assert sum(b.n for b in found) == len(keys) and all(b.n <= 4 for b in found) and len(d.slots) == 1 << d.depth
    same = Directory(capacity=2)
    for i in range(9):
        same.insert(5, b"%d" % i, i, 1)
    assert same.bucket(5).n == 9, "colliding keys chain beyond a bucket's size"


def test_buckets_split_on_bytes_and_are_handed_out_in_order():
    rng, d, out = random.Random(5), Directory(capacity=8, limit=1000), []
    keys = sorted(rng.getrandbits(64) for _ in range(500))
    for k in keys:
        out += d.passed(k)
        d.insert(k, b"x" * (k % 400), k, 1)
    out += d.passed(None)
    assert [k for b in out for k in b.chains] == keys
    assert all(b.n <= 8 and (b.size <= 1000 or b.n == 1) for b in out)


def test_colliding_hashes_are_told_apart_by_bytes():
    import pyarrow as pa

    from quillspark.llm.exact_dedup import _chains, _owner

    batch = pa.RecordBatch.from_arrays([pa.array([7, 7, 7], pa.int64()), pa.array(["a", "b", "a"]), pa.array([3, 2, 1], pa.int64())], ["key", "text", "doc_id"])
    chains = list(_chains(iter([batch])))[0]
    owned = chains.append_column("owner", pa.array([0] * len(chains), pa.int32()))
    got = [r for b in _owner(4, 3)(iter([owned])) for r in b.to_pylist() if r["what"] == "entry"]
    assert sorted((r["keep_id"], r["group_size"], r["chain"]) for r in got) == [(1, 2, 0), (2, 1, 1)]


def test_keepers_come_through_the_directory(spark):
    rows = [(i, f"text {i % 60}") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    index, keyed = build_index(docs, capacity=2), _keyed(docs, "doc_id", "text")
    assert index.filter("what = 'slot' AND slot > 0").count() > 0
    assert {r.doc_id: r.keep_id for r in looked_up(keyed, index).collect()} == {i: i % 60 for i, _ in rows}
    wrong = index.withColumn("bucket", F.when(F.col("what") == "slot", F.col("bucket") + 1).otherwise(F.col("bucket")))
    for broken in (wrong, index.filter("what = 'entry'")):
        with pytest.raises(Exception, match="has no entry"):
            looked_up(keyed, broken).collect()


def test_an_index_is_one_file_a_task(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "11")
    try:
        docs = spark.createDataFrame([(i, f"text {i % 60}") for i in range(200)], "doc_id long, text string")
        index = build_index(docs, capacity=2)
        assert len(index.inputFiles()) <= 16 == index.select("owner").distinct().count()
        assert {r.doc_id: r.keep_id for r in looked_up(_keyed(docs, "doc_id", "text"), index).collect()} == {i: i % 60 for i in range(200)}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
