import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from quillspark.llm.substring_dedup import duplicate_spans, remove_spans, substring_report


def _brute(rows, width=13):
    big = 1 << 70
    split = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    first = {}
    for i, w in split:
        for k in range(len(w) - width + 1):
            g = tuple(w[k : k + width])
            first[g] = min(first.get(g, big), big if i is None else i)
    out = []
    for i, w in split:
        gone = set()
        for k in range(len(w) - width + 1):
            if first[tuple(w[k : k + width])] < (big if i is None else i):
                gone.update(range(k, k + width))
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()))
    return sorted(out, key=repr)


def _corpus(seed, n=120):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)] + ["a", "b", "é", "漢字"]
    passages = [[rng.choice(vocabulary) for _ in range(rng.randrange(10, 40))] for _ in range(8)]
    rows = []
    for i in range(n):
        words = []
        for _ in range(rng.randrange(0, 5)):
            words += rng.choice(passages) if rng.random() < 0.5 else [rng.choice(vocabulary) for _ in range(rng.randrange(1, 30))]
        rows.append((i, rng.choice([" ", "\n", "  ", "\t"]).join(words)))
    return rows


@pytest.mark.parametrize(("seed", "block"), [(1, 1 << 23), (2, 2000), (3, 300)])
def test_against_brute_force(spark, seed, block):
    rows = _corpus(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, substring_report(docs, block_bytes=block).collect()), key=repr) == _brute(rows)


def test_tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = sorted(map(tuple, substring_report(docs).collect()), key=repr)
    assert got == _brute([(r.doc_id, r.text) for r in docs.collect()]) and sum(r[2] for r in got) > 0


def test_nulls_repeats_clashes_and_empty_tables(spark):
    long = " ".join(f"x{k}" for k in range(30))
    rows = [(5, long), (None, long), (None, None), (5, long + " y"), (6, ""), (7, None), (3, "word " * 40), (9, long), (8, "a  b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("block", F.lit("b")).withColumn("spans", F.lit(1))
    assert sorted(map(tuple, substring_report(docs).collect()), key=repr) == _brute(rows)
    assert substring_report(docs.limit(0)).count() == 0


def test_very_long_text(spark):
    rows = [(2, " ".join(f"k{k % 5000}" for k in range(60_000))), (1, " ".join(f"k{k}" for k in range(100, 200))), (3, "x" * 200_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, substring_report(docs, block_bytes=1000).collect()), key=repr) == _brute(rows)


def test_spans_and_removed_texts(spark):
    passage = " ".join(f"p{k}" for k in range(20))
    docs = spark.createDataFrame([(1, f"a b {passage} c"), (2, f"x {passage} y z")], "doc_id long, text string")
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in duplicate_spans(docs).collect()}
    assert got == {1: [], 2: [(1, 20, 1)]}
    assert {r.doc_id: r.text for r in remove_spans(docs).collect()} == {1: f"a b {passage} c", 2: "x y z"}


def test_negative_ids_take_part(spark):
    long = " ".join(f"x{k}" for k in range(20))
    rows = [(-5, long), (3, long), (-1, f"a {long}"), (None, long)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, substring_report(docs).collect()), key=repr) == _brute(rows)


@pytest.mark.parametrize("bits", [4, 9, 16])
def test_colliding_hashes_change_nothing(spark, bits):
    rows = _corpus(7)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, substring_report(docs, block_bytes=2000, bits=bits).collect()), key=repr) == _brute(rows)


def test_spans_stand_as_one_run_in_their_documents(spark):
    rows = _corpus(11, 80)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    text = {i: " " + " ".join(t.split()) + " " for i, t in rows}
    found = [(r.doc_id, s) for r in duplicate_spans(docs, block_bytes=2000).collect() for s in r.spans]
    assert found
    for i, s in found:
        words = text[i].split()[s.start : s.start + s.words]
        assert len(words) == s.words >= 13 and s.ref < i and f" {' '.join(words)} " in text[s.ref]


def test_removed_texts_of_repeated_rows_and_nulls(spark):
    passage = " ".join(f"p{k}" for k in range(20))
    rows = [(1, passage), (2, f"x {passage} y"), (2, f"x {passage} y"), (None, f"z {passage}"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, remove_spans(docs).collect()), key=repr) == sorted([(1, passage), (2, "x y"), (2, "x y"), (None, "z"), (None, "")], key=repr)


def _words(*texts):
    import pyarrow as pa

    from quillspark.llm.substring_dedup import Block

    return Block(pa.table({"doc_key": pa.array(range(len(texts)), pa.int64()), "text_key": pa.array([0] * len(texts), pa.int64()), "text": list(texts)}), 3, 2)


def test_factors_are_extended_and_looked_up_again_at_their_ends():
    import numpy as np
    import pyarrow as pa

    from quillspark.llm.substring_dedup import Reference, common_words, factors

    block = _words("a b c d e  f g x")
    cells = pa.table({"ref": pa.array([0, 1], pa.int32()), "cell": pa.array([0, 0], pa.int32()), "words": pa.array([b"z a b c d q d e f", b"d e f g h"], pa.binary()), "cuts": pa.array([np.array([6], np.int32).tobytes(), b""], pa.binary())})
    reference = Reference(cells, 0)
    assert common_words(block, 0, reference, 1, 5) == 4
    seeds, places = np.array([0, 1, 3, 4]), reference.places(np.array([0, 0, 1, 1]), np.array([1, 2, 0, 1]))
    assert factors(block, 0, seeds, np.array([7, 7, 8, 8]), places, reference) == ([(0, 4, 7), (3, 4, 8)], 0)
    # A reference that holds other words gives no factor, and is told of.
    assert factors(block, 0, np.array([0]), np.array([7]), np.array([0]), reference) == ([], 1)
    # A match ends where the reference's document does.
    assert factors(block, 0, np.array([3]), np.array([7]), reference.places(np.array([0]), np.array([6])), reference) == ([(3, 3, 7)], 0)


def test_matches_go_on_over_cells_whatever_the_blanks(spark):
    words = [f"x{k}" for k in range(1000)]
    rows = [(1, " ".join(words)), (2, "\n".join(words)), (3, "y " + "  ".join(words[100:700]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in duplicate_spans(docs, block_bytes=2000).collect()}
    assert got == {1: [], 2: [(0, 1000, 1)], 3: [(1, 600, 1)]}
