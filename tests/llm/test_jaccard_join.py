import os
import random
import re
from fractions import Fraction
from math import comb

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm.components import components
from quillspark.llm.jaccard_join import jaccard_classes, keep_one, least_matches, least_recurring, prefix_lengths
from quillspark.session import shared_dir


def _set(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def _brute(rows, t=0.8):
    texts = {}
    for i, x in rows:
        texts.setdefault(x or "", []).append(i)
    reps = {min(ids): _set(x) for x, ids in texts.items()}
    links = {r: [q for q in reps if q != r and reps[q] and len(reps[r] & reps[q]) >= t * len(reps[r] | reps[q]) - 1e-9 and reps[r]] for r in reps}
    seen = {}
    for r in sorted(reps):
        stack = [r]
        while stack:
            x = stack.pop()
            if x not in seen:
                seen[x] = r
                stack += links[x]
    return sorted((i, seen[min(ids)], len(links[min(ids)]), len(ids)) for ids in texts.values() for i in ids)


def _corpus(seed, n=150):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(300)] + ["É", "ß"]
    base, rows = [], []
    passage = [rng.choice(vocabulary) for _ in range(25)]
    for i in range(n):
        kind = rng.random()
        if base and kind < 0.6:
            words = list(rng.choice(base))
            for _ in range(rng.randrange(0, 4)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
        else:
            words = [rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 4, 5, 6, 20, 60, 150]))] + passage * (kind > 0.8)
            base.append(words)
        rows.append((i, rng.choice([" ", ", "]).join(words)))
    return rows


@pytest.mark.parametrize(("seed", "block"), [(1, 512), (2, 7), (3, 40)])
def test_against_brute_force(spark, seed, block):
    rows = _corpus(seed)
    got = sorted(map(tuple, jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string"), block=block).collect()))
    assert got == _brute(rows) and any(r[2] for r in got)


def test_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = sorted(map(tuple, jaccard_classes(docs).collect()))
    assert got == _brute(rows)
    kept = keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted({r[1] for r in got})


def test_nulls_repeats_clashes_and_empty_tables(spark):
    rows = [(1, None), (2, ""), (3, "a b"), (4, "A, b"), (None, "a b"), (None, "x y"), (5, "!!"), (6, "!!"), (6, "!!")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("rep", F.lit(1)).withColumn("n", F.lit("n")).withColumn("gone", F.lit(2))
    got = sorted(map(tuple, jaccard_classes(docs).collect()), key=repr)
    assert got == sorted([(1, 1, 0, 2), (2, 1, 0, 2), (3, 3, 1, 2), (4, 3, 1, 1), (None, 3, 1, 2), (None, None, 0, 1), (5, 5, 0, 3), (6, 5, 0, 3), (6, 5, 0, 3)], key=repr)
    assert jaccard_classes(docs.limit(0)).count() == 0
    assert keep_one(docs).columns == docs.columns


def test_pruning_bounds():
    for t in (0.5, 0.8, 0.95):
        for n, m in least_matches(t):
            assert 0 <= m <= n
    assert least_matches(0.8, tolerance=0) == [(n, 0) for n in (16, 32, 48, 64)]
    share = Fraction(3, 5)

    def chance(n, c):  # exactly
        return sum(comb(n + 1, k) * share**k * (1 - share) ** (n + 1 - k) for k in range(c + 1))

    for n in (1, 5, 30, 200, 700):
        least = least_recurring(n)
        assert 1 <= least <= n and chance(n, least) >= 1e-9 and (least == 1 or chance(n, least - 1) < 1e-9)
    assert least_recurring(5) == 1 and least_recurring(200) > 40
    sizes = np.array([1, 2, 4, 5, 6, 10, 101])
    assert prefix_lengths(sizes, 0.8).tolist() == [1, 1, 1, 2, 2, 3, 21]


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 200)] + [(500, k) for k in range(501, 560)] + [(rng.randrange(1000, 1100), rng.randrange(1000, 1100)) for _ in range(70)] + [(7, 7)]
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    import sys

    sys.setrecursionlimit(5000)
    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    loops = {a for a, b in edges if a == b} - {x for a, b in edges if a != b for x in (a, b)}
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root if x not in loops}


def test_very_long_texts_and_large_clusters(spark):
    rng = random.Random(12)
    long = [f"w{rng.randrange(5000)}" for _ in range(40_000)]
    other = list(long)
    for k in range(0, 40_000, 1000):
        other[k] = "changed"
    base = [f"b{k}" for k in range(400)]
    rows = [(1, " ".join(long)), (2, " ".join(other)), (3, "x" * 300_000)]
    for i in range(300):  # near copies of one text, in several blocks
        words = list(base)
        words[i] = f"own{i}"
        rows.append((10 + i, " ".join(words)))
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == (1, 1) and got[2] == (1, 1) and got[3] == (3, 0)
    assert all(got[10 + i] == (10, 299) for i in range(300))


def test_few_files(spark):
    """Each file, checksum file and folder in a local folder costs a process, which shows the executor's memory again."""
    conf = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    root = shared_dir(spark).removeprefix("file://")
    old = set(os.listdir(root))
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        rows = _corpus(5)
        kept = keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(40)).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted(r.doc_id for r in kept) == sorted({r[1] for r in _brute(rows)}) and len(kept) < len(rows)
    made = {d: os.listdir(f"{root}/{d}") for d in set(os.listdir(root)) - old}
    assert {d.rsplit("-", 1)[0] for d in made} >= {"copies", "shingles", "recurring", "promising", "sets", "prefixes", "first", "stars", "least", "links", "classes", "gone"}
    assert all(x.startswith("part-") for names in made.values() for x in names)
    assert all(len(names) <= 10 for d, names in made.items() if not d.startswith("links-"))
