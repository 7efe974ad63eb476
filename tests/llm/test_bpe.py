import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quillspark.llm.bpe import Bpe, PairTree, decode, encode, encode_report

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", "  ", "don't WE'LL o'clock 'sS", "Héllo  Wörld\n12½ ３ ٣", "éà ́x", "ΟΔΟΣ İstanbul ǅ", "a<|endoftext|>b <|startoftext|>", "<|endoftext", "\x1cx\x1f y\x85z w　v", "漢字 emoji 😀👍🏽!!!", "x" * 5000, " ​ ﻿", "\x00\x01", "ﬁ ß ſ", "aͅ ᾳ"]


@pytest.fixture(scope="module")
def theirs():
    return Tokenizer.from_file(PATH)


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(theirs, text):
    ids = theirs.encode(text, add_special_tokens=False).ids
    ours = Bpe(PATH)
    assert ours.encode(text) == ids
    assert ours.decode(ids) == theirs.decode(ids, skip_special_tokens=False)
    assert ours.both(text) == (" ".join(map(str, ids)), ours.decode(ids))


def test_random_words(theirs):
    rng, ours = random.Random(5), Bpe(PATH)
    for _ in range(300):
        text = "".join(rng.choice("abcdethinr éß'ñ1.<|") for _ in range(rng.randrange(60)))
        assert ours.encode(text) == theirs.encode(text, add_special_tokens=False).ids, text


def test_words_merged_side_by_side(theirs):
    rng, ours = random.Random(7), Bpe(PATH)
    words = list({"".join(rng.choice("abcdethinr") for _ in range(rng.choice([1, 2, 3, 5, 8, 9, 17, 64, 70]))) for _ in range(800)}) + ["éß", "漢字"]
    got = dict(ours.merge_all(words))
    assert got == {x: ours.merge(x) for x in words} == {x: theirs.encode(x, add_special_tokens=False).ids for x in words}


@pytest.mark.parametrize("cache", [4, 400_000])
def test_plain_texts_go_through_the_pieces(theirs, monkeypatch, cache):
    from quillspark.llm import bpe

    monkeypatch.setattr(bpe, "CACHE", cache)
    ours = Bpe(PATH)
    texts = ["Plain  words,\tplain WORDS.\n", "don't\u00a0stop at w\u3000x12", *(f"word{i} text {i % 3} again" for i in range(20))]
    want = [theirs.encode(x, add_special_tokens=False).ids for x in texts]
    monkeypatch.setattr(ours, "encode", None)  # the way of texts with special tokens or odd blanks
    assert list(ours.both_all(texts)) == [(" ".join(map(str, x)), ours.decode(x)) for x in want]
    assert 0 < len(ours.pieces) <= cache


def test_tree_gives_leftmost_lowest():
    rng = random.Random(1)
    for n in (1, 2, 3, 7, 16, 33):
        values = [rng.randrange(9) * n + i for i in range(n)]
        tree = PairTree(list(values))
        for _ in range(60):
            assert tree.root() == min(values)
            at = rng.randrange(n)
            values[at] = rng.randrange(9) * n + at
            tree.put(at, values[at])


def test_table_and_round_trip(spark, sf_dir, theirs):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in encode_report(docs, PATH).collect():
        got = theirs.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(got) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, got)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(theirs.decode(got, skip_special_tokens=False).encode()).hexdigest()
    some = docs.limit(20)
    for r in decode(encode(some, PATH), PATH).collect():
        assert r.text == theirs.decode(theirs.encode(texts[r.doc_id], add_special_tokens=False).ids, skip_special_tokens=False)


def test_nulls_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, None, 5), (1, "", 6), (None, "a b", 7)], "doc_id long, text string, n_tokens int")
    rows = sorted(encode_report(docs, PATH).collect(), key=lambda r: r.n_tokens)
    empty = hashlib.sha256(b"").hexdigest()
    assert [(r.doc_id, r.n_tokens) for r in rows] == [(1, 0), (1, 0), (None, 2)] and rows[0].ids_sha256 == empty == rows[0].decoded_sha256
    assert encode_report(docs.limit(0), PATH).count() == 0
