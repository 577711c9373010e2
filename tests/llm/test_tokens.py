"""Encoding, decoding and packing."""

import os
import random

import numpy as np
import pytest

from sensorframe.llm import packing as P
from sensorframe.llm import tokens as T

pytestmark = pytest.mark.skipif(not os.path.exists(T.vocabulary_path()), reason="no public vocabulary")
TEXTS = [None, "", " ", "\n\n\t \n", "It's a test, isn't it?", "  two  spaces and　more ", "日本語のテキスト。", "नमस्ते दुनिया", "مرحبا بالعالم", "👩‍👧👨‍👩‍👧 🇺🇳!", "<|endoftext|> is text", "x" * 20_000, "‮right‬", "a\r\nb c\x1c\x1d", "word " * 50_000, "It's a test, isn't it?"]


def test_encode_matches_the_public_tokenizers(spark, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(T, "BLOCK_WORDS", 12)  # many blocks
    rng = random.Random(0)
    texts = TEXTS + ["".join(rng.choice(["a", "é", " ", "1", "'s", "\n", "字", "!", "😀"]) for _ in range(rng.randrange(60))) for _ in range(200)]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], "doc_id long, text string, block int, word string").repartition(3)
    got = {r.doc_id: list(r.ids) for r in T.encode_corpus(df).collect()}
    enc = T.encoder(T.vocabulary_path())
    assert got == {i: enc.encode_ordinary(t or "") for i, t in enumerate(texts)}
    path = T.vocabulary_path().replace(".tiktoken", ".json")
    if os.path.exists(path):
        hf = Tokenizer.from_file(path)
        hf.encode_special_tokens = True
        assert all(got[i] == hf.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(texts))
    assert {r.doc_id: r.n_tokens for r in T.token_lengths(df).collect()} == {i: len(x) for i, x in got.items()}


def test_a_document_of_very_many_words(spark):
    text = " ".join(f"w{i}" for i in range(70_000))
    got = T.encode_corpus(spark.createDataFrame([(1, "before"), (2, text), (3, "after")], "doc_id long, text string")).collect()
    enc = T.encoder(T.vocabulary_path())
    assert {r.doc_id: list(r.ids) for r in got} == {1: enc.encode_ordinary("before"), 2: enc.encode_ordinary(text), 3: enc.encode_ordinary("after")}


def test_repeated_ids_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (1, None)], "doc_id long, text string")
    assert sorted(len(r.ids) for r in T.encode_corpus(df).collect()) == [0, 2, 2]
    assert T.encode_corpus(df.where("false")).collect() == []


def test_each_word_is_encoded_once(spark):
    """The rows between the shuffles hold one row for each word and block, never one for each occurrence."""
    df = spark.createDataFrame([(i, "the same words again and again " * 50) for i in range(200)], "doc_id long, text string").coalesce(2)
    rows = df.mapInArrow(T._split, T.ROUTED).collect()
    assert sum(r.word is not None for r in rows) <= 2 * len(set("the same words again and".split())) + 6


def test_round_trip(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    back = {r.doc_id: r.text for r in T.decode_ids(T.encode_corpus(df)).collect()}
    assert back == {i: t or "" for i, t in enumerate(TEXTS)}


# packing ------------------------------------------------------------------------------------------------------------


def check(spark, lengths, capacity=2048, unit=4, **k):
    df = spark.createDataFrame([(i, n, "x") for i, n in enumerate(lengths)], "doc_id long, n_tokens long, class string")
    rows = P.pack(df, capacity, unit, **k).collect()
    load, pieces = {}, {}
    for r in rows:
        assert 0 <= r.n_tokens <= capacity and r.container_id is not None
        load[r.container_id] = load.get(r.container_id, 0) + r.n_tokens
        pieces.setdefault(r.doc_id, []).append((r.piece, r.token_start, r.n_tokens))
    assert max(load.values(), default=0) <= capacity
    assert len(pieces) == len(lengths)
    for i, n in enumerate(lengths):
        ps, n = sorted(pieces[i]), n or 0
        assert sum(p[2] for p in ps) == n and [p[1] for p in ps] == [capacity * p[0] for p in ps]
        assert len(ps) == max(1, -(-n // capacity))
    return sum(x or 0 for x in lengths) / (len([v for v in load.values() if v]) * capacity) if any(lengths) else 0


def test_pack(spark):
    r = np.random.default_rng(0)
    lengths = [int(x) for x in np.minimum(r.lognormal(5.8, 1.1, 4000), 30_000)] + [0, None, 2048, 2049, 4096, 1, 100_000]
    assert check(spark, lengths) > 0.985


def test_pack_awkward(spark):
    assert check(spark, [1025] * 300) > 0.5
    assert check(spark, [700] * 3001 + [20] * 900) > 0.68  # two of 700 a container is the best there is
    assert check(spark, [0, None, 0]) == 0
    assert check(spark, [5] * 1000, capacity=64, unit=1) > 0.9
    assert P.pack(spark.createDataFrame([], "doc_id long, n_tokens long")).collect() == []


def test_pack_needs_few_containers_more_than_the_least():
    r = np.random.default_rng(3)
    h = np.bincount(np.clip((r.lognormal(4.0, 0.9, 50_000)).astype(int) + 1, 1, 512), minlength=513)
    plan = P.plan_containers(h, 512)
    assert all(plan.used.get(s, 0) == n for s, n in enumerate(h) if s)
    assert plan.containers <= 1.002 * -(-int((h * np.arange(513)).sum()) // 512) + 1


def test_patterns_fit_the_histogram():
    h = np.zeros(17, np.int64)
    h[[4, 12, 8]] = [100, 100, 60]
    patterns, repeats = P.fit_patterns(h, 16)
    assert ((repeats @ patterns) <= h).all() and (repeats @ patterns).sum() >= 0.9 * h.sum()
    assert all((p @ np.arange(17)) == 16 for p in patterns)
