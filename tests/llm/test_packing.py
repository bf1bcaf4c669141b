import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from strandsift.llm import packing
from strandsift.llm.packing import best_fit_plan, pack_documents, token_pieces, vocabulary_path


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(vocabulary_path())


ODD = ["", "  ", "It's ''s don't ²½ 3a1", "Ünïcödé ÀÉ naïve ªº", "Σας ΟΔΟΣ", "日本語 123abc 😀", "a\x85b\xa0c\x1cd", "İI ŉ ǅ", "é Å", "<|endoftext|> x", "One<|startoftext|>two\n<|endoftext|><|endoftext|> end<|END|> of é", "a" * 5000, "x​y﻿z", "tab\tnew\r\nline"]


@pytest.mark.parametrize("text", ODD)
def test_ids_are_the_tokenizers(tokenizer, text):
    found = packing.WordTokenizer(vocabulary_path())(text)
    assert np.frombuffer(found, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(text=st.text(max_size=80))
def test_ids_of_any_text(text):
    own = packing._tokenizer(vocabulary_path())
    assert np.frombuffer(own(text), "<u4").tolist() == own.tokenizer.encode(text, add_special_tokens=False).ids


def test_cache_runs_over(tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "KEPT", 10)
    monkeypatch.setattr(packing, "RECENT", 10)
    own = packing.WordTokenizer(vocabulary_path())
    for text in ["one two three four five six", "seven eight nine ten eleven twelve, one two", "three four thirteen fourteen - one"] * 3:
        assert np.frombuffer(own(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_many_texts_at_once(tokenizer):
    texts = [*ODD, None, "", "One, one. ONE", *ODD]
    found = packing.WordTokenizer(vocabulary_path()).many(pa.array(texts, pa.string()))
    assert [np.frombuffer(x, "<u4").tolist() for x in found] == [tokenizer.encode(x or "", add_special_tokens=False).ids for x in texts]
    assert packing.WordTokenizer(vocabulary_path()).many(pa.array([], pa.string())) == []


def fill(counts, capacity):
    """Bins by the plan: a list of (offset, length) for each."""
    plan, total = best_fit_plan(counts, capacity)
    bins = {}
    for length, n in counts.items():
        own = [r for r in plan.tolist() if r[0] == length]
        for rank in range(n):
            _, first, start, each, base = [r for r in own if r[1] <= rank][-1]
            bins.setdefault(start + (rank - first) // each, []).append((base + (rank - first) % each * length, length))
    assert len(bins) == total
    return list(bins.values())


def best_fit(counts, capacity):
    """Piece by piece."""
    rooms = []
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            fitting = [i for i, r in enumerate(rooms) if r >= length]
            if fitting:
                rooms[min(fitting, key=lambda i: rooms[i])] -= length
            else:
                rooms.append(capacity - length)
    return sorted(rooms)


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 12), max_size=12))
def test_plan_is_best_fit(counts):
    bins = fill(counts, 40)
    assert sorted(40 - sum(n for _, n in x) for x in bins) == best_fit(counts, 40)
    for x in bins:
        at = 0
        for offset, length in sorted(x):
            assert offset == at
            at += length


def check(df, rows, capacity, tokenizer):
    got = df.collect()
    expected = []
    for key, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            expected.append((key, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == Counter(expected)
    places = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for x in places.values():
        at = 0
        for offset, length in sorted(x):
            assert offset == at
            at += length
        assert at <= capacity
    return len(places)


def test_documents(spark, tokenizer):
    texts = [*ODD, None, "same text here", "same text here", "word " * 300]
    rows = list(enumerate(texts)) + [(None, "no id"), (3, "again"), (3, "again")]
    docs = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], "doc_id long, text string, piece int, offset string, length long")
    n = check(pack_documents(docs, capacity=64), rows, 64, tokenizer)
    total = sum(len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in rows)
    assert n == -(-total // 64)


def test_ids_are_kept(spark, tokenizer):
    docs = spark.createDataFrame([(1, "one two three " * 30)], "doc_id long, text string")
    pieces = token_pieces(docs, capacity=16).orderBy("piece").collect()
    assert [x for r in pieces for x in r.ids] == [*tokenizer.encode("one two three " * 30, add_special_tokens=False).ids, 1]


def test_hot_length(spark, tokenizer, monkeypatch):
    """One length has nearly all rows, and its ranks are counted in many buckets."""
    monkeypatch.setattr(packing, "spread_over", lambda spark, rows: 7)
    rows = [(i, "the same words") for i in range(500)] + [(1000 + i, "a b " * i) for i in range(20)]
    check(pack_documents(spark.createDataFrame(rows, "doc_id long, text string"), capacity=50), rows, 50, tokenizer)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert pack_documents(docs).count() == 0


def test_rows_without_ids(spark, tokenizer, monkeypatch):
    """Many equal rows without an id are dealt over the buckets."""
    monkeypatch.setattr(packing, "spread_over", lambda spark, rows: 8)
    rows = [(None, "the same words")] * 400 + [(7, "the same words")] * 400
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    check(pack_documents(df, capacity=50), rows, 50, tokenizer)
