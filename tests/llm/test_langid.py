import os
import zlib
from collections import Counter

import numpy as np
import pytest

from strandsift.llm import langid

SF = "/root/testdata/sf0.01"
EN = "the cat and the dog are walking to the old house with their friends because it is a nice day "
DE = "der hund und die katze gehen zu dem alten haus mit ihren freunden weil es ein schöner tag ist "


def corpus():
    rows = [(i, EN * (1 + i % 3), "en") for i in range(30)] + [(100 + i, DE * (1 + i % 3), "de") for i in range(30)]
    return rows + [(500, None, "en"), (501, "", None), (502, "123 !? 456", "de"), (503, EN, None), (504, DE.upper() * 700, "de"), (None, DE, None), (3, EN, "en"), (505, EN * 6 + DE * 3, None)]


@pytest.fixture(scope="module")
def documents(spark):
    return spark.createDataFrame([(*r, 1.5, "n") for r in corpus()], "doc_id long, text string, lang string, score double, bucket string")


def test_identify(documents):
    found = langid.identify(documents).collect()
    rows = corpus()
    assert Counter(r.doc_id for r in found) == Counter(i for i, _, _ in rows)
    by_id = {r.doc_id: r for r in found}
    for i, text, _ in rows:
        r = by_id[i]
        assert r.held_out == (zlib.crc32(b"" if i is None else str(i).encode()) % 5 == 0)
        assert 0 <= r.score <= 1
        if not any(c.isalpha() for c in text or ""):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        else:
            assert r.lang_pred == ("en" if text.lower().startswith("the") else "de")
    assert by_id[505].n_languages == 2
    assert by_id[505].score == pytest.approx(2 / 3, abs=0.05)
    assert by_id[0].n_languages == 1


def test_held_out_rows_do_not_teach(spark, documents):
    model = langid.train(documents.where(~langid.held_out()))
    other = documents.where(~langid.held_out()).unionByName(spark.createDataFrame([(999, "zzz", None, 0.0, "")], documents.schema))
    same = langid.train(other)
    assert model[0] == same[0] == ["de", "en"]
    assert np.array_equal(model[1], same[1])


def test_stage(documents):
    kept = langid.keep_known(documents)
    assert kept.columns == documents.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(i for i, t, _ in corpus() if any(c.isalpha() for c in t or ""))


def test_nothing_to_learn(spark):
    df = spark.createDataFrame([(1, "words", None)], "doc_id long, text string, lang string")
    assert [r.lang_pred for r in langid.identify(df).collect()] == ["und"]
    assert langid.identify(df.where("false")).count() == 0
    assert langid.keep_known(df.where("false")).count() == 0


def test_blocks_are_whole_texts(monkeypatch):
    text = (EN + DE).encode()
    whole = [np.concatenate(x) for x in zip(*langid.trigrams(text), strict=True)][0]
    monkeypatch.setattr(langid, "BLOCK", 1 << 20)
    assert len(whole) == sum(c.isalpha() for c in EN + DE)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    langs = {r.doc_id: r.lang for r in docs.collect()}
    own = [r for r in langid.identify(docs).collect() if r.held_out]
    assert sum(r.lang_pred == langs[r.doc_id] for r in own) / len(own) > 0.98


def test_blocks_end_between_words(monkeypatch):
    """Blocks of any size give the trigrams and words of the whole text."""
    text = (EN + "donaudampfschifffahrtsgesellschaft " * 3 + DE + "x" * 40 + " 12 é").encode()
    found, first = (np.concatenate(x) for x in zip(*langid.trigrams(text), strict=True))
    words = np.diff(np.r_[first, len(found)])
    for size in (1, 3, 7, 50):
        monkeypatch.setattr(langid, "BLOCK", size)
        parts = list(langid.trigrams(text))
        assert np.array_equal(np.concatenate([x for x, _ in parts]), found)
        assert np.array_equal(np.concatenate([np.diff(np.r_[y, len(x)]) for x, y in parts]), words)


def plain_infer(text, table):
    """The same inference word by word, in plain loops."""
    import math
    import re

    def bucket(a, b, c):
        h = (a * 0x9E3779B1 ^ b * 0x85EBCA77 ^ c * 0xC2B2AE3D) & 0xFFFFFFFF
        h = (h ^ h >> 15) * 0x2C1B3C6D & 0xFFFFFFFF
        return h >> 16

    words = []
    for word in re.findall(r"[^\W\d_]+", text.lower()):
        codes = [0, *map(ord, word), 0]
        log = [sum(float(table[bucket(*codes[i : i + 3])][k]) for i in range(len(word))) for k in range(table.shape[1])]
        words.append([math.exp(x - max(log)) + 1e-12 for x in log])

    def em(of):
        share = [1 / len(of)] * len(of)
        for _ in range(langid.STEPS if len(of) > 1 else 0):
            new = [0.0] * len(of)
            for p in words:
                joint = [p[k] * s for k, s in zip(of, share, strict=True)]
                new = [x + j / sum(joint) / len(words) for x, j in zip(new, joint, strict=True)]
            moved, share = max(abs(x - y) for x, y in zip(new, share, strict=True)), new
            if moved < 1e-4:
                break
        return share, sum(math.log(sum(p[k] * s for k, s in zip(of, share, strict=True))) for p in words)

    every, _ = em(list(range(table.shape[1])))
    order = sorted(range(len(every)), key=lambda k: (-every[k], k))
    order = order[: max(1, sum(x > 0.5 / len(words) for x in every))]
    best = max(((em(order[:k]), k) for k in range(1, len(order) + 1)), key=lambda x: x[0][1] - langid.PENALTY * (x[1] - 1) * math.log(len(words) + 1))
    out = [0.0] * table.shape[1]
    for k, x in zip(order, best[0][0], strict=False):
        out[k] = x
    return out


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_inference_against_plain_loops(spark):
    """On texts of the tables and mixtures of them."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    _, table = langid.train(docs.where(~langid.held_out()))
    texts = [r.text for r in docs.orderBy("doc_id").limit(400).collect() if r.text and len(r.text) < 1500][:25]
    texts += [x + " " + y for x, y in zip(texts[:12], texts[12:24], strict=True)]
    for text in texts:
        assert langid.infer(text.encode(), table) == pytest.approx(plain_infer(text, table), abs=2e-3)


def test_many_languages(spark, monkeypatch):
    """The table's size is bounded: with more languages, trigrams share buckets."""
    df = spark.createDataFrame([(i, " ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26)}{chr(97 + j)}" for j in range(20)), f"l{i:03d}") for i in range(150)] * 2, "doc_id long, text string, lang string")
    monkeypatch.setattr(langid, "HELD", 7)
    langs, whole = langid.train(df)
    monkeypatch.setattr(langid, "MOST_CELLS", 150 * 5000)
    fewer = langid.train(df)
    assert langs == fewer[0] == [f"l{i:03d}" for i in range(150)]
    assert whole.shape == (1 << 16, 150)
    assert fewer[1].shape == (4096, 150)
    found = langid.with_language(df.dropDuplicates(["doc_id"]).drop("doc_id"), fewer).collect()
    assert sum(r.lang == r.lang_pred for r in found) > 140
