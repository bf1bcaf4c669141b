import os
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandsift.llm import weak_labels as w

SF = "/root/testdata/sf0.1"


def area(score, label):
    """Area under the ROC curve."""
    order = np.argsort(np.argsort(score)) + 1
    good = label == 1
    return (order[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum())


def test_estimate_finds_accuracies():
    """Good and bad texts of known kinds, noisy votes: EM's accuracies come near the true ones, and its posteriors separate."""
    rng = np.random.default_rng(0)
    m = len(w.LABELLERS)
    counts, truth = Counter(), {}
    right = np.zeros((m, 2))
    cast_all = np.zeros((m, 2))
    for _ in range(20_000):
        kind = rng.integers(m) if rng.random() < 0.2 else -1
        cast = [w.BAD if (i == kind and rng.random() < 0.9) or rng.random() < 0.01 else w.NONE if rng.random() < 0.1 else w.GOOD for i in range(m)]
        key = w.pattern(cast)
        counts[key] += 1
        truth.setdefault(key, []).append(kind < 0)
        for i, v in enumerate(cast):
            if v != w.NONE:
                cast_all[i, v] += 1
                right[i, v] += (kind < 0) == (v == w.GOOD)
    posterior, accuracy, share = w.estimate(counts)
    assert share == pytest.approx(0.8, abs=0.06)
    assert np.abs(accuracy - right / cast_all)[:, w.BAD].mean() < 0.12
    right_now = sum(sum((posterior[k] >= 0.5) == x for x in v) for k, v in truth.items())
    best = sum(max(sum(v), len(v) - sum(v)) for v in truth.values())  # of anyone who knows each pattern's true share
    assert right_now > 0.98 * best


def test_estimate_of_nothing():
    assert w.estimate({})[0] == {}


def test_texts(spark):
    clean = [(i, " ".join(f"word{(i * 7 + j) % 211}" for j in range(40)) + ".") for i in range(200)]
    junk = [(1000 + i, " ".join(f"w{(i + j) % 97}***" for j in range(40))) for i in range(30)]
    rows = [*clean, *junk, (2000, None), (2001, ""), (None, clean[0][1]), (3, clean[3][1]), (2002, clean[0][1] * 2000)]
    df = spark.createDataFrame([(*r, "v", 2.0) for r in rows], "doc_id long, text string, votes string, score double")
    found = w.classify(df).collect()
    assert Counter(r.doc_id for r in found) == Counter(i for i, _ in rows)
    for r in found:
        assert 0 <= r.score <= 1
        assert r.kept == (r.score >= 0.5)
    by_id = {r.doc_id: r for r in found}
    assert all(by_id[i].kept for i in range(200))
    assert not any(by_id[1000 + i].kept for i in range(30))
    assert sorted(map(tuple, found), key=str) == sorted(map(tuple, w.classify(df).collect()), key=str)
    assert w.classify(df.where("false")).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_agrees_with_labels(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    found = [r for r in w.op3_weak_label_quality(spark, SF).collect() if r.doc_id in labels]
    label = np.array([labels[r.doc_id] for r in found])
    kept = np.array([r.kept for r in found])
    assert area(np.array([r.score for r in found]), label) > 0.97
    assert kept[label == 1].mean() > 0.98
    assert kept[label == 0].mean() < 0.06


def plain_estimate(texts):
    """The same model text by text, in plain loops: each text's probability of good."""
    m = len(w.LABELLERS)
    p = []
    for cast in texts:
        bad = [i for i in range(m) if cast[i] == w.BAD]
        p.append([1 / len(bad) if c in bad else 0.0 for c in range(m)] + [0.0] if bad else [0.0] * m + [1.0])
    for _ in range(w.STEPS):
        share = [(sum(x[c] for x in p) + 1) / (len(texts) + m + 1) for c in range(m + 1)]
        thought = [[w.HIT if c == i else w.FALSE_ALARM if c == m else None for i in range(m)] for c in range(m + 1)]
        rate = []
        for c in range(m + 1):
            rate.append([])
            for i in range(m):
                bad, all_of = 0.5, 1.0
                if thought[c][i] is not None:
                    bad, all_of = bad + w.PRIOR * thought[c][i], all_of + w.PRIOR
                for x, cast in zip(p, texts, strict=True):
                    bad, all_of = bad + x[c] * (cast[i] == w.BAD), all_of + x[c] * (cast[i] != w.NONE)
                rate[c].append(bad / all_of)
        new = []
        for cast in texts:
            like = share[:]
            for c in range(m + 1):
                for i in range(m):
                    like[c] *= rate[c][i] if cast[i] == w.BAD else 1 - rate[c][i] if cast[i] == w.GOOD else 1.0
            new.append([x / sum(like) for x in like])
        moved = max(abs(x - y) for a, b in zip(p, new, strict=True) for x, y in zip(a, b, strict=True))
        p = new
        if moved < 1e-7:
            break
    return [x[m] for x in p]


def test_estimate_against_plain_loops():
    rng = np.random.default_rng(3)
    texts = [[int(x) for x in rng.choice([w.GOOD, w.BAD, w.NONE], len(w.LABELLERS), p=[0.75, 0.15, 0.1])] for _ in range(60)] * 2
    posterior, _, _ = w.estimate(Counter(map(w.pattern, texts)))
    assert [posterior[w.pattern(x)] for x in texts] == pytest.approx(plain_estimate(texts), abs=1e-5)


def test_overlapping_labellers_are_told_apart():
    """Three labellers see the same kind of bad text; one of them also errs often. EM, told nothing, finds which, and doesn't follow it alone."""
    rng = np.random.default_rng(1)
    m = len(w.LABELLERS)
    counts = Counter()
    for _ in range(20_000):
        bad = rng.random() < 0.15
        cast = [w.GOOD] * m
        for i, (hit, alarm) in enumerate(((0.9, 0.005), (0.85, 0.005), (0.9, 0.10))):
            cast[i] = w.BAD if rng.random() < (hit if bad else alarm) else w.GOOD
        counts[w.pattern(cast)] += 1
    posterior, accuracy, _ = w.estimate(counts)
    assert accuracy[2, w.BAD] < accuracy[:2, w.BAD].min()
    everyone = [w.BAD, w.BAD, w.BAD] + [w.GOOD] * (m - 3)
    assert posterior[w.pattern(everyone)] < 0.01


def test_sample_is_bounded(spark, monkeypatch):
    """Many equal rows are sampled as rows, and features in all are bounded; scores come all the same."""
    df = spark.createDataFrame([(1, "the same words in a row " + " ".join(f"x{j}" for j in range(40)))] * 3000 + [(i, f"### {i} $$$ " * 20) for i in range(200)], "doc_id long, text string")
    fitted = []
    real = w.fit
    monkeypatch.setattr(w, "fit", lambda rows: fitted.append(rows) or real(rows))
    assert w.classify(df, sample=100).count() == 3200
    assert 60 < len(fitted[-1]) < 150
    monkeypatch.setattr(w, "ENTRIES", 2000)
    assert w.classify(df, sample=1000).where(F.col("kept") & (F.col("doc_id") == 1)).count() > 3000 - 1
    assert 0 < sum(len(at) for at, _, _ in fitted[-1]) < 4000


@pytest.mark.skipif(not os.path.isdir("/root/testdata/check_s"), reason="no tables")
def test_agrees_with_labels_that_no_limit_was_chosen_on(spark):
    """The labellers' limits were chosen on sf0.1; these are other rows."""
    sf = "/root/testdata/check_s"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    found = [r for r in w.op3_weak_label_quality(spark, sf).select("doc_id", "score", "kept").collect() if r.doc_id in labels]
    label, kept = np.array([labels[r.doc_id] for r in found]), np.array([r.kept for r in found])
    assert area(np.array([r.score for r in found]), label) > 0.97
    assert kept[label == 1].mean() > 0.98
    assert kept[label == 0].mean() < 0.06
