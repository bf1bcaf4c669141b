import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from strandsift.llm import mixing


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_targets():
    assert mixing.targets({"a": 100, "b": 100, None: 100}) == {"a": 187.5, "b": 75.0, None: 37.5}
    found = mixing.targets({"a": 10, "b": 1000, "c": 1000})
    assert found["a"] == 30.0  # its share would be 1256
    assert found["b"] == pytest.approx(2 * found["c"])
    assert sum(found.values()) == pytest.approx(2010)
    assert mixing.targets({}) == {}
    assert mixing.targets({"a": 0}) == {"a": 0.0}
    order = mixing.targets({"é": 100, "z": 100, "Z": 100})  # by code point
    assert order["Z"] > order["z"] > order["é"]


def documents(seed, n=600):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        source = rng.choices(["a", "b", "c", None, "d"], [5, 2, 2, 1, 1])[0]
        words = int(rng.lognormvariate(3, 1.2)) if rng.random() > 0.1 else 40
        rows.append((i, "w " * words, source))
    return rows


@pytest.mark.parametrize("seed", [0, 1])
def test_mix(spark, seed):
    rows = [*documents(seed), (9001, None, "a"), (9002, "", "b"), (9003, "é x\x0by", None), (None, "a b c", "a")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, source string, rate string")
    found = mixing.mix(df).collect()
    assert Counter((r.doc_id, r.source, r.size) for r in found) == Counter((i, s, size(t)) for i, t, s in rows)
    totals = Counter()
    for _, t, s in rows:
        totals[s] += size(t)
    goal = mixing.targets(dict(totals))
    taken = Counter()
    for r in found:
        assert r.source_size == totals[r.source]
        assert r.target == pytest.approx(goal[r.source])
        assert 0 <= r.copies <= 3
        assert abs(r.copies - r.rate) < 1
        taken[r.source] += r.size * r.copies
    for s, t in goal.items():
        assert taken[s] == pytest.approx(t, abs=3)
    again = mixing.mix(df).collect()
    assert Counter(map(tuple, found)) == Counter(map(tuple, again))


def test_rates_are_exponential(spark):
    df = spark.createDataFrame([(i, "w " * (1 + i % 50), "ab"[i % 2]) for i in range(400)], "doc_id long, text string, source string")
    for r in mixing.mix(df).collect():
        assert 0 < r.rate <= 3
    import math

    rates = {(r.source, r.size): r.rate for r in mixing.mix(df).collect()}
    for s in "ab":
        slopes = {round(math.log(rate) / n, 9) for (x, n), rate in rates.items() if x == s and rate < 3}
        assert len(slopes) == 1


def test_capped_source(spark):
    df = spark.createDataFrame([(1, "a b c d", "a")] + [(i, "w " * 30, "b") for i in range(10, 40)], "doc_id long, text string, source string")
    found = {r.doc_id: r for r in mixing.mix(df).collect()}
    assert found[1].target == 12.0
    assert found[1].copies == 3


def test_hot_cell(spark, monkeypatch):
    monkeypatch.setattr(mixing, "buckets_for", lambda rows: 5)
    df = spark.createDataFrame([(i, "one two three", "ab"[i % 2]) for i in range(1000)], "doc_id long, text string, source string")
    found = mixing.mix(df).collect()
    taken = Counter()
    for r in found:
        taken[r.source] += r.size * r.copies
    assert taken["a"] == pytest.approx(3000 * 5 / 7, abs=3)


def test_copies_are_taken(spark):
    rows = [*documents(3, 200), (500, "twice here", "a"), (500, "twice here", "a")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, size int")
    copies = {(r.doc_id, r.source): r.copies for r in mixing.mix(df).collect()}
    out = mixing.take_copies(df)
    assert out.columns == df.columns
    expected = Counter()
    for i, _, s in rows:
        expected[i] += copies[i, s]
    assert Counter(r.doc_id for r in out.collect()) == +expected


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix(df).count() == 0
    assert mixing.take_copies(df).count() == 0


@pytest.mark.parametrize(("key", "crowd"), [(None, mixing.CROWD), (7, 50)])
def test_rows_that_repeat_an_id(spark, monkeypatch, key, crowd):
    """Each row counts once, whatever its id: 600 rows of one source with one id, or none, take what the target says; so do rows that are equal."""
    monkeypatch.setattr(mixing, "CROWD", crowd)
    rows = [(key, "w " * 10 + ("x" if key else str(i)), "a") for i in range(600)] + [(1000 + i, "w " * 10, "b") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken, copies = Counter(), Counter()
    for r in mixing.mix(df).collect():
        taken[r.source] += r.size * r.copies
        copies[r.source] += r.copies
    for s, goal in mixing.targets({"a": 6600, "b": 600}).items():
        assert taken[s] == pytest.approx(goal, abs=11)
    assert Counter(r.source for r in mixing.take_copies(df).collect()) == copies


def test_clashing_names(spark):
    names = ["doc_id", "text", "source", "__file", "__row", "__size", "__copies", "__Times", "__at", "rate", "__own"]
    df = spark.createDataFrame([(i, "w " * (i % 9), "ab"[i % 2], *[i] * 8) for i in range(60)], "doc_id long, text string, source string, " + ", ".join(f"{x} int" for x in names[3:]))
    out = mixing.take_copies(df)
    assert out.columns == names
    copies = {r.doc_id: r.copies for r in mixing.mix(df).collect()}
    assert Counter(r.doc_id for r in out.collect()) == +Counter(copies)
    assert all(r["__own"] == r.doc_id for r in out.collect())


def test_target_table_is_targets(spark):
    """Against the plain form, with caps that make others reach theirs."""
    for sizes in ({"a": 100, "b": 100, None: 100}, {"a": 10, "b": 1000, "c": 1000}, {"é": 7, "z": 90, "Z": 3, "": 5000, "zz": 0, None: 12}, {f"s{i}": (i * 7919) % 1000 for i in range(200)}, {"a": 0}):
        df = spark.createDataFrame([("n" if s is None else "s" + s, n) for s, n in sizes.items()], "__source string, words long")
        found = {r["__source"]: r.target for r in mixing.target_table(df).collect()}
        goal = mixing.targets(sizes)
        assert found == {("n" if s is None else "s" + s): pytest.approx(t) for s, t in goal.items()}


def test_tilts_against_bisection(spark):
    """The dual's solution of each source, found by plain bisection."""
    import math

    rows = documents(5, 300)
    found = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    for s in {r.source for r in found}:
        own = [r for r in found if r.source == s]
        low, high = -5.0, 5.0
        for _ in range(200):
            mid = (low + high) / 2
            total = sum(r.size * min(3.0, math.exp(min(5.0, mid * r.size))) for r in own)
            low, high = (mid, high) if total < own[0].target else (low, mid)
        for r in own:
            assert r.rate == pytest.approx(min(3.0, math.exp(min(5.0, low * r.size))), rel=1e-4)
