import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from strandsift.llm import simhash


def plain_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split(" ") if text else []
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """Smallest index reachable, for each of a list of unsigned fingerprints."""
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=60))
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode()) % 2**64 == plain_fingerprint(text)


def test_fingerprint_of_long_texts():
    text = " ".join(random.Random(1).choices(["Alpha", "beta", "γάμμα", "D"], k=70_000))
    assert simhash.fingerprint(text.encode()) % 2**64 == plain_fingerprint(text)
    assert simhash.fingerprint(None) == simhash.fingerprint(b" \n") == 0


def near_prints(seed, n=300):
    """Clusters of fingerprints a few bits apart, chains, and single ones."""
    rng = random.Random(seed)
    out = []
    while len(out) < n:
        centre = rng.getrandbits(64)
        for _ in range(rng.choice([1, 1, 2, 5, 60])):
            out.append(centre)
            for _ in range(rng.choice([1, 3, 4, 5, 6])):
                centre ^= 1 << rng.randrange(64)
    return out[:n]


@pytest.mark.parametrize(("seed", "hot"), [(0, simhash.HOT), (1, 8), (2, 2)])
def test_links_connect_what_is_connected(spark, seed, hot):
    prints = sorted(set(near_prints(seed)))
    signed = [x - 2**64 if x >= 2**63 else x for x in prints]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    edges = [tuple(r) for r in simhash.links(df, hot).collect()]
    assert all((a % 2**64 ^ b % 2**64).bit_count() <= 4 for a, b in edges)
    roots = {r.node: r.root for r in simhash.components(simhash.links(df, hot)).collect()}
    by_root = {}
    for x, r in zip(prints, plain_components(prints), strict=True):
        by_root.setdefault(r, set()).add(x)
    found = {}
    for x, s in zip(prints, signed, strict=True):
        found.setdefault(roots.get(s, s), set()).add(x)
    assert sorted(map(sorted, by_root.values())) == sorted(map(sorted, found.values()))


def test_many_members_of_a_key():
    """Runs are walked as graphs and give a forest, not all pairs."""
    rng = random.Random(5)
    base = rng.getrandbits(60)
    prints = np.array(sorted({base ^ (1 << rng.randrange(20)) ^ (1 << rng.randrange(20)) for _ in range(200)}), np.int64)
    left, right = simhash._forest(prints)
    assert len(left) == len(prints) - len(set(plain_components([int(x) for x in prints])))


def test_components_of_a_path(spark):
    order = list(range(50))
    random.Random(2).shuffle(order)
    edges = spark.createDataFrame([(order[i], order[i + 1]) for i in range(49)] + [(100, 101)], "u long, v long")
    roots = {r.node: r.root for r in simhash.components(edges).collect()}
    assert roots == {**dict.fromkeys(range(50), 0), 100: 100, 101: 100}


TEXT = "the quick brown fox jumps over the lazy dog and runs far away from all of the other dogs that follow it " * 8


@pytest.fixture(scope="module")
def documents(spark):
    rows = [(5, TEXT), (3, TEXT), (7, TEXT.upper()), (8, TEXT + " end"), (9, "short"), (10, "Short "), (11, None), (12, ""), (13, " \n"), (14, "other words here now"), (14, "other words here now"), (None, "null id text"), (None, TEXT), (20, "x " * 50_000)]
    return rows, spark.createDataFrame([(i, t, "e", 1) for i, t in rows], "doc_id long, text string, fp string, root int")


def test_documents(documents):
    rows, df = documents
    found = simhash.near_duplicates(df)
    assert found.count() == len(rows)
    prints = [plain_fingerprint(t) for _, t in rows]
    roots = plain_components(prints)
    smallest = {}
    for (i, _), r in zip(rows, roots, strict=True):
        smallest[r] = min((x for x in (smallest.get(r), i) if x is not None), default=None)
    expected = Counter((i, f"{p:016x}", smallest[r]) for (i, _), p, r in zip(rows, prints, roots, strict=True))
    assert Counter(tuple(x) for x in found.select("doc_id", simhash.hex_digits(), "component_id").collect()) == expected


def test_one_of_each_stays(documents):
    rows, df = documents
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    prints = [plain_fingerprint(t) for _, t in rows]
    groups = {}
    for (i, _), r in zip(rows, plain_components(prints), strict=True):
        groups.setdefault(r, []).append(i)
    expected = Counter(min((x for x in g if x is not None), default=None) for g in groups.values())
    assert Counter(r.doc_id for r in kept.collect()) == expected


def test_one_id_with_two_near_texts(spark):
    df = spark.createDataFrame([(1, TEXT), (1, TEXT + " end"), (2, TEXT)], "doc_id long, text string")
    assert [r.doc_id for r in simhash.keep_one(df).collect()] == [1]


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(df).count() == 0
    assert simhash.keep_one(df).count() == 0


def test_the_kept_row_is_defined(spark, tmp_path):
    """Of rows with one id and fingerprint but other texts, the one whose text has the least hash stays; of equal rows one; columns may have any names; texts stay in place."""
    rows = [(1, TEXT, 0), (1, TEXT.upper(), 1), (2, TEXT, 2), (5, "alone it stands here", 3), (5, "alone it stands here", 4)]
    df = spark.createDataFrame([(*r, r[2], r[2]) for r in rows], "doc_id long, text string, __own int, __file int, __ROW int")
    found = simhash.keep_one(df).collect()
    from pyspark.sql import functions as F

    least = min(spark.createDataFrame([(TEXT,), (TEXT.upper(),)], "t string").select("t", F.xxhash64("t").alias("h")).collect(), key=lambda r: r.h).t
    assert sorted((r.doc_id, r.text) for r in found) == [(1, least), (5, "alone it stands here")]
    path = str(tmp_path / "docs")
    df.repartition(3).write.parquet(path)
    stored = simhash.keep_one(spark.read.parquet(path))
    assert stored.columns == df.columns
    assert sorted((r.doc_id, r.text) for r in stored.collect()) == [(1, least), (5, "alone it stands here")]
    assert "Exchange" not in stored._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("limit", [1, 5])
def test_hot_joins(spark, monkeypatch, documents, limit):
    """Components and copies by broadcast of the hot keys and a shuffle of the others: the same."""
    from strandsift.llm import common

    expected = Counter(map(tuple, simhash.near_duplicates(documents[1]).collect()))
    monkeypatch.setattr(common, "BROADCAST_ROWS", limit)
    assert Counter(map(tuple, simhash.near_duplicates(documents[1]).collect())) == expected
