import random
import uuid

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandsift.functions import sql
from strandsift.operators.approximate import find_approximate, find_exact
from strandsift.operators import needles as tables
from strandsift.operators import protocol
from strandsift.operators.matchers import Horspool, Myers, Pigeonhole, RestorableMyers, RestorableMyersPrefix, RestorableShiftOr, ShiftOr
from strandsift.plans import planner
from strandsift.sources.fasta import read_fasta, write_fasta
from strandsift.streaming.resumable import drain, find_stream, search_stream
from tests.models import begins, edit_distance_ends

HAYSTACK, NEEDLE = "ACGTGACTAGCACGTGACTAGCACGTGACTAGCACGTGACTAGC", "GCACG"


@pytest.fixture(scope="module")
def haystacks(spark):
    rows = [(1, HAYSTACK, "x"), (2, "", "x"), (3, None, "x"), (4, "GCAC", "x"), (5, "äöGCACGü😀GCACG", "x"), (6, "A" * 300 + NEEDLE, "x")]
    return spark.createDataFrame(rows, "haystack_id long, seq string, begin_pos string")


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


@pytest.mark.parametrize("matcher", [Horspool, ShiftOr])
def test_exact(haystacks, matcher):
    found = rows(matcher(NEEDLE).find(haystacks), "haystack_id", "begin_pos")
    assert found == [(1, 9), (1, 20), (1, 31), (5, 2), (5, 9), (6, 300)]
    assert matcher("").find(haystacks).count() == 0


def test_edits(haystacks):
    expected = sorted((r.haystack_id, e, d) for r in haystacks.collect() for e, d in edit_distance_ends(r.seq or "", NEEDLE, 1))
    assert rows(Myers(NEEDLE, 1).find(haystacks), "haystack_id", "end_pos", "distance") == expected
    for needle, k in (("CTAGCACGT", 2), ("GTGACTAGCACG", 3), ("ACG", 0)):  # by seeds
        expected = sorted((r.haystack_id, e, d) for r in haystacks.collect() for e, d in edit_distance_ends(r.seq or "", needle, k))
        assert rows(Myers(needle, k).find(haystacks), "haystack_id", "end_pos", "distance") == expected
    assert Myers("", 3).find(haystacks).count() == 0
    with pytest.raises(ValueError, match="errors"):
        Myers("A", -1)


def test_all_ends_match_if_k_is_the_needles_length(spark):
    one = spark.createDataFrame([(1, "TTTT")], "haystack_id long, seq string")
    assert rows(Myers("AC", 2).find(one), "end_pos") == [(1,), (2,), (3,), (4,)]


def test_prefix(haystacks):
    expected = sorted((r.haystack_id, e, d) for r in haystacks.collect() for e, d in edit_distance_ends(r.seq or "", "ACGTG", 2, True))
    assert rows(RestorableMyersPrefix("ACGTG", 2).find(haystacks), "haystack_id", "end_pos", "distance") == expected


def test_seeds(spark, haystacks):
    matcher = Pigeonhole([NEEDLE, "TGACTAGCAC"])
    found = rows(matcher.find(haystacks), "haystack_id", "begin_pos", "index", "offset", "count")
    joined = Pigeonhole([NEEDLE, "TGACTAGCAC"])
    joined.LOCAL = 0
    assert found == rows(joined.find(haystacks), "haystack_id", "begin_pos", "index", "offset", "count")
    assert [x[1] for x in found if x[0] == 1] == [3, 8, 9, 14, 19, 20, 25, 30, 31, 36]


def test_long_sequences_are_cut(spark):
    text = "ACGTTGCA" * 500
    one = spark.createDataFrame([(1, text)], "haystack_id long, seq string").coalesce(1)
    found = planner.scan(one, "haystack_id", "seq", None, lambda x: (begins(x, "GCAACG"),), [("begin_pos", T.LongType())], 6, size=50)
    assert [x for (x,) in rows(found, "begin_pos")] == begins(text, "GCAACG")
    dealt = Myers("GCAACG", 1).find(one, deal=3)
    assert rows(dealt, "end_pos", "distance") == edit_distance_ends(text, "GCAACG", 1)


def test_many_needles(haystacks):
    needles = [(7, NEEDLE), (8, "TGACTAG"), (9, ""), (10, NEEDLE)]
    found = rows(find_exact(haystacks, needles), "haystack_id", "needle_id", "begin_pos")
    assert found == sorted((r.haystack_id, i, b) for r in haystacks.collect() for i, x in needles for b in begins(r.seq or "", x))
    found = rows(find_approximate(haystacks, needles, 1), "haystack_id", "needle_id", "end_pos", "distance")
    assert found == sorted((r.haystack_id, i, e, d) for r in haystacks.collect() for i, x in needles for e, d in edit_distance_ends(r.seq or "", x, 1))


def cut_up(spark, size):
    parts = [(key, i // size, text[i : i + size]) for key, text in ((1, HAYSTACK), (2, "AAAAAAAA")) for i in range(0, len(text), size)]
    return spark.createDataFrame(parts, "haystack_id long, chunk_idx long, seq string")


@pytest.mark.parametrize("size", [1, 5, 13])
def test_resume(spark, size):
    chunks = cut_up(spark, size)
    assert rows(RestorableMyers(NEEDLE, 1).resume(chunks), "haystack_id", "end_pos") == [(1, x) for x in (13, 14, 15, 24, 25, 26, 35, 36, 37)]
    assert rows(RestorableShiftOr("AA").resume(chunks), "haystack_id", "end_pos") == [(2, x) for x in range(2, 9)]
    assert rows(RestorableMyersPrefix("ACGTG", 1).resume(chunks), "haystack_id", "end_pos") == [(1, 4), (1, 5), (1, 6)]


@pytest.mark.parametrize("matcher", [RestorableMyers(NEEDLE, 1), RestorableShiftOr(NEEDLE), RestorableMyersPrefix("ACGTG", 1)])
def test_stream(spark, tmp_path, matcher):
    """Chunks out of order, repeated, over several micro-batches."""
    chunks = cut_up(spark, 7).collect()
    order = [*chunks[::2], *chunks[1::2], *chunks[:3]]
    for i in range(0, len(order), 3):
        spark.createDataFrame(order[i : i + 3], "haystack_id long, chunk_idx long, seq string").coalesce(1).write.mode("append").parquet(str(tmp_path))
    source = spark.readStream.schema("haystack_id long, chunk_idx long, seq string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path))
    assert rows(drain(find_stream(source, matcher), "test"), "haystack_id", "end_pos") == rows(matcher.resume(cut_up(spark, 7)), "haystack_id", "end_pos")


def test_sql_function(spark):
    sql.register(spark)
    found = spark.sql(f"SELECT * FROM seq_find('{HAYSTACK}', '{NEEDLE}', 1)")
    assert [x for (x,) in rows(found, "end_pos")] == [13, 14, 15, 24, 25, 26, 35, 36, 37]


def test_fasta(spark, tmp_path):
    path = tmp_path / "x.fasta"
    path.write_text(">seq 1\nACGT\nACG\n>seq2\r\nTT\r\n\n>empty\n")
    assert rows(read_fasta(spark, str(path)), "id", "seq") == [("empty", ""), ("seq 1", "ACGTACG"), ("seq2", "TT")]


def test_plan_reads_only_what_it_needs(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(1, HAYSTACK, "x")], "doc_id long, text string, other string").write.parquet(path)
    plan = Horspool(NEEDLE).find(spark.read.parquet(path), "doc_id", "text")._jdf.queryExecution().executedPlan().toString()
    assert "StringContains(text,GCACG)" in plan
    assert "other" not in plan.split("ReadSchema")[1]


@pytest.mark.parametrize("matcher", [RestorableMyers("CTAGCACGT", 2), RestorableShiftOr("GACTAGC"), RestorableMyersPrefix("ACGTG", 2), RestorableShiftOr("A"), RestorableMyers("", 1)])
def test_blocks_of_chunks_find_the_same(spark, matcher):
    """Chunks of any size, blocks of one and of many numbers; a null id is an id of its own."""
    rng = random.Random(11)
    texts = {1: HAYSTACK * 3, 2: "AAAAAAAA", None: "ACGTG" + HAYSTACK}
    parts = []
    for key, text in texts.items():
        at = number = 0
        while at < len(text):
            n = rng.choice([0, 1, 2, 9, 30])
            parts.append((key, number, text[at : at + n]))
            at, number = at + n, number + rng.choice([1, 1, 3])
    chunks = spark.createDataFrame(rng.sample(parts, len(parts)), "haystack_id long, chunk_idx long, seq string")
    expected = sorted(((key, hit) for key, text in texts.items() for hit in matcher.step(text, matcher.start())[0]), key=str)
    for span in (1, 2, 7, 1000):
        found = planner.resume(chunks, "haystack_id", "chunk_idx", "seq", matcher, list(matcher.fields), span=span)
        assert sorted(((r.haystack_id, r.end_pos) for r in found.collect()), key=str) == expected


#: One sequence in odd chunks, and what counts of it: ids 1 (from number 1), 2 (a gap), 3 (repeated), 4 (null numbers, numbers under 0, null texts).
ODD = [(1, 1, HAYSTACK[:20]), (1, 2, HAYSTACK[20:]), (2, 0, HAYSTACK[:9]), (2, 5, HAYSTACK[9:]), (3, 0, HAYSTACK[:16]), (3, 0, HAYSTACK[:16]), (3, 1, HAYSTACK[16:]), (4, None, "GCACG"), (4, 0, HAYSTACK[:30]), (4, -1, "GCACG"), (4, 1, None), (4, 2, HAYSTACK[30:])]


@pytest.mark.parametrize("matcher", [RestorableMyers(NEEDLE, 1), RestorableShiftOr(NEEDLE), RestorableMyersPrefix("ACGTG", 1)])
def test_odd_numbers_in_batch_and_stream(spark, tmp_path, matcher):
    schema = "haystack_id long, chunk_idx long, seq string"
    expected = sorted((i, e) for i in (1, 2, 3, 4) for e in matcher.step(HAYSTACK, matcher.start())[0])
    assert rows(matcher.resume(spark.createDataFrame(ODD, schema)), "haystack_id", "end_pos") == expected
    for i in range(0, len(ODD), 5):
        spark.createDataFrame(ODD[i : i + 5][::-1], schema).coalesce(1).write.mode("append").parquet(str(tmp_path))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path))
    assert rows(search_stream(source, matcher, "odd"), "haystack_id", "end_pos") == expected


def test_waiting_is_bounded(spark, tmp_path):
    """Beyond the limit a missing number is given up, and too late when it comes; before, it isn't."""
    schema = "haystack_id long, chunk_idx long, seq string"
    for own in ([(1, 1, HAYSTACK), (1, 2, HAYSTACK)], [(1, 0, NEEDLE)]):
        spark.createDataFrame(own, schema).coalesce(1).write.mode("append").parquet(str(tmp_path))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path))
    matcher = RestorableShiftOr(NEEDLE)
    assert rows(search_stream(source, matcher, "late", waiting=60), "end_pos") == [(e,) for e in matcher.step(HAYSTACK * 2, matcher.start())[0]]
    assert rows(search_stream(source, matcher, "early", waiting=100), "end_pos") == [(e,) for e in matcher.step(NEEDLE + HAYSTACK * 2, matcher.start())[0]]


def test_needles_as_a_table(spark, haystacks, monkeypatch):
    """The same as a list, in one part and in many; null and empty needles, repeated ids and needles."""
    needles = [(7, NEEDLE), (8, "TGACTAG"), (9, ""), (10, NEEDLE), (11, None), (8, "ACGTG"), (12, "A" * 12)]
    table = spark.createDataFrame([(*x, "q") for x in needles], "needle_id long, needle string, part string")
    held = [(i, x) for i, x in needles if x]
    for part in (tables.PART, 10):
        monkeypatch.setattr(tables, "PART", part)
        found = rows(find_exact(haystacks, table), "haystack_id", "needle_id", "begin_pos")
        assert found == sorted((r.haystack_id, i, b) for r in haystacks.collect() for i, x in held for b in begins(r.seq or "", x))
        found = rows(find_approximate(haystacks, table, 1), "haystack_id", "needle_id", "end_pos", "distance")
        assert found == sorted((r.haystack_id, i, e, d) for r in haystacks.collect() for i, x in held for e, d in edit_distance_ends(r.seq or "", x, 1))
        seeds = Pigeonhole(spark.createDataFrame([(0, NEEDLE), (1, "TGACTAGCAC")], "needle_id long, needle string"))
        plain = Pigeonhole([NEEDLE, "TGACTAGCAC"])
        columns = ("haystack_id", "begin_pos", "index", "offset", "count")
        assert rows(seeds.find(haystacks), *columns) == rows(plain.find(haystacks), *columns)
        assert seeds.window_size() == plain.window_size() == 5
        assert seeds.search(HAYSTACK) == plain.search(HAYSTACK)
    assert find_exact(haystacks, table.where("false")).count() == 0


def test_many_thousand_needles(spark):
    """200,000 needles from a table, of which none goes through the driver."""
    letters = F.translate(F.hex(F.xxhash64("id")), "0123456789ABCDEF", "ACGTACGTACGTACGT")
    needles = spark.range(200_000).select(F.col("id").alias("needle_id"), F.concat(letters, F.lpad(F.conv("id", 10, 4), 9, "0")).alias("needle"))
    some = needles.where("needle_id % 50000 = 7").collect()
    hay = spark.createDataFrame([(i, "ACGT" + r.needle + "TT" + r.needle) for i, r in enumerate(some)], "haystack_id long, seq string").coalesce(1)
    expected = sorted((i, r.needle_id, b) for i, r in enumerate(some) for b in (4, 6 + len(r.needle)))
    assert rows(find_exact(hay, needles), "haystack_id", "needle_id", "begin_pos") == expected


def test_search_calls_back():
    """One sequence here and now; at each hit the matcher says where it is."""
    for matcher, expected in ((Horspool(NEEDLE), [9, 20, 31]), (ShiftOr(NEEDLE), [9, 20, 31]), (Myers(NEEDLE, 1), [13, 14, 15, 24, 25, 26, 35, 36, 37]), (RestorableMyers(NEEDLE, 1), [13, 14, 15, 24, 25, 26, 35, 36, 37]), (RestorableShiftOr(NEEDLE), [14, 25, 36])):
        told = []
        assert matcher.search(HAYSTACK, lambda at, m=matcher: told.append((at, m.position()))) == expected
        assert [x for x, _ in told] == [p[0] for _, p in told] == expected
    told = []
    seeds = Pigeonhole([NEEDLE, "TGACTAGCAC"])
    assert seeds.search(HAYSTACK, lambda at: told.append(seeds.position())) == [3, 8, 9, 14, 19, 20, 25, 30, 31, 36]
    assert [(i, o, n) for _, i, o, n in told] == [(1, 0, 5), (1, 5, 5), (0, 0, 5), (1, 0, 5), (1, 5, 5), (0, 0, 5), (1, 0, 5), (1, 5, 5), (0, 0, 5), (1, 0, 5)]
    assert Myers("").search("ACGT") == Horspool("").search("ACGT") == []


def test_set_up_and_tear_down(spark, tmp_path):
    """Around scans, resumed and streamed searches, and after an error too."""

    class Told(RestorableShiftOr):
        def set_up(self):
            (tmp_path / f"up-{uuid.uuid4().hex}").touch()

        def tear_down(self):
            (tmp_path / f"down-{uuid.uuid4().hex}").touch()

        def step(self, text, state):
            if text == "bad":
                raise ValueError("bad")
            return super().step(text, state)

    def seen():
        names = [x.name.split("-")[0] for x in tmp_path.iterdir() if x.is_file()]
        return names.count("up"), names.count("down")

    def check(action):
        before = seen()
        action()
        up, down = (x - y for x, y in zip(seen(), before, strict=True))
        assert up == down > 0

    check(lambda: Told(NEEDLE).find(spark.createDataFrame([(1, HAYSTACK)], "haystack_id long, seq string")).collect())
    check(lambda: Told(NEEDLE).resume(cut_up(spark, 9)).collect())

    def failing():
        with pytest.raises(Exception, match="bad"):
            Told(NEEDLE).resume(spark.createDataFrame([(1, 0, "bad")], "haystack_id long, chunk_idx long, seq string")).collect()

    check(failing)
    cut_up(spark, 9).coalesce(1).write.parquet(str(tmp_path / "in"))
    check(lambda: search_stream(spark.readStream.schema("haystack_id long, chunk_idx long, seq string").parquet(str(tmp_path / "in")), Told(NEEDLE), "told").collect())


def test_states_are_merged(spark, haystacks):
    hits = Horspool(NEEDLE).find(haystacks)
    states = protocol.HitCount.table(haystacks, hits)
    expected = sorted((r.haystack_id, len(begins(r.seq or "", NEEDLE)), len(r.seq or "")) for r in haystacks.collect())
    assert rows(protocol.merge_states(states, ["haystack_id"]), "haystack_id", "hits", "symbols") == expected
    assert rows(protocol.merge_any(states, ["haystack_id"], protocol.HitCount), "haystack_id", "hits", "symbols") == expected
    whole = [(sum(x for _, x, _ in expected), sum(x for _, _, x in expected))]
    assert rows(protocol.merge_states(states, []), "hits", "symbols") == rows(protocol.merge_any(states, [], protocol.HitCount), "hits", "symbols") == whole


def test_fasta_is_written(spark, tmp_path):
    own = [("1", "ACGT" * 40), ("a b", ""), ("x>y\nz", None), ("3", "A" * 70)]
    write_fasta(spark.createDataFrame(own, "id string, seq string"), str(tmp_path / "f"))
    text = "".join(x.read_text() for x in (tmp_path / "f").glob("part-*"))
    assert max(map(len, text.split("\n"))) == 70
    assert rows(read_fasta(spark, str(tmp_path / "f")), "id", "seq") == sorted([("1", "ACGT" * 40), ("a b", ""), ("x y z", ""), ("3", "A" * 70)])


def test_reads_in_references(spark, tmp_path):
    """Reads from one FASTA file, found in the references of another."""
    rng = random.Random(3)
    references = {str(i): "".join(rng.choices("ACGT", k=100)) for i in range(1, 6)}
    reads = {f"ref{r} read {i}": (r, at, text[at : at + 20]) for r, text in references.items() for i, at in enumerate(rng.sample(range(80), 10))}
    (tmp_path / "ref.fa").write_text("".join(f">{i}\n{x[:70]}\n{x[70:]}\n" for i, x in references.items()))
    (tmp_path / "reads.fa").write_text("".join(f">{i}\n{x}\n" for i, (_, _, x) in reads.items()))
    needles = read_fasta(spark, str(tmp_path / "reads.fa")).withColumn("needle_id", F.xxhash64("id")).withColumnRenamed("seq", "needle")
    names = {r.needle_id: r.id for r in needles.collect()}
    found = find_exact(read_fasta(spark, str(tmp_path / "ref.fa")), needles, "id").collect()
    assert sorted((names[r.needle_id], r.id, r.begin_pos) for r in found) == sorted((i, r, at) for i, (r, at, _) in reads.items())
