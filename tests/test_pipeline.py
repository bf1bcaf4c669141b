import pytest
from pyspark.sql import functions as F

from strandsift.plans import pipeline as p


def test_closures():
    double, add = p.make_closure(lambda x: 2 * x), p.make_closure(lambda x, y: x + y, 3)
    assert 5 | double == 10
    assert 5 | (double | add) == 13


def test_senders():
    assert p.run(p.make_sender(lambda x, y: x + y, 1, 2)) == 3
    assert p.run(p.make_sender(lambda: 4) | p.then(lambda x: x + 1) | p.then(str)) == "5"
    assert p.run(p.ready_done_sender()) is None
    assert p.run(p.ready_done_sender() | p.then(lambda: 1)) is None
    assert p.run(p.make_sender(lambda: 1) | p.then(lambda x: None)) is None


def test_errors_are_told_once():
    told = []

    class Receiver:
        def set_value(self, *values):
            told.append(values)

        def set_done(self):
            told.append("done")

        def set_error(self, error):
            told.append(error)

    def bad():
        raise KeyError("x")

    p.start(p.connect(p.make_sender(bad) | p.then(str), Receiver()))
    assert [type(x) for x in told] == [KeyError]
    with pytest.raises(KeyError):
        p.run(p.make_sender(bad))


def test_streams(spark, tmp_path):
    stream = p.make_stream([(1,), (2,)], spark, "x long") | p.transform_stream({"y": F.col("x") * 10}) | p.transform_stream(lambda df: df.where("y > 10"))
    seen = []
    p.run(stream | p.for_each_stream(lambda df: seen.extend(df.collect())))
    assert [tuple(x) for x in seen] == [(2, 20)]
    path = str(tmp_path / "in")
    spark.range(10).write.parquet(path)
    counts = []
    p.run(spark.readStream.schema("id long").parquet(path) | p.for_each_stream(lambda df: counts.append(df.count()), str(tmp_path / "marks")))
    assert sum(counts) == 10

    def fail(df):
        raise RuntimeError("sink")

    with pytest.raises(RuntimeError, match="sink"):
        p.run(stream | p.for_each_stream(fail))


def test_items_are_pulled_and_cleaned_up(spark):
    """next() gives lists of rows, then is done; cleanup() happens once, also if the sink fails."""
    told = []
    items = p.Items(spark.range(25), 10, lambda: told.append("clean"))
    sizes = []
    while (found := p.run(p.next_of(items) | p.then(lambda rows: rows))) is not None:
        sizes.append(len(found))
    assert sizes == [10, 10, 5]
    p.run(p.cleanup(items))
    p.run(p.cleanup(items))
    assert told == ["clean"]
    assert p.run(p.next_of(items)) is None

    seen = []
    p.run(p.Items(spark.range(25), 10, lambda: told.append("second")) | p.for_each_stream(lambda rows: seen.extend(r.id for r in rows)))
    assert sorted(seen) == list(range(25))

    def fail(rows):
        raise RuntimeError("sink")

    with pytest.raises(RuntimeError, match="sink"):
        p.run(p.Items(spark.range(25), 10, lambda: told.append("third")) | p.for_each_stream(fail, on_cleanup=lambda: told.append("sink")))
    with pytest.raises(RuntimeError, match="sink"):
        p.run(spark.range(3) | p.for_each_stream(fail, on_cleanup=lambda: told.append("table")))
    assert told == ["clean", "second", "third", "sink", "table"]
