from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

from strandsift.llm import common
from strandsift.llm.common import join_hot, keyed, null_key, rank_within, small_batches, take_rows, unused


def test_batches_are_small(spark):
    small_batches(spark)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["n"])

    long = spark.range(60, numPartitions=1).select(F.repeat(F.lit("x"), 1 << 20).alias("text"))
    assert max(r.n for r in long.mapInArrow(sizes, "n long").collect()) < 20 << 20
    many = spark.range(3000, numPartitions=1).mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"]) for b in batches), "n long")
    assert max(r.n for r in many.collect()) <= 500


def test_ranks(spark):
    rows = [(k, i) for k in ("a", "b") for i in range(200)] + [("c", 7), ("c", 7)]
    df = spark.createDataFrame(rows, "k string, i long")
    told = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "k string, more int")
    found = rank_within(df, ["k"], F.floor(F.col("i") / 50), [F.col("i")], "rank", table=told).collect()
    assert Counter((r.k, r["rank"]) for r in found) == Counter([(k, i) for k in ("a", "b") for i in range(200)] + [("c", 0), ("c", 1)])
    assert all(r["rank"] == r.i for r in found if r.k != "c")
    assert {(r.k, r.more) for r in found} == {("a", 1), ("b", 2), ("c", 3)}
    tied = rank_within(df, ["k"], F.lit(0), [F.col("i")], "rank", ties=True)
    assert [r["rank"] for r in tied.where("k = 'c'").collect()] == [0, 0]


def test_null_keys_differ_from_all_others(spark):
    df = spark.createDataFrame([("n",), (None,), ("",), ("s",)], "x string").select(null_key("x").alias("k"))
    assert len({r.k for r in df.collect()}) == 4


def test_rows_are_taken_in_place(spark, tmp_path, monkeypatch):
    """Rows of several files, by decisions in several ranges and buckets; and rows of a table that is no file."""
    monkeypatch.setattr(common, "STRIDE", 16)
    monkeypatch.setattr(common, "TOGETHER", 70)
    path = str(tmp_path / "t")
    spark.range(1000).select(F.col("id"), F.lit("x").alias("__at")).repartition(4).write.parquet(path)
    for df in (spark.read.parquet(path), spark.read.parquet(path).where("id >= 0").repartition(3), spark.range(1000).withColumn("__at", F.lit("x"))):
        rows, file, row = keyed(df)
        told = rows.where("id % 3 = 0").select(F.col(file).alias("__file"), F.col(row).alias("__row"), (F.col("id") % 2 * 2).alias("__times"))
        out = take_rows(rows, file, row, told, 1)
        assert out.columns == df.columns
        assert Counter(r.id for r in out.collect()) == +Counter({i: i % 2 * 2 if i % 3 == 0 else 1 for i in range(1000)})
    doubled = spark.read.parquet(path).withColumn("k", F.explode(F.array(F.lit(1), F.lit(2))))
    rows, file, row = keyed(doubled)
    assert rows.select(file, row).distinct().count() == 2000


def test_hot_keys_are_joined(spark, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_ROWS", 3)
    rows = spark.createDataFrame([("hot", i) for i in range(90)] + [(f"k{i}", i) for i in range(10)], "k string, i long")
    told = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")).withColumn("v", F.length("k"))
    out = join_hot(rows, told, ["k"], "n", 100)
    assert Counter((r.k, r.i, r.v) for r in out.collect()) == Counter((r.k, r.i, len(r.k)) for r in rows.collect())


def test_unused():
    assert unused(["a", "__X"], "__x", "b", "A") == ["__x_", "b", "A_"]
