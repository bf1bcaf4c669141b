"""Approximate nearest neighbours by multi-index hashing over learned binary codes.

A rotation learned from a sample turns vectors into binary codes (iterative quantisation: principal directions, then the rotation whose signs lose
least). Codes are split into substrings, each with a table from its value to the rows. Codes within Hamming radius r of a query differ from it by
at most r // m bits in one of the m substrings, so probing each table in a ball of that radius retrieves all of them; complete distances are
verified, then the original vectors are compared. The radius is learned on the sample as well: the one that holds RECALL of its true neighbours.

Scale: rows are dealt into blocks of at most BLOCK, shuffled once; each block builds its tables and streams all queries past them, giving the k
nearest of each, with as many more as its own id may take up. Of vectors that are equal, the k + 1 with the smallest ids take part (no other can be among anyone's k nearest), found by a
limit inside each task before the shuffle; queries that are equal are searched once. Queries with fewer than k neighbours within the radius are
searched again without a radius. The model is fitted on at most about SAMPLE vectors.

Vectors that are null, zero, empty, or hold null or non-finite components take no part. A distance needs vectors of one length: each length has an
index and answers of its own, one after the other. An id that repeats is never its own neighbour; rows that repeat both id and vector count once. Ties
go to the smaller id. Long vectors are compared whole. An empty table gives an empty one. Further columns aren't read, whatever their names.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandsift.llm.common import materialise, small_batches

K, EVERY, BITS, SAMPLE, BLOCK, RECALL, STEPS = 10, 100, 64, 10_000, 100_000, 0.99, 30
EMPTY = "query_id long, rank int, vec_id long, score double"


class Codes:
    """A fitted rotation and radius."""

    def __init__(self, sample: np.ndarray, bits: int = BITS, k: int = K, seed: int = 0) -> None:
        x = sample.astype(np.float64)
        self.bits = min(bits, x.shape[1])
        self.mean = x.mean(0)
        x = x - self.mean
        _, axes = np.linalg.eigh(x.T @ x)
        axes = axes[:, ::-1][:, : self.bits]
        z = x @ axes
        turn = np.linalg.qr(np.random.default_rng(seed).normal(size=(self.bits, self.bits)))[0]
        for _ in range(STEPS):
            u, _, v = np.linalg.svd(np.where(z @ turn > 0, 1.0, -1.0).T @ z)
            turn = (u @ v).T
        self.turn = axes @ turn
        self.radius = self._radius(sample.astype(np.float64), k)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        ones = np.zeros((len(x), 64), np.uint8)
        ones[:, : self.bits] = (x - self.mean) @ self.turn > 0
        return np.packbits(ones, axis=1, bitorder="little").view(np.uint64).ravel()

    def _radius(self, x: np.ndarray, k: int) -> int:
        codes, found = self(x), []
        norms = (x * x).sum(1)
        for at in range(0, min(len(x), 500), 50):
            some = np.arange(at, min(at + 50, len(x), 500))
            near = norms - 2 * x[some] @ x.T
            near[np.arange(len(some)), some] = np.inf
            best = np.argsort(near, axis=1)[:, : min(k, len(x) - 1)]
            found.append(np.bitwise_count(codes[some][:, None] ^ codes[best]).ravel())
        return int(np.quantile(np.concatenate(found), RECALL, method="higher")) if found and found[0].size else self.bits


class Block:
    """The tables of a block of rows."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, model: Codes) -> None:
        self.ids, self.vectors, self.model = ids, vectors, model
        self.alone = len(np.unique(ids)) == len(ids)
        self.codes = model(vectors.astype(np.float64))
        width = max(1, min(16, int(np.log2(max(2, len(ids))))))
        parts = -(-model.bits // width)
        edges = np.linspace(0, model.bits, parts + 1).astype(int).tolist()
        self.parts = list(itertools.pairwise(edges))
        self.tables = []
        for a, b in self.parts:
            value = self._part(self.codes, a, b)
            order = np.argsort(value, kind="stable")
            self.tables.append((order, np.searchsorted(value[order], np.arange((1 << (b - a)) + 1))))
        self.balls: dict[tuple[int, int], np.ndarray] = {}
        #: Rows that probing met, over all queries.
        self.touched = 0

    @staticmethod
    def _part(codes: np.ndarray, a: int, b: int) -> np.ndarray:
        return ((codes >> np.uint64(a)) & np.uint64((1 << (b - a)) - 1)).astype(np.int64)

    def _ball(self, width: int, radius: int) -> np.ndarray:
        if (width, radius) not in self.balls:
            value = np.arange(1 << width)
            self.balls[width, radius] = value[np.bitwise_count(value) <= radius]
        return self.balls[width, radius]

    def within(self, code: np.uint64, radius: int) -> np.ndarray:
        """Places of all rows whose code is within radius."""
        near = radius // len(self.parts)
        met = np.zeros(len(self.ids), bool)
        for (a, b), (order, start) in zip(self.parts, self.tables, strict=True):
            keys = self._ball(b - a, near) ^ self._part(np.array([code]), a, b)[0]
            first, n = start[keys], start[keys + 1] - start[keys]
            first, n = first[n > 0], n[n > 0]
            met[order[np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())]] = True
        places = np.flatnonzero(met)
        self.touched += len(places)
        return places[np.bitwise_count(self.codes[places] ^ code) <= radius]

    def nearest(self, query: np.ndarray, code: np.uint64, k: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and distances of rows within radius that hold the k nearest of another id, whichever id asks; ties to smaller ids.

        These are the k + 1 nearest if ids don't repeat, else the 2 k nearest of the k nearest of each id.
        """
        places = self.within(code, radius)
        away = np.sqrt(((self.vectors[places].astype(np.float64) - query) ** 2).sum(1))
        most, look = (k + 1 if self.alone else 2 * k), 4 * (k + 1)
        while True:
            some, near = places, away
            if len(places) > look:
                cut = away <= np.partition(away, look - 1)[look - 1]
                some, near = places[cut], away[cut]
            best = np.lexsort((self.ids[some], near))
            if not self.alone:
                own = self.ids[some][best]
                order = np.argsort(own, kind="stable")
                begins = np.searchsorted(own[order], own[order])
                best = best[np.sort(order[np.arange(len(own)) - begins < k])]
            if len(best) >= most or len(some) == len(places):
                return self.ids[some][best[:most]], near[best[:most]]
            look *= 8


def _matrix(column: pa.ListArray) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _search(rows: DataFrame, queries: DataFrame, model: Codes, k: int, blocks: int, radius: int) -> DataFrame:
    """(query, id, away): rows (id, vector) near each of queries (query, vector) within radius, as Block.nearest gives them for each block."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, now, block, ids, vectors = shared.value, None, None, [], []
        for batch in batches:
            which, kind, own = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            matrix = _matrix(batch.column(3))
            out: tuple[list, list, list] = ([], [], [])
            cuts = np.flatnonzero(np.r_[True, (np.diff(which) != 0) | (np.diff(kind) != 0)])
            for a, b in itertools.pairwise([*cuts.tolist(), len(which)]):
                if which[a] != now:
                    now, block, ids, vectors = which[a], None, [], []
                if kind[a] == 0:
                    ids.append(own[a:b])
                    vectors.append(matrix[a:b])
                    continue
                if not ids:
                    continue
                if block is None:
                    block = Block(np.concatenate(ids), np.concatenate(vectors), model)
                points = matrix[a:b].astype(np.float64)
                for query, point, code in zip(own[a:b], points, model(points), strict=True):
                    found, away = block.nearest(point, code, k, radius)
                    out[0].append(np.full(len(found), query))
                    out[1].append(found)
                    out[2].append(away)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], names=["query", "id", "away"])

    dealt = rows.select(F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), F.lit(0).alias("kind"), F.col("id").alias("own"), "vector")
    asked = queries.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("kind"), F.col("query").alias("own"), "vector")
    both = dealt.unionByName(asked).repartition(blocks, "block").sortWithinPartitions("block", "kind")
    return both.mapInArrow(run, "query long, id long, away double")


def _best(found: DataFrame, by: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy("away", "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, every: int = EVERY, block_rows: int = BLOCK, sample: int = SAMPLE, radius: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest of each row whose id is divisible by `every`."""
    spark = embeddings.sparkSession
    small_batches(spark)
    rows = embeddings.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("id").isNotNull() & F.coalesce(finite & F.exists("vector", lambda x: x != 0), F.lit(False)))
    lengths = [r["length"] for r in rows.select(F.size("vector").alias("length")).distinct().collect()]
    found = [_nearest(rows.where(F.size("vector") == n), k, every, block_rows, sample, radius) for n in sorted(lengths)]
    return functools.reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], EMPTY)


def _nearest(rows: DataFrame, k: int, every: int, block_rows: int, sample: int, radius: int | None) -> DataFrame:
    """nearest() of rows (id, vector) whose vectors are equally long."""
    spark = rows.sparkSession
    once = rows.withColumn("nth", F.dense_rank().over(Window.partitionBy("vector").orderBy("id"))).where(F.col("nth") <= k + 1).select("id", "vector").distinct()
    once = materialise(once, "ann-rows")
    total = once.count()
    chosen = once.where(F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1 << 30)) < int((1 << 30) * min(1.0, sample / total))).select("vector")
    learned = chosen.toArrow()["vector"].combine_chunks()
    if not len(learned):
        learned = once.select("vector").limit(1000).toArrow()["vector"].combine_chunks()
    model = Codes(_matrix(learned), k=k)
    asked = materialise(rows.where(F.col("id") % every == 0).distinct(), "ann-asked")
    classes = materialise(asked.select("vector").distinct().withColumn("query", F.monotonically_increasing_id()), "ann-queries")
    members = materialise(asked.join(classes, "vector").select(F.col("id").alias("query_id"), "query"), "ann-members")
    blocks = max(-(-total // block_rows), spark.sparkContext.defaultParallelism)

    def search(queries: DataFrame, within: int) -> DataFrame:
        return _best(_search(once, queries, model, k, blocks, within), ["query"], 2 * k).drop("rank")

    within = model.radius if radius is None else radius
    found = materialise(search(classes, within), "ann-found")
    others = members.join(found, "query").where("id <> query_id").groupBy("query_id", "query").agg(F.count(F.lit(1)).alias("n"))
    short = members.join(others, ["query_id", "query"], "left").where(F.coalesce("n", F.lit(0)) < k).select("query").distinct()
    few = classes.join(short, "query")
    if within < model.bits and not few.isEmpty():
        few = materialise(few, "ann-few")
        found = materialise(found.join(few.select("query"), "query", "left_anti").unionByName(search(few, model.bits)), "ann-found")
    pairs = members.join(found, "query").where("id <> query_id")
    best = _best(pairs, ["query_id", "query"], k)
    return best.select("query_id", "rank", F.col("id").alias("vec_id"), F.col("away").alias("score"))


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
