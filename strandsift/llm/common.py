"""What the training-data operators share: small batches, keys of rows, decisions about rows, joins and ranks that stand hot keys.

Decisions about rows (keep it, take it twice) are made on tables of keys and measures. They reach the texts without moving them: a row's key is its file
and its number there, decisions are written by ranges of such keys, and each task that reads texts fetches the decisions of its own ranges.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandsift.plans.shared import fresh_path, materialise, shared_dir  # noqa: F401  for the operators

ASCII_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: Rows that a lookup table may have at most to be broadcast (its rows are a few dozen bytes each); larger ones are joined by a shuffle.
BROADCAST_ROWS = 50_000

#: Rows of an Arrow batch where rows hold whole texts, vectors or pages: batches are held several times over, by the JVM and by the worker.
BATCH_ROWS, BATCH_BYTES = 500, "16m"


def small_batches(spark: SparkSession) -> None:
    """From now on the session sends at most BATCH_ROWS rows, and about BATCH_BYTES, at once to Python workers."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def binary_list(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    """A string column's values in UTF-8."""
    return batch.column(name).cast(pa.binary()).to_pylist()


def with_column(batch: pa.RecordBatch, **columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, *columns.values()], names=[*batch.schema.names, *columns])


def unused(columns: list[str], *names: str) -> list[str]:
    """Names like the given ones that no column has, in any case of letters."""
    taken, out = {x.lower() for x in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def null_key(name: str) -> Column:
    """A key that is never null: other for null than for any string."""
    return F.coalesce(F.concat(F.lit("s"), F.col(name).cast("string")), F.lit("n"))


def lookup(table: DataFrame, rows: int) -> DataFrame:
    """table with a hint to broadcast it if its counted rows are few."""
    return F.broadcast(table) if rows <= BROADCAST_ROWS else table


def join_hot(rows: DataFrame, table: DataFrame, keys: list[str], n: str, total: int) -> DataFrame:
    """rows joined with a table that has one row for each of keys; its column n, which is dropped, says how many rows have them, total at most.

    Keys of over total / BROADCAST_ROWS rows, of which there are fewer than BROADCAST_ROWS, come by broadcast, so no join key is hot.
    """
    if total <= BROADCAST_ROWS:
        return rows.join(F.broadcast(table.drop(n)), keys)
    (hot,) = unused([*rows.columns, *table.columns], "__hot")
    heavy = F.col(n) > total // BROADCAST_ROWS
    first = rows.join(F.broadcast(table.where(heavy).drop(n).withColumn(hot, F.lit(True))), keys, "left")
    rest = first.where(F.col(hot).isNull()).select(*rows.columns).join(table.where(~heavy).drop(n), keys)
    return first.where(F.col(hot)).drop(hot).unionByName(rest)


#: Rows of a file whose decisions lie together, and about how many decisions share a folder: a task that reads texts fetches one or two folders.
STRIDE, TOGETHER = 1 << 17, 200_000
_ROWWISE = ("Project", "Filter", "Repartition", "RepartitionByExpression", "SubqueryAlias", "LogicalRelation", "Relation")


def _rows_of_files(plan) -> bool:
    """Whether each row of a plan is one row of a file."""
    children = plan.children()
    return plan.nodeName().split(" ")[0] in _ROWWISE and children.size() <= 1 and all(_rows_of_files(children.apply(i)) for i in range(children.size()))


def keyed(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """docs and two more columns, with their names: a number for the row's file, and the row's number in it. Tables that aren't rows of Parquet files are written first."""
    file, row = unused(docs.columns, "__file", "__row")
    if "_metadata" not in docs.columns and _rows_of_files(docs._jdf.queryExecution().analyzed()):
        try:
            return docs.select("*", F.xxhash64("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(row)), file, row
        except AnalysisException:  # files of another kind
            pass
    return materialise(docs.withColumn(row, F.monotonically_increasing_id()), "rows").withColumn(file, F.lit(0).cast("long")), file, row


def take_rows(docs: DataFrame, file: str, row: str, decisions: DataFrame, default: int) -> DataFrame:
    """docs (from keyed()) without their keys, each row as often as decisions (__file, __row, __times) say, or default times.

    Decisions are shuffled and written; docs aren't. A task holds the decisions of a few ranges of STRIDE rows at a time.
    """
    spark = docs.sparkSession
    small_batches(spark)
    decisions = materialise(decisions, "decisions")
    buckets = buckets_for(decisions.count(), TOGETHER)

    def bucket(file: str, row: str) -> Column:
        return F.pmod(F.xxhash64(F.col(file), F.floor(F.col(row) / STRIDE)), F.lit(buckets)).cast("int")

    folder = fresh_path(spark, "by-range")
    decisions.withColumn("bucket", bucket("__file", "__row")).repartition("bucket").write.partitionBy("bucket").parquet(folder)
    (at,) = unused(docs.columns, "__at")
    names = [c for c in docs.columns if c not in (file, row)]

    def read(which: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        import pyarrow.parquet as pq
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(f"{folder}/bucket={which}")
        if system.get_file_info(path).type == fs.FileType.NotFound:
            return {}
        table = pq.ParquetDataset(path, filesystem=system, partitioning=None).read()
        own, rows, times = (table[x].to_numpy() for x in ("__file", "__row", "__times"))
        order = np.lexsort((rows, own))
        own, rows, times = own[order], rows[order], times[order]
        cuts = np.flatnonzero(np.r_[True, own[1:] != own[:-1], True]) if len(own) else np.array([0])
        return {int(own[a]): (rows[a:b], times[a:b]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, dict] = {}
        for batch in batches:
            files, rows, which = (batch.column(x).to_numpy() for x in (file, row, at))
            times = np.full(len(rows), default, np.int64)
            for k in np.unique(which).tolist():
                if k not in held:
                    if len(held) >= 4:
                        del held[next(iter(held))]
                    held[k] = read(k)
                for own in np.unique(files[which == k]).tolist():
                    if own in held[k]:
                        mine = np.flatnonzero((which == k) & (files == own))
                        told, n = held[k][own]
                        place = np.minimum(np.searchsorted(told, rows[mine]), len(told) - 1)
                        found = told[place] == rows[mine]
                        times[mine[found]] = n[place[found]]
            taken = pa.array(np.repeat(np.arange(len(rows)), times))
            yield pa.RecordBatch.from_arrays([batch.column(i).take(taken) for i, c in enumerate(batch.schema.names) if c not in (file, row, at)], names=names)

    schema = docs.select(*[F.col(f"`{c}`") for c in names]).schema
    return docs.withColumn(at, bucket(file, row)).mapInArrow(run, schema)


def buckets_for(rows: int, per_bucket: int = 20_000) -> int:
    return max(1, -(-rows // per_bucket))


def spread_over(spark: SparkSession, rows: int) -> int:
    """Buckets in which a hot group's rows are ranked: as many as tasks that a shuffle has, at least, so that small tables are dealt out too."""
    return max(buckets_for(rows), int(spark.conf.get("spark.sql.shuffle.partitions")))


def rank_within(df: DataFrame, keys: list[str], bucket: Column, order: list[Column], name: str, ties: bool = False, table: DataFrame | None = None) -> DataFrame:
    """Adds each row's rank from 0 among the rows of its keys, in the order of (bucket, *order).

    Ranks are counted inside (keys, bucket) and moved by the number of rows in earlier buckets, so the rows of a hot key spread over its buckets.
    bucket may be a struct. ties: equal rows of a bucket share a rank. table: further columns, one row for each of keys, which reach the rows by way of their buckets.
    """
    df = df.withColumn("__bucket", bucket)
    parts = [*keys, "__bucket"]
    sizes = df.groupBy(*parts).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select(*parts, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    base = base if table is None else base.join(table, keys)
    inside = (F.rank() if ties else F.row_number()).over(Window.partitionBy(*parts).orderBy(*order))
    ranked = df.withColumn("__inside", inside).join(base, parts)
    return ranked.withColumn(name, F.col("__base") + F.col("__inside") - 1).drop("__bucket", "__base", "__inside")
