"""SimHash near-duplicates: multi-index hashing over fingerprint segments, then connected components.

A fingerprint has 64 bits: each is 1 if it is set in over half of the XXH64 hashes (seed 42) of the text's word shingles. Texts link if their
fingerprints differ in at most 4 bits. Such a pair differs in at most 2 bits of one 32-bit half. Each distinct fingerprint therefore enumerates
the Hamming ball of radius 1 around both halves (33 keys each) and is put in the table under all of them: two halves at distance 2 meet at a value
between them. The members of a key are compared completely.

Scale: exact copies collapse into one fingerprint before anything else, so a group of copies is one row. The table has 66 rows for each distinct
fingerprint, in proportion to the input, made and compared by as many tasks as there are fingerprints for. A key's members are compared in place and
give a spanning forest, not all pairs, once they are many. Keys that would hold over `hot` members are split further by values near the other half
(see `_hot_edges`), where each group links to its least member without comparing pairs. Texts are read once for fingerprints; keep_one() reads them
once more, and shuffles none.

Null texts count as empty; empty texts have fingerprint 0 and link like any other; texts of any length are read whole. A null doc_id takes part, but
a component's id is the smallest one that is not null (null if there is none). Repeated rows, also of one id, each give a row. Ties, when one row of a
component is kept, go by fingerprint, text and place in the file. Empty tables give empty ones. Further columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandsift.llm.common import ASCII_LOWER, binary_list, join_hot, keyed, materialise, small_batches, take_rows, with_column
from strandsift.plans.planner import spread

SHINGLE, SEED, RADIUS = 4, 42, 4
#: A run of more members than this is walked as a graph instead of pair by pair.
PAIRWISE = 48
#: Members of a key from which it is split by the other half.
HOT = 20_000
#: Fingerprints whose keys one task makes, and rows of keys that one task compares.
FANNED, COMPARED = 50_000, 4_000_000


def fingerprint(text: bytes | None) -> int:
    """The fingerprint as a signed 64-bit number."""
    words = (text or b"").translate(ASCII_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    start = end - size
    many = len(words) >= SHINGLE
    starts, ends = (start[: len(words) - SHINGLE + 1], end[SHINGLE - 1 :]) if many else (start[:1], end[-1:])
    hash64 = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for at in range(0, len(starts), 1 << 16):
        spans = zip(starts[at : at + (1 << 16)].tolist(), ends[at : at + (1 << 16)].tolist(), strict=True)
        hashes = np.array([hash64(joined[a:b], SEED) for a, b in spans], np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits((2 * ones > len(starts)).astype(np.uint8), bitorder="little").view(np.int64)[0])


def with_fingerprints(docs: DataFrame, text: str = "text", name: str = "fp") -> DataFrame:
    """docs and a column of fingerprints."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield with_column(batch, **{name: pa.array([fingerprint(x) for x in binary_list(batch, text)], pa.int64())})

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())]))


def _distance(x: np.ndarray, y: np.ndarray | np.int64) -> np.ndarray:
    """Differing bits; numpy counts those of a signed number's absolute value, hence the view."""
    return np.bitwise_count((x ^ y).view(np.uint64))


def _forest(members: np.ndarray) -> tuple[list[int], list[int]]:
    """Edges of a spanning forest of the links among members: each member that is reached looks among those not reached yet."""
    left, right, waiting = [], [], members
    while len(waiting):
        front, waiting = [waiting[0]], waiting[1:]
        while front and len(waiting):
            x = front.pop()
            near = _distance(waiting, x) <= RADIUS
            if near.any():
                found = waiting[near].tolist()
                left += [int(x)] * len(found)
                right += found
                front += found
                waiting = waiting[~near]
    return left, right


def _key_edges(key: np.ndarray, fp: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links among the members of each key; key and fp sorted."""
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    size = np.diff(np.r_[first, len(key)])
    for a, n in zip(first[size > PAIRWISE].tolist(), size[size > PAIRWISE].tolist(), strict=True):
        left, right = _forest(fp[a : a + n])
        yield np.array(left, np.int64), np.array(right, np.int64)
    at = np.flatnonzero(np.repeat((size > 1) & (size <= PAIRWISE), size))
    for step in range(1, PAIRWISE):
        at = at[at + step < len(key)]
        at = at[key[at] == key[at + step]]
        if not len(at):
            break
        x, y, k = fp[at], fp[at + step], key[at]
        differ = x ^ y
        near = _distance(x, y) <= RADIUS
        x, y, k, differ = x[near], y[near], k[near], differ[near]
        # A pair meets under several keys; the one that counts is in the first half, if that is near enough, at the value with the lowest differing bit flipped.
        high = (differ >> 32) & 0xFFFFFFFF
        low = differ & 0xFFFFFFFF
        second = k >> 32 == 1
        own = np.where(second, low, high)
        value = np.where(second, x, x >> 32) & 0xFFFFFFFF
        mine = (k & 0xFFFFFFFF) == (value ^ (own & -own))
        mine &= ~second | (np.bitwise_count(high) > 2)
        yield x[mine], y[mine]


def _link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (key, fp), sorted; a key's rows may go over several batches."""
    keys, fps = [], []

    def edges(key: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        for x, y in _key_edges(key, fp) if len(key) > 1 else ():
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array(np.maximum(x, y)), pa.array(np.minimum(x, y))], names=["u", "v"])

    for batch in batches:
        key, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
        cut = int(np.searchsorted(key, key[-1])) if len(key) else 0
        if cut:
            yield from edges(np.concatenate([*keys, key[:cut]]), np.concatenate([*fps, fp[:cut]]))
            keys, fps = [], []
        keys.append(key[cut:])
        fps.append(fp[cut:])
    if keys:
        yield from edges(np.concatenate(keys), np.concatenate(fps))


def _keyed(fps: DataFrame) -> DataFrame:
    """(key, fp): each half's value and the 32 values one bit away; bit 32 of the key says which half."""
    return fps.select(
        F.explode(
            F.expr(
                "transform(sequence(0, 65), i -> shiftleft(cast(i div 33 as bigint), 32) + "
                "((if(i < 33, shiftrightunsigned(fp, 32), fp & 4294967295L)) ^ if(i % 33 = 0, 0L, shiftleft(1L, cast(i % 33 - 1 as int)))))"
            )
        ).alias("key"),
        "fp",
    )


def _hot_keys(fps: DataFrame, hot: int) -> DataFrame | None:
    """Keys of over `hot` members; None if there are none. A key over twice that has a value of over hot / 33 among its 33."""
    counts = fps.select(F.explode(F.expr("array(shiftrightunsigned(fp, 32), 4294967296L + (fp & 4294967295L))")).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    dense = materialise(counts.where(F.col("n") > hot / 33), "simhash-dense")
    if dense.isEmpty():
        return None
    ball = dense.select(F.explode(F.expr("transform(sequence(0, 32), i -> key ^ if(i = 0, 0L, shiftleft(1L, i - 1)))")).alias("key"), "n")
    keys = materialise(ball.groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") > hot).select("key"), "simhash-hot")
    return None if keys.isEmpty() else keys


def _hot_edges(rows: DataFrame) -> DataFrame:
    """Links among members of the same hot key: pairs at distance 4 or less share a value within 2 bits of both, whose one half is the key.

    Each member lists these values of the other half; whoever shares one links to its least member. No pairs are compared or listed.
    """
    flips = [0, *(1 << i for i in range(32)), *((1 << i) | (1 << j) for i in range(32) for j in range(i))]
    second = F.shiftright("key", 32) == 1
    own = F.when(second, F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))).otherwise(F.shiftrightunsigned("fp", 32))
    other = F.when(second, F.shiftrightunsigned("fp", 32)).otherwise(F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)))
    off = F.bit_count(own.bitwiseXOR(F.col("key").bitwiseAND(F.lit(0xFFFFFFFF))))
    masks = F.array(*[F.lit(x).cast("long") for x in flips])
    near = rows.select("key", "fp", other.alias("other"), F.explode(F.when(off == 0, masks).otherwise(F.slice(masks, 1, 33))).alias("flip"))
    near = near.select("key", "fp", F.col("other").bitwiseXOR(F.col("flip")).alias("near"))
    least = near.groupBy("key", "near").agg(F.min("fp").alias("v"))
    return near.join(least, ["key", "near"]).where(F.col("fp") > F.col("v")).select(F.col("fp").alias("u"), "v").distinct()


def links(fps: DataFrame, hot: int = HOT) -> DataFrame:
    """(u, v), u > v: links between distinct fingerprints (column fp) that connect all which are connected."""
    least, n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), fps.count()
    keyed, keys = _keyed(fps.repartition(max(least, -(-n // FANNED)))), _hot_keys(fps, hot)
    rest = keyed if keys is None else keyed.join(keys, "key", "left_anti")
    spread = rest.repartition(max(least, -(-66 * n // COMPARED)), "key").sortWithinPartitions("key", "fp")
    found = spread.mapInArrow(_link, "u long, v long")
    return found if keys is None else found.unionByName(_hot_edges(keyed.join(keys, "key")))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (u, v): the least node that can be reached. Alternating large-star and small-star steps.

    A node with many edges (the least node of a large component has all of its others) is no hot join key: join_hot() broadcasts its row.
    """
    edges = materialise(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
    state = None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if tuple(now) == state or not now[0]:
            break
        state = tuple(now)
        both = edges.select(F.col("u").alias("a"), F.col("v").alias("b")).unionByName(edges.select(F.col("v").alias("a"), F.col("u").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")).select("a", F.least("a", "m").alias("m"), "n")
        large = join_hot(both.where("b > a"), least, ["a"], "n", 2 * now[0]).select(F.col("b").alias("u"), F.col("m").alias("v")).distinct()
        large = materialise(large, "cc")
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        small = join_hot(large, least, ["u"], "n", 2 * now[0])
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        edges = materialise(small.distinct(), "cc")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """(id_col, fp long, component_id, root long: the component's least fingerprint) for every row of docs."""
    prints = materialise(with_fingerprints(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))).drop("text"), "simhash-docs")
    classes = materialise(prints.groupBy("fp").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")), "simhash-classes")
    named = classes.join(components(links(classes.select("fp"), hot)).withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = materialise(named, "simhash-rooted")
    smallest = materialise(named.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("members")), "simhash-smallest")
    named = materialise(join_hot(named.select("fp", "root", "n"), smallest, ["root"], "members", classes.count()), "simhash-named")
    return join_hot(prints, named, ["fp"], "n", prints.count()).select(F.col("id").alias(id_col), "fp", "component_id", "root")


def hex_digits(fp: str = "fp") -> F.Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return found.select("doc_id", hex_digits().alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """docs without all but one row of each component: that of the smallest id (null last), then the least fingerprint, then the least hash of its text, then the first in its file.

    Each distinct fingerprint, then each component, names its one row; only these names meet the texts, which stay where they are.
    """
    rows, file, row = keyed(docs)
    prints = rows.select(F.col(file).alias("file"), F.col(row).alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("hash"))
    prints = with_fingerprints(prints).select("fp", F.struct(F.col("id").isNull().alias("no_id"), "id", "fp", "hash", "file", "row").alias("first"))
    classes = materialise(prints.groupBy("fp").agg(F.min("first").alias("first")), "simhash-firsts")
    linked = components(links(classes.select("fp"), hot)).withColumnRenamed("node", "fp")
    chosen = classes.join(linked, "fp", "left").groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("first").alias("first"))
    return take_rows(rows, file, row, chosen.select(F.col("first.file").alias("__file"), F.col("first.row").alias("__row"), F.lit(1).alias("__times")), 0)
