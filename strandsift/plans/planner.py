"""How a search runs: which columns are read, how long sequences are cut, where rows go.

A sequence is cut into pieces of CHUNK symbols with the context that a match needs: pieces own the beginnings (or the ends) of the matches in
their range and see window - 1 symbols more on the right (or the left), so every match is found once. Rows stay in their task, without a shuffle,
unless the caller wants the pieces dealt out over a number of tasks: a few long sequences then spread.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandsift.operators.protocol import set_up, tear_down

CHUNK = 1 << 16
_CUT = [("__from", pa.int64()), ("__low", pa.int64()), ("__high", pa.int64()), ("__text", pa.string())]


def cut(text: str, window: int, ends: bool, size: int) -> Iterator[tuple[int, int, int, str]]:
    """(where the piece begins, own range [low, high) of positions or, of ends, (low, high], the piece)."""
    for at in range(0, max(1, len(text)), size):
        high = min(at + size, len(text))
        low = max(0, at - max(0, window - 1)) if ends else at
        yield low, at, high, text[low : high if ends else high + max(0, window - 1)]


def spread(table: DataFrame) -> DataFrame:
    """A table as read from files, dealt out if it comes in fewer parts than there are cores, as small files do. Large tables stay as they are."""
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(cores) if table.rdd.getNumPartitions() < cores else table


def scan(
    haystacks: DataFrame,
    id_col: str,
    seq_col: str,
    matcher: object,
    search: Callable[[str], tuple[list, ...]],
    fields: list[tuple[str, T.DataType]],
    window: int,
    ends: bool = False,
    size: int = CHUNK,
    deal: int = 0,
) -> DataFrame:
    """id_col and fields for every hit. search gives the hits of one piece: positions first, then further columns. deal: over how many tasks pieces go, 0 if they stay."""
    source = haystacks.select(id_col, seq_col)
    arrow = [pa.int32() if isinstance(t, T.IntegerType) else pa.int64() if isinstance(t, T.LongType) else pa.string() for _, t in fields]
    names = [id_col, *(n for n, _ in fields)]

    def cutting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, pieces = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                for piece in cut(text, window, ends, size) if text else ():
                    rows.append(i)
                    pieces.append(piece)
            columns = list(zip(*pieces, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *(pa.array(x, t) for x, (_, t) in zip(columns, _CUT, strict=True))], names=[id_col, *(n for n, _ in _CUT)])

    def searching(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        set_up(matcher)
        try:
            yield from hits(batches)
        finally:
            tear_down(matcher)

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if deal:
                pieces = zip(range(batch.num_rows), *(batch.column(i).to_pylist() for i in range(1, 5)), strict=True)
            else:
                pieces = ((i, *piece) for i, text in enumerate(batch.column(1).to_pylist()) if text for piece in cut(text, window, ends, size))
            rows: list[int] = []
            out: list[list] = [[] for _ in fields]
            for i, begin, low, high, text in pieces:
                found = search(text)
                for hit in zip(*found, strict=True):
                    at = begin + hit[0]
                    if low < at <= high if ends else low <= at < high:
                        rows.append(i)
                        for column, value in zip(out, (at, *hit[1:]), strict=True):
                            column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *(pa.array(x, t) for x, t in zip(out, arrow, strict=True))], names=names)

    schema = T.StructType([haystacks.schema[id_col], *(T.StructField(n, t) for n, t in fields)])
    if deal:
        pieces = T.StructType([haystacks.schema[id_col], *(T.StructField(n, T.StringType() if t == pa.string() else T.LongType()) for n, t in _CUT)])
        source = source.mapInArrow(cutting, pieces).repartition(deal)
    return source.mapInArrow(searching, schema)


#: Chunk numbers that one step of a resumable search covers.
SPAN = 256


def resume(chunks: DataFrame, id_col: str, order_col: str, seq_col: str, matcher: object, fields: list[tuple[str, T.DataType]], first: int = 0, span: int = SPAN) -> DataFrame:
    """id_col and fields for every hit in the sequences that the chunks of each id make, in order of their numbers.

    A number counts once (of different texts under it, the one with the least hash), numbers may be missing, and chunks without a number or with one
    under first take no part. A null text is an empty chunk; a null id is one of its own.

    Chunks are searched in blocks of span numbers, all at once: a block begins in the state behind the last window - 1 symbols before it, which finds
    the same. Lengths and ends of chunks are shuffled for these contexts, the chunks themselves once. A block is sorted inside its task and streamed.
    """
    arrow = [pa.int32() if isinstance(t, T.IntegerType) else pa.int64() for _, t in fields]
    reach, kind = max(0, matcher.window_size() - 1), chunks.schema[id_col]
    names = [id_col, *(n for n, _ in fields)]
    key = T.StructField("id", kind.dataType)
    text = F.coalesce(F.col(seq_col), F.lit(""))
    rows = chunks.where(F.col(order_col) >= first).select(F.col(id_col).alias("id"), F.floor((F.col(order_col) - first) / span).alias("block"), F.col(order_col).cast("long").alias("number"), F.xxhash64(text).alias("hash"), text.alias("text"))
    order = ["id", "block", "number", "hash"]

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """Rows (id, block, number, ...), the first of each number."""
        last: tuple | None = None
        for batch in batches:
            for row in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if row[:3] != last:
                    last = row[:3]
                    yield row

    def summing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(id, block, symbols, end) of each block."""
        now, symbols, end, out = None, 0, "", []
        for own, block, _, _, n, tail in once(batches):
            if now != (own, block):
                out += [(*now, symbols, end)] if now else []
                now, symbols, end = (own, block), 0, ""
            symbols, end = symbols + n, (end + tail)[-reach:] if reach else ""
        yield _rows([*out, (*now, symbols, end)] if now else out, kind, batch_names=("id", "block", "symbols", "end"))

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(id, block, offset, context): what stands before each block."""
        now, offset, context = object(), 0, ""
        for batch in batches:
            out = []
            for own, block, symbols, end in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if own != now:
                    now, offset, context = own, 0, ""
                out.append((own, block, offset, context))
                offset, context = offset + symbols, (context + end)[-reach:] if reach else ""
            yield _rows(out, kind, batch_names=("id", "block", "offset", "context"))

    def searching(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks' contexts, whose number is null and which come first, and their chunks."""
        state, offset, last = None, 0, None
        for batch in batches:
            out: list[list] = [[] for _ in fields]
            rows: list[int] = []
            for i, (own, block, number, _, text, at) in enumerate(zip(*(x.to_pylist() for x in batch.columns), strict=True)):
                if number is None:
                    state, offset, last = matcher.behind(text, at), at, None
                    continue
                if number == last:
                    continue
                last = number
                *found, state = matcher.step(text, state)
                for hit in zip(*found, strict=True):
                    rows.append(i)
                    for column, value in zip(out, (offset + hit[0], *hit[1:]), strict=True):
                        column.append(value)
                offset += len(text)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *(pa.array(x, t) for x, t in zip(out, arrow, strict=True))], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        set_up(matcher)
        try:
            yield from searching(batches)
        finally:
            tear_down(matcher)

    long = T.LongType()
    blocks = rows.select(*order, F.length("text").cast("long").alias("n"), F.right("text", F.lit(reach)).alias("tail")).repartition("id", "block").sortWithinPartitions(*order)
    blocks = blocks.mapInArrow(summing, T.StructType([key, T.StructField("block", long), T.StructField("symbols", long), T.StructField("end", T.StringType())]))
    before = blocks.repartition("id").sortWithinPartitions("id", "block").mapInArrow(contexts, T.StructType([key, T.StructField("block", long), T.StructField("offset", long), T.StructField("context", T.StringType())]))
    before = before.select("id", "block", F.lit(None).cast("long").alias("number"), F.lit(None).cast("long").alias("hash"), F.col("context").alias("text"), "offset")
    both = rows.withColumn("offset", F.lit(None).cast("long")).unionByName(before).repartition("id", "block").sortWithinPartitions(*order)
    return both.mapInArrow(run, T.StructType([kind, *(T.StructField(n, t) for n, t in fields)]))


def _rows(rows: list[tuple], kind: T.StructField, batch_names: tuple[str, ...]) -> pa.RecordBatch:
    """A batch of (id, long, long, string)."""
    from pyspark.sql.pandas.types import to_arrow_type

    columns = list(zip(*rows, strict=True)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (to_arrow_type(kind.dataType), pa.int64(), pa.int64(), pa.string()), strict=True)], names=list(batch_names))
