"""Resumable searches on a stream of chunks.

Each key's chunks carry a number, from `first` on. The same chunks count as in batch: each number once (of different texts under one number the first
that comes), none without a number or with one under first; a null text is an empty chunk. The search state waits in the state store between
micro-batches, and so do chunks that come early, up to WAITING symbols for a key. Beyond that, and at the end of a bounded search, numbers that haven't
come are given up: the chunks that wait are searched in order, as in batch. Late, early, missing and repeated chunks thus give the hits of one pass,
unless a chunk comes later than WAITING symbols behind it; such a chunk takes no part.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from strandsift.operators import kernels
from strandsift.operators.matchers import RestorableMyers, RestorableShiftOr
from strandsift.operators.protocol import set_up, tear_down

STATE = "next long, position long, search string, early string"
#: Symbols of early chunks that wait for a key.
WAITING = 1 << 24


def dump_state(state: kernels.PrefixState | kernels.EditState) -> str:
    return json.dumps([hex(x) for x in vars(state).values()])


def load_state(text: str, kind: type) -> kernels.PrefixState | kernels.EditState:
    return kind(*(int(x, 16) for x in json.loads(text)))


def _schema(chunks: DataFrame, matcher: RestorableShiftOr | RestorableMyers, id_col: str) -> T.StructType:
    return T.StructType([chunks.schema[id_col], *(T.StructField(n, t) for n, t in matcher.fields)])


def find_stream(chunks: DataFrame, matcher: RestorableShiftOr | RestorableMyers, id_col: str = "haystack_id", order_col: str = "chunk_idx", seq_col: str = "seq", first: int = 0, waiting: int = WAITING) -> DataFrame:
    """(id_col, end_pos[, distance]) for every hit, as soon as its chunk's turn has come. chunks: a streaming DataFrame."""
    kind = type(matcher.start())
    names = [id_col, *(n for n, _ in matcher.fields)]

    def run(key: tuple, parts: Iterator[pd.DataFrame], group: GroupState) -> Iterator[pd.DataFrame]:
        if group.exists:
            turn, position, search, early = group.get
            state, held = load_state(search, kind), {int(k): v for k, v in json.loads(early).items()}
        else:
            turn, position, state, held = first, 0, matcher.start(), {}
        rows, size = [], sum(map(len, held.values()))
        set_up(matcher)
        try:
            for part in parts:
                for i, text in zip(part[order_col].tolist(), part[seq_col].tolist(), strict=True):
                    if i is not None and i == i and i >= turn and int(i) not in held:
                        held[int(i)] = text if isinstance(text, str) else ""
                        size += len(held[int(i)])
                    while held and (turn in held or size > waiting):
                        turn = turn if turn in held else min(held)
                        text = held.pop(turn)
                        *found, state = matcher.step(text, state)
                        rows += [(key[0], position + hit[0], *hit[1:]) for hit in zip(*found, strict=True)]
                        position, size, turn = position + len(text), size - len(text), turn + 1
        finally:
            tear_down(matcher)
        group.update((turn, position, dump_state(state), json.dumps(held)))
        if rows:
            yield pd.DataFrame(rows, columns=names)

    kept = chunks.select(id_col, order_col, seq_col)
    return kept.groupBy(id_col).applyInPandasWithState(run, _schema(chunks, matcher, id_col), STATE, "append", GroupStateTimeout.NoTimeout)


def drain(stream: DataFrame, tag: str, marks: str | None = None) -> DataFrame:
    """Runs a stream over all that its source holds now, into a table in the shared folder, and reads that. marks: the stream's checkpoint folder."""
    from strandsift.plans.shared import fresh_path

    spark = stream.sparkSession
    path, marks = fresh_path(spark, tag), marks or fresh_path(spark, f"{tag}-marks")
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", marks).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def _released(marks: str, found: DataFrame, matcher: RestorableShiftOr | RestorableMyers, id_col: str) -> DataFrame:
    """Hits in the chunks that still wait in the state store of a stream that has ended."""
    kind = type(matcher.start())
    names = found.columns

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for own, position, search, early in zip(*(part[c].tolist() for c in ("id", "position", "search", "early")), strict=True):
                state = load_state(search, kind)
                for _, text in sorted((int(k), v) for k, v in json.loads(early).items()):
                    *hits, state = matcher.step(text, state)
                    rows += [(own, position + hit[0], *hit[1:]) for hit in zip(*hits, strict=True)]
                    position += len(text)
            yield pd.DataFrame(rows, columns=names)

    left = found.sparkSession.read.format("statestore").load(marks)
    state = F.col("value.groupState")
    left = left.select(F.col(f"key.`{left.schema['key'].dataType.fieldNames()[0]}`").alias("id"), state["position"].alias("position"), state["search"].alias("search"), state["early"].alias("early"))
    return left.where(F.col("early") != "{}").mapInPandas(run, found.schema)


def search_stream(chunks: DataFrame, matcher: RestorableShiftOr | RestorableMyers, tag: str, id_col: str = "haystack_id", order_col: str = "chunk_idx", seq_col: str = "seq", first: int = 0, waiting: int = WAITING) -> DataFrame:
    """All hits in what a stream's source holds now: those of the stream, and of chunks that wait behind a gap when it ends."""
    from strandsift.plans.shared import fresh_path

    marks = fresh_path(chunks.sparkSession, f"{tag}-marks")
    found = drain(find_stream(chunks, matcher, id_col, order_col, seq_col, first, waiting), tag, marks)
    return found.unionByName(_released(marks, found, matcher, id_col))
