"""Searches as SQL table functions."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from strandsift.operators import kernels


@udtf(returnType="end_pos: bigint, distance: int")
class SeqFind:
    """seq_find(text, needle, k): ends within k edits, and distances."""

    def eval(self, text: str, needle: str, k: int) -> Iterator[tuple[int, int]]:
        if text and needle and k is not None:
            ends, distances, _ = kernels.edit_ends(text, needle, k, kernels.first_edit_state(needle))
            yield from zip(ends, distances, strict=True)


def register(spark: SparkSession) -> None:
    spark.udtf.register("seq_find", SeqFind)
