"""Needles as a table: written to the shared folder, read by tasks, in parts of bounded size.

Nothing of the table goes through the driver but its measures. A task (in fact a worker, for all of its tasks) builds the automaton of one part at its
first text; a table of over PART symbols is searched in several parts, each by a pass of its own over the haystacks, so no task holds more than a part.
Needles that are null or empty are left out; an id may have several needles, and a needle several ids.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandsift.plans.shared import fresh_path, materialise

#: Symbols of needles that one task holds, at some 50 bytes each in its automaton.
PART = 4_000_000


class NeedleTable:
    """needles: id_col and text_col. error_rate: for seeds, see seed_length()."""

    def __init__(self, needles: DataFrame, id_col: str = "needle_id", text_col: str = "needle", error_rate: float = 0.0, part: int | None = None) -> None:
        kept = needles.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("needle")).where(F.length("needle") > 0)
        kept = materialise(kept, "needles")
        whole = seed_column(F.col("needle"), error_rate)
        size = kept.agg(F.coalesce(F.sum(F.length("needle")), F.lit(0)).alias("symbols"), F.coalesce(F.max(F.length("needle")), F.lit(0)).alias("longest"), F.coalesce(F.min(F.when(whole >= 3, whole)), F.lit(0)).alias("q")).first()
        self.longest, self.q = size["longest"], int(size["q"])
        parts = max(1, -(-size["symbols"] // (part or PART)))
        folder = fresh_path(needles.sparkSession, "needle-parts")
        kept.withColumn("part", F.pmod(F.xxhash64("id", "needle"), F.lit(parts))).repartition("part").write.partitionBy("part").parquet(folder)
        self.paths = [f"{folder}/part={i}" for i in range(parts)]

    def each(self, scan: Callable[[str], DataFrame]) -> DataFrame:
        """The hits of all parts; scan gives those of the part at a path."""
        return functools.reduce(DataFrame.unionByName, map(scan, self.paths))


def seed_column(text, error_rate: float):
    """The longest seeds of a needle that can't all be missed, as a column."""
    return F.floor(F.length(text) / (F.floor(F.lit(float(error_rate)) * F.length(text)) + 1))


def read_part(path: str) -> list[tuple[int, str]]:
    """(id, needle) of a part, in order."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    system, where = fs.FileSystem.from_uri(path)
    if system.get_file_info(where).type == fs.FileType.NotFound:
        return []
    table = pq.ParquetDataset(where, filesystem=system, partitioning=None).read(["id", "needle"])
    return sorted(zip(table["id"].to_pylist(), table["needle"].to_pylist(), strict=True), key=lambda x: (x[0] is None, x[0] or 0, x[1]))


def automaton(words):
    """Finds words; None if there are none."""
    import ahocorasick

    found = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
    for x in words:
        found.add_word(x)
    if not len(found):
        return None
    found.make_automaton()
    return found


def places(finder, text: str) -> list[tuple[int, str]]:
    """(begin, word) of every occurrence of an automaton's words, in order of ends."""
    return [] if finder is None else [(end - n + 1, text[end - n + 1 : end + 1]) for end, n in finder.iter(text)]
