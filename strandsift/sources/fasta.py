"""FASTA files as tables, and tables as FASTA files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_fasta(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(id, seq): the header behind `>`, and its lines joined. Records may not hold `>` in their header's text."""
    records = spark.read.text(path, lineSep=">").select(F.regexp_replace("value", "\r", "").alias("record")).where(F.trim("record") != "")
    lines = F.split("record", "\n")
    return records.select(F.trim(lines[0]).alias("id"), F.regexp_replace(F.array_join(F.slice(lines, 2, F.greatest(F.lit(0), F.size(lines) - 1)), ""), r"\s", "").alias("seq"))


def write_fasta(table: DataFrame, path: str, id_col: str = "id", seq_col: str = "seq", width: int = 70) -> None:
    """Writes a record for each row, in lines of width symbols. Ids are written in one line, without `>`; null ids and sequences as empty ones."""
    header = F.regexp_replace(F.coalesce(F.col(id_col).cast("string"), F.lit("")), "[>\\r\\n]+", " ")
    lines = F.regexp_replace(F.coalesce(F.col(seq_col), F.lit("")), f"(.{{{width}}})(?=.)", "$1\n")
    table.select(F.concat(F.lit(">"), header, F.lit("\n"), lines).alias("value")).write.text(path)
