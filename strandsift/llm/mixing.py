"""Mixing sources to target weights by entropy balancing.

Each document gets a rate: how often the mix should take it. Among all rates that give every source its target of words, entropy balancing takes
those nearest to 1 in relative entropy, none above `CAP`: rate = min(CAP, exp(a * size)), one `a` for each source. The `a` solve the convex
dual, one equation a source; each Newton step is one aggregation over all (source, size) cells, kept inside a bracket that always shrinks.
Rates become whole copies, each rate's whole part or one more: along a source's sizes, longest first, the number of documents with one more is
rounded so that the words taken stay nearest to what the rates say. What a long document leaves over, shorter ones make up for.

Scale: texts are read once, for their sizes, and by take_copies() once more; none is shuffled. Newton steps and rounding read cells (distinct sizes of a
source, with counts), far fewer than documents. Targets, tilts and brackets are tables with a row for each source; the driver holds numbers only. Which
documents of a cell get the extra copy goes by rank, counted in buckets, so a hot cell isn't one task, nor is a document that many rows repeat.

Sums are exact decimals and ranks go by a hash of id and text, so reruns agree. A null or empty text has size 0; a null source is a source of its own,
last in order. Documents of size 0 take 0 words. Texts count whole, whatever their length. Repeated rows and ids are documents of their own: each row has
its own number of copies (ties between equal rows go by file and place there). An empty table gives an empty one. Further columns may have any names.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from strandsift.llm.common import BROADCAST_ROWS, buckets_for, keyed, lookup, materialise, null_key, rank_within, take_rows
from strandsift.plans.planner import spread

WEIGHTS = (5, 2, 1)
CAP = 3
STEPS = 60
#: A source is solved when its rates give its target but for this share.
CLOSE = 1e-7
#: Rows of one document from which they are ranked in buckets of their own.
CROWD = 20_000
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str = "text") -> F.Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: dict[str | None, int], weights: tuple[float, ...] = WEIGHTS, cap: float = CAP) -> dict[str | None, float]:
    """A plain form of target_table(). Words each source should give: all words shared by weight, none above cap times its size, the excess shared again."""
    order = sorted(sizes, key=lambda x: (x is None, x or ""))
    weight = {x: weights[i % len(weights)] for i, x in enumerate(order)}
    out: dict[str | None, float] = {}
    free, rest = list(order), float(sum(sizes.values()))
    while free:
        total = sum(weight[x] for x in free)
        over = [x for x in free if rest * weight[x] / total > cap * sizes[x]]
        if not over:
            return out | {x: rest * weight[x] / total for x in free}
        for x in over:
            out[x] = float(cap * sizes[x])
        free = [x for x in free if x not in out]
        rest -= sum(out[x] for x in over)
    return out


def target_table(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """sources (__source, words) and target, as targets() gives it. Sources are ranked in ranges; a source is at its cap if cap * words / weight is under the level that is left for the others."""
    ordered = sources.repartitionByRange(F.col("__source").startswith("n"), "__source").withColumn("__part", F.spark_partition_id())
    ordered = materialise(ordered, "mix-ordered")
    ranked = rank_within(ordered.withColumn("__all", F.lit(0)), ["__all"], F.col("__part"), [F.col("__source").startswith("n"), F.col("__source")], "__nth").drop("__all", "__part")
    weight = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("__nth") % len(weights) + 1).cast("int"))
    ranked = materialise(ranked.withColumn("weight", weight).drop("__nth"), "mix-ranked")
    ratio, level, rest, free = F.col("words") * float(cap) / F.col("weight"), 0.0, 0.0, 1.0
    while True:
        over = ratio < level
        sums = ranked.agg(F.sum("words").alias("all"), F.sum(F.when(over, F.col("words") * float(cap))).alias("capped"), F.sum(F.when(~over, F.col("weight"))).alias("free")).first()
        rest, free = float(sums["all"] or 0) - float(sums["capped"] or 0), float(sums["free"] or 0)
        if not free or rest / free <= level:
            break
        level = rest / free
    return ranked.withColumn("target", F.when(F.lit(free) == 0, F.col("words") * float(cap)).when(ratio < level, F.col("words") * float(cap)).otherwise(F.lit(rest) * F.col("weight") / F.lit(free or 1.0))).drop("weight")


def _rate(cap: float) -> F.Column:
    """Of a row with size, scale and tilt."""
    return F.least(F.lit(float(cap)), F.exp(F.least(F.col("tilt") * F.col("size") / F.col("scale"), F.lit(math.log(cap) + 1))))


def balance(cells: DataFrame, sources: DataFrame, n_sources: int, cap: float = CAP) -> DataFrame:
    """sources with each one's tilt, for sizes divided by its scale. cells: (__source, size, n); sources: (__source, words, target, scale), n_sources rows.

    Newton steps on all sources' duals at once, in tables: an aggregation over the cells of sources that aren't solved, then a step of each, kept inside its
    bracket. Only how many are open reaches the driver.
    """
    none, every = F.lit(-math.inf), F.lit(math.inf)
    solve = (F.col("words") > 0) & (F.col("target") < cap * F.col("words") * (1 - 1e-12))
    full = F.when(F.col("words") > 0, 750.0 * F.col("scale")).otherwise(0.0)  # at its cap: every document at the highest rate


    def written(state: DataFrame) -> tuple[DataFrame, int]:
        seen = Observation()
        return materialise(state.observe(seen, F.count_if("open").alias("n")), "mix-tilts"), seen.get["n"]

    # Steps on a table of few rows are work of one task, not of as many as a shuffle has.
    sources = sources.coalesce(-(-max(1, n_sources) // BROADCAST_ROWS))
    state, n_open = written(sources.withColumns({"tilt": F.when(solve, 0.0).otherwise(full), "low": none, "high": every, "open": solve}))
    rate, words = _rate(cap), F.col("n") * F.col("size")
    slope = F.when(rate < cap, words * F.col("size") / F.col("scale") * rate).otherwise(0.0)
    for _ in range(STEPS):
        if not n_open:
            break
        now = lookup(state.where("open").select("__source", "scale", "tilt"), n_sources)
        sums = cells.join(now, "__source").groupBy("__source").agg(F.sum((words * rate).cast("decimal(38,6)")).cast("double").alias("f"), F.sum(slope.cast("decimal(38,6)")).cast("double").alias("d"))
        both = state.join(lookup(sums, n_sources), "__source", "left").withColumn("gap", F.col("f") - F.col("target"))
        both = both.withColumn("close", F.abs("gap") <= F.greatest(F.lit(1e-3), CLOSE * F.col("target")))
        both = both.withColumns({"low": F.when(F.col("open") & (F.col("gap") <= 0), F.greatest("low", "tilt")).otherwise(F.col("low")), "high": F.when(F.col("open") & (F.col("gap") > 0), F.least("high", "tilt")).otherwise(F.col("high"))})
        newton, a, b = F.when(F.col("d") > 0, F.col("tilt") - F.col("gap") / F.col("d")), F.col("low"), F.col("high")
        halved = F.when((a > none) & (b < every), (a + b) / 2).when(a > none, 2 * a + 1).otherwise(2 * b - 1)
        both = both.withColumn("step", F.when((newton > a) & (newton < b), newton).otherwise(halved))
        moves = F.col("open") & ~F.col("close") & (F.col("step") != F.col("tilt"))
        state, n_open = written(both.select(*sources.columns, F.when(moves, F.col("step")).otherwise(F.col("tilt")).alias("tilt"), "low", "high", F.coalesce(moves, F.lit(False)).alias("open")))
    return state.drop("low", "high", "open")


def round_cells(cells: pd.DataFrame) -> pd.DataFrame:
    """One source's cells, and how many of a cell's documents get a copy more than the rate's whole part.

    Longest first; that number is the rates' fractions' sum, rounded down or up, whichever brings the words taken so far nearer to what the rates say.
    """
    cells = cells.sort_values("size", ascending=False, kind="stable")
    owed, more = 0.0, []
    for size, n, rate in zip(cells["size"].tolist(), cells["n"].tolist(), cells["rate"].tolist(), strict=True):
        part = n * (rate - math.floor(rate))
        owed += part * size
        least = min(n, math.floor(part))
        most = min(n, math.ceil(part))
        best = most if abs(owed - most * size) < abs(owed - least * size) else least
        owed -= best * size
        more.append(best)
    return cells.assign(more=more)[["__source", "size", "source_size", "target", "rate", "more"]]


def _mixed(docs: DataFrame, file: str, row: str, id_col: str, text_col: str, source_col: str, weights: tuple[float, ...], cap: float) -> DataFrame:
    """(__file, __row, __id, __name, size, source_size, target, rate, copies) for every row of docs, which come from keyed()."""
    order = F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col(id_col).isNull(), F.coalesce(F.col(text_col), F.lit("")))
    sized = docs.select(F.col(file).alias("__file"), F.col(row).alias("__row"), F.col(id_col).alias("__id"), F.col(source_col).alias("__name"), null_key(source_col).alias("__source"), word_count(text_col).alias("size"), order.alias("__order"))
    sized = materialise(sized, "mix-sizes")
    cells = materialise(sized.groupBy("__source", "size").agg(F.count(F.lit(1)).alias("n")), "mix-cells")
    sources = materialise(cells.groupBy("__source").agg(F.sum(F.col("n") * F.col("size")).alias("words"), F.sum("n").alias("n")), "mix-sources")
    n_sources, rows = sources.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    scale = F.greatest(F.lit(1.0), F.col("words") / F.col("n"))
    wanted = target_table(sources.withColumn("scale", scale).drop("n"), weights, cap)
    told = balance(cells, wanted, n_sources, cap).withColumnRenamed("words", "source_size")
    cells = cells.join(lookup(told, n_sources), "__source").withColumn("rate", _rate(cap))
    schema = "__source string, size long, source_size long, target double, rate double, more long"
    cells = materialise(cells.groupBy("__source").applyInPandas(round_cells, schema), "mix-copies")
    buckets = buckets_for(rows)
    bucket = F.pmod("__order", F.lit(buckets))
    # Rows that repeat a document many times lie behind all others, in buckets of their own: whichever of them get the extra copy, the mix is the same.
    crowds = materialise(sized.groupBy("__order").agg(F.count(F.lit(1)).alias("__crowd")).where(F.col("__crowd") > CROWD), "mix-crowds")
    if n := crowds.count():
        sized = sized.join(lookup(crowds, n), "__order", "left")
        crowded = F.col("__crowd").isNotNull()
        part = F.when(crowded, F.pmod(F.xxhash64("__file", "__row"), F.ceil(F.coalesce("__crowd", F.lit(0)) / CROWD) + 1)).otherwise(F.lit(0))
        bucket = F.struct(crowded.alias("crowded"), F.when(crowded, F.col("__order")).otherwise(bucket).alias("at"), part.alias("part"))
    out = rank_within(sized, ["__source", "size"], bucket, [F.col("__order"), F.col("__id"), F.col("__file"), F.col("__row")], "__rank", table=cells)
    copies = (F.floor("rate") + F.when(F.col("__rank") < F.col("more"), 1).otherwise(0)).cast("int")
    return out.select("__file", "__row", "__id", "__name", "size", "source_size", "target", "rate", copies.alias("copies"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """(id_col, source_col, size, source_size, target, rate, copies) for every row of docs."""
    rows, file, row = keyed(docs.select(*dict.fromkeys((id_col, text_col, source_col))))
    mixed = _mixed(rows, file, row, id_col, text_col, source_col, weights, cap)
    return mixed.select(F.col("__id").alias(id_col), F.col("__name").alias(source_col), "size", "source_size", "target", "rate", "copies")


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def take_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """docs, each row as often as the mix takes it. Only the numbers of copies other than one are sent to the texts, which stay where they are."""
    rows, file, row = keyed(docs)
    mixed = _mixed(rows, file, row, id_col, text_col, source_col, WEIGHTS, CAP)
    return take_rows(rows, file, row, mixed.where("copies <> 1").select("__file", "__row", F.col("copies").alias("__times")), 1)
