"""Quality rules with thresholds from mergeable quantile sketches per language and source.

Each document is measured: symbols, capitals, marks, repeated lines, length of words, each a count of events over a number of units. A measure that
is unusually high for the document's language and source fails it. "Unusually high" is read off sketches: counts of values by logarithmic bucket
(relative error ERROR), one sketch for each (language, source, measure). Sketches merge by adding their counts, which is how tasks, then sources, then
languages combine; in a merged sketch no source counts for more than LEAST documents, so that a hot one doesn't speak for all.

A sketch's fence is its upper quartile + SPREAD * (upper - lower quartile). A merged fence (the language's, or all documents' if the language has under
LEAST) is the threshold of sources of under LEAST documents. Others have their own fence. Where over a quarter of a source is junk, its upper quartile
is junk too; so its fence is at most what its low end shows, lower quartile + REACH * (lower quartile - 5 % quantile) or twice the lower quartile if
that is more, which junk raises only from three quarters on (nor does junk with low values bring it under twice the merged lower quartile). A lower
quartile of zero shows nothing; then the fence is at most the merged fence, which one source can't dominate.

A document fails if its events exceed what its threshold gives for its units by over SIGMAS standard errors (of a count; at least of one event): a
short text has to be further off than a long one, and a few events prove nothing. No measure has a fixed limit but one: most documents repeat no line,
so sketches have no scale for those that do, and the share of lines that may be repeated is at least that of words in the base rule. The share
of repeated words is the base rule's own measure and has no second threshold.

Scale: a sketch has a few hundred rows at most, summed before they are shuffled, so a hot source is no hot task. Measuring is one pass without
shuffles; verdicts are reached on measures, without texts. Thresholds (one row for each language and source) are broadcast if there are few; else those of sources that hold over one in BROADCAST_ROWS of
all documents are broadcast, and the others, none of them hot, are joined.

A null or empty text has no words and fails the base rule. Null languages and sources are groups of their own. Texts are measured whole, whatever their
length. Ties: a document at its threshold is kept. Repeated rows, also of one id, each count and each give a row. An empty table gives an empty one.
Columns of other names than those asked for are left alone, whatever they are called.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandsift.llm.common import BROADCAST_ROWS, binary_list, keyed, materialise, null_key, small_batches, take_rows, unused, with_column
from strandsift.plans.planner import spread

WINDOW, MIN_WORDS, MAX_REPEAT = 5, 10, 20
SYMBOLS = b"#*$%&|<>"
BLANKS = b"\x20\x09\x0a\x0b\x0c\x0d"
UPPER = bytes(range(65, 91))
ERROR, SPREAD, LEAST = 0.01, 3.0, 200
#: On a normal distribution the bound then lies where the threshold does.
REACH = 5.5
SIGMAS = 4.0
GAMMA = (1 + ERROR) / (1 - ERROR)
#: A merged sketch counts documents in this many parts, so that those of a source of over LEAST can count for less than one.
PARTS = 1000
#: What is counted, and of how many units.
MEASURES = {"symbol_rate": ("n_symbols", "word_chars"), "line_rate": ("n_dup_lines", "n_lines"), "upper_rate": ("n_upper", "word_chars"), "mark_rate": ("n_marks", "n_words"), "word_length": ("word_chars", "n_words")}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks")


def repeated_words(words: list[bytes]) -> int:
    """Words in windows of five that occur twice or more."""
    if len(words) <= WINDOW:
        return 0
    windows = list(zip(*(words[i:] for i in range(WINDOW)), strict=False))
    found = Counter(windows)
    if len(found) == len(windows):
        return 0
    total = upto = 0
    for i, x in enumerate(windows):
        if found[x] > 1:
            total += i + WINDOW - max(i, upto)
            upto = i + WINDOW
    return total


def measure(text: bytes | None) -> tuple[int, ...]:
    """COUNTS of a text in UTF-8."""
    if not text:
        return (0,) * len(COUNTS)
    words = text.split()
    plain = text.translate(None, BLANKS)
    chars = len(plain) if plain.isascii() else len(plain.decode())
    lines = [x for x in text.split(b"\n") if x.strip()]
    symbols = len(plain) - len(plain.translate(None, SYMBOLS))
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated_words(words), len(lines), len(plain) - len(plain.translate(None, UPPER)), plain.count(b"!") + plain.count(b"?")


def with_measures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs and COUNTS."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(zip(*map(measure, binary_list(batch, text_col)), strict=True)) or [()] * len(COUNTS)
            yield with_column(batch, **{x: pa.array(v, pa.int64()) for x, v in zip(COUNTS, found, strict=True)})

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *(T.StructField(x, T.LongType()) for x in COUNTS)]))


def _counts(measure: str) -> tuple[F.Column, F.Column]:
    """A measure's events and units, at least one unit."""
    events, units = MEASURES[measure]
    return F.col(events), F.greatest(F.lit(1), F.col(units))


def base_failed() -> F.Column:
    words, repeat = F.col("n_words"), F.col("n_repeat_words")
    return (words < MIN_WORDS) | (100 * repeat > MAX_REPEAT * words)


def sketches(measured: DataFrame, lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(__lang, __source, measure, bucket, n): counts by bucket; bucket null: zero. Only documents that pass the base rule count."""
    values = {x: _counts(x)[0] / _counts(x)[1] for x in MEASURES}
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("measure"), v.alias("value")) for k, v in values.items()])).alias("x")
    rows = measured.where(~base_failed()).select(null_key(lang_col).alias("__lang"), null_key(source_col).alias("__source"), pairs)
    bucket = F.when(F.col("x.value") > 1e-6, F.ceil(F.log(F.col("x.value")) / math.log(GAMMA)).cast("int"))
    return rows.groupBy("__lang", "__source", F.col("x.measure").alias("measure"), bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def merge(sketch: DataFrame, *keys: str) -> DataFrame:
    """The sum of sketches that agree in keys."""
    return sketch.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))


def quantiles(sketch: DataFrame, keys: list[str], at: dict[str, float]) -> DataFrame:
    """(keys, measure, n, one column for each of at)."""
    by = Window.partitionBy(*keys, "measure")
    running = by.orderBy(F.col("bucket").asc_nulls_first())
    rows = sketch.withColumn("upto", F.sum("n").over(running)).withColumn("all", F.sum("n").over(by))
    value = F.when(F.col("bucket").isNull(), 0.0).otherwise(2 * F.pow(F.lit(GAMMA), F.col("bucket")) / (GAMMA + 1))
    return rows.groupBy(*keys, "measure").agg(F.first("all").alias("n"), *[F.min(F.when(F.col("upto") >= q * F.col("all"), value)).alias(name) for name, q in at.items()])


def _fences(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, measure, fence, reach: what the low end shows, twice: twice the lower quartile). A bucket's values go up to its edge, which lies above the value that stands for it."""
    found = quantiles(sketch, keys, {"least": 0.05, "low": 0.25, "high": 0.75})
    high = F.col("high") * ((GAMMA + 1) / 2)
    reach = F.greatest(F.col("low") + REACH * (F.col("low") - F.col("least")), 2 * F.col("low"))
    return found.select(*keys, "measure", (high + SPREAD * (F.col("high") - F.col("low"))).alias("fence"), reach.alias("reach"), (2 * F.col("low")).alias("twice"))


def thresholds(measured: DataFrame, lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(__lang, __source, __n, one column __max_<measure> for each measure) for every language and source of measured; __n: its documents."""
    own = materialise(sketches(measured, lang_col, source_col), "sketches")
    docs = F.sum("n").over(Window.partitionBy("__lang", "__source", "measure"))
    shared = own.withColumn("docs", docs).withColumn("n", F.expr(f"n * {PARTS} * least(docs, {LEAST}) div docs"))
    merged = []
    for level, keys in enumerate((["__lang"], []), 1):
        found = _fences(merge(shared, *keys), keys)
        bounded = F.least("fence", F.when(F.col("reach") > 0, F.col("reach")))
        counted = own.groupBy(*keys, "measure").agg(F.sum("n").alias(f"n{level}"))
        merged.append(found.select(*keys, "measure", bounded.alias(f"fence{level}"), F.col("twice").alias(f"twice{level}")).join(counted, [*keys, "measure"]))
    mine = _fences(own, ["__lang", "__source"]).drop("twice").join(own.groupBy("__lang", "__source", "measure").agg(F.sum("n").alias("n0")), ["__lang", "__source", "measure"])
    pairs = measured.groupBy(null_key(lang_col).alias("__lang"), null_key(source_col).alias("__source")).agg(F.count(F.lit(1)).alias("__n"))
    rows = pairs.select("*", F.explode(F.array(*map(F.lit, MEASURES))).alias("measure"))
    rows = rows.join(mine, ["__lang", "__source", "measure"], "left").join(merged[0], ["__lang", "measure"], "left").join(merged[1], ["measure"], "left")
    usual, twice = (F.coalesce(F.when(F.col("n1") >= LEAST, F.col(f"{x}1")).otherwise(F.col(f"{x}2")), F.lit(0.0)) for x in ("fence", "twice"))
    bound = F.when(F.col("reach") > 0, F.greatest("reach", twice)).otherwise(usual)
    chosen = F.when(F.col("n0") >= LEAST, F.least("fence", bound)).otherwise(usual)
    chosen = F.when(F.col("measure") == "line_rate", F.greatest(chosen, F.lit(MAX_REPEAT / 100))).otherwise(chosen)
    return rows.groupBy("__lang", "__source").agg(F.first("__n").alias("__n"), *[F.max(F.when(F.col("measure") == x, chosen)).alias(f"__max_{x}") for x in MEASURES])


def _exceeds(measure: str, most: F.Column) -> F.Column:
    events, units = _counts(measure)
    expected = most * units
    return events > expected + SIGMAS * F.sqrt(F.greatest(expected, F.lit(1.0)))


def verdicts(measured: DataFrame, limits: DataFrame, lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """measured (a written table, as it may be read twice) with base_failed and kept. limits: as thresholds() gives them."""
    limits = materialise(limits, "thresholds")
    names = dict(zip(limits.columns, unused(measured.columns, *limits.columns), strict=True))
    size = limits.agg(F.count(F.lit(1)).alias("rows"), F.sum("__n").alias("docs")).first()
    few = F.lit(True) if size["rows"] <= BROADCAST_ROWS else F.col("__n") > size["docs"] // BROADCAST_ROWS
    same = (null_key(lang_col) == F.col(names["__lang"])) & (null_key(source_col) == F.col(names["__source"]))
    joined = measured.join(F.broadcast(limits.where(few).withColumnsRenamed(names)), same, "left")
    if size["rows"] > BROADCAST_ROWS:
        rest = joined.where(F.col(names["__lang"]).isNull()).select(*[F.col(f"`{c}`") for c in measured.columns])
        joined = joined.where(F.col(names["__lang"]).isNotNull()).unionByName(rest.join(limits.where(~few).withColumnsRenamed(names), same))
    good = ~base_failed()
    for x in MEASURES:
        good &= ~_exceeds(x, F.col(names[f"__max_{x}"]))
    return joined.withColumns({"base_failed": base_failed(), "kept": good}).drop(*names.values())


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(id_col, lang_col, source_col, COUNTS, base_failed, kept) for every row of docs."""
    measured = materialise(with_measures(docs.select(id_col, text_col, lang_col, source_col), text_col).drop(text_col), "measures")
    return verdicts(measured, thresholds(measured, lang_col, source_col), lang_col, source_col)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def keep_good(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """docs that pass. Only which rows fail is sent to the texts, which are measured once and stay where they are."""
    rows, file, row = keyed(docs)
    measured = rows.select(F.col(file).alias("__file"), F.col(row).alias("__row"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"))
    measured = materialise(with_measures(measured).drop("text"), "measures")
    failed = verdicts(measured, thresholds(measured)).where("not kept")
    return take_rows(rows, file, row, failed.select("__file", "__row", F.lit(0).alias("__times")), 1)


_VALUES = ", ".join(f"('{x}', {events}, greatest(1, {units}))" for x, (events, units) in MEASURES.items())


def _level(name: str, keys: str, counts: str) -> str:
    """SQL of the fences of one level of sketches."""
    by = f"{keys}, measure" if keys else "measure"
    mid = f"CASE WHEN bucket IS NULL THEN 0 ELSE 2 * pow({GAMMA!r}::DOUBLE, bucket) / {GAMMA + 1!r}::DOUBLE END"
    return f"""{name}q AS (SELECT {by}, any_value(docs) AS docs, min(value) FILTER (WHERE upto >= 0.05::DOUBLE * n) AS least, min(value) FILTER (WHERE upto >= 0.25::DOUBLE * n) AS low, min(value) FILTER (WHERE upto >= 0.75::DOUBLE * n) AS high FROM (
  SELECT {by}, sum(c) OVER (PARTITION BY {by} ORDER BY bucket NULLS FIRST) AS upto, sum(c) OVER (PARTITION BY {by}) AS n, sum(d) OVER (PARTITION BY {by}) AS docs, {mid} AS value
  FROM (SELECT {by}, bucket, sum({counts}) AS c, sum(n) AS d FROM sketch GROUP BY {by}, bucket)) GROUP BY {by}),
{name} AS (SELECT {by}, docs, high * {(GAMMA + 1) / 2!r}::DOUBLE + {SPREAD}::DOUBLE * (high - low) AS fence, greatest(low + {REACH}::DOUBLE * (low - least), 2 * low) AS reach, 2 * low AS twice FROM {name}q)"""


OP9_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce('s' || lang, 'n') AS l, coalesce('s' || source, 'n') AS s, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
u AS (SELECT rid, unnest(ws) AS word, unnest(range(len(ws))) AS i FROM w),
g AS (SELECT rid, i, [word, lead(word, 1) OVER p, lead(word, 2) OVER p, lead(word, 3) OVER p, lead(word, 4) OVER p] AS five, lead(word, 4) OVER p AS fifth FROM u WINDOW p AS (PARTITION BY rid ORDER BY i)),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, five) AS c FROM g WHERE fifth IS NOT NULL) WHERE c > 1),
o AS (SELECT rid, count(DISTINCT i + k) AS n FROM r, range(5) AS five(k) GROUP BY rid),
c AS (SELECT d.rid, doc_id, l, s, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(o.n, 0) AS BIGINT) AS n_repeat_words,
  len(lines) AS n_lines, length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(t, '[^!?]', '', 'g')) AS n_marks
  FROM d JOIN w USING (rid) LEFT JOIN o USING (rid)),
m AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT} * n_words AS base_failed FROM c),
v AS (SELECT rid, l, s, base_failed, measure, events, units, events / units AS value FROM m, LATERAL (VALUES {_VALUES}) AS x(measure, events, units)),
h AS (SELECT l, s, measure, CASE WHEN value > 1e-6 THEN CAST(ceil(ln(value) / {math.log(GAMMA)!r}::DOUBLE) AS INTEGER) END AS bucket, count(*) AS n FROM v WHERE NOT base_failed GROUP BY ALL),
sketch AS (SELECT *, n * {PARTS} * least(sum(n) OVER (PARTITION BY l, s, measure), {LEAST}) // sum(n) OVER (PARTITION BY l, s, measure) AS shared FROM h),
{_level("f0", "l, s", "n")},
{_level("f1", "l", "shared")},
{_level("f2", "", "shared")},
b1 AS (SELECT l, measure, docs, twice, least(fence, CASE WHEN reach > 0 THEN reach END) AS fence FROM f1),
b2 AS (SELECT measure, twice, least(fence, CASE WHEN reach > 0 THEN reach END) AS fence FROM f2),
k AS (SELECT rid, events, units, measure, f0.docs AS docs, f0.fence AS own, f0.reach AS reach, coalesce(CASE WHEN b1.docs >= {LEAST} THEN b1.fence ELSE b2.fence END, 0) AS usual, coalesce(CASE WHEN b1.docs >= {LEAST} THEN b1.twice ELSE b2.twice END, 0) AS twice
  FROM v LEFT JOIN f0 USING (l, s, measure) LEFT JOIN b1 USING (l, measure) LEFT JOIN b2 USING (measure)),
y AS (SELECT rid, events, units * greatest(CASE WHEN docs >= {LEAST} THEN least(own, CASE WHEN reach > 0 THEN greatest(reach, twice) ELSE usual END) ELSE usual END, CASE WHEN measure = 'line_rate' THEN {MAX_REPEAT / 100}::DOUBLE ELSE 0 END) AS expected FROM k),
x AS (SELECT rid, bool_and(events <= expected + {SIGMAS}::DOUBLE * sqrt(greatest(expected, 1))) AS good FROM y GROUP BY rid)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND good AS kept FROM m JOIN x USING (rid)
"""
