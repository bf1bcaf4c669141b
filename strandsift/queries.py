"""All queries of the search engine, and their equivalents in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandsift.functions import alphabet as a
from strandsift.functions import sql
from strandsift.operators.approximate import find_approximate, find_exact
from strandsift.operators.matchers import Horspool, Myers, Pigeonhole, RestorableMyers, RestorableMyersPrefix, RestorableShiftOr, ShiftOr
from strandsift.operators.protocol import HitCount, merge_any, merge_states
from strandsift.plans import pipeline
from strandsift.plans.planner import spread
from strandsift.plans.shared import fresh_path, materialise
from strandsift.sources.fasta import read_fasta, write_fasta
from strandsift.streaming.resumable import search_stream

NEEDLE, START, K, ERROR_RATE, RUN = "GCACG", "ATTAT", 1, 0.1, 3


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def _dna(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as nucleotide sequences: their letters A, C, G and T."""
    return _table(spark, sf_dir, "documents").select("doc_id", a.letters_only(F.col("text")).alias("seq"))


def _turns(table: DataFrame) -> DataFrame:
    """Conversations' turns as chunks of nucleotide sequences."""
    return table.select("conv_id", "turn", a.letters_only(F.coalesce("text", F.lit(""))).alias("seq"))


def _needles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages as a table of needles."""
    return _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("needle_id"), F.col("text").alias("needle"))


def exact_begin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Horspool(NEEDLE).find(_dna(spark, sf_dir), "doc_id")


def exact_begin_shiftor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ShiftOr("AA").find(_dna(spark, sf_dir), "doc_id")


def exact_end_resumable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return RestorableShiftOr("ATTA").resume(_turns(_table(spark, sf_dir, "conversations")), "conv_id", "turn")


def myers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Myers(NEEDLE, K).find(_dna(spark, sf_dir), "doc_id")


def myers_resumable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return RestorableMyers(NEEDLE, K).resume(_turns(_table(spark, sf_dir, "conversations")), "conv_id", "turn")


def myers_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return RestorableMyersPrefix(START, 2).find(_dna(spark, sf_dir), "doc_id")


def myers_prefix_resumable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return RestorableMyersPrefix(START, 2).resume(_turns(_table(spark, sf_dir, "conversations")), "conv_id", "turn")


def pigeonhole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Pigeonhole(NEEDLE).find(_dna(spark, sf_dir), "doc_id")


def pigeonhole_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Pigeonhole(_needles(spark, sf_dir), ERROR_RATE).find(_table(spark, sf_dir, "documents"), "doc_id", "text")


def pigeonhole_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeds outside runs of equal symbols."""
    return Pigeonhole(["TTA", "AAC"], mask_runs=RUN).find(_dna(spark, sf_dir), "doc_id")


def contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where passages of `benchmark` stand in documents."""
    return find_exact(_table(spark, sf_dir, "documents"), _needles(spark, sf_dir), "doc_id", "text")


def contamination_approximate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where passages of `benchmark` stand in documents within 8 edits."""
    return find_approximate(_table(spark, sf_dir, "documents"), _needles(spark, sf_dir), 8, "doc_id", "text")


def window_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    needle = F.col("needle")
    sizes = {
        "horspool": Horspool.window_column(needle), "shiftor": ShiftOr.window_column(needle), "shiftor_resumable": RestorableShiftOr.window_column(needle), "myers": Myers.window_column(needle, 2),
        "myers_resumable": RestorableMyers.window_column(needle, 2), "myers_prefix": RestorableMyersPrefix.window_column(needle, 2), "pigeonhole": Pigeonhole.window_column(needle, ERROR_RATE),
    }
    rows = _needles(spark, sf_dir).where("needle is not null")
    return rows.select(F.col("needle_id").alias("item_id"), F.inline(F.array(*[F.struct(F.lit(k).alias("matcher"), v.alias("window_size")) for k, v in sizes.items()])))


def hit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States of searches as a table, merged by source: hits, and symbols searched."""
    docs = _table(spark, sf_dir, "documents").select("source", a.letters_only(F.col("text")).alias("seq"))
    return merge_states(HitCount.table(docs, Horspool(NEEDLE).find(docs, "source"), "source"), ["source"])


def hit_counts_by_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by the states' own aggregate()."""
    docs = _table(spark, sf_dir, "documents").select("source", a.letters_only(F.col("text")).alias("seq"))
    return merge_any(HitCount.table(docs, Horspool(NEEDLE).find(docs, "source"), "source"), ["source"], HitCount)


def sql_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Searches from SQL: seq_find() over documents."""
    sql.register(spark)
    return spark.sql(f"SELECT d.doc_id, f.end_pos, f.distance FROM {{docs}} d, LATERAL seq_find(d.seq, '{NEEDLE}', {K}) f", docs=_dna(spark, sf_dir))


def fasta_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' sequences as FASTA files, and these as a table."""
    path = fresh_path(spark, "fasta")
    write_fasta(_dna(spark, sf_dir), path, "doc_id")
    return read_fasta(spark, path)


def fasta_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FASTA reads in FASTA references: passages' first 12 letters are the reads, documents the references."""
    reads, references = fresh_path(spark, "fasta-reads"), fresh_path(spark, "fasta-references")
    passages = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.substring(a.letters_only(F.col("text")), 1, 12).alias("seq"))
    write_fasta(passages, reads)
    write_fasta(_dna(spark, sf_dir), references, "doc_id")
    needles = read_fasta(spark, reads).select(F.col("id").cast("long").alias("needle_id"), F.col("seq").alias("needle"))
    return find_exact(read_fasta(spark, references), needles, "id")


def _symbols(to: a.Alphabet) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _table(spark, sf_dir, "documents").select("doc_id", a.coerce("text", to).alias("seq"))

    return query


def complements(spark: SparkSession, sf_dir: str) -> DataFrame:
    seq = a.to_dna15("text")
    return _table(spark, sf_dir, "documents").select("doc_id", a.complement(seq, a.DNA15).alias("complement"), a.reverse_complement(a.to_dna5("text"), a.DNA5).alias("reverse_complement"))


def symbol_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each sequence's first symbol as a rank and back, all its symbols as ranks and back, and their sum."""
    dna = _dna(spark, sf_dir)
    first, all_ranks = F.substring("seq", 1, 1), a.ranks(F.col("seq"), a.DNA4)
    return dna.select(
        "doc_id", a.rank(first, a.DNA4).alias("first_rank"), a.from_rank(a.rank(first, a.DNA4), a.DNA4).alias("first_symbol"), a.from_ranks(all_ranks, a.DNA4).alias("seq"),
        F.aggregate(all_ranks, F.lit(0).cast("long"), lambda x, y: x + y).alias("rank_sum"),
    )


def symbol_ranks_of_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of symbols' ranks and their squares in each alphabet, and symbols from ranks."""
    def of(x: a.Alphabet) -> list:
        own = a.ranks(a.coerce("text", x), x)
        sums = [F.aggregate(own, F.lit(0).cast("long"), lambda s, r: s + r), F.aggregate(own, F.lit(0).cast("long"), lambda s, r: s + r * r)]
        return [sums[0].alias(f"{x.name}_sum"), sums[1].alias(f"{x.name}_squares"), (a.from_ranks(own, x) == a.coerce("text", x)).alias(f"{x.name}_back")]

    return _table(spark, sf_dir, "documents").select("doc_id", *[c for x in a.ALPHABETS.values() for c in of(x)])


def symbol_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document are sequences as they stand."""
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[ \n]"), lambda x: x != "")

    def valid(of: a.Alphabet) -> F.Column:
        return F.size(F.filter("words", lambda x: a.is_valid(x, of))).cast("long").alias(f"{of.name}_words")

    flags = [valid(x) for x in a.ALPHABETS.values()]
    return _table(spark, sf_dir, "documents").select("doc_id", words.alias("words")).select("doc_id", *flags)


def symbol_conversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", a.convert(a.to_dna5("text"), a.DNA4).alias("dna4"), a.convert(a.to_dna4("text"), a.DNA15).alias("dna15"))


def symbol_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    dna = _dna(spark, sf_dir)
    return dna.select("doc_id", (F.col("seq") < a.literal("GATTACA")).alias("before"), (F.substring("seq", 1, 3) == a.literal("GAT")).alias("same"))


def alphabet_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(x.name, x.size, x.bits_per_value) for x in a.ALPHABETS.values()], "alphabet string, size long, bits long")


def stream_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as a stream of chunks, searched as they come: a folder of files, of which each is a micro-batch."""
    path = fresh_path(spark, "chunks")
    rows = _turns(_table(spark, sf_dir, "conversations"))
    rows.write.parquet(path)
    chunks = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", max(1, spark.sparkContext.defaultParallelism // 2)).parquet(path)
    return search_stream(chunks, RestorableMyers(NEEDLE, K), "stream", "conv_id", "turn")


def stream_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source, a map and a sink that counts, piped: documents, their sequences, how many symbols each source has."""
    out: list[DataFrame] = []
    stream = pipeline.make_stream(_table(spark, sf_dir, "documents")) | pipeline.transform_stream({"symbols": F.length(a.letters_only(F.coalesce("text", F.lit("")))).cast("long")})
    pipeline.run(stream | pipeline.for_each_stream(lambda x: out.append(x.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("symbols").alias("symbols")))))
    return out[0]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "contamination": contamination,
        "contamination_approximate": contamination_approximate,
        "exact_begin": exact_begin,
        "exact_begin_shiftor": exact_begin_shiftor,
        "exact_end_resumable": exact_end_resumable,
        "myers": myers,
        "myers_resumable": myers_resumable,
        "myers_prefix": myers_prefix,
        "myers_prefix_resumable": myers_prefix_resumable,
        "pigeonhole": pigeonhole,
        "pigeonhole_multi": pigeonhole_multi,
        "pigeonhole_masked": pigeonhole_masked,
        "window_sizes": window_sizes,
        "symbols_dna4": _symbols(a.DNA4),
        "symbols_dna5": _symbols(a.DNA5),
        "symbols_dna15": _symbols(a.DNA15),
        "symbol_complements": complements,
        "symbol_ranks": symbol_ranks,
        "symbol_ranks_of_all": symbol_ranks_of_all,
        "symbol_validity": symbol_validity,
        "symbol_conversion": symbol_conversion,
        "symbol_order": symbol_order,
        "alphabet_sizes": alphabet_sizes,
        "stream_search": stream_search,
        "stream_pipeline": stream_pipeline,
        "hit_counts": hit_counts,
        "hit_counts_by_state": hit_counts_by_state,
        "sql_function": sql_function,
        "fasta_round_trip": fasta_round_trip,
        "fasta_search": fasta_search,
    }


_DNA = "SELECT doc_id, upper(regexp_replace(text, '[^ACGTacgt]', '', 'g')) AS seq FROM documents"
#: A number counts once, and none under 0 or null. (Texts that differ under one number: the engine has another choice.)
_TURNS = """SELECT conv_id, string_agg(seq, '' ORDER BY turn) AS seq FROM (
  SELECT conv_id, turn, min(upper(regexp_replace(coalesce(text, ''), '[^ACGTacgt]', '', 'g'))) AS seq FROM conversations WHERE turn >= 0 GROUP BY conv_id, turn) GROUP BY conv_id"""


def _exact(rows: str, key: str, needle: str, end: bool = False) -> str:
    m = len(needle)
    return f"""WITH d AS ({rows}), p AS (SELECT {key}, seq, unnest(range(0, length(seq) - {m} + 1)) AS pos FROM d)
SELECT {key}, CAST(pos + {m if end else 0} AS BIGINT) AS {"end_pos" if end else "begin_pos"} FROM p WHERE substr(seq, CAST(pos + 1 AS INTEGER), {m}) = '{needle}'"""


def _edits(rows: str, key: str, needle: str, k: int) -> str:
    m = len(needle)
    return f"""WITH d AS ({rows}), e AS (SELECT {key}, seq, unnest(range(1, length(seq) + 1)) AS e FROM d),
s AS (SELECT {key}, seq, e, unnest(range(greatest(0, e - {m + k}), greatest(0, e - {m - k}) + 1)) AS s FROM e),
x AS (SELECT {key}, e, min(levenshtein('{needle}', substr(seq, CAST(s + 1 AS INTEGER), CAST(e - s AS INTEGER)))) AS distance FROM s GROUP BY {key}, e)
SELECT {key}, CAST(e AS BIGINT) AS end_pos, CAST(distance AS INTEGER) AS distance FROM x WHERE distance <= {k}"""


def _starts(rows: str, key: str, needle: str, k: int) -> str:
    return f"""WITH d AS ({rows}), e AS (SELECT {key}, seq, unnest(range(1, least(length(seq), {len(needle) + k}) + 1)) AS e FROM d),
x AS (SELECT {key}, e, levenshtein('{needle}', substr(seq, 1, CAST(e AS INTEGER))) AS distance FROM e)
SELECT {key}, CAST(e AS BIGINT) AS end_pos, CAST(distance AS INTEGER) AS distance FROM x WHERE distance <= {k}"""


def _coerced(to: a.Alphabet, column: str = "text") -> str:
    return f"regexp_replace(translate(upper(regexp_replace({column}, '[^ -~]', '?', 'g')), '{to.others}', '{to.count_as}'), '[^{to.symbols}]', '{to.unknown}', 'g')"


def _rank_sums(of: a.Alphabet, power: int) -> str:
    return f"CAST(list_sum(list_transform(string_split({_coerced(of)}, ''), lambda x: CASE WHEN x = '' THEN 0 ELSE power(instr('{of.symbols}', x) - 1, {power}) END)) AS BIGINT)"


_HIT_COUNTS = f"""WITH d AS (SELECT source, upper(regexp_replace(text, '[^ACGTacgt]', '', 'g')) AS seq FROM documents)
SELECT source, CAST(sum(coalesce((SELECT count(*) FROM range(0, length(seq)) AS r(i) WHERE substr(seq, CAST(i + 1 AS INTEGER), {len(NEEDLE)}) = '{NEEDLE}'), 0)) AS BIGINT) AS hits, CAST(sum(coalesce(length(seq), 0)) AS BIGINT) AS symbols FROM d GROUP BY source"""


#: Letters of the tables beyond ASCII, for levenshtein(), which counts bytes in DuckDB: each becomes one that texts don't hold.
_BEYOND = "éóèñçüêäößíÉÈÑÓÇÄÊÜÖÍ"
_PLAIN = f"translate(text, '{_BEYOND}', {' || '.join(f'chr({i + 1 if i < 8 else i + 6})' for i in range(len(_BEYOND)))})"


def _within(k: int) -> str:
    """Passages within k edits. Of k + 1 pieces of one a match leaves one intact, so only ends near pieces' places can be ends; passages too short for that are compared everywhere."""
    return f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_PLAIN} AS t FROM documents WHERE text IS NOT NULL),
n AS (SELECT row_number() OVER () AS nid, item_id, {_PLAIN} AS n, length(text) AS m, length(text) // {k + 1} AS q FROM benchmark WHERE text <> ''),
p AS (SELECT nid, n, m, q, i * q AS o, substr(n, CAST(i * q + 1 AS INTEGER), q) AS piece FROM n, range({k + 1}) AS r(i) WHERE q >= 3),
h AS (SELECT rid, nid, t, m, q, o, piece FROM d JOIN p ON contains(t, piece)),
w AS (SELECT rid, nid, t, m, o, piece, q, unnest(range(0, length(t) - q + 1)) AS place FROM h),
e AS (SELECT DISTINCT rid, nid, unnest(range(greatest(1, place - o + m - {2 * k}), least(length(t), place - o + m + {2 * k}) + 1)) AS e FROM w WHERE substr(t, CAST(place + 1 AS INTEGER), q) = piece
  UNION SELECT rid, nid, unnest(range(1, length(t) + 1)) AS e FROM d, n WHERE q < 3),
s AS (SELECT rid, nid, doc_id, item_id, n, t, e, unnest(range(greatest(0, e - m - {k}), greatest(0, e - m + {k}) + 1)) AS s FROM e JOIN d USING (rid) JOIN n USING (nid)),
x AS (SELECT rid, nid, doc_id, item_id, e, min(levenshtein(n, substr(t, CAST(s + 1 AS INTEGER), CAST(e - s AS INTEGER)))) AS distance FROM s GROUP BY ALL)
SELECT doc_id, CAST(e AS BIGINT) AS end_pos, CAST(item_id AS BIGINT) AS needle_id, CAST(distance AS INTEGER) AS distance FROM x WHERE distance <= {k}"""


def oracle_sql() -> dict[str, str]:
    m = len(NEEDLE)
    return {
        "contamination": """WITH h AS (SELECT d.doc_id, b.item_id, d.text AS t, b.text AS n FROM documents d JOIN benchmark b ON length(b.text) > 0 AND contains(d.text, b.text)),
p AS (SELECT *, unnest(range(0, length(t) - length(n) + 1)) AS pos FROM h)
SELECT doc_id, CAST(pos AS BIGINT) AS begin_pos, item_id AS needle_id FROM p WHERE substr(t, CAST(pos + 1 AS INTEGER), length(n)) = n""",
        "contamination_approximate": _within(8),
        "exact_begin": _exact(_DNA, "doc_id", NEEDLE),
        "exact_begin_shiftor": _exact(_DNA, "doc_id", "AA"),
        "exact_end_resumable": _exact(_TURNS, "conv_id", "ATTA", end=True),
        "myers": _edits(_DNA, "doc_id", NEEDLE, K),
        "myers_resumable": _edits(_TURNS, "conv_id", NEEDLE, K),
        "myers_prefix": _starts(_DNA, "doc_id", START, 2),
        "myers_prefix_resumable": _starts(_TURNS, "conv_id", START, 2),
        "pigeonhole": f"""SELECT doc_id, begin_pos, CAST(0 AS BIGINT) AS "index", CAST(0 AS BIGINT) AS "offset", CAST({m} AS BIGINT) AS "count" FROM ({_exact(_DNA, "doc_id", NEEDLE)})""",
        "pigeonhole_multi": f"""WITH n AS (SELECT item_id AS i, text AS n, length(text) // (CAST(floor({ERROR_RATE}::DOUBLE * length(text)) AS BIGINT) + 1) AS most FROM benchmark WHERE text IS NOT NULL),
q AS (SELECT min(most) AS q FROM n WHERE most >= 3),
o AS (SELECT i, n, q, unnest(range(0, length(n) - q + 1, q)) AS o FROM n, q WHERE most >= 3),
g AS (SELECT i, o, substr(n, CAST(o + 1 AS INTEGER), q) AS gram FROM o),
p AS (SELECT doc_id, text, q, unnest(range(0, length(text) - q + 1)) AS pos FROM documents, q)
SELECT doc_id, CAST(pos AS BIGINT) AS begin_pos, CAST(i AS BIGINT) AS "index", CAST(o AS BIGINT) AS "offset", CAST(q AS BIGINT) AS "count" FROM p JOIN g ON substr(text, CAST(pos + 1 AS INTEGER), q) = gram""",
        "pigeonhole_masked": f"""WITH d AS ({_DNA}), p AS (SELECT doc_id, seq, unnest(range(0, length(seq) - 2)) AS pos FROM d),
h AS (SELECT doc_id, seq, pos, list_position(['TTA', 'AAC'], substr(seq, CAST(pos + 1 AS INTEGER), 3)) - 1 AS i FROM p WHERE substr(seq, CAST(pos + 1 AS INTEGER), 3) IN ('TTA', 'AAC'))
SELECT doc_id, CAST(pos AS BIGINT) AS begin_pos, CAST(i AS BIGINT) AS "index", CAST(0 AS BIGINT) AS "offset", CAST(3 AS BIGINT) AS "count" FROM h
WHERE NOT (i = 0 AND pos > 0 AND substr(seq, CAST(pos AS INTEGER), {RUN}) = repeat('T', {RUN})) AND NOT (i = 0 AND substr(seq, CAST(pos + 3 AS INTEGER), {RUN}) = repeat('A', {RUN}))
  AND NOT (i = 1 AND pos > 0 AND substr(seq, CAST(pos AS INTEGER), {RUN}) = repeat('A', {RUN})) AND NOT (i = 1 AND substr(seq, CAST(pos + 3 AS INTEGER), {RUN}) = repeat('C', {RUN}))""",
        "hit_counts": _HIT_COUNTS,
        "hit_counts_by_state": _HIT_COUNTS,
        "sql_function": _edits(_DNA, "doc_id", NEEDLE, K),
        "fasta_round_trip": f"SELECT CAST(doc_id AS VARCHAR) AS id, seq FROM ({_DNA})",
        "fasta_search": f"""WITH n AS (SELECT item_id, substr(upper(regexp_replace(text, '[^ACGTacgt]', '', 'g')), 1, 12) AS n FROM benchmark), d AS ({_DNA}),
h AS (SELECT doc_id, item_id, seq, n FROM d JOIN n ON n <> '' AND contains(seq, n)), p AS (SELECT *, unnest(range(0, length(seq) - length(n) + 1)) AS pos FROM h)
SELECT CAST(doc_id AS VARCHAR) AS id, CAST(pos AS BIGINT) AS begin_pos, CAST(item_id AS BIGINT) AS needle_id FROM p WHERE substr(seq, CAST(pos + 1 AS INTEGER), length(n)) = n""",
        "symbol_ranks_of_all": "SELECT doc_id, " + ", ".join(f"{_rank_sums(x, 1)} AS {x.name}_sum, {_rank_sums(x, 2)} AS {x.name}_squares, text IS NOT NULL OR NULL AS {x.name}_back" for x in a.ALPHABETS.values()) + " FROM documents",
        "window_sizes": f"""SELECT item_id, matcher, CAST(CASE WHEN matcher LIKE 'myers%' THEN length(text) + 2 WHEN matcher = 'pigeonhole' THEN CASE WHEN w >= 3 THEN w ELSE 0 END ELSE length(text) END AS BIGINT) AS window_size
FROM (SELECT *, length(text) // (CAST(floor({ERROR_RATE}::DOUBLE * length(text)) AS BIGINT) + 1) AS w FROM benchmark WHERE text IS NOT NULL),
(VALUES ('horspool'), ('shiftor'), ('shiftor_resumable'), ('myers'), ('myers_resumable'), ('myers_prefix'), ('pigeonhole')) AS v(matcher)""",
        **{f"symbols_{x.name}": f"SELECT doc_id, {_coerced(x)} AS seq FROM documents" for x in a.ALPHABETS.values()},
        "symbol_complements": f"""SELECT doc_id, translate({_coerced(a.DNA15)}, '{a.DNA15.symbols}', '{a.DNA15.complements}') AS complement,
reverse(translate({_coerced(a.DNA5)}, '{a.DNA5.symbols}', '{a.DNA5.complements}')) AS reverse_complement FROM documents""",
        "symbol_ranks": f"""SELECT doc_id, CASE WHEN seq <> '' THEN CAST(instr('ACGT', substr(seq, 1, 1)) - 1 AS INTEGER) END AS first_rank, CASE WHEN seq <> '' THEN substr(seq, 1, 1) END AS first_symbol, seq,
CAST(length(seq) - length(replace(seq, 'C', '')) + 2 * (length(seq) - length(replace(seq, 'G', ''))) + 3 * (length(seq) - length(replace(seq, 'T', ''))) AS BIGINT) AS rank_sum FROM ({_DNA})""",
        "symbol_validity": "SELECT doc_id, "
        + ", ".join(f"CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\n]'), lambda x: x <> '' AND regexp_full_match(x, '[{x.symbols}U{x.symbols.lower()}u]*'))) AS BIGINT) AS {x.name}_words" for x in a.ALPHABETS.values())
        + " FROM documents",
        "symbol_conversion": f"SELECT doc_id, {_coerced(a.DNA4, _coerced(a.DNA5))} AS dna4, {_coerced(a.DNA15, _coerced(a.DNA4))} AS dna15 FROM documents",
        "symbol_order": f"SELECT doc_id, seq < 'GATTACA' AS before, substr(seq, 1, 3) = 'GAT' AS same FROM ({_DNA})",
        "alphabet_sizes": "SELECT * FROM (VALUES ('dna4', 4::BIGINT, 2::BIGINT), ('dna5', 5::BIGINT, 3::BIGINT), ('dna15', 15::BIGINT, 4::BIGINT)) AS v(alphabet, size, bits)",
        "stream_search": _edits(_TURNS, "conv_id", NEEDLE, K),
        "stream_pipeline": "SELECT source, count(*) AS n_docs, CAST(sum(length(regexp_replace(coalesce(text, ''), '[^ACGTacgt]', '', 'g'))) AS BIGINT) AS symbols FROM documents GROUP BY source",
    }
