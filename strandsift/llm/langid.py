"""Language identification by multilingual mixture inference.

A document is a mixture of languages. Its words' likelihoods under each language come from character trigrams (hashed, smoothed counts); expectation-
maximisation finds the proportions of languages that best explain all its words, and the set of languages is chosen by penalised likelihood: of the
sets that take the most probable languages first, the one whose log likelihood less PENALTY * log(words) for each further language is highest. The
prediction is the language with the largest proportion, the score that proportion.

Scale: training counts are added up inside each task, then summed by (language, trigram bucket). The table that the driver gets and broadcasts has
MOST_CELLS numbers at most, whatever the input: with over MOST_CELLS / BUCKETS languages, buckets are merged until it fits. Prediction is one pass without
shuffles. Texts of any length are read whole; they are looked at in blocks that end between words.

A null or empty text, or one without a letter, is `und` with score 0; so is every text if nothing could be learned. Only rows with a language train.
Every row gives a row, also repeated ones; a null id counts as the empty string in the choice of held-out rows. Ties go to the language that comes
first by code point. An empty table gives an empty one. Further columns may have any names.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandsift.llm.common import binary_list, materialise, small_batches, with_column
from strandsift.plans.planner import spread

BUCKETS = 1 << 16
SMOOTHING = 0.5
PENALTY = 2.0
STEPS = 25
FOLDS = 5
#: Code points that are looked at together, and as many more as the word goes on.
BLOCK = 1 << 20
#: Numbers in the table of trigrams and languages; languages whose counts a task holds.
MOST_CELLS, HELD = 1 << 25, 64


@functools.cache
def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def trigrams(text: bytes | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each block of a text: the bucket of the trigram around each letter, and the places where words begin among them."""
    codes = np.frombuffer((text or b"").decode().lower().encode("utf-32-le", "surrogatepass"), "<u4")
    end = 0
    while end < len(codes):
        at, end = end, min(end + BLOCK, len(codes))
        while end < len(codes):  # a word stays in one block
            gap = np.flatnonzero(~_letters()[codes[end : end + BLOCK]])
            end = end + int(gap[0]) if len(gap) else min(end + BLOCK, len(codes))
            if len(gap):
                break
        own = codes[at:end]
        letter = _letters()[own]
        x = np.zeros(len(own) + 2, np.uint32)
        x[1:-1] = np.where(letter, own, 0)
        where = np.flatnonzero(letter)
        if len(where):
            mixed = x[where] * np.uint32(0x9E3779B1) ^ x[where + 1] * np.uint32(0x85EBCA77) ^ x[where + 2] * np.uint32(0xC2B2AE3D)
            mixed ^= mixed >> np.uint32(15)
            mixed *= np.uint32(0x2C1B3C6D)
            yield (mixed >> np.uint32(16)).astype(np.int64) & (BUCKETS - 1), np.flatnonzero(np.r_[True, np.diff(where) > 1])


def held_out(id_col: str = "doc_id") -> F.Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages, and the log probability of each bucket (row) in each language (column), from all rows with a language."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}

        def told() -> Iterator[pa.RecordBatch]:
            for lang, n in sums.items():
                some = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some, pa.int32()), pa.array(n[some])], names=["lang", "bucket", "n"])
            sums.clear()

        for batch in batches:
            for text, lang in zip(binary_list(batch, text_col), batch.column(lang_col).to_pylist(), strict=True):
                if lang not in sums and len(sums) == HELD:
                    yield from told()
                for found, _ in trigrams(text):
                    np.add.at(sums.setdefault(lang, np.zeros(BUCKETS, np.int64)), found, 1)
        yield from told()

    rows = docs.where(F.col(lang_col).isNotNull()).select(F.col(text_col), F.col(lang_col).cast("string").alias(lang_col))
    counted = rows.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    counted = materialise(counted, "trigrams")
    langs = sorted(r["lang"] for r in counted.select("lang").distinct().collect())
    buckets = BUCKETS
    while buckets > 1 and buckets * len(langs) > MOST_CELLS:
        buckets //= 2
    got = counted.groupBy("lang", F.floor(F.col("bucket") / (BUCKETS // buckets)).cast("int").alias("bucket")).agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros((buckets, len(langs)), np.float32)
    place = {x: i for i, x in enumerate(langs)}
    table[got["bucket"].to_numpy(), [place[x] for x in got["lang"].to_pylist()]] = got["n"].to_numpy()
    return langs, np.log((table + SMOOTHING) / (table.sum(0, dtype=np.float64) + SMOOTHING * buckets)).astype(np.float32)


def _proportions(p: np.ndarray) -> tuple[np.ndarray, float]:
    """EM over words (rows) and languages (columns) of likelihoods; proportions and log likelihood."""
    share = np.full(p.shape[1], 1 / p.shape[1])
    if p.shape[1] > 1:
        for _ in range(STEPS):
            joint = p * share
            new = (joint / joint.sum(1, keepdims=True)).mean(0)
            done = np.abs(new - share).max() < 1e-4
            share = new
            if done:
                break
    return share, float(np.log(np.maximum(p @ share, 1e-300)).sum())


def infer(text: bytes | None, table: np.ndarray) -> np.ndarray | None:
    """Each language's proportion; None without letters."""
    each = BUCKETS // len(table)
    words = [np.add.reduceat(table[found // each], first, axis=0) for found, first in trigrams(text)]
    if not words or not table.shape[1]:
        return None
    log = words[0] if len(words) == 1 else np.concatenate(words)
    p = np.exp((log - log.max(1, keepdims=True)).astype(np.float64)) + 1e-12
    share, _ = _proportions(p)
    order = np.argsort(-share, kind="stable")
    order = order[: max(1, int((share > 0.5 / len(p)).sum()))]
    best, chosen, value = None, order[:1], np.ones(1)
    for k in range(1, len(order) + 1):
        some, fit = _proportions(p[:, order[:k]])
        fit -= PENALTY * (k - 1) * np.log(len(p) + 1)
        if best is None or fit > best:
            best, chosen, value = fit, order[:k], some
    out = np.zeros(table.shape[1])
    out[chosen] = value
    return out


def with_language(docs: DataFrame, model: tuple[list[str], np.ndarray], text_col: str = "text", prefix: str = "") -> DataFrame:
    """docs and (lang_pred, score, n_languages)."""
    small_batches(docs.sparkSession)
    langs = model[0]
    shared = docs.sparkSession.sparkContext.broadcast(model[1])
    names = [prefix + x for x in ("lang_pred", "score", "n_languages")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [infer(x, shared.value) for x in binary_list(batch, text_col)]
            pred = [("und" if x is None else langs[int(x.argmax())]) for x in found]
            score = [(0.0 if x is None else min(1.0, float(x.max()))) for x in found]
            n = [0 if x is None else int((x > 0).sum()) for x in found]
            yield with_column(batch, **dict(zip(names, (pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(n, pa.int32())), strict=True)))

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *(T.StructField(x, t) for x, t in zip(names, (T.StringType(), T.DoubleType(), T.IntegerType()), strict=True))]))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id_col, held_out, lang_pred, score, n_languages) for every row, learned from the rows that aren't held out."""
    model = train(docs.where(~held_out(id_col)), text_col, lang_col)
    return with_language(docs.select(id_col, text_col), model, text_col).select(id_col, held_out(id_col).alias("held_out"), "lang_pred", "score", "n_languages")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")))


def keep_known(docs: DataFrame, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """docs in whose text one language has at least the given proportion."""
    prefix = "__l_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix += "_"
    found = with_language(docs, train(docs.where(~held_out(id_col)), text_col, lang_col), text_col, prefix)
    return found.where((F.col(f"{prefix}lang_pred") != "und") & (F.col(f"{prefix}score") >= least)).select(*[F.col(f"`{c}`") for c in docs.columns])
