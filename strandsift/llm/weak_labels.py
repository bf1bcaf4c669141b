"""Quality classifier from weak labels.

Overlapping heuristic labellers each vote good, bad or nothing. Expectation-maximisation (a class of good texts and several of bad ones, votes
independent given the class; see estimate()) finds how accurate each labeller is and gives every pattern of votes the probability of being good. These
posteriors are the labels on which a linear scorer over hashed features is trained: character trigrams of the text as it stands, and the text's
measures in coarse steps. Every text is then scored.

Scale: two passes over texts, without shuffles: one that votes and hashes the features of a sample, one that scores. EM runs on counts of vote patterns (3
** labellers at most, a few hundred in fact); all texts count. The scorer is fitted on about SAMPLE rows, chosen by a hash of id, text and row number,
so that repeated rows count as rows, and on about ENTRIES features of theirs in all; these bounds hold at any size.

A null or empty text has votes like any other and is scored by its measures. Texts are read whole, whatever their length. Every row gives a row, also
repeated ones. Ties: a score of exactly 0.5 is kept. An empty table gives an empty one. Further columns aren't read, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandsift.llm.common import binary_list, keyed, materialise, small_batches
from strandsift.llm.quality import measure
from strandsift.plans.planner import spread

BUCKETS, SAMPLE, EPOCHS, RATE, RIDGE, STEPS = 1 << 16, 6_000, 6, 0.5, 1e-6, 200
ENTRIES = 8_000_000
BLOCK = 1 << 20
GOOD, BAD, NONE = 1, 0, 2
#: What is thought before the votes are seen: rates of bad votes, with the weight of so many votes, however many texts there are.
FALSE_ALARM, HIT, PRIOR = 0.01, 0.95, 200
#: (name, value, upper limit of good, lower limit of bad); between them the labeller has no vote. Values from facts().
LABELLERS = (
    ("symbols", "symbol_rate", 0.01, 0.05),
    ("capitals", "upper_rate", 0.15, 0.50),
    ("lines", "line_rate", 0.05, 0.50),
    ("repeats", "repeat_rate", 0.05, 0.50),
    ("marks", "mark_rate", 0.05, 0.30),
    ("brevity", "short", 0.0, 1.0),
    ("sameness", "sameness", 0.15, 0.35),
    ("word_length", "word_length", 10.0, 16.0),
)


def facts(text: bytes | None) -> dict[str, float]:
    words, chars, symbols, dup_lines, repeats, lines, upper, marks = measure(text)
    distinct = len(set((text or b"").split()))
    return {
        "symbol_rate": symbols / max(1, chars), "upper_rate": upper / max(1, chars), "line_rate": dup_lines / max(1, lines), "repeat_rate": repeats / max(1, words),
        "mark_rate": marks / max(1, words), "short": 1.0 if words < 3 else 0.5 if words < 20 else 0.0, "sameness": 1 - math.log(distinct) / math.log(words) if words > 1 else 0.0, "word_length": chars / max(1, words),
    }


def votes(found: dict[str, float]) -> list[int]:
    return [GOOD if found[key] <= good else BAD if found[key] >= bad else NONE for _, key, good, bad in LABELLERS]


def pattern(cast: list[int]) -> int:
    out = 0
    for x in cast:
        out = 3 * out + x
    return out


def features(text: bytes | None, found: dict[str, float]) -> tuple[np.ndarray, int]:
    """Buckets of all trigrams and, last, of the measures' steps; how many of them are trigrams."""
    codes = np.frombuffer((text or b"").decode().encode("utf-32-le", "surrogatepass"), "<u4")
    parts = []
    for at in range(0, max(0, len(codes) - 2), BLOCK):
        x = codes[at : at + BLOCK + 2]
        mixed = x[:-2] * np.uint32(0x9E3779B1) ^ x[1:-1] * np.uint32(0x85EBCA77) ^ x[2:] * np.uint32(0xC2B2AE3D)
        mixed ^= mixed >> np.uint32(15)
        mixed *= np.uint32(0x2C1B3C6D)
        parts.append((mixed >> np.uint32(16)).astype(np.int64) & (BUCKETS - 1))
    grams = sum(map(len, parts))
    steps = [(7919 * (i + 1) + 104729 * min(15, int(10 * found[key] / bad))) & (BUCKETS - 1) for i, (_, key, _, bad) in enumerate(LABELLERS)]
    return np.concatenate([*parts, np.array(steps, np.int64)]), grams


def weights(n: int, grams: int) -> np.ndarray:
    """Trigrams share weight 3 among them; each step has weight 1."""
    out = np.ones(n)
    out[:grams] = 3.0 / max(1, grams)
    return out


def estimate(counts: dict[int, int]) -> tuple[dict[int, float], np.ndarray, float]:
    """EM on counts of patterns: each pattern's probability of good; the labellers' accuracies [labeller, vote], the share of right ones among its good and bad votes; the share of good.

    Bad texts are bad in different ways, and labellers of one way know nothing of the others. So there is a class of bad texts for each labeller,
    which begins with those it votes bad, and one of good texts, which begins with those that none votes bad. Each class has a table of every
    labeller's vote probabilities, estimated from the votes. Where others overlap with a labeller, EM finds out how often it errs. Votes alone can't
    tell a way of being bad that only one sees from that labeller's errors, so EM begins from a prior: a good text gets a labeller's bad vote at a rate of
    FALSE_ALARM, and one that is bad in the way that it looks for at a rate of HIT, with the weight of PRIOR votes, which many texts outweigh.
    """
    keys = np.array(sorted(counts), np.int64)
    n = np.array([counts[int(k)] for k in keys], float)
    m = len(LABELLERS)
    vote = np.stack([(keys // 3 ** (m - 1 - i)) % 3 for i in range(m)], axis=1).reshape(-1, m)
    cast = (vote[:, :, None] == np.arange(2)).astype(float)  # pattern, labeller, vote; no vote says nothing
    p = np.zeros((len(keys), m + 1))
    p[:, :m] = cast[:, :, BAD]
    p[:, m] = p.sum(1) == 0
    p /= p.sum(1, keepdims=True)
    share = np.ones(m + 1)
    for _ in range(STEPS):
        held = p * n[:, None]
        share = (held.sum(0) + 1) / (n.sum() + m + 1)
        table = np.einsum("kc,kiv->civ", held, cast) + 0.5
        table[m] += PRIOR * np.array([FALSE_ALARM, 1 - FALSE_ALARM])
        table[range(m), range(m)] += PRIOR * np.array([HIT, 1 - HIT])
        table /= table.sum(2, keepdims=True)
        log = np.log(share) + np.einsum("kiv,civ->kc", cast, np.log(table))
        new = np.exp(log - log.max(1, keepdims=True))
        new /= new.sum(1, keepdims=True)
        done = not len(new) or np.abs(new - p).max() < 1e-7
        p = new
        if done:
            break
    good = p[:, m]
    accuracy = np.zeros((m, 2))
    for v, right in ((GOOD, good), (BAD, 1 - good)):
        accuracy[:, v] = (cast[:, :, v] * (n * right)[:, None]).sum(0) / np.maximum(1e-9, (cast[:, :, v] * n[:, None]).sum(0))
    return {int(k): float(x) for k, x in zip(keys, good, strict=True)}, accuracy, float(share[m])


def fit(rows: list[tuple[np.ndarray, np.ndarray, float]]) -> tuple[np.ndarray, float]:
    """Logistic regression on (buckets, weights, posterior) by AdaGrad, in an order fixed by a seed."""
    w, b = np.zeros(BUCKETS), 0.0
    sums, bias_sum = np.full(BUCKETS, 1e-8), 1e-8
    order = np.random.default_rng(0)
    for _ in range(EPOCHS):
        for i in order.permutation(len(rows)).tolist():
            at, x, y = rows[i]
            gap = 1 / (1 + np.exp(-np.clip(w[at] @ x + b, -50, 50))) - y
            step = gap * x + RIDGE * w[at]
            sums[at] += step * step
            w[at] -= RATE * step / np.sqrt(sums[at])
            bias_sum += gap * gap
            b -= RATE * gap / np.sqrt(bias_sum)
    return w, float(b)


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """(id_col, votes string, posterior, score, kept) for every row of docs."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(id_col, text_col)
    rows, _, row = keyed(docs)
    part = min(1.0, sample / max(1, docs.count()))
    place = F.xxhash64(F.col(id_col).cast("string"), F.col(text_col), F.col(row))
    chosen = F.pmod(place, F.lit(1 << 30)) < int((1 << 30) * part)
    kinds = [("pattern", pa.int64()), ("n", pa.int64()), ("place", pa.int64()), ("at", pa.list_(pa.int32())), ("x", pa.list_(pa.float32()))]

    def voting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """How many texts have each pattern; and of chosen ones the features, with n = 0."""
        seen: Counter[int] = Counter()
        for batch in batches:
            out = []
            for text, taken, nth in zip(binary_list(batch, "text"), batch.column("chosen").to_pylist(), batch.column("place").to_pylist(), strict=True):
                found = facts(text)
                own = pattern(votes(found))
                seen[own] += 1
                if taken:
                    at, grams = features(text, found)
                    distinct, where = np.unique(at, return_inverse=True)
                    out.append({"pattern": own, "n": 0, "place": nth, "at": distinct.astype(np.int32), "x": np.bincount(where, weights(len(at), grams)).astype(np.float32)})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema(kinds))
        yield pa.RecordBatch.from_pylist([{"pattern": k, "n": n} for k, n in seen.items()], schema=pa.schema(kinds))

    voted = rows.select(F.col(text_col).alias("text"), place.alias("place"), chosen.alias("chosen")).mapInArrow(voting, "pattern long, n long, place long, at array<int>, x array<float>")
    voted = materialise(voted, "weak-votes")
    counts = {r["pattern"]: r["n"] for r in voted.where("n > 0").groupBy("pattern").agg(F.sum("n").alias("n")).collect()}
    posterior, _, share = estimate(counts)
    features_of = voted.where("n = 0")
    entries = features_of.agg(F.sum(F.size("at"))).first()[0] or 0
    fewer = F.pmod(F.xxhash64("place", F.lit("fewer")), F.lit(1 << 30)) < int((1 << 30) * min(1.0, ENTRIES / max(1, entries)))
    got = features_of.where(fewer).select("pattern", "at", "x").orderBy("pattern", F.xxhash64("at"), "at").toArrow()
    w, b = fit([(a.values.to_numpy(), x.values.to_numpy().astype(float), posterior[p]) for p, a, x in zip(got["pattern"].to_pylist(), got["at"], got["x"], strict=True)])
    model = spark.sparkContext.broadcast((w, b, posterior, share))

    def scoring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, b, posterior, share = model.value
        for batch in batches:
            shown, post, score = [], [], []
            for text in binary_list(batch, text_col):
                found = facts(text)
                cast = votes(found)
                at, grams = features(text, found)
                z = 3.0 * w[at[:grams]].sum() / max(1, grams) + w[at[grams:]].sum() + b
                shown.append("".join("-+."[x] for x in cast))
                post.append(posterior.get(pattern(cast), share))
                score.append(float(1 / (1 + np.exp(-np.clip(z, -50, 50)))))
            kept = [x >= 0.5 for x in score]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shown, pa.string()), pa.array(post, pa.float64()), pa.array(score, pa.float64()), pa.array(kept, pa.bool_())], names=[id_col, "votes", "posterior", "score", "kept"])

    schema = T.StructType([docs.schema[id_col], *T._parse_datatype_string("votes string, posterior double, score double, kept boolean").fields])
    return docs.mapInArrow(scoring, schema)


def op3_weak_label_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")))
