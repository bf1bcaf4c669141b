"""Best-fit packing by a plan over the histogram of lengths.

Texts become token pieces of at most `capacity` ids. The lengths' histogram (at most `capacity` rows, whatever the input) is packed by best fit,
longest first, with counts instead of pieces: a plan row says that the pieces of one length with ranks from..to fill bins start, start + 1, ...
with `per_bin` pieces each from place `base`. Then each piece is ranked within its length and joins the plan row of its rank.

Scale: only counts reach the driver. Ranks within a hot length are counted in buckets that pieces are dealt to by their place in the table, whatever
their ids, not in one task. The plan's size depends on the capacity only, so it may be broadcast.

A null text is empty, and an empty text is the one id that ends a document. Strings of the vocabulary's added tokens in a text become their ids, as the
tokenizer has it. Longer texts are cut, never dropped. A null doc_id is kept as null. Repeated rows and ids are pieces of their own. Ties: pieces of one
length are alike; which takes which slot is open. An empty table gives an empty one. Further columns aren't read, whatever their names.
"""

from __future__ import annotations

import functools
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandsift.llm.common import materialise, rank_within, small_batches, spread_over, unused
from strandsift.plans.planner import spread

CAPACITY = 4096
END_ID = 1
#: Chunks and units whose ids a worker keeps for good, the first that it meets, and for a while, some 150 bytes each.
KEPT, RECENT = 300_000, 200_000

_LATIN = re.compile(r"[a-zªµºß-öø-ÿ]+|'s|'t|'re|'ve|'m|'ll|'d|[0-9²³¹¼½¾]|[^\sa-zªµºß-öø-ÿ0-9²³¹¼½¾]+")
#: White space to str.split(), but not to the tokenizer.
_SEPARATORS = re.compile("[\x1c-\x1f]")
#: Characters that are neither letters, numbers nor white space.
_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


class WordTokenizer:
    """Ids of whole texts as little-endian unsigned 32-bit numbers, from the ids of their chunks, which are kept.

    The vocabulary's pre-tokenizer drops white space and never joins across it, so a text's ids are those of its chunks between blanks. Chunks in
    Latin-1 are lower-cased and cut by the pre-tokenizer's own pattern, after which each part is one unit that ends with an id of a word's end;
    others are encoded as they are.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        # For units, which are normal and cut already.
        self.units_only = Tokenizer.from_file(path)
        self.units_only.encode_special_tokens = True
        self.units_only.normalizer = normalizers.Sequence([])
        self.units_only.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for x, i in vocabulary.items() if x.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {}

    def _learn_units(self, units: list[str]) -> None:
        ids = np.array(self.units_only.encode_batch_fast([" ".join(units)], add_special_tokens=False)[0].ids, "<u4")
        stops = (4 * np.flatnonzero(self.ends[ids]) + 4).tolist()
        raw = ids.tobytes()
        self.known.update({unit: raw[a:b] for unit, a, b in zip(units, [0, *stops[:-1]], stops, strict=True)})

    def _learn(self, missing: list[str]) -> None:
        """Chunks without blanks, and the units that they consist of."""
        known, units, cut, others = self.known, set(), {}, []
        for x in missing:
            if not x.isascii():
                try:
                    x.encode("latin-1")
                except UnicodeEncodeError:
                    others.append(x)
                    continue
            if _SEPARATORS.search(x):
                others.append(x)
                continue
            small = x.lower()
            if small.isalpha():
                parts = (small,)
            else:
                word = small.rstrip(_MARKS)
                parts = (word, small[len(word) :]) if word.isalpha() else _LATIN.findall(small)
            units.update([y for y in parts if y not in known])
            if parts != (x,):
                cut[x] = parts
        if units:
            self._learn_units(list(units))
        known.update({x: b"".join([known[y] for y in parts]) for x, parts in cut.items()})
        if others:
            found = self.tokenizer.encode_batch_fast(others, add_special_tokens=False)
            known.update({x: np.array(y.ids, "<u4").tobytes() for x, y in zip(others, found, strict=True)})

    def many(self, texts: pa.Array) -> list[bytes]:
        """Ids of each text; a null has none. What is new in all of them is encoded at once. Texts that hold a string of an added token are encoded whole."""
        texts = pc.fill_null(texts, "")
        whole = functools.reduce(pc.or_, (pc.match_substring(texts, x) for x in self.added), pa.array([False] * len(texts), pa.bool_()))
        if not whole.true_count:
            return self._many(texts)
        found = self._many(pc.if_else(whole, "", texts))
        at = np.flatnonzero(whole.to_numpy(zero_copy_only=False)).tolist()
        for i, own in zip(at, self.tokenizer.encode_batch_fast(texts.take(at).to_pylist(), add_special_tokens=False), strict=True):
            found[i] = np.array(own.ids, "<u4").tobytes()
        return found

    def _many(self, texts: pa.Array) -> list[bytes]:
        known, lists = self.known, pc.ascii_split_whitespace(texts)
        chunks = lists.flatten().dictionary_encode()
        distinct = chunks.dictionary.to_pylist()
        self._learn([x for x in distinct if x not in known])
        found = [known[x] for x in distinct]
        if len(known) > KEPT + RECENT:
            for x in list(known)[KEPT:]:
                del known[x]
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        which = chunks.indices.to_numpy()
        upto = np.r_[0, np.cumsum(size[which])]
        place = np.repeat((np.cumsum(size) - size)[which] - upto[:-1], size[which]) + np.arange(upto[-1])
        raw = np.frombuffer(b"".join(found), "<u4")[place].tobytes()
        at = (4 * upto[lists.offsets.to_numpy()]).tolist()
        return [raw[a:b] for a, b in pairwise(at)]

    def __call__(self, text: str) -> bytes:
        return self.many(pa.array([text], pa.string()))[0]


@functools.cache
def _tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def token_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, vocabulary: str | None = None, with_ids: bool = True) -> DataFrame:
    """(id_col, piece int, start long, length long, ids_crc32 long[, ids array<int>]): each text's ids and the end id, cut into pieces if longer than capacity."""
    small_batches(docs.sparkSession)
    path = vocabulary or vocabulary_path()
    kind = docs.schema[id_col].dataType
    fields = [T.StructField(id_col, kind), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())]
    fields += [T.StructField("ids", T.ArrayType(T.IntegerType()))] * with_ids
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _tokenizer(path)
        for batch in batches:
            row, piece, start, length, crc, ids = [], [], [], [], [], []
            for i, found in enumerate(encode.many(batch.column(1))):
                found += end
                for k, at in enumerate(range(0, len(found), 4 * capacity)):
                    part = found[at : at + 4 * capacity]
                    row.append(i)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        ids.append(np.frombuffer(part, "<i4"))
            columns = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(ids, pa.list_(pa.int32()))] * with_ids, names=[f.name for f in fields])

    return docs.select(id_col, text_col).mapInArrow(run, T.StructType(fields))


def best_fit_plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """Rows (length, first rank, first bin, per_bin, base), sorted; the number of bins.

    Best fit, longest first: a piece goes to the fullest bin that has room. Bins that are alike are handled together: of `n` bins with `room`,
    the next `n * (room // length)` pieces of a length fill one after the other.
    """
    rows: list[tuple[int, int, int, int, int]] = []
    rooms: list[int] = []
    bins: dict[int, list[tuple[int, int]]] = {}
    total = 0

    def put(room: int, first: int, n: int) -> None:
        if room and n:
            if room not in bins:
                insort(rooms, room)
                bins[room] = []
            bins[room].append((first, n))

    for length in sorted(counts, reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"a piece of {length} ids")
        rank, left = 0, counts[length]
        while left:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                room, first, n = capacity, total, -(-left // (capacity // length))
                total += n
            else:
                room = rooms[at]
                first, n = bins[room].pop()
                if not bins[room]:
                    del bins[room], rooms[at]
            each = room // length
            full = min(n, left // each)
            some = left - full * each if full < n else 0
            some = min(some, each)
            rows.append((length, rank, first, each, capacity - room))
            used = full * each + some
            put(room - each * length, first, full)
            if some:
                put(room - some * length, first + full, 1)
            put(room, first + full + bool(some), n - full - bool(some))
            rank += used
            left -= used
    return np.array(sorted(rows), np.int64).reshape(-1, 5), total


def pack(pieces: DataFrame, id_col: str = "doc_id", capacity: int = CAPACITY) -> DataFrame:
    """pieces and (sequence_id long, offset long): the sequence of at most capacity ids that each joins and its place there.

    pieces: id_col, piece, length and any more columns; read more than once, so a written table.
    """
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan, _ = best_fit_plan(counts, capacity)
    buckets = spread_over(pieces.sparkSession, sum(counts.values()))
    salt, nth = unused(pieces.columns, "__salt", "__rank")
    salted = pieces.withColumn(salt, F.monotonically_increasing_id())  # the same at each reading, as pieces are a written table
    ranked = rank_within(salted, ["length"], F.pmod(F.xxhash64(salt), F.lit(buckets)), [F.col(salt)], nth).drop(salt)
    shared = pieces.sparkSession.sparkContext.broadcast(plan)
    fields = [f for f in ranked.schema.fields if f.name != nth]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = shared.value
        shift = int(rows[:, 1].max()) + 1 if len(rows) else 1
        keys = [int(a) * shift + int(b) for a, b in rows[:, :2].tolist()]
        at = np.array(keys, np.int64) if not keys or keys[-1] < 2**62 else np.array(keys, object)
        for batch in batches:
            length, rank = (batch.column(x).to_numpy(zero_copy_only=False).astype(at.dtype) for x in ("length", nth))
            row = rows[np.searchsorted(at, length * shift + np.minimum(rank, shift - 1), side="right") - 1]
            behind = rank.astype(np.int64) - row[:, 1]
            columns = [batch.column(f.name) for f in fields]
            columns += [pa.array(row[:, 2] + behind // row[:, 3]), pa.array(row[:, 4] + behind % row[:, 3] * row[:, 0])]
            yield pa.RecordBatch.from_arrays(columns, names=[*(f.name for f in fields), "sequence_id", "offset"])

    return ranked.mapInArrow(run, T.StructType([*fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]))


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, vocabulary: str | None = None, with_ids: bool = False) -> DataFrame:
    """Pieces of all docs with their places; with_ids: with their ids too."""
    return pack(materialise(token_pieces(docs, id_col, text_col, capacity, vocabulary, with_ids), "pieces"), id_col, capacity)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack_documents(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
