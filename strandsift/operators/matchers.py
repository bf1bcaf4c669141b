"""Matchers: a needle (or a set of them) that finds its places in a table of sequences.

find() is lazy and gives one row a hit; null and empty sequences have none, nor has an empty needle. Positions are characters from 0; a begin is
inclusive, an end exclusive. search() goes through one sequence here and now, and calls back at each hit, where position() says which it is.
Restorable matchers also go through chunks of a sequence one after the other: search() with capture() and restore(), resume() in batch, and
strandsift.streaming on a stream.
deal: over how many tasks the pieces of long sequences are dealt; 0: rows stay where they are.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandsift.operators import kernels
from strandsift.operators.needles import NeedleTable, automaton, places, read_part, seed_column
from strandsift.plans import planner

BEGIN, END, DISTANCE = ("begin_pos", T.LongType()), ("end_pos", T.LongType()), ("distance", T.IntegerType())


class Searching:
    """search() and position() for matchers whose hits() of a text are columns, places first."""

    _at: tuple = ()

    def search(self, text: str, on_hit: Callable[[int], None] | None = None) -> list[int]:
        """Places of all hits in a text; on_hit is called with each one, in order."""
        found = []
        for self._at in zip(*self.hits(text), strict=True):
            found.append(self._at[0])
            if on_hit is not None:
                on_hit(self._at[0])
        return found

    def position(self) -> tuple:
        """The last hit's columns: its place, then what else the matcher tells."""
        return self._at


@dataclass
class Horspool(Searching):
    """Exact: begins of all occurrences, overlapping ones too. Only sequences that hold the needle leave the JVM."""

    needle: str

    def window_size(self) -> int:
        return len(self.needle)

    @staticmethod
    def window_column(needle: Column) -> Column:
        """Window sizes of a column of needles."""
        return F.length(needle).cast("long")

    def hits(self, text: str) -> tuple[list[int], ...]:
        return (kernels.exact_begins(text, self.needle),)

    def find(self, haystacks: DataFrame, id_col: str = "haystack_id", seq_col: str = "seq", deal: int = 0) -> DataFrame:
        held = haystacks.where(F.contains(F.col(seq_col), F.lit(self.needle)) if self.needle else F.lit(False))
        needle = self.needle
        return planner.scan(held, id_col, seq_col, self, lambda text: (kernels.exact_begins(text, needle),), [BEGIN], self.window_size(), deal=deal)


@dataclass
class ShiftOr(Horspool):
    """Exact: the same hits."""


@dataclass
class RestorableShiftOr(ShiftOr):
    """Exact, resumable: a match may begin in an earlier chunk, so chunked searches give ends."""

    state: kernels.PrefixState = field(default_factory=kernels.PrefixState)

    def capture(self) -> kernels.PrefixState:
        return self.state

    def restore(self, state: kernels.PrefixState) -> None:
        self.state = state

    def start(self) -> kernels.PrefixState:
        return kernels.PrefixState()

    def step(self, text: str, state: kernels.PrefixState) -> tuple[list[int], kernels.PrefixState]:
        return kernels.exact_ends(text, self.needle, state)

    fields = (END,)

    def hits(self, text: str) -> tuple[list[int], ...]:
        """Ends in one chunk, counted from its beginning; the matcher's state moves on."""
        *found, self.state = self.step(text, self.state)
        return tuple(found)

    def behind(self, context: str, offset: int) -> kernels.PrefixState:
        """A state that finds what a state behind offset symbols finds, of which context is the last window_size() - 1."""
        return self.step(context, self.start())[-1]

    def resume(self, chunks: DataFrame, id_col: str = "haystack_id", order_col: str = "chunk_idx", seq_col: str = "seq", first: int = 0) -> DataFrame:
        """Hits in sequences that come in chunks. Which chunks count, and in what order: see planner.resume()."""
        return planner.resume(chunks, id_col, order_col, seq_col, self, list(self.fields), first)


def _checked(k: int) -> int:
    if k < 0:
        raise ValueError("the number of errors is 0 or more")
    return k


@dataclass
class Myers(Searching):
    """Approximate: every end at which the needle ends within k edits, with the least distance."""

    needle: str
    k: int = 0

    def __post_init__(self) -> None:
        _checked(self.k)

    def window_size(self) -> int:
        return len(self.needle) + self.k

    @staticmethod
    def window_column(needle: Column, k: int) -> Column:
        """Window sizes of a column of needles."""
        return (F.length(needle) + k).cast("long")

    def hits(self, text: str) -> tuple[list[int], ...]:
        return self._search(text) if self.needle else ([], [])

    def _search(self, text: str) -> tuple[list[int], list[int]]:
        if len(self.needle) // (self.k + 1) >= 3:  # pieces that long are rare enough to look for first
            from strandsift.operators.approximate import approximate_hits

            ends, _, distances = approximate_hits(text, ((0, self.needle),), self.k)
            return ends, distances
        return kernels.edit_ends(text, self.needle, self.k, kernels.first_edit_state(self.needle))[:2]

    def find(self, haystacks: DataFrame, id_col: str = "haystack_id", seq_col: str = "seq", deal: int = 0) -> DataFrame:
        return planner.scan(haystacks.where(F.lit(bool(self.needle))), id_col, seq_col, self, self._search, [END, DISTANCE], self.window_size(), ends=True, deal=deal)


@dataclass
class RestorableMyers(Myers):
    """Approximate, resumable."""

    anchored = False
    fields = (END, DISTANCE)

    def __post_init__(self) -> None:
        super().__post_init__()
        self.state = self.start()

    def start(self) -> kernels.EditState:
        return kernels.first_edit_state(self.needle)

    def capture(self) -> kernels.EditState:
        return self.state

    def restore(self, state: kernels.EditState) -> None:
        self.state = state

    def step(self, text: str, state: kernels.EditState) -> tuple[list[int], list[int], kernels.EditState]:
        return kernels.edit_ends(text, self.needle, self.k, state, self.anchored)

    def behind(self, context: str, offset: int) -> kernels.EditState:
        """A state that finds what a state behind offset symbols finds, of which context is the last window_size() - 1."""
        state = self.start() if self.anchored and offset >= self.window_size() else self.step(context, self.start())[-1]
        return replace(state, seen=offset)

    hits = RestorableShiftOr.hits
    resume = RestorableShiftOr.resume


@dataclass
class RestorableMyersPrefix(RestorableMyers):
    """Approximate, resumable, from the sequence's beginning: ends e with distance(needle, first e symbols) <= k."""

    anchored = True

    def find(self, haystacks: DataFrame, id_col: str = "haystack_id", seq_col: str = "seq", deal: int = 0) -> DataFrame:
        """In the JVM: no end lies behind the needle's length + k, so only so much of a sequence matters."""
        span = F.substring(F.col(seq_col), 1, self.window_size())
        rows = haystacks.where(F.lit(bool(self.needle)) & (F.length(span) > 0)).select(id_col, span.alias("__span"))
        ends = rows.select(id_col, "__span", F.explode(F.sequence(F.lit(1), F.length("__span"))).alias("__end"))
        distance = F.levenshtein(F.lit(self.needle), F.substring(F.col("__span"), F.lit(1), F.col("__end")), self.k)
        return ends.withColumn("distance", distance).where("distance >= 0").select(id_col, F.col("__end").cast("long").alias("end_pos"), "distance")


def seed_length(needles: list[str], error_rate: float) -> int:
    """The longest seeds that can't all be missed: of floor(rate * m) + 1 disjoint pieces of a needle of m symbols one has no error. Needles that allow under 3 are ignored."""
    lengths = [len(x) // (int(error_rate * len(x)) + 1) for x in needles if x]
    return min((x for x in lengths if x >= 3), default=0)


@dataclass
class Pigeonhole(Searching):
    """Seeds: every place where a piece of a needle occurs, with which needle (index), which piece (offset) and its length (count). Hits aren't verified.

    needles: one, a list (index: the place in it), or a table with columns needle_id (index: its value) and needle, of any size.
    mask_runs: seeds inside a run of at least so many equal symbols are left out. A list of over LOCAL pieces isn't sent to the tasks; seeds and
    pieces are joined instead.
    """

    needles: str | list[str] | DataFrame
    error_rate: float = 0.0
    mask_runs: int | None = None
    LOCAL = 1_000_000

    def __post_init__(self) -> None:
        if not 0 <= self.error_rate < 1:
            raise ValueError("the error rate is at least 0 and under 1")
        self.table = NeedleTable(self.needles, error_rate=self.error_rate) if isinstance(self.needles, DataFrame) else None
        if self.table is None:
            self.needles = [self.needles] if isinstance(self.needles, str) else list(self.needles)
        self.q = seed_length(self.needles, self.error_rate) if self.table is None else self.table.q
        self.finder: Seeds | None = None

    def window_size(self) -> int:
        return self.q

    @staticmethod
    def window_column(needle: Column, error_rate: float = 0.0) -> Column:
        """Window sizes of a column of needles, each a set of its own."""
        seed = seed_column(needle, error_rate)
        return F.when(seed >= 3, seed).otherwise(0).cast("long")

    def _numbered(self) -> list[tuple[int, str]]:
        return list(enumerate(self.needles))

    def pieces(self) -> list[tuple[str, int, int]]:
        """(piece, index, offset) of every needle of a list, in order."""
        return pieces(self._numbered(), self.q, self.error_rate)

    def _masked(self, text: str) -> list[tuple[int, int]]:
        return masked(text, self.mask_runs)

    def hits(self, text: str) -> tuple[list[int], ...]:
        if self.finder is None:
            needles = self._numbered() if self.table is None else [x for path in self.table.paths for x in read_part(path)]
            self.finder = Seeds(needles, self.q, self.error_rate, self.mask_runs)
        return self.finder(text)

    def find(self, haystacks: DataFrame, id_col: str = "haystack_id", seq_col: str = "seq", deal: int = 0) -> DataFrame:
        from strandsift.operators.approximate import Late, _in_part

        q, rate, runs = self.q, self.error_rate, self.mask_runs
        fields = [BEGIN, *((x, T.LongType()) for x in ("index", "offset", "count"))]
        size = 1 << 62 if runs else planner.CHUNK  # a run may be longer than any context: then sequences stay whole

        def scan(search: Callable[[str], tuple], fields: list) -> DataFrame:
            return planner.scan(haystacks.where(F.lit(q > 0)), id_col, seq_col, None, search, fields, q, size=size, deal=deal)

        if self.table is not None:
            return self.table.each(lambda path: scan(functools.partial(_in_part, Seeds, path, q, rate, runs), fields))
        own = self.pieces()
        if len(own) > self.LOCAL:
            grams = scan(functools.partial(_all_grams, q=q, runs=runs), [BEGIN, ("gram", T.StringType())])
            table = haystacks.sparkSession.createDataFrame(own, "gram string, index long, offset long")
            return grams.join(table, "gram").select(id_col, "begin_pos", "index", "offset", F.lit(q).cast("long").alias("count"))
        return scan(Late(functools.partial(Seeds, self._numbered(), q, rate, runs)), fields)


def pieces(needles: list[tuple[int, str]], q: int, error_rate: float) -> list[tuple[str, int, int]]:
    """(piece of q symbols, needle's number, offset), needles that allow under 3 left out."""
    return [(x[at : at + q], i, at) for i, x in needles if q and len(x) // (int(error_rate * len(x)) + 1) >= 3 for at in range(0, len(x) - q + 1, q)]


class Seeds:
    """Finds the pieces of needles (index, text)."""

    def __init__(self, needles: list[tuple[int, str]], q: int, error_rate: float, mask_runs: int | None) -> None:
        self.q, self.mask_runs = q, mask_runs
        self.postings: dict[str, list[tuple[int, int]]] = {}
        for piece, index, offset in pieces(needles, q, error_rate):
            self.postings.setdefault(piece, []).append((index, offset))
        self.finder = automaton(self.postings)

    def __call__(self, text: str) -> tuple[list[int], ...]:
        """(begins, indexes, offsets, counts)."""
        return _seed_hits(text, self.postings, self.q, functools.partial(masked, least=self.mask_runs), self.finder)


def _seed_hits(text: str, postings: dict[str, list[tuple[int, int]]], q: int, runs_of: Callable[[str], list], finder: object = None) -> tuple[list[int], ...]:
    """Places of pieces; finder: the automaton of postings, if it is made already."""
    out: tuple[list[int], ...] = ([], [], [], [])
    runs = runs_of(text)
    for begin, word in places(finder or automaton(postings), text):
        if not (runs and _inside(begin, q, runs)):
            for index, offset in postings[word]:
                for column, value in zip(out, (begin, index, offset, q), strict=True):
                    column.append(value)
    return out


def masked(text: str, least: int | None) -> list[tuple[int, int]]:
    """Runs of at least so many equal symbols."""
    return [] if not least else [m.span() for m in re.finditer(r"(.)\1*", text, re.DOTALL) if m.end() - m.start() >= least]


def _inside(at: int, q: int, runs: list[tuple[int, int]]) -> bool:
    return any(a < at + q and at < b for a, b in runs)


def _all_grams(text: str, q: int, runs: int | None) -> tuple[list, ...]:
    hidden = masked(text, runs)
    at = [i for i in range(len(text) - q + 1) if not (hidden and _inside(i, q, hidden))]
    return at, [text[i : i + q] for i in at]
