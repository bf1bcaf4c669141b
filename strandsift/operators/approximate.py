"""Many needles at once, exactly or within k edits: seeds find candidate windows, the bit-parallel matcher verifies them.

Needles are a short list of (id, text), a parameter held by every task, or a table of any size (see needles).
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from strandsift.operators import kernels
from strandsift.operators.needles import NeedleTable, automaton, places, read_part
from strandsift.plans import planner

FIELDS = [("end_pos", T.LongType()), ("needle_id", T.LongType()), ("distance", T.IntegerType())]
Needles = list[tuple[int, str]] | DataFrame


def _verify(text: str, needle: str, k: int, windows: list[tuple[int, int]]) -> dict[int, int]:
    """Ends and distances inside windows, which are merged where they meet."""
    found: dict[int, int] = {}
    merged: list[list[int]] = []
    for a, b in sorted((max(0, a), min(len(text), b)) for a, b in windows):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    for a, b in merged:
        ends, distances, _ = kernels.edit_ends(text[a:b], needle, k, kernels.first_edit_state(needle))
        for end, distance in zip(ends, distances, strict=True):
            found[a + end] = min(distance, found.get(a + end, distance))
    return found


class Seeded:
    """All needles (id, text) within k edits of any part of a text; the same hits as of a full scan.

    Of k + 1 disjoint pieces of a needle, a match leaves one intact: the piece at offset o, found at i, puts a match's beginning between i - o - k and
    i - o + k, and its end not behind i - o + m + k. Needles whose pieces would be shorter than 3 are looked for everywhere.
    """

    def __init__(self, needles: list[tuple[int, str]], k: int) -> None:
        self.needles, self.k, self.whole = needles, k, []
        self.postings: dict[str, list[tuple[int, int]]] = {}
        for place, (_, needle) in enumerate(needles):
            q = len(needle) // (k + 1)
            if q < 3:
                self.whole += [place] * bool(needle)
                continue
            for i in range(k + 1):
                self.postings.setdefault(needle[i * q : (i + 1) * q], []).append((place, i * q))
        self.finder = automaton(self.postings)

    def __call__(self, text: str) -> tuple[list[int], list[int], list[int]]:
        """(ends, needle ids, distances)."""
        k, needles = self.k, self.needles
        windows: dict[int, list[tuple[int, int]]] = {i: [(0, len(text))] for i in self.whole}
        for begin, word in places(self.finder, text):
            for place, offset in self.postings[word]:
                windows.setdefault(place, []).append((begin - offset - k, begin - offset + len(needles[place][1]) + k))
        out: tuple[list[int], list[int], list[int]] = ([], [], [])
        for place in sorted(windows):
            own, needle = needles[place]
            for end, distance in sorted(_verify(text, needle, k, windows[place]).items()):
                out[0].append(end)
                out[1].append(own)
                out[2].append(distance)
        return out


class Exact:
    """All needles (id, text) as they stand."""

    def __init__(self, needles: list[tuple[int, str]]) -> None:
        self.ids: dict[str, list[int]] = {}
        for i, x in needles:
            if x:
                self.ids.setdefault(x, []).append(i)
        self.finder = automaton(self.ids)

    def __call__(self, text: str) -> tuple[list[int], list[int]]:
        """(begins, needle ids)."""
        hits = [(begin, i) for begin, word in places(self.finder, text) for i in self.ids[word]]
        return [x for x, _ in hits], [i for _, i in hits]


class Late:
    """A searcher that is made at its first text, and not sent before: once for each task."""

    def __init__(self, make: Callable[[], Callable[[str], tuple]]) -> None:
        self.make, self.made = make, None

    def __getstate__(self) -> dict:
        return {"make": self.make, "made": None}

    def __call__(self, text: str) -> tuple:
        if self.made is None:
            self.made = self.make()
        return self.made(text)


@functools.lru_cache(2)
def part_searcher(kind: type, path: str, *more) -> Callable[[str], tuple]:
    """Once for each worker."""
    return kind(read_part(path), *more)


@functools.lru_cache(8)
def _seeded(needles: tuple[tuple[int, str], ...], k: int) -> Seeded:
    return Seeded(list(needles), k)


def approximate_hits(text: str, needles: tuple[tuple[int, str], ...], k: int) -> tuple[list[int], list[int], list[int]]:
    """(ends, needle ids, distances) of a few needles in one text."""
    return _seeded(needles, k)(text)


def _find(haystacks: DataFrame, needles: Needles, kind: type, more: tuple, fields: list, reach: int, ends: bool, id_col: str, seq_col: str, needle_id: str, needle: str, deal: int) -> DataFrame:
    if isinstance(needles, DataFrame):
        table = NeedleTable(needles, needle_id, needle)
        return table.each(lambda path: planner.scan(haystacks, id_col, seq_col, None, functools.partial(_in_part, kind, path, *more), fields, table.longest + reach, ends=ends, deal=deal))
    fixed = [(int(i), x) for i, x in needles]
    return planner.scan(haystacks, id_col, seq_col, None, Late(functools.partial(kind, fixed, *more)), fields, max((len(x) for _, x in fixed), default=0) + reach, ends=ends, deal=deal)


def _in_part(kind: type, path: str, *args) -> tuple:
    *more, text = args
    return part_searcher(kind, path, *more)(text)


def find_approximate(haystacks: DataFrame, needles: Needles, k: int, id_col: str = "haystack_id", seq_col: str = "seq", needle_id: str = "needle_id", needle: str = "needle", deal: int = 0) -> DataFrame:
    """(id_col, end_pos, needle_id, distance): all ends of all needles within k edits. needle_id, needle: columns of needles that come as a table."""
    return _find(haystacks, needles, Seeded, (k,), FIELDS, k, True, id_col, seq_col, needle_id, needle, deal)


def find_exact(haystacks: DataFrame, needles: Needles, id_col: str = "haystack_id", seq_col: str = "seq", needle_id: str = "needle_id", needle: str = "needle", deal: int = 0) -> DataFrame:
    """(id_col, begin_pos, needle_id): all occurrences of all needles, in one pass for the whole set (of a table: for each part)."""
    return _find(haystacks, needles, Exact, (), [("begin_pos", T.LongType()), ("needle_id", T.LongType())], 0, False, id_col, seq_col, needle_id, needle, deal)
