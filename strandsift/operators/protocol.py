"""What a matcher offers, as functions that work on any object with the right methods, and protocols to check against."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from dataclasses import fields as dataclass_fields
from typing import Any, Protocol, runtime_checkable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@runtime_checkable
class WindowMatcher(Protocol):
    def window_size(self) -> int: ...


@runtime_checkable
class OnlineMatcher(Protocol):
    def find(self, haystacks: DataFrame, id_col: str = ..., seq_col: str = ...) -> DataFrame: ...


@runtime_checkable
class StatefulMatcher(Protocol):
    def capture(self) -> Any: ...


@runtime_checkable
class RestorableMatcher(StatefulMatcher, Protocol):
    def restore(self, state: Any) -> None: ...


@runtime_checkable
class ReducibleState(Protocol):
    def aggregate(self, other: Any) -> Any: ...


def window_size(matcher: WindowMatcher) -> int:
    """The most symbols of a haystack that one match can cover."""
    return matcher.window_size()


def capture(matcher: StatefulMatcher) -> Any:
    """A copy of the matcher's state."""
    return matcher.capture()


def restore(matcher: RestorableMatcher, state: Any) -> None:
    """Goes on from a state. It always holds, also before the first search."""
    matcher.restore(state)


def aggregate(left: ReducibleState, right: ReducibleState) -> Any:
    """Two states as one. States of a search can't be: the second depends on where the first ended. Counts can."""
    return left.aggregate(right)


def set_up(matcher: Any) -> None:
    """Called in a task before its first search, if the matcher has such a method."""
    getattr(matcher, "set_up", lambda: None)()


def tear_down(matcher: Any) -> None:
    """Called in a task behind its last search, also if that fails."""
    getattr(matcher, "tear_down", lambda: None)()


@dataclass(frozen=True)
class HitCount:
    """Hits and symbols searched: a state that can be merged."""

    hits: int = 0
    symbols: int = 0

    def aggregate(self, other: HitCount) -> HitCount:
        return HitCount(self.hits + other.hits, self.symbols + other.symbols)

    @staticmethod
    def table(haystacks: DataFrame, hits: DataFrame, id_col: str = "haystack_id", seq_col: str = "seq") -> DataFrame:
        """A table of states (id_col, hits, symbols): one row for each sequence and one for each hit, to be merged."""
        own = haystacks.select(id_col, F.lit(0).cast("long").alias("hits"), F.coalesce(F.length(seq_col), F.lit(0)).cast("long").alias("symbols"))
        return own.unionByName(hits.select(id_col, F.lit(1).cast("long").alias("hits"), F.lit(0).cast("long").alias("symbols")))


def merge_states(states: DataFrame, keys: list[str], like: type = HitCount) -> DataFrame:
    """aggregate() over tables of states: those that agree in keys as one. like: a state whose fields, columns here, add up."""
    names = [f.name for f in dataclass_fields(like)]
    return states.groupBy(*keys).agg(*[F.sum(x).alias(x) for x in names])


def merge_any(states: DataFrame, keys: list[str], like: type) -> DataFrame:
    """The same for states of any kind, by their own aggregate(). Merged inside tasks, then by key: a hot key's rows are merged before they are shuffled.

    aggregate() must not care for order. A task holds one state for each of its keys.
    """
    names = [f.name for f in dataclass_fields(like)]

    def merged(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, Any] = {}
        for part in parts:
            own = zip(*(part[k].astype(object).where(part[k].notna(), None).tolist() for k in keys), strict=True) if keys else [()] * len(part)
            for key, values in zip(own, zip(*(part[x].tolist() for x in names), strict=True), strict=True):
                state = like(*values)
                held[key] = state if key not in held else held[key].aggregate(state)
        yield pd.DataFrame([(*k, *(getattr(v, x) for x in names)) for k, v in held.items()], columns=[*keys, *names])

    states = states.select(*keys, *names)
    once = states.mapInPandas(merged, states.schema)
    return (once.repartition(*keys) if keys else once.coalesce(1)).mapInPandas(merged, states.schema)
