"""What runs on one sequence: exact search, and bit-parallel searches whose state can be taken out and put back.

Positions count characters from 0. Python's integers are as long as the needle, so there is one code for needles of any length.
"""

from __future__ import annotations

from dataclasses import dataclass, replace


def exact_begins(text: str, needle: str) -> list[int]:
    """All occurrences, also those that overlap; none of an empty needle."""
    out: list[int] = []
    at = text.find(needle) if needle else -1
    while at >= 0:
        out.append(at)
        at = text.find(needle, at + 1)
    return out


def symbol_masks(needle: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for i, symbol in enumerate(needle):
        masks[symbol] = masks.get(symbol, 0) | 1 << i
    return masks


@dataclass(frozen=True)
class PrefixState:
    """Bit i: the last i + 1 symbols are the needle's first i + 1."""

    open: int = 0


def exact_ends(text: str, needle: str, state: PrefixState) -> tuple[list[int], PrefixState]:
    """Ends of occurrences, counted in this text, that may have begun in an earlier one; the state behind it."""
    masks, last, bits, out = symbol_masks(needle), 1 << len(needle) >> 1, state.open, []
    for i, symbol in enumerate(text):
        bits = (bits << 1 | 1) & masks.get(symbol, 0)
        if bits & last:
            out.append(i + 1)
    return out, PrefixState(bits)


@dataclass(frozen=True)
class EditState:
    """A column of the edit-distance table as differences down the needle (rises and falls), its last value, and the symbols seen."""

    rises: int
    falls: int
    score: int
    seen: int = 0


def first_edit_state(needle: str) -> EditState:
    return EditState((1 << len(needle)) - 1, 0, len(needle))


def edit_ends(text: str, needle: str, k: int, state: EditState, anchored: bool = False) -> tuple[list[int], list[int], EditState]:
    """Ends in this text at which the needle ends within k edits, their distances, and the state behind it.

    anchored: the match begins where the whole sequence began; else anywhere. The distances are the least over all beginnings.
    """
    if not needle:
        return [], [], replace(state, seen=state.seen + len(text))
    masks, full, last = symbol_masks(needle), (1 << len(needle)) - 1, 1 << (len(needle) - 1)
    up, down, score, step = state.rises, state.falls, state.score, int(anchored)
    reach = max(0, min(len(text), len(needle) + k - state.seen)) if anchored else len(text)
    ends, distances = [], []
    for i in range(reach):
        same = masks.get(text[i], 0)
        diagonal = (((same & up) + up) ^ up) | same | down
        right_up = down | ~(diagonal | up) & full
        right_down = up & diagonal
        if right_up & last:
            score += 1
        elif right_down & last:
            score -= 1
        right_up = (right_up << 1 | step) & full
        right_down = right_down << 1 & full
        up = right_down | ~(diagonal | right_up) & full
        down = right_up & diagonal
        if score <= k:
            ends.append(i + 1)
            distances.append(score)
    return ends, distances, EditState(up, down, score, state.seen + len(text))
