"""Plain models that the tests hold the search engine against."""


def edit_distance_ends(text: str, needle: str, k: int, anchored: bool = False) -> list[tuple[int, int]]:
    """(end, distance) by the textbook table, column by column."""
    column = list(range(len(needle) + 1))
    out = []
    for end, symbol in enumerate(text, 1):
        new = [end if anchored else 0]
        for i, x in enumerate(needle, 1):
            new.append(min(column[i - 1] + (x != symbol), column[i] + 1, new[i - 1] + 1))
        column = new
        if needle and column[-1] <= k:
            out.append((end, column[-1]))
    return out


def begins(text: str, needle: str) -> list[int]:
    return [i for i in range(len(text) - len(needle) + 1) if needle and text[i : i + len(needle)] == needle]
