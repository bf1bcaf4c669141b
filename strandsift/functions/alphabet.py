"""Nucleotide alphabets as string columns: coercion, ranks, conversion, complement, validity.

A symbol is one character and a sequence a string of symbols. Ranks are alphabetical, so comparing strings compares ranks. Everything is
a built-in expression; null gives null.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Alphabet:
    """Symbols in rank order; complements, symbol by symbol; the symbol for characters that are none; characters that count as symbols, and as which.

    Others than those here can be made: symbols are printable ASCII characters in alphabetical order, without lower case.
    """

    name: str
    symbols: str
    complements: str
    unknown: str
    others: str = ""
    count_as: str = ""

    def __post_init__(self) -> None:
        if list(self.symbols) != sorted(set(self.symbols)) or self.symbols != self.symbols.upper() or not (self.symbols.isascii() and self.symbols.isprintable()):
            raise ValueError("symbols are printable ASCII characters in alphabetical order, without lower case")
        if len(self.complements) != len(self.symbols) or len(self.others) != len(self.count_as) or not {*self.complements, *self.count_as, self.unknown} <= {*self.symbols}:
            raise ValueError("complements, the unknown symbol and what others count as are symbols, one for each")

    @property
    def pattern(self) -> str:
        """The symbols inside a bracket expression."""
        return "".join("\\" + x if x in "\\]^-[&~" else x for x in self.symbols)

    @property
    def size(self) -> int:
        return len(self.symbols)

    @property
    def bits_per_value(self) -> int:
        return (self.size - 1).bit_length()


# What each ambiguous symbol becomes in dna4, its first option.
AMBIGUOUS, FIRST_OPTION = "RWMDHVYSBK", "AAAAAACCCG"
# Fixed values of the public nucleotide alphabets.
DNA4 = Alphabet("dna4", "ACGT", "TGCA", "A", "U" + AMBIGUOUS, "T" + FIRST_OPTION)
DNA5 = Alphabet("dna5", "ACGNT", "TGCNA", "N", "U", "T")
DNA15 = Alphabet("dna15", "ABCDGHKMNRSTVWY", "TVGHCDMKNYSABWR", "N", "U", "T")
ALPHABETS = {x.name: x for x in (DNA4, DNA5, DNA15)}


def coerce(column: Column | str, to: Alphabet) -> Column:
    """Any text as symbols: never fails, keeps the length. Lower case counts as upper, others as the alphabet has them (U as T), anything else as its unknown symbol."""
    text = F.col(column) if isinstance(column, str) else column
    plain = F.upper(F.regexp_replace(text, "[^ -~]", "\x7f"))  # else upper() may change the length
    return F.regexp_replace(F.translate(plain, to.others, to.count_as) if to.others else plain, f"[^{to.pattern}]", to.unknown.replace("\\", "\\\\").replace("$", "\\$"))


def to_dna4(column: Column | str) -> Column:
    return coerce(column, DNA4)


def to_dna5(column: Column | str) -> Column:
    return coerce(column, DNA5)


def to_dna15(column: Column | str) -> Column:
    return coerce(column, DNA15)


def literal(text: str, of: Alphabet = DNA4) -> Column:
    return coerce(F.lit(text), of)


def convert(column: Column, to: Alphabet) -> Column:
    """Symbols of one alphabet as those of another."""
    return coerce(column, to)


def rank(symbol: Column, of: Alphabet) -> Column:
    """A symbol's rank; null if it isn't in the alphabet."""
    return F.when(F.length(symbol) == 1, F.nullif(F.instr(F.lit(of.symbols), symbol), F.lit(0)) - 1)


def ranks(sequence: Column, of: Alphabet) -> Column:
    """All symbols' ranks, as an array."""
    digits = "".join(chr(0x100 + i) for i in range(of.size))
    return F.transform(F.filter(F.split(F.translate(sequence, of.symbols, digits), ""), lambda x: x != ""), lambda x: F.ascii(x) - 0x100)


def from_rank(value: Column, of: Alphabet) -> Column:
    """The symbol of a rank; null if there is none."""
    return F.when((value >= 0) & (value < of.size), F.substring(F.lit(of.symbols), (value + 1).cast("int"), F.lit(1)))


def from_ranks(values: Column, of: Alphabet) -> Column:
    return F.array_join(F.transform(values, lambda x: from_rank(x, of)), "")


def complement(sequence: Column, of: Alphabet) -> Column:
    return F.translate(sequence, of.symbols, of.complements)


def reverse_complement(sequence: Column, of: Alphabet) -> Column:
    return F.reverse(complement(sequence, of))


def is_valid(text: Column, of: Alphabet) -> Column:
    """Whether every character is one of the alphabet's without coercion, in either case; U counts as T where T is a symbol."""
    return text.rlike(f"^(?i)[{of.pattern}{'U' if 'T' in of.symbols else ''}]*\\z")


def letters_only(text: Column, of: Alphabet = DNA4) -> Column:
    """The alphabet's letters in a text, in upper case, without all else."""
    return F.upper(F.regexp_replace(text, f"[^{of.symbols}{of.symbols.lower()}]", ""))
