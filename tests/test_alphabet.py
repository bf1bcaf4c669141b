import pytest
from pyspark.sql import functions as F

from strandsift.functions import alphabet as a


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "x string").select(expression(F.col("x"))).first()[0]


@pytest.mark.parametrize(
    ("text", "dna4", "dna5", "dna15"),
    [("acgtu", "ACGTT", "ACGTT", "ACGTT"), ("NRYKBx", "AACGCA", "NNNNNN", "NRYKBN"), ("ßé😀A\n", "AAAAA", "NNNAN", "NNNAN"), ("", "", "", ""), (None, None, None, None)],
)
def test_coercion(spark, text, dna4, dna5, dna15):
    assert [one(spark, text, f) for f in (a.to_dna4, a.to_dna5, a.to_dna15)] == [dna4, dna5, dna15]


def test_sizes():
    assert [(x.size, x.bits_per_value) for x in (a.DNA4, a.DNA5, a.DNA15)] == [(4, 2), (5, 3), (15, 4)]
    for x in a.ALPHABETS.values():
        assert list(x.symbols) == sorted(x.symbols)
        assert x.complements.translate(str.maketrans(x.symbols, x.complements)) == x.symbols


def test_complement(spark):
    assert one(spark, "ACGT", lambda x: a.complement(x, a.DNA4)) == "TGCA"
    assert one(spark, "AACGN", lambda x: a.reverse_complement(x, a.DNA5)) == "NCGTT"
    assert one(spark, "RKBDSWN", lambda x: a.complement(x, a.DNA15)) == "YMVHSWN"


def test_ranks(spark):
    for of in a.ALPHABETS.values():
        assert one(spark, of.symbols, lambda x, of=of: a.ranks(x, of)) == list(range(of.size))
        assert one(spark, of.symbols, lambda x, of=of: a.from_ranks(a.ranks(x, of), of)) == of.symbols
    assert one(spark, "G", lambda x: a.rank(x, a.DNA4)) == 2
    assert one(spark, "N", lambda x: a.rank(x, a.DNA4)) is None
    assert one(spark, "G", lambda x: a.from_rank(a.rank(x, a.DNA4) + 2, a.DNA4)) is None


def test_validity_and_conversion(spark):
    assert [one(spark, x, lambda c: a.is_valid(c, a.DNA4)) for x in ("acgTU", "ACGN", "AC\n", "")] == [True, False, False, True]
    assert one(spark, "ACGNT", lambda x: a.convert(x, a.DNA4)) == "ACGAT"
    assert one(spark, "x", lambda x: a.literal("acgu")) == "ACGT"
    assert one(spark, "a-cG t", lambda x: a.letters_only(x)) == "ACGT"


def test_other_alphabets(spark):
    """Any set of symbols: coercion, ranks and back, validity; and sets that are none are refused."""
    own = a.Alphabet("own", "-ABZ[]^", "-ABZ[]^", "^", "XY", "AB")
    df = spark.createDataFrame([("a-b^z[]xyé!",), ("",), (None,)], "t string")
    got = [r[0] for r in df.select(a.coerce("t", own)).collect()]
    assert got == ["A-B^Z[]AB^^", "", None]
    order = {x: i for i, x in enumerate(own.symbols)}
    assert df.select(a.ranks(a.coerce("t", own), own)).first()[0] == [order[x] for x in got[0]]
    assert df.select(a.from_ranks(a.ranks(a.coerce("t", own), own), own)).first()[0] == got[0]
    assert [r[0] for r in spark.createDataFrame([("AB-",), ("U",), ("ab]",)], "t string").select(a.is_valid(F.col("t"), own)).collect()] == [True, False, True]
    for bad in (("BA", "BA", "A"), ("AB", "A", "A"), ("AB", "AB", "C"), ("ab", "ab", "a")):
        with pytest.raises(ValueError):
            a.Alphabet("bad", *bad)
