import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strandsift.llm import licenses


def plain_base(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    places, labels = [], set()
    for phrase, label in licenses.BASE.items():
        own = phrase.split()
        for i in range(len(words) - len(own) + 1):
            if words[i : i + len(own)] == own:
                places.append(i)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


PARTS = ["under the MIT license", "Apache License, Version 2.0", "CC BY-NC", "cc by", "nc", "the", "MIT", "é", "İ", "\x85", "version-2", "Kcc", ".", "\n", "under", "SPDX-License-Identifier: MIT"]


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=40), st.lists(st.sampled_from(PARTS), max_size=14).map(" ".join), st.lists(st.sampled_from(PARTS), max_size=14).map("".join)))
def test_base(text):
    found = licenses.scan(text.encode())
    assert tuple(found[x] for x in ("n_words", "n_base", "first_word", "last_word", "base_labels")) == plain_base(text)
    assert set(filter(None, found["base_labels"].split(","))) <= set(found["labels"].split(","))
    assert 0 <= found["score"] <= 1


@pytest.mark.parametrize(
    ("text", "shown", "labels", "score"),
    [
        ("MIT", "mit", {"mit"}, 1.0),
        ("MIT OR Apache-2.0", "(mit or apache-2)", {"mit", "apache-2"}, 1.0),
        ("GPL-2.0-only WITH Classpath-exception-2.0 OR MIT AND CC-BY-NC-4.0", "((gpl-2 with classpath-exception-2) or (mit and cc-by-nc))", {"gpl-2", "mit", "cc-by-nc"}, 0.5),
        ("(MIT OR Apache-2.0) AND CC-BY-NC-4.0", "((mit or apache-2) and cc-by-nc)", {"mit", "apache-2", "cc-by-nc"}, 0.2),
        ("mit and isc or bsd-3-clause", "((mit and isc) or bsd-3-clause)", {"mit", "isc", "bsd-3-clause"}, 1.0),
        ("MIT. All else is text", "mit", {"mit"}, 1.0),
        ("MIT OR", "mit", {"mit"}, 1.0),
        ("GPL-3.0+ */", "gpl-3", {"gpl-3"}, 0.5),
        ("LGPL-2.1-or-later", "lgpl", {"lgpl"}, 0.6),
    ],
)
def test_expressions(text, shown, labels, score):
    found, value, printed = licenses.evaluate(licenses.to_postfix(text))
    assert (printed, found, value) == (shown, labels, score)
    whole = licenses.scan(f"x\n# SPDX-License-Identifier: {text}\nmore".encode())
    assert whole["expressions"] == [shown]


@pytest.mark.parametrize("text", ["", "(MIT OR ISC", "AND MIT", ")", "()", "."])
def test_no_expression(text):
    assert licenses.to_postfix(text) is None
    assert licenses.scan(f"SPDX-License-Identifier: {text}".encode())["labels"] == ""


def test_table(spark):
    text = "Released under the MIT License. " * 3 + "GNU General Public License, version 3. SPDX-License-Identifier: CC0-1.0"
    rows = [(1, text), (2, None), (3, ""), (None, "cc by nc"), (1, text), (4, "a " * 100_000 + "cc by nc")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, labels string, n_words int")
    found = licenses.scan_licenses(df).collect()
    expected = Counter((i, *plain_base(t)) for i, t in rows)
    assert Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in found) == expected
    first = next(r for r in found if r.doc_id == 1)
    assert first.labels == "cc0,gpl-3,mit"
    assert first.score == 0.5
    assert [(s.label, s.first) for s in first.spans if s.label == "mit"] == [("mit", 1), ("mit", 6), ("mit", 11)]
    assert licenses.scan_licenses(df.where("false")).count() == 0


def test_brackets_over_lines():
    """An expression goes on over line ends while brackets are open; a bracket that never closes takes no other tag with it."""
    for between in ("\n", "\r\n", "\n# ", "\n * ", "\n// ", "\n-- ", "\n\n  "):
        found = licenses.scan(f"# SPDX-License-Identifier: (MIT OR{between}Apache-2.0) AND{between}GPL-2.0-only".encode())
        assert (found["labels"], found["expressions"]) == ("apache-2,mit", ["(mit or apache-2)"])
    assert licenses.scan(b"SPDX-License-Identifier: (MIT OR\nSPDX-License-Identifier: ISC")["expressions"] == ["isc"]
    assert licenses.scan(b"SPDX-License-Identifier: MIT\nAND ISC")["expressions"] == ["mit"]


def test_brackets_that_never_close():
    """What stands before the outermost open bracket counts."""
    for text, labels in (("MIT OR (GPL-2.0-only AND", "mit"), ("MIT AND ISC OR (GPL-2.0-only AND (ISC", "isc,mit"), ("(MIT OR (ISC)", ""), ("(MIT) AND (ISC", "mit"), ("MIT WITH (", "mit")):
        assert licenses.scan(f"SPDX-License-Identifier: {text}".encode())["labels"] == labels
