"""Licence scans: Aho-Corasick over words for notice phrases and identifier tags, a shunting-yard parser for licence expressions.

A text's words are runs of letters, digits and non-ASCII characters, A-Z in lower case. One automaton finds all phrases, as whole words. The phrases
of BASE give the base labels; those of NOTICES add labels. Where it finds the words of an SPDX tag, the expression behind the tag is parsed:
`with` binds tighter than `and`, `and` tighter than `or`. Its identifiers add labels; its value is how freely the text may be used: the least of
both sides of `and`, the most of both sides of `or`. The score is the least value of all that a text holds, 0 if it holds none.

Scale: one pass without shuffles, each text on its own, whatever its length.

A null or empty text has no words. An expression that isn't well formed adds nothing from where it breaks; one whose brackets never close adds what
stands before the outermost of them. Long texts are scanned whole. Ties: of places and labels that are equal, each place counts and a label shows once.
Every row gives a row, also repeated ones; an empty table gives none. Further columns aren't read, whatever their names.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandsift.llm.common import binary_list, small_batches
from strandsift.plans.planner import spread

BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "licensed under the apache license": "apache-2",
    "gnu general public license version 2": "gpl-2",
    "gnu general public license version 3": "gpl-3",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license version 2": "mpl-2",
    "bsd 2 clause": "bsd-2-clause",
    "bsd 3 clause": "bsd-3-clause",
    "redistribution and use in source and binary forms": "bsd",
    "cc by sa": "cc-by-sa",
    "cc by 4 0": "cc-by",
    "cc0 1 0": "cc0",
    "creative commons attribution noncommercial": "cc-by-nc",
    "all rights reserved": "proprietary",
}
TAG = "spdx license identifier"
#: How freely a text under a label may be used. Labels that aren't here count as OTHER.
VALUE = {"mit": 1.0, "apache-2": 1.0, "bsd": 1.0, "bsd-2-clause": 1.0, "bsd-3-clause": 1.0, "isc": 1.0, "cc0": 1.0, "cc-by": 0.9, "mpl-2": 0.7, "lgpl": 0.6, "cc-by-sa": 0.6, "gpl-2": 0.5, "gpl-3": 0.5, "agpl": 0.4, "cc-by-nc": 0.2, "proprietary": 0.0}
OTHER = 0.3

_WORDS = bytes(x + 32 if 65 <= x <= 90 else x if x >= 128 or 48 <= x <= 57 or 97 <= x <= 122 else 32 for x in range(256))
_RAW_TAG = re.compile(r"spdx-license-identifier:[ \t]*([^\r\n]*)", re.IGNORECASE | re.ASCII)
_WORD = r"(\(|\)|[A-Za-z0-9.+:-]+)"
_TOKEN = re.compile(rf"[^\S\r\n]*{_WORD}")
#: Inside brackets: also behind line ends and the comment marks that follow them.
_WRAPPED = re.compile(rf"(?:[^\S\r\n]*[\r\n]\s*(?:#+|//+|/?\*+(?!/)|--+|;+|%+|!+|dnl\b|rem\b)?)?\s*{_WORD}", re.IGNORECASE)
_BINDS = {"or": 1, "and": 2, "with": 3}


@functools.cache
def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for kind, phrases in (("notice", NOTICES), ("base", BASE), ("tag", {TAG: ""})):
        for phrase, label in phrases.items():
            found.add_word(f" {phrase} ", (kind, label, len(phrase) + 2, phrase.count(" ") + 1))
    found.make_automaton()
    return found


def label_of(identifier: str) -> str:
    """The label of an SPDX identifier: lower case, without a trailing .0, `-only`, `-or-later` or `+`."""
    x = re.sub(r"(-only|-or-later|\+)$", "", identifier.lower())
    x = re.sub(r"\.0$", "", x)
    return re.sub(r"^(cc0|cc-by(?:-nc|-sa|-nd)*)-\d.*$|^(lgpl|agpl)-\d.*$", lambda m: m[1] or m[2], x)


def to_postfix(text: str, at: int = 0) -> list[str] | None:
    """Shunting-yard: the expression at a place of text in postfix order, as far as it is well formed; None if there is none.

    It ends with its line, but goes on over line ends while brackets are open. Of one whose brackets never close, what stands before the outermost counts.
    """
    out: list[str] = []
    stack: list[str] = []
    operand, before = True, ([], [])
    while m := (_WRAPPED if "(" in stack else _TOKEN).match(text, at):
        token, word = m[1], m[1].lower()
        if _RAW_TAG.match(text, m.start(1)):
            break
        if operand:
            if token == "(":
                if "(" not in stack:
                    before = out[:], stack[:]
                stack.append(token)
            elif token == ")" or word in _BINDS:
                break
            else:
                name = token.rstrip(".:")
                if not name:
                    break
                out.append(name)
                operand = False
        elif word in _BINDS:
            while stack and stack[-1] != "(" and _BINDS[stack[-1]] >= _BINDS[word]:
                out.append(stack.pop())
            stack.append(word)
            operand = True
        elif token == ")" and "(" in stack:
            while stack[-1] != "(":
                out.append(stack.pop())
            stack.pop()
        else:
            break
        at = m.end()
    if "(" in stack:
        (out, stack), operand = before, True
    if not out:
        return None
    if operand:  # an operator without its right side, the last that was read
        stack.pop()
    return out + stack[::-1]


def evaluate(postfix: list[str]) -> tuple[set[str], float, str]:
    """Labels, value, and the expression with all its brackets."""
    stack: list[tuple[set[str], float, str]] = []
    for x in postfix:
        if x not in _BINDS:
            label = label_of(x)
            stack.append(({label}, VALUE.get(label, OTHER), label))
            continue
        (b, vb, tb), (a, va, ta) = stack.pop(), stack.pop()
        text = f"({ta} {x} {tb})"
        stack.append((a, va, text) if x == "with" else (a | b, min(va, vb), text) if x == "and" else (a | b, max(va, vb), text))
    return stack[-1]


def scan(text: bytes | None) -> dict:
    """What a text in UTF-8 holds; spans: (label, first word, words) of base phrases and notices."""
    words = (text or b"").translate(_WORDS).split()
    joined = f" {b' '.join(words).decode()} "
    base, labels, values, spans, expressions, tagged = set(), set(), [], [], [], False
    n_base, first, last, seen, upto = 0, None, None, 0, 0
    hits = sorted((end - x[2] + 1, x) for end, x in _automaton().iter(joined))
    for start, (kind, label, _, size) in hits:
        upto += joined.count(" ", seen, start)
        seen = start
        if kind == "tag":
            tagged = True
            continue
        labels.add(label)
        values.append(VALUE[label])
        spans.append((label, upto, size))
        if kind == "base":
            base.add(label)
            n_base, first, last = n_base + 1, upto if first is None else first, upto
    if tagged:
        for m in _RAW_TAG.finditer(text.decode()):
            if postfix := to_postfix(m.string, m.start(1)):
                found, value, shown = evaluate(postfix)
                labels |= found
                values.append(value)
                expressions.append(shown)
    return {"n_words": len(words), "n_base": n_base, "first_word": first, "last_word": last, "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(labels)), "score": min(values, default=0.0), "spans": [dict(zip(("label", "first", "words"), x, strict=True)) for x in spans], "expressions": expressions}


SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label: string, first: bigint, words: bigint>>, expressions array<string>"
_ARROW = pa.schema(
    [(x, pa.int64()) for x in ("n_words", "n_base", "first_word", "last_word")] + [("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())]
    + [("spans", pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("words", pa.int64())]))), ("expressions", pa.list_(pa.string()))]
)


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and SCHEMA for every row of docs."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.RecordBatch.from_pylist([scan(x) for x in binary_list(batch, text_col)], schema=_ARROW)
            yield pa.RecordBatch.from_arrays([batch.column(0), *found.columns], names=[id_col, *found.schema.names])

    schema = T.StructType([docs.schema[id_col], *T._parse_datatype_string(SCHEMA).fields])
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", F.array_join("expressions", " ").alias("expressions"))


def _places(phrase: str) -> str:
    words = phrase.split()
    found = f"list_filter(range(len(ws)), lambda i: ws[i + 1 : i + {len(words)}] = [{', '.join(f"'{x}'" for x in words)}])"
    return f"CASE WHEN contains(' ' || array_to_string(ws, ' ') || ' ', ' {phrase} ') THEN {found} ELSE [] END"


def _held(phrases: dict[str, str]) -> str:
    """SQL: the labels of phrases that joined words hold, with null for the others."""
    return "[" + ", ".join(f"CASE WHEN contains(joined, ' {phrase} ') THEN '{label}' END" for phrase, label in phrases.items()) + "]"


_LABELS = "coalesce(array_to_string(list_sort(list_distinct(list_filter({0}, lambda x: x IS NOT NULL))), ','), '')"
#: For texts without SPDX tags: SQL has no parser for their expressions; tests cover those.
OP5_SQL = f"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
p AS (SELECT doc_id, ws, ' ' || array_to_string(ws, ' ') || ' ' AS joined, list_concat({_places(list(BASE)[0])}, list_concat({_places(list(BASE)[1])}, {_places(list(BASE)[2])})) AS base FROM w),
h AS (SELECT *, {_held(BASE)} AS own, {_held(NOTICES)} AS more FROM p)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(base) AS BIGINT) AS n_base, CAST(list_min(base) AS BIGINT) AS first_word, CAST(list_max(base) AS BIGINT) AS last_word,
  {_LABELS.format("own")} AS base_labels, {_LABELS.format("list_concat(own, more)")} AS labels,
  coalesce(list_min(list_transform(list_filter(list_concat(own, more), lambda x: x IS NOT NULL), lambda x: CASE x {" ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in VALUE.items())} END)), 0) AS score, '' AS expressions
FROM h
"""
