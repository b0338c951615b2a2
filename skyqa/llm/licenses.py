"""Licence scan: one automaton over normalised words finds notices and tags; tag expressions are parsed."""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame

# Notice phrases (as words) and the label of each.
BASE_PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
# Further notices, which add labels of their own.
MORE_PHRASES = {
    "gnu general public license version 3": "gpl-3",
    "gnu general public license version 2": "gpl-2",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl-3",
    "mozilla public license": "mpl-2",
    "permission is hereby granted free of charge": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc by 4": "cc-by",
    "cc0 1": "cc0",
}
TAG = "spdx license identifier"
# Identifiers in expressions (lower case, without -only, -or-later or +) and their labels.
IDENTIFIERS = {
    "mit": "mit",
    "apache-2.0": "apache-2",
    "cc-by-nc-4.0": "cc-by-nc",
    "cc-by-sa-4.0": "cc-by-sa",
    "cc-by-nd-4.0": "cc-by-nd",
    "cc-by-4.0": "cc-by",
    "cc0-1.0": "cc0",
    "gpl-2.0": "gpl-2",
    "gpl-3.0": "gpl-3",
    "lgpl-2.1": "lgpl",
    "lgpl-3.0": "lgpl",
    "agpl-3.0": "agpl-3",
    "mpl-2.0": "mpl-2",
    "bsd-2-clause": "bsd",
    "bsd-3-clause": "bsd",
}
# How freely a text under the label may be used, 0 to 1.
FREEDOM = {
    "mit": 1.0,
    "apache-2": 1.0,
    "bsd": 1.0,
    "cc0": 1.0,
    "cc-by": 0.9,
    "mpl-2": 0.6,
    "cc-by-sa": 0.5,
    "lgpl": 0.5,
    "gpl-2": 0.3,
    "gpl-3": 0.3,
    "agpl-3": 0.2,
    "cc-by-nd": 0.1,
    "cc-by-nc": 0.1,
}
UNKNOWN = 0.5

_WORDS = bytearray(b" " * 256)
for _c in (*range(48, 58), *range(97, 123), *range(128, 256)):
    _WORDS[_c] = _c
for _c in range(65, 91):
    _WORDS[_c] = _c + 32
_WORDS = bytes(_WORDS)

_TAG_LINE = re.compile(r"spdx-license-identifier\s*:[ \t]*([^\r\n]*?)(?=spdx-license-identifier\s*:|[\r\n]|\Z)", re.IGNORECASE)
_PART = re.compile(r"[()]|[A-Za-z0-9.+:-]+|\S")
_RANK = {"or": 1, "and": 2, "with": 3}

SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def parse(expression: str) -> tuple[frozenset[str], float] | None:
    """Labels and freedom of a licence expression; None if it is not one.

    Operators are moved behind their operands with a stack (``with`` before ``and`` before ``or``) and then
    evaluated: ``or`` is as free as its freer side, ``and`` as its stricter one; an exception after
    ``with`` frees its licence by half of what is missing. Comment ends after the expression are left out. At a part that
    cannot continue it, the longest whole expression before that part counts; a full stop ends it as well.
    """
    parts = _PART.findall(re.split(r"\*/|-->", expression)[0])
    output: list[str] = []
    stack: list[str] = []
    operand_next = True
    whole: list[str] | None = None
    for part in parts:
        low = part.lower()
        if operand_next:
            if low == "(":
                stack.append("(")
                continue
            low = low.rstrip(".:")
            if low in _RANK or not re.fullmatch(r"[a-z0-9.+:-]+", low):
                break
            output.append(low)
            operand_next = False
            if len(low) < len(part) and "(" not in stack:
                return _evaluate([*output, *reversed(stack)])
        elif low in _RANK:
            while stack and stack[-1] != "(" and _RANK[stack[-1]] >= _RANK[low]:
                output.append(stack.pop())
            stack.append(low)
            operand_next = True
        elif low == ")":
            while stack and stack[-1] != "(":
                output.append(stack.pop())
            if not stack:
                break
            stack.pop()
        else:
            break
        if not operand_next and "(" not in stack:
            whole = [*output, *reversed(stack)]
    else:
        return None if operand_next or "(" in stack else _evaluate([*output, *reversed(stack)])
    return _evaluate(whole) if whole else None


def _evaluate(postfix: list[str]) -> tuple[frozenset[str], float]:
    values: list[tuple[frozenset[str], float]] = []
    for part in postfix:
        if part not in _RANK:
            name = re.sub(r"(-only|-or-later|\+)$", "", part)
            label = IDENTIFIERS.get(name, name)
            values.append((frozenset([label]), FREEDOM.get(label, UNKNOWN)))
            continue
        right, left = values.pop(), values.pop()
        if part == "with":
            values.append((left[0], left[1] + (1 - left[1]) / 2))
        else:
            values.append((left[0] | right[0], (max if part == "or" else min)(left[1], right[1])))
    return values[0]


def scan(
    docs: DataFrame, base: Mapping[str, str] = BASE_PHRASES, more: Mapping[str, str] = MORE_PHRASES
) -> DataFrame:
    """One row per row of ``docs(doc_id, text)`` with what its licence notices say.

    A place is a start of a base phrase among the words. ``score`` is the freedom of the strictest notice or
    expression, 0.5 without any. NULL text counts as empty; other columns are ignored.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        machine = ahocorasick.Automaton()
        for phrase in {**more, **base, TAG: None}:
            machine.add_word(f" {phrase} ", (len(phrase) + 2, phrase))
        machine.make_automaton()
        for batch in batches:
            rows = [_one(machine, text, base, more) for text in batch.column(1).to_pylist()]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), *arrays], [c.split()[0] for c in SCHEMA.split(", ")]
            )

    return docs.select("doc_id", "text").mapInArrow(find, SCHEMA)


def _one(machine, text, base, more):
    words = (text or "").encode().translate(_WORDS).split()
    line = " " + b" ".join(words).decode("latin-1") + " "
    places: list[int] = []
    labels: set[str] = set()
    base_labels: set[str] = set()
    grades: list[float] = []
    tagged = False
    for end, (size, phrase) in machine.iter(line):
        if phrase in base:
            places.append(line.count(" ", 0, end - size + 1))
            base_labels.add(base[phrase])
        elif phrase == TAG:
            tagged = True
        else:
            labels.add(more[phrase])
    grades += [FREEDOM.get(label, UNKNOWN) for label in base_labels | labels]
    if tagged:
        for expression in _TAG_LINE.findall(text):
            if found := parse(expression):
                labels |= found[0]
                grades.append(found[1])
    first, last = (min(places), max(places)) if places else (None, None)
    return (
        len(words),
        len(places),
        first,
        last,
        ",".join(sorted(base_labels)),
        ",".join(sorted(base_labels | labels)),
        min(grades, default=UNKNOWN),
    )
