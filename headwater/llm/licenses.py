"""License scans: an Aho-Corasick automaton finds identifier tags and notice phrases, a shunting-yard parser evaluates
and/or/with expressions of identifiers."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from . import common as c

#: Phrases (as words) of the base, and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Notice phrases of our own, and their labels.
NOTICES = {
    "mit license": "mit",
    "apache license": "apache",
    "bsd license": "bsd",
    "mozilla public license": "mpl",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "creative commons": "cc",
    "public domain": "public-domain",
    "isc license": "isc",
    "boost software license": "bsl",
    "cc by nc": "cc-by-nc",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc0": "cc0",
    "eclipse public license": "epl",
    "european union public licence": "eupl",
    "gnu free documentation license": "gfdl",
    "open font license": "ofl",
    "open database license": "odbl",
    "artistic license": "artistic",
    "zlib license": "zlib",
    "microsoft public license": "ms-pl",
    "common development and distribution license": "cddl",
    "the unlicense": "unlicense",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "permission is hereby granted free of charge to any person or organization obtaining a copy": "bsl",
    "permission to use copy modify and or distribute this software for any purpose": "isc",
    "redistribution and use in source and binary forms with or without modification": "bsd",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "this software is provided as is without any express or implied warranty": "zlib",
    "the person who associated a work with this deed has dedicated the work to the public domain": "cc0",
    "you are free to share copy and redistribute the material in any medium or format": "cc",
}
TAG = "spdx license identifier"
#: Openness of a label's terms, from 0 (all rights kept) to 1 (hardly a condition).
OPENNESS = {
    "public-domain": 1.0, "cc0": 1.0, "mit": 0.95, "isc": 0.95, "bsd": 0.95, "bsl": 0.95, "zlib": 0.95, "unlicense": 1.0, "apache": 0.9, "cc-by": 0.85, "cc": 0.6,
    "mpl": 0.7, "lgpl": 0.6, "cc-by-sa": 0.6, "gpl": 0.5, "agpl": 0.4, "ofl": 0.8, "epl": 0.7, "artistic": 0.7,
    "ms-pl": 0.7, "cddl": 0.7, "eupl": 0.5, "gfdl": 0.5, "odbl": 0.5, "cc-by-nd": 0.3, "cc-by-nc": 0.25, "reserved": 0.0,
}
#: An exception named after "with" eases the terms so much.
EASED = 0.1
TAG_LINE = re.compile(r"SPDX-License-Identifier[ \t]*:[ \t]*([A-Za-z0-9.+() \t-]+)", re.IGNORECASE | re.ASCII)
SYMBOL = re.compile(r"[()]|[A-Za-z0-9.+-]+")
RANK = {"or": 1, "and": 2, "with": 3}


def family(identifier: str) -> str:
    """The label of an SPDX identifier: its longest known prefix of dash-separated parts, else the identifier itself, in small letters."""
    parts = identifier.lower().rstrip("+").split("-")
    for n in range(len(parts), 0, -1):
        if (name := "-".join(parts[:n])) in OPENNESS:
            return name
    return identifier.lower()


def postfix(expression: str) -> list[str]:
    """Shunting-yard: operators after their operands; `with` binds closer than `and`, and that closer than `or`. Ends at the first symbol that fits no expression."""
    out: list[str] = []
    stack: list[str] = []
    operand = False
    for s in SYMBOL.findall(expression):
        op = s.lower()
        if op in RANK and operand:
            while stack and stack[-1] != "(" and RANK[stack[-1]] >= RANK[op]:
                out.append(stack.pop())
            stack.append(op)
            operand = False
        elif s == "(" and not operand:
            stack.append("(")
        elif s == ")" and operand and "(" in stack:
            while stack[-1] != "(":
                out.append(stack.pop())
            stack.pop()
        elif s not in "()" and op not in RANK and not operand:
            out.append(s)
            operand = True
        else:
            break
    return out + [x for x in reversed(stack) if x != "("] if operand or not stack else _trimmed(out, stack)


def _trimmed(out: list[str], stack: list[str]) -> list[str]:
    """The expression broke off after an operator: that operator goes."""
    rest = [x for x in stack if x != "("][:-1]
    return out + rest[::-1]


def evaluate(expression: str) -> tuple[set[str], float | None]:
    """(labels, openness): `or` lets one choose the opener terms, `and` binds to both, `with` eases the terms. None: nothing stated."""
    values: list[tuple[set[str], float]] = []
    for s in postfix(expression):
        if s in RANK:
            if len(values) < 2:
                continue
            (bl, bv), (al, av) = values.pop(), values.pop()
            values.append((al, min(1.0, av + EASED)) if s == "with" else (al | bl, (max if s == "or" else min)(av, bv)))
        else:
            label = family(s)
            values.append(({label}, OPENNESS.get(label, 0.5)))
    if not values:
        return set(), None
    return set().union(*(x for x, _ in values)), min(v for _, v in values)


def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for phrase in {*BASE, *NOTICES, TAG}:
        a.add_word(f" {phrase} ", phrase)
    a.make_automaton()
    return a


def scan_text(text: str | None, find) -> tuple:
    """(n_words, n_base, first_word, last_word, base_labels, labels, score) of one text."""
    w = c.words(text)
    line = f" {b' '.join(w).decode('utf-8', 'surrogatepass')} "
    first = last = None
    n_base = 0
    base: set[str] = set()
    extra: set[str] = set()
    tagged = False
    at, seen = 0, 0  # words counted so far: matches come by their ends
    for end, phrase in find(line):
        if phrase in BASE:
            start = end - len(phrase) - 1
            if start >= at:
                seen, at = seen + line.count(" ", at, start), start
                k = seen
            else:
                k = line.count(" ", 0, start)
            n_base += 1
            base.add(BASE[phrase])
            first, last = (k if first is None else min(first, k)), (k if last is None else max(last, k))
        elif phrase == TAG:
            tagged = True
        else:
            extra.add(NOTICES[phrase])
    scores = [OPENNESS[x] for x in base | extra]
    if tagged:
        for m in TAG_LINE.finditer(text):
            labels, value = evaluate(m[1])
            extra |= labels
            scores += [value] * (value is not None)
    return len(w), n_base, first, last, ",".join(sorted(base)), ",".join(sorted(base | extra)), min(scores, default=0.0)


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Places overlap freely: every place of a base phrase counts. The score is the openness of the strictest terms found, 0
    where none are stated. Null texts count as empty, null ids stay null, repeated rows give repeated results, other
    columns are not read; an empty table gives no rows. Each text is one pass, whatever its length. No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = c.kept("licences", automaton).iter
        types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
        for b in batches:
            rows = [scan_text(t, find) for t in b.column(1).to_pylist()]
            cols = list(zip(*rows, strict=True)) if rows else [()] * 7
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, t) for x, t in zip(cols, types, strict=True))], names=["id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    spec = f"id {docs.schema[id_col].dataType.simpleString()}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return c.map_arrow(docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")), run, spec).withColumnRenamed("id", id_col)
