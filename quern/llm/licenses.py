"""Operator 10, licence scans: an Aho-Corasick automaton finds notice phrases and identifier tags; tagged expressions are parsed.

Phrases are matched as whole words over the text's words joined by single spaces,
in one pass for all of them. Behind an ``SPDX-License-Identifier:`` tag stands an
expression of identifiers with ``and``, ``or``, ``with`` and brackets; a shunting-yard
parser turns it into postfix form, and one pass over that collects the licences it names and says
whether permissive ones alone can satisfy it; expressions of any length cost in proportion to it.

Null texts count as empty: no words, no places, empty labels, score 0. Overlapping
places count each; repeated rows and null ids are scanned one by one. A text of any length is scanned whole, in one pass; an empty table
gives none, and other columns are not read, whatever their names.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

#: The phrases of the base rule and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Further notice phrases and their labels.
MORE = {
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "bsd license": "bsd",
    "isc license": "isc",
    "permission is hereby granted free of charge": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "creative commons attribution": "cc-by",
    "cc by sa": "cc-by-sa",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "cc0": "cc0",
    "public domain": "public-domain",
    "all rights reserved": "proprietary",
}
TAG = "spdx license identifier"
TAGGED = re.compile(r"spdx-license-identifier[^\S\r\n]*:[^\S\r\n]*([^\r\n]*)", re.I)
#: Starts of identifiers, longest first, and their labels.
FAMILIES = [("cc-by-nc", "cc-by-nc"), ("cc-by-nd", "cc-by-nd"), ("cc-by-sa", "cc-by-sa"), ("cc-by", "cc-by"), ("cc0", "cc0"), ("apache", "apache"), ("agpl", "agpl"), ("lgpl", "lgpl"), ("gpl", "gpl"), ("mpl", "mpl"), ("bsd", "bsd"), ("isc", "isc"), ("mit", "mit"), ("unlicense", "public-domain")]
#: Families that ask for little more than a notice.
PERMISSIVE = frozenset(["apache", "bsd", "cc0", "isc", "mit", "public-domain", "cc-by"])
#: Every byte that is no part of a word becomes a space; bytes of other than ASCII characters are parts of words.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
OPERATORS = {"or": 1, "and": 2, "with": 3}
PIECES = re.compile(r"[()]|(?<=[A-Za-z0-9.+])/(?=[A-Za-z])|[A-Za-z0-9.+:-]+")
#: Letters between an identifier's name and its version, as in GPLv2.
VERSION = re.compile(r"v?[0-9]", re.I)


def postfix(expression: str) -> list[str] | None:
    """Shunting-yard: operands and operators of an expression in postfix order; None if it is malformed.

    The expression ends where no further operand or operator can follow, as tags stand in comments.
    """
    out: list[str] = []
    stack: list[str] = []
    operand = True  # whether one is due
    for match in PIECES.finditer(expression):
        piece = "or" if match.group() == "/" else match.group()
        word = piece.lower()
        if operand:
            if piece == "(":
                stack.append(piece)
            elif piece == ")" or word in OPERATORS:
                return None
            else:
                out.append(piece)
                operand = False
        elif piece == ")":
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack:
                break
            stack.pop()
        elif word in OPERATORS:
            while stack and stack[-1] != "(" and OPERATORS[stack[-1]] >= OPERATORS[word]:
                out.append(stack.pop())
            stack.append(word)
            operand = True
        else:
            break
    if operand or "(" in stack:
        return None
    return out + stack[::-1]


def evaluated(expression: str, allowed: frozenset[str] = PERMISSIVE) -> tuple[str, list[str], bool] | None:
    """(postfix form, licences named, whether licences of the ``allowed`` families alone can satisfy it); None if malformed.

    One pass over the postfix form with a stack of truth values: ``or`` needs one side, ``and`` both, and what stands behind
    ``with`` is an exception to its licence, which counts as the licence does.
    """
    order = postfix(expression)
    if order is None:
        return None
    values: list[tuple[bool, int, int]] = []  # truth, and where the operands of this part begin and end among all
    operands: list[str] = []
    exception: list[bool] = []
    for piece in order:
        word = piece.lower()
        if word not in OPERATORS:
            operands.append(word)
            exception.append(False)
            values.append((family(word) in allowed, len(operands) - 1, len(operands)))
            continue
        right, left = values.pop(), values.pop()
        if word == "with":
            exception[right[1] : right[2]] = [True] * (right[2] - right[1])
        truth = left[0] or right[0] if word == "or" else left[0] and right[0] if word == "and" else left[0]
        values.append((truth, left[1], right[2]))
    named = list(dict.fromkeys(x for x, out in zip(operands, exception) if not out))
    return " ".join(x.lower() for x in order), named, values[0][0]


def family(identifier: str) -> str:
    """The family's label: an identifier belongs to it if it is its name, or goes on behind it with a mark or a version (``gpl-2.0``, ``gplv2``, ``gpl2``)."""
    for start, label in FAMILIES:
        rest = identifier[len(start) :]
        if identifier.startswith(start) and (not rest[:1].isalpha() or VERSION.match(rest)):
            return label
    return identifier


def named_families(expression: str) -> set[str]:
    """The families of the identifiers that stand before an expression's end, the first two words in a row or a closing bracket too many; exceptions behind ``with`` are none."""
    out: set[str] = set()
    known = {label for _, label in FAMILIES}
    last, depth = "", 0
    for match in PIECES.finditer(expression):
        piece = match.group().lower()
        if piece in "()":
            depth += 1 if piece == "(" else -1
            if depth < 0:
                break
        elif piece not in OPERATORS and piece != "/":
            if last == "name":
                break
            if last != "with" and family(piece) in known:
                out.add(family(piece))
            last = "name"
            continue
        last = piece
    return out


@lru_cache(maxsize=1)
def automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for phrase in {**BASE, **MORE, TAG: ""}:
        found.add_word(f" {phrase} ", phrase)
    found.make_automaton()
    return found


def scan(text: str | None) -> tuple:
    """(n_words, base places, first word, last word, base labels, labels, expressions, score) of a whole text."""
    words = (text or "").encode("utf-8", "replace").translate(_BYTES).split()
    joined = f" {b' '.join(words).decode('utf-8')} "
    starts: list[int] = []
    base: set[str] = set()
    more: set[str] = set()
    tagged = False
    at, before = 0, 0
    for end, phrase in automaton().iter(joined):
        if phrase == TAG:
            tagged = True
        elif phrase in BASE:
            begin = end - len(phrase) - 1
            if begin >= at:
                before += joined.count(" ", at, begin)
                at = begin
                place = before
            else:
                place = before - joined.count(" ", begin, at)
            starts.append(place)
            base.add(BASE[phrase])
        else:
            more.add(MORE[phrase])
    expressions: list[dict] = []
    sure = False
    if tagged:
        for match in TAGGED.finditer(text or ""):
            found = evaluated(match.group(1))
            if found is None:  # what it names is still known, if it is of a family
                more |= named_families(match.group(1))
                continue
            sure = True
            expressions.append({"postfix": found[0], "permissive": found[2]})
            more |= {family(x) for x in found[1]}
    labels = base | more
    score = 1.0 if sure else 0.0 if not labels else min(0.95, 0.6 + 0.1 * (len(starts) + len(more)))
    return (len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), expressions, score)


NAMES = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "expressions", "score"]
SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, expressions array<struct<postfix:string,permissive:boolean>>, score double"


def scan_licenses(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, expressions, score) of every row."""

    def run(rows: dict[str, list]) -> dict[str, list]:
        found = list(zip(*map(scan, rows["text"]), strict=True)) or [[] for _ in NAMES]
        return {id_column: rows["id"]} | {k: list(v) for k, v in zip(NAMES, found, strict=True)}

    kind = docs.schema[id_column].dataType.simpleString()
    return map_arrow(docs, [F.col(id_column).alias("id"), F.col(text_column).alias("text")], run, f"{id_column} {kind}, {SCHEMA}")


def op10_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
