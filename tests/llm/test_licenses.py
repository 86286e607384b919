"""Operator 10's labels, expressions and score against a plain version, and tags that are malformed."""

import re

import numpy as np
import pytest

from quern.llm import licenses as L

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def labels(text):
    return L.scan(text)[5]


@pytest.mark.parametrize(
    "tag, want",
    [
        ("MIT OR", "mit"),
        ("(MIT AND", "mit"),
        ("MIT/Apache-2.0", "apache,mit"),
        ("GPL-2.0 WITH Classpath-exception-2.0 */", "gpl"),
        ("MIT */ int x;", "mit"),
        ("GPLv2", "gpl"),
        ("LGPLv2.1+ OR MIT", "lgpl,mit"),
        ("gpl2 and bsd3", "bsd,gpl"),
        ("OR MIT", "mit"),
        ("GPL-2.0 WITH Classpath-exception-2.0", "gpl"),
        ("GPL-2.0 WITH", "gpl"),
        ("MIT) Apache-2.0", "mit"),
        ("mitten", "mitten"),
        ("AND AND", ""),
        ("", ""),
        ("(((", ""),
        ("Custom-1.0", "custom-1.0"),
        ("Custom-1.0 AND", ""),
    ],
)
def test_tags(tag, want):
    assert labels(f"// SPDX-License-Identifier: {tag}\nx") == want


def plain(expression, allowed):
    """Recursive descent: (truth, licences named) of a well-formed expression, None of others."""
    pieces = [p.lower() for p in re.findall(r"[()]|(?<=[A-Za-z0-9.+])/(?=[A-Za-z])|[A-Za-z0-9.+:-]+", expression)]
    pieces = ["or" if p == "/" else p for p in pieces]
    at = 0

    def one():
        nonlocal at
        if at >= len(pieces) or pieces[at] in (")", "or", "and", "with"):
            raise ValueError
        if pieces[at] == "(":
            at += 1
            out = any_of()
            if at >= len(pieces) or pieces[at] != ")":
                raise ValueError
            at += 1
            return out
        at += 1
        return L.family(pieces[at - 1]) in allowed, [pieces[at - 1]]

    def excepted():
        nonlocal at
        out = one()
        while at < len(pieces) and pieces[at] == "with":
            at += 1
            one()
        return out

    def level(word, below, join):
        nonlocal at
        out = below()
        while at < len(pieces) and pieces[at] == word:
            at += 1
            other = below()
            out = (join(out[0], other[0]), out[1] + other[1])
        return out

    def any_of():
        return level("or", lambda: level("and", excepted, lambda a, b: a and b), lambda a, b: a or b)

    try:
        out = any_of()
    except ValueError:
        return None
    return (out[0], list(dict.fromkeys(out[1]))) if at == len(pieces) else "more"


def test_expressions_against_recursive_descent():
    rng = np.random.default_rng(10)
    names = ["MIT", "GPL-2.0", "Apache-2.0", "x-1", "GPLv3", "ISC", "(", ")", "AND", "OR", "WITH", "/", "or", "and"]
    seen = 0
    for _ in range(20_000):
        text = " ".join(rng.choice(names, rng.integers(1, 9))).replace(" / ", rng.choice(["/", " / "]))
        want = plain(text, L.PERMISSIVE)
        got = L.evaluated(text)
        if want == "more":  # the plain version needs the whole text
            continue
        if want is None:
            assert got is None, text
        else:
            seen += 1
            assert got is not None and got[2] == want[0] and sorted(got[1]) == sorted(want[1]), text
    assert seen > 500


def test_labels_and_score_against_all_places():
    rng = np.random.default_rng(3)
    phrases = {**L.BASE, **L.MORE}
    parts = [*phrases, "gnu", "license", "the", "CC BY", "mit", "public", "apache", "é", "SPDX-License-Identifier: MIT\n", "SPDX-License-Identifier: (GPL-2.0\n"]
    for _ in range(1500):
        text = "".join(rng.choice(parts) + rng.choice([" ", ", ", "\n", "-"]) for _ in range(rng.integers(1, 12)))
        words = WORD.findall(text.lower())
        starts, base, all_of = [], set(), set()
        for phrase, label in phrases.items():
            own = phrase.split()
            for i in range(len(words) - len(own) + 1):
                if words[i : i + len(own)] == own:
                    all_of.add(label)
                    if phrase in L.BASE:
                        base.add(label)
                        starts.append(i)
        n_more = len({label for phrase, label in L.MORE.items() if f" {phrase} " in f" {' '.join(words)} "})
        tags = re.findall(r"spdx-license-identifier: (\(?[a-z0-9.-]+)", text.lower())
        sure = "mit" in tags
        tagged = {"gpl" if "gpl" in t else "mit" for t in tags}
        got = L.scan(text)
        assert got[:5] == (len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base))), text
        assert got[5] == ",".join(sorted(all_of | tagged)), text
        if sure:
            assert got[7] == 1.0
        elif not tagged:
            assert got[7] == (min(0.95, 0.6 + 0.1 * (len(starts) + n_more)) if all_of else 0.0), text


def test_edges(spark):
    rows = [(1, None), (None, "MIT License"), (1, ""), (2, "apache license " * 50_000)]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, labels string")
    got = L.scan_licenses(docs).collect()
    assert [(r["doc_id"], r["n_base"], r["labels"]) for r in got] == [(1, 0, ""), (None, 1, "mit"), (1, 0, ""), (2, 50_000, "apache")]
    assert L.scan_licenses(docs.where("false")).count() == 0
