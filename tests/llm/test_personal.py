"""Operator 12: base spans against the patterns themselves, the field against enumeration, accuracy on texts kept out of the fit."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from quern.llm import personal
from quern.llm.personal import Island, Lattice, base_spans

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_luhn(digits):
    odd = [int(c) for c in digits[::-1]]
    return sum(odd[::2] + [sum(divmod(2 * v, 10)) for v in odd[1::2]]) % 10 == 0


def plain_base(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            good = {"email": True, "ip": all(int(p) <= 255 for p in m.group().split(".")) if kind == "ip" else 0, "card": 13 <= len(digits) <= 19 and plain_luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if good:
                out.append((kind, *m.span()))
    return out


def luhned(rng, n=16):
    head = "".join(rng.choice("0123456789") for _ in range(n - 1))
    return next(head + c for c in "0123456789" if plain_luhn(head + c))


def test_base_spans_are_the_patterns():
    rng = random.Random(12)
    parts = ["a", "b.c", "@", "@x.y", "é", " ", "-", ".", "+", "1", "22", "300", "255.0", "(", ")", "\n", "%", "4111 1111 1111 1111", "+1 (555) 010-9999", "10.0.0.1", "0001", "a@b", "@", "_", "\x00", "9" * 13]
    for _ in range(6000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 14)))
        assert base_spans(text) == plain_base(text), text
    assert base_spans("a@b.c@d.e") == plain_base("a@b.c@d.e") and base_spans("1.2.3.4.5.6.7.8.9") == plain_base("1.2.3.4.5.6.7.8.9")


@pytest.mark.parametrize("piece", ["1", "a", "@", "a@", "1.", "+1(", "+1", "1 ", "a.b@c", "- ", "a@b.c "])
def test_odd_long_texts_take_linear_time(piece):
    import time

    start = time.process_time()
    text = piece * (200_000 // len(piece))
    base_spans(text)
    list(personal.islands(text))
    assert time.process_time() - start < 5


def segmentations(island, end):
    if end == 0:
        yield ()
        return
    for rest in segmentations(island, end - 1):
        yield (*rest, (end - 1, end, 0))
    for begin in island.candidates(end):
        for rest in segmentations(island, begin):
            for kind in range(1, len(personal.KINDS) + 1):
                yield (*rest, (begin, end, kind))


def test_field_against_enumeration():
    rng = np.random.default_rng(5)
    known = [(Island("tel ", "+1 555-01012", ""), [(0, 6, 3)]), (Island("", "a@b.cc", " x"), []), (Island("key = ", '"12345678"', ""), [(1, 2, 4)])]
    lattice = Lattice(known)
    weights = rng.normal(size=(len(lattice.names), lattice.states))
    steps = rng.normal(size=(lattice.states + 1, lattice.states))
    field = personal.Field(lattice.names, weights, steps)

    def score(island, path):
        total, last = 0.0, lattice.states
        for begin, end, kind in path:
            names = island.features(begin, end) if kind else island.alone(begin)
            total += steps[last][kind] + sum(field.weights[n][kind] for n in names)
            last = kind
        return total

    want = 0.0
    for island, gold in known:
        paths = list(segmentations(island, len(island.tokens)))
        scores = np.array([score(island, p) for p in paths])
        best = paths[int(scores.argmax())]
        assert field.spans(island) == [(personal.KINDS[k - 1], island.at[i], island.at[j]) for i, j, k in best if k]
        covered = {x for i, j, _ in gold for x in range(i, j)}
        path = sorted([(i, j, k + 1) for i, j, k in gold] + [(x, x + 1, 0) for x in range(len(island.tokens)) if x not in covered])
        want += score(island, path) - np.logaddexp.reduce(scores)
    got, by_weight, by_step = lattice.likelihood(weights, steps)
    assert got == pytest.approx(want)
    for array, gradient in ((weights, by_weight), (steps, by_step)):
        for at in itertools.islice(np.ndindex(array.shape), 0, None, 7):
            array[at] += 1e-5
            up = lattice.likelihood(weights, steps)[0]
            array[at] -= 2e-5
            down = lattice.likelihood(weights, steps)[0]
            array[at] += 1e-5
            assert gradient[at] == pytest.approx((up - down) / 2e-5, abs=1e-5)


def made_texts(rng, n):
    """Texts with spans that stand in known places: [(text, {(kind, start, end)})]."""
    for _ in range(n):
        text, spans = "", set()
        for _ in range(rng.randint(1, 4)):
            text += " ".join("".join(rng.choice("abcdefgé") for _ in range(rng.randint(1, 8))) for _ in range(rng.randint(1, 6))) + " "
            kind = rng.choice([*personal.KINDS, "none", "none"])
            if kind == "secret":
                text += rng.choice(["token", "api_key", "Secret"]) + rng.choice([' = "', ' : "'])
            piece = {
                "email": f"u{rng.randint(1, 99)}.x@mail{rng.randint(1, 9)}.example.org",
                "ip": ".".join(str(rng.randint(0, 255)) for _ in range(4)),
                "card": luhned(rng),
                "phone": f"+1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}",
                "secret": "".join(rng.choice("0123456789abcdef") for _ in range(39)) + "7",
                "none": rng.choice(["version 3.0 of", f"{rng.randint(300, 999)}.1.2.3", "in 1999 and", f"9{rng.randint(0, 10**5)}"]),
            }[kind]
            if kind != "none":
                spans.add((kind, len(text), len(text) + len(piece)))
            text += piece + ('" ' if kind == "secret" else " ")
        yield text, spans


@pytest.fixture(scope="module")
def field(spark):
    texts = [t for t, _ in made_texts(random.Random(1), 300)]
    return personal.train(spark.createDataFrame([(t,) for t in texts], "text string").repartition(5))


def test_spans_of_texts_kept_out(field):
    right = wrong = missed = 0
    for text, spans in made_texts(random.Random(2), 400):
        got = {s[:3] for s in personal.spans_of(text, field)}
        right += len(got & spans)
        wrong += len(got - spans)
        missed += len(spans - got)
    assert right > 500 and wrong <= 0.02 * right and missed <= 0.02 * right


def test_field_finds_what_no_pattern_has(field):
    found = lambda t: [(k, t[a:b]) for k, a, b, base in personal.spans_of(t, field) if not base]
    assert found("call (415) 555-2671 now") == [("phone", "(415) 555-2671")]
    assert found('x API_KEY = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b" y') == [("secret", "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b")]
    for clean in ("version 3.0 of 1999", "in 2024 some 1 000 000 people", "see page 12-14", "4.0.", "plain words only"):
        assert personal.spans_of(clean, field) == []


TEXTS = [None, "", "nothing here", "a@b.cc 4111 1111 1111 1111", "a@b.cc 4111 1111 1111 1111", "+49 (030) 123-4567\n1.2.3.4", 'é token = "' + "0a" * 20 + '"', "1 " * 3000, "x" * 100_000 + "@b.cc"]


def test_query_against_the_contract(spark, tmp_path):
    rows = [(i if i != 2 else None, t, "x", 1) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "x", 1)] * 2
    spark.createDataFrame(rows, "doc_id long, text string, spans string, start int").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    out = personal.op12_personal_data(spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    got = sorted(map(tuple, out.collect()), key=str)
    assert len(got) == len(rows)
    want = []
    for i, t, *_ in rows:
        base = plain_base(t or "")
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        want.append((i, *(sum(s[0] == k for s in base) for k in personal.BASE_KINDS), hashlib.sha256(joined.encode()).hexdigest()))
    assert [r[:6] for r in got] == sorted(want, key=str)
    for r in got:
        text = TEXTS[r[0]] if r[0] is not None else TEXTS[2]
        spans = [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in r[6].split(",") if s)]
        assert set(plain_base(text or "")) <= set(spans) and spans == sorted(spans, key=lambda s: (personal.KINDS.index(s[0]), s[1]))


def test_no_islands_and_redaction(spark):
    docs = spark.createDataFrame([(1, "no digits"), (2, None)], "doc_id long, text string")
    assert personal.train(docs) is None and personal.train(docs.where("false")) is None
    assert personal.find_personal(docs.where("false"), None).count() == 0
    docs = spark.createDataFrame([(1, "mail a@1.2.3.4 now"), (2, None), (3, "")], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in personal.find_personal(docs, None, with_text=True).collect()}
    assert rows[1]["redacted"] == "mail <email> now" and [s["kind"] for s in rows[1]["spans"]] == ["email", "ip"]
    assert rows[2]["redacted"] is None and rows[3]["redacted"] == "" and rows[2]["spans"] == []
