"""Operator 12, personal data: base patterns, and a semi-Markov conditional random field over whole candidate spans.

The base kinds are found leftmost, without overlaps within a kind, in time linear in the text. The
field works on islands: words with a digit or an ``@``, next to each other on a line. An island is cut into tokens; each stretch of up to ``MOST_TOKENS`` tokens that passes
``possible`` is a candidate for every kind, and a single token may be no entity. What a segment weighs comes from the whole span (its shape, digits, separators, check sums, the words
and marks around it) and from the kind of the segment before. Outside islands nothing is a candidate, so
dynamic programming over each island gives the best segmentation of the whole text, boundaries and kinds at once.

``train`` fits the weights by likelihood on at most ``MOST_ISLANDS`` islands, the first by a hash of their text, so the model is
the same on any cluster. Their labels are the base spans that pass their checks, strings assigned to names in ``SECRET_NAMES``, and phone
numbers with and without their country's code. The field adds its spans where they touch no base span: ``secret`` has no base pattern.

Null and empty texts have no spans. Texts are read whole, one row in one task, and their islands one by one; only islands of over
``LONGEST`` tokens are left out of the fit (never out of the search). Repeated rows and null ids give a row each, empty tables none; without an island to learn from the field adds
nothing. Spans are in code points, ends exclusive, by kind as listed in ``KINDS`` and start. Other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

KINDS = ("email", "ip", "card", "phone", "secret")
BASE_KINDS = KINDS[:4]
#: Tokens of the longest candidate; islands of the fit and their tokens.
MOST_TOKENS, MOST_ISLANDS, LONGEST = 24, 2000, 64
#: Words in the names that secrets are assigned to.
SECRET_NAMES = ("token", "key", "secret", "password", "passwd", "pwd", "credential", "bearer", "auth")

ADDRESS = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
PARTS = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
EMAIL_SHAPE = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
ASSIGNED = re.compile(r"([A-Za-z0-9_-]+)[\"']? ?[=:] ?([\"']?)$")
TOKEN = re.compile(r"[A-Za-z0-9]+|[^A-Za-z0-9]")
ANCHOR = re.compile(r"[0-9@]")
BREAK = re.compile(r"[ \t\r\n]")
NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    """Whether the check sum of a string of digits is right."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = int(c) << (k & 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def byte_part(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and (not part or int(part) <= 255)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base patterns, by kind and start."""
    found = []
    end = 0
    at = text.find("@")
    while at >= 0:
        match = ADDRESS.match(text, at)
        if match:
            start = at
            while start > end and text[start - 1] in LOCAL:
                start -= 1
            if start < at:
                end = match.end()
                found.append(("email", start, end))
        at = text.find("@", max(at + 1, end))
    for match in PARTS.finditer(text):
        parts, at = match.group().split("."), match.start()
        for k in range(0, len(parts) - 3, 4):  # four parts each, one after the other; they stay away if a part is too large
            size = sum(map(len, parts[k : k + 4])) + 3
            if all(map(byte_part, parts[k : k + 4])):
                found.append(("ip", at, at + size))
            at += size + 1
    for match in CARD.finditer(text):
        digits = NOT_DIGIT.sub("", match.group())
        if 13 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", *match.span()))
    for match in PHONE.finditer(text):
        if 9 <= len(NOT_DIGIT.sub("", match.group())) <= 15:
            found.append(("phone", *match.span()))
    return found


def islands(text: str) -> Iterator[tuple[int, int]]:
    """[start, end) of words with a digit or an ``@``, those next to each other on a line taken together."""
    start = end = -1
    match = ANCHOR.search(text)
    while match:
        at = match.start()
        low = max(end, 0)
        begin = max(low, *(text.rfind(c, low, at) + 1 for c in " \t\r\n"))
        stop = BREAK.search(text, at)
        after = stop.start() if stop else len(text)
        if start >= 0 and begin == end + 1 and text[end] == " ":
            end = after
        else:
            if start >= 0:
                yield start, end
            start, end = begin, after
        match = ANCHOR.search(text, after)
    if start >= 0:
        yield start, end


class Island:
    """An island's text with what stands around it, its tokens' places, and counts that answer ``possible`` at once."""

    def __init__(self, before: str, text: str, after: str) -> None:
        self.before, self.text, self.after = before, text, after
        self.tokens = TOKEN.findall(text)
        self.at = [0]
        self.digits = [0]
        self.spaces = [0]
        self.signs = [0]
        for t in self.tokens:
            self.at.append(self.at[-1] + len(t))
            self.digits.append(self.digits[-1] + sum(map(t.count, "0123456789")))
            self.spaces.append(self.spaces[-1] + (t == " "))
            self.signs.append(self.signs[-1] + (t == "@"))

    def possible(self, i: int, j: int) -> bool:
        """Whether tokens i to j - 1 can be an entity: ends that are no marks, and enough digits, one ``@``, or one long string."""
        if not (self.tokens[i][0].isalnum() or self.tokens[i] in "+(") or not self.tokens[j - 1][0].isalnum():
            return False
        digits, spaced = self.digits[j] - self.digits[i], self.spaces[j] > self.spaces[i]
        if self.signs[j] - self.signs[i]:
            return self.signs[j] - self.signs[i] == 1 and not spaced
        return 7 <= digits and (digits <= 19 or not spaced) or digits > 0 and not spaced and self.at[j] - self.at[i] >= 16

    def candidates(self, end: int) -> Iterator[int]:
        """First tokens of the candidates that end before token ``end``."""
        return (i for i in range(max(0, end - MOST_TOKENS), end) if self.possible(i, end))

    def features(self, i: int, j: int) -> list[str]:
        """What is known of tokens i to j - 1 as a whole span."""
        a, b = self.at[i], self.at[j]
        span, left, right = self.text[a:b], (self.before + self.text[:a])[-40:], (self.text[b : b + 2] + self.after)[:2]
        digits = self.digits[j] - self.digits[i]
        marks = sorted(set(NOT_ALNUM.findall(span)))
        out = ["bias", f"digits={min(digits, 20)}", *(f"mark={m}" for m in marks if m in " .-()+@_"), f"tokens={min(j - i, 12)}"]
        if any(m not in " .-()+@_%" for m in marks):
            out.append("odd mark")
        if span[0] == "+":
            out.append("plus")
        letters = len(span) - digits - sum(not c.isalnum() for c in span)
        if EMAIL_SHAPE.fullmatch(span):
            out.append("email shape")
        parts = span.split(".")
        if len(parts) == 4 and not letters and all(p.isdigit() for p in parts):
            out.append("ip parts" if all(map(byte_part, parts)) else "large parts")
        if not letters and 13 <= digits <= 19 and all(m in " -" for m in marks):
            out.append("right sum" if luhn(NOT_DIGIT.sub("", span)) else "wrong sum")
        if not letters and not marks:
            out.append("digits only")
        if letters and digits and not marks:
            out.append("mixed")
            if all(c in "0123456789abcdefABCDEF" for c in span):
                out.append("hexadecimal")
        if len(span) >= 16 and " " not in span:
            out.append(f"long={min(len(span) // 16, 4)}")
        if left[-1:].isalnum() or left[-1:] in tuple("@_%"):
            out.append("cut before")
        if right[:1].isalnum() or right[:1] in tuple("@_%"):
            out.append("cut behind")
        if left[-1:] in (".", "-", "+") or left[-1:] == " " and left[-2:-1].isdigit():
            out.append("more before")
        if right[:1] in (".", "-") and right[1:2].isalnum() or right[:1] == " " and right[1:2].isdigit():
            out.append("more behind")
        if left[-1:] in tuple("\"'") and right[:1] == left[-1:]:
            out.append("quoted")
        named = ASSIGNED.search(left)
        if named:
            out += ["assigned", f"name={named[1].lower()}"]
        else:
            words = left.lower().split()
            out += [f"before={words[-1].strip(':,.')}"] if words and not left[-1:].isalnum() else []
        return out

    def alone(self, i: int) -> list[str]:
        """What is known of token i as no entity."""
        t = self.tokens[i]
        return ["alone", "alone:" + (f"digits{min(len(t), 8)}" if t.isdigit() else "word" if t[0].isalnum() else t if t in " .-()+@_\"'" else "mark")]


NOT_ALNUM = re.compile(r"[^A-Za-z0-9]")


def islands_of(text: str) -> Iterator[tuple[int, Island]]:
    for a, b in islands(text):
        yield a, Island(text[max(0, a - 40) : a].rpartition("\n")[2], text[a:b], text[b : b + 2])


def labelled(island: Island) -> list[tuple[int, int, int]] | None:
    """(first token, token behind, kind) of the spans that the base patterns and assignments give; None where spans cross or end within tokens."""
    spans = [(a, b, KINDS.index(k)) for k, a, b in base_spans(island.text)]
    for match in re.finditer(r"[A-Za-z0-9_/+=.-]{16,}", island.text):
        a, b = match.span()
        named = ASSIGNED.search((island.before + island.text[:a])[-40:])
        if named and any(n in named[1].lower() for n in SECRET_NAMES) and not any(a < y and x < b for x, y, _ in spans):
            spans.append((a, b, KINDS.index("secret")))
    places = {a: k for k, a in enumerate(island.at)}
    out = []
    for a, b, kind in sorted(spans):
        if a not in places or b not in places or out and places[a] < out[-1][1]:
            return None
        i, j = places[a], places[b]
        if j - i > MOST_TOKENS or not island.possible(i, j):
            return None
        out.append((i, j, kind))
    return out


def examples(before: str, text: str, after: str) -> Iterator[tuple[Island, list[tuple[int, int, int]]]]:
    """The island with its labels; phone numbers also without their country's code (still one), and as plain numbers with and without spaces (none)."""
    island = Island(before, text, after)
    gold = labelled(island)
    if gold is None:
        return
    yield island, gold
    phone = KINDS.index("phone")
    if len(gold) == 1 and gold[0][2] == phone:
        a, b = island.at[gold[0][0]], island.at[gold[0][1]]
        national = re.sub(r"^\+[0-9]{1,3} ?", "", text[a:b])
        if len(NOT_DIGIT.sub("", national)) >= 7 and not national[0].isdigit():
            other = Island(before, text[:a] + national + text[b:], after)
            places = {x: k for k, x in enumerate(other.at)}
            if a in places and a + len(national) in places and other.possible(places[a], places[a + len(national)]):
                yield other, [(places[a], places[a + len(national)], phone)]
                digits = NOT_DIGIT.sub("", national)
                for number in (digits, f"{int(digits):,}".replace(",", " "), f"{int(digits[:7]):,}".replace(",", " ")):
                    yield Island(before, text[:a] + number + text[b:], after), []


class Field:
    """Weights of a fitted field: of each feature by kind (no entity first), and from each kind (and the start) to each."""

    def __init__(self, names: list[str], weights: np.ndarray, steps: np.ndarray) -> None:
        self.weights = {n: w for n, w in zip(names, weights.tolist(), strict=True)}
        self.steps = steps.tolist()

    def spans(self, island: Island) -> list[tuple[str, int, int]]:
        """The best segmentation's entities as (kind, start, end) within the island."""
        states = len(KINDS) + 1
        best: list[list[float]] = [[float("-inf")] * states + [0.0]]  # the last state is the start
        back: list[list] = [[None] * (states + 1)]
        for end in range(1, len(island.tokens) + 1):
            score, came = [float("-inf")] * (states + 1), [None] * (states + 1)
            for begin in [end - 1, *island.candidates(end)]:
                names = island.alone(begin) if came[0] is None else island.features(begin, end)
                rows = [self.weights[n] for n in names if n in self.weights]
                for kind in [0] if came[0] is None else range(1, states):
                    own = sum(r[kind] for r in rows)
                    for last, reached in enumerate(best[begin]):
                        total = reached + self.steps[last][kind] + own
                        if total > score[kind]:
                            score[kind], came[kind] = total, (begin, last)
            best.append(score)
            back.append(came)
        out, end = [], len(island.tokens)
        kind = max(range(states + 1), key=lambda k: best[end][k])
        while end:
            begin, last = back[end][kind]
            if kind:
                out.append((KINDS[kind - 1], island.at[begin], island.at[end]))
            end, kind = begin, last
        return out[::-1]


class Lattice:
    """Arcs of all candidate segments of some islands, for sums over all segmentations at once."""

    def __init__(self, known: list[tuple[Island, list[tuple[int, int, int]]]]) -> None:
        states = len(KINDS) + 1
        index: dict[str, int] = {}
        arcs, flat, where, gold, self.gold_steps = [], [], [], [], np.zeros((states + 1, states))
        for k, (island, spans) in enumerate(known):
            chosen = {(i, j): kind + 1 for i, j, kind in spans}
            covered = {x for i, j, _ in spans for x in range(i, j)}
            last = states
            for end in range(1, len(island.tokens) + 1):
                for begin, names, kinds in [(end - 1, island.alone(end - 1), [0]), *((i, island.features(i, end), range(1, states)) for i in island.candidates(end))]:
                    row = len(where)
                    where.append(len(flat))
                    flat += [index.setdefault(n, len(index)) for n in names]
                    for kind in kinds:
                        arcs.append((k, begin, end, kind, row))
                        gold.append(chosen.get((begin, end)) == kind if kind else end - 1 not in covered)
                if end - 1 not in covered or any(j == end for _, j in chosen):
                    kind = 0 if end - 1 not in covered else next(v for (_, j), v in chosen.items() if j == end)
                    self.gold_steps[last, kind] += 1
                    last = kind
        self.names, self.n, self.states = list(index), len(known), states
        self.island, self.begin, self.end, self.kind, self.row = (np.array(x, int) for x in zip(*arcs, strict=True))
        self.flat, self.where, self.gold = np.array(flat), np.array(where), np.array(gold)
        self.of_flat = np.repeat(np.arange(len(where)), np.diff(np.append(where, len(flat))))
        self.size = int(self.end.max())
        self.length = np.zeros(self.n, int)
        np.maximum.at(self.length, self.island, self.end)
        self.by_end = [np.flatnonzero(self.end == e) for e in range(self.size + 1)]
        self.by_begin = [np.flatnonzero(self.begin == e) for e in range(self.size + 1)]

    def likelihood(self, weights: np.ndarray, steps: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """(log likelihood, gradient by feature and kind, gradient by step) of the known segmentations."""
        rows = np.add.reduceat(weights[self.flat], self.where)
        score = rows[self.row, self.kind]
        ahead = np.full((self.n, self.size + 1, self.states + 1), -np.inf)
        ahead[:, 0, self.states] = 0
        into = np.empty(len(score))
        for at in self.by_end[1:]:
            reach = ahead[self.island[at], self.begin[at]] + steps[:, self.kind[at]].T
            into[at] = np.logaddexp.reduce(reach, axis=1)
            np.logaddexp.at(ahead, (self.island[at], self.end[at], self.kind[at]), into[at] + score[at])
        behind = np.full((self.n, self.size + 1, self.states + 1), -np.inf)
        behind[np.arange(self.n), self.length] = 0
        for at in reversed(self.by_begin):
            value = score[at] + behind[self.island[at], self.end[at], self.kind[at]]
            reach = value[:, None] + steps[:, self.kind[at]].T
            for last in range(self.states + 1):
                np.logaddexp.at(behind, (self.island[at], self.begin[at], np.full(len(at), last)), reach[:, last])
        whole = behind[:, 0, self.states]
        share = np.exp(into + score + behind[self.island, self.end, self.kind] - whole[self.island])
        extra = self.gold - share
        by_row = np.zeros_like(rows)
        np.add.at(by_row, (self.row, self.kind), extra)
        gradient = np.zeros_like(weights)
        np.add.at(gradient, self.flat, by_row[self.of_flat])
        reach = ahead[self.island, self.begin] + steps[:, self.kind].T
        part = share[:, None] * np.exp(reach - into[:, None])
        by_step = np.zeros_like(steps.T)
        np.add.at(by_step, self.kind, part)
        total = score[self.gold].sum() + (self.gold_steps * steps).sum() - whole.sum()
        return float(total), gradient, self.gold_steps - by_step.T


def fit(known: list[tuple[Island, list[tuple[int, int, int]]]], rounds: int = 120, ridge: float = 0.05) -> Field | None:
    """The field of the greatest likelihood less ``ridge`` times the weights' squares, by sign-adapted steps; None without islands."""
    if not known:
        return None
    lattice = Lattice(known)
    shape = (len(lattice.names), lattice.states)
    at = np.zeros(shape[0] * shape[1] + (lattice.states + 1) * lattice.states)
    pace, before = np.full(len(at), 0.1), np.zeros(len(at))
    cut = shape[0] * shape[1]
    for _ in range(rounds):
        _, by_weight, by_step = lattice.likelihood(at[:cut].reshape(shape), at[cut:].reshape(-1, lattice.states))
        gradient = np.concatenate([by_weight.ravel(), by_step.ravel()]) - 2 * ridge * at
        same = gradient * before
        pace = np.clip(np.where(same > 0, pace * 1.2, np.where(same < 0, pace * 0.5, pace)), 1e-4, 1.0)
        gradient[same < 0] = 0
        at += np.sign(gradient) * pace
        before = gradient
    return Field(lattice.names, at[:cut].reshape(shape), at[cut:].reshape(-1, lattice.states))


def train(docs: DataFrame, text_column: str = "text") -> Field | None:
    """A field fitted on the first ``MOST_ISLANDS`` different islands by hash."""

    def run(rows: dict[str, list]) -> dict[str, list]:
        found = Counter((x.before, x.text, x.after) for t in rows["text"] if t for _, x in islands_of(t) if len(x.tokens) <= LONGEST)
        return dict(zip(("before", "text", "after"), map(list, zip(*found, strict=True)))) if found else {"before": [], "text": [], "after": []}

    found = map_arrow(docs, [F.col(text_column).alias("text")], run, "before string, text string, after string").distinct()
    key = F.xxhash64("before", "text", "after")
    sample = found.orderBy(key, "text", "before", "after").limit(MOST_ISLANDS).collect()
    return fit([x for r in sample for x in examples(r["before"], r["text"], r["after"])])


def spans_of(text: str | None, field: Field | None) -> list[tuple[str, int, int, bool]]:
    """(kind, start, end, base) of a whole text, by kind and start."""
    if not text:
        return []
    base = base_spans(text)
    out = [(*s, True) for s in base]
    if field is not None:
        taken = sorted((a, b) for _, a, b in base)
        k, most = 0, 0  # ends of the base spans that start before the place
        for shift, island in islands_of(text):
            for kind, a, b in field.spans(island):
                while k < len(taken) and taken[k][0] < shift + b:
                    most = max(most, taken[k][1])
                    k += 1
                if most <= shift + a:
                    out.append((kind, shift + a, shift + b, False))
    return sorted(out, key=lambda s: (KINDS.index(s[0]), s[1]))


def redacted(text: str | None, spans: list[tuple[str, int, int, bool]]) -> str | None:
    """The text with its spans replaced by their kinds in angle brackets; spans that overlap become one, of the first kind."""
    if not spans:
        return text
    out, at = [], 0
    merged: list[list] = []
    for kind, a, b, _ in sorted(spans, key=lambda s: (s[1], s[2])):
        if merged and a < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], b)
        else:
            merged.append([kind, a, b])
    for kind, a, b in merged:
        out += [text[at:a], f"<{kind}>"]
        at = b
    return "".join(out) + text[at:]


SPAN = "struct<kind:string,start:long,end:long,base:boolean>"


def find_personal(docs: DataFrame, field: Field | None, id_column: str = "doc_id", text_column: str = "text", with_text: bool = False) -> DataFrame:
    """(id, spans[, redacted]) of every row, with a field that ``train`` fitted."""

    def run(rows: dict[str, list]) -> dict[str, list]:
        found = [spans_of(t, field) for t in rows["text"]]
        out = {id_column: rows["id"], "spans": [[dict(zip(("kind", "start", "end", "base"), s, strict=True)) for s in x] for x in found]}
        return out | ({"redacted": list(map(redacted, rows["text"], found))} if with_text else {})

    kind = docs.schema[id_column].dataType.simpleString()
    return map_arrow(docs, [F.col(id_column).alias("id"), F.col(text_column).alias("text")], run, f"{id_column} {kind}, spans array<{SPAN}>" + ", redacted string" * with_text)


def op12_personal_data(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = find_personal(docs, train(docs))
    base = F.filter("spans", lambda s: s["base"])
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    own = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long")
    counts = [own(k).alias(f"n_{k}") for k in BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
