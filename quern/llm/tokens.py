"""Exact ids of a byte-level BPE file of the ``tokenizers`` library, with a bounded memory of the pieces seen.

A text may be cut at every single space that has no white space beside it: the
split pattern of byte-level BPE never crosses such a place.  The pieces between
them repeat, so their ids are kept; the new pieces of a batch of texts come apart into pre-tokens, whose
ids are kept too and come from the library's model. Pieces with characters beyond U+024F go to the library whole.
"""

from __future__ import annotations

import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SAFE_CUT = re.compile(r"(?<=\S) (?=\S)")
#: Characters whose Unicode class all the libraries agree on; other pieces take the library's whole path.
_PLAIN = re.compile(r"[\t\n\r\x20-ɏ]*")
END_TEXT = "<|endoftext|>"
#: The library's pattern on plain characters, its classes of letters and numbers written out.
_L, _N = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", "0-9\xb2\xb3\xb9\xbc-\xbe"
_pretokens = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^\s{_L}{_N}]+|\s+(?!\S)|\s+").findall


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def byte_letters() -> list[str]:
    """The printable letter of each byte in byte-level BPE: printable bytes stand for themselves, the rest follow from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


#: Letters of new pieces that the library encodes in one call.
CALL = 1 << 18
#: Pieces whose values are put in place at once.
PLACED = 1 << 16


class Pieces:
    """Values of whole texts that add up over safe cuts, as flat numbers of ``dtype`` for a batch of texts at once.

    The pieces of a batch are numbered, so each different one is looked up once and the rest is array work. New pieces of plain
    characters come apart into pre-tokens, which repeat far more than they do. ``memory`` holds at most ``most`` values: of pre-tokens, by the
    word if a space is before it and by space and word if none is, and of pieces with one pre-token more.
    """

    def __init__(self, dtype: np.dtype, most: int):
        self.dtype, self.most = dtype, most
        self.memory: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        """The value of a text that is not cut."""
        raise NotImplementedError

    def of_words(self, words: list[str]) -> list[bytes]:
        """The values of pre-tokens of plain characters."""
        raise NotImplementedError

    def of_others(self, pieces: list[str]) -> list[bytes]:
        """The values of pieces that don't come apart, each with one space before it."""
        return [self.whole(" " + p) for p in pieces]

    def additive(self, piece: str) -> bool:
        """Whether the value of a piece of plain characters is that of its pre-tokens."""
        return True

    def learn(self, pieces: list[str]) -> dict[str, bytes]:
        """The values of different pieces that ``memory`` lacks, each with one space before it; none for those with white space at an end."""
        memory, found, mixed, others = self.memory, {}, [], []
        for p in pieces:
            if p.isalpha() and (p.isascii() or _PLAIN.fullmatch(p)):
                found[p] = b""
            elif not p or p[0].isspace() or p[-1].isspace():
                continue
            elif END_TEXT not in p and _PLAIN.fullmatch(p) and self.additive(p):
                mixed.append(p)
            else:
                others.append(p)
        words = _pretokens(" " + " ".join(mixed)) if mixed else []
        # a piece of one pre-token is its own key
        keys = [w[1:] if w[0] == " " else " " + w for w in words]
        new = [*found, *(k for k in set(keys) if k not in memory and k not in found)]
        found.update(zip(new, self.of_words([k[1:] if k[0] == " " else " " + k for k in new]), strict=True))
        starts = [i for i, w in enumerate(words) if w[0] == " "]
        if len(starts) != len(mixed):
            raise AssertionError("a piece holds a space")
        long = {}
        for p, a, b in zip(mixed, starts, [*starts, len(words)][1:], strict=True):
            if b > a + 1:
                (found if b == a + 2 else long)[p] = b"".join([found[k] if k in found else memory[k] for k in keys[a:b]])
        found.update(zip(others, self.of_others(others), strict=True))
        if len(memory) < self.most:
            memory.update((p, v) for p, v in found.items() if len(p) <= 64)
        found.update(long)
        return found

    def _unsafe(self, text: str) -> bytes:
        """A text with more white space than single spaces between its pieces."""
        head, *rest = _SAFE_CUT.split(text)
        safe = {p for p in rest if " " not in p and not p[-1].isspace()}
        known = {p: self.memory[p] for p in safe if p in self.memory}
        known.update(self.learn([p for p in safe if p not in known]))
        return self.whole(head) + b"".join(known[p] if p in safe else self.whole(" " + p) for p in rest)

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(the values of all texts in a row, where each text's begin and, as one more, where the last one's end); null is empty."""
        texts = pc.fill_null(texts, "")
        n = len(texts)
        cut = pc.split_pattern(texts, " ")
        first = np.concatenate([[0], np.cumsum(pc.list_value_length(cut).to_numpy(), dtype=np.int64)])
        numbered = cut.flatten().dictionary_encode()
        at = numbered.indices.to_numpy().astype(np.int64)
        pieces = numbered.dictionary.to_numpy(zero_copy_only=False).tolist()
        heads = [pieces[i] for i in at[first[:-1]].tolist()]
        at[first[:-1]] = len(pieces) + np.arange(n)  # a text's first piece has no space before it
        used = np.zeros(len(pieces) + n, bool)
        used[at] = True
        known = list(map(self.memory.get, pieces))
        new = [i for i, value in enumerate(known) if value is None and used[i]]
        found = self.learn([pieces[i] for i in new])
        for i in new:
            known[i] = found.get(pieces[i])
        odd = np.zeros(len(pieces) + n, bool)
        odd[[i for i in new if known[i] is None]] = True
        odd[[len(pieces) + k for k, h in enumerate(heads) if h and h[-1].isspace() and first[k + 1] > first[k] + 1]] = True
        later = np.flatnonzero(np.add.reduceat(odd[at], first[:-1])).tolist() if n else []
        nothing = len(known) + n
        starting = [self.whole(h) for h in heads]
        for k in later:
            at[first[k] + 1 : first[k + 1]] = nothing
            starting[k] = self._unsafe(texts[k].as_py())
        each = [*(v or b"" for v in known), *starting, b""]
        flat = np.frombuffer(b"".join(each), self.dtype)
        size = np.fromiter(map(len, each), np.int64, len(each)) // self.dtype.itemsize
        begin = np.cumsum(size) - size
        length = size[at]
        ends = np.concatenate([[0], np.cumsum(length)])
        out = np.empty(ends[-1], self.dtype)
        for a in range(0, len(at), PLACED):
            own, b = at[a : a + PLACED], min(a + PLACED, len(at))
            places = np.repeat(begin[own] - ends[a:b], length[a:b])
            places += np.arange(ends[a], ends[b])
            out[ends[a] : ends[b]] = flat[places]
        return out, ends[first]


class Encoder(Pieces):
    """``ids_of(texts)``: little-endian ids of whole texts, as ``encode(text, add_special_tokens=False)`` gives them."""

    def __init__(self, path: str, memory: int = 500_000):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        super().__init__(np.dtype("<u2") if self.library.get_vocab_size() <= 1 << 16 else np.dtype("<u4"), memory)
        self.model = self.library.model
        self.split = regex.compile(public_tokenizers.PATTERN).findall
        letters = byte_letters()
        self.space = letters[32]
        self.letters = {b: letters[b] for b in range(256)}
        self.spelled = {c: "".join(letters[b] for b in chr(c).encode()) for c in range(0x250)}
        vocabulary = self.library.get_vocab()
        self.heads = np.zeros(max(vocabulary.values()) + 1, bool)  # the ids that begin with a space
        self.heads[[i for t, i in vocabulary.items() if t.startswith(self.space)]] = True

    def pretokens(self, text: str) -> list[str]:
        """The library's split of a text without special strings."""
        if _PLAIN.fullmatch(text):
            return self.split(text)
        return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def as_letters(self, text: str) -> str:
        if text.isascii() and text.isprintable():
            return text.replace(" ", self.space)
        return text.encode("utf-8", "replace").decode("latin-1").translate(self.letters)

    def whole(self, text: str) -> bytes:
        """The library's own ids of a text."""
        return np.array(self.library.encode(text, add_special_tokens=False).ids, self.dtype).tobytes() if text else b""

    def of_words(self, words: list[str]) -> list[bytes]:
        """The ids of pre-tokens, by the library's model alone."""
        merge, kind = self.model.tokenize, "H" if self.dtype.itemsize == 2 else "I"
        space, spelled = self.space, self.spelled
        return [array(kind, [t.id for t in merge(w.replace(" ", space) if w.isascii() and w.isprintable() else w.translate(spelled))]).tobytes() for w in words]

    def of_others(self, pieces: list[str]) -> list[bytes]:
        """Many pieces go to the library in one call, and come apart again at the ids that begin with a space."""
        found = {p: self.whole(" " + p) for p in pieces if END_TEXT in p}
        order = [p for p in pieces if p not in found]
        found.update(zip(order, self.many(order), strict=True))
        return [found[p] for p in pieces]

    def many(self, pieces: list[str]) -> list[bytes]:
        """The ids of pieces without a space or special string in them, each with one space before it."""
        out: list[bytes] = []
        size, at = self.dtype.itemsize, 0
        while at < len(pieces):
            stop, letters = at, 0
            while stop < len(pieces) and letters < CALL:
                letters += len(pieces[stop])
                stop += 1
            part = pieces[at:stop]
            ids = np.array(self.library.encode_batch_fast([" " + " ".join(part)], add_special_tokens=False)[0].ids, self.dtype)
            starts = np.flatnonzero(self.heads[ids])
            if len(starts) != len(part):
                raise AssertionError("a piece holds a space")
            whole, cuts = ids.tobytes(), [*(starts * size).tolist(), len(ids) * size]
            out += [whole[a:b] for a, b in zip(cuts, cuts[1:])]
            at = stop
        return out

    def ids_of(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text, null as empty."""
        ids, bounds = self.batch(pa.array(texts, pa.string()))
        whole, cuts = ids.tobytes(), (bounds * self.dtype.itemsize).tolist()
        return [whole[a:b] for a, b in zip(cuts, cuts[1:])]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each Python worker and file."""
    return Encoder(path)
