"""Piecewise memoised encoding with a public tokenizer file.

Where no token holds white space after a character that is not white space, a text may be cut before every space or line
end that follows such a character, and each piece encoded by itself. A line end between two such characters is then a
token of its own. This is tried at load, with characters of every Unicode category on both sides; a file that fails
encodes whole texts, as sentencepiece models do. Pieces repeat very often; their ids are kept in a bounded memo for the life of a Python worker.
"""

from __future__ import annotations

import random
import re
import unicodedata
from array import array
from collections.abc import Callable
from functools import lru_cache

import numpy as np

_UNSAFE = re.compile(r"\s[ \n]|\n\s").search
_SAFE_SPACE = re.compile(r"(?<=\S) ")
#: Letters up to U+00FF, which are in one normal form, and ASCII marks; contractions, digits and special tokens are left to the library.
_LETTERS, _MARKS = "A-Za-zªµºÀ-ÖØ-öø-ÿ", r"""!"#$%&()*+,\-./:;=>?@\[\\\]^_`{}~"""
_WORD = re.compile(rf"([{_LETTERS}]+)([{_MARKS}]*)").fullmatch
PROBES = 1500
MEMO_LIMIT = 500_000
LONGEST = 64


@lru_cache(maxsize=1)
def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others follow from U+0100."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {b: chr(b) if b in plain else chr(next(rest)) for b in range(256)}


def _plain(word: str) -> str:
    return word if word.isascii() else word.encode().decode("latin-1").translate(_byte_letters())


def _spaced(word: str) -> str:
    return (" " + word).encode().decode("latin-1").translate(_byte_letters())


def _lowered(word: str) -> str:
    return _plain(word.lower())


@lru_cache(maxsize=1)
def _characters() -> tuple[str, ...]:
    """Two characters of each Unicode category that aren't white space, and marks that tokenizers treat apart."""
    found: dict[str, list[str]] = {}
    for code in (*range(0x3000), *range(0xAC00, 0xAC10), *range(0x1F600, 0x1F604)):
        c = chr(code)
        if not c.isspace() and len(kind := found.setdefault(unicodedata.category(c), [])) < 2:
            kind.append(c)
    return tuple(sorted({c for kind in found.values() for c in kind} | set("'’_-.<|#")))


def crosses_spaces(tokenizer) -> bool:
    """Whether a token of the vocabulary has white space after another character: then a merge can reach over a space, whatever is tried.

    Tokens are read as plain text, with the mark of SentencePiece as a space, and as the bytes of a byte-level file; halves of characters are no space.
    """
    byte = {letter: b for b, letter in _byte_letters().items()}
    for token in tokenizer.get_vocab(with_added_tokens=True):
        forms = [token.replace("\u2581", " ")]
        if all(c in byte for c in token):
            forms.append(bytes(byte[c] for c in token).decode("utf-8", "replace"))
        if any(re.search(r"\S\s", form) for form in forms):
            return True
    return False


def cuts_at_spaces(tokenizer) -> bool:
    """Whether encoding a text is encoding its pieces: no token crosses a space, and all pairs of characters around a space or a line end agree."""
    if crosses_spaces(tokenizer):
        return False
    chars = _characters()
    ids = lambda texts: [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    alone, spaced, line = ids(list(chars)), ids([" " + c for c in chars]), ids(["\n"])[0]
    pairs = [(i, j) for i in range(len(chars)) for j in range(len(chars))]
    with_space, with_line = (ids([chars[i] + between + chars[j] for i, j in pairs]) for between in " \n")
    return all(x == alone[i] + spaced[j] and y == alone[i] + line + alone[j] for (i, j), x, y in zip(pairs, with_space, with_line))


@lru_cache(maxsize=1)
def _probes() -> tuple[str, ...]:
    """Words of plain letters and marks, as _WORD takes them."""
    rng = random.Random(1)
    letters, marks = [chr(c) for c in range(256) if re.match(f"[{_LETTERS}]", chr(c))], [chr(c) for c in range(128) if re.match(f"[{_MARKS}]", chr(c))]
    ascii_letters = [c for c in letters if c.isascii()]
    word = lambda: "".join(rng.choice(letters if rng.random() < 0.2 else ascii_letters) for _ in range(rng.randint(1, 9)))
    return tuple(word() + "".join(rng.choice(marks) for _ in range(rng.choice((0, 0, 1, 2)))) for _ in range(PROBES))


class _Memo(dict):
    """Values by piece, in two generations of `most` (MEMO_LIMIT by default) at most.

    When the younger is full it becomes the older, and a piece that is met again moves back, so frequent pieces stay.
    """

    def __init__(self, make: Callable[[str], object], most: int | None = None):
        super().__init__()
        self.make, self.older, self.most = make, {}, most or MEMO_LIMIT

    def __missing__(self, piece: str):
        value = self.older.get(piece)
        if value is None:
            value = self.make(piece)
        self.keep(piece, value)
        return value

    def keep(self, piece: str, value) -> None:
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        if len(piece) <= LONGEST:
            self[piece] = value


class Encoder:
    """Ids of texts as bytes or, with lengths_only, their number."""

    def __init__(self, path: str, lengths_only: bool = False, memo: int | None = None):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.dtype = "<u2" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 65536 else "<u4"
        self.lengths_only = lengths_only
        self.cuts = cuts_at_spaces(self.tokenizer)
        self._code = "H" if self.dtype == "<u2" else "I"
        self._model = self.tokenizer.model.tokenize
        self._line = self._value(self._encode("\n"))
        self.marks = _Memo(lambda x: self._value(self._encode(x)), memo)
        self.marks[""] = self._value([])
        self.spaced, self.bare, self.forms = _Memo(lambda x: self._piece(x, 0), memo), _Memo(lambda x: self._piece(x, 1), memo), None
        if lengths_only or not self.cuts:
            return  # counts come from batches of the library
        probes = _probes()
        spaced, bare = ([self._value(e.ids) for e in self.tokenizer.encode_batch_fast([head + x for x in probes], add_special_tokens=False)] for head in (" ", ""))
        for forms in ((_spaced, _plain), (_lowered, _lowered)):
            self.forms = forms
            if all(self._piece(x, 0) == y and self._piece(x, 1) == z for x, y, z in zip(probes, spaced, bare)):
                return  # the library's model gives for the parts of a piece what the library gives for the whole
        self.forms = None

    def _encode(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _value(self, ids: list[int]):
        return len(ids) if self.lengths_only else array(self._code, ids).tobytes()

    def _piece(self, piece: str, kind: int):
        """kind 0: with a space in front, 1: without. Letters are one word of the model, marks after them another."""
        match = self.forms and _WORD(piece)
        if not match:
            return self._value(self._encode(piece if kind else " " + piece))
        word, marks = match.groups()
        if marks:
            return (self.spaced, self.bare)[kind][word] + self.marks[marks]
        return self._value([t.id for t in self._model(self.forms[kind](word))])

    def _cut(self, text: str) -> tuple[list[str], list[str]]:
        """Pieces that begin a text or a line, and pieces with a space in front."""
        if _UNSAFE(text):
            head, *rest = _SAFE_SPACE.split(text)
            return [head], rest
        heads, rest = [], []
        for line in text.split("\n"):
            words = line.split(" ")
            heads.append(words[0])
            rest += words[1:]
        return heads, rest

    def counts(self, texts: list[str]) -> list[int]:
        """Tokens of each text. The pieces that are not known are encoded in one batch."""
        if not self.cuts:
            return [len(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        cut = [self._cut(t) for t in texts]
        for memo, k, front in ((self.bare, 0, ""), (self.spaced, 1, " ")):
            new = [x for x in set().union(*[c[k] for c in cut]).difference(memo) if len(x) <= LONGEST and x not in memo.older]
            for piece, got in zip(new, self.tokenizer.encode_batch_fast([front + x for x in new], add_special_tokens=False)):
                memo.keep(piece, len(got.ids))
        return [sum(map(self.bare.__getitem__, heads)) + sum(map(self.spaced.__getitem__, rest)) + self._line * (len(heads) - 1) for heads, rest in cut]

    def values(self, text: str) -> list:
        """Values of the pieces of a text in order."""
        if not self.cuts:
            return [self._value(self._encode(text))]
        safe = _UNSAFE(text) is None
        out = []
        for i, line in enumerate(text.split("\n") if safe else [text]):
            head, *rest = line.split(" ") if safe else _SAFE_SPACE.split(line)
            out += (self._line, self.bare[head]) if i else (self.bare[head],)
            out += map(self.spaced.__getitem__, rest)
        return out

    def ids(self, text: str | None) -> np.ndarray:
        return np.frombuffer(b"".join(self.values(text)) if text else b"", self.dtype)


class PieceModel:
    """A sentencepiece model, with whole texts only."""

    cuts = False

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.dtype = "<u2" if self.model.get_piece_size() <= 65536 else "<u4"

    def counts(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.model.encode(texts, num_threads=1)]

    def ids(self, text: str | None) -> np.ndarray:
        return np.array(self.model.encode(text) if text else [], self.dtype)


@lru_cache(maxsize=2)
def encoder(path: str, lengths_only: bool = False, memo: int | None = None) -> Encoder | PieceModel:
    """One encoder for each file and worker: tokenizers for .json, sentencepiece for .model."""
    return PieceModel(path) if path.endswith(".model") else Encoder(path, lengths_only, memo)
