"""A fast exact front to a word-level BPE of the tokenizers library.

The vocabulary's own steps (NFC, white space, lower case, split into words, byte-level
letters, merges) never look across a U+0020. Words of plain Latin text are therefore cut
here with one regular expression and each distinct word is merged once by the library's
model; the rest of a text, and anything unusual, goes through the library as a whole.
"""

from __future__ import annotations

import re
import unicodedata
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 12_000_000  # characters encoded together
_RE2_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"

#: Code points that fast splitting handles: printable ASCII, tab and line ends, Latin letters and signs.
_PLAIN = [*range(0x21, 0x7F), 0x20, 0x09, 0x0A, 0x0D, *range(0xA1, 0x250), *range(0x2010, 0x2028), *range(0x2030, 0x205F), 0x20AC]
#: Not those whose lower case lies elsewhere.
_PLAIN = [p for p in _PLAIN if all(ord(c) in set(_PLAIN) for c in chr(p).lower())]


def _class(points) -> str:
    return "".join(re.escape(chr(p)) for p in points)


_SPACE = (0x20, 0x09, 0x0A, 0x0D)
_LETTER = _class(p for p in _PLAIN if unicodedata.category(chr(p))[0] == "L")
_NUMBER = _class(p for p in _PLAIN if unicodedata.category(chr(p))[0] == "N")
_OTHER = _class(p for p in _PLAIN if p not in _SPACE and unicodedata.category(chr(p))[0] not in "LN")
_PLAIN_ASCII = bytes(p for p in _PLAIN if p < 128)
_IS_PLAIN = np.zeros(max(_PLAIN) + 2, bool)
_IS_PLAIN[_PLAIN] = True
_WORDS = re.compile(f"[{_LETTER}]+|[{_NUMBER}]|'s|'t|'re|'ve|'m|'ll|'d|[{_OTHER}]+")
_ASCII_WORDS = re.compile(f"[a-z]+|[0-9]|'s|'t|'re|'ve|'m|'ll|'d|[{_class(p for p in _PLAIN if 0x20 < p < 0x7F and not chr(p).isalnum())}]+")


def plain(text: str) -> bool:
    """Whether fast splitting holds for the whole text; "<|" could begin a special token."""
    if "<|" in text:
        return False
    if text.isascii():
        return not text.encode().translate(None, _PLAIN_ASCII)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return bool(_IS_PLAIN[np.minimum(points, len(_IS_PLAIN) - 1)].all())


def _folded(text: str) -> str:
    """A plain text in lower case, with tabs and line ends as the spaces they count as."""
    text = text.lower()
    return text if text.isprintable() else text.replace("\n", " ").replace("\t", " ").replace("\r", " ")


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others follow from 256."""
    keep = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(keep)]
    return {b: chr(b) for b in keep} | {b: chr(256 + n) for n, b in enumerate(rest)}


_LETTERS = _byte_letters()


class WordEncoder:
    """Token ids of texts as ``tokenizers`` gives them with add_special_tokens=False.

    Pieces between spaces are kept with their ids, letters-only words among them; the table
    holds two generations of at most ``limit`` pieces, and what is asked again moves to the newer.
    """

    def __init__(self, path: str, limit: int = 200_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.limit = limit
        self.words = _Table(self)
        self.pieces: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        """By the library alone."""
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _word(self, word: str) -> bytes:
        letters = word if word.isascii() else "".join(map(_LETTERS.__getitem__, word.encode()))
        return array("I", [t.id for t in self.model.tokenize(letters)]).tobytes()

    def _plain(self, text: str) -> bytes:
        if len(self.words) > self.limit:
            self.words.age()
        return b"".join(map(self.words.__getitem__, _folded(text).split(" ")))

    def encode_many(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each text begins and, last, the end); null counts as empty.

        Arrow numbers the distinct pieces of some megabytes of plain text at a time and cuts
        these into words, so that only distinct words are looked up; ids are gathered at once.
        """
        out, counts, at = [np.empty(0, "<u4")], [np.zeros(1, np.int64)], 0
        while at < len(texts):
            some, size, odd = [], 0, {}
            while at < len(texts) and size < SLICE:
                text = texts[at] or ""
                if plain(text):
                    some.append(_folded(text))
                else:
                    odd[len(some)] = text
                    some.append("")
                size, at = size + len(text), at + 1
            ids, bounds = self._slice(some)
            n = np.diff(bounds)
            if odd:
                parts = [ids[bounds[i] : bounds[i + 1]] if i not in odd else np.frombuffer(self.encode(odd[i]), "<u4") for i in range(len(some))]
                ids, n = np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts))
            out.append(ids)
            counts.append(n)
        return np.concatenate(out), np.cumsum(np.concatenate(counts))

    def _slice(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        pieces = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        numbered = pieces.values.dictionary_encode()
        words = pc.split_pattern(pc.replace_substring_regex(numbered.dictionary, _RE2_WORDS, "\\0 "), " ")
        distinct = words.values.dictionary_encode()
        values = self._values(distinct.dictionary.to_numpy(zero_copy_only=False).tolist())
        known = np.frombuffer(b"".join(values), "<u4")
        sizes = np.fromiter(map(len, values), np.int64, len(values)) // 4
        ids, bounds = _gather(known, np.cumsum(sizes) - sizes, sizes, distinct.indices.to_numpy())  # of each distinct piece
        begins = bounds[words.offsets.to_numpy()]
        ids, bounds = _gather(ids, begins[:-1], np.diff(begins), numbered.indices.to_numpy())
        return ids, bounds[pieces.offsets.to_numpy()]

    def _values(self, words: list[str]) -> list[bytes]:
        """The packed ids of distinct words, from the table as far as it has them."""
        if len(self.words) > self.limit:
            self.words.age()
        kept, older, make = self.words, self.words.old, self._word
        values = [kept.get(w) for w in words]
        for n, value in enumerate(values):
            if value is None:
                word = words[n]
                values[n] = kept[word] = older.get(word) or make(word)
        return values

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if plain(text):
            return self._plain(text)
        out, run = [], []
        for piece in text.split(" "):
            if plain(piece):
                run.append(piece)
                continue
            if run:
                out.append(self._plain(" ".join(run)))
                run = []
            got = self.pieces.get(piece)
            if got is None:
                got = self.whole(piece)
                if len(self.pieces) > 20_000:
                    self.pieces.clear()
                if len(piece) < 200:
                    self.pieces[piece] = got
            out.append(got)
        if run:
            out.append(self._plain(" ".join(run)))
        return b"".join(out)


def _gather(values: np.ndarray, begins: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs values[begin : begin + size] of the chosen numbers end to end, and their bounds."""
    sizes = sizes[which]
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    places = np.repeat(begins[which] - bounds[:-1], sizes)
    places += np.arange(len(places))
    return values[places], bounds


class _Table(dict):
    """Pieces without white space -> ids; ``old`` is the generation before."""

    def __init__(self, owner: WordEncoder):
        self.owner = owner
        self.old: dict[str, bytes] = {}

    def age(self) -> None:
        self.old = dict(self)
        self.clear()

    def __missing__(self, piece: str) -> bytes:
        value = self.old.get(piece)
        if value is None:
            if piece.isalpha() and plain(piece):
                value = self.owner._word(piece)
            elif not plain(piece):
                value = self.owner.whole(piece)
            else:
                words = _ASCII_WORDS if piece.isascii() else _WORDS
                parts = words.findall(piece)
                value = b"".join([self[w] if w != piece else self.owner._word(w) for w in parts])
        if len(piece) < 64:
            self[piece] = value
        return value


@lru_cache(maxsize=2)
def word_encoder(path: str, limit: int = 200_000) -> WordEncoder:
    """One for each worker process, vocabulary and size."""
    return WordEncoder(path, limit)
