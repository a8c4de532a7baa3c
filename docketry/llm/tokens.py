"""Token ids of whole texts with a public vocabulary, by a bounded cache of pieces per worker."""

from __future__ import annotations

import gc
import json
import unicodedata
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np

from . import common

#: Pieces of a generation of the cache; it keeps two, about 80 MB each. What is used goes to the younger.
CACHE_PIECES = 550_000
#: Longer pieces are encoded and not remembered.
LONG_PIECE = 40

_made: dict[str, "Pieces"] = {}


#: The printable stand-ins of byte-level vocabularies: byte -> character.
_shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = {b: chr(b) for b in _shown} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(_shown))}


class Remembered(dict):
    """A cache of two generations: where the younger is full it becomes the older, which is dropped."""

    def __init__(self, most: int | None = None) -> None:
        self.older: dict = {}
        self.most = most or CACHE_PIECES

    def __missing__(self, key):
        found = self.older.get(key)
        if found is None:
            found = self.make(key)
            if len(key) > LONG_PIECE:
                return found
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[key] = found
        return found


class Pieces(Remembered):
    """Piece of text -> its ids as little-endian unsigned 32-bit integers.

    A piece is cut where the vocabulary's own splitting rule must cut, so that its ids do not
    depend on its neighbours; texts for which that is not sure go to the library whole. A piece of
    letters alone is one unit of the splitting rule and goes to the library's merge model at once.
    """

    #: Marks that the splitting rules keep apart from letters; no apostrophe, which may join them.
    MARKS = ".,!?;:|#$%&*"

    def __init__(self, path: str, most: int | None = None) -> None:
        from tokenizers import Tokenizer

        super().__init__(most)
        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.octets = [i.to_bytes(4, "little") for i in range(self.library.get_vocab_size())]

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def letters(self, unit: str) -> bytes:
        """Ids of a unit of letters, which may have a space before it."""
        shown = unit if unit.isascii() and unit.isalpha() else unit.encode().decode("latin-1").translate(_BYTES)
        octets = self.octets
        return b"".join([octets[t.id] for t in self.model.tokenize(shown)])

    def ids(self, text: str) -> bytes:
        return self.whole(text)

    def plain(self, text: str) -> bool:
        return not any(s in text for s in self.special)


class WordPieces(Pieces):
    """For word_bpe: white space separates words and is dropped; letters, digits and marks split."""

    #: The units of the vocabulary's splitting rule: a fixed value of the file.
    UNITS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    #: White space to Python and not to the library.
    odd = "\x1c\x1d\x1e\x1f"

    def make(self, word: str) -> bytes:
        if word.isascii():
            if word.isalpha():
                return self.letters(word) if word.islower() else self[word.lower()]
        elif not unicodedata.is_normalized("NFC", word) or "\u0130" in word:
            return self.whole(word)
        elif word.isalpha():
            low = word.lower()
            # Beyond Latin, the library's lower case may differ from Python's.
            return self.letters(low) if max(low) < "\u0250" else self.whole(word)
        base = word.rstrip(self.MARKS)
        if base != word and base.isalpha():
            return self[base] + self[word[len(base):]]
        return self.whole(word)

    def ids(self, text: str) -> bytes:
        if not self.plain(text) or any(c in text for c in self.odd) or "\u0130" in text:
            return self.whole(text)  # a lower-case dotted I is two characters, which moves the library's units
        return b"".join(map(self.__getitem__, text.split()))


class _Odd(Exception):
    """White space meets white space: units may cross the cut."""


def _edged(piece: str) -> bool:
    return not piece or piece[0].isspace() or piece[-1].isspace()


class _Bare(Remembered):
    """Ids of pieces that no space precedes."""

    def __init__(self, spaced: BytePieces) -> None:
        super().__init__(spaced.most // 4)
        self.spaced = spaced

    def make(self, piece: str) -> bytes:
        if _edged(piece):
            raise _Odd
        base = piece.rstrip(Pieces.MARKS)
        if base.isalpha():
            return self.spaced.letters(base) + (self[piece[len(base):]] if base != piece else b"")
        return self.spaced.whole(piece)


class BytePieces(Pieces):
    """For byte_bpe: a space joins the word after it, so texts are cut into lines and before spaces.

    Keys are the words behind a space, without it.
    """

    def __init__(self, path: str, most: int | None = None) -> None:
        super().__init__(path, most)
        self.bare = _Bare(self)
        self.line_end = self.whole("\n")

    def make(self, word: str) -> bytes:
        if _edged(word):
            raise _Odd
        base = word.rstrip(self.MARKS)
        if base.isalpha():
            return self.letters(" " + base) if base == word else self[base] + self.bare[word[len(base):]]
        return self.whole(" " + word)

    def ids(self, text: str) -> bytes:
        if not text or not self.plain(text):
            return self.whole(text)
        spaced, bare, out = self.__getitem__, self.bare, []
        try:
            for line in text.split("\n"):
                words = line.split(" ")
                out.append(bare[words[0]])
                out.extend(map(spaced, words[1:]))
                out.append(self.line_end)
        except _Odd:
            return self.whole(text)
        out.pop()
        return b"".join(out)


def kind(path: str) -> type[Pieces]:
    """How a vocabulary file lets texts be cut, by the rules in it; any other is given whole texts."""
    with open(path, encoding="utf-8") as file:
        rules = json.load(file)
    plain = not rules["truncation"] and not rules["padding"] and rules["model"]["type"] == "BPE" and not rules["model"].get("ignore_merges")
    split, before = rules["pre_tokenizer"] or {}, [n["type"] for n in (rules["normalizer"] or {}).get("normalizers", [])]
    if plain and rules["normalizer"] is None and split.get("type") == "ByteLevel" and split["use_regex"] and not split["add_prefix_space"]:
        return BytePieces
    if plain and before == ["NFC", "Replace", "Lowercase"] and split.get("type") == "Sequence" and [p["type"] for p in split["pretokenizers"]] == ["Split", "ByteLevel"]:
        return WordPieces if split["pretokenizers"][0]["pattern"].get("Regex") == WordPieces.UNITS else Pieces
    return Pieces


@contextmanager
def without_collector() -> Iterator[None]:
    """Encoding makes no cycles of objects, and looking for some is a twentieth of its time."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


def encoder(path: str, most: int | None = None) -> Pieces:
    """The cached encoder of a vocabulary file; lives until the worker serves another operator.

    most: pieces of a generation of its cache.
    """
    common.only("tokens", _made.clear)
    if path not in _made:
        _made.clear()
        _made[path] = kind(path)(path, most)
    return _made[path]
