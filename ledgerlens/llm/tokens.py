"""Token ids of whole texts by a public tokenizer, with a per-worker cache of word ids.

A text is cut where no token can cross, the pieces are looked up, and unknown pieces go to the tokenizers
library. The cache lives in the Python worker across batches and tasks and holds at most ``CACHE`` pieces.
"""

from __future__ import annotations

import re
import sys
from array import array

from tokenizers import Tokenizer

CACHE = 1_000_000

#: A cut is safe only between two characters that nobody counts as white space.
_ODD_SPACE = "\\s\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f\u2060\u3000\ufeff"
_INNER_CUT = re.compile(f"(?<=[^{_ODD_SPACE}])(?= [^{_ODD_SPACE}])")
_RARE_SPACE = re.compile("[\0\t\x0b-\r\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f\u2060\u3000\ufeff]")
_RARE_ASCII = [chr(c) for c in (0, 9, 11, 12, 13, 28, 29, 30, 31)]


def _simple(text: str) -> bool:
    """Every white space is a single blank or line feed between two other characters."""
    if "  " in text or " \n" in text or "\n " in text or "\n\n" in text or text[:1] in " \n" or text[-1:] in " \n":
        return False
    if text.isascii():
        return not any(c in text for c in _RARE_ASCII)
    return _RARE_SPACE.search(text) is None



_ASCII_SPACES = re.compile("[ \t-\r]+")


def _printable_bytes() -> dict[int, int]:
    """The public byte-to-character table of byte-level BPE: printable bytes stand for themselves, the others
    follow from code point 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: b for b in plain} | {b: 256 + i for i, b in enumerate(rest)}


_PRINTABLE = _printable_bytes()


def _packed(ids: list[int]) -> bytes:
    out = array("H", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class WordIds(dict):
    """Piece of text -> its ids as little-endian unsigned 16-bit bytes."""

    def __init__(self, path: str, words: bool):
        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids over 65535 do not fit")
        self.model, self.words = self.tokenizer.model, words

    def __missing__(self, piece: str) -> bytes:
        ids = self._ids(piece)
        if len(self) < CACHE:
            self[piece] = ids
        return ids

    def _ids(self, piece: str) -> bytes:
        head, tail = piece[:-1], piece[-1:]
        if tail in (",", ".") and self._plain(head):
            return self[head] + self[tail]
        if self._plain(piece):  # one word of the pre-tokenizer: the model alone decides
            word = (piece.lower() if self.words else piece).encode().decode("latin-1").translate(_PRINTABLE)
            return _packed([t.id for t in self.model.tokenize(word)])
        return _packed(self.tokenizer.encode(piece, add_special_tokens=False).ids)

    def _plain(self, piece: str) -> bool:
        word = piece[1:] if piece[:1] == " " and not self.words else piece
        return word.isalpha() and max(word) < "\u0250" and (not self.words or word.lower().isalpha())

    def encode(self, text: str) -> bytes:
        """All ids of a text."""
        if self.words:
            return b"".join(map(self.__getitem__, _ASCII_SPACES.split(text)))
        if _simple(text):
            return b"".join(map(self.__getitem__, text.replace(" ", "\0 ").split("\0")))
        return b"".join(map(self.__getitem__, _INNER_CUT.split(text)))


_LOADED: dict[tuple[str, bool], WordIds] = {}


def byte_level(path: str) -> WordIds:
    """For byte-level BPE files: a blank belongs to the word after it."""
    if (path, False) not in _LOADED:
        _LOADED[path, False] = WordIds(path, words=False)
    return _LOADED[path, False]


def word_level(path: str) -> WordIds:
    """For lower-casing BPE files with word ends: white space is dropped."""
    if (path, True) not in _LOADED:
        _LOADED[path, True] = WordIds(path, words=True)
    return _LOADED[path, True]
