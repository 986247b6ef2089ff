"""Whole-text encoding with a public tokenizer file, one distinct piece of text at a time.

A text is cut where the tokenizer's own splitting rule always cuts, so encoding the parts
gives the ids of the whole. Each distinct part is encoded once per worker and kept in a
bounded table; texts are then put together from encoded parts.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from array import array

# Unicode white space, as the tokenizers' patterns understand it.
_SPACE = "\t-\r \x85\xa0  -     　"
# An optional blank and what follows it up to the next white space; else white space that
# leaves its last character to the next part; else white space.
_BLANK_FIRST = re.compile(f" ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
_WORDS = re.compile(f"[^{_SPACE}]+")

# Parts kept per worker, about 200 bytes each.
KEPT_PARTS = 1_000_000


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in plain}
    for b in range(256):
        if b not in letters:
            letters[b] = chr(256 + len(letters) - len(plain))
    return letters


_LETTERS = _byte_letters()


def _stays_a_letter(char: str) -> bool:
    """A letter that composing and lower-casing turn into one letter again."""
    return char.isascii() and char.isalpha() or (
        char.isalpha() and unicodedata.is_normalized("NFC", char) and len(char.lower()) == 1
    )


def vocabulary_size(path: str) -> int:
    """Ids run from 0 up to, not including, this number."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True)


class TextEncoder(dict):
    """Part of text -> its ids as unsigned 32-bit integers in the machine's byte order.

    Two kinds of byte-level BPE files are understood: those that keep white space in the
    ids (a blank belongs to the word behind it) and those that lower-case and drop it.
    With ``special``, the file's special strings in a text get their own ids, as a plain
    ``encode`` does; without, they are letters like all others.
    """

    def __init__(self, path: str, special: bool = False):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        drops_space = spec.get("normalizer") is not None
        if not drops_space and (spec.get("pre_tokenizer") or {}).get("type") != "ByteLevel":
            raise ValueError(f"{path}: neither of the byte-level kinds that can be cut at white space")
        self.special = {}
        if special:
            added = spec.get("added_tokens") or []
            if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added):
                raise ValueError(f"{path}: special strings that depend on what stands around them")
            self.special = {t["content"]: array("I", [t["id"]]).tobytes() for t in added}
        longest_first = sorted(self.special, key=len, reverse=True)
        self.cut = re.compile(f"({'|'.join(map(re.escape, longest_first))})").split if longest_first else None
        self.lower = drops_space
        self.merges = self.tokenizer.model.tokenize
        self.parts = (_WORDS if drops_space else _BLANK_FIRST).findall

    def __missing__(self, part: str) -> bytes:
        word, tail = part, b""
        # A letter and a comma or full stop behind it are never in one id.
        if len(part) > 1 and part[-1] in ".," and _stays_a_letter(part[-2]):
            word, tail = part[:-1], self[part[-1]]
        if self.lower and word.isascii():
            word = word.lower()
        if word != part and word in self:
            ids = self[word] + tail
        else:
            own = self._encode(word)
            if word != part:
                self._keep(word, own)
            ids = own + tail
        self._keep(part, ids)
        return ids

    def _keep(self, part: str, ids: bytes) -> None:
        if len(self) >= KEPT_PARTS:
            self.clear()
        self[part] = ids

    def _encode(self, part: str) -> bytes:
        word = part[1:] if not self.lower and part[0] == " " else part
        # Letters that normalising and splitting leave as they are go straight to the merges.
        if word.isascii():
            plain = word.isalpha()
        else:
            plain = word.isalpha() and (not self.lower or all(map(_stays_a_letter, word)) and word == word.lower())
        if not plain:
            return array("I", self.tokenizer.encode(part, add_special_tokens=False).ids).tobytes()
        if word is not part or not part.isascii():
            part = "".join(map(_LETTERS.__getitem__, part.encode()))
        return array("I", [t.id for t in self.merges(part)]).tobytes()

    def ids(self, text: str | None) -> bytes:
        """All ids of a text as little-endian unsigned 32-bit integers, null as empty."""
        if not text:
            return b""
        if self.cut is None:
            joined = b"".join([self[p] for p in self.parts(text)])
        else:
            joined = b"".join(
                [self.special[s] if s in self.special else b"".join([self[p] for p in self.parts(s)]) for s in self.cut(text)]
            )
        if sys.byteorder == "big":
            swapped = array("I", joined)
            swapped.byteswap()
            joined = swapped.tobytes()
        return joined


_ENCODERS: dict[tuple[str, bool], TextEncoder] = {}


def encoder(path: str, special: bool = False) -> TextEncoder:
    """The worker's encoder of a file, kept between tasks."""
    if (path, special) not in _ENCODERS:
        _ENCODERS[path, special] = TextEncoder(path, special)
    return _ENCODERS[path, special]
