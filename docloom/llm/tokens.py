"""Encoding with a public tokenizer, at the speed of a look-up for each word.

The tokenizers used here, byte-level BPE as it is or lower-cased with word
ends, never make a token that crosses from other characters into white space,
so a text can be cut before each run of white space and the parts encoded
alone. Parts repeat; their ids are kept in a table of bounded size in each
worker. Parts that are words go to the tokenizer's model at once, any others
through the whole tokenizer, and so do texts that hold an added token's string.
A lower-casing tokenizer drops white space: its texts are lower-cased as a
whole where that gives the same, so that a word is one entry of the table.
"""

from __future__ import annotations

import re
import unicodedata
from array import array

from tokenizers import Tokenizer

# white space as the tokenizers' patterns see it
_WS = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_parts = re.compile(f"[{_WS}]+[^{_WS}]*|[^{_WS}]+").findall
_words = re.compile(f"[^{_WS}]+").findall
_encoders: dict[tuple[str, int], "Encoder"] = {}

# byte-level models name bytes by characters: printable ones by themselves, the rest by those from 256 on
_PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
_NAMES = {b: chr(b) for b in _PRINTABLE} | {b: chr(256 + i) for i, b in enumerate(sorted({*range(256)} - _PRINTABLE))}


class Encoder(dict):
    """Ids of parts as little-endian unsigned 32-bit bytes, looked up or made."""

    def __init__(self, path: str, most: int) -> None:
        super().__init__()
        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.model, self.lowers = self.tokenizer.model, self.tokenizer.normalizer is not None
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def __missing__(self, part: str) -> bytes:
        if len(part) > 1 and part[-1] in ",." and part[-2].isalpha() and part[-2] != "İ":  # the mark is a token of its own; a lower-cased İ ends in one more
            ids = self[part[:-1]] + self[part[-1]]
        elif self.lowers and part[0] in " \n":
            ids = self[part[1:]] if len(part) > 1 else b""
        elif part[0] == "\n" and part[1:].isalpha():
            ids = self["\n"] + self[part[1:]]
        else:
            word = part[1:] if part[0] == " " else part
            if not word.isalpha() or "Σ" in word or not unicodedata.is_normalized("NFC", word):
                ids = self.whole(part)
            elif self.lowers and (low := word.lower()) != word:
                ids = self[low]
            else:
                ids = array("I", [t.id for t in self.model.tokenize(part.encode().decode("latin-1").translate(_NAMES))]).tobytes()
        self[part] = ids
        return ids

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, text: str | None) -> bytes:
        text = text or ""
        if len(self) > self.most:
            self.clear()
        for mark in self.added:
            if mark in text:
                return self.whole(text)
        if self.lowers and "Σ" not in text and "İ" not in text and unicodedata.is_normalized("NFC", text):
            return b"".join(map(self.__getitem__, _words(text.lower())))
        return b"".join(map(self.__getitem__, _parts(text)))


def encoder(path: str, most: int = 600_000) -> Encoder:
    """The worker's own encoder for this vocabulary file; most bounds its table."""
    if (path, most) not in _encoders:
        _encoders[path, most] = Encoder(path, most)
    return _encoders[path, most]
