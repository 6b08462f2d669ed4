"""Splitting a text by the public byte-level pattern, as the tokenizer libraries do."""

from __future__ import annotations

import re
from collections.abc import Callable

import regex

#: Entries of each of the two generations of a worker's memory of encoded pretokens, and letters of a pretoken that is remembered.
MEMO_ENTRIES, MEMO_LETTERS = 1 << 18, 48

#: White space by the Unicode property; Python's own `\s` also takes U+001C to U+001F.
_SPACE = r"\t-\r \x85\xa0  -     　"


def _pattern(letters: str, numbers: str) -> str:
    return (
        rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{numbers}]+| ?[^{_SPACE}{letters}{numbers}]+"
        rf"|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
    )


_ASCII = re.compile(_pattern("A-Za-z", "0-9"))
_LATIN = re.compile(_pattern("A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾"))
_FULL = regex.compile(_pattern(r"\p{L}", r"\p{N}"))


def pretokens(text: str) -> list[str]:
    """All pretokens of a text in order; joined, they are the text again."""
    if text.isascii():
        return _ASCII.findall(text)
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return _FULL.findall(text)
    return _LATIN.findall(text)


class PretokenMemo(dict):
    """Packed ids by pretoken; one that is not there comes from the generation before, or from `encode`."""

    def __init__(self, encode: Callable[[str], bytes]):
        self.encode, self.older = encode, {}

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            ids = self.encode(word)
        if len(word) <= MEMO_LETTERS:
            self[word] = ids
        return ids

    def text(self, text: str) -> bytes:
        """Ids of all pretokens of a text, joined; a full generation makes room first."""
        if len(self) > MEMO_ENTRIES:
            self.older = dict(self)
            self.clear()
        return b"".join(map(self.__getitem__, pretokens(text)))
