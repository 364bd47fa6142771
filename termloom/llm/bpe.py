"""Byte-pair merging by a segment tree, and the tables read from a tokenizer file of the public JSON format."""

from __future__ import annotations

import json
import re
from functools import lru_cache


@lru_cache(1)
def byte_letters() -> tuple[str, ...]:
    """The printable letter of every byte: bytes that print stand for themselves, the others follow from U+0100."""
    plain = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAC + 1), *range(0xAE, 0xFF + 1)}
    extra = iter(range(256, 512))
    return tuple(chr(b) if b in plain else chr(next(extra)) for b in range(256))


@lru_cache(1)
def letter_bytes() -> dict[str, int]:
    return {letter: b for b, letter in enumerate(byte_letters())}


def merge_symbols(symbols: list[int], ranks: dict[tuple[int, int], int], made: list[int]) -> list[int]:
    """Merge the lowest-ranked, leftmost adjacent pair until none is left.

    ``ranks``: pair to rank; ``made``: the new symbol of each rank. A segment tree stands over the pairs: the leaf of
    position i holds ``rank * n + i`` of the pair that starts there, or ``none`` where nothing can merge, and every
    inner node the smaller of its two children, so that the root is the next merge. A merge changes at most three
    leaves, each at logarithmic cost.
    """
    n = len(symbols)
    if n < 2:
        return symbols
    none = len(made) * n
    get = ranks.get
    base = 1 << (n - 1).bit_length()
    tree = [none] * (2 * base)
    any_pair = False
    for i, pair in enumerate(zip(symbols, symbols[1:], strict=False)):
        if (r := get(pair)) is not None:
            tree[base + i] = r * n + i
            any_pair = True
    if not any_pair:
        return symbols
    for i in range(base - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a < b else b

    def put(at: int, value: int) -> None:
        at += base
        if tree[at] == value:
            return
        tree[at] = value
        while at > 1:
            other = tree[at ^ 1]
            if other < value:
                value = other
            at >>= 1
            if tree[at] == value:
                return
            tree[at] = value

    symbols = list(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    while (top := tree[1]) != none:
        rank, i = divmod(top, n)
        j = after[i]
        symbols[i] = new = made[rank]
        symbols[j] = -1
        after[i] = k = after[j]
        put(j, none)
        if k < n:
            before[k] = i
            r = get((new, symbols[k]))
            put(i, none if r is None else r * n + i)
        else:
            put(i, none)
        if (h := before[i]) >= 0:
            r = get((symbols[h], new))
            put(h, none if r is None else r * n + h)
    return [s for s in symbols if s >= 0]


class Vocabulary:
    """Vocabulary, merges and special strings of one file. Small (a few MB, fixed by the file), so it may be broadcast."""

    def __init__(self, text: str) -> None:
        spec = json.loads(text)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.tokens = {i: t for t, i in self.ids.items()}
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.tokens.update({i: t for t, i in self.special.items()})
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.ranks = {(self.ids[a], self.ids[b]): rank for rank, (a, b) in enumerate(pairs)}
        self.made = [self.ids[a + b] for a, b in pairs]
        #: the symbol of each byte, inside a word and at its end
        self.inner = [self.ids[x] for x in byte_letters()]
        self.last = [self.ids[x + self.suffix] for x in byte_letters()]
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def encode(self, word: str) -> list[int]:
        """The ids of one pre-token: its UTF-8 bytes, the last with the end-of-word mark, merged."""
        if not word:
            return []
        data = word.encode()
        symbols = [self.inner[b] for b in data]
        symbols[-1] = self.last[data[-1]]
        return merge_symbols(symbols, self.ranks, self.made)

    def pieces(self, text: str) -> list[str]:
        """The text cut at special strings, which stay as pieces of their own."""
        if self.split_special is None or not any(s in text for s in self.special):
            return [text]
        return [p for p in self.split_special.split(text) if p]


#: Pre-tokens of the word-end vocabulary, fixed pattern: {L}, {N} and {S} stand for letters, numbers, white space.
WORD_PATTERN = r"[{L}]+|'(?:s|t|re|ve|m|ll|d)|[{N}]|[^{S}{L}{N}]+"
#: Pre-tokens of the byte-level vocabulary, fixed pattern.
BYTE_PATTERN = r" ?[{L}]+|'(?:s|t|re|ve|m|ll|d)| ?[{N}]+| ?[^{S}{L}{N}]+|[{S}]+(?![^{S}])|[{S}]+"

#: White space, letters and numbers up to U+017F, fixed values.
_LOW = {"S": r"\t-\r \x85\xa0", "L": r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ſ", "N": r"0-9\xb2\xb3\xb9\xbc-\xbe"}


class Cutter:
    """Normalises and cuts a text into pre-tokens.

    Texts up to U+017F (and U+2010 to U+2027) are in normal form as they are and take a plain pattern. Others go through
    the library's own normaliser and pre-tokenizer, whose Unicode tables are not Python's; merging is done here alike.
    """

    def __init__(self, spec: str, pattern: str, lower: bool) -> None:
        for name, letters in _LOW.items():
            pattern = pattern.replace("{" + name + "}", letters)
        self._find, self._lower = re.compile(pattern).findall, lower
        self._high = re.compile("[^\x00-ſ‐-‧]").search
        self._spec, self._library = spec, None

    def __call__(self, text: str) -> list[str]:
        if text.isascii() or not self._high(text):
            return self._find(text.lower() if self._lower else text)
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_str(self._spec)
        if self._library.normalizer is not None:
            text = self._library.normalizer.normalize_str(text)
        back = letter_bytes()
        return [bytes(back[c] for c in letters).decode() for letters, _ in self._library.pre_tokenizer.pre_tokenize_str(text)]
