"""Token counts by the whole-token shortcut: strings proven to encode alone as one token are counted without merging."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import BYTE_PATTERN, Cutter, Vocabulary, letter_bytes
from .rows import map_columns, text_of

#: Merged pre-tokens whose counts a worker keeps, in two generations.
_KEPT = 400_000


def whole_tokens(vocabulary: Vocabulary, split: Cutter) -> list[str]:
    """The vocabulary strings that, as a text of their own, are one pre-token and encode as exactly their own id.

    This is the offline proof: every string is really cut and merged. A pre-token's ids depend on nothing but its
    string, so wherever a proven string occurs as a pre-token, it is one token.
    """
    back = letter_bytes()
    out = []
    for letters, i in vocabulary.ids.items():
        if letters in vocabulary.special or any(c not in back for c in letters):
            continue
        try:
            text = bytes(back[c] for c in letters).decode()
        except UnicodeDecodeError:
            continue
        if split(text) == [text] and vocabulary.encode(text) == [i]:
            out.append(text)
    return out


class Counts(dict):
    """Tokens of a pre-token. Proven strings stay; others are merged once and kept in a bounded memory."""

    def __init__(self, vocabulary: Vocabulary, proven: list[str]) -> None:
        super().__init__(dict.fromkeys(proven, 1))
        self._proven, self._vocabulary, self._old = proven, vocabulary, {}

    def __missing__(self, word: str) -> int:
        n = self._old.get(word)
        if n is None:
            n = len(self._vocabulary.encode(word))
        if len(self) >= _KEPT + len(self._proven):
            self._old = dict(self)
            self.clear()
            self.update(dict.fromkeys(self._proven, 1))
        self[word] = n
        return n


class Counter:
    def __init__(self, spec: str, proven: list[str]) -> None:
        self.vocabulary = Vocabulary(spec)
        self._counts = Counts(self.vocabulary, proven)
        self._split = Cutter(spec, BYTE_PATTERN, lower=False)

    def count(self, text: str) -> int:
        total = 0
        for piece in self.vocabulary.pieces(text):
            total += 1 if piece in self.vocabulary.special else sum(map(self._counts.__getitem__, self._split(piece)))
        return total


_counters: dict[int, Counter] = {}


def _counter(spec: str, proven: list[str]) -> Counter:
    key = hash(spec)
    if key not in _counters:
        _counters.clear()
        _counters[key] = Counter(spec, proven)
    return _counters[key]


def count_tokens(docs: DataFrame, vocabulary_file: str, limit: int = 1024, keys: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """Key columns, ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens) of every row.

    Whole texts are counted; special strings inside them are one token each, none are added. A null or empty text has
    zero bytes and tokens. One row comes out for each row that goes in, repeated rows and null keys included; other
    columns are not read. A map over batches without an exchange; the vocabulary and the list of proven strings, both
    fixed by the file, travel with the tasks once.
    """
    context = docs.sparkSession.sparkContext
    with open(vocabulary_file, encoding="utf-8") as f:
        spec = f.read()
    shared = context.broadcast((spec, whole_tokens(Vocabulary(spec), Cutter(spec, BYTE_PATTERN, lower=False))))

    def make(texts: pa.Array) -> dict[str, list]:
        counter = _counter(*shared.value)
        sizes, counts = [], []
        for value in texts:
            one = value.as_py()
            sizes.append(len(one) if one.isascii() else len(one.encode()))
            counts.append(counter.count(one))
        return {"n_bytes": sizes, "n_tokens": counts, "over_limit": [n > limit for n in counts]}

    return map_columns(docs, list(keys), text_of(text), make, "n_bytes long, n_tokens long, over_limit boolean")
