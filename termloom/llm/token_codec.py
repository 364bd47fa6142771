"""Encoding and decoding with a word-end byte-pair vocabulary; merges come from a segment tree over pair ranks."""

from __future__ import annotations

from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import WORD_PATTERN, Cutter, Vocabulary
from .rows import map_columns, text_of

#: Words whose ids a worker keeps, in two generations: bounded memory (28 MB for both), and frequent words survive.
_KEPT = 100_000


class Codec:
    """Encoder and decoder of one worker, with a bounded memory of words it has merged."""

    def __init__(self, spec: str) -> None:
        self.vocabulary = Vocabulary(spec)
        self._words = Cutter(spec, WORD_PATTERN, lower=True)
        self._young: dict[str, str] = {}
        self._old: dict[str, str] = {}
        #: token string by decimal id: what decoding joins with blanks, as the file names no decoder
        self._token = {str(i): t for i, t in self.vocabulary.tokens.items()}

    def _word(self, word: str) -> str:
        found = self._old.get(word)
        if found is None:
            found = " ".join(map(str, self.vocabulary.encode(word)))
        if len(self._young) >= _KEPT:
            self._old, self._young = self._young, {}
        self._young[word] = found
        return found

    def encode(self, text: str) -> str:
        """The decimal ids, joined by one blank."""
        parts: list[str] = []
        for piece in self.vocabulary.pieces(text):
            if piece in self.vocabulary.special:
                parts.append(str(self.vocabulary.special[piece]))
                continue
            for word in self._words(piece):
                found = self._young.get(word)
                parts.append(self._word(word) if found is None else found)
        return " ".join(parts)

    def decode(self, ids: str) -> str:
        return " ".join(map(self._token.__getitem__, ids.split(" "))) if ids else ""


_codecs: dict[int, Codec] = {}


def _codec(spec: str) -> Codec:
    key = hash(spec)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(spec)
    return _codecs[key]


_OUTPUTS = {"n_tokens": "long", "ids": "array<int>", "decoded": "string", "ids_sha256": "string", "decoded_sha256": "string"}


def encode_documents(docs: DataFrame, vocabulary_file: str, outputs: tuple[str, ...] = ("ids", "decoded"), keys: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """Encode every whole text and decode it again; returns the key columns and the wanted ``outputs``.

    ``outputs``: ``n_tokens``, ``ids``, ``decoded``, and the SHA-256 of the decimal ids joined by blanks
    (``ids_sha256``) and of the decoded text (``decoded_sha256``). Special strings inside a text are special tokens;
    none are added. A null or empty text has no ids and decodes to the empty text. One row comes out for each row that
    goes in, repeated rows and null keys included; other columns are not read. Work on a text is near linear in its
    length, also for very long words, as a merge costs a logarithm of the word's length.

    No exchange: a map over batches. The vocabulary (its size is fixed by the file) travels with the tasks once.
    """
    spark = docs.sparkSession
    with open(vocabulary_file, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())

    def make(texts: pa.Array) -> dict[str, list]:
        codec = _codec(spec.value)
        out: dict[str, list] = {name: [] for name in outputs}
        for value in texts:
            ids = codec.encode(value.as_py())
            decoded = codec.decode(ids) if "decoded" in out or "decoded_sha256" in out else ""
            for name, column in out.items():
                if name == "n_tokens":
                    column.append(ids.count(" ") + 1 if ids else 0)
                elif name == "ids":
                    column.append([int(i) for i in ids.split(" ")] if ids else [])
                elif name == "decoded":
                    column.append(decoded)
                elif name == "ids_sha256":
                    column.append(sha256(ids.encode()).hexdigest())
                else:
                    column.append(sha256(decoded.encode()).hexdigest())
        return out

    added = ", ".join(f"{name} {_OUTPUTS[name]}" for name in outputs)
    return map_columns(docs, list(keys), text_of(text), make, added)
