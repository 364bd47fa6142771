"""Texts to postings within a task, on Arrow batches: what the stored index is made of."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

#: Bytes of text that are grouped at once, and the most documents of one row of postings.
SLICE_BYTES, CHUNK = 16 << 20, 1024

_bits: dict[str, bytes] = {}


def letter_bits(spark: SparkSession) -> bytes:
    """A bit for each code point: is it a letter or one of 0 to 9 to the engine's regular expressions? (139 KB)"""
    key = spark.sparkContext.applicationId
    if key not in _bits:
        points = spark.range(0, 0x110000, 1, 8).where("id < 55296 or id > 57343")
        letter = F.expr("decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32')").rlike(r"^[\p{L}0-9]$")
        table = np.zeros(0x110000, dtype=bool)
        table[points.where(letter).toArrow()["id"].to_numpy()] = True
        _bits[key] = np.packbits(table).tobytes()
    return _bits[key]


def table_of(bits: bytes) -> np.ndarray:
    return np.unpackbits(np.frombuffer(bits, dtype=np.uint8)).astype(bool)


def cut(texts: pa.StringArray, table: np.ndarray) -> tuple[pa.StringArray, np.ndarray]:
    """The longest runs of letters and digits of all texts, one after another, and each text's number of them."""
    ends = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    b = np.frombuffer(data, dtype=np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, dtype=np.uint8)
    ends = ends - ends[0]
    ascii_ = table[:256].copy()
    ascii_[128:] = False
    keep = ascii_[b]
    lead = np.flatnonzero(b >= 0xC0)
    if lead.size:
        padded = np.concatenate([b, np.zeros(3, dtype=np.uint8)])
        first = b[lead].astype(np.int32)
        c1, c2, c3 = ((padded[lead + i] & 0x3F).astype(np.int32) for i in (1, 2, 3))
        point = np.where(first < 0xE0, (first & 0x1F) << 6 | c1, np.where(first < 0xF0, (first & 0x0F) << 12 | c1 << 6 | c2, (first & 0x07) << 18 | c1 << 12 | c2 << 6 | c3))
        good = table[np.minimum(point, 0x10FFFF)]
        at, first = lead[good], first[good]
        for i, least in enumerate((0, 0xC0, 0xE0, 0xF0)):
            keep[at[first >= least] + i] = True
    begins = keep.copy()
    begins[1:] &= ~keep[:-1]
    own = ends[:-1][ends[:-1] < ends[1:]]  # a text begins anew
    begins[own] = keep[own]
    starts = np.flatnonzero(begins)
    before = np.cumsum(keep)[starts] - 1
    kept = b[keep]
    offsets = np.append(before, kept.size).astype(np.int32)
    tokens = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(kept))
    return tokens, np.diff(np.searchsorted(starts, ends))


def cut_any(column: pa.Array, table: np.ndarray | None) -> tuple[pa.Array, np.ndarray]:
    """Texts are cut; without a table, the column has lists of tokens already."""
    if table is not None:
        return cut(column, table)
    return column.flatten(), np.diff(column.offsets.to_numpy()).astype(np.int64)


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in pieces of about SLICE_BYTES of its last column, a row at least."""
    column = batch.column(batch.num_columns - 1)
    sizes = np.diff(column.offsets.to_numpy()) * 8 if pa.types.is_list(column.type) else np.diff(np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1])
    piece = np.cumsum(sizes.astype(np.int64)) // SLICE_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), batch.num_rows]
    for a, z in zip(cuts, cuts[1:], strict=False):
        if z > a:
            yield batch.slice(a, z - a)


def grouped(ids: pa.Array, tokens: pa.Array, counts: np.ndarray) -> pa.RecordBatch:
    """Rows ``(term, n, total, docs, tfs, lens, offs)``: a term's documents, at most CHUNK in a row, with its number,
    their lengths and its offsets in each."""
    codes = tokens.dictionary_encode()
    counts = counts.astype(np.int64)
    document = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(len(tokens)) - np.repeat(np.cumsum(counts) - counts, counts)
    packed = codes.indices.to_numpy(zero_copy_only=False).astype(np.int64) << 32 | np.arange(len(tokens))
    packed.sort()
    order, code = packed & 0xFFFFFFFF, packed >> 32
    document, place = document[order], place[order].astype(np.int32)
    pair = np.flatnonzero(np.append(True, (code[1:] != code[:-1]) | (document[1:] != document[:-1])))
    of, doc = code[pair], document[pair]
    tf = np.diff(np.append(pair, len(tokens)))
    new = np.append(True, of[1:] != of[:-1])
    nth = np.arange(len(pair)) - np.flatnonzero(new)[np.cumsum(new) - 1]
    row = np.flatnonzero(nth % CHUNK == 0)
    at = pa.array(np.append(row, len(pair)).astype(np.int32))
    inner = pa.ListArray.from_arrays(pa.array(np.append(pair, len(tokens)).astype(np.int32)), pa.array(place))
    lists = [ids.take(pa.array(doc)), pa.array(tf.astype(np.int32)), pa.array(counts[doc].astype(np.int32)), inner]
    columns = [codes.dictionary.take(pa.array(of[row])), pa.array(np.diff(np.append(row, len(pair))).astype(np.int32)), pa.array(np.add.reduceat(tf, row).astype(np.int64))]
    return pa.RecordBatch.from_arrays(columns + [pa.ListArray.from_arrays(at, x) for x in lists], ["term", "n", "total", "docs", "tfs", "lens", "offs"])


def to_postings(bits: bytes | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow over ``(doc_id, text or terms)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = None if bits is None else table_of(bits)
        for batch in batches:
            for piece in slices(batch):
                tokens, counts = cut_any(piece.column(1), table)
                if len(tokens):
                    yield grouped(piece.column(0), tokens, counts)

    return run


def to_lengths(bits: bytes | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow over ``(doc_id, name, text or terms)``: the documents with their lengths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = None if bits is None else table_of(bits)
        for batch in batches:
            for piece in slices(batch):
                _, counts = cut_any(piece.column(2), table)
                yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), pa.array(counts.astype(np.int32))], ["doc_id", "name", "len"])

    return run


def to_grams(k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow over ``(term, cf)``: ``(gram, term, n, cf)``, a row for each distinct k-gram of the padded term; n:
    distinct ones of the term as it stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams: list[str] = []
            many, sizes = [], []
            for term in batch.column(0).to_pylist():
                padded = f"^{term}$"
                found = {padded[i : i + k] for i in range(len(padded) - k + 1)}
                grams += found
                many.append(len(found))
                sizes.append(len({term[i : i + k] for i in range(len(term) - k + 1)}))
            at = pa.array(np.repeat(np.arange(batch.num_rows), many))
            yield pa.RecordBatch.from_arrays([pa.array(grams, pa.string()), batch.column(0).take(at), pa.array(sizes, pa.int32()).take(at), batch.column(1).take(at)], ["gram", "term", "n", "cf"])

    return run
