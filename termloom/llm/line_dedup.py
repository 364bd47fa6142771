"""Fuzzy line deduplication: MinHash bands propose, exact Jaccard decides, union-find keeps one line a component."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .rows import join_spread, pieces, size_of, text_of
from .scratch import Scratch
from .settle import distinct, settle

SHINGLE = 5  # characters: a line of 49 or more with one letter changed, of 80 or more with a short word, is still alike
LIKENESS = 0.8
#: Bands of BAND_ROWS out of ROWS minima, any two bands with two in common at most: a pair of likeness 0.8 is missed with
#: probability 2.2 %, one of 0.85 with 0.4 %, one of 0.9 with 0.02 %.
ROWS, BANDS, BAND_ROWS = 48, 16, 6
_BLOCK = 1 << 15  # characters signed at once: they stay in the processor's cache
_BLOOM_BITS = 27
_PART_BYTES = 1 << 20  # of the table, for each part that its bands are dealt into


def _design(rows: int, bands: int, width: int) -> np.ndarray:
    """Which minima make up each band: every one equally often, and any two bands have as few in common as a hundred
    draws allow."""
    rng = np.random.default_rng(20)
    best, least = None, width + 1
    for _ in range(100):
        drawn = np.concatenate([rng.permutation(rows) for _ in range(-(-bands * width // rows))])[: bands * width].reshape(bands, width)
        common = [len(np.intersect1d(drawn[i], drawn[j])) for i in range(bands) for j in range(i)]
        if all(len(set(b)) == width for b in drawn) and max(common) < least:
            best, least = drawn, max(common)
    return best


_MULTIPLY = np.random.default_rng(20).integers(0, 2**32, ROWS, dtype=np.uint32) | np.uint32(1)
_OF_BAND = _design(ROWS, BANDS, BAND_ROWS)


def normal(line: str) -> str:
    """Lower case, runs of white space as one blank. Lines that come out empty are blank."""
    return _single_blanks(line.lower())


def _single_blanks(line: str) -> str:
    # the only white space in a printable string is the blank
    return line.strip(" ") if line.isprintable() and "  " not in line else " ".join(line.split())


def line_hash(normalised: str) -> int:
    h = xxhash.xxh3_64_intdigest(normalised)
    return h - (1 << 64) if h >> 63 else h


def shingle_hashes(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of every line's character shingles, in order and with repeats, and how many each line has. A line
    shorter than a shingle is one shingle."""
    lines = [x.ljust(SHINGLE, "\0") for x in lines]
    joined = "".join(lines)
    c = np.frombuffer(joined.encode(), np.uint8) if joined.isascii() else np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    c = c.astype(np.uint64)
    sizes = np.fromiter(map(len, lines), np.int64, len(lines))
    h = c[: len(c) - SHINGLE + 1].copy()
    for i in range(1, SHINGLE):
        h *= np.uint64(0x9E3779B97F4A7C15)
        h += c[i : i + len(h)]
    # shingles that would reach into the next line go
    inside = np.ones(len(h), bool)
    ends = np.cumsum(sizes)[:-1]
    for i in range(1, SHINGLE):
        inside[ends - i] = False
    h = h[inside]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h, sizes - SHINGLE + 1


def shingle_sets(lines: list[str]) -> np.ndarray:
    """The lines' numbered distinct shingles."""
    h, sizes = shingle_hashes(lines)
    return h, sizes


def band_keys(lines: list[str]) -> np.ndarray:
    """64-bit keys, lines x BANDS, of the MinHash signatures of the lines' character shingles; the lowest four bits are
    the band's number."""
    minima = np.empty((ROWS, len(lines)), np.uint32)
    start = 0
    while start < len(lines):
        stop, size = start, 0
        while stop < len(lines) and (stop == start or size + len(lines[stop]) < _BLOCK):
            size += max(SHINGLE, len(lines[stop]))
            stop += 1
        minima[:, start:stop] = _minima(lines[start:stop])
        start = stop
    keys = np.empty((len(lines), BANDS), np.uint64)
    for band, rows in enumerate(_OF_BAND):
        key = np.full(len(lines), band + 1, np.uint64)
        for row in rows:
            key ^= minima[row]
            key *= np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(32)
        keys[:, band] = (key << np.uint64(4)) | np.uint64(band)
    return keys


def _minima(lines: list[str]) -> np.ndarray:
    """ROWS minima of each line, of a block of lines or of one long line a block at a time."""
    if len(lines) == 1 and len(lines[0]) > 2 * _BLOCK:
        line = lines[0]
        return np.minimum.reduce([_minima([line[i : i + _BLOCK + SHINGLE - 1]]) for i in range(0, len(line) - SHINGLE + 1, _BLOCK)])
    h, sizes = shingle_hashes(lines)
    h = (h >> np.uint64(32)).astype(np.uint32)
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    out = np.empty((ROWS, len(lines)), np.uint32)
    order = np.empty_like(h)
    for row in range(ROWS):
        np.multiply(h, _MULTIPLY[row], out=order)
        np.minimum.reduceat(order, first, out=out[row])
    return out


def _lines_of(texts: pa.Array) -> Iterator[tuple[int, int, str]]:
    """Row, position and normal form of every line that is not blank."""
    for row, text in enumerate(texts.to_pylist()):
        text = text.lower()
        single = "  " not in text
        for at, line in enumerate(text.split("\n")):
            if n := line.strip(" ") if single and line.isprintable() else _single_blanks(line):
                yield row, at, n


_PACKED = "part int, blob binary"
_GROUP = "key long, node long, leader long"


def _scan(parts: int):
    """Some of a piece's distinct lines with their bands' keys, packed, for each of the parts that the bands are dealt
    into.

    Lines of the piece that share a band are put together here: the least becomes their leader and alone goes on to meet
    other pieces; the others' rows are ready and stay where they are, as part -1, along with a row of key 0 for each line
    that the piece repeats. So a hot band, or a hot line, leaves a piece as one row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            names, again = {}, set()
            for _, _, n in _lines_of(batch.column("_text")):
                h = line_hash(n)
                if h in names:
                    again.add(h)
                names[h] = n
            if names:
                packed = _pack(np.fromiter(names, np.int64, len(names)), band_keys(list(names.values())), np.array(list(again), np.int64), parts)
                yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in packed], pa.int32()), pa.array([b for _, b in packed], pa.binary())], ["part", "blob"])

    return run


def _led(key: np.ndarray, line: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The rows by key, with where each key begins and with the least line of the key."""
    order = np.argsort(key)
    key, line = key[order], line[order]
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    least = np.minimum.reduceat(line, starts)
    return key, line, starts, np.repeat(least, np.diff(np.append(starts, len(key))))


def _pack(lines: np.ndarray, keys: np.ndarray, again: np.ndarray, parts: int) -> list[tuple[int, bytes]]:
    key, line, starts, leader = _led(keys.ravel(), np.repeat(lines, BANDS))
    out = []
    # all members of a band that has several
    below = np.repeat(np.diff(np.append(starts, len(key))) > 1, np.diff(np.append(starts, len(key))))
    if below.any() or len(again):
        ready = [(key[below].view(np.int64), np.zeros(len(again), np.int64)), (line[below], again), (leader[below], again)]
        out.append((-1, b"".join(x.tobytes() for column in ready for x in column)))
    key, line = key[starts], leader[starts]
    # parts are ranges of the key's upper half
    part = ((key >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
    cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
    for a, b in zip(cuts, [*cuts[1:], len(part)], strict=True):
        out.append((int(part[a]), key[a:b].tobytes() + line[a:b].tobytes()))
    return out


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed rows, sorted by part, to the groups of two or more lines that share a band; the least line leads. A line
    that several pieces have comes with key 0."""

    def group(blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        key, line = np.concatenate([np.frombuffer(b, np.int64).reshape(2, -1) for b in blobs], axis=1)
        key, line, starts, leader = _led(key.view(np.uint64), line)
        size = np.diff(np.append(starts, len(key)))
        keep = np.repeat(size > 1, size)
        if not keep.any():
            return
        lines = np.repeat(np.maximum.reduceat(line, starts) != leader[starts], size)[keep]
        key, line, leader = key[keep], line[keep], leader[keep]
        order = np.lexsort((line, key))
        key, line, leader, lines = key[order], line[order], leader[order], lines[order]
        same = np.concatenate([[False], (key[1:] == key[:-1]) & (line[1:] == line[:-1])])
        mark = line[same & (key & np.uint64(15) == 0)]  # every band shows a repeat: one tells it
        other = ~same & lines
        yield from rows([(key[other].view(np.int64), np.zeros(len(mark), np.int64)), (line[other], mark), (leader[other], mark)])

    def rows(columns: list[tuple]) -> Iterator[pa.RecordBatch]:
        key, node, leader = map(np.concatenate, columns)
        if len(key):
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(node), pa.array(leader)], ["key", "node", "leader"])

    last, held = None, []
    for batch in batches:
        for part, blob in zip(batch.column("part").to_pylist(), batch.column("blob"), strict=True):
            if part < 0:
                yield from rows([(x,) for x in np.frombuffer(blob.as_py(), np.int64).reshape(3, -1)])
                continue
            if part != last and held:
                yield from group(held)
                held = []
            last = part
            held.append(blob.as_py())
    if held:
        yield from group(held)


def _wanted_lines(words, kind: StructType):
    """Places of lines that may be wanted, by a bit table of fixed size, each line's normal form once a piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(kind)
        bits = words.value
        for batch in pieces(batches):
            lines = list(_lines_of(batch.column("_text")))
            if not lines:
                continue
            h = np.fromiter((line_hash(n) for *_, n in lines), np.int64, len(lines))
            at = h & ((1 << _BLOOM_BITS) - 1)
            keep = np.flatnonzero((bits[at >> 5] >> (at & 31).astype(np.uint32)) & np.uint32(1) == 1)
            if len(keep):
                first = np.zeros(len(keep), bool)
                first[np.unique(h[keep], return_index=True)[1]] = True
                rows = [lines[i] for i in keep]
                columns = [batch.column("doc").take(pa.array([r for r, *_ in rows])), pa.array([a for _, a, _ in rows]), pa.array(h[keep])]
                columns.append(pa.array([n if f else None for (*_, n), f in zip(rows, first, strict=True)], pa.string()))
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return run


def line_groups(texts: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """``(key, node, leader)``: the groups of two or more lines, by hash, that share a band, every member with one that
    leads it (and once more where it leads others itself); and ``(node)``: lines that occur again."""
    parts = max(64, min(1 << 30, size_of(texts) // _PART_BYTES))
    packed = texts.mapInArrow(_scan(parts), _PACKED)
    # ready rows stay evenly dealt; the others meet by part
    deal = F.when(F.col("part") >= 0, F.col("part")).otherwise(F.xxhash64("blob"))
    met = scratch.save(packed.withColumn("deal", deal).repartition("deal").sortWithinPartitions("part").select("part", "blob").mapInArrow(_meet, _GROUP))
    return met.where("key <> 0"), met.where("key = 0").select("node")


def _bit_table(nodes: DataFrame) -> np.ndarray:
    """16 MB whatever the corpus: with very many lines it filters less, but stays right. Its words reach the driver as
    Arrow batches, 8 bytes each and 4 million at most, never as Python rows."""
    mask = F.col("node").bitwiseAND((1 << _BLOOM_BITS) - 1)
    bit = F.call_function("shiftleft", F.lit(1), mask.bitwiseAND(31).cast("int"))
    words = nodes.groupBy(F.shiftright(mask, 5).cast("int").alias("w")).agg(F.bit_or(bit).alias("b")).toArrow()
    table = np.zeros(1 << (_BLOOM_BITS - 5), np.uint32)
    for batch in words.to_batches():
        table[batch.column("w").to_numpy()] = batch.column("b").to_numpy().view(np.uint32)
    return table


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", name: str = "lines") -> DataFrame:
    """All columns of ``docs`` with ``text`` cleaned, and ``n_lines`` and ``n_dropped`` (lines that are not blank).

    Lines are compared in their normal form (lower case, single blanks). Equal lines, and lines whose sets of
    five-character shingles have a Jaccard likeness of 0.8 or more, are linked; of every component of links only the
    first occurrence stays: the one with the least key, then the earliest line. Blank lines always stay.

    A null text stays null, an empty one empty; a document may come out without lines. Rows that share a key count as
    one document (repeated rows are cleaned alike); rows with a null key count as coming last. Other columns pass
    through, but ``n_lines`` and ``n_dropped`` replace columns of that name. An empty table stays empty. Texts and lines
    of any length are read whole: a line takes about 40 bytes a character while its shingles are compared.

    Lines are known by a 64-bit hash. One exchange deals the bands (16 bytes each, packed) and one the texts, to meet the
    list of their dropped lines; only lines that share a band or occur again are written. Counts and a fixed bit table
    reach the driver, no lines, links or components.
    """
    scratch, inner = Scratch(docs.sparkSession, name), Scratch(docs.sparkSession, f"{name}-groups")
    docs = docs.drop("n_lines", "n_dropped")
    texts = docs.select(F.col(key).alias("doc"), text_of(text).alias("_text"))
    groups, repeats = line_groups(texts.select("_text"), inner)
    nodes = inner.save(groups.select("node").distinct())
    bits = docs.sparkSession.sparkContext.broadcast(_bit_table(nodes.unionByName(repeats)))
    wanted = StructType([StructField("doc", docs.schema[key].dataType), *StructType.fromDDL("at int, line long, name string").fields])
    seen = scratch.save(texts.mapInArrow(_wanted_lines(bits, wanted), wanted))
    bits.destroy()
    names = seen.where("name is not null").select(F.col("line").alias("node"), F.col("name").alias("text"))
    roots = settle(groups, inner.save(names.join(nodes, "node", "left_semi").dropDuplicates(["node"])), shingle_hashes, LIKENESS, inner)

    occurrences = seen.select("doc", "at", "line")
    order = F.struct(F.col("doc").isNull().alias("last"), "doc", "at")
    lines = occurrences.groupBy("line").agg(F.min(order).alias("first"), F.count("*").alias("n"))
    rooted = scratch.save(lines.join(roots, lines["line"] == roots["node"], "left").select("line", "first", "n", F.coalesce("root", "line").alias("root")))
    inner.clear()
    tops = rooted.groupBy("root").agg(F.min("first").alias("top"), F.sum("n").alias("total"), F.count("*").alias("lines")).where("total > 1")
    tops = scratch.save(tops)
    counts = rooted.agg(F.count("*").alias("lines"), F.sum("n").alias("n")).first()
    # lines that occur again or hang together with others; hot lines and roots are few and travel to all tasks
    again = scratch.save(join_spread(rooted.select("line", "n", "root"), tops.select("root", "top", "lines"), "root", "lines", counts["lines"]))
    drops = join_spread(occurrences, again.select("line", "n", "top"), "line", "n", counts["n"] or 0)
    drops = drops.where(~(F.col("doc").eqNullSafe(F.col("top.doc")) & (F.col("at") == F.col("top.at"))))
    # a list belongs to one document and is no longer than its lines
    lists = drops.groupBy("doc").agg(F.collect_set(F.struct("at", "line")).alias("_drops"))
    row = docs.select(F.struct("*").alias("_row"), F.col(key).alias("_doc"))
    joined = row.join(lists, F.col("_doc").eqNullSafe(F.col("doc")), "left").select("_row", "_drops")
    out = StructType([*docs.schema.fields]).add("n_lines", "integer").add("n_dropped", "integer")
    return joined.mapInArrow(_clean(out, text), out)


def _clean(out: StructType, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(out)
        at_text = schema.get_field_index(text)
        for batch in pieces(batches):
            columns = batch.column("_row").flatten()
            texts, sizes, dropped = [], [], []
            lists = batch.column("_drops")
            ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy())
            places, hashes = (x.to_pylist() for x in lists.flatten().flatten())
            start = 0
            for one, end in zip(columns[at_text].to_pylist(), ends.tolist(), strict=True):
                lines = [] if one is None else one.split("\n")
                gone = {at for at, h in zip(places[start:end], hashes[start:end], strict=True) if at < len(lines) and (n := normal(lines[at])) and line_hash(n) == h}
                start = end
                sizes.append(sum(not x.isspace() for x in lines if x))
                dropped.append(len(gone))
                texts.append("\n".join(x for i, x in enumerate(lines) if i not in gone) if gone else one)
            columns[at_text] = pa.array(texts, pa.string())
            columns += [pa.array(sizes, pa.int32()), pa.array(dropped, pa.int32())]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return run
