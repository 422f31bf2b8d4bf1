"""Repeated byte strings: equal windows meet by their rarest part, and suffix arrays find them exactly."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellsift.llm.suffixes import common_prefixes, suffix_array
from cellsift.llm.text import slices

#: Bytes of a string that counts as repeated, and of the parts by which windows meet.
LENGTH, GRAM = 200, 48
#: Bits of the sketch of the parts' frequencies, and of the bitmap of parts that stand in several places (16 MB).
SKETCH_BITS, SPOT_BITS, CHUNK = 18, 27, 1 << 10
#: Window starts that are looked at together, and bytes of text whose copies a worker drops.
BLOCK, SLICE = 1 << 19, 4 << 20
#: Bytes that a suffix array is made of, at least (one part's windows are never divided).
ARRAY = 3 << 17
#: Copies of each text's row in the last join.
SALTS = 16

_BASE = 0x9E3779B97F4A7C15
_MIX = (0x7FB5D329728EA185, 0xD6E8FEB86659FD93)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(_MIX[0])
    return (x ^ (x >> np.uint64(29))) * np.uint64(_MIX[1])


class Windows:
    """Hashes of the parts of a stretch of bytes, and the rarest part of each window."""

    def __init__(self, length: int, classes: np.ndarray | None = None):
        self.length, self.gram = length, max(1, min(GRAM, length // 3))
        self.span, self.classes = length - self.gram + 1, classes
        self.powers = self.inverses = np.zeros(0, dtype=np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.powers) < n:
            for name, base in (("powers", _BASE), ("inverses", pow(_BASE, -1, 1 << 64))):
                p = np.full(n, base, dtype=np.uint64)
                p[0] = 1
                setattr(self, name, np.multiply.accumulate(p))

    def grams(self, data: np.ndarray) -> np.ndarray:
        """A hash of the part at each place."""
        self._powers(len(data) + 1)
        total = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(7)) * self.powers[: len(data)], out=total[1:])
        return _mixed((total[self.gram:] - total[: -self.gram]) * self.inverses[: len(data) - self.gram + 1])

    def keys(self, data: np.ndarray) -> np.ndarray:
        """Order of the parts: rarer ones first, then by hash."""
        gram = self.grams(data)
        return (self.classes[gram >> np.uint64(64 - SKETCH_BITS)].astype(np.uint64) << np.uint64(58)) | (gram >> np.uint64(6))

    def _slide(self, x: np.ndarray, least) -> np.ndarray:
        size = 1
        n = len(x) - self.span + 1
        while size * 2 <= self.span:
            x = least(x[:-size], x[size:])
            size *= 2
        return least(x[:n], x[self.span - size: self.span - size + n])

    def first(self, keys: np.ndarray) -> np.ndarray:
        """The least key of each window."""
        return self._slide(keys, np.minimum)

    def chosen(self, keys: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Places whose part is the rarest one of some window."""
        edge = np.zeros(self.span - 1, dtype=np.uint64)
        return np.flatnonzero(self._slide(np.concatenate([edge, first, edge]), np.maximum) == keys)


def _data(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of an array of binaries without nulls, and where each begins (with the end at last)."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64, count=len(column) + 1, offset=8 * column.offset)
    if offsets[-1] == offsets[0]:
        return np.zeros(0, dtype=np.uint8), offsets - offsets[0]
    return np.frombuffer(column.buffers()[2], dtype=np.uint8)[offsets[0]: offsets[-1]], offsets - offsets[0]


def _blocks(column: pa.Array, length: int):
    """(row, place, bytes) of stretches of single texts that hold each window once; short texts have none."""
    data, offsets = _data(column)
    for row in np.flatnonzero(np.diff(offsets) >= length):
        begin, end = int(offsets[row]), int(offsets[row + 1])
        for at in range(begin, end - length + 1, BLOCK):
            yield int(row), at - begin, data[at: min(at + BLOCK + length - 1, end)]


def _together(column: pa.Array, length: int):
    """Texts of a slice as stretches (rows, places, bytes, sound): many short texts at once, long ones in blocks.

    ``rows`` and ``places`` give the text of each byte and its place there; ``sound`` says where a window starts that
    doesn't leave its text.
    """
    held, size = [], 0

    def joined():
        sizes = np.array([len(d) for _, _, d in held])
        rows = np.repeat([r for r, _, _ in held], sizes)
        step = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        sound = (np.repeat(sizes, sizes) - step >= length)[: int(sizes.sum()) - length + 1]
        return rows, np.repeat([p for _, p, _ in held], sizes) + step, np.concatenate([d for _, _, d in held]), sound

    for piece in _blocks(column, length):
        held.append(piece)
        size += len(piece[2])
        if size >= BLOCK:
            yield joined()
            held, size = [], 0
    if held:
        yield joined()


def _classes(texts: DataFrame, length: int) -> np.ndarray:
    """How much more frequent than the mean the parts of each bucket of hashes are, in powers of two."""

    def count(batches):
        total, windows = np.zeros(1 << SKETCH_BITS, dtype=np.int64), Windows(length)
        for part in slices(batches, "text", SLICE):
            for _, _, data, _ in _together(part.column(1), length):
                total += np.bincount((windows.grams(data) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(total))
        chunks = total.reshape(-1, CHUNK)
        at = np.flatnonzero(chunks.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array([chunks[i].tobytes() for i in at], pa.binary())], names=["chunk", "counts"])

    def add(batches):
        found = {}
        for batch in batches:
            for at, counts in zip(batch.column(0).to_pylist(), batch.column(1)):
                found[at] = found.get(at, 0) + np.frombuffer(counts.as_buffer(), dtype=np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array([v.tobytes() for v in found.values()], pa.binary())], names=["chunk", "counts"])

    out = "chunk int, counts binary"
    # One row per chunk of the sketch comes to the driver, a fixed number.
    rows = texts.mapInArrow(count, out).repartition("chunk").mapInArrow(add, out).collect()
    total = np.zeros((1 << SKETCH_BITS) // CHUNK * CHUNK, dtype=np.int64).reshape(-1, CHUNK)
    for row in rows:
        total[row["chunk"]] = np.frombuffer(bytes(row["counts"]), dtype=np.int64)
    mean = max(total.sum() / total.size, 1.0)
    return np.clip(np.floor(np.log2(np.maximum(total.ravel(), 1) / mean)), 0, 63).astype(np.uint8)


def _shared(texts: DataFrame, length: int, classes: np.ndarray) -> np.ndarray:
    """Bitmap of the windows' rarest parts that stand at several places of different texts or of one text."""

    def parts(batches):
        windows = Windows(length, classes)
        for part in slices(batches, "text", SLICE):
            marks = part.column(2).to_numpy(zero_copy_only=False).view(np.uint64)
            for rows, places, data, sound in _together(part.column(1), length):
                keys = windows.keys(data)
                at = windows.chosen(keys, np.where(sound, windows.first(keys), 0))
                place = _mixed(marks[rows[at]] ^ _mixed(places[at].astype(np.uint64) + np.uint64(1)))
                yield pa.RecordBatch.from_arrays([pa.array(keys[at].view(np.int64)), pa.array(place.view(np.int64))], names=["part", "place"])

    def spots(batches):
        for batch in batches:
            spot = _mixed(batch.column(0).to_numpy().view(np.uint64)) >> np.uint64(64 - SPOT_BITS)
            yield pa.RecordBatch.from_arrays([pa.array((spot >> np.uint64(6)).astype(np.int32)), pa.array((np.uint64(1) << (spot & np.uint64(63))).view(np.int64))], names=["at", "bits"])

    places = texts.mapInArrow(parts, "part long, place long").groupBy("part").agg(F.min("place").alias("a"), F.max("place").alias("b"))
    several = places.filter("a != b").select("part").mapInArrow(spots, "at int, bits long")
    # At most one row per 64 places of the bitmap comes to the driver.
    rows = several.groupBy("at").agg(F.bit_or("bits").alias("bits")).toPandas()
    out = np.zeros(1 << (SPOT_BITS - 6), dtype=np.uint64)
    out[rows["at"].to_numpy(dtype=np.int64)] = rows["bits"].to_numpy(dtype=np.int64).view(np.uint64)
    return out


def _segments(texts: DataFrame, length: int, classes: np.ndarray, shared: np.ndarray) -> DataFrame:
    """(part, owner, begin, stop, bytes): runs of windows with one rarest part that may be repeated elsewhere.

    Segments of equal bytes in a slice are repeated as a whole: they come without bytes, and only one goes on with them.
    Copies of a text within a slice are dropped.
    """

    def run(batches):
        windows = Windows(length, classes)
        for part in slices(batches, "text", SLICE):
            owners = part.column(0).to_pylist()
            once = list({o: i for i, o in reversed(list(enumerate(owners)))}.values())
            found, seen, twice = [], {}, set()
            for rows, places, data, sound in _together(part.column(1).take(pa.array(sorted(once))), length):
                first = windows.first(windows.keys(data))
                row = rows[: len(first)]
                edge = np.append(True, (first[1:] != first[:-1]) | (row[1:] != row[:-1]) | (sound[1:] != sound[:-1]))
                begin = np.flatnonzero(edge)
                stop = np.append(begin[1:], len(first)) + length - 1
                spot = _mixed(first[begin]) >> np.uint64(64 - SPOT_BITS)
                often = (shared[(spot >> np.uint64(6)).astype(np.int64)] >> (spot & np.uint64(63))) & np.uint64(1) == 1
                whole = data.tobytes()
                for k in np.flatnonzero(often & sound[begin]):
                    a, b = int(begin[k]), int(stop[k])
                    found.append((int(first[a].view(np.int64)), int(rows[a]), int(places[a]), whole[a:b]))
            keep = sorted(once)
            out = []
            for number, row, place, content in found:
                if content in seen:
                    twice.add(content)
                    out.append((number, owners[keep[row]], place, place + len(content), None))
                else:
                    seen[content] = True
                    out.append((number, owners[keep[row]], place, place + len(content), content))
            out += [(number, owner, begin, stop, None) for number, owner, begin, stop, content in out if content is not None and content in twice]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary()))],
                                                 names=["part", "owner", "begin", "stop", "bytes"])

    return texts.mapInArrow(run, "part long, owner binary, begin long, stop long, bytes binary")


def repeated_spans(pieces: list[tuple[bytes, int, bytes]], length: int) -> list[tuple[bytes, int, int]]:
    """(owner, begin, stop) of bytes in strings of ``length`` that start at several places of the given pieces.

    Pieces (owner, place, bytes) of one owner that overlap are joined, so that each place stands once.
    """
    runs = []
    for owner, begin, content in sorted(pieces, key=lambda p: p[:2]):
        if runs and runs[-1][0] == owner and begin <= runs[-1][1] + len(runs[-1][2]):
            runs[-1][2].extend(content[runs[-1][1] + len(runs[-1][2]) - begin:])
        else:
            runs.append((owner, begin, bytearray(content)))
    if len(runs) == 1 and len(runs[0][2]) <= length:
        return []
    sizes = np.array([len(r[2]) for r in runs])
    starts = np.cumsum(sizes + 1) - sizes - 1
    # 0 ends the text, 1 stands between pieces, bytes come after.
    text = np.append(np.frombuffer(b"\0".join(r[2] for r in runs), dtype=np.uint8).astype(np.uint16) + 2, 0).astype(np.uint16)
    text[starts[1:] - 1] = 1
    before, common = common_prefixes(text, suffix_array(text, 258))
    left = np.repeat(starts + sizes, sizes + 1) - np.arange(len(text))
    hit = np.flatnonzero((common >= length) & (left >= length))
    mark = np.zeros(len(text), dtype=bool)
    mark[hit] = mark[before[hit]] = True
    at = np.flatnonzero(mark)
    if not len(at):
        return []
    cut = np.flatnonzero(np.diff(at) > length)
    first, last = at[np.append(0, cut + 1)], at[np.append(cut, len(at) - 1)]
    run = np.searchsorted(starts, first, side="right") - 1
    return [(runs[r][0], runs[r][1] + a, runs[r][1] + b + length) for r, a, b in zip(
        run.tolist(), (first - starts[run]).tolist(), (last - starts[run]).tolist())]


def _spans(segments: DataFrame, length: int) -> DataFrame:
    """(owner, begin, stop) of repeated bytes: a suffix array for each lot of whole groups of one rarest part."""

    def run(batches):
        pieces, size, last = [], 0, None

        def solved(spans):
            if spans:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*spans), (pa.binary(), pa.int64(), pa.int64()))], names=["owner", "begin", "stop"])

        for batch in batches:
            ready = batch.filter(pc.is_null(batch.column(4)))
            if ready.num_rows:
                yield pa.RecordBatch.from_arrays([ready.column(i) for i in (1, 2, 3)], names=["owner", "begin", "stop"])
            rest = batch.filter(pc.is_valid(batch.column(4)))
            for number, owner, begin, content in zip(*(rest.column(i).to_pylist() for i in (0, 1, 2, 4))):
                if number != last and size >= ARRAY:
                    yield from solved(repeated_spans(pieces, length))
                    pieces, size = [], 0
                pieces.append((owner, begin, content))
                size, last = size + len(content), number
        if pieces:
            yield from solved(repeated_spans(pieces, length))

    return segments.repartition("part").sortWithinPartitions("part").mapInArrow(run, "owner binary, begin long, stop long")


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Texts without the bytes covered by repeated strings: (id, n_bytes, n_removed, n_spans, spans, kept), one row per row.

    A text is its UTF-8 bytes. Each byte goes that lies in a string of ``length`` bytes which also starts at another place,
    of this text or another one; strings are judged on the input. ``spans`` lists the maximal removed runs (begin, stop),
    ``kept`` the bytes that remain.

    Null texts are empty; shorter texts lose nothing. Rows of one text are copies: each loses all, if it has ``length``
    bytes. A null id is a value like others. An empty table gives an empty result. Other columns are not read.

    Each window of ``length`` bytes is named by the rarest part of 48 bytes in it, rarity coming from a sketch of
    all parts. Equal windows have equal names, so windows whose name occurs elsewhere are sent by name, with the bytes
    around them, and suffix arrays of whole groups of names find the equal ones. Parts of common passages name only windows
    that lie inside them, whose bytes are alike and meet before the shuffle. Texts are known by 128 bits of SHA-256.
    """
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    base = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    owned = base.select("id", "text", F.substring(F.unhex(F.sha2("text", 256)), 1, 16).alias("owner"))
    long_ones = base.filter(F.octet_length("text") >= length)
    classes = _classes(long_ones.select(F.lit(None).cast("binary").alias("owner"), "text"), length)
    shared = _shared(long_ones.select(F.lit(None).cast("binary").alias("owner"), "text", F.xxhash64("text").alias("mark")), length, classes)
    segments = _segments(owned.filter(F.octet_length("text") >= length).select("owner", "text"), length, classes, shared)
    spans = _spans(segments, length).groupBy("owner").agg(F.collect_set(F.struct("begin", "stop")).alias("spans"))
    copies = owned.filter(F.octet_length("text") >= length).groupBy("owner").agg(F.count("*").alias("n")).filter("n > 1").select("owner", F.lit(True).alias("copied"))
    facts = copies.join(spans, "owner", "full").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = owned.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(facts, ["owner", "salt"], "left").select(
        "id", "text", F.coalesce("copied", F.lit(False)).alias("copied"), "spans")

    def cut(batches):
        for part in slices(batches, "text", SLICE):
            out = []
            for content, copied, spans in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), part.column(3).to_pylist()):
                runs = []
                for a, b in [(0, len(content))] if copied and len(content) >= length else sorted((s["begin"], s["stop"]) for s in spans or ()):
                    if runs and a <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], b)
                    else:
                        runs.append([a, b])
                edges = [0, *(x for r in runs for x in r), len(content)]
                kept = b"".join(content[a:b] for a, b in zip(edges[::2], edges[1::2]))
                out.append((len(content), len(content) - len(kept), len(runs), [{"begin": a, "stop": b} for a, b in runs], kept))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("begin", pa.int64()), ("stop", pa.int64())])), pa.binary())
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(zip(*out), kinds))], names=result.names)

    result = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *(T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")),
                           T.StructField("spans", T.ArrayType(T.StructType([T.StructField("begin", T.LongType()), T.StructField("stop", T.LongType())]))), T.StructField("kept", T.BinaryType())])
    return rows.mapInArrow(cut, result)
