"""Phrase collocations: lossless counts in counting quotient filters, then the weakest cut's association score."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cellsift.llm import quotient
from cellsift.llm.quotient import Layout
from cellsift.llm.text import distinct, slices
from cellsift.operators.running import running
from cellsift.session import durable

#: Words that every worker has at hand with their ids, at most; other words meet their ids in a join.
COMMON = 1 << 17
#: Bits of the bitmap of possible phrases (a fixed 8 MB however many there are).
SPOT_BITS = 26
#: Words of text whose phrases a worker counts at once, and keys that wait for a merge.
WORDS, PENDING = 1 << 21, 1 << 21
#: Occurrences for which a shard of the filters is made.
SHARD = 1 << 21
#: Bytes of text that are cut into words at once.
SLICE = 4 << 20
#: Copies of the smaller side of a join whose keys may be hot.
SALTS = 16

# 0: part of a word, 1: between words, 2: between pieces.
_KIND = np.zeros(256, dtype=np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"): ord("Z") + 1] += 32


def _stretches(data: np.ndarray, ends: np.ndarray, limit: int):
    """Bounds of stretches of about ``limit`` bytes that end with a text or between pieces."""
    at = 0
    while at < len(data):
        stop = at + limit
        if stop < len(data):
            text = int(ends[np.searchsorted(ends, stop)])
            # The text may go on for long: the next end of a piece will do.
            while stop < text and not (found := np.flatnonzero(_KIND[data[stop: stop + limit]] == 2)).size:
                stop = min(stop + limit, text)
            stop = min(stop + int(found[0]) + 1, text) if stop < text else text
        stop = min(stop, len(data))
        yield at, stop
        at = stop


def words_in_pieces(column: pa.Array, limit: int = SLICE):
    """Of texts, in stretches: the words (A-Z lower-cased), the text of each, and whether a piece starts with it."""
    column = pc.fill_null(column, "").cast(pa.large_binary())
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset: column.offset + len(column) + 1]
    if offsets[-1] == offsets[0]:
        return
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8)[offsets[0]: offsets[-1]]
    offsets = offsets - offsets[0]
    for a, b in _stretches(data, offsets[1:], limit):
        kind = _KIND[data[a:b]]
        inside = kind == 0
        begins = offsets[np.searchsorted(offsets, a): np.searchsorted(offsets, b)] - a
        edge = np.zeros(b - a + 1, dtype=np.int32)
        np.add.at(edge, begins, 1)
        fresh = edge[:-1] > 0
        start = inside.copy()
        start[1:] &= ~inside[:-1] | fresh[1:]
        at = np.flatnonzero(start)
        if not len(at):
            continue
        size = np.cumsum(inside)
        bounds = np.append(size[at] - 1, size[-1]).astype(np.int32)
        flat = pa.StringArray.from_buffers(len(at), pa.py_buffer(bounds), pa.py_buffer(_LOWER[data[a:b][inside]]))
        piece = np.cumsum((kind == 2) | fresh)[at]
        first = np.append(True, piece[1:] != piece[:-1])
        yield flat, np.searchsorted(offsets, at + a, side="right") - 1, first


def _coded(part):
    """Words of rows (text, lang): (keys `lang word`, langs, words, code of each word, whether a piece starts)."""
    langs = part.column(1).dictionary_encode()
    lang_of, names = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64), langs.dictionary
    for flat, doc, first in words_in_pieces(part.column(0)):
        vocab, codes = distinct(flat)
        both, codes = np.unique(lang_of[doc] * len(vocab) + codes, return_inverse=True)
        yield names.take(pa.array(both // len(vocab))), vocab.take(pa.array(both % len(vocab))), codes, first


def word_counts(texts: DataFrame) -> DataFrame:
    """(lang, word, f) over rows (text, lang)."""

    def count(batches):
        for part in slices(batches, limit=SLICE):
            for langs, words, codes, _ in _coded(part):
                yield pa.RecordBatch.from_arrays([langs, words, pa.array(np.bincount(codes, minlength=len(words)).astype(np.int64))], names=["lang", "word", "f"])

    return texts.mapInArrow(count, "lang string, word string, f long").groupBy("lang", "word").agg(F.sum("f").alias("f"))


def encode(texts: DataFrame, vocab: DataFrame, size: int, common: int) -> DataFrame:
    """(slice, codes, patch): ids of stretches of text as 32-bit integers, -1 between pieces and for words without an id.

    Words past the ``common`` first ids are joined: a stretch numbers them -2, -3, ..., and ``patch`` lists their ids.
    """
    near = vocab.filter(F.col("id") < common).select("lang", "word", "id").toPandas()
    keys, ids = (near["lang"] + " " + near["word"]).tolist(), near["id"].to_numpy(dtype=np.int64)
    more = size > common

    def run(batches):
        known = pa.array(keys, pa.string())
        number = TaskContext.get().partitionId() << 32
        for part in slices(batches, limit=SLICE):
            for langs, words, codes, first in _coded(part):
                spot = pc.fill_null(pc.index_in(pc.binary_join_element_wise(langs, words, " "), value_set=known), -1).to_numpy(zero_copy_only=False)
                local = np.where(spot < 0, -1, ids[spot] if len(ids) else -1)
                lost = np.flatnonzero(local < 0) if more else np.zeros(0, dtype=np.int64)
                local[lost] = -2 - np.arange(len(lost))
                row = np.insert(local[codes], np.flatnonzero(first), -1)
                # One break does between two words; a lone word makes no phrase.
                gap = row == -1
                alone = ~gap & np.append(True, gap[:-1]) & np.append(gap[1:], True)
                row = np.where(alone, -1, row)
                row = row[(row != -1) | np.append(True, row[:-1] != -1)].astype(np.int32)
                none = pa.nulls(len(lost), pa.binary())
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(lost) + 1, number)), pa.array(np.append(-1, -2 - np.arange(len(lost))).astype(np.int32)),
                    pa.concat_arrays([pa.nulls(1, pa.string()), langs.take(pa.array(lost)).cast(pa.string())]),
                    pa.concat_arrays([pa.nulls(1, pa.string()), words.take(pa.array(lost)).cast(pa.string())]),
                    pa.concat_arrays([pa.array([pa.compress(row.tobytes(), "lz4", asbytes=True)], pa.binary()), none]),
                    pa.array(np.append(len(row), np.zeros(len(lost), dtype=np.int64)).astype(np.int32)),
                ], names=["slice", "local", "lang", "word", "codes", "n"])
                number += 1

    found = texts.mapInArrow(run, "slice long, local int, lang string, word string, codes binary, n int")
    if not more:
        return durable(found.select("slice", "codes", "n", F.lit(None).cast("array<struct<local:int,id:long>>").alias("patch")))
    found = durable(found)
    rest = found.filter("codes IS NULL").join(vocab.select("lang", "word", "id"), ["lang", "word"])
    patches = rest.groupBy("slice").agg(F.collect_list(F.struct("local", "id")).alias("patch"))
    return durable(found.filter("codes IS NOT NULL").join(patches, "slice", "left").select("slice", "codes", "n", "patch"))


def _patched(batch) -> list[np.ndarray]:
    rows = []
    for codes, n, patch in zip(batch.column(1), batch.column(2), batch.column(3)):
        row = np.frombuffer(pa.decompress(codes.as_buffer(), n.as_py() * 4, "lz4"), dtype=np.int32).astype(np.int64) if n.as_py() else np.zeros(0, dtype=np.int64)
        fix = patch.as_py() or []
        table = np.full(max([int(-row.min(initial=-1)), *(-p["local"] for p in fix)]) + 1, -1)
        table[[-p["local"] for p in fix]] = [p["id"] for p in fix]
        rows.append(np.where(row < 0, table[-np.minimum(row, 0)], row))
        rows.append(np.array([-1]))
    return rows


def count_phrases(codes: DataFrame, n: int, bits: int, least: int, shard_bits: int, possible: np.ndarray | None) -> DataFrame:
    """(ids, f, spot) of the phrases of ``n`` ids that occur ``least`` times or more.

    Each worker counts a stretch of text in quotient filters, one a shard; the filters of a shard are merged.
    ``possible`` is the bitmap of shorter phrases: one that lacks a part can't be frequent.
    """
    layout, short = Layout(n, bits), Layout(n - 1, bits)
    shard_bits = min(shard_bits, layout.width)

    def keys(row):
        ok = row >= 0
        size = len(row) - n + 1
        if size <= 0:
            return [np.zeros(0, dtype=np.uint64)] * layout.lanes
        mask = np.logical_and.reduce([ok[i: i + size] for i in range(n)])
        if possible is not None:
            at = np.flatnonzero(mask)
            part = np.unique(np.concatenate([at, at + 1]))
            spot = quotient.spots(quotient.permute(quotient.pack([row[part + i] for i in range(n - 1)], short), short), SPOT_BITS)
            hit = np.zeros(len(row), dtype=bool)
            hit[part] = (possible[(spot >> np.uint64(6)).astype(np.int64)] >> (spot & np.uint64(63))) & np.uint64(1) == 1
            mask &= hit[:size] & hit[1: size + 1]
        at = np.flatnonzero(mask)
        return quotient.permute(quotient.pack([row[at + i] for i in range(n)], layout), layout)

    def build(rows):
        lanes, counts = quotient.tally(keys(np.concatenate(rows)))
        shards, at = quotient.cuts(lanes[0], layout, shard_bits)
        blobs = [quotient.store([lane[a:b] for lane in lanes], counts[a:b], layout, shard_bits) for a, b in zip(at[:-1], at[1:])]
        return pa.RecordBatch.from_arrays([pa.array(shards), pa.array(blobs, pa.binary())], names=["shard", "filter"])

    def count(batches):
        rows = []
        for batch in batches:
            for i in range(batch.num_rows):
                rows += _patched(batch.slice(i, 1))
                if sum(map(len, rows)) >= WORDS:
                    yield build(rows)
                    rows = []
        if rows:
            yield build(rows)

    def frequent(filters):
        lanes, counts = quotient.merge(filters)
        often = np.flatnonzero(counts >= least)
        lanes, counts = [lane[often] for lane in lanes], counts[often]
        ids = quotient.unpack(quotient.restore(lanes, layout), layout)
        flat = pa.ListArray.from_arrays(pa.array(np.arange(0, n * len(counts) + 1, n, dtype=np.int32)), pa.array(ids.ravel()))
        return pa.RecordBatch.from_arrays([flat, pa.array(counts), pa.array(quotient.spots(lanes, SPOT_BITS).astype(np.int64))], names=["ids", "f", "spot"])

    def merged(batches):
        shard, held, size = None, [], 0
        for batch in batches:
            for now, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                if now != shard and held:
                    yield frequent(held)
                    held, size = [], 0
                shard = now
                held.append(quotient.load(blob.as_buffer(), layout, shard_bits))
                size += len(held[-1][1])
                if size > PENDING and len(held) > 1:
                    held, size = [quotient.merge(held)], 0
        if held:
            yield frequent(held)

    filters = codes.mapInArrow(count, "shard long, filter binary")
    return filters.repartition("shard").sortWithinPartitions("shard").mapInArrow(merged, "ids array<long>, f long, spot long")


def _bitmap(phrases: DataFrame) -> np.ndarray:
    """Bits of the places of all phrases; at most one row per 64 places comes to the driver."""
    rows = phrases.groupBy((F.col("spot") / 64).cast("int").alias("at")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(spot % 64 as int))")).alias("bits")).toPandas()
    out = np.zeros(1 << (SPOT_BITS - 6), dtype=np.uint64)
    out[rows["at"].to_numpy(dtype=np.int64)] = rows["bits"].to_numpy(dtype=np.int64).view(np.uint64)
    return out


def _salted(left: DataFrame, right: DataFrame, on: list[str], by: Column) -> DataFrame:
    """Inner join; ``right`` stands once per salt, so that a hot key of ``left`` is spread."""
    salted = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")).join(salted, [*on, "_salt"]).drop("_salt")


def collocations(
    docs: DataFrame,
    least: int = 100,
    longest: int = 5,
    top: int | None = 2000,
    share: int = 100,
    common: int = COMMON,
    text_col: str = "text",
    lang_col: str = "lang",
) -> DataFrame:
    """The strongest phrases of 2 to ``longest`` words of each lang: (lang, rank, phrase, a, l, r, n, score).

    Texts are cut at `.,;:!?` and line ends into pieces, these at blanks and tabs into words, A-Z lower-cased. ``a``
    counts a phrase's occurrences within pieces (``least`` or more), ``n`` all words of the lang. A cut into parts with
    counts l and r scores floor(1000 a n / (l r)); the weakest cut counts, the first one on ties. A phrase goes if a longer
    one that holds it occurs at least ``share`` percent as often. Ranks go by score and ``a``, descending, then phrase
    in byte order; ``top`` of None returns all.

    Null texts are empty; a null lang is `und`. Rows count each, so repeated rows count repeatedly. An empty table, or one
    without frequent phrases, gives an empty result. Other columns are not read.

    Words below ``least`` can be part of no phrase. The other words get ids, and phrases of ids are counted exactly, one
    length after the other; a phrase is counted only if its two parts, one word shorter, may be frequent.
    """
    texts = docs.select(F.col(text_col).alias("text"), F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"))
    counts = durable(word_counts(texts))
    totals = durable(counts.groupBy("lang").agg(F.sum("f").alias("n")))
    often = counts.filter(F.col("f") >= least).withColumn("one", F.lit(1))
    vocab = running(often, [], [F.desc("f"), "lang", "word"], {"id": ("sum", "one", "before")}).drop("one")
    vocab = durable(_salted(vocab, totals, ["lang"], F.col("word")))
    size, words = vocab.count(), totals.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    bits = max(1, (size - 1).bit_length())
    shard_bits = max(0, (words // SHARD).bit_length())
    codes = encode(texts, vocab, size, common)
    found, possible = [], None
    for n in range(2, longest + 1):
        level = durable(count_phrases(codes, n, bits, least, shard_bits, possible))
        found.append(level.select("ids", "f"))
        if n < longest:
            possible = _bitmap(level)
            if not possible.any():
                break
    return _scored(vocab, found, share, top)


def _scored(vocab: DataFrame, found: list[DataFrame], share: int, top: int | None) -> DataFrame:
    ids = found[0]
    for more in found[1:]:
        ids = ids.unionByName(more)
    spelt = _salted(ids.select("ids", "f", F.posexplode("ids").alias("at", "id")), vocab.select("id", "lang", "word", "n"), ["id"], F.col("ids"))
    phrases = durable(spelt.groupBy("ids").agg(
        F.first("f").alias("a"), F.first("lang").alias("lang"), F.first("n").alias("n"),
        F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]).alias("words"),
    ).select("lang", "words", F.array_join("words", " ").alias("phrase"), "a", "n"))

    def part(begin, length):
        return F.array_join(F.slice("words", begin, length), " ")

    k, size = F.col("k"), F.size("words")
    halves = phrases.select("lang", "phrase", "a", "n", "words", F.explode(F.sequence(F.lit(1), size - 1)).alias("k")).select(
        "lang", "phrase", "a", "n", "k", part(F.lit(1), k).alias("left"), part(k + 1, size - k).alias("right"))
    counts = vocab.select("lang", F.col("word").alias("part"), "f").unionByName(phrases.select("lang", F.col("phrase").alias("part"), F.col("a").alias("f")))
    for side, name in (("left", "l"), ("right", "r")):
        halves = _salted(halves, counts.select("lang", F.col("part").alias(side), F.col("f").alias(name)), ["lang", side], F.col("phrase"))
    # Products may pass 64 bits: decimals of 38 digits.
    big = {c: F.col(c).cast("decimal(38,0)") for c in "anlr"}
    scored = halves.withColumn("over", F.lit(1000).cast("decimal(38,0)") * big["a"] * big["n"]).withColumn("under", big["l"] * big["r"])
    weakest = scored.withColumn("score", F.expr("over div under")).groupBy("lang", "phrase").agg(
        F.first("a").alias("a"), F.first("n").alias("n"), F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    spans = F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda length: F.transform(
        F.sequence(F.lit(1), size - length + 1), lambda at: F.array_join(F.slice("words", at, length), " "))))
    inner = phrases.filter(size > 2).select("lang", F.explode(spans).alias("phrase"), F.col("a").alias("longer")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = weakest.join(inner, ["lang", "phrase"], "left").filter(
        F.col("longer").isNull() | (F.lit(100) * F.col("longer") < F.lit(share) * F.col("a"))).select(
        "lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))
    order = [F.desc("score"), F.desc("a"), "phrase"]
    if top is None:
        ranked = running(kept.withColumn("one", F.lit(1)), ["lang"], order, {"rank": ("sum", "one")})
    else:
        ranked = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
