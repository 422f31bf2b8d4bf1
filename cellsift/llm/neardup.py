"""Near-duplicates by SimHash: fingerprints, links by pigeonring filtering, components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellsift.llm.text import fresh, row_hash, slices, words
from cellsift.operators.hot import hot_join, least_neighbors
from cellsift.session import durable

#: Differing bits of a link, and the segments that a fingerprint is cut into.
BITS, SEGMENTS, WIDTH = 3, 4, 16
#: Members of a block that meet in one task, at most (twice as many where a block is cut into tiles).
TILE = 1024
#: Bytes of text whose shingles a worker holds at once.
SLICE = 2 << 20

# For each byte its eight bits, each in a byte of its own.
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def simhash(columns: pa.Array, shingle: int = 3, seed: int = 42) -> np.ndarray:
    """64-bit fingerprints of texts; a bit is 1 if it is set in over half of the hashed word shingles."""
    flat, doc, n_words = words(columns, lower=True)
    sizes = pc.binary_length(flat).to_numpy(zero_copy_only=False).astype(np.int64)
    joined = b" ".join(flat.cast(pa.binary()).to_pylist())
    begin = np.cumsum(sizes + 1) - sizes - 1
    first = np.cumsum(n_words) - n_words
    n_hashes = np.where(n_words > 0, np.maximum(n_words - shingle + 1, 1), 0)
    of = np.repeat(np.arange(len(n_words)), n_hashes)
    at = first[of] + np.arange(len(of)) - (np.cumsum(n_hashes) - n_hashes)[of]
    last = np.minimum(at + shingle, (first + n_words)[of]) - 1
    digest = xxhash.xxh64_intdigest
    stop = (begin[last] + sizes[last]).tolist() if len(of) else []
    hashes = np.fromiter((digest(joined[a:b], seed) for a, b in zip(begin[at].tolist(), stop)), dtype=np.uint64, count=len(of))
    counts = np.zeros((len(n_words), 64), dtype=np.int64)
    if len(of):
        raw = hashes.view(np.uint8).reshape(-1, 8)
        # Runs of at most 255 hashes of one text, so that a byte holds each bit's count.
        step = np.arange(len(of)) - (np.cumsum(n_hashes) - n_hashes)[of]
        runs = np.flatnonzero(step % 255 == 0)
        owner = of[runs]
        bounds = np.flatnonzero(np.diff(owner, prepend=-1))
        for k in range(8):
            lanes = np.add.reduceat(_SPREAD[raw[:, k]], runs).view(np.uint8).reshape(-1, 8).astype(np.int64)
            counts[owner[bounds], 8 * k: 8 * k + 8] = np.add.reduceat(lanes, bounds)
    bits = counts * 2 > n_hashes[:, None]
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64).ravel()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, fp, *keep): the fingerprint of every whole text as a signed 64-bit number. Null texts have no words: zero."""
    fields = [docs.schema[id_col], T.StructField("fp", T.LongType()), *(docs.schema[c] for c in keep)]

    def run(batches):
        for part in slices(batches, limit=SLICE):
            fp = pa.array(simhash(part.column(1)).view(np.int64))
            yield pa.RecordBatch.from_arrays([part.column(0), fp, *part.columns[2:]], names=[f.name for f in fields])

    return docs.select(id_col, F.col(text_col).alias("text"), *keep).mapInArrow(run, T.StructType(fields))


def _chain(a: np.ndarray, b: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """Whether the chain that starts at segment ``turn`` stays within its budget at every length."""
    diff = a ^ b
    shift = (turn * WIDTH).astype(np.uint64)
    turned = (diff >> shift) | (diff << ((np.uint64(64) - shift) & np.uint64(63)))
    ok = np.ones(np.broadcast(a, b).shape, dtype=bool)
    # Lengths 1 to SEGMENTS may hold BITS * length / SEGMENTS differing bits; the last one is the full check.
    for length in range(1, SEGMENTS + 1):
        mask = np.uint64((1 << (WIDTH * length)) - 1)
        ok &= np.bitwise_count(turned & mask) <= BITS * length // SEGMENTS
        if not ok.any():
            break
    return ok


def _forest(members: np.ndarray, linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each member whose component has an earlier member, and the component's first one."""
    label = np.arange(len(members))
    while True:
        low = np.where(linked, label[None, :], len(members)).min(axis=1)
        new = np.minimum(label, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    at = np.flatnonzero(label != np.arange(len(members)))
    return members[at], members[label[at]]


def _block_links(batches):
    """Links inside the blocks of rows sorted by block; whole blocks are seen together."""

    def solve(block, turn, fp):
        starts = np.flatnonzero(np.concatenate([[True], (block[1:] != block[:-1]).any(axis=1)]))
        size = np.diff(np.append(starts, len(fp)))
        left, right = [], []
        small = size <= 32
        own = np.repeat(np.where(small, np.arange(len(starts)), -1), size)
        for gap in range(1, int(size[small].max(initial=1))):
            at = np.flatnonzero((own[gap:] == own[:-gap]) & (own[gap:] >= 0))
            ok = at[_chain(fp[at], fp[at + gap], turn[at])]
            left.append(fp[ok + gap])
            right.append(fp[ok])
        for s, n in zip(starts[~small], size[~small]):
            x = fp[s: s + n]
            a, b = _forest(x, _chain(x[:, None], x[None, :], turn[s: s + 1]))
            left.append(a)
            right.append(b)
        left, right = np.concatenate([*left, np.zeros(0, np.uint64)]), np.concatenate([*right, np.zeros(0, np.uint64)])
        return pa.RecordBatch.from_arrays([pa.array(left.view(np.int64)), pa.array(right.view(np.int64))], names=["a", "b"])

    rest = None
    for batch in batches:
        block = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(3)], axis=1)
        fp = batch.column(3).to_numpy().view(np.uint64)
        if rest is not None:
            block, fp = np.concatenate([rest[0], block]), np.concatenate([rest[1], fp])
        if not len(fp):
            continue
        cut = len(fp) - int(np.argmax((block[::-1] != block[-1]).any(axis=1))) if (block != block[-1]).any() else 0
        if cut:
            yield solve(block[:cut], (block[:cut, 0] >> 25).astype(np.uint64), fp[:cut])
        rest = block[cut:], fp[cut:]
    if rest is not None and len(rest[1]):
        yield solve(rest[0], (rest[0][:, 0] >> 25).astype(np.uint64), rest[1])


def links(prints: DataFrame, tile: int = TILE) -> DataFrame:
    """(a, b) of distinct fingerprints ``fp`` at most 3 bits apart, enough of them to connect every component.

    Pigeonring: of four segments on a ring, some chain of consecutive ones stays within 3/4 bits per segment at every
    length. So it starts with an equal segment, and the next one differs in a bit at most, which leaves one of its
    halves equal: these 24 bits are the block's key (8 keys a fingerprint). Blocks of over ``tile`` members are cut
    into tiles that meet pairwise, each pair in its own group.
    """
    fp = F.col("fp")
    keys = []
    for turn in range(SEGMENTS):
        ring = F.shiftrightunsigned(fp, turn * WIDTH).bitwiseOR(F.shiftleft(fp, 64 - turn * WIDTH)) if turn else fp
        equal = ring.bitwiseAND(F.lit((1 << WIDTH) - 1))
        for half in range(2):
            part = F.shiftrightunsigned(ring, WIDTH + 8 * half).bitwiseAND(F.lit(255))
            keys.append(F.lit((turn << 25) + (half << 24)) + F.shiftleft(part, 16) + equal)
    rows = durable(prints.select("fp", F.explode(F.array(*keys)).alias("block")))
    sizes = rows.groupBy("block").agg(F.count("*").alias("n")).filter("n > 1")
    tiles = F.ceil(F.col("n") / tile).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int")
    meet = rows.join(sizes, "block").withColumn("tiles", tiles).withColumn("own", own).withColumn(
        "other", F.explode(F.when(F.col("tiles") == 1, F.array(F.lit(0))).otherwise(
            F.filter(F.sequence(F.lit(0), F.col("tiles") - 1), lambda x: x != F.col("own")))))
    pair = meet.select("block", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "fp")
    return (
        pair.repartition("block", "p", "q")
        .sortWithinPartitions("block", "p", "q", "fp")
        .mapInArrow(_block_links, "a long, b long")
        .distinct()
    )


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for the nodes of ``edges`` (a, b): root is the smallest node that can be reached.

    Alternating large and small stars until nothing changes; every round is checkpointed. The smallest neighbours are
    found by partial minima and a hub's rows meet theirs in a broadcast of at most a thousand hubs, so no task holds a hub.
    """
    now = durable(edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    rows, mark = now.count(), None
    while True:
        # Large star: the larger neighbours of a node take the smallest of its neighbourhood.
        near = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = durable(least_neighbors(near, 2 * rows).filter("b > a").select(F.col("b").alias("a"), F.least("m", "a").alias("b")).distinct())
        # Small star: a node and its smaller neighbours take the smallest of these.
        small = least_neighbors(large, large.count())
        now = durable(small.select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).filter("a != b").distinct())
        new = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if new == mark:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        rows, mark = new[0], new


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, fp, root, component_id, *keep): as ``near_duplicates``; ``root`` is the group's smallest fingerprint.

    Rows of a fingerprint, or fingerprints of a group, that are a large share of all meet their group in a broadcast.
    """
    prints = durable(fingerprints(docs, id_col, text_col, keep).withColumnsRenamed({id_col: "id"}))
    firsts = durable(prints.groupBy("fp").agg(F.min("id").alias("first")))
    roots = components(links(firsts.select("fp")))
    placed = durable(firsts.join(roots, firsts["fp"] == roots["node"], "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")))
    heads = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    member = durable(hot_join(placed.select("fp", "root"), heads, ["root"]))
    return hot_join(prints, member, ["fp"]).select("id", "fp", "root", "component_id", *keep)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint, component_id), one row per row of ``docs``: groups of texts linked at 3 or fewer bits.

    ``component_id`` is the smallest id of the group. Null, empty and blank texts have fingerprint zero and link to
    each other. Repeated rows and ids come back as often. A group whose ids are all null has a null component.
    Other columns are not read. Exact copies meet before the link search: it works on distinct fingerprints.
    """
    return groups(docs, id_col, text_col).select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, with one row of each near-duplicate group: the one of the smallest id.

    Rows without an id come last. Among rows of that id the text with the smallest hash stays, among rows of that text
    the one with the smallest hash of all columns; of equal rows one stays. Null and empty texts are one group. An empty
    table stays empty.
    """
    mark, pick = fresh(docs, "llm_mark"), fresh(docs, "llm_pick")
    marked = docs.withColumns({mark: F.xxhash64(text_col), pick: row_hash(docs)})
    found = groups(marked.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"), F.col(mark).alias("mark"), F.col(pick).alias("pick")), "doc", "text", ("mark", "pick"))
    heads = found.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "mark", "pick")).alias("head")).select(
        F.col("head.id").alias("head_id"), F.col("head.mark").alias("head_mark"), F.col("head.pick").alias("head_pick"))
    rows = marked.dropDuplicates([id_col, mark, pick])
    same = rows[id_col].eqNullSafe(F.col("head_id")) & (rows[mark] == F.col("head_mark")) & (rows[pick] == F.col("head_pick"))
    return rows.join(heads, same, "left_semi").drop(mark, pick)
