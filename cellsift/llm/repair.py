"""Conversation structure repair: a cost DP over edits, and the least optimal audit by prefix-doubling ranks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellsift.llm.text import crc_mod

#: Costs of the edits; a kept text without an end costs ENDLESS more.
DELETE, REROLE, INSERT, ENDLESS = 4, 3, 3, 3
#: Rows whose conversations are solved together, at least (a longer conversation is solved whole).
ROWS = 20_000
#: White space, and marks that end a text.
BLANKS, STOPS = " \t\n\x0b\x0c\r", ".!?"

# States of `(s?(ua)+)?`: nothing yet, after s, after u, after a. Where a user or assistant row leads from each.
_NEXT = np.array([2, 2, 3, 2])
# Where a kept row leads, by initial (s, u, a, other) and state; -1: nowhere.
_KEEP = np.array([[1, -1, -1, -1], [2, 2, -1, 2], [-1, -1, 3, -1], [-1, -1, -1, -1]])
_ACCEPTED = np.array([True, False, False, True])
_FAR = np.int64(1 << 40)
# Arcs in the order of their letters' codes; 0 is the end of the audit.
_LETTERS = np.frombuffer(b"\0DIKR", dtype=np.uint8)


def damage(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The rows with ``times`` (0: dropped, 2: repeated), and texts and roles spoilt by a checksum of conversation and turn.

    Of 20 checksums, 0 drops a row, 1 empties its text, 2 takes out its ends of sentences, 3 repeats it, 4 makes it a
    user's. Nulls count as one space, in the checksum, as role and as text.
    """
    def said(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    fate = crc_mod(F.concat(said(conv_col), F.lit(":"), said(turn_col)), 20)
    return turns.select(
        F.col(conv_col), F.col(turn_col),
        F.when(fate == 4, "user").otherwise(said(role_col)).alias(role_col),
        F.when(fate == 1, "").when(fate == 2, F.regexp_replace(said(text_col), "[.!?]", "")).otherwise(said(text_col)).alias(text_col),
        F.when(fate == 0, 0).when(fate == 3, 2).otherwise(1).alias("times"),
    )


def _costs(initial: np.ndarray, gone: np.ndarray, endless: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Cheapest way on from each node (conversation, rows read, state), one row of four states per rows read.

    A conversation of n rows has n + 1 such rows; all conversations are walked from the end at once.
    """
    cost = np.full((int((sizes + 1).sum()), 4), _FAR)
    order = np.argsort(-sizes, kind="stable")
    last, longest = (first + np.arange(len(sizes)) + sizes)[order], sizes[order]
    row = (first + sizes)[order]

    def with_inserts(h):
        for _ in range(3):
            h = np.minimum(h, INSERT + h[:, _NEXT])
        return h

    if len(sizes):
        cost[last] = with_inserts(np.broadcast_to(np.where(_ACCEPTED, 0, _FAR), (len(last), 4)))
    for back in range(1, int(sizes.max(initial=0)) + 1):
        n = int(np.searchsorted(-longest, -back, side="right"))
        at, r = last[:n] - back, row[:n] - back
        on = cost[at + 1]
        extra = np.where(gone[r], _FAR, endless[r] * ENDLESS)[:, None]
        to = _KEEP[initial[r]]
        kept = np.where(to >= 0, np.take_along_axis(on, np.maximum(to, 0), axis=1), _FAR)
        h = np.minimum(on + DELETE, np.minimum(kept, REROLE + on[:, _NEXT]) + extra)
        cost[at] = with_inserts(np.minimum(h, _FAR))
    return cost


def _arcs(cost: np.ndarray, initial: np.ndarray, gone: np.ndarray, endless: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Targets of each node's optimal arcs by letter (0 is the end, at the node itself); -1 where there is none."""
    n_at = len(cost)
    where = np.arange(n_at)
    conv = np.repeat(np.arange(len(sizes)), sizes + 1)
    ends = np.zeros(n_at, dtype=bool)
    ends[first + np.arange(len(sizes)) + sizes] = True
    row = np.where(ends, 0, where - conv)
    initial, gone, endless = (np.append(x, x.dtype.type(0))[row] for x in (initial, gone, endless))
    on = cost[np.minimum(where + 1, n_at - 1)]
    extra = (endless * ENDLESS)[:, None]
    target = np.full((n_at, 4, 5), -1, dtype=np.int64)
    state = np.arange(4)[None, :]
    inside = ~ends[:, None]
    target[:, :, 0] = np.where(ends[:, None] & _ACCEPTED & (cost == 0), where[:, None] * 4 + state, -1)
    target[:, :, 1] = np.where(inside & (cost == DELETE + on), (where[:, None] + 1) * 4 + state, -1)
    target[:, :, 2] = np.where(cost == INSERT + cost[:, _NEXT], where[:, None] * 4 + _NEXT, -1)
    to = _KEEP[initial]
    kept = np.where(to >= 0, np.take_along_axis(on, np.maximum(to, 0), axis=1), _FAR) + extra
    stay = inside & ~gone[:, None]
    target[:, :, 3] = np.where(stay & (to >= 0) & (cost == kept), (where[:, None] + 1) * 4 + to, -1)
    target[:, :, 4] = np.where(stay & (cost == REROLE + extra + on[:, _NEXT]), (where[:, None] + 1) * 4 + _NEXT, -1)
    target[cost >= _FAR] = -1
    return target.reshape(-1, 5)


def least_paths(target: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nodes and letter codes along each start's least optimal path, and the length of each path.

    ``target`` holds each node's optimal arcs by letter. Ranks of the least audits of length 1, 2, 4, ... from each node
    come from the ranks of half that length, here and at the node that the first half leads to. The last ranks order the
    nodes by whole audits; each node then takes the arc of the least letter and rank.
    """
    n = len(target)
    has = target >= 0
    letter = np.where(has.any(axis=1), has.argmax(axis=1), 0)
    hop = target[np.arange(n), letter]
    hop = np.where(hop < 0, np.arange(n), hop)
    rank, most = letter.astype(np.int64), -1
    while True:
        _, new = np.unique(rank * (n + 1) + rank[hop], return_inverse=True)
        kinds = int(new.max(initial=0))
        rank, hop = new, hop[hop]
        if kinds == most:
            break
        most = kinds
    score = np.where(has, np.arange(5) * np.int64(n + 1) + rank[np.maximum(target, 0)], np.iinfo(np.int64).max)
    letter = np.where(has.any(axis=1), score.argmin(axis=1), 0)
    one = target[np.arange(n), letter]
    one = np.where(one < 0, np.arange(n), one)
    # Lengths by doubling, then node number t of each path by the binary digits of t.
    jumps, steps = [one], (letter > 0).astype(np.int64)
    while True:
        more = steps + steps[jumps[-1]]
        if (more == steps)[starts].all():
            break
        steps, jumps = more, [*jumps, jumps[-1][jumps[-1]]]
    sizes = steps[starts]
    t = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    node = np.repeat(starts, sizes)
    for k, jump in enumerate(jumps):
        odd = (t >> k) & 1 == 1
        node[odd] = jump[node[odd]]
    return node, letter[node], sizes


def _repaired(roles: pa.Array, texts: pa.Array, turns: np.ndarray, known: np.ndarray, conv: np.ndarray, n_convs: int):
    """Counts, cost, audit and repaired text of whole conversations; rows lie in order, ``conv`` numbers their conversation."""
    sizes = np.bincount(conv, minlength=n_convs)
    first = np.cumsum(sizes) - sizes
    start = pc.utf8_slice_codeunits(roles, 0, 1)
    initial = pc.fill_null(pc.index_in(start, pa.array(["s", "u", "a"])), 3).to_numpy(zero_copy_only=False).astype(np.int64)
    trimmed = pc.utf8_rtrim(texts, BLANKS)
    blank = pc.equal(trimmed, "").to_numpy(zero_copy_only=False)
    ended = pc.is_in(pc.utf8_slice_codeunits(trimmed, -1), pa.array(list(STOPS))).to_numpy(zero_copy_only=False)
    role_code = roles.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    text_code = texts.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    order = np.lexsort((text_code, role_code, conv))
    seen = np.zeros(len(conv), dtype=bool)
    same = np.ones(max(len(conv) - 1, 0), dtype=bool)
    for x in (conv, role_code, text_code):
        same &= x[order][1:] == x[order][:-1]
    seen[order[1:][same]] = True
    double = seen & ~blank
    endless = ~ended & ~blank & ~double
    pair = conv[1:] == conv[:-1]
    legal = ((initial[:-1] == 0) & (initial[1:] == 1)) | ((initial[:-1] == 1) & (initial[1:] == 2)) | ((initial[:-1] == 2) & (initial[1:] == 1))

    def count(mask, of=conv):
        return np.bincount(of[mask], minlength=n_convs).astype(np.int64)

    # Rows with a turn lie behind those without, by turn.
    at = np.flatnonzero(known)
    here, when = conv[at], turns[at]
    new = np.append(True, (here[1:] != here[:-1]) | (when[1:] != when[:-1]))[: len(at)]
    heads, tails = (np.flatnonzero(np.append(True, here[1:] != here[:-1])), np.flatnonzero(np.append(here[1:] != here[:-1], True))) if len(at) else (at, at)
    gaps = np.zeros(n_convs, dtype=np.int64)
    gaps[here[heads]] = when[tails] - when[heads] + 1
    gaps -= count(new, here)

    gone = blank | double
    cost = _costs(initial, gone, endless, first, sizes)
    starts = first + np.arange(n_convs)
    node, letter, steps = least_paths(_arcs(cost, initial, gone, endless, first, sizes), starts * 4)
    path = np.repeat(np.arange(n_convs), steps)
    offsets = np.append(0, np.cumsum(steps)).astype(np.int32)
    audit = pa.StringArray.from_buffers(n_convs, pa.py_buffer(offsets), pa.py_buffer(_LETTERS[letter].tobytes()))
    said = letter > 1
    row = np.minimum(node[said] // 4 - path[said], max(len(conv) - 1, 0))
    letters = letter[said]
    new_role = pa.array(["user", "assistant"]).take(pa.array((_NEXT[node[said] % 4] == 3).astype(np.int64)))
    insert, keep = pa.array(letters == 2), pa.array(letters == 3)
    if len(conv):
        role = pc.if_else(keep, roles.take(pa.array(row)), new_role)
        text = pc.if_else(insert, "", texts.take(pa.array(row)))
    else:
        role, text = new_role, pa.array([""] * len(letters), pa.string())
    lines = pc.binary_join_element_wise(role, text, ":")
    cuts = np.append(0, np.cumsum(np.bincount(path[said], minlength=n_convs))).astype(np.int32)
    whole = pc.binary_join(pa.ListArray.from_arrays(pa.array(cuts), lines.cast(pa.string())), "\n")
    numbers = [gaps, count(blank), count(double), count(endless), count(~legal & pair, conv[1:]), cost[starts, 0]]
    return [*map(pa.array, numbers), audit, whole]


def repair(
    turns: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    times_col: str | None = None,
) -> DataFrame:
    """Faults and the cheapest repair of every conversation: (conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired).

    A conversation's rows are taken by turn, nulls first, then by role and text. Edits keep a row (K), give it the role
    user or assistant (R), delete it (D), which blank and repeated rows need, or insert an empty row (I); the roles must
    read `(s?(ua)+)?` by their initials. Among the cheapest audits the ASCII-least is taken; ``repaired`` holds the lines
    `role:text` that it leaves.

    Null roles and texts count as one space. A null ``conv_col`` is a conversation of its own. ``times_col`` says how often
    a row stands; with 0 it only names its conversation, which may be left with no row: zeros and empty texts. Repeated
    rows are duplicates. An empty table gives an empty result. Other columns are not read.

    One shuffle by conversation. Small conversations are solved many at a time; one conversation is held whole by a
    worker, as its repaired text is one value of the result.
    """
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired"]
    out = T.StructType([T.StructField(conv_col, turns.schema[conv_col].dataType)] + [
        T.StructField(c, T.StringType() if c in ("audit", "repaired") else T.LongType()) for c in names])

    def solve(table: pa.Table) -> pa.RecordBatch:
        conv, turn, role, text = (table.column(i).combine_chunks() for i in range(4))
        times = table.column(4).to_numpy()
        number = np.cumsum(np.append(0, _changes(conv)))
        rows = np.repeat(np.arange(len(number)), times)
        heads = np.flatnonzero(np.append(True, number[1:] != number[:-1]))
        take = pa.array(rows)
        known = turn.is_valid().to_numpy(zero_copy_only=False)[rows]
        found = _repaired(role.take(take), text.take(take), pc.fill_null(turn, 0).to_numpy()[rows], known, number[rows], len(heads))
        return pa.RecordBatch.from_arrays([conv.take(pa.array(heads)), *found], names=out.names)

    def run(batches):
        held = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if sum(b.num_rows for b in held) < ROWS:
                continue
            table = pa.Table.from_batches(held)
            turning = np.flatnonzero(_changes(table.column(0).combine_chunks()))
            if len(turning):
                cut = int(turning[-1]) + 1
                yield solve(table.slice(0, cut))
                held = table.slice(cut).to_batches()
        if held:
            yield solve(pa.Table.from_batches(held))

    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in (role_col, text_col))
    times = F.lit(1) if times_col is None else F.coalesce(F.col(times_col), F.lit(0)).cast("int")
    rows = turns.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"),
        F.when(times > 0, role).otherwise("").alias("role"), F.when(times > 0, text).otherwise("").alias("text"), times.alias("times"))
    return rows.repartition("conv").sortWithinPartitions("conv", F.col("turn").asc_nulls_first(), "role", "text").mapInArrow(run, out)


def _changes(values: pa.Array) -> np.ndarray:
    """Whether each value differs from the one before it; null is a value."""
    if len(values) < 2:
        return np.zeros(0, dtype=bool)
    a, b = values[:-1], values[1:]
    other = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
    return other | (a.is_null().to_numpy(zero_copy_only=False) != b.is_null().to_numpy(zero_copy_only=False))
