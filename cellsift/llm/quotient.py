"""Counting quotient filters: lossless sorted counters of fixed-width integer tuples, in numpy.

A key is a tuple of 64-bit lanes. An invertible permutation mixes all lanes into the first one. Its leading bits name the
shard and the quotient, i.e. the key's home slot; the bits that remain, with the other lanes, are the remainder. A filter
stores the home slots in unary, then the remainders and counters in slot order, so that no key is lost or confused with
another, and filters of one shard merge like sorted lists.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_ODD = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
#: Counters of this size and above are kept at full width.
_WIDE = 255


@dataclass(frozen=True)
class Layout:
    """Keys of ``n`` ids of ``bits`` bits: as many whole ids a lane as fit."""

    n: int
    bits: int

    @property
    def per_lane(self) -> int:
        return min(self.n, 64 // self.bits)

    @property
    def lanes(self) -> int:
        return -(-self.n // self.per_lane)

    @property
    def width(self) -> int:
        """Bits of the first lane, which the permutation mixes."""
        return self.per_lane * self.bits

    def parts(self) -> list[range]:
        return [range(a, min(a + self.per_lane, self.n)) for a in range(0, self.n, self.per_lane)]


def pack(columns: list[np.ndarray], layout: Layout) -> list[np.ndarray]:
    """Lanes of keys whose ids are given as ``n`` columns."""
    lanes = []
    for part in layout.parts():
        lane = np.zeros(len(columns[0]), dtype=np.uint64)
        for i in part:
            lane = (lane << np.uint64(layout.bits)) | columns[i].astype(np.uint64)
        lanes.append(lane)
    return lanes


def unpack(lanes: list[np.ndarray], layout: Layout) -> np.ndarray:
    """Ids, one row per key."""
    out = np.empty((len(lanes[0]), layout.n), dtype=np.int64)
    mask = np.uint64((1 << layout.bits) - 1)
    for lane, part in zip(lanes, layout.parts()):
        for back, i in enumerate(reversed(part)):
            out[:, i] = (lane >> np.uint64(layout.bits * back)) & mask
    return out


def _others(lanes: list[np.ndarray], mask: np.uint64) -> np.ndarray:
    mixed = np.zeros(len(lanes[0]), dtype=np.uint64)
    for lane in lanes[1:]:
        mixed = (mixed ^ lane) * np.uint64(_ODD[0])
        mixed ^= mixed >> np.uint64(29)
    return mixed & mask


def permute(lanes: list[np.ndarray], layout: Layout) -> list[np.ndarray]:
    """The first lane mixed with the others and within itself; a bijection on ``width`` bits."""
    mask, half = np.uint64((1 << layout.width) - 1), np.uint64((layout.width + 1) // 2)
    x = lanes[0] ^ _others(lanes, mask) if len(lanes) > 1 else lanes[0]
    for odd in _ODD:
        x = x ^ (x >> half)
        x = (x * np.uint64(odd)) & mask
    return [x ^ (x >> half), *lanes[1:]]


def restore(lanes: list[np.ndarray], layout: Layout) -> list[np.ndarray]:
    """Inverse of ``permute``."""
    mask, half = np.uint64((1 << layout.width) - 1), np.uint64((layout.width + 1) // 2)
    x = lanes[0]
    for odd in reversed(_ODD):
        x = x ^ (x >> half)
        x = (x * np.uint64(pow(odd, -1, 1 << 64))) & mask
    x = x ^ (x >> half)
    return [x ^ _others(lanes, mask) if len(lanes) > 1 else x, *lanes[1:]]


def spots(lanes: list[np.ndarray], bits: int) -> np.ndarray:
    """A place of each (permuted) key among 2 ** bits, for a bitmap of possible keys."""
    mixed = np.zeros(len(lanes[0]), dtype=np.uint64)
    for lane in lanes:
        mixed = (mixed ^ lane) * np.uint64(_ODD[1])
        mixed ^= mixed >> np.uint64(32)
    return (mixed * np.uint64(_ODD[0])) >> np.uint64(64 - bits)


def tally(lanes: list[np.ndarray], counts: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct keys in order, with summed counts."""
    if len(lanes) == 1 and counts is None:
        lanes, order = [np.sort(lanes[0])], None
    else:
        order = np.argsort(lanes[0], kind="stable") if len(lanes) == 1 else np.lexsort(lanes[::-1])
        lanes = [lane[order] for lane in lanes]
    new = np.ones(len(lanes[0]), dtype=bool)
    if len(new):
        new[1:] = np.logical_or.reduce([lane[1:] != lane[:-1] for lane in lanes])
    first = np.flatnonzero(new)
    if counts is None:
        total = np.diff(np.append(first, len(new)))
    else:
        total = np.add.reduceat(counts[order], first) if len(first) else np.zeros(0, dtype=np.int64)
    return [lane[first] for lane in lanes], total.astype(np.int64)


def cuts(first: np.ndarray, layout: Layout, shard_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Shards present among sorted first lanes, and where each begins (with the end at last)."""
    shard = first >> np.uint64(layout.width - shard_bits) if shard_bits else np.zeros(len(first), dtype=np.uint64)
    at = np.flatnonzero(np.append(True, shard[1:] != shard[:-1])) if len(first) else np.zeros(0, dtype=np.int64)
    return shard[at].astype(np.int64), np.append(at, len(first))


def _bytes_of(bits: int) -> int:
    return -(-bits // 8)


def store(lanes: list[np.ndarray], counts: np.ndarray, layout: Layout, shard_bits: int) -> bytes:
    """The filter of one shard's distinct keys in order: header, shard, slots in unary, remainders, counters."""
    n = len(counts)
    q = min(max(n - 1, 0).bit_length(), layout.width - shard_bits)
    rest = layout.width - shard_bits - q
    head = int(lanes[0][0]) >> (layout.width - shard_bits) if n and shard_bits else 0
    home = ((lanes[0] >> np.uint64(rest)) if rest < 64 else np.zeros(n, dtype=np.uint64)) & np.uint64((1 << q) - 1)
    unary = np.zeros(n + (1 << q), dtype=np.uint8)
    unary[home.astype(np.int64) + np.arange(n)] = 1
    parts = [np.array([n, q, head], dtype=np.int64).tobytes(), np.packbits(unary).tobytes()]
    widths = [_bytes_of(rest), *[_bytes_of(len(p) * layout.bits) for p in layout.parts()[1:]]]
    low = lanes[0] & np.uint64((1 << rest) - 1) if rest < 64 else lanes[0]
    for lane, width in zip([low, *lanes[1:]], widths):
        if width:
            parts.append(np.ascontiguousarray(lane.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes())
    parts.append(np.minimum(counts, _WIDE).astype(np.uint8).tobytes())
    parts.append(counts[counts >= _WIDE].astype("<i8").tobytes())
    return b"".join(parts)


def load(blob: bytes, layout: Layout, shard_bits: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Keys in order and counts of a stored filter."""
    n, q, head = (int(x) for x in np.frombuffer(blob, dtype=np.int64, count=3))
    at, rest = 24, layout.width - shard_bits - q
    size = _bytes_of(n + (1 << q))
    ones = np.flatnonzero(np.unpackbits(np.frombuffer(blob, dtype=np.uint8, count=size, offset=at), count=n + (1 << q)))
    at += size
    home = (ones - np.arange(n)).astype(np.uint64)
    lanes = []
    for width in [_bytes_of(rest), *[_bytes_of(len(p) * layout.bits) for p in layout.parts()[1:]]]:
        lane = np.zeros((n, 8), dtype=np.uint8)
        lane[:, :width] = np.frombuffer(blob, dtype=np.uint8, count=n * width, offset=at).reshape(width, n).T
        at += n * width
        lanes.append(lane.view("<u8").ravel())
    lead = np.uint64(head << (layout.width - shard_bits)) if shard_bits else np.uint64(0)
    if rest < 64:
        lanes[0] = lanes[0] | (home << np.uint64(rest)) | lead
    counts = np.frombuffer(blob, dtype=np.uint8, count=n, offset=at).astype(np.int64)
    counts[counts == _WIDE] = np.frombuffer(blob, dtype="<i8", offset=at + n)
    return lanes, counts


def merge(filters: list[tuple[list[np.ndarray], np.ndarray]]) -> tuple[list[np.ndarray], np.ndarray]:
    """One filter's keys and counts out of several (the stable sort joins their sorted stretches)."""
    if len(filters) == 1:
        return filters[0]
    lanes = [np.concatenate(x) for x in zip(*[f[0] for f in filters])]
    return tally(lanes, np.concatenate([f[1] for f in filters]))
