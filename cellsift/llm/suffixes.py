"""Suffix arrays by induced sorting, and permuted common prefixes, in numpy."""

from __future__ import annotations

import numpy as np

#: Places of the array that a step of a scan looks at, at most, and places that are walked singly where steps are short.
AHEAD, SINGLE = 1 << 16, 512
#: Symbols that a string of names has, at least, to be sorted by recursion; shorter ones are ranked by doubled lengths.
BASE = 1 << 17


def _types(text: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one; runs of one symbol take the type of their end."""
    turn = np.flatnonzero(text[:-1] != text[1:])
    smaller = np.ones(len(text), dtype=bool)
    smaller[: turn[-1] + 1 if len(turn) else 0] = np.repeat(text[turn] < text[turn + 1], np.diff(np.append(-1, turn)))
    return smaller


def _scan(view: np.ndarray, text: np.ndarray, wanted: np.ndarray, free: np.ndarray) -> None:
    """Fill ``view`` in order: each known suffix puts the one before it, if ``wanted``, at its symbol's next free place.

    A step takes the places up to the first one that it fills itself, so all it reads is final.
    """
    n, i, ahead, short = len(view), 0, 1024, 0
    while i < n:
        if short > 3:
            stop, short = min(i + SINGLE, n), 0
            for at in range(i, stop):
                before = int(view[at]) - 1
                if before >= 0 and wanted[before]:
                    symbol = text[before]
                    view[free[symbol]] = before
                    free[symbol] += 1
            i = stop
            continue
        stop = min(i + ahead, n)
        here = view[i:stop]
        at = np.flatnonzero(here > 0)
        before = here[at] - 1
        ok = np.flatnonzero(wanted[before])
        before = before[ok]
        symbol = text[before]
        nearest = int(free[symbol].min()) if len(ok) else n
        cut = nearest < stop
        if cut:
            keep = np.searchsorted(at[ok], nearest - i)
            before, symbol = before[:keep], symbol[:keep]
        if len(before):
            order = np.argsort(symbol, kind="stable")
            symbol = symbol[order]
            first = np.flatnonzero(np.append(True, symbol[1:] != symbol[:-1]))
            size = np.diff(np.append(first, len(symbol)))
            kinds = symbol[first]
            view[np.repeat(free[kinds] - first, size) + np.arange(len(symbol))] = before[order]
            free[kinds] += size
        if cut:
            short = short + 1 if nearest - i < 16 else 0
            ahead, i = max(64, nearest - i + (nearest - i >> 1)), nearest
        else:
            short, i, ahead = 0, stop, min(2 * ahead, AHEAD)


def _induce(text, smaller, counts, left_most) -> np.ndarray:
    """All suffixes out of the leftmost-smaller ones in their order (by first symbol at least)."""
    ends = np.cumsum(counts)
    array = np.full(len(text), -1, dtype=np.int32)
    symbol = text[left_most]
    size = np.bincount(symbol, minlength=len(counts))
    place = (ends - size)[symbol] + np.arange(len(symbol)) - (np.cumsum(size) - size)[symbol]
    array[place] = left_most
    _scan(array, text, ~smaller, ends - counts)
    array[place[1:]] = -1  # the end of the text stays
    _scan(array[::-1], text, smaller, len(text) - ends)
    return array


def _names(text: np.ndarray, lms: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Ranks of the leftmost-smaller substrings, in the order given; equal ones share a rank."""
    size = np.diff(np.append(lms, len(text) - 1))
    a, b = lms[order[:-1]], lms[order[1:]]
    differs = size[order[:-1]] != size[order[1:]]
    open_ = np.flatnonzero(~differs)
    length = size[order[1:]][open_]
    step = 0
    while len(open_):
        other = text[a[open_] + step] != text[b[open_] + step]
        differs[open_[other]] = True
        step += 1
        on = ~other & (length >= step)
        open_, length = open_[on], length[on]
    return np.append(0, np.cumsum(differs)).astype(np.int32)


def _doubled(text: np.ndarray) -> np.ndarray:
    """Order of the suffixes of a short string by ranks of prefixes of 1, 2, 4, ... symbols."""
    n, step, rank = len(text), 1, text.astype(np.int64)
    while True:
        key = rank * (n + 1)
        key[:-step] += rank[step:] + 1
        order = np.argsort(key, kind="stable")
        ranks = np.append(0, np.cumsum(key[order[1:]] != key[order[:-1]]))
        if ranks[-1] == n - 1:
            return order
        rank = np.empty(n, dtype=np.int64)
        rank[order], step = ranks, min(2 * step, n - 1)


def suffix_array(text: np.ndarray, symbols: int) -> np.ndarray:
    """Order of all suffixes of ``text``, whose last symbol, 0, stands nowhere else.

    Suffixes are classified as smaller or larger than the next one; the leftmost smaller ones' substrings are sorted by
    induction and named, the string of names is sorted by recursion unless names differ, and its order induces the rest.
    """
    if len(text) == 1:
        return np.zeros(1, dtype=np.int32)
    smaller = _types(text)
    lms = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    counts = np.bincount(text, minlength=symbols)
    rough = _induce(text, smaller, counts, lms[np.argsort(text[lms], kind="stable")])
    number = np.full(len(text), -1, dtype=np.int32)
    number[lms] = np.arange(len(lms))
    order = number[rough]
    order = order[order >= 0]
    names = _names(text, lms, order)
    if names[-1] + 1 < len(lms):
        shorter = np.empty(len(lms), dtype=np.int32)
        shorter[order] = names
        order = suffix_array(shorter, int(names[-1]) + 1) if len(shorter) > BASE else _doubled(shorter)
    return _induce(text, smaller, counts, lms[order])


def common_prefixes(text: np.ndarray, array: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place of ``text`` (16-bit symbols) the suffix before its own in ``array``, and their common prefix's length.

    Where both are preceded by one symbol the length is one less than the length at the place before; only the others
    are compared, four symbols at a time. The first suffix has no other before it: -1 and 0.
    """
    n = len(text)
    before = np.empty(n, dtype=np.int32)
    before[array[1:]], before[array[0]] = array[:-1], -1
    known = np.flatnonzero((before > 0) & (np.arange(n) > 0))
    open_ = np.ones(n, dtype=bool)
    open_[known] = text[known - 1] != text[before[known] - 1]
    start = np.flatnonzero(open_ & (before >= 0))
    padded = np.concatenate([text.astype("<u2"), np.zeros(4, dtype="<u2")])
    fours = np.ndarray(n, dtype="<u8", buffer=padded, strides=(2,))
    length = np.zeros(n, dtype=np.int32)
    a, b, at = start, before[start].astype(np.int64), 0
    while len(a):
        if len(a) < 32 and at > 256:
            for p, q in zip(a.tolist(), b.tolist()):
                size, on = 1 << 10, at
                while True:
                    differ = np.flatnonzero(text[p + on: p + on + size] != text[q + on: q + on + size][: n - p - on]) if p > q else np.flatnonzero(
                        text[p + on: p + on + size][: n - q - on] != text[q + on: q + on + size])
                    if len(differ):
                        length[p] = on + differ[0]
                        break
                    on, size = on + size, 2 * size
            break
        # The end of the text differs from all else, so no comparison runs past it.
        other = fours[a + at] ^ fours[b + at]
        more = other == 0
        stop = ~more
        low = other[stop]
        length[a[stop]] = at + np.bitwise_count((low & (~low + np.uint64(1))) - np.uint64(1)).astype(np.int32) // 16
        a, b = a[more], b[more]
        at += 4
    # Lengths of the rest fall by one from the last compared place.
    last = np.maximum.accumulate(np.where(open_, np.arange(n), 0))
    return before, np.maximum(length[last] - (np.arange(n) - last), 0).astype(np.int32)
