"""Removal of repeated strings against a search of all windows, suffix arrays against sorting."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from cellsift.llm import repeats, suffixes


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    count = Counter(d[i: i + length] for d in data for i in range(len(d) - length + 1))
    for d in data:
        gone = np.zeros(len(d) + 1, dtype=bool)
        for i in range(len(d) - length + 1):
            if count[d[i: i + length]] > 1:
                gone[i: i + length] = True
        kept = bytes(b for b, g in zip(d, gone) if not g)
        yield len(d), int(gone.sum()), int((gone[:-1] & ~np.append(False, gone[:-2])).sum()) if len(d) else 0, hashlib.sha256(kept).hexdigest()


def corpus(seed, n, length):
    rng, alphabet = random.Random(seed), ["a", "b", "é", "日", " ", "\n", "\0", "😀"]
    some = lambda k: "".join(rng.choice(alphabet) for _ in range(k))
    shared = [some(rng.randint(length // 4, 2 * length)) for _ in range(4)]
    texts = [None, "", "x", "a" * (3 * length), "ab" * length, some(length)]
    for _ in range(n):
        text = some(rng.randint(0, 2 * length))
        for _ in range(rng.randint(0, 3)):
            text += rng.choice(shared) + some(rng.randint(0, length // 2))
        texts.append(text)
    return texts + texts[10:14] + [texts[10] + "!"] * 3


@pytest.mark.parametrize("length,block,slice_bytes", [(30, 1 << 19, 4 << 20), (40, 50, 300), (200, 128, 1000), (1, 1 << 19, 4 << 20)])
def test_all_windows(spark, monkeypatch, length, block, slice_bytes):
    monkeypatch.setattr(repeats, "BLOCK", block)
    monkeypatch.setattr(repeats, "SLICE", slice_bytes)
    monkeypatch.setattr(repeats, "ARRAY", 2_000)
    texts = corpus(length, 60, length)
    docs = spark.createDataFrame([(i, t, b"x", 1, "s") for i, t in enumerate(texts)], "doc_id long, text string, owner binary, part long, spans string").repartition(5)
    rows = {r["doc_id"]: r for r in repeats.remove_repeats(docs, length).collect()}
    assert len(rows) == len(texts)
    for i, want in enumerate(brute(texts, length)):
        r = rows[i]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) == want
        assert sum(s["stop"] - s["begin"] for s in r["spans"]) == r["n_removed"] and len(r["spans"]) == r["n_spans"]


def test_hot_passage(spark):
    """A passage in every text, just long enough, and one a byte too short."""
    rng = random.Random(4)
    some = lambda k: "".join(rng.choice("abcdefgh ") for _ in range(k))
    line, short = some(200), some(199)
    texts = [some(150) + line + some(120) + "|" + short + some(40) for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    found = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) for r in repeats.remove_repeats(docs).collect()}
    assert found == dict(enumerate(brute(texts, 200)))


def test_odd(spark, odd, nothing):
    assert repeats.remove_repeats(nothing).collect() == []
    rows = odd.select("doc_id", "text").collect()
    want = Counter((r["doc_id"], *w) for r, w in zip(rows, brute([r["text"] for r in rows], 60)))
    found = repeats.remove_repeats(odd, 60).collect()
    assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) for r in found) == want


@pytest.mark.parametrize("base", [4, 1 << 17])
def test_suffix_arrays(monkeypatch, base):
    monkeypatch.setattr(suffixes, "BASE", base)
    rng = np.random.default_rng(base)
    for trial in range(150):
        text = rng.integers(1, 2 + trial % 4, int(rng.integers(0, 300)))
        if trial % 3 == 0:
            text = np.tile(text[: len(text) // 9 + 1], 9)
        text = np.append(text, 0).astype(np.uint16)
        raw = text.astype(">u2").tobytes()
        want = sorted(range(len(text)), key=lambda i: raw[2 * i:])
        array = suffixes.suffix_array(text, int(text.max()) + 1)
        assert array.tolist() == want
        before, common = suffixes.common_prefixes(text, array)
        for a, b in zip(want[1:], want):
            size = next(k for k in range(len(text)) if text[a + k] != text[b + k])
            assert (before[a], common[a]) == (b, size)
