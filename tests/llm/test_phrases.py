"""Phrase collocations against direct counts, and the counting quotient filter against a dictionary."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from cellsift.llm import phrases, quotient
from cellsift.llm.quotient import Layout


def pieces_of(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [[w for w in re.split("[ \t]+", piece) if w] for piece in re.split("[.,;:!?\n-\r]", low)]


def brute(rows, least, share=100, top=2000):
    count, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for words in pieces_of(text):
            n[lang] += len(words)
            count.update((lang, tuple(words[i: i + m])) for m in range(1, 6) for i in range(len(words) - m + 1))
    often = {k: c for k, c in count.items() if c >= least and len(k[1]) > 1}
    longer = Counter()
    for (lang, words), c in often.items():
        for m in range(2, len(words)):
            for i in range(len(words) - m + 1):
                longer[lang, words[i: i + m]] = max(longer[lang, words[i: i + m]], c)
    found = {}
    for (lang, words), a in often.items():
        if 100 * longer[lang, words] >= share * a:
            continue
        score, k = min((1000 * a * n[lang] // (count[lang, words[:k]] * count[lang, words[k:]]), k) for k in range(1, len(words)))
        found.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), count[lang, words[:k]], count[lang, words[k:]]))
    return {(lang, i + 1, p.decode(), -a, left, right, n[lang], -score)
            for lang, rows in found.items() for i, (score, a, p, left, right) in enumerate(sorted(rows)[:top])}


def corpus(seed, n=150):
    rng, words = random.Random(seed), [*"a b c d e f é zz".split(), "Th", "#x", "日", "q\xa0r"]
    rows = []
    for _ in range(n):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", "?!"]) for _ in range(rng.randint(0, 60)))
        rows.append((rng.choice(["en", "de", None, "e n"]), text))
    return rows + [("en", None), ("de", ""), (None, " . ")] + [("en", "new york city hall is far. New York")] * 12


@pytest.mark.parametrize("common,share,top,slice_bytes", [(1 << 17, 100, 2000, 4 << 20), (3, 80, None, 4 << 20), (0, 100, 5, 40)])
def test_direct_counts(spark, monkeypatch, common, share, top, slice_bytes):
    for name, value in (("SLICE", slice_bytes), ("WORDS", 300), ("PENDING", 50), ("SHARD", 500)):
        monkeypatch.setattr(phrases, name, value)
    rows = corpus(3)
    docs = spark.createDataFrame([(t, lang, 1, "x", 2, 3) for lang, t in rows], "text string, lang string, f long, word string, id long, n long").repartition(4)
    found = [tuple(r) for r in phrases.collocations(docs, least=7, common=common, share=share, top=top).collect()]
    assert set(found) == brute(rows, 7, share, top or 10 ** 9) and len(found) == len(set(found))


def test_odd(spark, odd, nothing):
    assert phrases.collocations(nothing).collect() == []
    rows = [(r["lang"], r["text"]) for r in odd.select("lang", "text").collect()]
    assert {tuple(r) for r in phrases.collocations(odd, least=5).collect()} == brute(rows, 5)
    assert phrases.collocations(odd, least=10 ** 6).collect() == []


@pytest.mark.parametrize("n,bits,shard_bits", [(2, 1, 0), (2, 17, 3), (5, 12, 7), (5, 17, 4), (4, 32, 0), (3, 40, 9), (2, 32, 0), (5, 13, 64)])
def test_filters_are_lossless(n, bits, shard_bits):
    rng = np.random.default_rng(n * bits)
    layout, every, stored = Layout(n, bits), Counter(), {}
    shard_bits = min(shard_bits, layout.width)
    for _ in range(5):
        pool = rng.integers(0, min(1 << bits, 6), (400, n)) if bits > 1 else rng.integers(0, 2, (400, n))
        ids = np.where(rng.random((400, n)) < 0.2, (1 << bits) - 1, pool)
        every.update(map(tuple, ids.tolist()))
        lanes, counts = quotient.tally(quotient.permute(quotient.pack(list(ids.T), layout), layout))
        counts = counts * 1
        shards, at = quotient.cuts(lanes[0], layout, shard_bits)
        for shard, a, b in zip(shards, at[:-1], at[1:]):
            stored.setdefault(int(shard), []).append(quotient.store([x[a:b] for x in lanes], counts[a:b], layout, shard_bits))
    found = Counter()
    for blobs in stored.values():
        half = [quotient.load(b, layout, shard_bits) for b in blobs]
        lanes, counts = quotient.merge([quotient.merge(half[:2]), *half[2:]])
        assert all(lanes[0][1:] >= lanes[0][:-1])
        ids = quotient.unpack(quotient.restore(lanes, layout), layout)
        found.update(dict(zip(map(tuple, ids.tolist()), counts.tolist())))
    assert found == every


def test_wide_counters():
    layout = Layout(2, 8)
    lanes = quotient.permute(quotient.pack([np.arange(5), np.arange(5)], layout), layout)
    lanes, counts = quotient.tally(lanes, np.array([1, 254, 255, 256, 10 ** 12]))
    back = quotient.load(quotient.store(lanes, counts, layout, 0), layout, 0)
    assert (back[0][0] == lanes[0]).all() and (back[1] == counts).all()
