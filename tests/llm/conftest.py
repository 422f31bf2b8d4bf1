import random

import pandas as pd
import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, id string, mark long, llm_mark string, word string, shard string, fp long"
VOWELS = {"en": "the and of with reading water house shining".split(), "de": "der und schön zwischen Straße größer".split(),
          "fr": "être à l'eau château très forêt où".split()}


def prose(rng: random.Random, lang: str, n: int) -> str:
    return " ".join(rng.choice(VOWELS[lang]) for _ in range(n))


def odd_rows():
    """Nulls everywhere, empty, blank and wordless texts, repeated rows and ids, very long texts and words."""
    long_text = " ".join(f"w{i % 700}" for i in range(5_000))
    texts = [None, "", " \t\n", "### 123 !!!", "x", "a b", "Mail me at a@b.co or call +1 (212) 555-0100.", "a b c " * 30, long_text,
             "q" * 1_000, "é" * 90 + " 日本語 😀", "same text here now", "same text here now", "1.2.3.4 4111 1111 1111 1111 GB82 WEST 1234 5698 7654 32"]
    ids = [*range(len(texts) - 1), None]
    rows = [(i, t, None if k % 3 == 0 else "en", None if k % 4 == 0 else f"s{k % 3}", None if t is None else len(t)) for k, (i, t) in enumerate(zip(ids, texts))]
    rows += [rows[7], rows[7], (None, None, None, None, None), (3, "same id, other text", "de", "s1", 19)]
    return [(*r, 0.5, "x", 7, "m", "w", "old", 9) for r in rows]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def corpus():
    """Texts in three languages, some copied, some nearly."""
    rng, rows = random.Random(5), []
    for i in range(240):
        lang = "en de fr".split()[i % 3]
        rows.append((i, prose(rng, lang, rng.randint(15, 120)), lang, f"s{i % 5}"))
    for i in range(240, 270):
        words = rows[i - 240][1].split()
        if i % 2:
            words[len(words) // 2] = "changed"
        rows.append((i, " ".join(words), rows[i - 240][2], "s0"))
    return pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source"])
