"""Languages of the words of a text by a linear-chain conditional random field."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellsift.llm.text import distinct, drawn, letter_words, sample_rate, slices

#: Slots of the hashed features; words of a chain; texts for fitting and chains of each, per language.
SLOTS, CHAIN, ROWS, DRAWS = 1 << 16, 64, 500, 2
UNKNOWN = "und"
#: Bytes of text that a worker labels at once.
SLICE = 1 << 20
_G = np.uint64(0x9E3779B97F4A7C15)


def _features(vocab: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(word, slot) pairs: the word itself (lexicon) and its 2-, 3- and 4-grams with marked ends (affixes, n-grams)."""
    texts = vocab.to_pylist()
    flat = np.frombuffer("".join(f"\x02{w}\x03" for w in texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    size = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 2
    owner, end = np.repeat(np.arange(len(texts)), size), np.repeat(np.cumsum(size), size)
    place = np.arange(len(flat))
    words, slots = [], []
    with np.errstate(over="ignore"):
        chars = flat.astype(np.uint64) + np.uint64(1)
        gram = chars
        for n in range(2, 5):
            gram = gram[:-1] * _G + chars[n - 1:] if len(gram) else gram
            at = np.flatnonzero(place[: len(gram)] + n <= end[: len(gram)])
            words.append(owner[at])
            slots.append(((gram[at] * _G) >> np.uint64(48)) & np.uint64(SLOTS - 1))
        begins = np.cumsum(size) - size
        whole = np.zeros(len(texts), dtype=np.uint64)
        if len(texts):
            power = np.cumprod(np.full(int(size.max()), _G))[place - begins[owner]]
            whole = np.add.reduceat(chars * power, begins)
        words.append(np.arange(len(texts)))
        slots.append(((whole ^ (whole >> np.uint64(29))) * _G) >> np.uint64(48))
    return np.concatenate(words), np.concatenate(slots).astype(np.int64)


def _emissions(vocab: pa.Array, weights: np.ndarray, block: int = 1 << 14) -> np.ndarray:
    """Scores of all words for every language; the features of ``block`` words are in memory at a time."""
    out = np.zeros((len(vocab), weights.shape[1]), dtype=np.float32)
    for i in range(0, len(vocab), block):
        some = vocab.slice(i, block)
        owner, slot = _features(some)
        for k in range(weights.shape[1]):
            out[i: i + len(some), k] = np.bincount(owner, weights[slot, k], minlength=len(some))
    return out


def _posteriors(scores: np.ndarray, used: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over chains [n, t, labels]: label and summed transition posteriors. ``used`` marks real words."""
    n, t, k = scores.shape
    e = np.exp(scores - scores.max(axis=2, keepdims=True))
    a = np.exp(moves - moves.max())
    ahead, behind = np.empty_like(e), np.ones_like(e)
    x = e[:, 0]
    for i in range(t):
        x = x if i == 0 else (ahead[:, i - 1] @ a) * e[:, i]
        ahead[:, i] = x / x.sum(axis=1, keepdims=True)
    for i in range(t - 2, -1, -1):
        y = (e[:, i + 1] * behind[:, i + 1]) @ a.T
        y /= y.sum(axis=1, keepdims=True)
        behind[:, i] = np.where(used[:, i + 1, None], y, 1.0 / k)
    post = ahead * behind
    post /= post.sum(axis=2, keepdims=True)
    left = ahead[:, :-1, :, None] * a * (e[:, 1:] * behind[:, 1:])[:, :, None, :]
    left /= left.sum(axis=(2, 3), keepdims=True)
    pairs = (left * used[:, 1:, None, None]).sum(axis=(0, 1)) if t > 1 else np.zeros((k, k))
    return post, pairs


def fit_chains(chains: list[list[str]], labels: list[int], kinds: int, steps: int = 40, decay: float = 1e-3, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Feature weights [SLOTS, kinds] and transitions [kinds, kinds] by AdaGrad on the chains' log-likelihood.

    Each chain has one language. Half of the chains are also spliced: words of one, then words of another, so that
    switches are seen.
    """
    draw = np.random.default_rng(seed)
    n = len(chains)
    flat = pa.array([w for c in chains for w in c], pa.string())
    vocab, codes = distinct(flat)
    begin = np.concatenate([[0], np.cumsum([len(c) for c in chains])]).astype(np.int64)
    word, gold = np.zeros((n + n // 2, CHAIN), dtype=np.int64), np.full((n + n // 2, CHAIN), -1)
    for i in range(n):
        c = codes[begin[i]: begin[i + 1]][:CHAIN]
        word[i, : len(c)], gold[i, : len(c)] = c, labels[i]
    for i in range(n, n + n // 2):
        p, q = draw.integers(n, size=2)
        a, b = (gold[p] >= 0).sum(), (gold[q] >= 0).sum()
        cut = int(draw.integers(1, max(2, min(a, CHAIN - 1) + 1)))
        rest = int(min(b, CHAIN - cut))
        word[i, :cut], gold[i, :cut] = word[p, :cut], gold[p, :cut]
        word[i, cut: cut + rest], gold[i, cut: cut + rest] = word[q, :rest], gold[q, :rest]
    used = gold >= 0
    owner, slot = _features(vocab)
    weights, moves = np.zeros((SLOTS, kinds)), np.zeros((kinds, kinds))
    seen_w, seen_m = np.full((SLOTS, kinds), 1e-8), np.full((kinds, kinds), 1e-8)
    truth = (gold[..., None] == np.arange(kinds)).astype(float)
    pairs_true = np.einsum("nti,ntj->ij", truth[:, :-1], truth[:, 1:])
    total = max(1, used.sum())
    for _ in range(steps):
        emit = np.stack([np.bincount(owner, weights[slot, k], minlength=len(vocab)) for k in range(kinds)], axis=1)
        post, pairs = _posteriors(np.where(used[..., None], emit[word], 0.0), used, moves)
        gap = (post - truth)[used]
        by_word = np.stack([np.bincount(word[used], gap[:, k], minlength=len(vocab)) for k in range(kinds)], axis=1)
        g = np.stack([np.bincount(slot, by_word[owner, k], minlength=SLOTS) for k in range(kinds)], axis=1) / total + decay * weights / SLOTS
        seen_w += g * g
        weights -= 0.3 * g / np.sqrt(seen_w)
        m = (pairs - pairs_true) / total + decay * moves
        seen_m += m * m
        moves -= 0.3 * m / np.sqrt(seen_m)
    return weights.astype(np.float32), moves.astype(np.float32)


def draw_chains(docs: DataFrame, rows: int = ROWS, draws: int = DRAWS) -> tuple[list[list[str]], list[str]]:
    """Chains for fitting from columns (text, lang, pick): about ``rows`` texts per language, ``draws`` chains of each.

    The texts are drawn by the hash ``pick``; the chains of a text lie evenly over the whole of it.
    """
    docs = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["count"] for r in docs.groupBy("lang").count().collect()}  # one row per language
    rate = F.lit(0.0)
    for lang, n in sorted(sizes.items()):
        rate = F.when(F.col("lang") == lang, F.lit(sample_rate(n, rows))).otherwise(rate)

    def cut(batches):
        for part in slices(batches):
            flat, _, n_words = letter_words(part.column(0))
            texts, begin, out = flat.to_pylist(), np.cumsum(n_words) - n_words, ([], [])
            for i in np.flatnonzero(n_words):
                chains = -(-int(n_words[i]) // CHAIN)
                for j in sorted({k * chains // draws for k in range(draws)}):
                    a = begin[i] + j * CHAIN
                    out[0].append(texts[a: min(a + CHAIN, begin[i] + n_words[i])])
                    out[1].append(part.column(1)[int(i)].as_py())
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.list_(pa.string())), pa.array(out[1], pa.string())], names=["words", "lang"])

    got = docs.filter(drawn(rate, "pick")).select("text", "lang").mapInArrow(cut, "words array<string>, lang string").collect()
    got.sort(key=lambda r: (r["lang"], r["words"]))
    return [r["words"] for r in got], [r["lang"] for r in got]


class Model:
    """Fitted languages, weights and transitions; it is small (SLOTS x languages) and travels with the task."""

    def __init__(self, languages: list[str], weights: np.ndarray, moves: np.ndarray):
        self.languages, self.weights, self.moves = languages, weights, moves

    def label(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Per text: index of the language (-1: none), its share, words, changes of language between neighbouring words."""
        n, k = len(column), len(self.languages)
        flat, doc, n_words = letter_words(column)
        has = pc.fill_null(pc.match_substring_regex(column.cast(pa.string()), r"\p{L}"), False).to_numpy(zero_copy_only=False)
        if not k or not len(flat):
            return np.full(n, -1), np.zeros(n), n_words, np.zeros(n, dtype=np.int64)
        vocab, codes = distinct(flat)
        emit = _emissions(vocab, self.weights)
        place = np.arange(len(flat)) - (np.cumsum(n_words) - n_words)[doc]
        chains = -(-n_words // CHAIN)
        chain = (np.cumsum(chains) - chains)[doc] + place // CHAIN
        scores = np.zeros((int(chains.sum()), CHAIN, k), dtype=np.float32)
        used = np.zeros(scores.shape[:2], dtype=bool)
        scores[chain, place % CHAIN], used[chain, place % CHAIN] = emit[codes], True
        post = np.concatenate([_posteriors(scores[i: i + 512], used[i: i + 512], self.moves)[0] for i in range(0, len(scores), 512)])
        by_word = post[chain, place % CHAIN]
        sums = np.stack([np.bincount(doc, by_word[:, j], minlength=n) for j in range(k)], axis=1)
        best, share = sums.argmax(axis=1), np.clip(sums.max(axis=1) / np.maximum(n_words, 1), 0, 1)
        tags = by_word.argmax(axis=1)
        switch = np.bincount(doc[1:][(doc[1:] == doc[:-1]) & (tags[1:] != tags[:-1])], minlength=n)
        known = has & (n_words > 0)
        return np.where(known, best, -1), np.where(known, share, 0.0), n_words, switch


def fit(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = ROWS) -> Model:
    """Learn the languages named in ``lang_col`` from a bounded sample of the rows where ``train`` is true.

    About ``rows`` texts per language are drawn by a hash of id and text and cut into chains of 64 words; the fit runs on the
    driver. No labelled rows: a model without languages, which answers ``und``.
    """
    rows_of = docs.filter(train).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("pick"))
    chains, langs = draw_chains(rows_of, rows)
    names = sorted(set(langs))
    if not names:
        return Model([], np.zeros((SLOTS, 0), np.float32), np.zeros((0, 0), np.float32))
    return Model(names, *fit_chains(chains, [names.index(x) for x in langs], len(names)))


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, *keep, lang_pred, score, n_words, n_switches) of every whole text, one row per row of ``docs``.

    Every word is labelled in a chain of up to 64 neighbouring words; ``lang_pred`` has the largest mean posterior over
    all words of the text and ``score`` is that mean. ``n_switches`` counts changes between neighbouring words.
    Null texts and texts without a letter are ``und`` with score 0. Equal means take the first language by name.
    Repeated rows are answered each; other columns than ``keep`` are not read.
    """
    fields = [docs.schema[id_col], *(docs.schema[c] for c in keep), T.StructField("lang_pred", T.StringType()),
              T.StructField("score", T.DoubleType()), T.StructField("n_words", T.LongType()), T.StructField("n_switches", T.LongType())]

    def run(batches):
        names = np.array([*model.languages, UNKNOWN], dtype=object)
        for part in slices(batches, limit=SLICE):
            best, share, n_words, switch = model.label(part.column(1))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), *part.columns[2:], pa.array(names[best], pa.string()), pa.array(share.astype(float)),
                 pa.array(n_words.astype(np.int64)), pa.array(switch.astype(np.int64))], names=[f.name for f in fields])

    return docs.select(id_col, F.col(text_col).alias("text"), *keep).mapInArrow(run, T.StructType(fields))


def keep_identified(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose text has a language: all but null texts and texts without a letter.

    A text of several languages stays, however its words are dealt. An empty table stays empty; repeated rows stay.
    """

    def run(batches):
        for part in slices(batches, text_col, SLICE):
            best, *_ = model.label(part.column(part.schema.get_field_index(text_col)))
            yield part.filter(pa.array(best >= 0))

    return docs.mapInArrow(run, docs.schema)
