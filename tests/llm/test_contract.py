"""Each operator on odd rows, on nothing, and against brute force or SQL."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from cellsift.llm import contamination, language, lattice, mixing, neardup, pii, quality, scoring, sharding, tokens, toxicity
from cellsift.llm.queries import SQL
from cellsift.llm.text import held_out, slices, words
from tests.llm.conftest import prose

LABELS = "doc_id long, quality int, toxic int"
ITEMS = [(1, "same text here now"), (2, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 w12 w13 w14 w15"), (3, None), (4, ""), (2, "x"), (5, "a b c " * 6)]


def bench(spark):
    return spark.createDataFrame(ITEMS, "item_id long, text string")


def run(name, docs):
    spark = docs.sparkSession
    labels = spark.createDataFrame([(5, 1, 0), (7, 0, 1), (7, 0, 1), (None, None, None)], LABELS)
    graded = docs.select(F.col("doc_id").alias("id"), "text", F.when(F.col("doc_id") > 6, 1).otherwise(0).alias("grade"))
    return {
        "op1": lambda: tokens.count_tokens(docs),
        "op2": lambda: toxicity.grade(docs, toxicity.fit(graded)),
        "op3": lambda: language.identify(docs, language.fit(docs, ~held_out("doc_id", 4, 2))),
        "op4": lambda: pii.find(docs),
        "op5": lambda: quality.judge(docs, labels),
        "op6": lambda: mixing.mix(docs),
        "op7": lambda: contamination.contamination(docs, bench(spark)),
        "op8": lambda: neardup.near_duplicates(docs),
        "op9": lambda: sharding.placements(docs),
        "op10": lambda: scoring.score_texts(docs, held_out("doc_id", 5, 1)),
    }[name]()


NAMES = [f"op{i}" for i in range(1, 11)]


@pytest.mark.parametrize("name", NAMES)
def test_odd_rows_each_get_a_row(odd, name):
    got = run(name, odd).toPandas()
    want = Counter(str(r["doc_id"]) for r in odd.select("doc_id").collect())
    assert Counter("None" if pd.isna(x) else str(int(x)) for x in got["doc_id"]) == want


@pytest.mark.parametrize("name", NAMES)
def test_no_rows(nothing, name):
    assert run(name, nothing).count() == 0


def by_sql(spark, docs, name, tmp_path, benchmark=None):
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text", "source").toPandas().astype({"doc_id": "Int64"}))
    if benchmark is not None:
        con.register("benchmark", benchmark.toPandas())
    return con.execute(SQL[name]).fetchdf()


def same(a, b):
    key = lambda f: sorted(tuple("" if pd.isna(v) else (round(v, 6) if isinstance(v, float) else str(v)) for v in r) for r in f[sorted(f.columns)].astype({"doc_id": "Int64"}).itertuples(index=False))
    assert sorted(a.columns) == sorted(b.columns)
    assert key(a) == key(b)


def test_words_split_at_ascii_space_only():
    flat, doc, n = words(pa.array([" a\x0bb\x0cc\x85d e f ", None, ""]))
    assert flat.to_pylist() == ["a", "b", "c\x85d", "e f"] and n.tolist() == [4, 0, 0] and doc.tolist() == [0] * 4


def test_slices_keep_all_rows():
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * 10, None, "b" * 50, "c"])], names=["text"])
    parts = list(slices([batch], limit=12))
    assert [x for p in parts for x in p.column(0).to_pylist()] == batch.column(0).to_pylist() and len(parts) > 1


# --- op1, op10: lattice ------------------------------------------------------------------------------------------

PIECES = ["▁", "▁a", "a", "b", "ab", "▁ab", "c", "bc", "abc", "é"]
LOGP = np.log(np.array([1, 3, 2, 2, 4, 1, 1, 2, 1, 1.0]) / 20)


def segmentations(word):
    """Every way to spell the marked word: (log-probability, pieces)."""
    text, index = lattice.MARK + word, {p: i for i, p in enumerate(PIECES)}

    def rest(at):
        if at == len(text):
            yield 0.0, 0
            return
        n = len(text[at].encode())
        for lp, k in rest(at + 1):
            yield lp + n * lattice.BYTE_LOG, k + n
        for end in range(at + 1, len(text) + 1):
            if text[at:end] in index:
                for lp, k in rest(end):
                    yield lp + LOGP[index[text[at:end]]], k + 1

    return list(rest(0))


@pytest.mark.parametrize("wide", [64, 0])
def test_lattice_equals_all_segmentations(monkeypatch, wide):
    monkeypatch.setattr(lattice, "WIDE", wide)
    vocab = ["abc", "ab", "a", "abca", "é", "x", "bcabé", "a😀b"]
    table = lattice.Pieces(PIECES, LOGP)
    total, best, uses = lattice.word_log_probs(pa.array(vocab), table), lattice.word_piece_counts(pa.array(vocab), table), np.zeros(len(PIECES))
    for w, lp, k in zip(vocab, total, best):
        every = segmentations(w)
        assert math.isclose(lp, math.log(sum(math.exp(x) for x, _ in every)), rel_tol=1e-9)
        top = max(x for x, _ in every)
        assert k == min(n for x, n in every if math.isclose(x, top, rel_tol=1e-12))
    weight = np.arange(1.0, len(vocab) + 1)
    uses = lattice.expected_pieces(pa.array(vocab), weight, table)
    step = 1e-6  # expected uses are the slope of the log-likelihood
    for p in range(len(PIECES)):
        up = LOGP.copy()
        up[p] += step
        slope = ((lattice.word_log_probs(pa.array(vocab), lattice.Pieces(PIECES, up)) - total) * weight).sum() / step
        assert abs(slope - uses[p]) < 1e-3


def test_token_counts(spark, odd):
    rows = tokens.count_tokens(odd).toPandas()
    table = lattice.Pieces(ps := lattice.load_pieces(tokens.VOCABULARY), lattice.rank_log_probs(len(ps)))
    one = lambda t: sum(int(lattice.word_piece_counts(pa.array([w]), table)[0]) for w in re.split(r"[ \t-\r]+", t or "") if w)
    texts = {r["doc_id"]: r["text"] for r in odd.filter("doc_id in (0, 1, 6, 7, 10, 13)").collect()}
    for i, t in texts.items():
        assert set(rows[rows.doc_id == i].n_tokens) == {one(t)}


def plain_counts(frame):
    low = lambda t: [w for w in re.split(r"[ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w]
    train = Counter()
    for r in frame.itertuples():
        if r.held_out is False or r.held_out == 0:
            train.update([*low(r.text), "\n"])
    return low, train


@pytest.mark.parametrize("common", [1 << 17, 4, 0])
def test_scores(spark, corpus, common):
    docs = spark.createDataFrame(corpus).withColumn("held_out", held_out("doc_id", 5, 1))
    frame = docs.toPandas()
    got = scoring.score_texts(docs, F.col("held_out"), common=common).toPandas().set_index("doc_id")
    low, train = plain_counts(frame)
    total, kinds = sum(train.values()), len(train)
    for r in frame.itertuples():
        t = [*low(r.text), "\n"]
        g = got.loc[r.doc_id]
        assert (g.n_tokens, g.n_known, g.train_tokens) == (len(t), sum(train[w] > 0 for w in t), total)
        assert math.isclose(g.base_score, sum(math.log10((train[w] + 0.5) / (total + 0.5 * (kinds + 1))) for w in t), rel_tol=1e-9)
    # The lattice's own learning on the driver gives the same scores.
    vocab = pa.array([w for w in train if w != "\n"])
    weight = np.array([train[w] for w in vocab.to_pylist()], float)
    pieces = lattice.load_pieces(tokens.VOCABULARY)
    start = logp = lattice.rank_log_probs(len(pieces))
    for _ in range(3):
        used = lattice.expected_pieces(vocab, weight, lattice.Pieces(pieces, logp))
        p = used + scoring.PRIOR * np.exp(start)
        logp = np.log(p / p.sum() * (1 - lattice.BYTE_MASS))
    end = (train["\n"] + 1.0) / (used.sum() + train["\n"] + 2.0)
    table = lattice.Pieces(pieces, logp + math.log1p(-end))
    for r in frame.head(20).itertuples():
        want = (sum(lattice.word_log_probs(pa.array([w]), table)[0] for w in low(r.text)) + math.log(end)) / math.log(10)
        assert math.isclose(got.loc[r.doc_id].score, want, rel_tol=1e-6)


# --- op2 ---------------------------------------------------------------------------------------------------------

def test_severity_rises_with_bad_words(spark):
    rng, rows = random.Random(1), []
    for i in range(900):
        grade = i % 3 if i % 2 else 0
        bad = ["foul"] * (grade > 0) + ["vile"] * (grade > 1)
        text = prose(rng, "en", 30).split()
        for w in bad:
            text.insert(rng.randrange(len(text)), w)
        rows.append((i, " ".join(text), grade))
    graded = spark.createDataFrame(rows, "id long, text string, grade int")
    model = toxicity.fit(graded)
    assert {"foul", "vile"} <= set(model.features) and (np.diff(model.cuts) > 0).all()
    tests = [(1, "the water of the house"), (2, "the FOUL, water"), (3, "a foul and vile house"), (4, None)]
    got = toxicity.grade(spark.createDataFrame(tests, "doc_id long, text string"), model).toPandas().set_index("doc_id")
    assert got.severity.tolist() == [0, 1, 2, 0] and got.toxic.tolist() == [False, True, True, False]
    assert got.expected_severity[1] < got.expected_severity[2] < got.expected_severity[3]


def test_ordinal_fit_reaches_the_shares():
    grade = np.array([0] * 70 + [1] * 20 + [2] * 10)
    none = np.zeros(0, dtype=np.int64)
    _, cuts = toxicity.fit_ordinal(none, none, np.zeros(0), grade, 0, 3)
    assert np.allclose(1 / (1 + np.exp(cuts)), [0.3, 0.1], atol=0.01)


# --- op3 ---------------------------------------------------------------------------------------------------------

def test_languages_of_held_out_texts(spark, corpus):
    docs = spark.createDataFrame(corpus)
    model = language.fit(docs, ~held_out("doc_id", 4, 2))
    got = language.identify(docs, model, keep=("lang",)).toPandas()
    assert (got.lang == got.lang_pred).mean() == 1 and got.score.between(0, 1).all()
    mixed = spark.createDataFrame([(1, " ".join(VOW) * 1) for VOW in [["the", "water", "of", "the", "house"] * 4 + ["der", "schön", "zwischen", "Straße"] * 4]] + [(2, "123 !"), (3, None)], "doc_id long, text string")
    out = language.identify(mixed, model).toPandas().set_index("doc_id")
    assert out.n_switches[1] == 1 and out.lang_pred[1] == "en" and out.score[1] < 0.7
    assert out.lang_pred[2] == out.lang_pred[3] == "und" and out.score[2] == 0


def test_posteriors_equal_all_paths():
    rng = np.random.default_rng(0)
    scores, moves = rng.normal(size=(1, 4, 3)), rng.normal(size=(3, 3))
    used = np.array([[True, True, True, False]])
    post, pairs = language._posteriors(np.where(used[..., None], scores, 0), used, moves)
    weight = np.zeros((3, 3, 3))
    for a in range(3):
        for b in range(3):
            for c in range(3):
                weight[a, b, c] = math.exp(scores[0, 0, a] + scores[0, 1, b] + scores[0, 2, c] + moves[a, b] + moves[b, c])
    weight /= weight.sum()
    assert np.allclose(post[0, 0], weight.sum((1, 2))) and np.allclose(post[0, 1], weight.sum((0, 2))) and np.allclose(post[0, 2], weight.sum((0, 1)))
    assert np.allclose(pairs, weight.sum(2) + weight.sum(0))


# --- op4 ---------------------------------------------------------------------------------------------------------

PII_TEXTS = ["a@b.c.d%x@e.f a@b.c@d.e x@y", "1.2.3.4.5.6.7.8 256.1.1.1 001.0002.3.4 1.2.3", "4111 1111 1111 1111, 4111-1111-1111-1112 4111111111111111 1",
             "+1 (212) 555-0100 ++44 20 7946 0958. +1 2", "Konto: GB82 WEST 1234 5698 7654 32 und GB82WEST12345698765433", "é😀 mail: é@x.yz ü.a@x.yz\n+49.30.1234567",
             "card 5555555555554444 ip 8.8.8.8 ip 8.8.8.999999999999", "." * 5000 + "a" * 5000, "@@@ +++ ...", "1 " * 3000, None, ""]


def test_spans_equal_sql(spark, tmp_path):
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(PII_TEXTS)], "doc_id long, text string, source string")
    got = pii.find(docs).toPandas()
    same(got, by_sql(spark, docs, "op4_pii", tmp_path))
    by = got.set_index("doc_id")
    assert by.n_email[0] == 3 and by.n_ip[1] == 3 and by.n_card[2] == 1 and "iban:7:34" in by.spans[4]


def plain_accounts(t):
    """Leftmost, then longest, account numbers that end at a word boundary and leave 1 modulo 97."""
    out, at = [], 0
    while at < len(t):
        ends = [e for e in range(at + 15, len(t) + 1) if re.fullmatch(r"[A-Z]{2}[0-9]{2}( ?[A-Z0-9]){11,30}", t[at:e])
                and not re.match(r"\w", t[e:], re.A) and not re.search(r"\w$", t[:at], re.A)]
        codes = {e: t[at:e].replace(" ", "") for e in ends}
        good = [e for e, c in codes.items() if int("".join(str(int(x, 36)) for x in c[4:] + c[:4])) % 97 == 1]
        out += [f"iban:{at}:{max(good)}"] if good else []
        at = max(good, default=at + 1)
    return out


def test_accounts_before_other_words(spark):
    a, b = "DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32"
    flat = a.replace(" ", "")
    texts = [f"{a} BIC COBADEFFXXX", f"{flat} 2024", f"{a} {b}", f"{flat} {a} {b} {flat}", f"AB12 {a} X", f"é😀 {a} Bank", f"{a}x {flat}_ {flat}é",
             f"NO9386011117947 {flat}", f"MT84MALT011000012345MTLCAST001S 12 {a}", f"{a[:-1]} BIC", f"A{a}", f"AB12 CD34 {a[:-3]} 01"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: [s for s in r["spans"].split(",") if s.startswith("iban")] for r in pii.find(docs).collect()}
    assert got == {i: plain_accounts(t) for i, t in enumerate(texts)}
    assert [len(got[i]) for i in range(10)] == [1, 1, 2, 4, 1, 1, 1, 2, 2, 0] and got[0] == ["iban:0:27"] and got[1] == ["iban:0:22"]


def test_many_spans_in_one_text(spark):
    """Time and places of 60,000 addresses and numbers in one text; context words stand many pieces back."""
    import time

    parts = [["a%d@b.co" % i, "1.2.3.%d" % (i % 300), "+1 (212) 555-0%03d" % (i % 999), "x" * (i % 7)][i % 4] for i in range(80_000)]
    text = "mail " + " ".join(parts) + " é visa 4111 1111 1111 1111"
    docs = spark.createDataFrame([(1, text), (2, "é a@b.cd a@b.cd mail a@b.cd a@b.cd")], "doc_id long, text string")
    begun = time.time()
    got = {r["doc_id"]: r for r in pii.find(docs).collect()}
    assert time.time() - begun < 90
    assert got[1]["n_email"] == 20_000 and got[1]["n_card"] == 1 and got[1]["n_phone"] == 20_000
    assert got[1]["n_ip"] == sum(i % 4 == 1 and i % 300 < 256 for i in range(80_000))
    last = len(text) - 19
    assert got[1]["spans"].endswith(f"card:{last}:{last + 19}") and got[1]["scores"].endswith(",100") and got[1]["scores"].startswith("100,")
    assert got[2]["spans"] == "email:2:8,email:9:15,email:21:27,email:28:34" and got[2]["scores"] == "80,80,100,100"


def test_spans_of_accounts_equal_sql(spark, tmp_path):
    """Account numbers before other words, one inside the run of another, and numbers without a valid end."""
    a, b = "DE89370400440532013000", "GB82 WEST 1234 5698 7654 32"
    texts = [f"{a} BIC COBADEFFXXX", f"konto {b} 2024 {a}", f"{a} {a}{a}", f"x{a}", f"{a}y {b}", None, f"AB12 {b} é {a}", f"{b} {b} {b}", "DE89 3704 0044 0532 0130 01 x" * 3]
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    got = pii.find(docs).toPandas()
    assert (got.n_spans > 0).sum() >= 6
    same(got, by_sql(spark, docs, "op4_pii", tmp_path))


def test_spans_of_odd_rows_equal_sql(spark, odd, tmp_path):
    same(pii.find(odd).toPandas(), by_sql(spark, odd, "op4_pii", tmp_path))


# --- op5 ---------------------------------------------------------------------------------------------------------

def plain_measure(t):
    t = t or ""
    w = [x for x in re.split(r"[ \t-\r]+", t) if x]
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^ \t-\r]", line):
            dup += line in seen
            seen.add(line)
    at = defaultdict(list)
    for i in range(len(w) - 4):
        at[tuple(w[i: i + 5])].append(i)
    hit = {j for x in at.values() if len(x) > 1 for i in x for j in range(i, i + 5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(hit)


def test_measures(spark, odd):
    rows = [(i, t) for i, t in enumerate(["a b c d e a b c d e f", "x\nx\n\n\nx y\nx", "a a a a a a", "%%% |||", "l1\n l1\nl1 "])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").unionByName(odd.filter("doc_id is not null").select("doc_id", "text").dropDuplicates(["doc_id"]).withColumn("doc_id", F.col("doc_id") + 100))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in quality.measure(docs).collect():
        assert tuple(r)[1:6] == plain_measure(texts[r["doc_id"]])


def test_repeats_survive_hash_collisions(monkeypatch):
    monkeypatch.setattr(quality, "_ODD", np.zeros(5, dtype=np.uint64))  # every window collides
    codes = np.array([0, 1, 2, 3, 4, 9, 0, 1, 2, 3, 4, 7, 7])
    assert quality.repeated_words(codes, np.zeros(13, dtype=np.int64), 1).tolist() == [10]


def test_cutoffs_hold_their_risk(spark):
    rng, rows, labels = random.Random(3), [], []
    for i in range(4500):
        good = i % 3 > 0
        w = [rng.choice("abcdefgh") + str(rng.randrange(500)) + ("" if good or rng.random() < 0.1 else "$$$###") for _ in range(30)]
        rows.append((i, " ".join(w)))
        labels.append((i, int(good), 0))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, LABELS)
    got = quality.judge(docs, marks).toPandas()
    good = got.doc_id % 3 > 0
    assert (~got[good].kept).mean() <= quality.RISK and (~got[~good].kept).mean() > 0.95
    assert not quality.judge(docs, marks.limit(0)).filter("reasons <> ''").count()


def test_cutoffs_equal_a_direct_count(spark):
    """Good texts reach 0.1 to 0.5 in one rule, so the walk has to stop on the way."""
    rng, rows = random.Random(8), []
    for _ in range(20_000):
        n_words, letters = rng.choice([20, 100, 500, 2000]), 1000
        upper = int(letters * (rng.uniform(0.1, 0.5) if rng.random() < 0.2 else rng.uniform(0, 0.1)))
        rows.append((n_words, 4 * n_words, rng.randrange(n_words // 10), 0, rng.randrange(n_words // 4), 10, upper, letters, int(rng.random() < 0.9)))
    measured = spark.createDataFrame(rows, ", ".join(f"{c} long" for c in (*quality.COUNTS, "quality")))
    got = quality.select_cutoffs(measured, F.col("quality") == 1)
    table = pd.DataFrame(rows, columns=[*quality.COUNTS, "quality"])
    held = table[table.quality == 1]
    level = sum((held.n_words >= b).astype(int) for b in quality.BANDS)
    values = {
        "symbol_ratio": held.n_symbols / held.word_chars, "dup_line_ratio": held.n_dup_lines / held.n_lines, "repeat_ratio": held.n_repeat_words / held.n_words,
        "upper_ratio": held.n_upper / held.n_letters, "long_words": held.word_chars / held.n_words / 100}
    want = {}
    for b in range(4):
        for rule, v in values.items():
            for cutoff in quality.GRID:
                if quality.tail(int((v[level == b] > cutoff).sum()), int((level == b).sum()), quality.RISK / len(quality.RULES)) > 0.05 / 20:
                    break
                want[b, rule] = cutoff
    assert got == want and {got[b, "upper_ratio"] for b in range(4)} <= {0.5, 0.6} and len(set(got.values())) > 3


def test_binomial_tail():
    assert math.isclose(quality.tail(2, 10, 0.3), sum(math.comb(10, i) * 0.3**i * 0.7 ** (10 - i) for i in range(3)))
    assert quality.tail(0, 458, 0.01) < 0.0101 and quality.tail(5, 5, 0.1) == 1


# --- op6 ---------------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("block", [1, 7, 256])
def test_mix_equals_sql(spark, odd, tmp_path, block):
    got = mixing.mix(odd, block=block).toPandas().astype({"first_slot": "Int64"})
    want = by_sql(spark, odd, "op6_mix_sources", tmp_path).astype({"first_slot": "Int64"})
    assert ((got.n_slots > 0) == (got.taken > 0)).all() and (got.first_slot.isna() == (got.taken == 0)).all()
    # The SQL has blocks of the usual size.
    slots = [] if block == mixing.BLOCK else ["first_slot", "n_slots"]
    same(got.drop(columns=slots), want.drop(columns=slots))
    assert (got.taken <= 2 * got["size"]).all()


def test_schedule_spreads_sources(spark):
    goals = spark.createDataFrame([("a", 18380, 13977.9), ("b", 600, 1200.0), (None, 10, 15.2)], "source string, source_size long, target double")
    rows = mixing.schedule(mixing.plan(goals)).orderBy("slot").toPandas()
    assert rows.slot.tolist() == list(range(len(rows)))
    assert rows.groupby("source", dropna=False).words.sum().to_dict() == {"a": 13978, "b": 1200, np.nan: 15} or rows.words.sum() == 15193
    share = (rows.source == "a").cumsum() / np.arange(1, len(rows) + 1)
    assert (share[20:] - (rows.source == "a").mean()).abs().max() < 0.1


def test_take_repeats_rows(spark, odd):
    kept = mixing.take(odd)
    assert kept.columns == odd.columns
    assert kept.filter("text is null or trim(text) = ''").count() == 0
    assert kept.groupBy("doc_id", "text").count().filter("count > 6").count() == 0


# --- op7 ---------------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("at_once", [200_000, 3])
def test_contamination_equals_sql(spark, odd, tmp_path, monkeypatch, at_once):
    monkeypatch.setattr(contamination, "AT_ONCE", at_once)
    got = contamination.contamination(odd, bench(spark)).toPandas()
    same(got, by_sql(spark, odd, "op7_decontamination", tmp_path, bench(spark)))
    assert got.contaminated.sum() > 3
    clean = contamination.drop_contaminated(odd, bench(spark))
    assert clean.columns == odd.columns and clean.count() == (~got.contaminated).sum()


# --- op8 ---------------------------------------------------------------------------------------------------------

def plain_fp(t):
    w = [x for x in re.split(r"[ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
    s = [" ".join(w[i: i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(ids, fps):
    label = list(range(len(ids)))

    def find(i):
        while label[i] != i:
            label[i] = label[label[i]]
            i = label[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                label[find(i)] = find(j)
    best = {}
    for i, d in enumerate(ids):
        best[find(i)] = min(best.get(find(i), d), d)
    return [best[find(i)] for i in range(len(ids))]


def test_groups_equal_brute_force(spark, corpus, odd):
    rows = [*zip(corpus.doc_id.tolist(), corpus.text), *((1000 + r["doc_id"], r["text"]) for r in odd.filter("doc_id is not null").select("doc_id", "text").dropDuplicates(["doc_id"]).collect())]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).toPandas().set_index("doc_id")
    fps = [plain_fp(t) for _, t in rows]
    assert got.fingerprint.to_dict() == {i: f"{f:016x}" for (i, _), f in zip(rows, fps)}
    assert got.component_id.to_dict() == dict(zip([i for i, _ in rows], plain_components([i for i, _ in rows], fps)))


@pytest.mark.parametrize("tile", [1024, 5])
def test_links_join_all_that_are_near(spark, tile):
    rng = random.Random(2)
    fps = [rng.getrandbits(64) for _ in range(300)]
    for f in fps[:60]:
        for _ in range(5):
            x = f
            for b in rng.sample(range(64), rng.randint(1, 4)):
                x ^= 1 << b
            fps.append(x)
    fps = sorted({*fps, *((1 << 63) ^ k for k in range(200))})  # a large block
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    frame = spark.createDataFrame([(f,) for f in signed], "fp long")
    roots = {r["node"]: r["root"] for r in neardup.components(neardup.links(frame, tile)).collect()}
    want = plain_components(signed, fps)
    assert [roots.get(s, s) for s in signed] == want


def test_one_of_each_group_stays(spark, odd):
    groups = neardup.groups(odd).select("root").distinct().count()
    kept = neardup.keep_one(odd)
    assert kept.columns == odd.columns
    assert kept.count() == groups == neardup.groups(kept).select("root").distinct().count()


# --- op9 ---------------------------------------------------------------------------------------------------------

def test_table_follows_preferences():
    shards = ["a", "b", "c"]
    got = sharding.lookup_table(shards, 13)
    h = lambda s, salt: int(hashlib.md5(f"{salt}:{s}".encode()).hexdigest()[:16], 16)
    order = [[(h(s, "offset") % 13 + j * (h(s, "skip") % 12 + 1)) % 13 for j in range(13)] for s in shards]
    table = {}
    while len(table) < 13:
        for i in range(3):
            if len(table) < 13:
                table[next(x for x in order[i] if x not in table)] = i
    assert got == [table[x] for x in range(13)]
    with pytest.raises(ValueError):
        sharding.lookup_table(shards, 12)


def test_few_slots_move():
    names = [f"n{i}" for i in range(20)]
    a, b = sharding.lookup_table(names, 2003), sharding.lookup_table(names[:-1], 2003)
    sizes = Counter(a)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    assert sum(x != y for x, y in zip(a, b) if x != 19) < 0.1 * 2003


def test_place_replaces_and_keeps(odd):
    got = sharding.place(odd)
    assert sorted(got.columns) == sorted(odd.columns) and got.filter("shard = 'old' or shard is null").count() == 0
    assert got.groupBy("doc_id", "text").agg(F.countDistinct("shard").alias("n")).filter("n > 1").count() == 0


# --- pipeline ----------------------------------------------------------------------------------------------------

def test_stages_on_odd_rows_and_nothing(spark, odd, nothing, tmp_path):
    import corpus_pipeline

    bench(spark).write.parquet(f"{tmp_path}/benchmark.parquet")
    fresh = itertools.count()
    for docs in (odd, nothing):
        for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, str(tmp_path))
            if i < len(corpus_pipeline.STAGES) - 1:
                assert out.columns == docs.columns
            out.write.parquet(path := f"{tmp_path}/{next(fresh)}")
            docs = spark.read.parquet(path)
        assert "shard" in docs.columns


def test_pipeline_equals_its_parts(spark):
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").toPandas()
    model = language.fit(spark.createDataFrame(docs), ~held_out("doc_id", 4, 2))
    said = language.identify(spark.createDataFrame(docs), model).toPandas().set_index("doc_id")
    docs = docs[(said.loc[docs.doc_id].score.to_numpy() >= 0.5) & (said.loc[docs.doc_id].lang_pred.to_numpy() != "und")]
    assert len(docs) > 150
    docs = docs[[a == b for a, b in zip(docs.doc_id, plain_components(docs.doc_id.tolist(), [plain_fp(t) for t in docs.text]))]]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW benchmark AS SELECT * FROM '{folder}/benchmark.parquet'")
    con.register("documents", docs)
    bad = set(con.execute(f"SELECT doc_id FROM ({SQL['op7_decontamination']}) WHERE contaminated").fetchdf().doc_id)
    docs = docs[~docs.doc_id.isin(bad)]
    con.unregister("documents")
    con.register("documents", docs)
    mixed = con.execute(SQL["op6_mix_sources"]).fetchdf()
    want = Counter({int(doc): int(taken / size + 0.5) for doc, taken, size in zip(mixed.doc_id, mixed.taken, mixed["size"]) if taken})
    got = Counter(r["doc_id"] for r in corpus_pipeline.run(spark, folder).select("doc_id").collect())
    assert got == +want


def test_rows_that_differ_elsewhere(spark):
    """Rows of one id, text and source but other columns are each taken; of a group the same one stays on every run."""
    rows = [(1, "a b c", "s", "en"), (1, "a b c", "s", "de"), (1, "a b c", "s", "de"), (2, None, None, "fr"), (2, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    taken = [tuple(r) for n in (1, 3) for r in sorted(mixing.take(docs.repartition(n)).collect(), key=repr)]
    half = len(taken) // 2
    assert taken[:half] == taken[half:]
    mixed = [round(r["taken"] / r["size"] + 1e-9) for r in mixing.mix(docs).collect() if r["size"]]
    assert half == sum(mixed) and {r[3] for r in taken} == {"en", "de"} and sum(r[3] == "en" for r in taken[:half]) <= 2
    ones = [sorted(map(tuple, neardup.keep_one(docs.repartition(n)).collect()), key=repr) for n in (1, 2, 5)]
    assert ones[0] == ones[1] == ones[2] and [r[0] for r in ones[0]] == [1, 2] and set(ones[0]) <= set(rows)


def test_components_of_a_hub(spark, monkeypatch):
    from cellsift.operators import hot

    monkeypatch.setattr(hot, "LEAST", 4)
    rng = random.Random(8)
    edges = [(900, i) for i in range(400)] + [(i, i + 1) for i in range(1_000, 1_060)] + [(rng.randint(2_000, 2_400), rng.randint(2_000, 2_400)) for _ in range(250)]
    label = {x: x for e in edges for x in e}
    while any(label[a] != label[b] for a, b in edges):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    found = {r["node"]: r["root"] for r in neardup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(found.get(x, x) == root for x, root in label.items()) and set(found) <= set(label)


def test_texts_of_many_languages_stay(spark):
    model = language.Model(["de", "en", "fr"], np.zeros((language.SLOTS, 3), np.float32), np.zeros((3, 3), np.float32))
    docs = spark.createDataFrame([(1, "der the le"), (2, None), (3, " 12 "), (4, "")], "doc_id long, text string")
    assert [r[0] for r in language.keep_identified(docs, model).collect()] == [1]


def test_placements_equal_plain_hashes(spark, odd):
    """Slot, shard and size of each row of the whole query, from the hash of its id or text and the plain filling."""
    table = sharding.lookup_table([f"shard-{i:03d}" for i in range(sharding.SHARDS)], sharding.SLOTS)
    rows = odd.select("doc_id", "text").collect()

    def slot(i, t):
        own = str(i) if i is not None else "\x00" + t if t is not None else "\x00"
        h = xxhash.xxh64_intdigest(own.encode(), 42)
        return (h - (1 << 64) * (h >> 63)) % sharding.SLOTS

    want = Counter((i, slot(i, t), f"shard-{table[slot(i, t)]:03d}", len((t or "").encode())) for i, t in rows)
    assert Counter(tuple(r) for r in sharding.placements(odd).collect()) == want


def test_severity_equals_plain_rule(spark, odd):
    """Features by their log odds, each text's grade by its words, and weights at which the likelihood is flat."""
    rng = random.Random(12)
    rows = []
    for i in range(900):
        g = rng.choice([0, 0, 0, 1, 2])
        bad = [rng.choice(["idiot", "schwein", "moron"][: g + 1]) for _ in range(g)]
        g = rng.choice([0, 1, 2]) if rng.random() < 0.2 else g  # words don't settle all
        rows.append((i, " ".join([*[rng.choice("the a of with Straße be to in".split()) for _ in range(12)], *bad]), g))
    model = toxicity.fit(spark.createDataFrame(rows, "id long, text string, grade int"))
    has = [(set(re.findall(r"[^\W\d_]+", t.lower())), g) for _, t, g in rows]
    bad, clean = sum(g > 0 for _, g in has), sum(g == 0 for _, g in has)
    z = {}
    for word in set().union(*(w for w, _ in has)):
        a, b = sum(word in w for w, g in has if g) + 0.5, sum(word in w for w, g in has if not g) + 0.5
        c, d = bad + 1 - a, clean + 1 - b
        z[word] = (math.log(a / c) - math.log(b / d)) / math.sqrt(1 / a + 1 / b + 1 / c + 1 / d)
    assert set(model.features) == {w for w, v in z.items() if abs(v) >= toxicity.LEAST_Z} and "idiot" in model.features

    def chances(text, weights, cuts):
        n = Counter(re.findall(r"[^\W\d_]+", (text or "").lower()))
        x = sum((1 + math.log(n[f])) * w for f, w in zip(model.features, weights) if n[f])
        up = [1 / (1 + math.exp(c - x)) for c in cuts]
        return [1 - up[0], *(u - v for u, v in zip(up, up[1:])), up[-1]]

    got = {r["doc_id"]: r for r in toxicity.grade(spark.createDataFrame([(i, t) for i, t, _ in rows] + [(-1, None)], "doc_id long, text string"), model).collect()}
    for i, t, _ in [*rows, (-1, None, 0)]:
        p = chances(t, model.weights, model.cuts)
        assert math.isclose(got[i]["expected_severity"], sum(k * v for k, v in enumerate(p)), rel_tol=1e-9)
        assert math.isclose(got[i]["p_toxic"], 1 - p[0], rel_tol=1e-9, abs_tol=1e-12) and got[i]["severity"] == max(range(3), key=lambda k: (p[k], -k))
    loss = lambda w, c: -sum(math.log(chances(t, w, c)[g]) for _, t, g in rows) / len(rows) + 5e-6 * sum(v * v for v in w)
    best = loss(model.weights, model.cuts)
    for k in range(len(model.features)):
        for step in (-0.5, 0.5):
            moved = np.array(model.weights, dtype=float)
            moved[k] += step
            assert loss(moved, model.cuts) > best - 1e-3
