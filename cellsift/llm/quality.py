"""Quality rules whose cutoffs carry a guarantee on false rejections."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellsift.llm.text import distinct, slices, words
from cellsift.session import durable

WINDOW = 5
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters")
#: Rules: a text is rejected where the value exceeds the cutoff. Cutoffs are tried from the loosest to the tightest.
RULES: dict[str, str] = {
    "symbol_ratio": "n_symbols / greatest(word_chars, 1)",
    "dup_line_ratio": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_ratio": "n_repeat_words / greatest(n_words, 1)",
    "upper_ratio": "n_upper / greatest(n_letters, 1)",
    "long_words": "least(word_chars / greatest(n_words, 1) / 100, 1D)",
}
GRID = (0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.08, 0.06, 0.04, 0.02)
#: Share of the good texts of a stratum that all rules together may reject.
RISK = 0.02
#: Length bands: the strata.
BANDS = (50, 200, 1000)
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], dtype=np.uint64)


def repeated_words(codes: np.ndarray, doc: np.ndarray, rows: int, n: int = WINDOW) -> np.ndarray:
    """Words per text that lie in an ``n``-word window found twice or more in that text.

    Equal windows meet by sorting a 64-bit hash; neighbours with equal hashes are then compared word by word, and if
    any differ (a collision) the windows are ranked exactly instead.
    """
    total = len(codes)
    if total < n:
        return np.zeros(rows, dtype=np.int64)
    at = np.flatnonzero(doc[n - 1:] == doc[: total - n + 1])
    with np.errstate(over="ignore"):
        mixed = (codes.astype(np.uint64) + np.uint64(1)) * _ODD[0]
        mixed ^= mixed >> np.uint64(31)
        key = (doc[at].astype(np.uint64) + np.uint64(1)) * _ODD[1]
        for k in range(n):
            key += mixed[at + k] * _ODD[k % 5] ** np.uint64(k // 5 + 1)
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    x, y = at[order[1:][same]], at[order[:-1][same]]
    if any((codes[x + k] != codes[y + k]).any() for k in range(n)) or (doc[x] != doc[y]).any():
        rows_of = np.stack([doc[at], *(codes[at + k] for k in range(n))], axis=1)
        _, rank = np.unique(rows_of, axis=0, return_inverse=True)
        twice = np.bincount(rank)[rank] > 1
    else:
        twice = np.zeros(len(at), dtype=bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
    edge = np.zeros(total + 1, dtype=np.int64)
    np.add.at(edge, at[twice], 1)
    np.add.at(edge, at[twice] + n, -1)
    return np.bincount(doc[np.cumsum(edge[:-1]) > 0], minlength=rows)


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, counts) of every whole text: words, their code points, symbols, repeated lines and words, lines, letters.

    Words lie between ASCII white space. A repeated line has a word and equals an earlier line of the text. Null and
    empty texts count zero throughout (lines: those with a word). Repeated rows are measured each.
    """
    fields = [docs.schema[id_col], *(T.StructField(c, T.LongType()) for c in COUNTS)]

    def run(batches):
        for part in slices(batches):
            rows, text = part.num_rows, pc.fill_null(part.column(1).cast(pa.string()), "")
            flat, doc, n_words = words(text)
            _, codes = distinct(flat)
            size = pc.utf8_length(flat).to_numpy(zero_copy_only=False)
            lines = pc.split_pattern(text, "\n")
            of = np.repeat(np.arange(rows), pc.list_value_length(lines).to_numpy(zero_copy_only=False))
            line = lines.flatten()
            real = pc.not_equal(pc.ascii_trim_whitespace(line), "").to_numpy(zero_copy_only=False)
            kinds, line_codes = distinct(line)
            pairs = of[real] * max(1, len(kinds)) + line_codes[real]
            once = np.unique(pairs)
            n_lines = np.bincount(of[real], minlength=rows)
            count = lambda pattern: pc.count_substring_regex(text, pattern).to_numpy(zero_copy_only=False)
            out = [
                n_words, np.bincount(doc, size, minlength=rows), count(r"[#*$%&|<>]"),
                n_lines - np.bincount(once // max(1, len(kinds)), minlength=rows), repeated_words(codes, doc, rows),
                n_lines, count(r"\p{Lu}"), count(r"\p{L}"),
            ]
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(np.asarray(x).astype(np.int64)) for x in out)], names=[f.name for f in fields])

    return docs.select(id_col, F.col(text_col).alias("text")).mapInArrow(run, T.StructType(fields))


def tail(k: int, n: int, p: float) -> float:
    """P(Bin(n, p) <= k), exactly."""
    if k >= n:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
    top = max(logs)
    return min(1.0, math.exp(top) * math.fsum(math.exp(x - top) for x in logs))


def band() -> Column:
    """The stratum of a text: its length band."""
    return sum(((F.col("n_words") >= b).cast("int") for b in BANDS), F.lit(0))


def select_cutoffs(measured: DataFrame, good: Column, risk: float = RISK, confidence: float = 0.05) -> dict[tuple[int, str], float]:
    """The tightest cutoffs per (stratum, rule) with which a stratum's rules together reject at most ``risk`` of its good texts.

    Each rule has an equal part of its stratum's risk, so the parts of all rules together keep the bound. For each
    stratum and rule the grid is walked from the loosest cutoff to the tightest and stops at the first one
    whose exact binomial p-value, P(Bin(good texts, part) <= rejected good texts), exceeds ``confidence`` divided by
    the number of strata and rules (fixed sequence within, Bonferroni across). So with probability 1 - ``confidence``
    every stratum keeps its bound. Too few labelled texts choose none. All labelled rows are counted; one row
    per stratum, rule and cutoff comes to the driver.
    """
    tests, risk = (len(BANDS) + 1) * len(RULES), risk / len(RULES)
    spots = [sum(((F.expr(v) > g).cast("int") for g in GRID), F.lit(0)).alias(name) for name, v in RULES.items()]
    held = measured.filter(good).select(band().alias("band"), *spots)
    stacked = held.select("band", F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("over")) for r in RULES])).alias("x"))
    rows = stacked.groupBy("band", "x.rule", "x.over").count().collect()
    chosen = {}
    for b in range(len(BANDS) + 1):
        for rule in RULES:
            mine = [(r["over"], r["count"]) for r in rows if r["band"] == b and r["rule"] == rule]
            n = sum(c for _, c in mine)
            for i, cutoff in enumerate(GRID):
                # The grid falls: a value above cutoff i is above all len(GRID) - i cutoffs from there on.
                if not n or tail(sum(c for over, c in mine if over >= len(GRID) - i), n, risk) > confidence / tests:
                    break
                chosen[b, rule] = cutoff
    return chosen


def judge(docs: DataFrame, labels: DataFrame, risk: float = RISK, confidence: float = 0.05, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, counts, base_failed, kept, reasons) of every whole text, one row per row of ``docs``.

    ``labels`` (id, quality) names good texts (1); an id with several labels is good if any says so, labels without a
    text are ignored. ``base_failed``: under 10 words, or over 20 % repeated words. ``kept`` is false there and where a
    rule's value exceeds the cutoff chosen for the text's stratum; ``reasons`` names these rules. Null and empty texts
    fail the base. With no labels no rule is active. The counts are checkpointed, texts are read once.
    """
    measured = durable(measure(docs, id_col, text_col))
    marks = labels.groupBy(F.col(id_col).alias("labelled")).agg(F.max("quality").alias("quality"))
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    holdout = measured.filter(~base).join(marks, F.col(id_col) == F.col("labelled"))
    cutoffs = select_cutoffs(holdout, F.col("quality") == 1, risk, confidence)
    b = band()
    broken = [
        F.when(_any([(b == s) & (F.expr(RULES[r]) > c) for (s, r), c in cutoffs.items() if r == rule]), F.lit(rule)) for rule in RULES
    ]
    reasons = F.concat_ws(",", *broken)
    return measured.select(
        id_col, *COUNTS[:5], base.alias("base_failed"), (~base & (reasons == "")).alias("kept"), reasons.alias("reasons"))


def _any(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out
