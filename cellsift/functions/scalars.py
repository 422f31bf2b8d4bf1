"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c: str | Column) -> Column:
    """NaN and infinities become null."""
    x = col(c).cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def compact_float(c: str | Column) -> Column:
    """Six significant digits, non-finite becomes null."""
    x = finite(c)
    return F.when(x.isNotNull(), F.format_string("%.6g", x).cast("double"))


def ratio(a: str | Column, b: str | Column) -> Column:
    """a / b, null when b is 0."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def fold(c: str | Column) -> Column:
    """Key for names that differ only in case and outer blanks."""
    return F.lower(F.trim(col(c)))


def edges(lo: str | Column, hi: str | Column, bins: int) -> Column:
    """bins + 1 evenly spaced edges from lo to hi."""
    lo, hi = col(lo), col(hi)
    inner = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: lo + i * ((hi - lo) / bins))
    return F.concat(inner, F.array(hi))


def bin_index(v: str | Column, lo: str | Column, hi: str | Column, bins: int) -> Column:
    """0-based equal-width bin; the last bin is closed.

    A constant column falls in the middle bin, a range too narrow to be cut in the first.
    """
    v, lo, hi = col(v), col(lo), col(hi)
    step = (hi - lo) / bins
    guess = F.least(F.floor(F.try_divide(v - lo, hi - lo) * bins), F.lit(bins - 1))
    fixed = (
        F.when(v < lo + guess * step, guess - 1)
        .when((guess < bins - 1) & (v >= lo + (guess + 1) * step), guess + 1)
        .otherwise(guess)
    )
    return (
        F.when(lo == hi, F.lit(bins // 2))
        .when(lo + step == lo, F.lit(0))
        .otherwise(fixed)
        .cast("int")
    )


def strip_seq_id(c: str | Column) -> Column:
    """First token without ``db|`` prefixes; of what is left, the first non-empty ``|`` part."""
    token = F.element_at(F.split(F.trim(col(c)), r"\s+"), 1)
    token = F.regexp_replace(token, r"^(?:[A-Za-z]{2,3}\|)+", "")
    parts = F.filter(F.split(token, r"\|"), lambda p: p != "")
    return F.when(F.size(parts) > 0, F.element_at(parts, 1)).otherwise(token)


def organ_tokens(field: str | Column) -> Column:
    """``Stem|Root|Unknown`` -> [Stem, Root]."""
    parts = F.transform(F.split(F.coalesce(col(field), F.lit("")), r"\|"), lambda p: F.trim(p))
    return F.filter(parts, lambda t: (t != "") & (t != "Unknown"))


def organ_match(field: str | Column, target: str) -> Column:
    """True / false when the field names organs, null when it names none."""
    tokens = organ_tokens(field)
    want = target.strip().lower()
    return F.when(F.size(tokens) > 0, F.exists(tokens, lambda t: F.lower(t) == want))


def organ_class(has_target: str | Column, has_other: str | Column) -> Column:
    """root / partial / mismatch / unknown from the two per-candidate facts."""
    t, o = F.coalesce(col(has_target), F.lit(False)), F.coalesce(col(has_other), F.lit(False))
    return F.when(t & o, "partial").when(t, "root").when(o, "mismatch").otherwise("unknown")


def organ_status(fields: str | Column, target: str) -> Column:
    """Class of an array of organ fields against the target organ."""
    if not isinstance(target, str) or not target.strip():
        raise ValueError(f"target organ must be a non-empty string, got {target!r}")
    hits = F.transform(col(fields), lambda f: organ_match(f, target))
    return organ_class(F.exists(hits, lambda h: h), F.exists(hits, lambda h: ~h))


def organ_priority(status: str | Column) -> Column:
    s = col(status)
    return F.when(s == "root", 0).when(s == "partial", 1).when(s == "unknown", 2).otherwise(3)


def cluster_order(c: str | Column) -> list[Column]:
    """Sort keys: numeric ids by value first, then text."""
    c = col(c)
    number = F.when(c.rlike("^[0-9]+$"), c.cast("decimal(38,0)"))
    return [number.asc_nulls_last(), c.asc()]


def fold_cluster_ids(path: str | Column) -> Column:
    """Paths that differ only in the cluster number become one."""
    return F.regexp_replace(
        col(path), r"(?:cluster[-_]?|clusters\.|per_cluster\.|cluster)(\d+)", "<CLUSTER_ID>"
    )


def tokens(text: str | Column) -> Column:
    """Latin words in lower case, then single CJK characters."""
    t = F.coalesce(col(text), F.lit(""))
    words = F.transform(F.regexp_extract_all(t, F.lit("([a-zA-Z0-9_]+)"), F.lit(1)), F.lower)
    return F.concat(words, F.regexp_extract_all(t, F.lit("([一-鿿])"), F.lit(1)))


def token_estimate(text: str | Column) -> Column:
    """Four characters to a token, at least one unless empty."""
    n = F.length(F.coalesce(col(text), F.lit("")))
    return F.when(n == 0, F.lit(0)).otherwise(F.greatest(F.lit(1), F.floor(n / 4))).cast("long")
