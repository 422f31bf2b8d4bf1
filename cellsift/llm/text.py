"""Words of Arrow text columns, and small helpers that the operators share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Text handled at once by a Python worker; one longer text is still handled whole.
SLICE_BYTES = 8 << 20
#: Split pattern of words, for Spark's functions.
SPACE = r"[\x20\x09-\x0D]+"


def slices(batches, column: str = "text", limit: int = SLICE_BYTES):
    """Cut record batches into runs of rows with at most ``limit`` bytes of text (one row at least)."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0)
        ends = np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def _flat(parts) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    flat = parts.flatten()
    counts = pc.list_value_length(parts).to_numpy(zero_copy_only=False)
    doc = np.repeat(np.arange(len(counts)), counts)
    keep = pc.not_equal(flat, "")
    mask = keep.to_numpy(zero_copy_only=False)
    if not mask.all():
        flat, doc = flat.filter(keep), doc[mask]
    return flat, doc, np.bincount(doc, minlength=len(counts))


def words(column: pa.Array, lower: bool = False) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Words between ASCII white space: all words, the row of each, words per row. Null is empty.

    ``lower`` lower-cases A-Z only.
    """
    text = pc.fill_null(column.cast(pa.string()), "")
    return _flat(pc.ascii_split_whitespace(pc.ascii_lower(text) if lower else text))


def letter_words(column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Runs of letters and marks, lower-cased; shape as for ``words``."""
    text = pc.utf8_lower(pc.fill_null(column.cast(pa.string()), ""))
    return _flat(pc.split_pattern_regex(text, r"[^\p{L}\p{M}]+"))


def distinct(flat: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Distinct values, and the index of each item among them."""
    coded = flat.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)


def crc_mod(column: str | Column, mod: int) -> Column:
    """crc32 of the value as text, modulo ``mod``; null counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(None)).cast("string").cast("binary")), F.lit(mod))


def held_out(id_col: str, mod: int, remainder: int) -> Column:
    """Whether a row belongs to the holdout; rows without an id don't."""
    return F.coalesce(crc_mod(id_col, mod) == remainder, F.lit(False))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def row_hash(df: DataFrame) -> Column:
    """A hash of all columns, the same in any order of the rows."""
    return F.xxhash64(*[F.to_json(F.struct(F.col(f"`{c}`"))) if "map<" in kind or "variant" in kind else F.col(f"`{c}`") for c, kind in df.dtypes])


def sample_rate(rows: int, wanted: int) -> float:
    return 1.0 if rows <= wanted else wanted / rows


def drawn(rate: Column, *keys: str) -> Column:
    """True for about ``rate`` of the rows, by a hash of ``keys``."""
    return F.pmod(F.xxhash64(*keys, F.lit("draw")), F.lit(1 << 30)) < rate * (1 << 30)
