"""The run log as a stream: tail, running usage, latest records, gaps."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from cellsift.operators.runlog import cited
from cellsift.sources.readers import BAD, LOG_SCHEMA

GAP_SCHEMA = T.StructType([
    T.StructField("run", T.StringType()), T.StructField("seq", T.LongType()), T.StructField("expected", T.LongType())])


def tail_log(spark: SparkSession, path: str, schema: str = LOG_SCHEMA, files_per_batch: int | None = None) -> DataFrame:
    """New lines of the log files in a folder; lines that are no JSON keep their text in ``_bad``."""
    full = T._parse_datatype_string(schema).add(BAD, T.StringType()).add("run", T.StringType())
    reader = spark.readStream.schema(full).option("columnNameOfCorruptRecord", BAD)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.json(path)


def split_batches(stream: DataFrame, good: Callable[[DataFrame, int], None], bad: Callable[[DataFrame, int], None], checkpoint: str):
    """Hand each batch's good rows and bad lines to two writers."""

    def both(batch: DataFrame, number: int) -> None:
        batch.persist()
        good(batch.where(F.col(BAD).isNull()).drop(BAD), number)
        bad(batch.where(F.col(BAD).isNotNull()).select(BAD), number)
        batch.unpersist()

    return stream.writeStream.foreachBatch(both).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_usage(stream: DataFrame) -> DataFrame:
    """(decision_point, path, n), kept up to date; the state is one number per cited path."""
    return cited(stream).groupBy("decision_point", "path").agg(F.count("*").alias("n"))


def stream_latest(stream: DataFrame) -> DataFrame:
    """Highest-seq execution per (run, step.op), whatever the order of arrival."""
    execs = stream.where("type = 'exec' AND run_id IS NOT NULL AND seq IS NOT NULL")
    return execs.groupBy("run", F.substring_index("run_id", "#", 1).alias("key")).agg(
        F.max("seq").alias("seq"), F.max_by(F.struct("run_id", "metrics"), "seq").alias("record"))


class _Gaps(StatefulProcessor):
    """Per run: the highest seq seen; a record above it that does not follow it is a gap."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._top = handle.getValueState("top", "top long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        top = self._top.get()[0] if self._top.exists() else 0
        # A batch's seqs of one run arrive in several chunks, in any order: 8 bytes a row are held to sort them together.
        seqs = np.unique(np.concatenate([np.zeros(0, dtype=np.int64), *(pdf["seq"].dropna().to_numpy(dtype=np.int64) for pdf in rows)]))
        seqs = seqs[seqs > top]
        expected = np.concatenate([[top], seqs])[:-1] + 1
        odd = seqs != expected
        if len(seqs):
            self._top.update((int(seqs[-1]),))
        yield pd.DataFrame({"run": key[0], "seq": seqs[odd], "expected": expected[odd]})

    def close(self) -> None:
        pass


def stream_gaps(stream: DataFrame) -> DataFrame:
    """(run, seq, expected) for every record that does not follow the one before it.

    Repeated and late records (at or below the highest seq of an earlier batch) report nothing.

    The state is one number per run. Needs the RocksDB state store.
    """
    return stream.select("run", "seq").where("run IS NOT NULL").groupBy("run").transformWithStateInPandas(
        statefulProcessor=_Gaps(), outputStructType=GAP_SCHEMA, outputMode="Append", timeMode="None")


MISSING_SCHEMA = T.StructType([
    T.StructField("run", T.StringType()), T.StructField("first", T.LongType()), T.StructField("last", T.LongType()), T.StructField("event", T.StringType())])


#: Seqs of a slot: the ranges that begin in it share one entry of the state.
SLOT = 1 << 16


class _Missing(StatefulProcessor):
    """Per run: the highest seq seen, and the ranges below it that are still missing."""

    def __init__(self, keep_ms: int | None):
        self._keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._top = handle.getValueState("top", "top long", self._keep_ms)
        self._open = handle.getMapState("open", "slot long", "first binary, last binary", self._keep_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        top = self._top.get()[0] if self._top.exists() else 0
        seqs = np.unique(np.concatenate([np.zeros(0, dtype=np.int64), *(pdf["seq"].dropna().to_numpy(dtype=np.int64) for pdf in rows)]))
        late, new = seqs[(seqs <= top) & (seqs > 0)], seqs[seqs > top]
        held = {slot: (np.frombuffer(a, dtype=np.int64), np.frombuffer(b, dtype=np.int64)) for (slot,), (a, b) in self._open.iterator()} if len(late) and self._open.exists() else {}
        first, last = (np.concatenate([np.zeros(0, dtype=np.int64), *(held[slot][c] for slot in sorted(held))]) for c in (0, 1))
        out = []
        if len(first):
            at = np.searchsorted(first, late, "right") - 1
            inside = late[(at >= 0) & (late <= last[at])]
            # What is left of the ranges: both ends in order, without the empty ones.
            first, last = np.sort(np.concatenate([first, inside + 1])), np.sort(np.concatenate([last, inside - 1]))
            first, last = first[first <= last], last[first <= last]
            cut = np.flatnonzero(np.diff(inside) > 1)
            if len(inside):
                out += [(int(a), int(b), "closed") for a, b in zip(inside[np.append(0, cut + 1)], inside[np.append(cut, len(inside) - 1)])]
        if len(new):
            before = np.append(top, new[:-1])
            gap = new - before > 1
            out += [(int(a) + 1, int(b) - 1, "missing") for a, b in zip(before[gap], new[gap])]
            first, last = np.concatenate([first, before[gap] + 1]), np.concatenate([last, new[gap] - 1])
            self._top.update((int(new[-1]),))
        self._store(first, last, held)
        yield pd.DataFrame({"run": [key[0]] * len(out), "first": [o[0] for o in out], "last": [o[1] for o in out], "event": [o[2] for o in out]})

    def _store(self, first: np.ndarray, last: np.ndarray, held: dict) -> None:
        """Ranges by slots of their first seq: one state call a slot, not one a range. Without ``held`` they join the open ones."""
        slots, starts = np.unique(first // SLOT, return_index=True)
        for slot, a, b in zip(slots.tolist(), np.split(first, starts[1:]), np.split(last, starts[1:])):
            if slot not in held and self._open.containsKey((slot,)):
                (x, y) = self._open.getValue((slot,))
                a, b = np.concatenate([np.frombuffer(x, dtype=np.int64), a]), np.concatenate([np.frombuffer(y, dtype=np.int64), b])
            elif slot in held and np.array_equal(held[slot][0], a) and np.array_equal(held[slot][1], b):
                continue
            self._open.updateValue((slot,), (a.tobytes(), b.tobytes()))
        for slot in set(held) - set(slots.tolist()):
            self._open.removeKey((slot,))

    def close(self) -> None:
        pass


def stream_missing(stream: DataFrame, keep_ms: int | None = None) -> DataFrame:
    """(run, first, last, event): ranges of seqs that are missing, and those of them that late records close.

    Seqs count from 1, in any order of arrival; repeated ones report nothing. What is missing and not closed lacks in the
    log. The state is one number per run and 16 bytes per open range; with ``keep_ms`` a run's state goes when it was
    not touched for that long. Needs the RocksDB state store.
    """
    return stream.select("run", "seq").where("run IS NOT NULL").groupBy("run").transformWithStateInPandas(
        statefulProcessor=_Missing(keep_ms), outputStructType=MISSING_SCHEMA, outputMode="Append", timeMode="None" if keep_ms is None else "ProcessingTime")
