"""Conversation repair against a search over all edits."""

import heapq
import random
import re
import zlib

import pytest

from cellsift.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string, times int"
COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired"]


def damaged(conv, turn, role, text):
    """The rows that damage leaves of one row."""
    role, text = " " if role is None else role, " " if text is None else text
    fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
    if fate == 0:
        return []
    if fate == 1:
        text = ""
    if fate == 2:
        text = re.sub("[.!?]", "", text)
    if fate == 4:
        role = "user"
    return [(turn, role, text)] * (2 if fate == 3 else 1)


def brute(rows):
    """Expected row of one conversation: cheapest first, then ASCII-least, over whole edit sequences."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    faults, seen = [], set()
    for _, role, text in rows:
        body = text.rstrip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    illegal = sum(a[1][:1] + b[1][:1] not in {"su", "ua", "au"} for a, b in zip(rows, rows[1:]))
    heap, done = [(0, "", 0, ())], set()
    while heap:
        cost, audit, i, lines = heapq.heappop(heap)
        roles = "".join(line[0] for line in lines)
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            return (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, "\n".join(lines))
        if (i, lines, audit) in done or not re.fullmatch("(s|s?(ua)*u?)", roles):
            continue
        done.add((i, lines, audit))
        for role in ("user", "assistant"):
            heapq.heappush(heap, (cost + 3, audit + "I", i, (*lines, role + ":")))
        if i < len(rows):
            _, own, text = rows[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, lines))
            if faults[i] not in ("blank", "duplicate"):
                more = 3 * (faults[i] == "truncated")
                if own[:1]:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, (*lines, f"{own}:{text}")))
                for role in ("user", "assistant"):
                    heapq.heappush(heap, (cost + 3 + more, audit + "R", i + 1, (*lines, f"{role}:{text}")))


def by_conv(df):
    return {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in df.collect()}


def test_all_edits(spark):
    rng, rows = random.Random(1), []
    for conv in range(400):
        for i in range(rng.randint(1, 6)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", ""])
            text = rng.choice(["Yes.", "No!", "Why", "", " \n", "Yes.", "So ? \t", f"text {i}."])
            rows.append((conv, rng.choice([None, i, i, i, i + 2, 0]), role, text, rng.choice([1, 1, 1, 2])))
    found = by_conv(repair.repair(spark.createDataFrame(rows, SCHEMA).repartition(5), times_col="times"))
    expected = {}
    for conv in range(400):
        expected[conv] = brute([r[1:4] for r in rows if r[0] == conv for _ in range(r[4])])
    assert found == expected


def test_damaged_odd_rows(spark):
    rows = [(None, 0, "user", "a."), (None, None, None, None), (1, None, "user", None), (1, 3, "system", "x."), (1, 3, "assistant", "y"), (2, 1, None, "z."),
            *[(9, t, "user" if t % 2 else "assistant", f"t{t}.") for t in range(12)], *[(c, 5, "system", "s.") for c in range(30, 90)]]
    table = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, times string").repartition(3)
    found = by_conv(repair.repair(repair.damage(table), times_col="times"))
    expected = {conv: brute([x for r in rows if r[0] == conv for x in damaged(*r)]) for conv in {r[0] for r in rows}}
    assert found == expected
    dropped = [c for c in expected if c is not None and not any(damaged(*r) for r in rows if r[0] == c)]
    assert dropped and all(found[c] == (0, 0, 0, 0, 0, 0, "", "") for c in dropped)


def test_empty(spark):
    assert repair.repair(repair.damage(spark.createDataFrame([], SCHEMA)), times_col="times").collect() == []


@pytest.mark.parametrize("n", [3_000])
def test_long_conversation(spark, n):
    rows = [(7, i, "assistant" if i % 2 else "user", f"w{i}.", 1) for i in range(n)] + [(8, 0, "user", "q?", 1), (8, 1, "assistant", "a.", 1)]
    rows[10] = (7, 10, "user", "w8.", 1)  # seen before
    found = by_conv(repair.repair(spark.createDataFrame(rows, SCHEMA), times_col="times"))
    gaps, blank, double, endless, illegal, cost, audit, text = found[7]
    assert (gaps, blank, double, endless, illegal, cost) == (0, 0, 1, 0, 0, 7)
    # The row must go; a row of its role put back is cheaper than the loss of its answer.
    assert audit == "K" * 10 + "DI" + "K" * (n - 11)
    assert text.split("\n")[10] == "user:" and found[8][5:7] == (0, "KK")


def test_keys_of_other_types(spark):
    rows = [("b", 0, "user", "q?"), ("b", 1, "assistant", "a."), ("a", 0, "user", "q?"), (None, 0, "user", "q")]
    found = by_conv(repair.repair(spark.createDataFrame(rows, "conv_id string, turn int, role string, text string")))
    assert found["b"][5:7] == (0, "KK") and found["a"][5:7] == (3, "KI") and found[None][5:7] == (4, "D")
