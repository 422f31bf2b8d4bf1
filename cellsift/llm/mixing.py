"""Mixing sources to target weights along a low-discrepancy schedule of blocks."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellsift.llm.text import SPACE, fresh, row_hash
from cellsift.operators.running import running
from cellsift.session import durable

#: Words of a block, share of all words that the mix takes, times a source may be repeated, weights by turn.
BLOCK, SHARE, MOST, WEIGHTS = 256, 1.5, 2.0, (5, 2, 1)
#: Sources up to which their table is broadcast; more are joined.
FEW, PIECE = 20_000, 1024


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= FEW else df


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, weight, target) from (source, source_size), one row per source.

    Sources by code point, null last, take the weights in turn. All targets sum to ``share`` of all sizes; a target stops at
    ``most`` times its source's size and the excess goes to the others by weight, until none is above. Sources of
    size zero have target zero.
    """
    ranked = running(
        sizes.select("source", "source_size", F.lit(1).alias("one"), F.col("source").isNull().cast("int").alias("last")),
        [], ["last", "source"], {"nth": ("sum", "one")})
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("nth") - 1) % len(weights)).cast("int"))
    weighed = ranked.select("source", "source_size", "nth", weight.alias("weight")).withColumn("cap", most * F.col("source_size"))
    weighed = durable(weighed.withColumn("ratio", F.col("cap") / F.col("weight")))
    total, all_weight = weighed.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0.0))).first()
    # In the order of cap / weight, level is what a unit of weight gets if just the sources before are capped.
    filled = running(weighed, [], ["ratio", "nth"], {"capped": ("sum", "cap", "before"), "spent": ("sum", "weight", "before")})
    level = (share * total - F.coalesce("capped", F.lit(0.0))) / (all_weight - F.coalesce("spent", F.lit(0.0)))
    line = filled.select("ratio", "nth", level.alias("level")).filter(F.col("level") <= F.col("ratio")).agg(
        F.min_by("level", F.struct("ratio", "nth"))).first()[0]
    goal = F.col("cap") if line is None else F.least("cap", F.lit(float(line)) * F.col("weight"))
    return weighed.select("source", "source_size", "weight", goal.alias("target"))


def plan(goals: DataFrame, block: int = BLOCK) -> DataFrame:
    """Adds per source: the words to take, its blocks, and its number of slots."""
    size = F.col("source_size")
    words = F.least(F.floor(F.col("target") + 0.5), F.floor(MOST * size)).cast("long")
    blocks = F.ceil(size / block).cast("long")
    full = F.when(size > 0, F.floor(F.col("words") / size)).otherwise(0).cast("long")
    return goals.withColumn("words", words).withColumn("blocks", blocks).withColumn(
        "slots", (full * F.col("blocks") + F.ceil((F.col("words") - full * size) / block)).cast("long"))


def schedule(planned: DataFrame, block: int = BLOCK) -> DataFrame:
    """(slot, source, turn, block, words): the mix in order, one row per slot.

    Slot k of M holds the point k g mod M, where g is coprime to M and next to M over the golden ratio; the points
    are a permutation, and equal shares of neighbouring slots go to each source in proportion to its slots. A
    source's slots, ranked, take its blocks in turn, again from the first after the last; the last slot takes what its
    target leaves.
    """
    spark = planned.sparkSession
    ends = durable(running(planned.withColumn("null_", F.col("source").isNull().cast("int")), [], ["null_", "source"], {"upto": ("sum", "slots")}))
    m, n = ends.agg(F.coalesce(F.sum("slots"), F.lit(0)), F.count("*")).first()
    m = int(m)
    g = max(1, round(m / ((1 + 5**0.5) / 2)))
    while m and math.gcd(g, m) > 1:
        g += 1
    big = lambda c: c.cast("decimal(19,0)")
    points = spark.range(m).select(F.col("id").alias("slot"), (big(F.col("id")) * big(F.lit(g)) % F.lit(max(m, 1)).cast("decimal(19,0)")).cast("long").alias("point"))
    # Sources by the pieces of the line [0, M) that they touch: an equality join finds the source of a point.
    lines = ends.filter("slots > 0").select(
        "source", "source_size", "blocks", F.col("words").alias("goal"), F.col("upto").alias("stop"), (F.col("upto") - F.col("slots")).alias("start"))
    lines = lines.select("*", F.explode(F.sequence(F.floor(F.col("start") / PIECE), F.floor((F.col("stop") - 1) / PIECE))).alias("piece"))
    lines = _small(lines, n + m // PIECE)
    taken = points.withColumn("piece", F.floor(F.col("point") / PIECE)).join(lines, "piece").filter("point >= start AND point < stop")
    ranked = running(
        taken.select("slot", "source", "source_size", "blocks", "goal", F.lit(1).alias("one")),
        ["source"], ["slot"], {"rank": ("sum", "one")})
    turn = F.col("rank") - 1
    nth = F.floor(turn / F.col("blocks"))
    spot = turn - nth * F.col("blocks")
    before = nth * F.col("source_size") + spot * block
    own = F.least(F.lit(block), F.col("source_size") - spot * block, F.col("goal") - before)
    return ranked.select("slot", "source", turn.alias("turn"), spot.cast("long").alias("block"), F.greatest(own, F.lit(0)).cast("long").alias("words"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: tuple[str, ...] = (), block: int = BLOCK) -> DataFrame:
    """(id, size, source_size, target, taken, first_slot, n_slots, *keep), one row per row of ``docs``: the words of each text that
    the mix takes, and the slots of the schedule in which it stands: the first one (null: in none) and how many.

    Size is the number of words between ASCII white space; null and empty texts have none and nothing is taken. The texts
    of a source are shuffled (by the MD5 of their id, then id and size) and laid end to end; this line is cut into blocks of ``block`` words (the last
    one may be shorter) and the slots of ``schedule`` take blocks. So each source gives its target, rounded to a word,
    and a text at most twice its words. Null is a source like others, the last. Rows without an id come first in the
    shuffle. Repeated rows count each. Other columns are not read. Same input, same result.

    Every ordered step runs over ranges of rows, so a source with most of the rows spans many tasks.
    """
    count = F.size(F.array_remove(F.split(F.coalesce(F.col(text_col), F.lit("")), SPACE), "")).cast("long")
    sized = durable(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), count.alias("size"), *keep))
    goals = durable(plan(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"))), block))
    n = goals.count()
    slots = durable(schedule(goals, block))
    mixed = F.md5(F.col("id").cast("string").cast("binary"))
    some = sized.filter("size > 0").withColumn("mixed", mixed)
    laid = running(some, ["source"], ["mixed", "id", "size", *keep], {"start": ("sum", "size", "before")}).withColumn("start", F.coalesce("start", F.lit(0)).cast("long"))
    # A text meets the slots of the blocks that it touches.
    touched = laid.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block))))
    s = slots.select("slot", F.col("source").alias("slot_source"), F.col("block").alias("slot_block"), "words")
    met = touched.join(s, F.col("source").eqNullSafe(F.col("slot_source")) & (F.col("block") == F.col("slot_block")), "left")
    begin = F.col("block") * block
    part = F.least(F.col("start") + F.col("size"), begin + F.coalesce("words", F.lit(0))) - F.greatest("start", begin)
    took = met.groupBy("id", "source", "start", "size", *keep).agg(
        F.coalesce(F.sum(F.greatest(part, F.lit(0))), F.lit(0)).alias("taken"), F.min(F.when(part > 0, F.col("slot"))).alias("first_slot"),
        F.count_if(part > 0).alias("n_slots"))
    zero = F.lit(0).cast("long")
    none = sized.filter("size = 0").select("id", "source", "size", zero.alias("taken"), F.lit(None).cast("long").alias("first_slot"), zero.alias("n_slots"), *keep)
    every = took.select("id", "source", "size", "taken", "first_slot", "n_slots", *keep).unionByName(none)
    g = _small(goals.select(F.col("source").alias("goal_source"), "source_size", "target"), n)
    return every.join(g, F.col("source").eqNullSafe(F.col("goal_source"))).select(
        F.col("id").alias(id_col), "size", "source_size", "target", F.col("taken").cast("long").alias("taken"), "first_slot", "n_slots", *keep)


def take(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of ``docs``, all columns, each as often as ``mix`` takes its words, rounded: at most twice.

    Only the text at a source's cut is taken in part; it is rounded. Rows without words are not taken. Rows of one id,
    text and source that differ in other columns are rows of their own, in the order of a hash of all columns. An
    empty table stays empty.
    """
    mark, pick, times = fresh(docs, "llm_mark"), fresh(docs, "llm_pick"), fresh(docs, "llm_times")
    marked = docs.withColumns({mark: F.xxhash64(text_col), pick: row_hash(docs)})
    read = marked.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(source_col).alias("source"),
                         F.col(mark).alias("mark"), F.col(pick).alias("pick"), F.col(source_col).alias("origin"))
    mixed = mix(read, "id", "text", "source", ("mark", "pick", "origin")).filter("size > 0")
    copies = F.floor(F.col("taken") / F.col("size") + 0.5).cast("int")
    # Rows equal in all columns, of which there is one in the join, share their copies.
    counts = mixed.groupBy("id", "mark", "pick", "origin").agg(F.sum(copies).alias("times_")).filter("times_ > 0")
    rows = marked.dropDuplicates([id_col, mark, pick, source_col])
    same = rows[id_col].eqNullSafe(counts["id"]) & (rows[mark] == counts["mark"]) & (rows[pick] == counts["pick"]) & rows[source_col].eqNullSafe(counts["origin"])
    joined = rows.join(counts.withColumnsRenamed({"times_": times}), same)
    kept = [rows[c] for c in docs.columns]
    return joined.select(*kept, F.explode(F.sequence(F.lit(1), F.col(times))).alias(times)).drop(times)
