"""Personal data in texts: patterns propose spans, checksums confirm them, context words adjust the score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Possessive quantifiers and the look-behind only save time: a run that fails at its first character fails at every
# other one, and \G lets a match begin where the last one ended.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
# Runs of fewer digits would be dropped anyway.
CARD = r"[0-9](?:[\x20-]?[0-9]){13,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# Only the head is consumed, so the next number may begin within the run that follows. The run takes one character more
# where it ends inside a word.
IBAN = r"(?<![0-9A-Za-z_])[A-Z]{2}[0-9]{2}(?=((?:\x20?[A-Z0-9]){11,30}+[0-9A-Za-z_]?))"
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
#: Kinds in order; the first four are the base.
KINDS = ("email", "ip", "card", "phone", "iban")
BASE = 4
#: Score of a confirmed span, and what a context word within NEAR code points before it adds.
SCORES = {"email": 80, "ip": 60, "card": 80, "phone": 60, "iban": 80}
BONUS, NEAR = 20, 40
CONTEXT = {
    "email": "mail|contact|contacto|kontakt",
    "ip": "ip|host|server|address|adresse",
    "card": "card|visa|credit|karte|carte|tarjeta",
    "phone": "phone|tel|call|mobile|telefon|tel[eé]fono",
    "iban": "iban|account|konto|compte|cuenta|bank",
}


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    def part(c, i):
        d = c.cast("int") * (i % 2 + 1)
        return F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), part), F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def mod97(code: Column) -> Column:
    """Whether an account number without spaces leaves 1 modulo 97 (first four characters moved to the end, letters as 10 to 35)."""
    moved = F.concat(F.substr(code, F.lit(5)), F.substr(code, F.lit(1), F.lit(4)))

    def step(a, c):
        v = F.ascii(c)
        return F.when(v >= 65, a * 100 + v - 55).otherwise(a * 10 + v - 48) % 97

    return F.aggregate(F.split(moved, ""), F.lit(0), lambda a, c: F.when(c == "", a).otherwise(step(a, c)).cast("int")) == 1


def _account(run: Column) -> Column:
    """Code points of the longest account number at the start of a run, tried at each word boundary; null if none passes."""
    def passes(end):
        code = F.regexp_replace(F.substr(run, F.lit(1), end), " ", "")
        return ~F.substr(run, end + 1, F.lit(1)).rlike("[0-9A-Za-z_]") & code.rlike("^[A-Z0-9]{15,34}$") & mod97(code)

    return F.array_max(F.filter(F.sequence(F.lit(15), F.length(run)), passes))


def _confirmed(kind: str, match: Column) -> Column:
    digits = _digits(match)
    if kind == "ip":
        return match.rlike(rf"^{OCTET}\.{OCTET}\.{OCTET}\.{OCTET}$")
    if kind == "card":
        return F.length(digits).between(14, 19) & luhn(digits)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


#: Items that a scan holds before it adds them to its result; pieces before a match that may hold its context.
BLOCK, PIECES = 256, NEAR // 4


def _let(value: Column, fn) -> Column:
    """``fn`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def _scan(items: Column, start: Column, step, kind: str) -> Column:
    """Results of a walk over an array: ``step`` gives the next state and a result for a state and an item.

    Results are gathered in blocks, so a long array is not copied once an item.
    """
    none = F.array().cast(f"array<{kind}>")

    def one(acc, item):
        state, out = step(acc["state"], item)
        return F.struct(state.alias("state"), F.concat(acc["out"], F.array(out)).alias("out"))

    def block(acc, k):
        return _let(
            F.aggregate(F.slice(items, k * BLOCK + 1, BLOCK), F.struct(acc["state"].alias("state"), none.alias("out")), one),
            lambda part: F.struct(part["state"].alias("state"), F.concat(acc["out"], part["out"]).alias("out")))

    blocks = F.sequence(F.lit(0), F.floor((F.size(items) - 1) / BLOCK).cast("int"))
    return F.when(F.size(items) > 0, F.aggregate(blocks, F.struct(start.alias("state"), none.alias("out")), block)["out"]).otherwise(none)


SPAN = "array<struct<start:int,kind:int,end:int,score:int>>"


def spans_of(text: Column, kind: str) -> Column:
    """Confirmed spans of one kind: the texts between matches and the matches, in turn, give the places.

    The match of an account number is its head; the longest number that passes behind the last span counts. Each step is
    linear in the text: places are running lengths, and a match's context comes from the pieces before it.
    """
    pattern, order = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE, "iban": IBAN}[kind], KINDS.index(kind)
    matches, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    runs = F.regexp_extract_all(text, F.lit(pattern), F.lit(1)) if kind == "iban" else F.array().cast("array<string>")
    tail = lambda c: F.substring(c, -NEAR, NEAR)

    def pieces(x):
        m, b = x["m"], x["b"]
        sizes = F.transform(m, lambda match, i: F.struct(F.length(F.get(b, i)).alias("gap"), F.length(match).alias("size")))
        return _let(F.struct(
            m.alias("m"), x["r"].alias("r"), sizes.alias("sizes"),
            # What stands before match i, of every piece the last code points only.
            F.transform(m, lambda match, i: F.concat(tail(F.get(b, i)), tail(match))).alias("both"),
            F.transform(m, lambda match, i: tail(F.get(b, i))).alias("gaps")), placed)

    def placed(x):
        step = lambda at, s: ((at + s["gap"] + s["size"]).cast("int"), (at + s["gap"]).cast("int"))
        return _let(F.struct(x["m"].alias("m"), x["r"].alias("r"), x["both"].alias("both"), x["gaps"].alias("gaps"),
                             _scan(x["sizes"], F.lit(0), step, "int").alias("starts")), judged)

    def judged(x):
        def span(match, i):
            start = F.get(x["starts"], i)
            if kind == "iban":
                end = start + _account(F.concat(match, F.get(x["r"], i)))
            else:
                end = F.when(_confirmed(kind, match), start + F.length(match))
            first = F.greatest(i - PIECES, F.lit(0))
            context = tail(F.concat(F.array_join(F.slice(x["both"], first + 1, i - first), ""), F.get(x["gaps"], i)))
            near = context.rlike(rf"(?i)(?:^|[^A-Za-z])(?:{CONTEXT[kind]})(?:[^A-Za-z]|$)")
            score = F.lit(SCORES[kind]) + F.when(near, F.lit(BONUS)).otherwise(F.lit(0))
            return F.struct(start.cast("int").alias("start"), F.lit(order).alias("kind"), end.cast("int").alias("end"), score.cast("int").alias("score"))

        found = F.filter(F.transform(x["m"], span), lambda s: s["end"].isNotNull())
        return found if kind != "iban" else _let(found, apart)

    def apart(found):
        # An account number begins behind the one before it.
        def step(last, s):
            ok = s["start"] >= last
            return F.when(ok, s["end"]).otherwise(last).cast("int"), ok

        return _let(_scan(found, F.lit(0), step, "boolean"), lambda ok: F.filter(found, lambda s, i: F.get(ok, i)))

    spans = _let(F.struct(matches.alias("m"), between.alias("b"), runs.alias("r")), pieces)
    return F.when(text.rlike(pattern), spans.cast(SPAN)).otherwise(F.array().cast(SPAN))


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spans of personal data of every whole text, one row per row of ``docs``.

    Returns (id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans, scores). Base kinds are e-mail, IP (parts
    up to 255), card (14 to 19 digits, Luhn) and phone (10 to 15 digits); the method adds account numbers (15 to 34 characters, mod-97
    at each word boundary, the longest that passes).
    Matches are the leftmost ones per kind and do not overlap within a kind; kinds may overlap each other. Places are
    code points, the end exclusive. Every confirmed span stays; its score (0 to 100, in the order of ``spans``) rises
    by 20 where a context word stands within 40 code points before it. Null and empty texts have no spans: empty
    strings and the digest of the empty string. Repeated rows are searched each; other columns are not read. Columns
    and functions of Spark only; nothing is shuffled.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    read = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = read.select("id", *[spans_of(text, k).alias(k) for k in KINDS])
    base = F.array_sort(F.concat(*KINDS[:BASE]))
    every = F.array_sort(F.concat(*KINDS))
    return found.select(
        F.col("id").alias(id_col), *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:BASE]],
        F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(every).alias("spans"),
        F.size(every).cast("long").alias("n_spans"),
        F.array_join(F.transform(every, lambda s: s["score"].cast("string")), ",").alias("scores"),
    )
