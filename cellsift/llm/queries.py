"""Named queries of this subpackage over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellsift.llm import contamination, language, mixing, neardup, phrases, pii, quality, repair, repeats, scoring, sharding, tokens, toxicity
from cellsift.llm.text import held_out

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query
def op1_token_counts(spark, sf_dir):
    return tokens.count_tokens(_table(spark, sf_dir, "documents"))


@_query
def op2_toxicity(spark, sf_dir):
    """Grades for fitting: 0 not toxic, 1 toxic in good text, 2 toxic in poor text."""
    docs = _table(spark, sf_dir, "documents")
    marks = _table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("labelled"), (F.col("toxic") * (2 - F.coalesce("quality", F.lit(1)))).alias("grade"))
    graded = docs.select(F.col("doc_id").alias("id"), "text").join(marks, F.col("id") == F.col("labelled")).select("id", "text", "grade")
    return toxicity.grade(docs, toxicity.fit(graded))


@_query
def op3_language_id(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.fit(docs, ~held_out("doc_id", 4, 2))
    return language.identify(docs, model).select(
        "doc_id", held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score", "n_words", "n_switches")


@_query
def op4_pii(spark, sf_dir):
    return pii.find(_table(spark, sf_dir, "documents"))


@_query
def op5_quality_rules(spark, sf_dir):
    return quality.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@_query
def op6_mix_sources(spark, sf_dir):
    return mixing.mix(_table(spark, sf_dir, "documents"))


@_query
def op7_decontamination(spark, sf_dir):
    return contamination.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


@_query
def op8_simhash_neardup(spark, sf_dir):
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"))


@_query
def op9_sharding(spark, sf_dir):
    return sharding.placements(_table(spark, sf_dir, "documents"))


@_query
def op10_lm_scoring(spark, sf_dir):
    return scoring.score_texts(_table(spark, sf_dir, "documents"), held_out("doc_id", 5, 1))


@_query
def op11_phrase_collocations(spark, sf_dir):
    return phrases.collocations(_table(spark, sf_dir, "documents"))


@_query
def op12_suffix_dedup(spark, sf_dir):
    return repeats.remove_repeats(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@_query
def op13_conversation_repair(spark, sf_dir):
    """Every conversation's rows after damage, repaired; the digest is of the repaired lines."""
    turns = repair.damage(_table(spark, sf_dir, "conversations"))
    return repair.repair(turns, times_col="times").withColumn("repaired_sha256", F.sha2("repaired", 256)).drop("repaired")


# --- SQL ---------------------------------------------------------------------------------------------------------

_PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_DIGITS = "regexp_replace({m}, '[^0-9]', '', 'g')"
_LUHN = """list_sum(list_transform(range(1, len({d}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN reverse({d})[i]::INT
  WHEN reverse({d})[i]::INT > 4 THEN 2 * reverse({d})[i]::INT - 9 ELSE 2 * reverse({d})[i]::INT END)) % 10 = 0"""
_MOD97 = """list_reduce(list_concat([0::BIGINT], list_transform(string_split(substr({c}, 5) || substr({c}, 1, 4), ''),
  lambda ch: CASE WHEN ch = '' THEN 0 WHEN ch >= 'A' THEN ascii(ch) - 55 ELSE ch::INT END::BIGINT)),
  lambda a, v: (CASE WHEN v >= 10 THEN a * 100 + v ELSE a * 10 + v END) % 97) = 1"""
_VALID = {
    "email": "true",
    "ip": "list_max(list_transform(string_split(m, '.'), lambda p: CASE WHEN len(ltrim(p, '0')) > 3 THEN 999 ELSE coalesce(try_cast(p AS BIGINT), 999) END)) <= 255",
    "card": "len(d) BETWEEN 14 AND 19 AND " + _LUHN.format(d="d"),
    "phone": "len(d) BETWEEN 10 AND 15",
}


def _near_sql(kind: str) -> str:
    near = rf"(^|[^A-Za-z])({pii.CONTEXT[kind]})([^A-Za-z]|$)"
    return f"""{pii.SCORES[kind]} + CASE WHEN regexp_matches(substr(t, greatest(s - {pii.NEAR} + 1, 1), least(s, {pii.NEAR})), '{near}', 'i') THEN {pii.BONUS} ELSE 0 END"""


def _kind_sql(order: int, kind: str) -> str:
    return f"""{kind}_m AS (SELECT rid, t, regexp_extract_all(t, '{_PATTERNS[kind]}') AS m, string_split_regex(t, '{_PATTERNS[kind]}') AS b
    FROM d WHERE regexp_matches(t, '{_PATTERNS[kind]}')),
  {kind}_s AS (SELECT rid, t, unnest(m) AS m, unnest(list_transform(range(1, len(m) + 1), lambda i:
    list_sum(list_transform(b[1:i], lambda x: len(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: len(x))), 0)))::BIGINT AS s FROM {kind}_m),
  {kind} AS (SELECT rid, s, {order} AS k, '{kind}' AS kind, s + len(m) AS e, {_near_sql(kind)} AS score
    FROM (SELECT *, {_DIGITS.format(m='m')} AS d FROM {kind}_s) WHERE {_VALID[kind]})"""


# Heads at word boundaries, each with its longest end that passes, taken from the left behind the one before.
_ACCOUNTS = f"""iban_h AS (SELECT rid, t, unnest(range(1, len(t) - 13)) AS p FROM d WHERE regexp_matches(t, '[A-Z][A-Z][0-9][0-9]')),
  iban_r AS (SELECT rid, t, p - 1 AS s, substr(t, p, 4) || regexp_extract(substr(t, p + 4, 70), '^(\x20?[A-Z0-9]){{11,30}}[0-9A-Za-z_]?') AS run FROM iban_h
    WHERE regexp_matches(substr(t, p, 4), '^[A-Z][A-Z][0-9][0-9]$') AND NOT regexp_matches(substr(t, greatest(p - 1, 1), least(p - 1, 1)), '[0-9A-Za-z_]')),
  iban_e AS (SELECT rid, t, s, run, unnest(range(15, len(run) + 1)) AS n FROM iban_r WHERE len(run) > 14),
  iban_c AS (SELECT rid, t, s, max(n) AS n FROM (SELECT *, replace(substr(run, 1, n), ' ', '') AS code FROM iban_e
      WHERE NOT regexp_matches(substr(run, n + 1, 1), '[0-9A-Za-z_]')) WHERE regexp_matches(code, '^[A-Z0-9]{{15,34}}$') AND {_MOD97.format(c="code")} GROUP BY 1, 2, 3),
  iban_l AS (SELECT rid, any_value(t) AS t, list_concat([[]::STRUCT(s BIGINT, e BIGINT)[]], list([{{'s': s::BIGINT, 'e': (s + n)::BIGINT}}] ORDER BY s)) AS found FROM iban_c GROUP BY 1),
  iban AS (SELECT rid, x.s AS s, 4 AS k, 'iban' AS kind, x.e AS e, {_near_sql("iban").replace("(s - ", "(x.s - ").replace("least(s,", "least(x.s,")} AS score FROM (SELECT rid, t, unnest(list_reduce(found, lambda a, y:
    CASE WHEN len(a) = 0 OR y[1].s >= a[len(a)].e THEN a || y ELSE a END)) AS x FROM iban_l))"""


SQL["op4_pii"] = f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
  {', '.join(_kind_sql(i, k) for i, k in enumerate(pii.KINDS[:4]))}, {_ACCOUNTS},
  every AS ({' UNION ALL '.join(f'SELECT * FROM {k}' for k in pii.KINDS)}),
  joined AS (SELECT rid, {', '.join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in pii.KINDS[:4])}, count(*) AS n_spans,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) FILTER (k < 4) AS base,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k, e) AS spans, string_agg(score, ',' ORDER BY s, k, e) AS scores FROM every GROUP BY rid)
SELECT doc_id, {', '.join(f'coalesce(n_{k}, 0) AS n_{k}' for k in pii.KINDS[:4])}, sha256(coalesce(base, '')) AS base_sha256,
  coalesce(spans, '') AS spans, coalesce(n_spans, 0) AS n_spans, coalesce(scores, '') AS scores FROM d LEFT JOIN joined USING (rid)"""

SQL["op6_mix_sources"] = r"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source,
    len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS size FROM documents),
  s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS nth FROM d GROUP BY source),
  w AS (SELECT *, [5.0::DOUBLE, 2.0, 1.0][(nth - 1) % 3 + 1] AS weight, 2.0::DOUBLE * source_size AS cap FROM s),
  f AS (SELECT *, cap / weight AS ratio, (1.5::DOUBLE * (SELECT sum(source_size) FROM s)
    - coalesce(sum(cap) OVER before, 0)) / ((SELECT sum(weight) FROM w) - coalesce(sum(weight) OVER before, 0)) AS level
    FROM w WINDOW before AS (ORDER BY cap / weight, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  l AS (SELECT arg_min(level, (ratio, nth)) AS level FROM f WHERE level <= ratio),
  g AS (SELECT source, source_size, least(cap, l.level * weight) AS target FROM f, l),
  q AS (SELECT *, least(floor(target + 0.5), 2 * source_size)::BIGINT AS words FROM g),
  p AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY md5(doc_id::VARCHAR) NULLS FIRST, doc_id NULLS FIRST, size
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM d WHERE size > 0),
  b AS (SELECT *, ceil(source_size / 256)::BIGINT AS blocks, CASE WHEN source_size > 0 THEN words // source_size ELSE 0 END AS rounds FROM q),
  e AS (SELECT *, sum(slots) OVER (ORDER BY source IS NULL, source)::BIGINT AS upto FROM (SELECT *, (rounds * blocks + ceil((words - rounds * source_size) / 256))::BIGINT AS slots FROM b)),
  m AS (SELECT sum(slots)::BIGINT AS m FROM e),
  -- A step coprime to the slots, from next to their number over the golden ratio on.
  st AS (SELECT min(x) AS step FROM (SELECT m, unnest(range(greatest(1, round(m / ((1 + sqrt(5)) / 2)))::BIGINT, greatest(1, round(m / ((1 + sqrt(5)) / 2)))::BIGINT + 5000)) AS x FROM m) WHERE gcd(x, m) = 1),
  pt AS (SELECT slot, ((slot::HUGEINT * step) % m)::BIGINT AS point FROM (SELECT unnest(range(m)) AS slot, m FROM m), st),
  tu AS (SELECT slot, source, source_size, words, blocks, row_number() OVER (PARTITION BY source ORDER BY slot) - 1 AS turn FROM pt JOIN e ON point >= upto - slots AND point < upto),
  sb AS (SELECT slot, source, turn % blocks * 256 AS head, least(256, source_size - turn % blocks * 256, words - turn // blocks * source_size - turn % blocks * 256) AS w FROM tu),
  fs AS (SELECT rid, min(slot) AS first_slot, count(*) AS n_slots FROM p JOIN sb ON p.source IS NOT DISTINCT FROM sb.source AND w > 0 AND start < head + w AND start + size > head GROUP BY 1)
SELECT d.doc_id, d.size, q.source_size, q.target, CASE WHEN d.size = 0 THEN 0 ELSE (q.words // q.source_size) * d.size
  + greatest(least(p.start + d.size, q.words % q.source_size) - p.start, 0) END::BIGINT AS taken, first_slot, coalesce(n_slots, 0)::BIGINT AS n_slots
FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source LEFT JOIN p ON d.rid = p.rid LEFT JOIN fs ON d.rid = fs.rid"""

_WORDS = (r"list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
          r"'[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')")
SQL["op7_decontamination"] = f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
  i AS (SELECT item_id, w, least(13, len(w)) AS n FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
  iw AS (SELECT DISTINCT item_id, n, array_to_string(w[a:a + n - 1], ' ') AS win FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS a FROM i)),
  dw AS (SELECT rid, a, n, array_to_string(w[a:a + n - 1], ' ') AS win
    FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS a FROM d, (SELECT DISTINCT n FROM iw))),
  h AS (SELECT rid, a, n, item_id FROM dw JOIN iw USING (n, win)),
  c AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(a, a + n)) AS p FROM h) GROUP BY rid),
  t AS (SELECT rid, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT rid, item_id FROM h) GROUP BY rid)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated FROM d LEFT JOIN c USING (rid) LEFT JOIN t USING (rid)"""

SQL["op11_phrase_collocations"] = r"""WITH p AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w
    FROM (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
  t AS (SELECT lang, sum(len(w))::HUGEINT AS n FROM p GROUP BY lang),
  g AS (SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase
    FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM p, (SELECT unnest([1, 2, 3, 4, 5]) AS m))),
  f AS (SELECT lang, m, phrase, count(*)::HUGEINT AS f FROM g GROUP BY ALL HAVING count(*) >= 100),
  c AS (SELECT lang, phrase, m, f AS a, string_split(phrase, ' ') AS w, unnest(range(1, m)) AS k FROM f WHERE m > 1),
  s AS (SELECT c.lang, c.phrase, c.a, x.f AS l, y.f AS r, t.n, (1000 * c.a * t.n) // (x.f * y.f) AS score, k FROM c JOIN t ON t.lang = c.lang
    JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(w[1:k], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(w[k + 1:], ' ')),
  b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
  i AS (SELECT lang, phrase, max(a) AS longer FROM (SELECT lang, a, array_to_string(w[z:z + q - 1], ' ') AS phrase
    FROM (SELECT *, unnest(range(1, m - q + 2)) AS z FROM (SELECT DISTINCT lang, w, a, m, unnest(range(2, m)) AS q FROM c))) GROUP BY ALL)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l,
  r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM b LEFT JOIN i USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 100 * a
  QUALIFY rank <= 2000"""
