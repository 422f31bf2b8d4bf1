"""Cross-species mapping records: sources, best hits, summaries, routing."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from cellsift.functions.fixed import DEFAULT_REFERENCES
from cellsift.operators.distribution import describe

MAPPING_COLUMNS = ["gene", "ref_species", "ref_gene", "score", "score_type", "mapping_type"]
MAX_REFERENCES = 3

_SOURCES: dict[str, Callable[[DataFrame], DataFrame]] = {}


def mapping_source(name: str):
    """Register a mapping source: DataFrame in, mapping records out."""

    def add(fn: Callable[[DataFrame], DataFrame]):
        _SOURCES[name] = fn
        return fn

    return add


def map_genes(name: str, rows: DataFrame) -> DataFrame:
    """Run a registered source and check the columns and score range it promised."""
    if name not in _SOURCES:
        raise KeyError(f"unknown mapping source {name!r}, known: {sorted(_SOURCES)}")
    out = _SOURCES[name](rows)
    missing = [c for c in MAPPING_COLUMNS if c not in out.columns]
    if missing:
        raise ValueError(f"mapping source {name} lacks columns {missing}")
    in_range = F.col("score").between(0, 100)
    return out.withColumn("score", F.when(in_range, F.col("score")).otherwise(F.raise_error("score outside 0..100")))


def limit_references(references: Sequence[str]) -> tuple[list[str], list[str]]:
    """First three distinct reference species and the warning for the rest."""
    names = list(dict.fromkeys(references))
    if len(names) <= MAX_REFERENCES:
        return names, []
    kept = names[:MAX_REFERENCES]
    return kept, [f"more than {MAX_REFERENCES} reference species, kept {kept}"]


def collect_marker_genes(markers: DataFrame, gene: str = "gene_id") -> DataFrame:
    """Sorted distinct non-empty genes."""
    return markers.select(F.col(gene).alias("gene")).where(F.col("gene") != "").distinct().orderBy("gene")


def collapse_best(records: DataFrame, min_score: float = 30.0, max_hits: int = 1) -> DataFrame:
    """Best hits per (gene, reference species), every species kept, positions by score.

    Rows beyond max_hits fall away before the shuffle, so a gene with very many
    hits costs its tasks only the few it keeps.
    """
    w = W.partitionBy("gene", "ref_species").orderBy(F.col("score").desc(), "ref_gene")
    best = (
        records.where(F.col("score") >= min_score)
        .withColumn("_r", F.row_number().over(w))
        .where(F.col("_r") <= max_hits)
        .drop("_r")
    )
    order = W.partitionBy("gene").orderBy(F.col("score").desc(), "ref_species", "ref_gene")
    return best.withColumn("position", F.row_number().over(order))


def unmapped_genes(genes: DataFrame, mapped: DataFrame) -> DataFrame:
    return genes.select("gene").distinct().join(mapped.select("gene").distinct(), "gene", "left_anti")


def mapping_summary(genes: DataFrame, mapped: DataFrame) -> DataFrame:
    """Input, mapped, unmapped, hit rate, mean distinct reference species per mapped gene."""
    per_gene = mapped.groupBy("gene").agg(F.count_distinct("ref_species").alias("_k"))
    return genes.select("gene").distinct().join(per_gene, "gene", "left").agg(
        F.count("*").alias("n_input"),
        F.count("_k").alias("n_mapped"),
        F.count_if(F.col("_k").isNull()).alias("n_unmapped"),
        F.round(F.count("_k") / F.greatest(F.count("*"), F.lit(1)), 4).alias("hit_rate"),
        F.round(F.coalesce(F.avg("_k"), F.lit(0.0)), 4).alias("mean_ref_species"),
    )


def mapping_types(mapped: DataFrame) -> DataFrame:
    """Counts by score type and mapping type."""
    return mapped.groupBy("score_type", "mapping_type").agg(F.count("*").alias("n"))


def mapping_scores(mapped: DataFrame) -> DataFrame:
    return describe(mapped, "score")


def error_warning(requests: DataFrame) -> DataFrame:
    """One row with a warning when all, or at least half, of the requests failed (column ``failed``)."""
    n, bad = F.count("*"), F.count_if("failed")
    return requests.agg(
        n.alias("n_requests"), bad.alias("n_errors"),
        F.when((n > 0) & (bad >= n), "all requests failed").when((bad > 0) & (bad >= n * 0.5), "most requests failed").alias("warning"),
    )


def routing(coverage: DataFrame) -> DataFrame:
    """Whether to map across species, and which references to use.

    ``coverage``: target_species, target_species_type, recommended_strategy, refs.
    Without a strategy nothing is mapped; without refs the defaults of the species
    type apply.
    """
    table = F.create_map(
        *[x for k, v in DEFAULT_REFERENCES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))]
    )
    kind = F.lower(F.trim(F.coalesce("target_species_type", F.lit("plant"))))
    default = F.coalesce(F.try_element_at(table, kind), F.try_element_at(table, F.lit("plant")))
    named = F.filter(F.coalesce("refs", F.array().cast("array<string>")), lambda r: r.isNotNull() & (r != ""))
    strategy = F.coalesce("recommended_strategy", F.lit("single_species"))
    need = strategy.isin("mixed", "cross_species_only") & (F.coalesce("target_species", F.lit("")) != "")
    return coverage.select(
        "target_species",
        strategy.alias("strategy"),
        need.alias("map_needed"),
        F.when(need, F.when(F.size(named) > 0, F.slice(named, 1, MAX_REFERENCES)).otherwise(default)).alias("references"),
        F.when(need, F.when(F.size(named) > 0, "report").otherwise("default")).alias("reference_source"),
        F.lit("routing_accept").alias("decision"),
    )


def reuse_key(markers: DataFrame, target: str, references: Sequence[str], source: str, gene: str = "gene_id") -> DataFrame:
    """Key under which a mapping may be reused: order of references and rows does not matter.

    The rows are hashed where they lie and the hashes added up; nothing is gathered.
    """
    prefix = f"cross_species_map__{target}__{','.join(sorted(references))}__{source}__"
    h = F.xxhash64(gene)
    return markers.select(gene).distinct().agg(
        F.concat(
            F.lit(prefix),
            F.substring(F.md5(F.concat_ws(":", F.count("*"), F.sum(h.cast("decimal(38,0)")), F.bit_xor(h))), 1, 8),
        ).alias("key")
    )
