"""Marker lookup in the knowledge graph, its hierarchy, and its coverage.

The graph is four tables: gene(gene_id, name, species, species_type, marker_resource,
dataset), ontology(ontology_id, name, organ, species_type, type), marker_of(gene_id,
ontology_id, relation_confidence, info_source), ontology_relation(child, parent).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from cellsift.functions.fixed import BLAST_SPECIES, SPECIES_ALIAS
from cellsift.functions.scalars import col, fold
from cellsift.operators.hot import hot_join
from cellsift.operators.running import running
from cellsift.session import durable

#: Characters of the runs by which names and labels meet.
GRAM = 3
HIT_COLUMNS = ["cell_type", "organ", "ontology_id", "species_type", "ontology_type", "confidence", "source"]


def marker_rows(gene: DataFrame, marker_of: DataFrame, ontology: DataFrame) -> DataFrame:
    """The graph's edges with the names of both ends."""
    return (
        marker_of.join(
            gene.select("gene_id", F.col("name").alias("gene"), "species", F.col("species_type").alias("gene_type")),
            "gene_id",
        )
        .join(
            ontology.select(
                "ontology_id", F.col("name").alias("cell_type"), "organ", "species_type",
                F.col("type").alias("ontology_type"),
            ),
            "ontology_id",
        )
        .withColumnsRenamed({"relation_confidence": "confidence", "info_source": "source"})
    )


def hit_projection(
    rows: DataFrame, min_confidence: float = 0.0, strict_organ: bool = False, organ: str | None = None
) -> DataFrame:
    """Null confidence counts as 1; then the confidence floor and the whole-field organ filter."""
    hits = rows.withColumn("confidence", F.coalesce("confidence", F.lit(1.0)))
    if min_confidence > 0:
        hits = hits.where(F.col("confidence") >= min_confidence)
    if strict_organ:
        hits = hits.where(F.lower(F.coalesce("organ", F.lit(""))) == (organ or "").lower())
    return hits


def lookup_markers(
    genes: DataFrame, rows: DataFrame, species_type: str | None = None, species: str | None = None,
    min_confidence: float = 0.0, strict_organ: bool = False, organ: str | None = None,
) -> DataFrame:
    """Direct hits (gene, cell type, ...) of the distinct input genes."""
    found = rows
    if species_type:
        found = found.where(F.col("gene_type") == species_type)
    if species:
        found = found.where(F.col("species") == species)
    if min_confidence > 0:
        # An edge without confidence cannot pass a floor in the graph itself.
        found = found.where(F.col("confidence") >= min_confidence)
    hits = found.join(genes.select("gene").distinct(), "gene")
    return hit_projection(hits, min_confidence, strict_organ, organ).select("gene", *HIT_COLUMNS)


def lookup_via_orthologs(
    genes: DataFrame, orthologs: DataFrame, rows: DataFrame, species_type: str | None = None,
    min_confidence: float = 0.0, strict_organ: bool = False, organ: str | None = None,
) -> DataFrame:
    """Hits of the reference genes, handed back to every target gene that maps to them.

    ``orthologs`` is (gene, ref_species, ref_gene); rows without either are skipped.
    """
    pairs = (
        orthologs.where(
            (F.coalesce("ref_gene", F.lit("")) != "") & (F.coalesce("ref_species", F.lit("")) != "")
        )
        .select("gene", "ref_species", "ref_gene")
        .distinct()
        .join(genes.select("gene").distinct(), "gene", "left_semi")
    )
    found = rows.withColumnsRenamed({"gene": "ref_gene", "species": "ref_species"})
    if species_type:
        found = found.where(F.col("gene_type") == species_type)
    if min_confidence > 0:
        found = found.where(F.col("confidence") >= min_confidence)
    hits = found.join(pairs, ["ref_gene", "ref_species"])
    return hit_projection(hits, min_confidence, strict_organ, organ).select(
        "gene", *HIT_COLUMNS, F.col("ref_gene").alias("ortholog_ref_gene"),
        F.col("ref_species").alias("ortholog_ref_species"),
    )


def all_hits(direct: DataFrame, ortholog: DataFrame) -> DataFrame:
    """Both paths in one table, told apart by ``source_path``."""
    return direct.withColumn("source_path", F.lit("direct")).unionByName(
        ortholog.withColumn("source_path", F.lit("ortholog")), allowMissingColumns=True
    )


def ancestors(names: DataFrame, relation: DataFrame, max_hops: int | None = None, name: str = "name") -> DataFrame:
    """Distinct (name, ancestor, hops) over is-a steps, until nothing new appears or up to max_hops; no hops, no rows."""
    edge = relation.select(F.col("child").alias("_at"), F.col("parent").alias("ancestor")).distinct()
    step = names.select(F.col(name).alias("name")).distinct().withColumn("_at", F.col("name"))
    if max_hops is not None and max_hops <= 0:
        return step.select("name", F.col("_at").alias("ancestor"), F.lit(0).alias("hops")).limit(0)
    found, hop = None, 0
    while max_hops is None or hop < max_hops:
        hop += 1
        # Only the ancestors of the asked names travel on, never the whole closure; a pair that is known stops (cycles).
        step = step.join(edge, "_at").where(F.col("ancestor").isNotNull()).select("name", F.col("ancestor").alias("_at")).distinct()
        level = step.select("name", F.col("_at").alias("ancestor"), F.lit(hop).alias("hops"))
        level = durable(level if found is None else level.join(found, ["name", "ancestor"], "left_anti"))
        if level.isEmpty():
            return level if found is None else found
        found = level if found is None else found.unionByName(level)
        step = level.select("name", F.col("ancestor").alias("_at"))
    return found


def _grams(text: Column, sizes: Column) -> Column:
    """Distinct runs of characters of the given sizes."""
    chars = F.regexp_extract_all(text, F.lit("(?s)(.)"), F.lit(1))
    runs = lambda q: F.when(F.size(chars) >= q, F.transform(
        F.sequence(F.lit(1), F.size(chars) - q + 1), lambda i: F.array_join(F.slice(chars, i, q), ""))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.flatten(F.transform(sizes, runs)))


def match_candidates(labels: DataFrame, names: DataFrame, label: str = "label", name: str = "name") -> DataFrame:
    """(label, _key, name): names that hold the rarest run of three characters of a label, which few other names do.

    A shorter label is a run itself. Names are cut once per length of runs, at most three times their text; a run that is in
    most names meets its labels in a broadcast.
    """
    wanted = durable(labels.select(F.col(label).alias("label"), fold(label).alias("_key")).where("_key <> ''").distinct())
    short = names.select(F.col(name).alias("name")).where("name IS NOT NULL").distinct()
    sizes = wanted.select(F.collect_set(F.least(F.length("_key"), F.lit(GRAM)))).scalar()
    cut = durable(short.withColumn("_sizes", sizes).select("name", F.explode(_grams(F.lower("name"), F.col("_sizes"))).alias("_gram")))
    own = durable(wanted.select("label", "_key", F.explode(_grams(F.col("_key"), F.array(F.least(F.length("_key"), F.lit(GRAM))))).alias("_gram")))
    counted = hot_join(own, cut.groupBy("_gram").agg(F.count("*").alias("_n")), ["_gram"])
    rarest = counted.groupBy("label", "_key").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "_gram")).alias("_r"))
    by_gram = durable(rarest.where("_r.n > 0").groupBy(F.col("_r._gram").alias("_gram")).agg(F.collect_list(F.struct("label", "_key")).alias("_l")))
    return hot_join(cut, by_gram, ["_gram"], "inner").select("name", F.explode("_l").alias("_l")).select("_l.label", "_l._key", "name")


def match_names(
    labels: DataFrame, names: DataFrame, limit: int | None = None, label: str = "label", name: str = "name", seen: Observation | None = None,
) -> DataFrame:
    """Names that equal the label, or contain it, ignoring case; all, or up to ``limit`` per label.

    Candidates share the label's rarest run of characters and are then checked as a whole; ``seen`` takes the number
    of candidates as ``rows``.
    """
    met = match_candidates(labels, names, label, name)
    met = met if seen is None else met.observe(seen, F.count(F.lit(1)).alias("rows"))
    met = met.where(F.contains(F.lower("name"), F.col("_key"))).select(
        "label", "name", F.when(F.trim(F.lower("name")) == F.col("_key"), "casefold").otherwise("contains").alias("match"))
    if limit is None:
        # A label that is in most names has a row for each; their order spans many tasks.
        return running(met.withColumn("_one", F.lit(1)), ["label"], ["match", "name"], {"position": ("sum", "_one")}).select(
            "label", "name", "match", F.col("position").cast("int").alias("position"))
    # Rows beyond the limit are dropped before the shuffle.
    w = W.partitionBy("label").orderBy("match", "name")
    return met.withColumn("position", F.row_number().over(w)).where(F.col("position") <= limit)


def canonical_name(df: DataFrame, nodes: DataFrame, name: str, out: str = "node") -> DataFrame:
    """Add the node of exactly that name, else the first one equal ignoring case."""
    exact = nodes.select(F.col("name").alias("_exact")).distinct()
    loose = nodes.groupBy(fold("name").alias("_key")).agg(F.min("name").alias("_loose"))
    raw = F.trim(F.col(name))
    return (
        df.join(exact, raw == F.col("_exact"), "left")
        .join(loose, fold(name) == F.col("_key"), "left")
        .withColumn(out, F.when(raw != "", F.coalesce("_exact", "_loose")))
        .drop("_exact", "_key", "_loose")
    )


def unmatched_genes(genes: DataFrame, hits: DataFrame, limit: int | None = None) -> DataFrame:
    """Genes without any hit; with a limit the first ones by name, as a report shows them."""
    missing = genes.select("gene").distinct().join(hits.select("gene").distinct(), "gene", "left_anti")
    return missing.orderBy("gene").limit(limit) if limit else missing


def kg_provenance(gene: DataFrame, ontology: DataFrame, marker_of: DataFrame) -> DataFrame:
    """(item, value, n): node and edge counts, vocabularies, organ counts; a report may show a prefix."""
    nodes = gene.select(F.lit("Gene").alias("value")).unionAll(ontology.select(F.lit("Ontology").alias("value")))
    parts = [nodes.groupBy("value").agg(F.count("*").alias("n")).select(F.lit("node").alias("item"), "value", "n")]
    for column in ("species", "species_type", "marker_resource", "dataset"):
        seen = gene.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
        parts.append(seen.select(F.lit(column).alias("item"), "value", "n"))
    parts.append(
        marker_of.select(F.lit("edge").alias("item"), F.lit("marker_of").alias("value")).groupBy("item", "value").agg(
            F.count("*").alias("n"))
    )
    organs = ontology.groupBy(F.coalesce("organ", F.lit("None")).alias("value")).agg(F.count("*").alias("n"))
    parts.append(organs.select(F.lit("organ").alias("item"), "value", "n"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def target_coverage(gene: DataFrame, rows: DataFrame, high: int = 500, low: int = 50) -> DataFrame:
    """Per species: genes, genes with a type, types, edges, tier and strategy."""
    all_genes = gene.groupBy("species").agg(
        F.count("*").alias("n_genes"), F.count_distinct("name").alias("n_unique_genes")
    )
    typed = rows.groupBy("species").agg(
        F.count_distinct("gene").alias("n_genes_with_type"),
        F.count_distinct("cell_type").alias("n_types"),
        F.count("*").alias("n_edges"),
    )
    return coverage_tier(
        all_genes.join(typed, "species", "left").fillna(0, ["n_genes_with_type", "n_types", "n_edges"]), high, low
    )


def coverage_tier(coverage: DataFrame, high: int = 500, low: int = 50) -> DataFrame:
    n = F.col("n_genes_with_type")
    tier = F.when(n >= high, "high").when(n >= low, "medium").otherwise("low")
    text = (
        F.when(F.col("tier") == "high", "direct path is enough, skip the ortholog mapping")
        .when(F.col("tier") == "medium", "direct path first, up to three reference species fill the gaps")
        .otherwise("ortholog path is needed, up to three reference species")
    )
    return coverage.withColumn("tier", tier).withColumns(
        {
            "strategy": F.when(F.col("tier") == "high", "single_species")
            .when(F.col("tier") == "medium", "mixed")
            .otherwise("cross_species_only"),
            "rationale": F.concat(F.format_string("%d genes with a type: ", n), text),
        }
    )


def normalize_species(name, species_type):
    """Graph name of a species id; the id itself when no alias is known."""
    table = F.create_map(*[F.lit(x) for (n, kind), to in SPECIES_ALIAS.items() for x in (f"{n}\t{kind}", to)])
    return F.coalesce(F.try_element_at(table, F.concat_ws("\t", col(name), col(species_type))), col(name))


def blast_prefix(species_id):
    """File prefix of a species: one capital for known ids, else every part capitalised."""
    s = col(species_id)
    upper_first = lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 1 << 20))
    return F.when(s.isin(BLAST_SPECIES), upper_first(s)).otherwise(
        F.array_join(F.transform(F.split(s, "_"), upper_first), "_")
    )


def flatten_species(values: Sequence[str]) -> list[str]:
    """['a,b', 'b;c'] -> [a, b, c]."""
    parts = (p.strip() for v in values or [] for p in str(v).replace(";", ",").split(","))
    return list(dict.fromkeys(p for p in parts if p))
