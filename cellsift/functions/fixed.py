"""Fixed values that results must agree on: names, weights, tiers, tables."""

# Relation weights.
ACCURACY_WEIGHT = {"exact": 1.0, "synonym": 1.0, "subtype": 1.0, "supertype": 0.0, "unrelated": 0.0, "unmatched": 0.0}
HIERARCHY_WEIGHT = {"exact": 1.0, "synonym": 1.0, "subtype": 1.5, "supertype": 0.5, "unrelated": 0.0, "unmatched": 0.0}
CONFIDENCE_WEIGHT = {"high": 1.0, "medium": 1.0, "low": 0.5}

# The decisions each decision point allows, and the scope it needs.
DECISIONS = {
    "qc_threshold": ("session", ["threshold_set", "threshold_default"]),
    "resolution_select": ("session", ["resolution_chosen"]),
    "clustering_quality": ("session", ["clustering_accept", "clustering_adjust"]),
    "batch_effect": ("session", ["batch_effect", "condition_specific", "well_mixed"]),
    "de_method": ("session", ["wilcoxon", "pseudobulk_all", "pseudobulk_rare"]),
    "marker_quality": ("session", ["markers_accept", "markers_adjust_filter", "markers_fail"]),
    "kg_match": ("session", ["id_match_ok", "id_mismatch_gene_key", "id_mismatch_organ"]),
    "cross_species_routing": (
        "session",
        ["routing_accept", "routing_force_single", "routing_force_cross", "routing_multi_reference"],
    ),
    "unknown_cluster": ("session", ["single_unknown_type", "multiple_unknown_types"]),
    "global_quality": ("session", ["quality_good", "quality_acceptable", "quality_poor"]),
    "candidate_gap": (
        "cluster",
        ["first_decisive", "ambiguous_parent_child", "ambiguous_synonym", "ambiguous_true", "unknown"],
    ),
    "candidate_disambiguate": ("cluster", ["ambiguous_parent_child", "ambiguous_synonym", "ambiguous_true"]),
    "refine_effect": (
        "cluster",
        ["refine_effective", "refine_ineffective", "refine_skipped", "refine_autocorr_low"],
    ),
    "label_confirm": ("cluster", ["label_confirmed", "label_downgraded", "label_unknown"]),
}
RECORD_TYPES = ["session_start", "exec", "judgment", "session_end"]
RUN_ID_PATTERN = "^[A-Za-z0-9_]+\\.[A-Za-z0-9_]+#[1-9][0-9]*$"
MAX_ATTEMPT = 6

# The decision taken at each point when nothing is inspected.
ACCEPT = {
    "qc_threshold": "threshold_default",
    "resolution_select": "resolution_chosen",
    "clustering_quality": "clustering_accept",
    "batch_effect": "well_mixed",
    "de_method": "wilcoxon",
    "marker_quality": "markers_accept",
    "cross_species_routing": "routing_accept",
    "kg_match": "id_match_ok",
    "candidate_gap": "first_decisive",
    "candidate_disambiguate": "ambiguous_true",
    "refine_effect": "refine_skipped",
    "unknown_cluster": "multiple_unknown_types",
    "label_confirm": "label_confirmed",
    "global_quality": "quality_good",
}

# How good a decision is, per point; names not listed count as 1.
DECISION_TIER = {
    "qc_threshold": {"threshold_default": 1, "threshold_set": 2},
    "resolution_select": {"resolution_default": 1, "resolution_chosen": 2},
    "de_method": {"wilcoxon": 1, "pseudobulk_rare": 1, "pseudobulk_all": 1},
    "kg_match": {"id_match_no": 0, "id_match_partial": 1, "id_match_ok": 2},
    "batch_effect": {"batch_not_detected": 1, "batch_detected": 1, "batch_corrected": 2},
    "global_quality": {"global_quality_bad": 0, "global_quality_marginal": 1, "global_quality_ok": 2},
    "unknown_cluster": {"unknown_cluster_yes": 0, "unknown_cluster_flagged": 1, "unknown_cluster_clarified": 2},
}
# Points judged by rank only; a name not listed never improves.
DECISION_RANK = {
    "label_confirm": {"label_unknown": 0, "label_downgraded": 1, "label_confirmed": 2},
    "candidate_gap": {"ambiguous_true": 0, "ambiguous_synonym": 1, "ambiguous_parent_child": 1, "first_decisive": 2},
    "candidate_disambiguate": {"still_ambiguous": 0, "disambiguated_partial": 1, "disambiguated_full": 2},
}
# Metrics whose move between the two cited executions decides.
METRIC_DIRECTION = {
    "clustering_quality": [("silhouette_overall.mean", "up"), ("n_singleton", "down")],
    "marker_quality": [("n_clusters_in_range_10_50", "up")],
    "refine_effect": [("subcluster_silhouette.mean", "up"), ("n_subclusters_with_distinct_type", "up")],
}

# Species names of the graph that differ from the usual id.
SPECIES_ALIAS = {
    ("homo_sapiens", "Animal"): "Human",
    ("mus_musculus", "Animal"): "Mus musculus",
    ("danio_rerio", "Animal"): "Danio rerio",
    ("monopterus_albus", "Animal"): "Monopterus albus",
    ("oreochromis_niloticus", "Animal"): "Oreochromis niloticus",
    ("gasterosteus_aculeatus", "Animal"): "Gasterosteus aculeatus",
    ("astyanax_mexicanus", "Animal"): "Astyanax mexicanus",
    ("nothobranchius_furzeri", "Animal"): "Nothobranchius furzeri",
    ("oncorhynchus_mykiss", "Animal"): "Oncorhynchus mykiss",
    ("mastacembelus_armatus", "Animal"): "Mastacembelus armatus",
    ("oryzias_latipes", "Animal"): "Oryzias latipes",
}
# Species with a sequence database; the file prefix is the id with a capital first letter.
BLAST_SPECIES = [
    "arabidopsis_thaliana", "brassica_rapa", "oryza_sativa", "zea_mays", "triticum_aestivum", "glycine_max",
    "medicago_truncatula", "solanum_lycopersicum", "nicotiana_tabacum", "nicotiana_attenuata", "fragaria_vesca",
    "manihot_esculenta", "gossypium_hirsutum", "bombax_ceiba", "catharanthus_roseus",
    "populus_alba_var_pyramidalis", "homo_sapiens", "mus_musculus", "danio_rerio", "oryzias_latipes",
    "oreochromis_niloticus", "oncorhynchus_mykiss", "gasterosteus_aculeatus", "astyanax_mexicanus",
    "mastacembelus_armatus", "monopterus_albus", "nothobranchius_furzeri",
]
# Reference species when the coverage report names none.
DEFAULT_REFERENCES = {
    "plant": ["zea_mays", "oryza_sativa", "arabidopsis_thaliana"],
    "animal": ["mus_musculus", "homo_sapiens"],
}
ORTHOLOG_TYPES = ["ortholog_one2one", "ortholog_one2many", "ortholog_many2many"]
REQUIRED_META = ["kg_source", "kg_version", "organ", "annotation_date", "scanpy_version"]
