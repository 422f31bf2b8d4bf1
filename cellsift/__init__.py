"""Annotation and evaluation of sparse entity x feature tables on Spark.

Every public function takes DataFrames and returns DataFrames; key columns are
arguments, so cells, genes and clusters are only the usual names for them.
"""

__version__ = "0.1.0"
