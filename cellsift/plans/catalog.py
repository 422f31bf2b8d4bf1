"""All registered queries."""

from cellsift.plans import embedding, evaluation, files, knowledge, logs, quality, retrieval, summaries  # noqa: F401
from cellsift.plans.registry import QUERIES, SQL  # noqa: F401

FLAGSHIP = "evaluate_run"
