"""The registered queries: one per operator, each over its whole tables."""

from sheetweave.plans.catalog.registry import ORACLE, QUERIES  # noqa: F401
from sheetweave.plans.catalog import (  # noqa: F401
    geometry, filters, joins, aggregates, iterative, documents, prompting, editing,
)
