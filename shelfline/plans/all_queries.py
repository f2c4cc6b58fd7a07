"""Every registered query."""

from shelfline.plans import (queries_archive, queries_catalog, queries_files, queries_review,  # noqa: F401
                             queries_stored, queries_text)
from shelfline.plans.registry import COMPARISONS, QUERIES

__all__ = ["COMPARISONS", "QUERIES"]
