"""Every registered query of the package but those of the corpus operators."""

from __future__ import annotations

from recscope.plans import journals  # noqa: F401  (registers its queries)
from recscope.plans.queries import ORACLES, QUERIES, flagship_template_stats

__all__ = ["ORACLES", "QUERIES", "flagship_template_stats"]
