"""All registered queries. Importing the modules registers them."""

from __future__ import annotations

from citeweave.plans import curation, evaluation, grounding, retrieval, studies, training  # noqa: F401
from citeweave.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
