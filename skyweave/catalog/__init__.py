"""Registered queries over the driver tables, each with an independent SQL check."""

from skyweave.catalog.base import ORACLES, QUERIES
from skyweave.catalog import (  # noqa: F401  (each module registers its queries)
    audits,
    cleaning,
    comparison,
    fusions,
    geography,
    joins,
    metrics,
    reshaping,
    scalars,
    storage,
)

__all__ = ["QUERIES", "ORACLES"]
