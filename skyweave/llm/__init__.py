"""Operators for training-data pipelines and their registered queries."""

from skyweave.llm.queries import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]
