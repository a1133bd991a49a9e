"""Operators for training-data pipelines. Nothing outside this folder imports it."""

from .queries import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
