"""Registered queries and their SQL, gathered from the plan modules."""

from __future__ import annotations

from . import banks, building, corpus, metrics, mining, runs, selection, stores, streams, vectors  # noqa: F401
from .common import ORACLE_SQL, QUERIES  # noqa: F401
