"""Every operator of the engine as a query over the tables of a folder."""

from __future__ import annotations

from . import aggregations, management, predicates, ranking, texts
from .base import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "aggregations", "management", "predicates", "ranking", "texts"]
