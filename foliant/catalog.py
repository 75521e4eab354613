"""Registry of the core queries and their SQL."""

from __future__ import annotations

from foliant.operators import archive, engine, evaluation, layouts, neighbours, orphans, retrieval, router, sampling, spatial, summary
from foliant.sources import queries as trips

_MODULES = [orphans, archive, retrieval, router, spatial, summary, evaluation, sampling, neighbours, layouts, engine, trips]

QUERIES: dict = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
SQL: dict = {k: v for m in _MODULES for k, v in m.SQL.items()}
