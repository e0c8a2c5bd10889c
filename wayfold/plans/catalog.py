"""All registered analytics queries and their SQL."""

from __future__ import annotations

from wayfold.plans import queries, query_classic, query_functions, query_geometry, query_increments, query_tables, query_views

#: The modules register their queries in one table.
MODULES = (queries, query_views, query_functions, query_classic, query_geometry, query_increments, query_tables)
QUERIES, ORACLES = queries.QUERIES, queries.ORACLES
