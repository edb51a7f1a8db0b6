"""All core queries by name, and their SQL twins."""

from __future__ import annotations

from lumenframe.plans import activity_queries, catalogue, data_quality, derived_queries, discovery_queries, profile_queries, scalar_queries, search_queries, snapshot_queries, taste_queries

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "p5_found"
for _module in (data_quality, snapshot_queries, catalogue, search_queries, taste_queries, activity_queries, profile_queries, derived_queries, scalar_queries, discovery_queries):
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
