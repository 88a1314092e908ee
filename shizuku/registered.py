"""All registered queries and their SQL, gathered from the query modules."""

from __future__ import annotations

from shizuku.plans import domain, more_queries, observation_queries, occurrence_queries, record_queries, record_sets, rule_queries  # noqa: F401  they register themselves

QUERIES, SQL = domain.QUERIES, domain.SQL
