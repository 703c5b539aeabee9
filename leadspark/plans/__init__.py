"""Registered queries over the test tables, and the oracle SQL of those that SQL expresses."""

from . import entity_queries, job_queries, market_queries, policy_queries, text_queries

MODULES = (text_queries, entity_queries, job_queries, market_queries, policy_queries)
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.SQL.items()}
