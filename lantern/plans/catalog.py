"""Every registered query of the core and its SQL twin."""

from lantern.plans import case_queries, causal_queries, evaluation_queries, retrieval_queries, score_queries, telemetry_queries

PARTS = (telemetry_queries, evaluation_queries, retrieval_queries, causal_queries, score_queries, case_queries)

QUERIES: dict = {k: v for p in PARTS for k, v in p.QUERIES.items()}
ORACLES: dict = {k: v for p in PARTS for k, v in p.ORACLES.items()}
