"""All queries of the reference's operators: name -> Spark query, name -> DuckDB SQL."""

from __future__ import annotations

from brindle.plans import corpus_queries, eval_queries, more_queries, report_queries
from brindle.streaming import curation, shield

QUERIES = {**corpus_queries.QUERIES, **eval_queries.QUERIES, **report_queries.QUERIES, **more_queries.QUERIES, **curation.QUERIES, **shield.QUERIES}
ORACLES = {**corpus_queries.ORACLES, **eval_queries.ORACLES, **report_queries.ORACLES, **more_queries.ORACLES, **curation.ORACLES, **shield.ORACLES}
