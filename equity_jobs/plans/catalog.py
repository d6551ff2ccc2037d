"""All registered queries of the equity jobs, by name, with their DuckDB SQL."""

from __future__ import annotations

from equity_jobs.plans import market, reports, research

FLAGSHIP = "tk3_research_queue"
PARTS = [market, research, reports]
QUERIES = {name: query for part in PARTS for name, query in part.QUERIES.items()}
ORACLE_SQL = {name: text for part in PARTS for name, text in part.ORACLE_SQL.items()}
