"""All registered queries of the panel library and their SQL."""

from __future__ import annotations

from crosspanel.plans import book_queries, factor_queries, file_queries, health_queries, ingest_queries, judging_queries, ledger_queries, model_queries, panel_queries, price_queries, research_queries, table_queries, text_queries, wide_queries

MODULES = (factor_queries, table_queries, panel_queries, research_queries, file_queries, price_queries, book_queries, health_queries, ledger_queries, text_queries, ingest_queries, judging_queries, model_queries, wide_queries)
QUERIES: dict = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLE_SQL: dict = {k: v for m in MODULES for k, v in m.SQL.items()}
FLAGSHIP = "a14_quantile_spread"
