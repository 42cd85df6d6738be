"""All registered queries of the core library, and their SQL."""

from __future__ import annotations

from savora.plans import analytics_queries, ingest_queries, ranking_queries, service_queries, source_queries, stream_queries, text_queries

QUERIES = {**ranking_queries.QUERIES, **analytics_queries.QUERIES, **text_queries.QUERIES, **stream_queries.QUERIES, **service_queries.QUERIES, **ingest_queries.QUERIES, **source_queries.QUERIES}
SQL = {**ranking_queries.SQL, **analytics_queries.SQL, **text_queries.SQL, **stream_queries.SQL, **service_queries.SQL, **ingest_queries.SQL, **source_queries.SQL}
