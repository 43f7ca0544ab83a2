"""All relational and streaming queries by name, and the SQL that DuckDB checks them with."""

from __future__ import annotations

from lodestone.plans import batch, large, ordered, stream

QUERIES = {**batch.QUERIES, **large.QUERIES, **ordered.QUERIES, **stream.QUERIES}
ORACLE_SQL = {**batch.ORACLE_SQL, **large.ORACLE_SQL, **ordered.ORACLE_SQL, **stream.ORACLE_SQL}
