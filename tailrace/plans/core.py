"""Registry of the core queries and their SQL; the query modules of the package fill it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tailrace.operators import messages

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with the SQL it is checked against where SQL can express it."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


P4_KEY = """CASE WHEN event_id IS NULL THEN NULL ELSE
 regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(event_id), '\\s+', '', 'g'), '^(urn:)?(uuid:)?', ''), '[{}()-]', '', 'g'),
 '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\\1-\\2-\\3-\\4-\\5') END"""


@query(f"SELECT key AS event_id FROM (SELECT {P4_KEY} AS key FROM bus_events) WHERE key IS NOT NULL GROUP BY key HAVING count(*) > 1")
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages.repeated_messages(table(spark, sf_dir, "bus_events"))


@query(f"""WITH k AS (SELECT *, {P4_KEY} AS key FROM bus_events),
 r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY delivered_at NULLS LAST, batch_no NULLS LAST) AS rn FROM k)
 SELECT key AS event_id, delivered_at, batch_no, length(data)::INTEGER AS data_chars FROM r WHERE key IS NULL OR rn = 1""")
def p4_exactly_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    once = messages.exactly_once(table(spark, sf_dir, "bus_events"))
    return once.select(messages.message_key(F.col("event_id")).alias("event_id"), "delivered_at", "batch_no", F.length("data").alias("data_chars"))
