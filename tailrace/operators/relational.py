"""The relational queries of the pipeline's repositories: look-ups, listings, counts, upserts and set tests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lookup(df: DataFrame, column: str, value) -> DataFrame:
    """Rows whose ``column`` equals ``value``; the filter reaches the scan."""
    return df.filter(F.col(column) == F.lit(value))


def list_by_status(docs: DataFrame, status: str, limit: int = 100) -> DataFrame:
    """The earliest ``limit`` documents of a status, ties by id."""
    return docs.filter(F.col("status") == status).orderBy("created_at", "id").limit(limit)


def page(df: DataFrame, order: Sequence[str], limit: int, offset: int = 0) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def count_by(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def failure_breakdown(docs: DataFrame, top: int = 10) -> DataFrame:
    """Failed documents by stage; a missing stage is ``unknown``."""
    stage = F.coalesce(F.nullif("failed_stage", F.lit("")), F.lit("unknown")).alias("stage")
    return docs.filter("status = 'failed'").groupBy(stage).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "stage").limit(top)


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key: the first in ``order``. The window group limit keeps one row per key and task before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def upsert(current: DataFrame, incoming: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """``current`` with ``incoming`` written over it: per key the incoming row that comes first in ``order``, else the current one."""
    both = current.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    return latest_per_key(both, keys, [F.desc("_new"), *order]).drop("_new")


def delete_where(df: DataFrame, condition: Column) -> DataFrame:
    """The rows that a deletion leaves: those for which ``condition`` isn't true."""
    return df.filter(~F.coalesce(condition, F.lit(False)))


def semi(df: DataFrame, keys: DataFrame, left: str, right: str) -> DataFrame:
    k = keys.select(F.col(right).alias("_k"))
    return df.join(k, F.col(left) == F.col("_k"), "left_semi")


def anti(df: DataFrame, keys: DataFrame, left: str, right: str) -> DataFrame:
    k = keys.select(F.col(right).alias("_k"))
    return df.join(k, F.col(left) == F.col("_k"), "left_anti")


def patch(df: DataFrame, changes: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """``df`` with the non-null values of ``changes`` (one row per key) in ``columns``."""
    new = changes.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_new_{c}") for c in columns])
    joined = df.join(new, F.col(key) == F.col("_key"), "left")
    return joined.select(*[F.coalesce(F.col(f"_new_{c}"), F.col(c)).alias(c) if c in columns else F.col(c) for c in df.columns])


def band_candidates(signatures: DataFrame) -> DataFrame:
    """``(a, b)``, a < b, of documents that share a band hash. Hashes that stand alone are dropped before the join."""
    bands = signatures.filter("band_hashes IS NOT NULL AND document_id IS NOT NULL").select("document_id", F.explode("band_hashes").alias("band")).filter("band IS NOT NULL").distinct()
    shared = bands.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1").select("band")
    kept = bands.join(shared, "band", "left_semi")
    return kept.select("band", F.col("document_id").alias("a")).join(kept.select("band", F.col("document_id").alias("b")), "band").filter("a < b").select("a", "b").distinct()
