"""Classification of incidents: chunks, a pluggable scorer, the maximum over chunks, thresholds, and what is written back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tailrace.functions.text import section_chunks
from tailrace.taxonomy import LABELS

Scorer = Callable[[DataFrame], DataFrame]


def hash_score(chunk: Column, label: Column) -> Column:
    """A stand-in for a model that gives the same score everywhere: from the MD5 of chunk and label."""
    return F.conv(F.substring(F.md5(F.concat(chunk, F.lit("|"), label)), 1, 8), 16, 10).cast("long") % 10000 / F.lit(10000.0)


def hash_scorer(chunks: DataFrame) -> DataFrame:
    """``id, label, prob`` of ``chunks (id, chunk)`` by ``hash_score``."""
    return chunks.select("id", "chunk", F.explode(F.array(*[F.lit(x) for x in LABELS])).alias("label")).select("id", "label", hash_score(F.col("chunk"), F.col("label")).alias("prob"))


def chunked(incidents: DataFrame) -> DataFrame:
    return incidents.select("id", F.explode(section_chunks(F.col("title"), F.col("summary"), F.col("sections"))).alias("chunk"))


def pooled(incidents: DataFrame, scorer: Scorer = hash_scorer, thresholds: DataFrame | None = None) -> DataFrame:
    """``id, label, prob, active``: each label's largest score over the incident's chunks, and whether it reaches the label's threshold (one half unless given)."""
    best = scorer(chunked(incidents)).groupBy("id", "label").agg(F.max("prob").alias("prob"))
    if thresholds is None:
        return best.withColumn("active", F.col("prob") >= 0.5)
    return best.join(F.broadcast(thresholds), "label", "left").select("id", "label", "prob", (F.col("prob") >= F.coalesce("threshold", F.lit(0.5))).alias("active"))


def classify_incidents(incidents: DataFrame, labels: DataFrame, scorer: Scorer = hash_scorer, thresholds: DataFrame | None = None, annotator: str = "system", marker: str | None = None) -> DataFrame:
    """New model rows ``incident_id, label, source, confidence, annotator_id`` for incidents without any. ``marker``: a label for those with no active one, so that they aren't tried again."""
    done = labels.filter("source = 'model'").select(F.col("incident_id").alias("_done")).distinct()
    todo = incidents.join(done, F.col("id") == F.col("_done"), "left_anti")
    scored = pooled(todo, scorer, thresholds)
    rows = scored.filter("active").select(F.col("id").alias("incident_id"), "label", F.lit("model").alias("source"), F.round("prob", 4).alias("confidence"), F.lit(annotator).alias("annotator_id"))
    if marker is None:
        return rows
    empty = todo.select("id").join(rows.select(F.col("incident_id").alias("id")).distinct(), "id", "left_anti")
    return rows.unionByName(empty.select(F.col("id").alias("incident_id"), F.lit(marker).alias("label"), F.lit("model").alias("source"), F.lit(1.0).alias("confidence"), F.lit(annotator).alias("annotator_id")))
