"""JSON-lines inputs, the golden set's file, thresholds and baselines, cached answers, seeds and reports."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tailrace.functions.text import llm_cache_key

TRAINING = "id string, text string, org string, silver_labels array<string>, gold_labels array<string>"
GOLDEN = "id string, content_hash string, labels array<string>"
CACHE = "cache_key string, response string"


def read_training(spark: SparkSession, path: str) -> DataFrame:
    """Training examples from JSON lines; missing texts and names are empty, missing label lists are empty lists. Lines that are no JSON are left out."""
    rows = spark.read.schema(TRAINING).option("mode", "DROPMALFORMED").json(path)
    none = F.array().cast("array<string>")
    return rows.select("id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("org", F.lit("")).alias("org"), F.coalesce("silver_labels", none).alias("silver_labels"), F.coalesce("gold_labels", none).alias("gold_labels"))


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(GOLDEN).json(path)


def write_golden(golden: DataFrame, path: str) -> None:
    """One JSON line per incident, sorted by id across and within files."""
    golden.select("id", "content_hash", F.sort_array("labels").alias("labels")).repartitionByRange("id").sortWithinPartitions("id").write.mode("overwrite").json(path)


def read_seed_lists(spark: SparkSession, path: str) -> DataFrame:
    """``body``: each markdown file whole."""
    return spark.read.option("wholetext", True).text(path).withColumnRenamed("value", "body")


def save_values(path: str, values: Mapping[str, float]) -> None:
    """Thresholds or a baseline: a small JSON object on the driver, keys in order."""
    with open(path, "w") as f:
        json.dump(dict(sorted(values.items())), f, indent=2)


def load_values(spark: SparkSession, path: str, value: str = "threshold") -> DataFrame:
    """``label, <value>`` of such a file."""
    with open(path) as f:
        return spark.createDataFrame(sorted((k, float(v)) for k, v in json.load(f).items()), f"label string, {value} double")


def with_cached(incidents: DataFrame, cache: DataFrame) -> DataFrame:
    """``incidents`` with the cached ``response`` of each, null where the model must be asked."""
    return incidents.withColumn("cache_key", llm_cache_key(F.col("content_hash"))).join(cache.dropDuplicates(["cache_key"]), "cache_key", "left")


def markdown_table(title: str, columns: Iterable[str], rows: Iterable[Row]) -> str:
    """A report section from a few rows."""
    names = list(columns)
    lines = [f"## {title}", "", "| " + " | ".join(names) + " |", "|" + "---|" * len(names)]
    for r in rows:
        lines.append("| " + " | ".join("" if r[c] is None else f"{r[c]:.4f}" if isinstance(r[c], float) else str(r[c]) for c in names) + " |")
    return "\n".join(lines) + "\n"
