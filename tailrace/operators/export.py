"""Export of incidents, its manifest, the golden set and the statistics of a data set."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tailrace.functions.licenses import is_permissive
from tailrace.taxonomy import REVIEWED

# fixed values: states of a document
STATES = ("discovered", "fetched", "parsed", "deduped", "duplicate", "failed")


def export_rows(incidents: DataFrame) -> DataFrame:
    """The ten exported columns; full text only under permissive licences."""
    return incidents.select(
        "id", "org", "title", F.coalesce("url", F.lit("")).alias("url"), F.coalesce(F.date_format("occurred_on", "yyyy-MM-dd"), F.lit("")).alias("date"), F.coalesce(F.col("severity").cast("int"), F.lit(-1)).alias("severity"),
        F.coalesce(F.to_json("sections", {"ignoreNullFields": "false"}), F.lit("[]")).alias("sections"), "license", F.when(is_permissive(F.col("license")), F.coalesce("summary", F.lit(""))).otherwise("").alias("full_text"), "content_hash",
    )


def write_export(incidents: DataFrame, path: str, files: int | None = None) -> None:
    """Rows in the order of their content hash, as parquet; a range partition per file, so that no task holds them all."""
    rows = export_rows(incidents)
    rows = rows.repartitionByRange(files, "content_hash") if files else rows.repartitionByRange("content_hash")
    rows.sortWithinPartitions("content_hash", "id").write.mode("overwrite").parquet(path)


def row_hash(*columns: str):
    return F.sha2(F.concat_ws("\u0001", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), 256)


def manifest(rows: DataFrame, version: str = "v1") -> DataFrame:
    """One row ``version, num_records, sha256``, the same however rows are laid out: the digest of the sums of the words of all rows' hashes, over all ten columns. Sums combine in each task, and equal rows count each."""
    h = row_hash("id", "org", "title", "url", "date", "severity", "sections", "license", "full_text", "content_hash")
    parts = [F.sum(F.conv(F.substring(h, 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)")).alias(f"h{i}") for i in range(4)]
    g = rows.agg(F.count("*").alias("num_records"), *parts)
    return g.select(F.lit(version).alias("version"), "num_records", F.sha2(F.concat_ws("-", *[F.coalesce(F.col(f"h{i}").cast("string"), F.lit("0")) for i in range(4)]), 256).alias("sha256"))


def golden_set(labels: DataFrame, incidents: DataFrame) -> DataFrame:
    """``id, content_hash, labels``: the human labels of each incident, sorted, the sentinel left out."""
    sets = labels.filter(f"source = 'human' AND label <> '{REVIEWED}'").groupBy("incident_id").agg(F.sort_array(F.collect_set("label")).alias("labels"))
    return incidents.select("id", "content_hash").join(sets, F.col("id") == F.col("incident_id")).select("id", "content_hash", "labels")


def share_of(rows: DataFrame, key: str) -> DataFrame:
    """``key, n, pct`` of all rows."""
    g = rows.groupBy(key).agg(F.count("*").alias("n"))
    total = rows.agg(F.count("*").alias("_t"))
    return g.crossJoin(F.broadcast(total)).select(key, "n", F.round(100.0 * F.col("n") / F.col("_t"), 1).cast("double").alias("pct"))


def top_orgs(rows: DataFrame, k: int = 15) -> DataFrame:
    return rows.groupBy(F.coalesce("org", F.lit("unknown")).alias("org")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "org").limit(k)


def section_counts(rows: DataFrame) -> DataFrame:
    """``section, n, pct`` of records; ``sections`` is JSON."""
    names = rows.select(F.explode(F.from_json("sections", "array<struct<name:string>>")["name"]).alias("section")).groupBy("section").agg(F.count("*").alias("n"))
    return names.crossJoin(F.broadcast(rows.agg(F.count("*").alias("_t")))).select("section", "n", F.round(100.0 * F.col("n") / F.col("_t"), 1).cast("double").alias("pct"))


def completeness(rows: DataFrame) -> DataFrame:
    n = F.count("*")
    parts = [("with_text", F.count_if(F.col("full_text") != "")), ("with_date", F.count_if(F.col("date") != "")), ("with_severity", F.count_if(F.col("severity") != -1))]
    return rows.agg(n.alias("n"), *[x for name, c in parts for x in (c.alias(name), F.coalesce(F.round(F.try_divide(100.0 * c, n), 1), F.lit(0.0)).cast("double").alias(f"{name}_pct"))])


def pipeline_report(docs: DataFrame) -> DataFrame:
    """``status, n, pct`` of every state, zeros included."""
    states = docs.sparkSession.createDataFrame([(s,) for s in STATES], "status string")
    g = docs.groupBy("status").agg(F.count("*").alias("k"))
    total = docs.agg(F.count("*").alias("_t"))
    return states.join(F.broadcast(g), "status", "left").crossJoin(F.broadcast(total)).select("status", F.coalesce("k", F.lit(0).cast("long")).alias("n"), F.coalesce(F.round(F.try_divide(100.0 * F.coalesce("k", F.lit(0)), F.col("_t")), 1), F.lit(0.0)).cast("double").alias("pct"))
