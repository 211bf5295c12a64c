"""Queries over the pipeline's tables as the repositories ask them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tailrace.operators import relational as r
from tailrace.plans.core import query, table

S = "source_documents"


@query("SELECT id, name, kind, uri, active FROM sources WHERE name = 'quiet-pager'")
def point_lookup(spark, d):
    return r.lookup(table(spark, d, "sources"), "name", "quiet-pager").select("id", "name", "kind", "uri", "active")


@query(f"SELECT id, source_id, created_at FROM {S} WHERE status = 'deduped' ORDER BY created_at, id LIMIT 100")
def list_by_status(spark, d):
    return r.list_by_status(table(spark, d, S), "deduped").select("id", "source_id", "created_at")


@query("SELECT id, org, title FROM incidents ORDER BY id LIMIT 50 OFFSET 100")
def paginate(spark, d):
    return r.page(table(spark, d, "incidents"), ["id"], 50, 100).select("id", "org", "title")


@query(f"SELECT status, count(*) AS n FROM {S} GROUP BY status")
def count_by_status(spark, d):
    return r.count_by(table(spark, d, S), "status")


@query("SELECT count(*) AS n FROM incidents")
def total_count(spark, d):
    return table(spark, d, "incidents").agg(F.count("*").alias("n"))


@query(f"SELECT coalesce(nullif(failed_stage, ''), 'unknown') AS stage, count(*) AS n FROM {S} WHERE status = 'failed' GROUP BY 1 ORDER BY n DESC, stage LIMIT 10")
def failure_breakdown(spark, d):
    return r.failure_breakdown(table(spark, d, S))


@query("SELECT label, count(*) AS n FROM incident_labels WHERE source = 'human' GROUP BY label")
def count_by_label(spark, d):
    return r.count_by(table(spark, d, "incident_labels").filter("source = 'human'"), "label")


@query("SELECT incident_id, label, confidence FROM incident_labels WHERE source = 'model' ORDER BY incident_id, label, confidence")
def labels_by_source(spark, d):
    return table(spark, d, "incident_labels").filter("source = 'model'").select("incident_id", "label", "confidence").orderBy("incident_id", "label", "confidence")


@query("SELECT DISTINCT incident_id, annotator_id FROM incident_labels WHERE source = 'human'")
def distinct_annotators(spark, d):
    return table(spark, d, "incident_labels").filter("source = 'human'").select("incident_id", "annotator_id").distinct()


@query("SELECT id, name, kind FROM sources WHERE active ORDER BY name")
def active_sources(spark, d):
    return table(spark, d, "sources").filter("active").select("id", "name", "kind").orderBy("name")


@query("""SELECT incident_id, label, annotator_id, annotation_round, confidence, model_version FROM (
    SELECT *, row_number() OVER (PARTITION BY incident_id, label, annotator_id ORDER BY annotation_round DESC NULLS LAST, confidence DESC NULLS LAST, model_version DESC NULLS LAST) AS rn
    FROM incident_labels) WHERE rn = 1""")
def label_upsert(spark, d):
    labels = table(spark, d, "incident_labels")
    newest = [F.desc_nulls_last(c) for c in ("annotation_round", "confidence", "model_version")]
    return r.upsert(labels.limit(0), labels, ["incident_id", "label", "annotator_id"], newest).select("incident_id", "label", "annotator_id", F.col("annotation_round").cast("int").alias("annotation_round"), "confidence", "model_version")


@query("""SELECT document_id, num_perm, band_size, canonical_id, n_bands FROM (
    SELECT document_id, num_perm::INTEGER AS num_perm, band_size::INTEGER AS band_size, canonical_id, len(band_hashes)::INTEGER AS n_bands,
    row_number() OVER (PARTITION BY document_id ORDER BY num_perm DESC NULLS LAST, band_size DESC NULLS LAST, canonical_id DESC NULLS LAST, array_to_string(band_hashes, ',') DESC NULLS LAST) AS rn
    FROM minhash_signatures) WHERE rn = 1""")
def signature_upsert(spark, d):
    sig = table(spark, d, "minhash_signatures")
    order = [F.desc_nulls_last("num_perm"), F.desc_nulls_last("band_size"), F.desc_nulls_last("canonical_id"), F.array_join("band_hashes", ",").desc_nulls_last()]
    return r.upsert(sig.limit(0), sig, ["document_id"], order).select("document_id", F.col("num_perm").cast("int").alias("num_perm"), F.col("band_size").cast("int").alias("band_size"), "canonical_id", F.when(F.col("band_hashes").isNotNull(), F.size("band_hashes")).alias("n_bands"))


@query("SELECT incident_id, label, source, annotator_id FROM incident_labels WHERE source IS NULL OR source <> 'weak'")
def delete_by_source(spark, d):
    return r.delete_where(table(spark, d, "incident_labels"), F.col("source") == "weak").select("incident_id", "label", "source", "annotator_id")


@query("""WITH b AS (SELECT DISTINCT document_id, unnest(band_hashes) AS band FROM minhash_signatures WHERE document_id IS NOT NULL)
    SELECT DISTINCT x.document_id AS a, y.document_id AS b FROM b x JOIN b y ON x.band = y.band AND x.document_id < y.document_id""")
def lsh_candidates(spark, d):
    return r.band_candidates(table(spark, d, "minhash_signatures"))


@query("SELECT id, title FROM incidents WHERE id IN (SELECT id FROM golden_set)")
def golden_semi_join(spark, d):
    return r.semi(table(spark, d, "incidents"), table(spark, d, "golden_set"), "id", "id").select("id", "title")


@query("SELECT id, org FROM incidents WHERE id NOT IN (SELECT incident_id FROM incident_labels WHERE source = 'model' AND incident_id IS NOT NULL)")
def unclassified(spark, d):
    return r.anti(table(spark, d, "incidents"), table(spark, d, "incident_labels").filter("source = 'model'"), "id", "incident_id").select("id", "org")


@query(f"""SELECT id, content_hash FROM (SELECT id, content_hash, row_number() OVER (PARTITION BY content_hash ORDER BY created_at, id) AS rn
    FROM {S} WHERE status = 'deduped' AND content_hash IS NOT NULL AND content_hash NOT IN (SELECT content_hash FROM incidents WHERE content_hash IS NOT NULL)) WHERE rn = 1""")
def promote_new(spark, d):
    ready = table(spark, d, S).filter("status = 'deduped' AND content_hash IS NOT NULL")
    fresh = r.anti(ready, table(spark, d, "incidents"), "content_hash", "content_hash")
    return r.latest_per_key(fresh, ["content_hash"], [F.asc("created_at"), F.asc("id")]).select("id", "content_hash")


@query(f"""SELECT s.id, coalesce(i.status, s.status) AS status, coalesce(i.content_hash, s.content_hash) AS content_hash
    FROM {S} s LEFT JOIN (SELECT document_id, 'promoted' AS status, content_hash FROM incidents) i ON s.id = i.document_id""")
def status_update(spark, d):
    changes = table(spark, d, "incidents").select(F.col("document_id").alias("id"), F.lit("promoted").alias("status"), "content_hash")
    return r.patch(table(spark, d, S).select("id", "status", "content_hash"), changes, "id", ["status", "content_hash"])


@query("SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderdate >= DATE '1995-01-01' AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 40) GROUP BY o_orderpriority")
def semi_join_orders(spark, d):
    orders = table(spark, d, "orders").filter("o_orderdate >= DATE '1995-01-01'")
    big = table(spark, d, "lineitem").filter("l_quantity > 40")
    return r.semi(orders, big, "o_orderkey", "l_orderkey").groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT source_id, status, count(*) AS n, max(attempts)::INTEGER AS max_attempts FROM (SELECT DISTINCT * FROM ingest_jobs) GROUP BY source_id, status")
def job_summary(spark, d):
    return table(spark, d, "ingest_jobs").distinct().groupBy("source_id", "status").agg(F.count("*").alias("n"), F.max("attempts").cast("int").alias("max_attempts"))
