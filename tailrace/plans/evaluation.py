"""Queries of data sets, evaluation, classification and export."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tailrace.functions import text
from tailrace.functions.licenses import PERMISSIVE
from tailrace.operators import classify, export
from tailrace.operators import evaluation as ops
from tailrace.plans.core import query, table
from tailrace.plans.labelling import TAX, q
from tailrace.plans.texts import TEXTS_SQL, strip_sql
from tailrace.session import work_dir
from tailrace.taxonomy import LABELS

HASH = "('0x' || substr(md5(example_id::VARCHAR || ':' || label), 1, 8))::BIGINT % 10000"
PRED = f"""{TAX}, pred AS (SELECT example_id, label, label_id, y, weight, round(0.6 * (({HASH}) / 10000.0) + 0.4 * y, 4)::DOUBLE AS prob
 FROM (SELECT example_id, weight, unnest(labels) AS y, generate_subscripts(labels, 1) - 1 AS label_id FROM labeled_examples) JOIN tax USING (label_id))"""
THR = "thr AS (SELECT label, 0.3::DOUBLE + 0.02 * label_id AS threshold FROM tax)"
METRICS = "sum((hit AND y = 1)::INT)::DOUBLE AS tp, sum((hit AND y = 0)::INT)::DOUBLE AS fp, sum((NOT hit AND y = 1)::INT)::DOUBLE AS fn"
P = "CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END"
R = "CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END"
F1 = "CASE WHEN 2 * tp + fp + fn > 0 AND tp > 0 THEN 2 * (tp / (tp + fp)) * (tp / (tp + fn)) / ((tp / (tp + fp)) + (tp / (tp + fn))) ELSE 0 END"


def predictions(spark, d):
    """Scores of a stand-in model: four tenths truth, six tenths a hash of example and label."""
    flat = table(spark, d, "labeled_examples").select("example_id", "weight", F.posexplode("labels").alias("label_id", "y"))
    named = flat.withColumn("label", F.array(*[F.lit(x) for x in LABELS])[F.col("label_id")])
    h = F.conv(F.substring(F.md5(F.concat(F.col("example_id").cast("string"), F.lit(":"), "label")), 1, 8), 16, 10).cast("long") % 10000
    return named.withColumn("prob", F.round(0.6 * (h / F.lit(10000.0)) + 0.4 * F.col("y"), 4))


def thresholds(spark):
    return spark.createDataFrame([(x, 0.3 + 0.02 * i) for i, x in enumerate(LABELS)], "label string, threshold double")


@query(f"""WITH {TAX}, t AS (SELECT id, array_to_string(list_filter(list_concat([coalesce(title, ''), coalesce(summary, '')], {TEXTS_SQL}), lambda x: x <> ''), chr(10) || chr(10)) AS text FROM incidents),
 s AS (SELECT incident_id, list_distinct(list(label) FILTER (source = 'human')) AS gold, list_distinct(list(label) FILTER (source = 'weak')) AS silver FROM incident_labels WHERE label IN (SELECT label FROM tax) GROUP BY incident_id)
 SELECT id, array_to_string(list_transform([{', '.join(q(x) for x in LABELS)}], lambda x: list_contains(CASE WHEN len(coalesce(gold, [])) > 0 THEN gold ELSE coalesce(silver, []) END, x)::INT), '') AS labels, CASE WHEN len(coalesce(gold, [])) > 0 THEN 1.0::DOUBLE ELSE 0.7::DOUBLE END AS weight
 FROM t JOIN s ON s.incident_id = t.id WHERE {strip_sql('text')} <> '' AND len(coalesce(gold, [])) + len(coalesce(silver, [])) > 0""")
def merge_silver_gold(spark, d):
    texts = table(spark, d, "incidents").select("id", text.training_text(F.col("title"), F.col("summary"), F.col("sections")).alias("text"))
    return ops.merge_silver_gold(texts, table(spark, d, "incident_labels")).select("id", F.array_join(F.col("labels").cast("array<string>"), "").alias("labels"), "weight")


@query("""WITH x AS (SELECT example_id, unnest(labels) AS y, generate_subscripts(labels, 1)::INTEGER - 1 AS k FROM labeled_examples), f AS (SELECT k, count(*) AS freq FROM x WHERE y = 1 GROUP BY k),
 r AS (SELECT example_id, k, row_number() OVER (PARTITION BY example_id ORDER BY freq, k) AS rn FROM x JOIN f USING (k) WHERE y = 1),
 s AS (SELECT e.example_id, coalesce(r.k, -1)::INTEGER AS stratum, ('0x' || substr(md5('42:' || e.example_id::VARCHAR), 1, 8))::BIGINT AS u FROM labeled_examples e LEFT JOIN r ON r.example_id = e.example_id AND rn = 1),
 p AS (SELECT example_id, stratum, (row_number() OVER (PARTITION BY stratum ORDER BY u, example_id) - 1)::DOUBLE / count(*) OVER (PARTITION BY stratum) AS place FROM s)
 SELECT example_id, stratum, CASE WHEN place < 0.15 THEN 'val' WHEN place < 0.3 THEN 'test' ELSE 'train' END AS split FROM p""")
def stratified_split(spark, d):
    return ops.stratified_split(table(spark, d, "labeled_examples"))


@query("SELECT k AS label_id, CASE WHEN p = 0 THEN 10.0 ELSE least((n - p)::DOUBLE / p, 10.0) END::DOUBLE AS weight FROM (SELECT k, count(*) AS n, sum(y) AS p FROM (SELECT unnest(labels) AS y, generate_subscripts(labels, 1)::INTEGER - 1 AS k FROM labeled_examples) GROUP BY k)")
def pos_weights(spark, d):
    return ops.pos_weights(table(spark, d, "labeled_examples"))


@query(f"""WITH {PRED}, w AS (SELECT label_id, CASE WHEN sum(y) = 0 THEN 10.0 ELSE least((count(*) - sum(y))::DOUBLE / sum(y), 10.0) END AS pw FROM pred GROUP BY label_id)
 SELECT round(avg(-(pw * y * ln(greatest(least(prob, 1 - 1e-7), 1e-7)) + (1 - y) * ln(1 - greatest(least(prob, 1 - 1e-7), 1e-7))) * weight), 6) AS loss FROM pred JOIN w USING (label_id)""")
def weighted_bce(spark, d):
    return ops.weighted_bce(predictions(spark, d), ops.pos_weights(table(spark, d, "labeled_examples")))


@query(f"WITH {PRED}, g AS (SELECT label, {METRICS}, sum(y)::BIGINT AS support FROM (SELECT *, prob >= 0.5 AS hit FROM pred) GROUP BY label) SELECT label, round({P}, 4)::DOUBLE AS precision, round({R}, 4)::DOUBLE AS recall, round({F1}, 4)::DOUBLE AS f1, support FROM g")
def label_metrics(spark, d):
    return ops.label_metrics(predictions(spark, d))


MICRO = f"""g AS (SELECT label, {METRICS} FROM (SELECT pred.*, prob >= threshold AS hit FROM pred JOIN thr USING (label)) GROUP BY label), m AS (SELECT sum({F1}) / {len(LABELS)} AS macro, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM g),
 mm AS (SELECT round({F1}, 4)::DOUBLE AS micro_f1, round(macro, 4)::DOUBLE AS macro_f1, round({P}, 4)::DOUBLE AS micro_precision, round({R}, 4)::DOUBLE AS micro_recall FROM m)"""
BIN = "CASE " + " ".join(f"WHEN prob > {i / 10} THEN {i}" for i in range(9, 0, -1)) + " ELSE 0 END"
ECE = f"ec AS (SELECT round(sum(n * abs(acc - conf)) / sum(n), 4)::DOUBLE AS ece FROM (SELECT {BIN} AS b, count(*) AS n, avg(prob) AS conf, avg(y) AS acc FROM pred GROUP BY 1))"


@query(f"WITH {PRED}, {THR}, {MICRO} SELECT * FROM mm")
def micro_macro_f1(spark, d):
    return ops.micro_macro(predictions(spark, d), thresholds(spark))


@query(f"WITH {PRED}, {ECE} SELECT * FROM ec")
def ece(spark, d):
    return ops.ece(predictions(spark, d))


@query(f"""WITH {PRED}, grid AS (SELECT unnest(range(0, 81)) AS k), g AS (SELECT label, k, {METRICS} FROM (SELECT label, k, y, prob >= 0.1 + 0.01 * k - 1e-9 AS hit FROM pred CROSS JOIN grid) GROUP BY label, k),
 f AS (SELECT label, k, round({F1}, 9) AS f1 FROM g), b AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY f1 DESC, k) AS rn FROM f)
 SELECT label, round(0.1 + 0.01 * k, 4)::DOUBLE AS threshold, round(f1, 4)::DOUBLE AS f1 FROM b WHERE rn = 1""")
def tune_thresholds(spark, d):
    return ops.tune_thresholds(predictions(spark, d))


@query(f"""WITH {PRED}, e AS (SELECT example_id, coalesce(nullif(org, ''), 'unknown') AS org, length(coalesce(text, '')) AS chars FROM labeled_examples), md AS (SELECT median(chars) AS mid FROM e),
 t AS (SELECT example_id, 'org:' || org AS slice FROM e UNION ALL SELECT example_id, CASE WHEN chars <= mid THEN 'doc:short' ELSE 'doc:long' END FROM e, md),
 p AS (SELECT example_id, {METRICS} FROM (SELECT *, prob >= 0.5 AS hit FROM pred) GROUP BY example_id),
 g AS (SELECT slice, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, count(*) AS n FROM t JOIN p USING (example_id) GROUP BY slice HAVING count(*) >= 3)
 SELECT slice, round({F1}, 4)::DOUBLE AS f1, n FROM g""")
def slice_metrics(spark, d):
    return ops.slice_metrics(predictions(spark, d), table(spark, d, "labeled_examples").select("example_id", "org", "text"))


@query(f"WITH {PRED}, {THR}, {MICRO}, {ECE} SELECT * FROM mm CROSS JOIN ec")
def evaluate(spark, d):
    return ops.evaluate(predictions(spark, d), thresholds(spark))


@query(f"""WITH {PRED}, {THR}, a AS (SELECT label, {METRICS} FROM (SELECT *, prob >= 0.5 AS hit FROM pred) GROUP BY label), b AS (SELECT label, {METRICS} FROM (SELECT pred.*, prob >= threshold AS hit FROM pred JOIN thr USING (label)) GROUP BY label),
 j AS (SELECT label, x.f1 AS baseline_f1, y.f1 FROM (SELECT label, round({F1}, 4)::DOUBLE AS f1 FROM a) x JOIN (SELECT label, round({F1}, 4)::DOUBLE AS f1 FROM b) y USING (label))
 SELECT label, baseline_f1, f1, round(baseline_f1 - f1, 4) <= 0.03 AS passed FROM j UNION ALL SELECT 'macro', round(avg(baseline_f1), 4), round(avg(f1), 4), round(round(avg(baseline_f1), 4) - round(avg(f1), 4), 4) <= 0.01 FROM j""")
def regression_gate(spark, d):
    p = predictions(spark, d)
    return ops.regression_gate(ops.label_metrics(p, thresholds(spark)), ops.label_metrics(p))


MS = "date_diff('millisecond', started_at, finished_at)::DOUBLE"


@query(f"SELECT round(avg(v), 4) AS mean, round(quantile_cont(v, 0.5), 4) AS p50, round(quantile_cont(v, 0.95), 4) AS p95, round(quantile_cont(v, 0.99), 4) AS p99, round(min(v), 4) AS least, round(max(v), 4) AS most FROM (SELECT (epoch_us(finished_at) - epoch_us(started_at)) / 1000000.0::DOUBLE AS v FROM ingest_jobs WHERE finished_at IS NOT NULL AND started_at IS NOT NULL)")
def latency_stats(spark, d):
    return ops.latency_stats(table(spark, d, "ingest_jobs"), (F.unix_micros("finished_at") - F.unix_micros("started_at")) / F.lit(1000000.0))


@query(f"WITH {PRED} SELECT round(max(abs(prob - round(prob, 2))), 6)::DOUBLE AS max_diff, max(abs(prob - round(prob, 2))) <= 0.01 AS equal FROM pred")
def parity_check(spark, d):
    p = predictions(spark, d)
    return ops.parity(p, p.withColumn("prob", F.round("prob", 2)), ["example_id", "label"], "prob")


CHUNKS = f"""{TAX}, ch AS (SELECT id, unnest(list_concat(list_filter([array_to_string(list_filter([coalesce(title, ''), coalesce(summary, '')], lambda x: x <> ''), chr(10) || chr(10))], lambda x: x <> ''),
 list_transform(list_filter({TEXTS_SQL}, lambda x: {strip_sql('x')} <> ''), lambda x: substr(x, 1, 100000)))) AS chunk FROM incidents),
 pool AS (SELECT id, label, max((('0x' || substr(md5(chunk || '|' || label), 1, 8))::BIGINT % 10000) / 10000.0::DOUBLE) AS prob FROM ch CROSS JOIN tax GROUP BY id, label)"""


@query(f"WITH {CHUNKS} SELECT id, label, prob, prob >= 0.5 AS active FROM pool")
def section_maxpool(spark, d):
    return classify.pooled(table(spark, d, "incidents"))


@query(f"""WITH {CHUNKS}, a AS (SELECT id AS incident_id, label, 'model' AS source, round(prob, 4) AS confidence, 'system' AS annotator_id FROM pool WHERE prob >= 0.97),
 todo AS (SELECT id FROM incidents WHERE id NOT IN (SELECT incident_id FROM incident_labels WHERE source = 'model' AND incident_id IS NOT NULL))
 SELECT * FROM a WHERE incident_id IN (SELECT id FROM todo) UNION ALL SELECT id, '__none__', 'model', 1.0::DOUBLE, 'system' FROM todo WHERE id NOT IN (SELECT incident_id FROM a)""")
def classify_incidents(spark, d):
    high = spark.createDataFrame([(x, 0.97) for x in LABELS], "label string, threshold double")
    return classify.classify_incidents(table(spark, d, "incidents"), table(spark, d, "incident_labels"), thresholds=high, marker="__none__")


ROWS = f"""rows AS (SELECT id, coalesce(org, 'unknown') AS org, org AS raw_org, title, coalesce(url, '') AS url, coalesce(strftime(occurred_on, '%Y-%m-%d'), '') AS date, coalesce(severity::INTEGER, -1) AS severity,
 coalesce(to_json(sections)::VARCHAR, '[]') AS sections, license,
 CASE WHEN license IN ({', '.join(q(x) for x in PERMISSIVE)}) THEN coalesce(summary, '') ELSE '' END AS full_text, content_hash FROM incidents)"""


@query(f"WITH {ROWS} SELECT id, raw_org AS org, title, url, date, severity, sections, license, full_text, content_hash FROM rows")
def export_rows(spark, d):
    return export.export_rows(table(spark, d, "incidents"))


@query(f"WITH {ROWS} SELECT id, raw_org AS org, severity, content_hash FROM rows ORDER BY content_hash")
def export_dataset(spark, d):
    path = f"{work_dir(spark)}/export-{uuid.uuid4().hex}"
    export.write_export(table(spark, d, "incidents"), path)
    return spark.read.parquet(path).select("id", "org", "severity", "content_hash")


_H = "sha256(" + " || chr(1) || ".join(f"coalesce({c}::VARCHAR, '')" for c in ("id", "raw_org", "title", "url", "date", "severity", "sections", "license", "full_text", "content_hash")) + ")"


@query(f"WITH {ROWS}, h AS (SELECT {_H} AS h FROM rows) SELECT 'v1' AS version, count(*) AS num_records, sha256(" + " || '-' || ".join(f"coalesce(sum(('0x' || substr(h, {1 + 15 * i}, 15))::BIGINT), 0)::VARCHAR" for i in range(4)) + ") AS sha256 FROM h")
def export_manifest(spark, d):
    return export.manifest(export.export_rows(table(spark, d, "incidents")))


@query("SELECT i.id, i.content_hash, array_to_string(l.labels, ',') AS labels FROM incidents i JOIN (SELECT incident_id, list_sort(list_distinct(list(label))) AS labels FROM incident_labels WHERE source = 'human' AND label <> '__reviewed__' GROUP BY incident_id) l ON l.incident_id = i.id")
def golden_set(spark, d):
    return export.golden_set(table(spark, d, "incident_labels"), table(spark, d, "incidents")).select("id", "content_hash", F.array_join("labels", ",").alias("labels"))


@query(f"WITH {ROWS} SELECT severity, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM rows), 1)::DOUBLE AS pct FROM rows GROUP BY severity")
def stats_severity(spark, d):
    return export.share_of(export.export_rows(table(spark, d, "incidents")), "severity")


@query(f"WITH {ROWS} SELECT org, count(*) AS n FROM rows GROUP BY org ORDER BY n DESC, org LIMIT 15")
def stats_top_orgs(spark, d):
    return export.top_orgs(export.export_rows(table(spark, d, "incidents")))


@query(f"WITH {ROWS} SELECT license, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM rows), 1)::DOUBLE AS pct FROM rows GROUP BY license")
def stats_license(spark, d):
    return export.share_of(export.export_rows(table(spark, d, "incidents")), "license")


@query("SELECT section, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM incidents), 1)::DOUBLE AS pct FROM (SELECT unnest(list_transform(sections, lambda s: s.name)) AS section FROM incidents) GROUP BY section")
def stats_sections(spark, d):
    return export.section_counts(export.export_rows(table(spark, d, "incidents")))


@query(f"""WITH {ROWS} SELECT count(*) AS n, sum((full_text <> '')::INT)::BIGINT AS with_text, round(100.0 * sum((full_text <> '')::INT) / count(*), 1)::DOUBLE AS with_text_pct, sum((date <> '')::INT)::BIGINT AS with_date, round(100.0 * sum((date <> '')::INT) / count(*), 1)::DOUBLE AS with_date_pct,
 sum((severity <> -1)::INT)::BIGINT AS with_severity, round(100.0 * sum((severity <> -1)::INT) / count(*), 1)::DOUBLE AS with_severity_pct FROM rows""")
def stats_completeness(spark, d):
    return export.completeness(export.export_rows(table(spark, d, "incidents")))


@query("SELECT s.status, count(d.id) AS n, round(100.0 * count(d.id) / (SELECT count(*) FROM source_documents), 1)::DOUBLE AS pct FROM (VALUES " + ", ".join(f"('{s}')" for s in export.STATES) + ") s(status) LEFT JOIN source_documents d USING (status) GROUP BY s.status")
def pipeline_report(spark, d):
    return export.pipeline_report(table(spark, d, "source_documents"))
