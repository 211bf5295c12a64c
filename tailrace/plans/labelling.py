"""Queries of weak supervision, annotation and agreement."""

from __future__ import annotations

from pyspark.sql import functions as F

from tailrace.operators import labels as ops
from tailrace.plans.core import query, table
from tailrace.taxonomy import KEYWORDS, LABELS


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


TAX = "tax(label_id, label) AS (VALUES " + ", ".join(f"({i}, {q(x)})" for i, x in enumerate(LABELS)) + ")"
_ROWS = """rows AS (SELECT id AS incident_id, coalesce(array_to_string(list_transform(list_filter(coalesce(sections, []), lambda s: lower(s.name) IN ('root_cause', 'root cause', 'rootcause')), lambda s: coalesce(s.text, '')), chr(10)), '') AS cause,
 coalesce(summary, '') AS told, coalesce(title, '') AS head FROM incidents)"""
_PATS = "pat(label, p) AS (VALUES " + ", ".join(f"({q(x)}, {q('(?i)' + p)})" for x, p in KEYWORDS) + ")"
VOTES = f"""{_ROWS}, kw AS (""" + " UNION ALL ".join(f"SELECT incident_id, {q(x)} AS label, {q('kw_' + x.replace('-', '_'))} AS lf_name, regexp_matches(cause, {q('(?i)' + p)}) AS strong, regexp_matches(told, {q('(?i)' + p)}) OR regexp_matches(head, {q('(?i)' + p)}) AS weak FROM rows" for x, p in KEYWORDS) + """),
 votes AS (SELECT incident_id, label, lf_name, strong OR weak AS positive, CASE WHEN strong THEN 0.9::DOUBLE WHEN weak THEN 0.7::DOUBLE ELSE 1.0::DOUBLE END AS confidence FROM kw)"""
LLM = f"""{TAX}, ans AS (SELECT DISTINCT incident_id, label FROM incident_labels WHERE source = 'model'),
 lv AS (SELECT a.incident_id, t.label, 'llm' AS lf_name, b.label IS NOT NULL AS positive, CASE WHEN b.label IS NOT NULL THEN 0.85::DOUBLE ELSE 1.0::DOUBLE END AS confidence
 FROM (SELECT DISTINCT incident_id FROM ans) a CROSS JOIN tax t LEFT JOIN ans b ON b.incident_id = a.incident_id AND b.label = t.label)"""
SILVER = f"""{LLM}, {VOTES}, allv AS (SELECT * FROM votes UNION ALL SELECT * FROM lv),
 silver AS (SELECT incident_id, label, round(avg(confidence), 4) AS confidence, array_to_string(list_sort(list_distinct(list(lf_name))), ',') AS voters FROM allv WHERE positive GROUP BY incident_id, label HAVING avg(confidence) >= 0.5)"""


def _votes(spark, d):
    return ops.keyword_votes(table(spark, d, "incidents"))


def _llm(spark, d):
    return ops.llm_votes(table(spark, d, "incident_labels").filter("source = 'model'"))


def _silver(spark, d):
    return ops.silver_labels(_votes(spark, d).unionByName(_llm(spark, d)))


@query(f"WITH {VOTES} SELECT * FROM votes")
def keyword_votes(spark, d):
    return _votes(spark, d)


@query(f"WITH {LLM} SELECT * FROM lv")
def llm_votes(spark, d):
    return _llm(spark, d)


@query(f"WITH {SILVER} SELECT * FROM silver")
def silver_labels(spark, d):
    return _silver(spark, d)


@query(f"""WITH {TAX}, {VOTES}, pos AS (SELECT DISTINCT incident_id, label FROM votes WHERE positive), n AS (SELECT count(DISTINCT incident_id) AS n FROM votes),
 k AS (SELECT x.label AS label_a, y.label AS label_b, count(*) AS k FROM pos x JOIN pos y USING (incident_id) GROUP BY ALL)
 SELECT a.label AS label_a, b.label AS label_b, round(coalesce(k, 0) / n, 4) AS p FROM tax a CROSS JOIN tax b CROSS JOIN n LEFT JOIN k ON k.label_a = a.label AND k.label_b = b.label""")
def cooccurrence(spark, d):
    return ops.cooccurrence(_votes(spark, d))


@query(f"WITH {SILVER} SELECT t.label, count(s.label) AS n FROM tax t LEFT JOIN silver s USING (label) GROUP BY t.label")
def label_coverage(spark, d):
    return ops.label_coverage(_silver(spark, d))


@query(f"WITH {SILVER}, c AS (SELECT t.label, count(s.label) AS n FROM tax t LEFT JOIN silver s USING (label) GROUP BY t.label) SELECT label, n, round(100.0 * n / (SELECT count(*) FROM incidents), 1)::DOUBLE AS pct, n < 30 AS low FROM c")
def coverage_report(spark, d):
    return ops.coverage_report(_silver(spark, d), table(spark, d, "incidents").agg(F.count("*").alias("total")))


@query(f"WITH {SILVER} SELECT incident_id, label, source, confidence, annotator_id FROM incident_labels WHERE source <> 'weak' UNION ALL SELECT incident_id, label, 'weak', confidence, 'weak_supervision' FROM silver")
def reconcile(spark, d):
    return ops.reconcile(table(spark, d, "incident_labels"), _silver(spark, d))


@query("""WITH dec AS (SELECT id AS incident_id, 'ann-01' AS annotator_id, CASE WHEN severity IS NULL THEN [] WHEN severity = 0 THEN ['dns', 'dns', 'bad-deploy'] ELSE ['human-error'] END AS labels FROM incidents WHERE severity IS DISTINCT FROM 3),
 kept AS (SELECT incident_id, label, source, confidence, annotator_id FROM incident_labels WHERE NOT coalesce(source = 'human' AND incident_id IN (SELECT incident_id FROM dec), false))
 SELECT * FROM kept UNION ALL SELECT incident_id, unnest(list_distinct(CASE WHEN len(labels) > 0 THEN labels ELSE ['__reviewed__'] END)), 'human', 1.0::DOUBLE, annotator_id FROM dec""")
def annotate_apply(spark, d):
    # incidents of severity 3 stay as they are
    chosen = F.when(F.col("severity").isNull(), F.array().cast("array<string>")).when(F.col("severity") == 0, F.array(F.lit("dns"), F.lit("dns"), F.lit("bad-deploy"))).otherwise(F.array(F.lit("human-error")))
    decisions = table(spark, d, "incidents").filter("severity IS DISTINCT FROM 3").select(F.col("id").alias("incident_id"), F.lit("ann-01").alias("annotator_id"), chosen.alias("labels"))
    return ops.annotate(table(spark, d, "incident_labels"), decisions).select("incident_id", "label", "source", "confidence", "annotator_id")


@query("""WITH a AS (SELECT DISTINCT l.annotator_id, l.incident_id FROM incident_labels l JOIN incidents i ON i.id = l.incident_id WHERE l.source = 'human' AND annotator_id IS NOT NULL)
 SELECT annotator_id, count(*) AS done, (SELECT min(id) FROM incidents i WHERE NOT EXISTS (SELECT 1 FROM a b WHERE b.annotator_id = a.annotator_id AND b.incident_id = i.id)) AS next_id FROM a GROUP BY annotator_id""")
def next_unannotated(spark, d):
    return ops.next_unannotated(table(spark, d, "incidents"), table(spark, d, "incident_labels"))


@query("""WITH r AS (SELECT i.id, l.label FROM incidents i LEFT JOIN (SELECT DISTINCT incident_id, label FROM incident_labels WHERE source = 'weak') l ON l.incident_id = i.id),
 f AS (SELECT label, count(*) AS freq FROM r WHERE label IS NOT NULL GROUP BY label),
 k AS (SELECT r.id, r.label, row_number() OVER (PARTITION BY r.label ORDER BY md5('42:' || coalesce(r.label, '') || ':' || r.id), r.id) AS round, freq FROM r LEFT JOIN f USING (label)),
 b AS (SELECT id, label, round, row_number() OVER (PARTITION BY id ORDER BY (label IS NULL)::INT, round, coalesce(freq, 1099511627776), coalesce(label, '')) AS rn, coalesce(freq, 1099511627776) AS freq FROM k)
 SELECT id, coalesce(label, '') AS label, round::INTEGER AS round FROM b WHERE rn = 1 ORDER BY (label IS NULL)::INT, round, freq, label, id LIMIT 60""")
def stratified_sample(spark, d):
    return ops.stratified_sample(table(spark, d, "incidents"), table(spark, d, "incident_labels").filter("source = 'weak'"), 60)


DOUBLY = f"""{TAX}, sets AS (SELECT DISTINCT incident_id, lower(trim(annotator_id)) AS a, label FROM incident_labels WHERE source = 'human' AND label <> '__reviewed__' AND annotator_id IS NOT NULL),
 dbl AS (SELECT incident_id, count(DISTINCT a)::DOUBLE AS m FROM sets GROUP BY incident_id HAVING count(DISTINCT a) >= 2)"""
KAPPA = f"""{DOUBLY}, two AS (SELECT list_sort(list_distinct(list(a)))[1:2] AS t FROM sets JOIN dbl USING (incident_id)),
 per AS (SELECT incident_id, list(label) FILTER (a = t[1]) AS s1, list(label) FILTER (a = t[2]) AS s2 FROM sets JOIN dbl USING (incident_id) CROSS JOIN two GROUP BY incident_id HAVING count(*) FILTER (a = t[1]) > 0 AND count(*) FILTER (a = t[2]) > 0),
 fl AS (SELECT tax.label, list_contains(s1, tax.label)::INT::DOUBLE AS y1, list_contains(s2, tax.label)::INT::DOUBLE AS y2 FROM per CROSS JOIN tax),
 g AS (SELECT label, count(*) AS n, avg((y1 = y2)::INT) AS po, avg(y1) AS p, avg(y2) AS q FROM fl GROUP BY label),
 kap AS (SELECT label, n, round(CASE WHEN p * q + (1 - p) * (1 - q) = 1 THEN 1.0 ELSE (po - (p * q + (1 - p) * (1 - q))) / (1 - (p * q + (1 - p) * (1 - q))) END, 6) AS kappa FROM g)"""


@query(f"WITH {KAPPA} SELECT label, n, kappa FROM kap")
def cohens_kappa(spark, d):
    return ops.cohens_kappa(table(spark, d, "incident_labels"))


ALPHA = """u AS (SELECT m, (SELECT count(DISTINCT a) FROM sets s WHERE s.incident_id = dbl.incident_id AND s.label = tax.label)::DOUBLE AS y FROM dbl CROSS JOIN tax),
 ga AS (SELECT count(*) AS units, sum(y * (m - y) / (m - 1)) AS dd, sum(y) AS o, sum(m) AS v FROM u),
 alpha AS (SELECT units, round(1 - (dd / units) / (2 * o * (v - o) / (v * (v - 1))), 6) AS alpha FROM ga)"""
GRADE = "CASE WHEN kappa >= 0.8 THEN 'Almost perfect' WHEN kappa >= 0.6 THEN 'Substantial' WHEN kappa >= 0.4 THEN 'Moderate' WHEN kappa >= 0.2 THEN 'Fair' WHEN kappa >= 0 THEN 'Slight' ELSE 'Poor' END"


@query(f"WITH {DOUBLY}, {ALPHA} SELECT units, alpha FROM alpha")
def krippendorff_alpha(spark, d):
    return ops.krippendorff_alpha(table(spark, d, "incident_labels"))


@query(f"WITH {KAPPA}, {ALPHA} SELECT label, n, kappa, {GRADE} AS grade, units, alpha FROM kap CROSS JOIN alpha")
def agreement(spark, d):
    return ops.agreement_report(table(spark, d, "incident_labels"))


@query(f"WITH {KAPPA} SELECT label, {GRADE} AS grade FROM kap")
def kappa_bands(spark, d):
    return ops.cohens_kappa(table(spark, d, "incident_labels")).select("label", ops.kappa_band(F.col("kappa")).alias("grade"))
