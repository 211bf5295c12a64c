"""Queries of near-duplicate detection."""

from __future__ import annotations

from pyspark.sql import functions as F

from tailrace.operators import dedup
from tailrace.plans.core import query, table

D = "documents"
PERMS = ", ".join(f"({i}, {a}, {b})" for i, (a, b) in enumerate(dedup.permutations()))
WORDS = "list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: w <> '')"
SHINGLES = f"""sh AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i+4], ' ') END AS s
 FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM (SELECT doc_id, {WORDS} AS w FROM documents WHERE text IS NOT NULL)))"""
SIG = f"""{SHINGLES}, code AS (SELECT doc_id, ('0x' || substr(md5(s), 1, 8))::BIGINT % {dedup.PRIME} AS c FROM sh), perm(p, a, b) AS (VALUES {PERMS}),
 hv AS (SELECT doc_id, p, min((a::BIGINT * c + b) % {dedup.PRIME}) AS h FROM code CROSS JOIN perm GROUP BY doc_id, p),
 band AS (SELECT doc_id, p // 4 AS i, 'b' || (p // 4) || ':' || md5('[' || string_agg(h::VARCHAR, ', ' ORDER BY p) || ']') AS band FROM hv GROUP BY doc_id, p // 4)"""
DUP = f"""{SIG}, cand AS (SELECT DISTINCT x.doc_id AS a, y.doc_id AS b FROM band x JOIN band y ON x.band = y.band AND x.doc_id < y.doc_id),
 sim AS (SELECT a, b, avg((x.h = y.h)::INT) AS j FROM cand JOIN hv x ON x.doc_id = a JOIN hv y ON y.doc_id = b AND x.p = y.p GROUP BY a, b),
 dup AS (SELECT b AS document_id, min(a) AS duplicate_of FROM sim WHERE j >= 0.85 GROUP BY b)"""


def _sigs(spark, d):
    return dedup.signatures(table(spark, d, D), "doc_id", "text")


def _dups(spark, d):
    docs = table(spark, d, D)
    return dedup.near_duplicates(_sigs(spark, d), docs.select(F.col("doc_id").alias("document_id"), F.col("doc_id").alias("seq")))


@query(f"WITH {SHINGLES} SELECT doc_id, count(*)::INTEGER AS n FROM sh GROUP BY doc_id")
def shingles(spark, d):
    return table(spark, d, D).filter("text IS NOT NULL").select("doc_id", F.size(dedup.shingles(F.col("text"))).alias("n"))


@query(f"WITH {SIG} SELECT doc_id AS document_id, md5(string_agg(h::VARCHAR, ',' ORDER BY p)) AS signature FROM hv GROUP BY doc_id")
def minhash_signatures(spark, d):
    return _sigs(spark, d).select("document_id", F.md5(F.array_join(F.col("hashvalues").cast("array<string>"), ",")).alias("signature"))


@query(f"WITH {SIG} SELECT doc_id AS document_id, band FROM band")
def lsh_bands(spark, d):
    return _sigs(spark, d).select("document_id", F.explode("band_hashes").alias("band"))


@query("""WITH s AS (SELECT document_id, any_value(hashvalues) AS h FROM minhash_signatures WHERE num_perm = 128 AND hashvalues IS NOT NULL GROUP BY document_id HAVING count(*) = 1)
 SELECT s.document_id, s.h = s.h AS same, round(list_sum(list_transform(list_zip(s.h, t.h), lambda z: (z[1] = z[2])::INT)) / len(s.h), 6) AS similarity
 FROM s JOIN minhash_signatures m ON m.document_id = s.document_id JOIN s t ON t.document_id = m.canonical_id""")
def minhash_jaccard(spark, d):
    raw = table(spark, d, "minhash_signatures").filter("num_perm = 128 AND hashvalues IS NOT NULL")
    s = raw.groupBy("document_id").agg(F.first("hashvalues").alias("h"), F.count("*").alias("n")).filter("n = 1").select("document_id", "h")
    links = table(spark, d, "minhash_signatures").select("document_id", "canonical_id")
    t = s.select(F.col("document_id").alias("canonical_id"), F.col("h").alias("g"))
    return s.join(links, "document_id").join(t, "canonical_id").select("document_id", (F.col("h") == F.col("h")).alias("same"), F.round(dedup.signature_similarity(F.col("h"), F.col("g")), 6).alias("similarity"))


@query(f"WITH {DUP} SELECT document_id, duplicate_of FROM dup")
def near_duplicates(spark, d):
    return _dups(spark, d).select("document_id", "duplicate_of")


@query(f"WITH {DUP} SELECT doc_id AS document_id, CASE WHEN text IS NULL THEN 'failed' WHEN duplicate_of IS NOT NULL THEN 'duplicate' ELSE 'deduped' END AS status, duplicate_of FROM documents LEFT JOIN dup ON dup.document_id = doc_id")
def dedup_status(spark, d):
    return dedup.dedup_status(table(spark, d, D), _dups(spark, d), "doc_id", "text")


@query("SELECT sum((status = 'duplicate')::INT)::BIGINT AS duplicates, sum((status = 'deduped')::INT)::BIGINT AS kept, round(100.0 * sum((status = 'duplicate')::INT) / sum((status IN ('duplicate', 'deduped'))::INT), 1) AS rate FROM source_documents")
def dup_rate(spark, d):
    return dedup.duplicate_rate(table(spark, d, "source_documents"))
