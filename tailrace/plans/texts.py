"""Queries over the texts: every scalar function and document stage."""

from __future__ import annotations

from pyspark.sql import functions as F

from tailrace.functions import licenses, text, urls
from tailrace.operators import documents as ops
from tailrace.plans.core import query, table

S = "source_documents"
WS = r"[\s\x{00A0}\x{0085}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{1680}]"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def at(sql: str, x: str) -> str:
    return sql.replace("{x}", x)


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, {q('^' + WS + '+|' + WS + '+$')}, '', 'g')"


def case_sql(x: str, pairs, default: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({x}, {q(p)}) THEN {v}" for v, p in pairs) + f" ELSE {default} END"


NETLOC = "regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)"
HOST_SQL = f"nullif(regexp_replace(regexp_replace(lower({NETLOC}), '^.*@', ''), ':[0-9]*$', ''), '')"
STRIPPED = f"lower({NETLOC})"
for _p in urls.HOST_PREFIXES:
    STRIPPED = f"regexp_replace({STRIPPED}, {q('^' + _p.replace('.', chr(92) + '.'))}, '')"
_SECOND = ", ".join(q(x) for x in urls.SECOND_LEVEL)
ORG_SQL = f"""CASE WHEN url IS NULL OR url = '' THEN 'unknown'
 WHEN len(string_split({STRIPPED}, '.')) >= 3 AND string_split({STRIPPED}, '.')[-1] IN ('io', 'com') AND string_split({STRIPPED}, '.')[-2] IN ('github', 'gitlab') THEN string_split({STRIPPED}, '.')[1]
 WHEN len(string_split({STRIPPED}, '.')) >= 3 AND string_split({STRIPPED}, '.')[-2] IN ({_SECOND}) THEN string_split({STRIPPED}, '.')[-3]
 WHEN len(string_split({STRIPPED}, '.')) >= 2 THEN string_split({STRIPPED}, '.')[-2]
 ELSE coalesce(nullif({STRIPPED}, ''), 'unknown') END"""
SKIP_SQL = " AND ".join(f"NOT contains(url, {q(s)})" for s in urls.SKIP)
LICENSE_SQL = case_sql("substr({x}, 1, 5000)", [(q(n), p) for n, p in licenses.LICENSE_PATTERNS], q(licenses.RESERVED))
SEVERITY_SQL = case_sql("substr({x}, 1, 5000)", [(str(i), p) for i, p in enumerate(text.SEVERITY_PATTERNS)], "NULL")
LANG_SQL = "CASE WHEN {x} IS NULL THEN NULL WHEN length(regexp_replace(substr({x}, 1, 2000), '[^\\p{L}]', '', 'g')) = 0 THEN 'unknown' WHEN length(regexp_replace(substr({x}, 1, 2000), '[^A-Za-z]', '', 'g')) > 0.8 * length(regexp_replace(substr({x}, 1, 2000), '[^\\p{L}]', '', 'g')) THEN 'en' ELSE 'non-en' END"
SECTIONS_SQL = "array_to_string(list_filter([" + ", ".join(f"{strip_sql('lower(regexp_extract({x}, ' + q(p) + ', 1))')}" for p in text.SECTION_PATTERNS) + "], lambda x: x <> ''), '|')"
FLAT = "regexp_replace(replace(replace({m}, ',', ''), '/', '-'), '\\s+', ' ', 'g')"
DATE_SQL = f"""CASE WHEN regexp_matches({FLAT}, '^[0-9]{{4}}-') THEN try_strptime({FLAT}, '%Y-%m-%d') WHEN regexp_matches({FLAT}, '^[0-9]{{1,2}}-') THEN try_strptime({FLAT}, '%m-%d-%Y') ELSE try_strptime({FLAT}, '%B %d %Y') END::DATE"""
MATCH_SQL = f"coalesce(nullif(regexp_extract(coalesce(title, ''), {q(text.DATE_PATTERN)}), ''), nullif(regexp_extract(substr(coalesce({{body}}, ''), 1, 2000), {q(text.DATE_PATTERN)}), ''))"


def date_sql(body: str) -> str:
    return DATE_SQL.replace("{m}", MATCH_SQL.replace("{body}", body))


HEAD = strip_sql("substr({x}, 1, 500)")
SUMMARY_SQL = f"CASE WHEN length({{x}}) > 0 THEN coalesce(nullif(regexp_extract({HEAD}, '(?s)^(.+\\.)', 1), ''), {HEAD}) END"


@query(f"SELECT id, url, min(pos)::INTEGER AS pos FROM (SELECT id, regexp_replace(trim(unnest(l)), '/+$', '') AS url, generate_subscripts(l, 1) - 1 AS pos FROM (SELECT id, regexp_extract_all(body, {q(urls.LINK)}, 2) AS l FROM {S})) WHERE {SKIP_SQL} GROUP BY id, url")
def extract_links(spark, d):
    return ops.extract_links(table(spark, d, S))


@query(f"""SELECT DISTINCT url FROM (SELECT regexp_replace(trim(unnest(regexp_extract_all(body, {q(urls.LINK)}, 2))), '/+$', '') AS url FROM {S}) x
 WHERE {SKIP_SQL} AND NOT EXISTS (SELECT 1 FROM {S} s WHERE regexp_replace(s.url, '/+$', '') = x.url)""")
def seed_discover(spark, d):
    docs = table(spark, d, S)
    return ops.discover(docs, docs)


@query(f"SELECT id, {SKIP_SQL} AS kept FROM {S}")
def url_skip_filter(spark, d):
    return table(spark, d, S).select("id", urls.is_report_url(F.col("url")).alias("kept"))


PRIVATE = "regexp_matches({h}, '^(0|10|127|169\\.254|192\\.168|172\\.(1[6-9]|2[0-9]|3[01]))\\.') AND regexp_matches({h}, '^([0-9]{1,3}\\.){3}[0-9]{1,3}$')"
OK_URL = f"(regexp_matches(lower(url), '^https?:') AND {HOST_SQL} IS NOT NULL AND NOT ({PRIVATE.replace('{h}', HOST_SQL)}))"


@query(f"SELECT id, CASE WHEN ok THEN 'fetched' ELSE 'failed' END AS status, CASE WHEN ok THEN NULL ELSE 'crawl' END AS failed_stage, CASE WHEN ok THEN sha256(body) END AS page_hash FROM (SELECT id, body, coalesce({OK_URL}, false) AND body IS NOT NULL AS ok FROM {S})")
def crawl_pages(spark, d):
    return ops.fetch(table(spark, d, S))


@query("SELECT doc_id, f AS duplicate_of FROM (SELECT doc_id, first_value(doc_id) OVER (PARTITION BY text ORDER BY fetched_at, doc_id) AS f FROM documents WHERE length(text) > 0) WHERE doc_id <> f")
def crawl_exact_dup(spark, d):
    return ops.exact_copies(table(spark, d, "documents"), "doc_id", "fetched_at", "text")


HTML = "concat('<html><head><title lang=\"en\"> ', title, ' </title><style>p {}</style></head><body><nav>Home</nav><p>', replace(body, '\n', '</p><p>'), '</p><!-- end --><script>var x;</script></body></html>')"
HTML_STEPS = [
    (r"(?is)<(?:script|style|head|nav|footer|aside|form)\b.*?</(?:script|style|head|nav|footer|aside|form)>", " "),
    (r"(?s)<!--.*?-->", " "),
    (r"(?i)</?(?:p|div|br|li|ul|ol|tr|table|h[1-6]|pre|section|article|body|html)\b[^>]*>", "\n"),
    (r"<[^>]+>", ""),
]
HTML_SQL = HTML.replace("\n", "' || chr(10) || '")
for _p, _to in HTML_STEPS:
    HTML_SQL = f"regexp_replace({HTML_SQL}, {q(_p)}, {'chr(10)' if _to == chr(10) else q(_to)}, 'g')"
for _e, _c in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
    HTML_SQL = f"replace({HTML_SQL}, {q(_e)}, {q(_c)})"
HTML_SQL = f"nullif({strip_sql(f'''regexp_replace(regexp_replace({HTML_SQL}, '[ \\t]+', ' ', 'g'), '\\s*\\n\\s*', chr(10), 'g')''')}, '')"


@query(f"SELECT id, {strip_sql('title')} AS html_title FROM {S} WHERE title IS NOT NULL AND title <> '' AND body IS NOT NULL AND NOT contains(title, '<')")
def html_title(spark, d):
    docs = table(spark, d, S).filter("title IS NOT NULL AND title <> '' AND body IS NOT NULL AND NOT contains(title, '<')")
    return docs.select("id", text.html_title(F.expr(HTML.replace("\n", "\\n"))).alias("html_title"))


@query(f"SELECT id, {HTML_SQL} AS content FROM {S} WHERE title IS NOT NULL AND body IS NOT NULL")
def html_to_text(spark, d):
    return table(spark, d, S).filter("title IS NOT NULL AND body IS NOT NULL").select("id", text.html_text(F.expr(HTML.replace("\n", "\\n"))).alias("content"))


@query("SELECT doc_id, md5(nfc_normalize(text || ' cafe' || chr(769))) AS nfc_md5 FROM documents WHERE text IS NOT NULL")
def nfc_text(spark, d):
    return table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", F.md5(text.nfc(F.concat("text", F.lit(" café")))).alias("nfc_md5"))


@query(f"SELECT doc_id, {at(LANG_SQL, 'text')} AS language FROM documents")
def detect_language(spark, d):
    return table(spark, d, "documents").select("doc_id", text.detect_language(F.col("text")).alias("language"))


@query(f"SELECT doc_id, {at(SECTIONS_SQL, 'text')} AS sections FROM documents WHERE text IS NOT NULL")
def detect_sections(spark, d):
    return table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", F.array_join(text.detect_sections(F.col("text")), "|").alias("sections"))


@query("SELECT doc_id, sha256(text) AS content_hash FROM documents")
def content_hash(spark, d):
    return table(spark, d, "documents").select("doc_id", text.content_hash(F.col("text")).alias("content_hash"))


@query(f"""SELECT id, CASE WHEN good THEN 'parsed' ELSE 'failed' END AS status, CASE WHEN good THEN NULL ELSE 'parse' END AS failed_stage, CASE WHEN NOT empty THEN lang END AS language
 FROM (SELECT id, empty, lang, NOT empty AND coalesce(lang = 'en', false) AS good FROM (SELECT id, coalesce(length({strip_sql('body')}) = 0, true) AS empty, {at(LANG_SQL, 'body')} AS lang FROM {S}))""")
def parse_status(spark, d):
    return ops.parse(table(spark, d, S)).select("id", "status", "failed_stage", "language")


@query(f"SELECT id, {ORG_SQL} AS org FROM {S}")
def extract_org(spark, d):
    return table(spark, d, S).select("id", urls.extract_org(F.col("url")).alias("org"))


@query(f"SELECT doc_id, {at(SEVERITY_SQL, 'text')}::INTEGER AS severity FROM documents")
def severity(spark, d):
    return table(spark, d, "documents").select("doc_id", text.severity(F.col("text")).alias("severity"))


@query(f"SELECT doc_id, {date_sql('text')} AS occurred_on FROM documents")
def extract_date(spark, d):
    return table(spark, d, "documents").select("doc_id", text.extract_date(F.col("title"), F.col("text")).alias("occurred_on"))


@query(f"SELECT doc_id, {at(SUMMARY_SQL, 'text')} AS summary FROM documents")
def summary(spark, d):
    return table(spark, d, "documents").select("doc_id", text.summary(F.col("text")).alias("summary"))


#: Licence wording doesn't occur in the texts; every seventh shape of it is added to a text of its own.
WORDING = "CASE CAST(doc_id % 10 AS INT) WHEN 0 THEN ' Released under CC0.' WHEN 1 THEN ' Creative Commons Attribution 4.0' WHEN 2 THEN ' CC-BY-SA-4.0' WHEN 3 THEN ' Apache License, Version 2.0' WHEN 4 THEN ' MIT License applies.' WHEN 5 THEN ' cc by 3.0' WHEN 6 THEN ' in the public  domain' ELSE '' END"


@query(f"SELECT doc_id, {at(LICENSE_SQL, 't')} AS license FROM (SELECT doc_id, {WORDING} || coalesce(text, '') AS t FROM documents)")
def license_text(spark, d):
    return table(spark, d, "documents").select("doc_id", licenses.license_in_text(F.concat(F.expr(WORDING), F.coalesce("text", F.lit("")))).alias("license"))


REPO = "CASE CAST(doc_id % 5 AS INT) WHEN 0 THEN ' MIT ' WHEN 1 THEN 'Apache-2.0' WHEN 2 THEN 'GPL-3.0' WHEN 3 THEN 'other' ELSE NULL END"
MAP_SQL = f"CASE WHEN lower(trim(r)) IN ({', '.join(q(x) for x in licenses.REPOSITORY_LICENSES)}) THEN lower(trim(r)) ELSE '{licenses.RESERVED}' END"


@query(f"SELECT doc_id, {MAP_SQL} AS license FROM (SELECT doc_id, {REPO} AS r FROM documents)")
def license_map(spark, d):
    return table(spark, d, "documents").select("doc_id", licenses.license_of_repository(F.expr(REPO)).alias("license"))


@query(f"SELECT doc_id, CASE WHEN m <> '{licenses.RESERVED}' THEN m ELSE t END AS license FROM (SELECT doc_id, {MAP_SQL} AS m, {at(LICENSE_SQL, 't')} AS t FROM (SELECT doc_id, {REPO} AS r, {WORDING} || coalesce(text, '') AS t FROM documents))")
def license_combined(spark, d):
    return table(spark, d, "documents").select("doc_id", licenses.license_of(F.concat(F.expr(WORDING), F.coalesce("text", F.lit(""))), F.expr(REPO)).alias("license"))


@query(f"SELECT id, license, coalesce(license IN ({', '.join(q(x) for x in licenses.PERMISSIVE)}), false) AS full_text FROM incidents")
def export_policy(spark, d):
    return table(spark, d, "incidents").select("id", "license", licenses.is_permissive(F.col("license")).alias("full_text"))


GUARD = "(VALUES ('http://example.com/a'), ('https://8.8.8.8/x'), ('ftp://example.com'), ('file:///etc/passwd'), ('http:///nohost'), ('http://127.0.0.1/'), ('http://10.1.2.3:80/'), ('https://172.16.9.9'), ('http://192.168.0.1/x'), ('http://169.254.169.254/meta'), ('https://172.32.0.1/'), ('http://user@10.0.0.1/'), (NULL))"


@query(f"""SELECT url, CASE WHEN url IS NULL OR NOT regexp_matches(lower(url), '^https?:') THEN 'scheme' WHEN {HOST_SQL} IS NULL THEN 'host' WHEN {PRIVATE.replace('{h}', HOST_SQL)} THEN 'address' ELSE 'ok' END AS verdict
 FROM (SELECT url FROM {S} UNION ALL SELECT url FROM {GUARD} g(url))""")
def ssrf_guard(spark, d):
    extra = spark.sql(f"SELECT url FROM VALUES {GUARD[8:-1]} AS g(url)")
    return table(spark, d, S).select("url").unionByName(extra).select("url", urls.url_verdict(F.col("url")).alias("verdict"))


@query()
def robots_filter(spark, d):
    robots = spark.createDataFrame([("status.kanefe.example", "User-agent: *\nDisallow: /reports/"), ("blog.lemodo.example", "User-agent: *\nDisallow: /")], "host string, body string")
    return ops.robots_allowed(table(spark, d, S).select("id", "url"), robots)


@query(f"SELECT id, (row_number() OVER (PARTITION BY {HOST_SQL} ORDER BY created_at, id) - 1) * 2.0::DOUBLE AS start_s FROM {S} WHERE url IS NOT NULL")
def politeness_schedule(spark, d):
    return ops.politeness(table(spark, d, S).filter("url IS NOT NULL"), [F.asc("created_at"), F.asc("id")]).select("id", "start_s")


NAMED_SQL = "list_transform(list_filter(coalesce(sections, []), lambda s: length(s.text) > 0), lambda s: '[' || s.name || ']: ' || substr(s.text, 1, 500))"


@query(f"""SELECT id, array_to_string(list_concat(list_filter([CASE WHEN length(title) > 0 THEN 'Title: ' || title END, CASE WHEN length(summary) > 0 THEN 'Summary: ' || substr(summary, 1, 500) END, CASE WHEN length(body) > 0 THEN 'Body:' || chr(10) || substr(body, 1, 2000) END], lambda x: x IS NOT NULL), {NAMED_SQL}), chr(10) || chr(10)) AS prompt FROM (SELECT i.*, s.body FROM incidents i LEFT JOIN source_documents s ON s.id = i.document_id)""")
def llm_prompt(spark, d):
    bodies = table(spark, d, S).select(F.col("id").alias("document_id"), "body")
    return table(spark, d, "incidents").join(bodies, "document_id", "left").select("id", text.llm_prompt(F.col("title"), F.col("summary"), F.col("body"), F.col("sections")).alias("prompt"))


RESPONSE = "CASE CAST(doc_id % 5 AS INT) WHEN 0 THEN '{\"labels\": [\"dns\", \"nonsense\", \"bad-deploy\"], \"reasoning\": \"x\"}' WHEN 1 THEN '```json' || chr(10) || '{\"labels\": [\"quota-limit\"]}' || chr(10) || '```' WHEN 2 THEN '{\"labels\": []}' WHEN 3 THEN 'no json' ELSE '{\"other\": 1}' END"


@query("SELECT doc_id, CASE CAST(doc_id % 5 AS INT) WHEN 0 THEN 'dns|bad-deploy' WHEN 1 THEN 'quota-limit' WHEN 3 THEN NULL ELSE '' END AS labels FROM documents")
def llm_parse(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(text.llm_labels(F.expr(RESPONSE)), "|").alias("labels"))


@query("SELECT id, substr(sha256(content_hash || ':v1'), 1, 32) AS cache_key FROM incidents")
def llm_cache_key(spark, d):
    return table(spark, d, "incidents").select("id", text.llm_cache_key(F.col("content_hash")).alias("cache_key"))


TEXTS_SQL = "list_transform(coalesce(sections, []), lambda s: coalesce(s.text, ''))"


@query(f"SELECT id, array_to_string(list_filter(list_concat([coalesce(title, ''), coalesce(summary, '')], {TEXTS_SQL}), lambda x: x <> ''), chr(10) || chr(10)) AS text FROM incidents")
def training_text(spark, d):
    return table(spark, d, "incidents").select("id", text.training_text(F.col("title"), F.col("summary"), F.col("sections")).alias("text"))


@query(f"""SELECT id, unnest(c) AS chunk, generate_subscripts(c, 1)::INTEGER - 1 AS pos FROM (SELECT id, list_concat(list_filter([array_to_string(list_filter([coalesce(title, ''), coalesce(summary, '')], lambda x: x <> ''), chr(10) || chr(10))], lambda x: x <> ''),
 list_transform(list_filter({TEXTS_SQL}, lambda x: {strip_sql('x')} <> ''), lambda x: substr(x, 1, 100000))) AS c FROM incidents)""")
def split_sections(spark, d):
    return table(spark, d, "incidents").select("id", F.posexplode(text.section_chunks(F.col("title"), F.col("summary"), F.col("sections"))).alias("pos", "chunk"))


@query(f"""SELECT id AS document_id, {ORG_SQL} AS org, coalesce(nullif(title, ''), 'Untitled incident') AS title, {date_sql('body')} AS occurred_on, {at(SEVERITY_SQL, "coalesce(body, '')")}::INTEGER AS severity,
 {at(SUMMARY_SQL, 'body')} AS summary FROM {S} WHERE status = 'deduped'""")
def promote_documents(spark, d):
    return ops.promote(table(spark, d, S).filter("status = 'deduped'")).drop("license")
