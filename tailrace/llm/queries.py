"""The queries of the text operators, and SQL for those that SQL can express."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tailrace.llm import leaks, mixing, repeated_lines, truncation, wrapper
from tailrace.llm.consensus import Consensus
from tailrace.llm.grouped_splits import component_names, load_components, save_components, tied_names, update_components
from tailrace.llm.near_duplicates import NearDuplicates
from tailrace.llm.split_overlap import SplitOverlap, overlap_report
from tailrace.session import work_dir
from tailrace.taxonomy import LABELS

_ENTITIES = ("org", "incident_id")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SplitOverlap(_table(spark, sf_dir, "labeled_examples"), least=0.7).pairs()


def p1_overlap_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap_report(_table(spark, sf_dir, "labeled_examples"), least=0.7)


def p1_overlapping_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SplitOverlap(_table(spark, sf_dir, "labeled_examples"), least=0.7).records()


def _targets(spark: SparkSession, sf_dir: str) -> dict[str, float]:
    return {r["split_name"]: r["share"] for r in _table(spark, sf_dir, "split_targets").collect()}


def _splits(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return update_components(_table(spark, sf_dir, "labeled_examples"), "example_id", _ENTITIES, _targets(spark, sf_dir))


def _in_two_batches(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The component table after the records of today's train split came first and all others, with another session's table to load, later."""
    records, targets = _table(spark, sf_dir, "labeled_examples"), _targets(spark, sf_dir)
    folder = f"{work_dir(spark)}/components-{uuid.uuid4().hex}"
    first = F.coalesce(F.col("split") == "train", F.lit(False))
    for batch in (records.filter(first), records.filter(~first)):
        table, placed = update_components(batch, "example_id", _ENTITIES, targets, load_components(spark, folder))
        save_components(table, folder)
    return load_components(spark, folder), placed


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tied_names(_in_two_batches(spark, sf_dir)[0]).select(F.col("a").alias("org_a"), F.col("b").alias("org_b"))


def p2_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return component_names(_in_two_batches(spark, sf_dir)[0]).select(F.col("name").alias("org"), F.col("first_name").alias("first_org"), F.col("n_names").alias("n_orgs"), F.col("size").alias("n_records"))


def p2_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _splits(spark, sf_dir)[1]


def p2_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each split's share of all records beside its target."""
    n = _splits(spark, sf_dir)[1].groupBy("split").agg(F.count("*").alias("n_records"))
    whole = n.agg(F.sum("n_records").alias("_all"))  # one row
    asked = _table(spark, sf_dir, "split_targets").select(F.col("split_name").alias("split"), F.col("share").alias("target"))
    return asked.join(n, "split", "full").crossJoin(F.broadcast(whole)).select("split", "n_records", "target", (F.col("n_records") / F.col("_all")).alias("share"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_lines.repeated_line_rows(_table(spark, sf_dir, "source_documents"))


def p3_stripped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_lines.strip_repeated_lines(_table(spark, sf_dir, "source_documents").select("id", "source_id", "body"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrapper.template_lines(_table(spark, sf_dir, "source_documents"))


def p5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrapper.main_text(_table(spark, sf_dir, "source_documents").select("id", "source_id", "title", "body"), "report").select("id", "report")


def _near(spark: SparkSession, sf_dir: str) -> NearDuplicates:
    return NearDuplicates(_table(spark, sf_dir, "source_documents"), 0.7, _table(spark, sf_dir, "minhash_signatures"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _near(spark, sf_dir).pairs()


def p6_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _near(spark, sf_dir).groups()


def _consensus(spark: SparkSession, sf_dir: str) -> Consensus:
    return Consensus(_table(spark, sf_dir, "incident_labels"), LABELS)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _consensus(spark, sf_dir).labels().select("incident_id", "label")


def p7_annotators(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _consensus(spark, sf_dir).annotators()


def p7_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _consensus(spark, sf_dir).agreement()


def p7_golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The consensus of the incidents whose labels are settled; SQL has the settled labels."""
    settled = _table(spark, sf_dir, "golden_set").select(F.col("id").alias("incident_id")).distinct()
    return _consensus(spark, sf_dir).labels().join(F.broadcast(settled), "incident_id", "left_semi").select("incident_id", "label")


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leaked(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "eval_items"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaks(spark, sf_dir).filter("run_edits = 0").select("doc_id", "item_id").distinct()


def p8_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leaked_passages(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "eval_items"))


def _mix(spark: SparkSession, sf_dir: str) -> mixing.Mix:
    return mixing.Mix(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "mix_targets"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir).rates.filter("short").select("source")


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir).shares()


def p9_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir).copies()


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.truncated(_table(spark, sf_dir, "documents"))


def p10_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.truncation_rates(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (p1_found, p1_overlap_report, p1_overlapping_records, p2_found, p2_components, p2_splits, p2_shares, p3_found, p3_stripped, p5_found, p5_main_text, p6_found, p6_groups, p7_found, p7_golden, p7_annotators, p7_agreement, p8_found, p8_leaks, p9_found, p9_shares, p9_copies, p10_found, p10_rates)
    return {f.__name__: f for f in own}


_WORDS = "list_filter(regexp_split_to_array(lower({x}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"


def _runs(name: str, key: str, text: str, table: str, k: int) -> str:
    """A CTE of the distinct runs of ``k`` words of each text."""
    w = _WORDS.format(x=text)
    return f"{name} AS (SELECT DISTINCT {key}, array_to_string(w[i:i + {k - 1}], ' ') AS run FROM (SELECT {key}, w, unnest(range(1, len(w) - {k - 2})) AS i FROM (SELECT {key}, {w} AS w FROM {table} WHERE {text} IS NOT NULL)))"


_FOLDED = """SELECT id, source_id, no, regexp_replace(lower(line), '[^\\p{L}]', '', 'g') AS k, line
 FROM (SELECT id, source_id, unnest(string_split(body, chr(10))) AS line, generate_subscripts(string_split(body, chr(10)), 1) AS no FROM source_documents WHERE source_id IS NOT NULL)"""
_RECURRING = f"""l AS (SELECT * FROM ({_FOLDED}) WHERE k <> '' AND NOT regexp_matches(line, '^\\s*#')),
 n AS (SELECT source_id, count(*) AS m FROM source_documents GROUP BY source_id), g AS (SELECT source_id, k FROM l JOIN n USING (source_id) GROUP BY source_id, k HAVING count(DISTINCT id) >= 4 AND count(DISTINCT id) >= 0.2 * max(m))"""


# fixed patterns, as in ``truncation``
_MARK = r"(\s*(\[\s*(\.{2,}|…|truncated|cut|more)\s*\]|\(\s*(\.{3}|…|truncated)\s*\)|…|\.{3,}|\x{FFFD}|<truncated>|\[\+\d+ chars\]))+\s*$"
_STOP = r"[.!?][\"'”’)\]*_]*$"
_OTHER = r"^(\s*([-*•+–—]|\d{1,3}[.)])\s|\s*\d{1,2}:\d{2}\b|    |\s*#|https?://)"
_BLANK = "' ' || chr(9) || chr(13) || chr(10) || chr(12) || chr(160)"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _cut_words(line: str) -> str:
    number = "'(0)[.,:/-](0)', '\\1_\\2', 'g'"
    masked = f"regexp_replace(regexp_replace(translate(lower({line}), '123456789', '000000000'), {number}), {number})"
    return f"regexp_split_to_array(regexp_replace({masked}, '[.!?]+(\\s|$)', ' . \\1', 'g'), '[^\\p{{L}}0._]+')"


def _cut_kind(line: str) -> str:
    return f"CASE WHEN regexp_matches(left({line}, 16), {_quoted(_OTHER)}) THEN 'other' WHEN length({line}) - length(replace({line}, ' ', '')) >= 7 THEN 'prose' ELSE 'short' END"


def _cut_stop(line: str) -> str:
    return f"regexp_matches(right(rtrim({line}, {_BLANK}), 8), {_quoted(_STOP)})"


def _cut_sql() -> str:
    """CTEs down to ``judged (doc_id, cut)``: one row for each text that ends without a stop."""
    levels = {"3": "kind, a, b, c", "2": "kind, b, c", "1": "kind, c", "3a": "a, b, c", "2a": "b, c", "1a": "c"}
    sums = ", ".join(f"s{n} AS (SELECT {k}, sum(inside) AS i{n}, sum(ends) AS e{n} FROM tri GROUP BY {k})" for n, k in levels.items())
    joins = " ".join(f"JOIN s{n} USING ({k})" for n, k in levels.items())
    shares = {n: f"CASE WHEN i{n} + e{n} - 1 >= 2 THEN (e{n} - 1) / (i{n} + e{n} - 1) END" for n in levels}
    return f"""t AS (SELECT doc_id, source, trim(text, {_BLANK}) AS text FROM documents),
 m AS (SELECT *, regexp_matches(right(text, 40), {_quoted(_MARK)}) AS marked FROM t WHERE text <> ''),
 body AS (SELECT doc_id, source, marked, CASE WHEN marked THEN rtrim(substr(text, 1, greatest(length(text) - 40, 0)) || regexp_replace(right(text, 40), {_quoted(_MARK)}, ''), {_BLANK}) ELSE text END AS body FROM m),
 line AS (SELECT unnest(string_split(body, chr(10))) AS line, unnest(range(1, len(string_split(body, chr(10))) + 1)) AS pos, len(string_split(body, chr(10))) AS n FROM body),
 w AS (SELECT CASE WHEN n > 1 AND pos = 1 AND NOT {_cut_stop("line")} THEN 'title' ELSE {_cut_kind("line")} END AS kind, pos = n AS final, {_cut_words("line")} AS w FROM line),
 word AS (SELECT kind, final, w, unnest(range(1, len(w) + 1)) AS i FROM w),
 shaped AS (SELECT kind, final, CASE WHEN i > 1 THEN w[i - 1] END AS p, CASE WHEN i > 2 THEN w[i - 2] END AS q, w[i] AS c, CASE WHEN i < len(w) THEN w[i + 1] END AS d FROM word WHERE w[i] NOT IN ('', '.')),
 inner_tri AS (SELECT kind, CASE WHEN coalesce(p, '') IN ('', '.') OR coalesce(q, '') IN ('', '.') THEN '^' ELSE q END AS a, CASE WHEN coalesce(p, '') IN ('', '.') THEN '^' ELSE p END AS b, c,
 count(*) FILTER (coalesce(d, '') <> '' AND d <> '.') AS inside, count(*) FILTER (coalesce(d, '') = '' AND NOT final) AS ends FROM shaped GROUP BY ALL),
 lastline AS (SELECT doc_id, source, marked, length(body) AS size, list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '[\\p{{L}}\\p{{N}}]'))[-1] AS line FROM body),
 lastwords AS (SELECT doc_id, source, marked, size, {_cut_kind("line")} AS kind, {_cut_stop("line")} AS ended, list_filter({_cut_words("line")}, lambda x: x NOT IN ('', '.')) AS v FROM lastline WHERE line IS NOT NULL),
 last AS (SELECT doc_id, source, marked, size, kind, ended, CASE WHEN len(v) > 2 THEN v[-3] ELSE '^' END AS a, CASE WHEN len(v) > 1 THEN v[-2] ELSE '^' END AS b, v[-1] AS c FROM lastwords WHERE len(v) > 0),
 tri AS (SELECT * FROM inner_tri UNION ALL SELECT kind, a, b, c, 0, count(DISTINCT (source, size)) FROM last WHERE NOT ended GROUP BY kind, a, b, c),
 {sums}, s0 AS (SELECT kind, sum(ends) / greatest(sum(inside) + sum(ends), 1) AS by_kind FROM tri GROUP BY kind),
 pair AS (SELECT b, c AS longer, sum(inside + ends) AS n FROM tri GROUP BY b, c), single AS (SELECT longer, sum(n) AS n FROM pair GROUP BY longer),
 open AS (SELECT * FROM last {joins} JOIN s0 USING (kind) WHERE NOT ended),
 piece AS (SELECT DISTINCT b, c FROM open WHERE NOT regexp_matches(c, '^[0_]+$')),
 longer2 AS (SELECT b, c, sum(n) AS longer2 FROM piece JOIN pair USING (b) WHERE length(longer) > length(c) AND starts_with(longer, c) GROUP BY b, c),
 longer1 AS (SELECT c, sum(n) AS longer1 FROM (SELECT DISTINCT c FROM piece) JOIN single ON length(longer) > length(c) AND starts_with(longer, c) GROUP BY c),
 judged AS (SELECT doc_id, coalesce(CASE WHEN kind = 'short' THEN coalesce({shares["3"]}, {shares["3a"]}, {shares["2a"]}) ELSE coalesce({shares["3"]}, {shares["2"]}, {shares["1"]}, by_kind) END < 0.05, false) OR (marked AND kind = 'short')
 OR (NOT regexp_matches(c, '^[0_]+$') AND ((i2a = 0 AND longer2 > 0 AND e2a - 1 <= 0.05 * longer2) OR (i1a = 0 AND longer1 > 0 AND e1a - 1 <= 0.05 * longer1))) AS cut
 FROM open LEFT JOIN longer2 USING (b, c) LEFT JOIN longer1 USING (c))"""


def oracle_sql() -> dict[str, str]:
    """SQL for the queries that can be expressed in it and end in time on whole tables; the others are held against brute force in the tests."""
    return {
        "p1_found": f"""WITH {_runs("r", "example_id", "text", "labeled_examples", 5)}, n AS (SELECT example_id, count(*) AS n FROM r GROUP BY example_id),
 b AS (SELECT x.example_id AS a, y.example_id AS b, count(*) AS k FROM r x JOIN r y ON x.run = y.run AND x.example_id < y.example_id GROUP BY ALL)
 SELECT a AS example_id_a, b AS example_id_b FROM b JOIN n x ON x.example_id = a JOIN n y ON y.example_id = b JOIN labeled_examples s ON s.example_id = a JOIN labeled_examples t ON t.example_id = b
 WHERE k >= 0.7 * (x.n + y.n - k) AND (s.split = 'train') <> (t.split = 'train')""",
        "p2_found": """WITH RECURSIVE e AS (SELECT DISTINCT incident_id, lower(trim(org)) AS org FROM labeled_examples WHERE incident_id IS NOT NULL AND org IS NOT NULL AND lower(trim(org)) NOT IN ('', 'unknown')),
 p AS (SELECT DISTINCT x.org AS a, y.org AS b FROM e x JOIN e y USING (incident_id)), c AS (SELECT a, b FROM p UNION SELECT c.a, p.b FROM c JOIN p ON c.b = p.a)
 SELECT a AS org_a, b AS org_b FROM c WHERE a < b""",
        "p2_components": """WITH RECURSIVE r AS (SELECT example_id, incident_id, CASE WHEN lower(trim(org)) NOT IN ('', 'unknown') THEN lower(trim(org)) END AS org FROM labeled_examples),
 e AS (SELECT DISTINCT incident_id, org FROM r WHERE org IS NOT NULL), p AS (SELECT DISTINCT x.org AS a, y.org AS b FROM e x JOIN e y USING (incident_id) UNION SELECT org, org FROM e),
 c AS (SELECT a, b FROM p UNION SELECT c.a, p.b FROM c JOIN p ON c.b = p.a), o AS (SELECT a AS org, min(b) AS first_org, count(*) AS n_orgs FROM c GROUP BY a),
 i AS (SELECT incident_id, min(first_org) AS first_org FROM e JOIN o USING (org) WHERE incident_id IS NOT NULL GROUP BY incident_id),
 n AS (SELECT coalesce(o.first_org, i.first_org) AS first_org, count(*) AS n_records FROM r LEFT JOIN o ON r.org = o.org LEFT JOIN i ON r.incident_id = i.incident_id GROUP BY 1)
 SELECT org, first_org, n_orgs, n_records FROM o JOIN n USING (first_org)""",
        "p3_found": f"WITH {_RECURRING} SELECT id, no AS line_no FROM l JOIN g USING (source_id, k)",
        "p3_stripped": f"""WITH {_RECURRING}, gone AS (SELECT id, list(no) AS x FROM l JOIN g USING (source_id, k) GROUP BY id)
 SELECT s.id, source_id, CASE WHEN x IS NULL THEN body ELSE array_to_string(list_filter(string_split(body, chr(10)), lambda line, i: NOT list_contains(x, i)), chr(10)) END AS body FROM source_documents s LEFT JOIN gone USING (id)""",
        "p10_found": f"WITH {_cut_sql()} SELECT doc_id FROM judged WHERE coalesce(cut, false)",
        "p10_rates": f"""WITH {_cut_sql()}, n AS (SELECT source, count(*) AS n_docs, count(DISTINCT CASE WHEN cut THEN doc_id END) AS n_truncated FROM documents LEFT JOIN judged USING (doc_id) GROUP BY source)
 SELECT *, n_truncated / n_docs AS share FROM n""",
        "p7_golden": "SELECT DISTINCT id AS incident_id, unnest(labels) AS label FROM golden_set",
        "p7_agreement": f"""WITH r AS (SELECT incident_id, lower(trim(annotator_id)) AS a, regexp_replace(lower(trim(label)), '[\\s_-]+', '-', 'g') AS label, coalesce(annotation_round, -1) AS round
 FROM incident_labels WHERE lower(trim(source)) = 'human' AND incident_id IS NOT NULL AND trim(annotator_id) <> ''),
 v AS (SELECT DISTINCT incident_id, a, label FROM (SELECT *, rank() OVER (PARTITION BY incident_id, a ORDER BY round DESC) AS k FROM r) WHERE k = 1),
 n AS (SELECT incident_id, count(DISTINCT a) AS n FROM v GROUP BY incident_id HAVING count(DISTINCT a) > 1), t AS (SELECT unnest({list(LABELS)}) AS label),
 y AS (SELECT t.label, n.incident_id, any_value(n.n) AS n, count(v.a) AS y FROM n CROSS JOIN t LEFT JOIN v ON v.incident_id = n.incident_id AND v.label = t.label GROUP BY t.label, n.incident_id),
 g AS (SELECT label, count(*) AS items, sum(2.0 * y * (n - y) / (n - 1)) AS diff, sum(y) AS ones, sum(n) AS vals FROM y GROUP BY label)
 SELECT label, items, CASE WHEN ones > 0 AND ones < vals THEN 1 - diff / (2.0 * ones * (vals - ones) / (vals - 1)) ELSE 1.0 END AS alpha FROM g""",
        "p8_found": f"WITH {_runs('d', 'doc_id', 'text', 'documents', 13)}, {_runs('i', 'item_id', 'text', 'eval_items', 13)} SELECT DISTINCT doc_id, item_id FROM d JOIN i USING (run)",
    }
