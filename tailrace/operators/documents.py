"""The document stages: links and seeds, fetching, exact copies, parsing, promotion, politeness and robots."""

from __future__ import annotations

from urllib.robotparser import RobotFileParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from tailrace.functions import licenses, text, urls


def extract_links(docs: DataFrame, key: str = "id", body: str = "body") -> DataFrame:
    """``key, url, pos``: the distinct links of each text with the place of their first use, skipped addresses left out."""
    found = docs.select(key, F.posexplode(urls.links(F.col(body))).alias("pos", "url")).filter(urls.is_report_url(F.col("url")))
    return found.groupBy(key, "url").agg(F.min("pos").alias("pos"))


def discover(lists: DataFrame, known: DataFrame, body: str = "body") -> DataFrame:
    """``url`` of every link that no known document has yet."""
    fresh = lists.select(F.explode(urls.links(F.col(body))).alias("url")).filter(urls.is_report_url(F.col("url"))).distinct()
    return fresh.join(known.select(F.regexp_replace("url", "/+$", "").alias("_url")), F.col("url") == F.col("_url"), "left_anti")


def fetch(docs: DataFrame) -> DataFrame:
    """``id, status, failed_stage, page_hash`` after fetching from the stored pages: guarded URLs fail, stored bodies count as fetched."""
    verdict = urls.url_verdict(F.col("url"))
    ok = (verdict == "ok") & F.col("body").isNotNull()
    return docs.select("id", F.when(ok, "fetched").otherwise("failed").alias("status"), F.when(ok, None).otherwise("crawl").alias("failed_stage"), F.when(ok, text.content_hash(F.col("body"))).alias("page_hash"))


def exact_copies(docs: DataFrame, key: str = "id", order: str = "created_at", body: str = "body") -> DataFrame:
    """``key, duplicate_of``: documents whose body equals an earlier one's. The first of each hash is found by aggregation, so a hot hash combines in each task."""
    hashed = docs.filter(F.length(body) > 0).select(key, order, text.content_hash(F.col(body)).alias("h"))
    first = hashed.groupBy("h").agg(F.min(F.struct(order, key)).alias("f"), F.count("*").alias("n")).filter("n > 1").select("h", F.col(f"f.{key}").alias("duplicate_of"))
    return hashed.join(first, "h").filter(F.col(key) != F.col("duplicate_of")).select(key, "duplicate_of")


def parse(docs: DataFrame, body: str = "body") -> DataFrame:
    """``id, status, failed_stage, language, content_hash, sections``: empty bodies and other languages than English fail."""
    lang = text.detect_language(F.col(body))
    empty = F.coalesce(F.length(text.strip(F.col(body))) == 0, F.lit(True))
    good = ~empty & (lang == "en")
    return docs.select(
        "id", F.when(good, "parsed").otherwise("failed").alias("status"), F.when(good, None).otherwise("parse").alias("failed_stage"),
        F.when(~empty, lang).alias("language"), F.when(good, text.content_hash(F.col(body))).alias("content_hash"), F.when(good, text.detect_sections(F.col(body))).alias("sections"),
    )


def promote(docs: DataFrame, title: str = "title", body: str = "body") -> DataFrame:
    """``document_id, org, title, occurred_on, severity, summary, license`` of each document as an incident."""
    return docs.select(
        F.col("id").alias("document_id"), urls.extract_org(F.col("url")).alias("org"), text.title_or_default(F.col(title)).alias("title"),
        text.extract_date(F.col(title), F.col(body)).alias("occurred_on"), text.severity(F.coalesce(F.col(body), F.lit(""))).alias("severity"),
        text.summary(F.col(body)).alias("summary"), F.coalesce(licenses.license_in_text(F.col(body)), F.lit(licenses.RESERVED)).alias("license"),
    )


def politeness(requests: DataFrame, order: list[Column], interval: float = 2.0) -> DataFrame:
    """``requests`` with ``start_s``, so that requests to one host are ``interval`` seconds apart."""
    w = Window.partitionBy(urls.host(F.col("url"))).orderBy(*order)
    return requests.withColumn("start_s", (F.row_number().over(w) - 1) * F.lit(interval))


def robots_allowed(requests: DataFrame, robots: DataFrame, agent: str = "tailrace") -> DataFrame:
    """``requests`` with ``allowed`` by the host's robots file (``host, body``); hosts without one allow everything."""

    @F.pandas_udf(BooleanType())
    def allowed(urls_: pd.Series, rules: pd.Series) -> pd.Series:
        parsed: dict[str, RobotFileParser] = {}

        def one(url, rule):
            if not rule or not url:
                return True
            if rule not in parsed:
                parsed[rule] = RobotFileParser()
                parsed[rule].parse(rule.splitlines())
            return parsed[rule].can_fetch(agent, url)

        return pd.Series([one(u, r) for u, r in zip(urls_, rules)], dtype=bool)

    rules = robots.select(F.lower("host").alias("_host"), F.col("body").alias("_rules")).dropDuplicates(["_host"])
    joined = requests.withColumn("_h", urls.host(F.col("url"))).join(rules, F.col("_h") == F.col("_host"), "left")
    return joined.withColumn("allowed", allowed("url", "_rules")).drop("_h", "_host", "_rules")
