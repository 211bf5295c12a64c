"""Scalar functions against tables of cases."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tailrace.functions import licenses, text, urls


def one(spark, column, **values):
    names = list(values)
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} string" for n in names))
    return df.select(column(*[F.col(n) for n in names]).alias("x")).head()["x"]


@pytest.mark.parametrize(
    ("url", "org"),
    [
        ("https://engineering.shopify.com/a", "shopify"), ("https://www.google.com", "google"), ("https://blog.cloudflare.com/x", "cloudflare"), ("https://status.github.com", "github"),
        ("https://mycompany.github.io/p", "mycompany"), ("https://blog.acme.co.uk", "acme"), (None, "unknown"), ("", "unknown"), ("no url", "unknown"), ("http://localhost/x", "localhost"),
    ],
)
def test_org(spark, url, org):
    assert one(spark, urls.extract_org, url=url) == org


@pytest.mark.parametrize(
    ("t", "sev"),
    [("A total outage", 0), ("there was data  loss", 0), ("major outage", 1), ("partial outage", 2), ("degraded", 2), ("a minor issue", 3), ("fine", None), ("total outage after a minor issue", 0), ("x" * 5001 + " total outage", None)],
)
def test_severity(spark, t, sev):
    assert one(spark, text.severity, t=t) == sev


@pytest.mark.parametrize(
    ("title", "body", "date"),
    [
        ("Incident 2024-03-15", None, dt.date(2024, 3, 15)), (None, "On 03/15/2024 it broke", dt.date(2024, 3, 15)), ("x", "January 5, 2023", dt.date(2023, 1, 5)), ("x", "March 22 2022", dt.date(2022, 3, 22)),
        ("x", "2024/07/04", dt.date(2024, 7, 4)), ("none", "none", None), ("2024-01-01", "2023-01-01", dt.date(2024, 1, 1)), ("2024-02-31", "2023-01-01", None), ("", "y" * 2000 + "2023-01-01", None), ("0000-01-01", None, None),
    ],
)
def test_date(spark, title, body, date):
    assert one(spark, text.extract_date, title=title, body=body) == date


def test_summary(spark):
    assert one(spark, text.summary, b="short") == "short"
    assert one(spark, text.summary, b=None) is None
    cut = one(spark, text.summary, b="First sentence. " + "x" * 600)
    assert cut == "First sentence."
    assert len(one(spark, text.summary, b="x" * 600)) == 500


@pytest.mark.parametrize(
    ("t", "name"),
    [("CC0", "cc0-1.0"), ("Creative Commons Zero", "cc0-1.0"), ("in the public domain", "cc0-1.0"), ("CC BY 4.0", "cc-by-4.0"), ("CC-BY-SA-4.0", "cc-by-sa-4.0"), ("Apache License, Version 2.0", "apache-2.0"), ("the MIT License", "mit"), ("nothing", "all-rights-reserved")],
)
def test_license_in_text(spark, t, name):
    assert one(spark, licenses.license_in_text, t=t) == name


def test_license_of(spark):
    assert one(spark, licenses.license_of_repository, t=" MIT ") == "mit"
    assert one(spark, licenses.license_of_repository, t=None) == "all-rights-reserved"
    assert one(spark, licenses.license_of, b="CC0", r="GPL-3.0") == "gpl-3.0"
    assert one(spark, licenses.license_of, b="CC0", r="odd") == "cc0-1.0"
    assert one(spark, licenses.is_permissive, x="gpl-3.0") is False
    assert one(spark, licenses.is_permissive, x=None) is False


def test_language(spark):
    assert one(spark, text.detect_language, t="An English sentence.") == "en"
    assert one(spark, text.detect_language, t="日本語の文章" * 50) == "non-en"
    assert one(spark, text.detect_language, t="123 !") == "unknown"
    assert one(spark, text.detect_language, t=None) is None


def test_sections(spark):
    found = one(spark, text.detect_sections, t="## Impact\nx\n## Root Cause\n## Timeline\n## Lessons Learned")
    assert found == ["impact", "timeline", "root cause", "lessons learned"]
    assert one(spark, text.detect_sections, t="plain") == []


@pytest.mark.parametrize(
    ("url", "verdict"),
    [
        ("http://example.com", "ok"), ("https://8.8.8.8/x", "ok"), ("ftp://example.com", "scheme"), ("file:///etc", "scheme"), ("http:///x", "host"), ("http://127.0.0.1", "address"), ("http://10.0.0.8:80/", "address"),
        ("http://172.16.0.1", "address"), ("http://172.32.0.1", "ok"), ("http://192.168.1.1", "address"), ("http://169.254.0.1", "address"), ("http://[::1]/", "address"), ("http://[2001:4860:4860::8888]/", "ok"), (None, "scheme"), ("http://localhost/", "address"),
    ],
)
def test_guard(spark, url, verdict):
    assert one(spark, urls.url_verdict, url=url) == verdict


def test_links(spark):
    md = "[a](https://x.com/1/) and [b](http://y.org/p) again [a](https://x.com/1) ![b](https://img.shields.io/badge)"
    assert one(spark, urls.links, m=md) == ["https://x.com/1", "http://y.org/p", "https://x.com/1", "https://img.shields.io/badge"]
    assert one(spark, urls.is_report_url, u="https://img.shields.io/badge") is False
    assert one(spark, urls.links, m="") == []


def test_html(spark):
    page = "<html><head><title> A &amp; B </title><style>p{}</style></head><body><nav>menu</nav><p>One<br>two</p><script>var x;</script><pre>code  x</pre></body></html>"
    assert one(spark, text.html_title, h=page) == "A &amp; B"
    assert one(spark, text.html_title, h="<p>none</p>") is None
    assert one(spark, text.html_text, h=page) == "One\ntwo\ncode x"
    assert one(spark, text.parsed_html_text, h=page) == "One\ntwo\ncode x"
    assert one(spark, text.html_text, h="<body></body>") is None
    assert one(spark, text.parsed_html_text, h=None) is None


def test_llm(spark):
    assert one(spark, text.llm_labels, r='{"labels": ["dns", "nonsense", "bad-deploy"]}') == ["dns", "bad-deploy"]
    assert one(spark, text.llm_labels, r='```json\n{"labels": ["dns"]}\n```') == ["dns"]
    assert one(spark, text.llm_labels, r='{"labels": []}') == []
    assert one(spark, text.llm_labels, r="no json") is None


def test_nfc_and_strip(spark):
    assert one(spark, text.nfc, t="café") == "café"
    assert one(spark, text.strip, t="  \n x \t") == "x"


def test_chunks(spark):
    df = spark.createDataFrame([("T", "S", [("a", "x" * 200_000), ("b", "  "), ("c", None)])], "t string, s string, c array<struct<name:string,text:string>>")
    got = df.select(text.section_chunks(F.col("t"), F.col("s"), F.col("c")).alias("x")).head()["x"]
    assert [len(g) for g in got] == [4, 100_000]
