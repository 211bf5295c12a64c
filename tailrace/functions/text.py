"""Functions on texts: trimming, language, sections, severity, dates, summaries, HTML and language-model prompts."""

from __future__ import annotations

import unicodedata
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tailrace.taxonomy import LABELS

# fixed values: sections, in the order in which they are listed
SECTION_PATTERNS = (
    r"(?i)\b(impact|blast radius)\b",
    r"(?i)\b(timeline|chronology)\b",
    r"(?i)\b(root\s*cause|cause)\b",
    r"(?i)\b(lessons?\s*learned|takeaways?|action\s*items?)\b",
    r"(?i)\b(mitigation|remediation|resolution|recovery)\b",
    r"(?i)\b(detection|monitoring|alerting)\b",
    r"(?i)\b(prevention|follow[\s-]*up)\b",
    r"(?i)\b(summary|overview|abstract|background)\b",
)

# fixed values: severity by wording, 0 is the worst
SEVERITY_PATTERNS = (
    r"(?i)\b(total\s+outage|complete\s+outage|data\s+loss|data\s+breach)\b",
    r"(?i)\b(major\s+outage|significant\s+impact|service\s+down)\b",
    r"(?i)\b(partial\s+outage|degraded|elevated\s+error|latency\s+spike)\b",
    r"(?i)\b(minor\s+issue|intermittent|brief\s+disruption)\b",
)

# fixed values: the three forms of a date
MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
DATE_PATTERN = rf"(?:{MONTHS})\s+\d{{1,2}},?\s+\d{{4}}|\d{{4}}[-/]\d{{1,2}}[-/]\d{{1,2}}|\d{{1,2}}[-/]\d{{1,2}}[-/]\d{{4}}"

SUMMARY_CHARS = 500
SEVERITY_CHARS = 5000
DATE_CHARS = 2000
LANGUAGE_CHARS = 2000
UNTITLED = "Untitled incident"
PROMPT_VERSION = "v1"


def strip(x: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def blank_to_null(x: Column) -> Column:
    return F.when(strip(x) != "", x)


def content_hash(x: Column) -> Column:
    return F.sha2(x, 256)


def detect_language(x: Column) -> Column:
    """``en`` if over four fifths of the letters among the first 2,000 characters are ASCII, else ``non-en``; ``unknown`` without letters."""
    head = F.substring(x, 1, LANGUAGE_CHARS)
    letters = F.length(F.regexp_replace(head, r"[^\p{L}]", ""))
    ascii_ = F.length(F.regexp_replace(head, r"[^A-Za-z]", ""))
    return F.when(x.isNull(), None).when(letters == 0, "unknown").when(ascii_ > 0.8 * letters, "en").otherwise("non-en")


def detect_sections(x: Column) -> Column:
    """What each section pattern first matches, lower-cased, in the order of the patterns."""
    hits = [F.lower(F.nullif(F.regexp_extract(x, p, 1), F.lit(""))) for p in SECTION_PATTERNS]
    return F.array_compact(F.array(*[strip(h) for h in hits]))


def severity(x: Column) -> Column:
    """The first severity whose wording occurs in the first 5,000 characters; null if none does."""
    head = F.substring(x, 1, SEVERITY_CHARS)
    out = F.when(head.rlike(SEVERITY_PATTERNS[0]), 0)
    for level, p in enumerate(SEVERITY_PATTERNS[1:], 1):
        out = out.when(head.rlike(p), level)
    return out.cast("int")


def parse_date(x: Column) -> Column:
    """A date from one of the three forms; null if there is no such day."""
    flat = F.regexp_replace(F.regexp_replace(F.regexp_replace(x, ",", ""), "/", "-"), r"\s+", " ")
    ymd = F.try_to_date(flat, "yyyy-M-d")
    mdy = F.try_to_date(flat, "M-d-yyyy")
    name = F.try_to_date(flat, "MMMM d yyyy")
    parsed = F.when(flat.rlike(r"^\d{4}-"), ymd).when(flat.rlike(r"^\d{1,2}-"), mdy).otherwise(name)
    return F.when(F.year(parsed) >= 1, parsed)


def extract_date(title: Column, body: Column) -> Column:
    """The date that the title names, else the body's first 2,000 characters. A date in the title that doesn't exist gives null."""
    in_title = F.nullif(F.regexp_extract(F.coalesce(title, F.lit("")), DATE_PATTERN, 0), F.lit(""))
    in_body = F.nullif(F.regexp_extract(F.substring(F.coalesce(body, F.lit("")), 1, DATE_CHARS), DATE_PATTERN, 0), F.lit(""))
    return parse_date(F.coalesce(in_title, in_body))


def summary(body: Column) -> Column:
    """The first 500 characters up to their last full stop; null for null and empty."""
    head = strip(F.substring(body, 1, SUMMARY_CHARS))
    upto = F.nullif(F.regexp_extract(head, r"(?s)^(.+\.)", 1), F.lit(""))
    return F.when(F.length(body) > 0, F.coalesce(upto, head))


def title_or_default(x: Column) -> Column:
    return F.coalesce(F.nullif(x, F.lit("")), F.lit(UNTITLED))


def html_title(html: Column) -> Column:
    """The text of the first title element, stripped; null if there is none."""
    found = F.regexp_extract(html, r"(?i)<title[^>]*>([^<]+)</title>", 1)
    return F.when(html.rlike(r"(?i)<title[^>]*>[^<]+</title>"), strip(found))


def html_text(html: Column) -> Column:
    """The text of an HTML page by replacement alone: scripts and styles out, blocks on lines of their own, entities resolved."""
    out = F.regexp_replace(html, r"(?is)<(script|style|head|nav|footer|aside|form)\b.*?</(script|style|head|nav|footer|aside|form)>", " ")
    out = F.regexp_replace(out, r"(?s)<!--.*?-->", " ")
    out = F.regexp_replace(out, r"(?i)</?(p|div|br|li|ul|ol|tr|table|h[1-6]|pre|section|article|body|html)\b[^>]*>", "\n")
    out = F.regexp_replace(out, r"<[^>]+>", "")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.nullif(strip(F.regexp_replace(F.regexp_replace(out, r"[ \t]+", " "), r"\s*\n\s*", "\n")), F.lit(""))


class _Text(HTMLParser):
    SKIP = {"script", "style", "head", "nav", "footer", "aside", "form", "noscript", "template"}
    BLOCK = {"p", "div", "br", "li", "ul", "ol", "tr", "table", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "section", "article", "blockquote"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.skip = 0

    def handle_starttag(self, tag, attrs):
        self.skip += tag in self.SKIP
        if tag in self.BLOCK:
            self.out.append("\n")

    def handle_endtag(self, tag):
        self.skip = max(0, self.skip - (tag in self.SKIP))
        if tag in self.BLOCK:
            self.out.append("\n")

    def handle_data(self, data):
        if not self.skip:
            self.out.append(data)


@F.pandas_udf(StringType())
def parsed_html_text(pages: pd.Series) -> pd.Series:
    """As ``html_text``, by a real parser: for pages whose tags don't nest."""

    def one(page):
        if not page:
            return None
        p = _Text()
        p.feed(page)
        p.close()
        lines = (" ".join(x.split()) for x in "".join(p.out).split("\n"))
        return "\n".join(x for x in lines if x) or None

    return pages.map(one)


@F.pandas_udf(StringType())
def nfc(texts: pd.Series) -> pd.Series:
    """Unicode normal form C; Spark has no function for it."""
    return texts.map(lambda x: None if x is None else unicodedata.normalize("NFC", x), na_action="ignore")


def join_nonempty(parts: list[Column], by: str = "\n\n") -> Column:
    return F.array_join(F.filter(F.array(*[F.coalesce(p, F.lit("")) for p in parts]), lambda x: x != ""), by)


def training_text(title: Column, summary_: Column, sections: Column) -> Column:
    """Title, summary and the sections' texts, empty ones left out."""
    texts = F.coalesce(F.transform(sections, lambda s: F.coalesce(s["text"], F.lit(""))), F.array().cast("array<string>"))
    return F.array_join(F.filter(F.concat(F.array(F.coalesce(title, F.lit("")), F.coalesce(summary_, F.lit(""))), texts), lambda x: x != ""), "\n\n")


def section_chunks(title: Column, summary_: Column, sections: Column, max_chars: int = 100_000) -> Column:
    """The chunks a classifier sees: title with summary, then each section that isn't blank, cut at ``max_chars``."""
    head = join_nonempty([title, summary_])
    texts = F.coalesce(F.transform(sections, lambda s: F.coalesce(s["text"], F.lit(""))), F.array().cast("array<string>"))
    kept = F.transform(F.filter(texts, lambda x: strip(x) != ""), lambda x: F.substring(x, 1, max_chars))
    return F.concat(F.filter(F.array(head), lambda x: x != ""), kept)


def llm_prompt(title: Column, summary_: Column, body: Column, sections: Column) -> Column:
    """The prompt's parts, empty ones left out."""
    def part(label, x, n=None):
        return F.when(F.length(x) > 0, F.concat(F.lit(label), F.substring(x, 1, n) if n else x))

    named = F.transform(F.filter(F.coalesce(sections, F.array().cast("array<struct<name:string,text:string>>")), lambda s: F.length(s["text"]) > 0), lambda s: F.concat(F.lit("["), s["name"], F.lit("]: "), F.substring(s["text"], 1, 500)))
    head = F.array_compact(F.array(part("Title: ", title), part("Summary: ", summary_, 500), part("Body:\n", body, 2000)))
    return F.array_join(F.concat(head, named), "\n\n")


def llm_labels(response: Column) -> Column:
    """The valid labels of a model's JSON answer, in its order; code fences are put aside; null if it is no JSON."""
    bare = F.regexp_replace(F.regexp_replace(strip(response), r"(?s)^```[^\n]*\n", ""), r"(?s)\n?```\s*$", "")
    parsed = F.from_json(bare, "labels array<string>")
    valid = F.filter(parsed["labels"], lambda x: x.isin(*LABELS))
    return F.when(F.try_parse_json(bare).isNotNull(), F.coalesce(valid, F.array().cast("array<string>")))


def llm_cache_key(hash_: Column, version: str = PROMPT_VERSION) -> Column:
    return F.substring(F.sha2(F.concat(hash_, F.lit(":"), F.lit(version)), 256), 1, 32)
