"""Licences: found in texts, mapped from a repository's own name, and what may be exported under them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tailrace.functions.text import strip

# fixed values: patterns in the order in which they are tried
LICENSE_PATTERNS = (
    ("cc0-1.0", r"(?i)\bcc\s*0\b|creative\s+commons\s+zero|public\s+domain"),
    ("cc-by-4.0", r"(?i)creative\s+commons\s+attribution\s+4\.0|cc[\s-]*by[\s-]*4\.0"),
    ("cc-by-3.0", r"(?i)creative\s+commons\s+attribution\s+3\.0|cc[\s-]*by[\s-]*3\.0"),
    ("cc-by-2.0", r"(?i)creative\s+commons\s+attribution\s+2\.0|cc[\s-]*by[\s-]*2\.0"),
    ("cc-by-sa-4.0", r"(?i)creative\s+commons\s+attribution[\s-]*share\s*alike\s+4\.0|cc[\s-]*by[\s-]*sa[\s-]*4\.0"),
    ("cc-by-sa-3.0", r"(?i)creative\s+commons\s+attribution[\s-]*share\s*alike\s+3\.0|cc[\s-]*by[\s-]*sa[\s-]*3\.0"),
    ("apache-2.0", r"(?i)apache\s+license,?\s+version\s+2\.0|apache[\s-]*2\.0"),
    ("mit", r"(?i)\bMIT\s+License\b"),
)

# fixed values: names that repositories give
REPOSITORY_LICENSES = ("mit", "apache-2.0", "bsd-2-clause", "bsd-3-clause", "cc0-1.0", "cc-by-4.0", "cc-by-sa-4.0", "unlicense", "gpl-3.0", "lgpl-3.0", "agpl-3.0", "mpl-2.0")

# fixed values: licences under which full text may be exported
PERMISSIVE = ("cc0-1.0", "cc-by-4.0", "cc-by-3.0", "cc-by-2.0", "cc-by-sa-4.0", "cc-by-sa-3.0", "apache-2.0", "mit", "bsd-2-clause", "bsd-3-clause", "unlicense", "public-domain")

RESERVED = "all-rights-reserved"
LICENSE_CHARS = 5000


def license_in_text(x: Column) -> Column:
    """The first licence whose wording occurs in the first 5,000 characters."""
    head = F.substring(x, 1, LICENSE_CHARS)
    out = None
    for name, p in LICENSE_PATTERNS:
        out = F.when(head.rlike(p), name) if out is None else out.when(head.rlike(p), name)
    return out.otherwise(RESERVED)


def license_of_repository(x: Column) -> Column:
    known = strip(F.lower(x))
    return F.when(known.isin(*REPOSITORY_LICENSES), known).otherwise(RESERVED)


def license_of(body: Column, repository: Column) -> Column:
    """The repository's licence, else the text's. The URL says nothing about it."""
    return F.coalesce(F.nullif(license_of_repository(repository), F.lit(RESERVED)), F.nullif(license_in_text(body), F.lit(RESERVED)), F.lit(RESERVED))


def is_permissive(x: Column) -> Column:
    return F.coalesce(x.isin(*PERMISSIVE), F.lit(False))
