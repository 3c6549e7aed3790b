"""Column functions the operators share; all run in the JVM."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}]+"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def token_estimate(text: Column) -> Column:
    """A quarter of the UTF-8 bytes."""
    return (F.octet_length(text) / 4).cast("int")


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is 0."""
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    dot = total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))
    norm = lambda v: F.sqrt(total(F.transform(v, lambda x: x.cast("double") * x.cast("double"))))
    return F.when((norm(a) == 0) | (norm(b) == 0), 0.0).otherwise(dot / (norm(a) * norm(b)))


def vector_fault(v: Column, dims: int) -> Column:
    """null for a sound vector; NaN and infinity are found before zero."""
    return (
        F.when(v.isNull() | (F.size(v) == 0), "empty")
        .when(F.size(v) != dims, "dimension")
        .when(F.exists(v, lambda x: F.isnan(x)), "nan")
        .when(F.exists(v, lambda x: F.abs(x) == float("inf")), "inf")
        .when(F.forall(v, lambda x: x == 0), "zero")
    )


def glob_regex(pattern: str) -> str:
    """Anchored regular expression of a shell pattern over one path component (* and ? don't cross a slash)."""
    out = "".join("[^/]*" if c == "*" else "[^/]" if c == "?" else re.escape(c) for c in pattern)
    return f"^{out}$"


def is_test(path: Column, patterns: list[str]) -> Column:
    """A pattern that ends in / names a directory anywhere in the path; any other is a glob over the last component."""
    name = F.substring_index(path, "/", -1)
    hits = [path.rlike(f"(^|/){re.escape(p[:-1])}/") if p.endswith("/") else name.rlike(glob_regex(p)) for p in patterns]
    return reduce(lambda a, b: a | b, hits, F.lit(False))


def sanitize_query(text: str) -> list[str]:
    """Words of a query without operators; an empty list finds nothing."""
    words = (re.sub(r'["*+\-^]', "", w) for w in text.split())
    return [w for w in words if w]


def keyword_norm(rank: Column) -> Column:
    """Ranks are negative, lower is better: 0 for 0 and above, else -rank / 50, at most 1."""
    return F.when(rank >= 0, 0.0).otherwise(F.least(-rank / 50, F.lit(1.0)))


def decay_change(hours: Column, lines: Column) -> Column:
    return F.exp(-0.05 * hours) * F.least(lines / 50, F.lit(1.0))


def session_value(minutes: Column, count: Column, since: Column) -> Column:
    return F.exp(-0.07 * minutes) * F.least(F.log2(count + 1) / 4, F.lit(1.0)) * F.exp(-0.1 * since)
