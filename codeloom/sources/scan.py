"""File sources: the repository scan, ignore patterns, languages by extension."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LANGUAGES = {"ts": "typescript", "tsx": "typescript", "py": "python", "go": "go", "rs": "rust", "java": "java", "sh": "bash", "bash": "bash", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "rb": "ruby", "rake": "ruby", "gemspec": "ruby", "erb": "erb"}
SKIPPED = ["node_modules", "dist", "build", "vendor", "__pycache__"]
MOST_BYTES, SNIFF = 10 * 1024 * 1024, 512


def ignore_regex(pattern: str) -> tuple[str, bool] | None:
    """(regular expression, negated) of an ignore-file line; None for blank lines and comments."""
    p = pattern.rstrip()
    if not p or p.startswith("#"):
        return None
    negated, p = p.startswith("!"), p.lstrip("!")
    directory, p = p.endswith("/"), p.rstrip("/")
    anchored, p = "/" in p, p.lstrip("/")
    out = ""
    for part in re.split(r"(\*\*/|\*\*|\*|\?)", p):
        out += {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(part, re.escape(part))
    # A pattern with a slash counts from the root, unless it only names what lies in some directory of that name.
    head = "^" if anchored and pattern.lstrip("!").startswith("/") else "(?:^|/)"
    return head + out + ("/" if directory else "(?:/|$)"), negated


def ignored(path: Column, patterns: list[str]) -> Column:
    """The last pattern that matches decides."""
    out = F.lit(False)
    for found in filter(None, map(ignore_regex, patterns)):
        out = F.when(path.rlike(found[0]), F.lit(not found[1])).otherwise(out)
    return out


def language(path: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.element_at(table, F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)))


def is_binary(content: Column) -> Column:
    """Whether there's a zero among the first SNIFF bytes."""
    return F.hex(F.substring(content, 1, SNIFF)).rlike("^(?:..)*?00")


def scan(spark: SparkSession, root: str, patterns: list[str] = ()) -> DataFrame:
    """(path, language, size, mtime, content_hash, content): source files below root that aren't hidden, skipped, ignored,
    binary or too large. The glob, the size and the path filters are applied before contents are read."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", GLOB).load(root)
    return sources(raw, root, patterns).drop("ts")


GLOB = "*.{" + ",".join(LANGUAGES) + "}"


def sources(raw: DataFrame, root: str, patterns: list[str] = ()) -> DataFrame:
    """The files of a read or a stream of binary files that count, with the time of their last change as `ts`."""
    base = re.sub(r"^file:/*", "/", root).rstrip("/") + "/"
    path = F.expr(f"substring(regexp_replace(path, '^file:/*', '/'), {len(base) + 1})")
    rows = raw.where(F.col("length") <= MOST_BYTES).withColumn("path", path)
    skip = reduce(lambda a, b: a | b, [F.col("path").rlike(f"(^|/){re.escape(n)}/") for n in SKIPPED], F.col("path").rlike(r"(^|/)\.[^/]"))
    rows = rows.where(~skip & ~ignored(F.col("path"), list(patterns)))
    # Bytes that aren't UTF-8 become replacement characters, so one such file doesn't end the scan.
    text = F.make_valid_utf8(F.col("content").cast("string"))
    rows = rows.where(~is_binary(F.col("content")))
    return rows.select("path", language(F.col("path")).alias("language"), F.col("length").alias("size"), (F.unix_micros("modificationTime") / 1e6).alias("mtime"), F.sha2("content", 256).alias("content_hash"), text.alias("content"), F.col("modificationTime").alias("ts"))
