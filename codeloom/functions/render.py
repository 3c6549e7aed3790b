"""What results look like to a reader: columns of text, and JSON."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def located() -> Column:
    """A result as its place alone."""
    return F.format_string("%s:%d-%d score:%.2f", "path", "start_line", "end_line", "score")


def block(path_before: Column) -> Column:
    """A result under its path, which is named once for results of one file in a row."""
    head = F.when(path_before.eqNullSafe(F.col("path")), "").otherwise(F.concat("path", F.lit("\n")))
    return F.concat(head, F.format_string("  %d-%d (%d tokens)", "start_line", "end_line", "token_count"))


def packed() -> Column:
    return F.concat(F.format_string("--- %s:%d-%d (%d tokens)\n", "path", "start_line", "end_line", "token_count"), "content")


def symbol() -> Column:
    return F.concat(F.format_string("%s %s  %s:%d", "kind", "name", "path", "line"), F.when(F.col("role") == "referenced_by", " (refers to it)").otherwise(""))


def dependency() -> Column:
    return F.format_string("%s %s  %s:%d", "kind", "name", "path", "line")


def difference() -> Column:
    names = F.when(F.size("affected") > 0, F.concat(F.lit(": "), F.array_join("affected", ", "))).otherwise("")
    return F.concat(F.format_string("%s %s +%d -%d", "change", "path", "lines_added", "lines_removed"), names)


def statistics() -> Column:
    return F.format_string("%d files, %d chunks, %d symbols, %.2f %% embedded, %d files with errors", "files", "chunks", "symbols", "embedded_pct", "parse_errors")


FORMS = {"locate": located, "context": packed, "symbols": symbol, "dependencies": dependency, "diff": difference, "summary": statistics}


def text(df: DataFrame, form: str) -> str:
    """The rows in their order, a line or block each; results are bounded by their query's limit."""
    return "\n".join(r[0] for r in df.select(FORMS[form]()).collect())


def as_json(df: DataFrame) -> str:
    """The rows as a JSON array, columns without a value left out."""
    return json.dumps([json.loads(r[0]) for r in df.select(F.to_json(F.struct("*"))).collect()])
