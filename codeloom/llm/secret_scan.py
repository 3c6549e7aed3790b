"""Secret scans by trigram queries, with DataFrame functions alone.

From each rule's regular expression a Boolean query over trigrams (lower case) is derived: every text that matches holds
them. Candidates are the documents whose trigrams meet the query, and only they are verified by the expression. Rules
without a mandatory trigram scan all documents.

The trigrams that some query uses are kept as one bit each beside their document: posting bitmaps laid out by document, not
lists by trigram. Lists would have to be joined back to the texts, which shuffles the whole corpus, and as one base rule
(`hex`) has no mandatory trigram every text is read in any case; so the index saves verification, not reading.

Spans come from the texts between and within matches: their lengths in code points, summed up in blocks, so that the work
grows with the matches.

Base rules: assign, access, hex; further rules find known token forms and private keys. Null texts count as empty; an
empty text has no span. One row per row, repeated rows get equal rows, an empty table gives none; nothing is shuffled.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

try:
    from re import _constants as C
    from re import _parser
except ImportError:  # before Python 3.11
    import sre_constants as C
    import sre_parse as _parser


@dataclass(frozen=True)
class Rule:
    kind: str
    regex: str
    #: Group whose text must have `least` characters (0: the whole match).
    group: int = 0
    least: int = 0


BASE = [
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    # The matches of AKIA[A-Z0-9]+ of 18 characters or more, and the runs of [0-9a-f] of 16 or more: a shorter run holds none.
    Rule("access", r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]{16,}"),
]
MORE = [
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[baprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[sr]k_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
]
RULES = BASE + MORE


# A query is a trigram, ("and", queries), ("or", queries), or None: nothing is mandatory.
def _all(parts):
    parts = list(dict.fromkeys(p for p in parts if p is not None))
    return None if not parts else parts[0] if len(parts) == 1 else ("and", tuple(parts))


def _any(parts):
    parts = list(dict.fromkeys(parts))
    if not parts or None in parts:
        return None
    held = [{p} if isinstance(p, str) else set(p[1]) if p[0] == "and" else None for p in parts]
    # What asks for more than another alternative adds nothing.
    parts = [p for p, own in zip(parts, held) if own is None or not any(o is not None and o < own for o in held)]
    return parts[0] if len(parts) == 1 else ("or", tuple(parts))


def _of_strings(exact: set[str]):
    return _any([_all([s[i : i + 3] for i in range(len(s) - 2)]) for s in sorted(exact)])


def _walk(items) -> tuple[set[str] | None, object]:
    """(the exact strings a sequence can match, if few, else None; its query)."""
    exact, queries = {""}, []

    def close():
        nonlocal exact
        if exact:
            queries.append(_of_strings(exact))
        exact = {""}

    for op, arg in items:
        own, query = None, None
        if op is C.LITERAL:
            own = {chr(arg).lower()}
        elif op is C.IN and len(arg) <= 8 and all(o is C.LITERAL for o, _ in arg):
            own = {chr(a).lower() for _, a in arg}
        elif op is C.SUBPATTERN:
            own, query = _walk(arg[3])
        elif op is C.BRANCH:
            branches = [_walk(b) for b in arg[1]]
            if all(e is not None for e, _ in branches):
                own = set().union(*(e for e, _ in branches))
            else:
                query = _any([q if e is None else _of_strings(e) for e, q in branches])
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
            least, most, inner = arg
            e, q = _walk(inner)
            if e is not None and least == 0 and most == 1:
                own = e | {""}
            elif least > 0:
                query = q if e is None else _of_strings(e)
        elif op is C.AT:
            continue
        if own is not None and len(exact) * len(own) <= 64:
            exact = {a + b for a in exact for b in own}
        else:
            close()
            if own is not None:
                exact = own
            else:
                queries.append(query)
    if not queries:
        return exact, _of_strings(exact)
    close()
    return None, _all(queries)


def trigram_query(regex: str):
    return _walk(_parser.parse(regex))[1]


def trigrams(query) -> set[str]:
    return set() if query is None else {query} if isinstance(query, str) else set().union(*map(trigrams, query[1]))


def postings(df: DataFrame, rules: list[Rule] = RULES, text_col: str = "text", into: str = "__postings") -> tuple[DataFrame, dict[str, int]]:
    """df with the bitmap column `into`, and each trigram's bit. Bits go by 62 into an array of longs."""
    bit = {t: i for i, t in enumerate(sorted(set().union(*[trigrams(trigram_query(r.regex)) for r in rules])))}
    low = df.withColumn("__low", F.lower(F.coalesce(F.col(text_col), F.lit(""))))
    names = sorted(bit, key=bit.get)
    words = [reduce(lambda a, b: a.bitwiseOR(b), [F.when(F.col("__low").contains(t), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")) for i, t in enumerate(names[at : at + 62])]) for at in range(0, len(names), 62)]
    return low.withColumn(into, F.array(*words) if words else F.array().cast("array<long>")).drop("__low"), bit


def candidate(query, bit: dict[str, int], column: str = "__postings") -> Column:
    if query is None:
        return F.lit(True)
    if isinstance(query, str):
        return F.get(F.col(column), F.lit(bit[query] // 62)).bitwiseAND(F.lit(1 << bit[query] % 62).cast("long")) != 0
    parts = [candidate(q, bit, column) for q in query[1]]
    return reduce(lambda a, b: a & b, parts) if query[0] == "and" else reduce(lambda a, b: a | b, parts)


#: Matches are folded in blocks of so many, for a fold copies its array at every step.
FOLD = 256
SPANS = "array<struct<start:int,order:int,kind:string,end:int>>"


def let(value: Column, body) -> Column:
    """body(value), where value is evaluated once however often the body, or a lambda in it, names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def blocks_of(items: Column) -> Column:
    last = F.floor((F.size(items) - 1) / FOLD).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(items, b * FOLD + 1, F.lit(FOLD)))


def running(values: Column, combine) -> Column:
    """For each of an array of int what the ones before it combine to, from 0."""
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("out"))
    return F.aggregate(values, start, lambda acc, x: F.struct(combine(acc["at"], x).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out")), lambda acc: acc["out"])


def spans(text: Column, rule: Rule, order: int) -> Column:
    """array of (start, order, kind, end) of the rule's matches, leftmost first, those that fail `least` left out."""
    regex = F.lit(rule.regex)
    gaps = F.transform(F.split(text, rule.regex, -1), lambda x: F.length(x))
    whole = F.transform(F.regexp_extract_all(text, regex, F.lit(0)), lambda x: F.length(x))
    held = F.transform(F.regexp_extract_all(text, regex, F.lit(rule.group)), lambda x: F.length(x)) if rule.group else whole
    empty = F.expr(f"cast(array() as {SPANS})")

    def step(acc: Column, s: Column) -> Column:
        start, end = acc["at"] + s["gap"], acc["at"] + s["gap"] + s["whole"]
        found = F.struct(start.alias("start"), F.lit(order).alias("order"), F.lit(rule.kind).alias("kind"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(s["held"] >= rule.least, F.array_append(acc["found"], found)).otherwise(acc["found"]).alias("found"))

    def folded(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda n, s: n + s["gap"] + s["whole"]))
        both = F.arrays_zip(blocks.alias("steps"), running(totals, lambda n, x: n + x).alias("at"))
        return F.flatten(F.transform(both, lambda b: F.aggregate(b["steps"], F.struct(b["at"].alias("at"), empty.alias("found")), step, lambda acc: acc["found"])))

    steps = let(whole, lambda w: F.arrays_zip(F.slice(gaps, F.lit(1), F.size(w)).alias("gap"), w.alias("whole"), (held if rule.group else w).alias("held")))
    return let(steps, lambda s: F.when(F.size(s) > 0, let(blocks_of(s), folded)).otherwise(empty))


def with_spans(df: DataFrame, rules: list[Rule] = RULES, text_col: str = "text", into: str = "__spans") -> DataFrame:
    """df with the column `into`: array of (start, order, kind, end) of all rules, sorted."""
    indexed, bit = postings(df, rules, text_col)
    text = F.coalesce(F.col(text_col), F.lit(""))
    empty = F.expr(f"cast(array() as {SPANS})")
    # rlike stops at the first match; only texts that have one are cut into spans.
    found = [F.when(candidate(trigram_query(r.regex), bit) & text.rlike(r.regex), spans(text, r, i)).otherwise(empty) for i, r in enumerate(rules)]
    return indexed.withColumn(into, F.array_sort(F.flatten(F.array(*found)))).drop("__postings")


def joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_assign, n_access, n_hex, base_spans, spans (kind:start:end, code points, comma-joined)."""
    found = with_spans(df.select(id_col, text_col), RULES, text_col)
    count = lambda i: F.size(F.filter("__spans", lambda s: s["order"] == i)).cast("long")
    base = F.filter("__spans", lambda s: s["order"] < len(BASE))
    return found.select(id_col, *[count(i).alias(f"n_{r.kind}") for i, r in enumerate(BASE)], joined(base).alias("base_spans"), joined(F.col("__spans")).alias("spans"))


def redacted(df: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """df with every span of the text replaced by the mark (spans that overlap by one mark). Texts without any stay as they are."""
    found = with_spans(df, RULES, text_col)
    text, found_spans = F.col(text_col), F.col("__spans")

    def piece(lo: Column, block: Column) -> Column:
        """The text from lo to the end of the block's spans, marks in place; places within this section alone are counted."""
        section = F.substring(text, lo + 1, F.greatest(lo, F.array_max(F.transform(block, lambda s: s["end"]))) - lo)

        def step(own: Column, acc: Column, s: Column) -> Column:
            fresh = F.concat(acc["out"], F.substring(own, acc["at"] - lo + 1, s["start"] - acc["at"]), F.lit(mark))
            return F.when(s["end"] <= acc["at"], acc).otherwise(F.struct(s["end"].alias("at"), F.when(s["start"] < acc["at"], acc["out"]).otherwise(fresh).alias("out")))

        return let(section, lambda own: F.aggregate(block, F.struct(lo.alias("at"), F.lit("").alias("out")), lambda acc, s: step(own, acc, s), lambda acc: acc["out"]))

    def cut(blocks: Column) -> Column:
        ends = F.transform(blocks, lambda b: F.array_max(F.transform(b, lambda s: s["end"])))
        both = F.arrays_zip(blocks.alias("spans"), running(ends, lambda n, x: F.greatest(n, x)).alias("lo"))
        return F.array_join(F.transform(both, lambda b: piece(b["lo"], b["spans"])), "")

    last = F.array_max(F.transform(found_spans, lambda s: s["end"]))
    whole = F.concat(let(blocks_of(found_spans), cut), F.substring(text, last + 1, F.length(text)))
    return found.withColumn(text_col, F.when(F.size(found_spans) > 0, whole).otherwise(text)).drop("__spans")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans")
