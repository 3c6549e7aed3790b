"""Lexical parser: files to chunks, symbols and edges.

Python goes through its own syntax tree; other languages through declarations found line by line and the extent of their
braces (or `end` in Ruby). A file that can't be parsed gives one row of tag `error` and nothing else.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_TOKENS, LEAST_TOKENS = 1024, 20
ID = r"[A-Za-z_$][\w$]*"
#: language -> (regular expression with a group `name`, kind of chunk, kind of symbol, whether members are looked for)
DECLARATIONS: dict[str, list[tuple[str, str, str, bool]]] = {
    "go": [(rf"^func\s+\([^)]*\)\s*(?P<name>{ID})", "method", "method", False), (rf"^func\s+(?P<name>{ID})", "function", "function", False), (rf"^type\s+(?P<name>{ID})", "type", "type", False), (rf"^(?:var)\s+(?P<name>{ID})", "block", "variable", False), (rf"^const\s+(?P<name>{ID})", "block", "constant", False)],
    "rust": [(rf"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+|unsafe\s+|const\s+|extern\s+\"[^\"]*\"\s+)*fn\s+(?P<name>{ID})", "function", "function", False), (rf"^\s*macro_rules!\s*(?P<name>{ID})", "function", "function", False), (rf"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:struct|enum|union|type)\s+(?P<name>{ID})", "type", "type", False), (rf"^\s*(?:pub(?:\([^)]*\))?\s+)?trait\s+(?P<name>{ID})", "interface", "interface", True), (rf"^\s*(?:unsafe\s+)?impl(?:<[^>]*>)?\s+(?:[\w:<>, ]+\s+for\s+)?(?P<name>{ID})", "block", "type", True), (rf"^\s*(?:pub(?:\([^)]*\))?\s+)?mod\s+(?P<name>{ID})\s*\{{", "block", "namespace", True), (rf"^\s*(?:pub\s+)?(?:const|static)\s+(?:mut\s+)?(?P<name>{ID})", "block", "variable", False)],
    "java": [(rf"^\s*(?:(?:public|protected|private|abstract|final|static|sealed)\s+)*(?:class|record)\s+(?P<name>{ID})", "class", "class", True), (rf"^\s*(?:(?:public|protected|private|static)\s+)*interface\s+(?P<name>{ID})", "interface", "interface", True), (rf"^\s*(?:(?:public|protected|private|static)\s+)*(?:enum|@interface)\s+(?P<name>{ID})", "type", "type", False), (rf"^\s+(?:(?:public|protected|private|static|final|abstract|default|synchronized)\s+)*(?:<[^>]*>\s*)?[\w<>\[\], ?.]*?(?P<name>{ID})\s*\([^;=]*\)\s*(?:throws [\w, .]+)?\s*[{{;]", "method", "method", False), (rf"^\s+(?:(?:public|protected|private)\s+)?static\s+final\s+[\w<>\[\], ?.]+\s+(?P<name>{ID})\s*=", "block", "constant", False), (rf"^\s+(?:(?:public|protected|private|final|static)\s+)+[\w<>\[\], ?.]+\s+(?P<name>{ID})\s*[=;]", "block", "variable", False)],
    "ruby": [(r"^\s*def\s+(?:self\.)?(?P<name>[\w?!=]+)", "function", "method", False), (rf"^\s*class\s+(?:<<\s*)?(?P<name>{ID})", "class", "class", True), (rf"^\s*module\s+(?P<name>{ID})", "class", "class", True)],
    "bash": [(r"^(?:function\s+)?(?P<name>[\w-]+)\s*\(\)\s*\{", "function", "function", False), (r"^function\s+(?P<name>[\w-]+)\s*\{", "function", "function", False)],
    "erb": [(r"(?P<name><%=?)", "block", "", False)],
}
DECLARATIONS["typescript"] = [
    (rf"^\s*(?:export\s+)?(?:default\s+)?(?:declare\s+)?(?:async\s+)?function\s*\*?\s*(?P<name>{ID})", "function", "function", False),
    (rf"^\s*(?:export\s+)?(?:default\s+)?(?:declare\s+)?(?:abstract\s+)?class\s+(?P<name>{ID})", "class", "class", True),
    (rf"^\s*(?:export\s+)?(?:declare\s+)?interface\s+(?P<name>{ID})", "interface", "interface", True),
    (rf"^\s*(?:export\s+)?(?:declare\s+)?(?:const\s+)?enum\s+(?P<name>{ID})", "type", "type", False),
    (rf"^\s*(?:export\s+)?(?:declare\s+)?type\s+(?P<name>{ID})\s*[=<]", "type", "type", False),
    (rf"^\s*(?:export\s+)?(?:declare\s+)?(?:namespace|module)\s+(?P<name>{ID})", "block", "namespace", True),
    (rf"^(?:export\s+)?const\s+(?P<name>{ID})", "block", "constant", False),
    (rf"^(?:export\s+)?(?:let|var)\s+(?P<name>{ID})", "block", "variable", False),
    (rf"^\s+(?:(?:public|private|protected|static|async|readonly|get|set|override)\s+)*(?P<name>(?!if\b|for\b|while\b|switch\b|catch\b|return\b){ID})\s*(?:<[^>]*>)?\([^;]*\)[^;=]*\{{", "method", "method", False),
]
DECLARATIONS["javascript"] = DECLARATIONS["typescript"]
IMPORTS = {
    "go": r'^\s*(?:import\s+)?(?:\w+\s+)?"(?P<path>[\w./-]+)"\s*$', "rust": r"^\s*(?:pub\s+)?use\s+(?P<path>[^;]+);", "java": r"^\s*import\s+(?:static\s+)?(?P<path>[\w.]+)\s*;",
    "typescript": r"^\s*import\s+(?P<names>.+?)\s+from\s+['\"](?P<path>[^'\"]+)['\"]", "javascript": r"^\s*import\s+(?P<names>.+?)\s+from\s+['\"](?P<path>[^'\"]+)['\"]",
}
COMMENTS = {"python": r"^\s*#", "ruby": r"^\s*#", "bash": r"^\s*#"}
WORDS = {"if", "for", "while", "switch", "catch", "return", "function", "func", "fn", "new", "await", "defer", "go", "match", "super", "elif", "except", "print", "sizeof", "typeof", "and", "or", "not", "in", "with", "assert", "def", "class"}
CALL = re.compile(rf"(?P<name>(?:{ID}(?:\.|::))*{ID})\s*\(")


def tokens(text: str) -> int:
    return len(text.encode()) // 4


def _extent(lines: list[str], start: int, language: str) -> int:
    """Last line of the declaration that begins at a line."""
    if language == "ruby":
        indent = len(lines[start]) - len(lines[start].lstrip())
        for i in range(start + 1, len(lines)):
            if re.match(rf"^\s{{{indent}}}end\b", lines[i]):
                return i
        return start
    depth, opened = 0, False
    for i in range(start, len(lines)):
        code = re.sub(r"\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'|`[^`]*`|//.*$", "", lines[i])
        for c in code:
            if c in "{(":
                depth, opened = depth + 1, opened or c == "{"
            elif c in "})":
                depth -= 1
        if depth <= 0 and (opened or code.rstrip().endswith(";") or i + 1 == len(lines) or not code.rstrip().endswith(("(", ",", "=", "{")) and not (i + 1 < len(lines) and lines[i + 1].lstrip().startswith("{"))):
            return i
    return len(lines) - 1


def _visible(language: str, name: str, line: str) -> tuple[str, bool]:
    if language == "go":
        out = name[:1].isupper()
    elif language in ("typescript", "javascript"):
        out = bool(re.match(r"^\s*export\b", line))
    elif language == "rust":
        out = bool(re.match(r"^\s*pub\b", line))
    elif language == "java":
        word = next((w for w in ("public", "private", "protected") if re.search(rf"\b{w}\b", line)), "")
        return {"public": "public", "private": "private"}.get(word, "internal"), word == "public"
    else:
        out = not name.startswith("_")
    return ("exported" if out else "internal"), out


def _python(text: str) -> Iterator[tuple]:
    """(name, chunk kind, symbol kind, first line, last line, parent) from the syntax tree."""

    def walk(body, parent):
        for node in body:
            if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                kind = "class" if isinstance(node, ast.ClassDef) else "method" if parent else "function"
                first = min([node.lineno, *(x.lineno for x in node.decorator_list)])
                yield node.name, kind, "class" if kind == "class" else "function", first, node.end_lineno, parent
                if kind == "class":
                    yield from walk(node.body, node.name)
            elif isinstance(node, getattr(ast, "TypeAlias", ())):
                yield node.name.id, "type", "type", node.lineno, node.end_lineno, parent

    yield from walk(ast.parse(text).body, "")


def _further(line: str, language: str) -> list[str]:
    """Names that a declaration of several variables declares after the first one."""
    if language == "go":
        m = re.match(rf"^(?:var|const)\s+{ID}((?:\s*,\s*{ID})+)", line)
        return re.findall(ID, m[1]) if m else []
    line, before = re.sub(r"\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'|`[^`]*`|//.*$", "", line), None
    while line != before:  # commas within brackets part no declarations
        line, before = re.sub(r"\([^()]*\)|\[[^\[\]]*\]|\{[^{}]*\}|<[^<>]*>", "", line), line
    return re.findall(rf",\s*({ID})\s*(?=[=:,;]|$)", line) if "(" not in line else []


def _grouped(lines: list[str], first: int, language: str) -> tuple[int, list[tuple]] | None:
    """Go's `var (...)`, `const (...)`, `type (...)`: the last line and (name, kind of symbol, line) of what it declares."""
    m = re.match(r"^(var|const|type)\s*\(\s*$", lines[first]) if language == "go" else None
    if not m:
        return None
    symbol = {"var": "variable", "const": "constant", "type": "type"}[m[1]]
    last = next((i for i in range(first + 1, len(lines)) if lines[i].startswith(")")), len(lines) - 1)
    names = [(name, symbol, i) for i in range(first + 1, last) if (d := re.match(rf"^\t?\s*({ID}(?:\s*,\s*{ID})*)", lines[i])) and len(lines[i]) - len(lines[i].lstrip()) <= 4 for name in re.split(r"\s*,\s*", d[1])]
    return last, names


def _found(text: str, language: str) -> list[tuple]:
    if language == "python":
        return list(_python(text))
    lines, out = text.split("\n"), []

    def walk(first: int, last: int, parent: str):
        i = first
        while i <= last:
            if (group := _grouped(lines, i, language)) and group[1]:
                end, names = group
                out.append((names[0][0], "type" if names[0][1] == "type" else "block", names[0][1], i + 1, end + 1, parent))
                out.extend((name, "", symbol, at + 1, at + 1, parent) for name, symbol, at in names[1:])
                i = end + 1
                continue
            hit = next(((m, d) for d in DECLARATIONS.get(language, []) if (m := re.match(d[0], lines[i]))), None)
            if hit is None:
                i += 1
                continue
            (m, (_, kind, symbol, members)), end = hit, min(last, _extent(lines, i, language))
            out.append((m["name"], kind, symbol, i + 1, end + 1, parent))
            if symbol in ("variable", "constant") and language in ("go", "typescript", "javascript", "java"):
                out.extend((name, "", symbol, i + 1, i + 1, parent) for name in _further(lines[i], language))
            if members:
                walk(i + 1, end, m["name"])
            i = end + 1

    walk(0, len(lines) - 1, "")
    return out


def _imports(text: str, language: str) -> Iterator[tuple[str, str]]:
    """(short name, qualified name)."""
    if language == "python":
        for node in ast.walk(ast.parse(text)):
            if isinstance(node, ast.Import):
                yield from ((a.name, a.name) for a in node.names)
            elif isinstance(node, ast.ImportFrom):
                yield from ((a.name, f"{node.module or ''}.{a.name}") for a in node.names if a.name != "*")
        return
    for m in re.finditer(IMPORTS[language], text, re.M) if language in IMPORTS else ():
        path = m["path"].strip()
        if language == "go":
            yield path.rsplit("/", 1)[-1], path
        elif language == "java":
            yield path.rsplit(".", 1)[-1], path
        elif language == "rust":
            head, _, braces = path.partition("{")
            for part in braces.rstrip("}").split(",") if braces else [path]:
                name = part.strip().split(" as ")[-1].rsplit("::", 1)[-1]
                if name and name != "*":
                    yield name, (head + part.strip()) if braces else path
        else:
            for name in re.findall(r"[\w$]+(?:\s+as\s+[\w$]+)?", m["names"].replace("type ", "")):
                last = name.split(" as ")[-1].strip()
                yield last, path if "*" in m["names"] else f"{path}/{name.split(' ')[0]}"


def _split(kind: str, name: str, signature: str, parent: str, first: int, content: str) -> Iterator[dict]:
    """Pieces of under MOST_TOKENS, cut at lines."""
    held, start, cost, lines = [], first, 0, content.split("\n")
    for i, line in enumerate(lines):
        own = tokens(line) + (i + 1 < len(lines))
        if held and cost + own >= MOST_TOKENS:
            yield {"kind": kind, "name": name, "signature": signature, "parent": parent, "start_line": start, "end_line": first + i - 1, "content": "\n".join(held)}
            held, start, cost = [], first + i, 0
        held.append(line)
        cost += own
    yield {"kind": kind, "name": name, "signature": signature, "parent": parent, "start_line": start, "end_line": first + len(lines) - 1, "content": "\n".join(held)}


def parse(path: str, text: str, language: str) -> Iterator[dict]:
    """Rows of tag chunk, symbol, edge, or one of tag error."""
    try:
        found = _found(text, language)
        imports = list(dict.fromkeys(_imports(text, language)))
    except (SyntaxError, ValueError, RecursionError) as e:
        yield {"tag": "error", "path": path, "content": str(e)}
        return
    lines = text.split("\n")
    comment = re.compile(COMMENTS.get(language, r"^\s*(//|/\*|\*)"))
    taken = {i for _, _, _, a, b, _ in found for i in range(a, b + 1)}
    header = [(i, x) for i, x in enumerate(lines, 1) if i not in taken and x.strip() and not comment.match(x)]
    chunks: list[dict] = []
    if header:
        chunks.append({"kind": "header", "name": None, "signature": None, "parent": None, "start_line": header[0][0], "end_line": header[-1][0], "content": "\n".join(x for _, x in header)})
    for name, kind, symbol, a, b, parent in found:
        if not kind:  # declared beside another, whose chunk holds it
            continue
        body, signature = "\n".join(lines[a - 1 : b]), lines[a - 1].strip()
        inner = [f for f in found if f[1] and f[5] == name and a < f[3] <= b]
        if inner and tokens(body) > MOST_TOKENS:  # members are chunks of their own; what stays is the outline
            within = {i for f in inner for i in range(f[3], f[4] + 1)}
            body = "\n".join([x for i, x in enumerate(lines[a - 1 : b], a) if i not in within] + [lines[f[3] - 1] for f in inner])
            chunks.append({"kind": kind, "name": name, "signature": signature, "parent": parent or None, "start_line": a, "end_line": b, "content": body})
        elif not parent or tokens("\n".join(lines)) > MOST_TOKENS or kind in ("method", "function"):
            pieces = list(_split(kind, name, signature, parent or None, a, body))
            small = len(pieces) == 1 and tokens(body) < LEAST_TOKENS and chunks and chunks[-1]["kind"] != "header"
            if small:
                chunks[-1]["content"] += "\n\n" + body
                chunks[-1]["end_line"] = max(b, chunks[-1]["end_line"])
            else:
                chunks += pieces
    for i, c in enumerate(chunks):
        yield {"tag": "chunk", "path": path, "chunk_index": i, "token_count": tokens(c["content"]), **c}
    owners = []
    for name, _, symbol, a, b, parent in found:
        if symbol:
            visibility, exported = _visible(language, name, lines[a - 1])
            kind = "method" if symbol == "function" and parent and language == "python" else symbol
            owners.append((a, b, name))
            yield {"tag": "symbol", "path": path, "name": name, "kind": kind, "start_line": a, "end_line": b, "signature": lines[a - 1].strip(), "parent": parent or None, "visibility": visibility, "exported": exported}
    if not owners:
        return
    edges = {(owners[0][2], short, qualified, "imports") for short, qualified in imports}
    for i, line in enumerate(lines, 1):
        owner = max((o for o in owners if o[0] <= i <= o[1]), default=None)
        if owner is None or comment.match(line):
            continue
        for m in CALL.finditer(line):
            last = re.split(r"\.|::", m["name"])[-1]
            if last not in WORDS and last != owner[2] and not (i == owner[0] and last == owner[2]):
                edges.add((owner[2], m["name"], m["name"], "calls"))
        # The line of the name may follow decorators.
        if (m := re.match(r"\s*class\s+(\w+)\s*(?:\(([^)=]*)\)|<\s*([\w:]+))", line)) and m[1] == owner[2]:
            edges |= {(owner[2], x.strip(), x.strip(), "inherits") for x in (m[2] or m[3] or "").split(",") if x.strip()}
        if i == owner[0]:
            if m := re.search(r"\bextends\s+([\w.]+)", line):
                edges.add((owner[2], m[1], m[1], "inherits"))
            if m := re.search(r"\bimplements\s+([\w., ]+)", line):
                edges |= {(owner[2], x.strip(), x.strip(), "implements") for x in m[1].split(",") if x.strip()}
            if m := re.match(rf"\s*impl(?:<[^>]*>)?\s+([\w:]+).*\s+for\s+({ID})", line):
                edges.add((m[2], m[1], m[1], "implements"))
    for src, dst, qualified, kind in sorted(edges):
        yield {"tag": "edge", "path": path, "name": src, "target": dst, "qualified": qualified, "kind": kind}


COLUMNS = {"tag": "string", "path": "string", "chunk_index": "int", "kind": "string", "name": "string", "signature": "string", "parent": "string", "start_line": "int", "end_line": "int", "token_count": "int", "content": "string", "visibility": "string", "exported": "boolean", "target": "string", "qualified": "string"}


def parse_files(files: DataFrame) -> DataFrame:
    """files(path, content, language) -> tagged rows; callers take what they need by tag."""

    def run(frames):
        for frame in frames:
            rows = [r for p, t, lang in zip(frame.path, frame.content, frame.language) for r in parse(p, t or "", lang or "")]
            out = pd.DataFrame(rows, columns=list(COLUMNS))
            for c, kind in COLUMNS.items():
                out[c] = out[c].astype({"int": "Int32", "boolean": "boolean"}.get(kind, "object"))
            yield out.where(out.notna(), None)

    return files.select("path", "content", "language").mapInPandas(run, ", ".join(f"{c} {k}" for c, k in COLUMNS.items()))


def tagged(rows: DataFrame, tag: str) -> DataFrame:
    return rows.where(F.col("tag") == tag).drop("tag")
