"""Single operators: ranking, packing, folds, graph, store, parser, API, streams; odd cases by name."""

import json
import os

import pytest
from pyspark.sql import functions as F

from codeloom import config, schemas
from codeloom.api import Engine, duration
from codeloom.functions import embed, render
from codeloom.functions import scalar as fn
from codeloom.functions.embed import hashing
from codeloom.operators import assemble, graph, rank, store, temporal, text, vector
from codeloom.sources import parse, scan
from codeloom.streaming import streams


def test_weights_keep_their_ratios_and_sum_to_one():
    for semantic in (True, False):
        for session in (True, False):
            w = rank.weights(semantic, session)
            assert abs(sum(w.values()) - 1) < 1e-9 and abs(w["structural"] / w["change"] - 0.2 / 0.15) < 1e-9
    assert round(rank.weights(semantic=False)["structural"], 4) == 0.3333


@pytest.mark.parametrize("chunks,vectors,ready,want", [(0, 0, True, "filesystem"), (10, 9, False, "keyword"), (10, 0, True, "keyword"), (10, 8, True, "hybrid"), (10, 2, True, "mixed"), (10, 1, True, "keyword")])
def test_level(chunks, vectors, ready, want):
    assert rank.level(chunks, vectors, ready) == want


def test_keyword_norm(spark):
    got = spark.createDataFrame([(0.0,), (5.0,), (-25.0,), (-100.0,)], "r double").select(fn.keyword_norm(F.col("r"))).collect()
    assert [r[0] for r in got] == [0.0, 0.0, 0.5, 1.0]


def test_sanitize_query():
    assert fn.sanitize_query('foo* "bar" -baz ^ + qu+x') == ["foo", "bar", "baz", "qux"]
    assert fn.sanitize_query(' "* ') == []


def test_bm25_matches_any_word_and_nothing_without_words(spark):
    df = spark.createDataFrame([(1, "validateToken checks"), (2, "token here token"), (3, "nothing"), (4, None)], "doc_id long, text string")
    assert [r[0] for r in text.top_keyword(df, "token absent", 5).collect()] == [2]  # identifiers aren't split
    assert text.bm25(df, "* -").count() == 0
    assert all(r[1] < 0 for r in text.bm25(df, "token nothing").collect())


def test_phrase_counts_overlaps(spark):
    df = spark.createDataFrame([(1, "a a a b"), (2, "A, b"), (3, "ab")], "doc_id long, text string")
    assert {r[0]: r[1] for r in text.phrase(df, ["a", "a"]).collect()} == {1: 2}
    assert {r[0]: r[1] for r in text.phrase(df, ["a", "b"]).collect()} == {1: 1, 2: 1}


def test_vector_order_and_faults(spark):
    rows = [(1, [1.0, 0.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.0, 0.0]), (3, [0.9, 0.1, 0.0, 0.0]), (4, [0.0] * 4), (5, [float("nan")] + [0.0] * 3), (6, [1.0]), (7, []), (8, None), (9, [float("inf")] + [0.0] * 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert [r[0] for r in vector.top_k(df, [1.0, 0, 0, 0], 5).collect()] == [1, 3, 2]
    assert {r[0]: r[1] for r in vector.health(df, 4).collect()} == {"ok": 3, "zero": 1, "nan": 1, "dimension": 1, "empty": 2, "inf": 1}


def test_neighbours(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4)], "src long, dst long")
    one = spark.createDataFrame([(1,)], "seed long")
    get = lambda *a: sorted(r["node"] for r in graph.neighbours(e, one, *a).collect())
    assert get(1, "outgoing") == [2] and get(2, "outgoing") == [2, 3]
    assert get(3, "outgoing") == [1, 2, 3, 4]  # the cycle reaches the seed
    assert get(1, "incoming") == [3] and get(0, "outgoing") == [2] and get(99, "outgoing") == [1, 2, 3, 4]
    with pytest.raises(ValueError):
        graph.neighbours(e, one, 1, "sideways")


def test_resolution_never_crosses_languages(spark):
    sy = spark.createDataFrame([(1, "foo", 1, "go"), (2, "foo", 2, "py"), (3, "bar", 1, "go")], "symbol_id long, name string, file long, language string")
    e = spark.createDataFrame([(3, "foo", "calls", 1, "go"), (9, "foo", "calls", 7, "py"), (9, "bar", "calls", 7, "py"), (9, "bar", "imports", 7, ""), (9, "none", "calls", 7, "go")], "src long, dst_name string, kind string, file long, language string")
    resolved, pending = graph.resolve(e, sy)
    assert sorted(map(tuple, resolved.collect())) == [(3, 1, "calls"), (9, 2, "calls"), (9, 3, "imports")]
    assert sorted((r["dst_name"], r["language"]) for r in pending.collect()) == [("bar", "py"), ("none", "go")]


def test_structural_pair(spark):
    c = spark.createDataFrame([(10, 1), (20, 2), (30, 3)], "chunk_id long, symbol_id long")
    e = spark.createDataFrame([(1, 2)], "src long, dst long")
    assert {r[0]: r[2] for r in graph.structural_score(c.select("chunk_id"), c, e).collect()} == {10: 0.5, 20: 0.5}


def pack(spark, rows, budget):
    return [tuple(r)[1:] for r in assemble.pack_budget(spark.createDataFrame(rows, "id long, path string, start_line int, end_line int, token_count int, score double"), budget).orderBy("position").collect()]


def test_packing(spark):
    assert pack(spark, [(1, "a", 1, 10, 500, 0.9)], 300) == [(1, 300)]  # the first is cut
    assert pack(spark, [(1, "a", 1, 10, 200, 0.9), (2, "b", 1, 10, 200, 0.8), (3, "c", 1, 10, 10, 0.7)], 300) == [(1, 200), (2, 200)]  # a later one isn't, and ends it
    assert pack(spark, [(1, "a", 1, 10, 20, 0.9), (2, "a", 5, 14, 20, 0.8), (3, "a", 6, 15, 20, 0.7)], 300) == [(1, 20), (3, 20)]  # 60 % is too much, 50 % isn't


def test_chunk_folds(spark):
    df = spark.createDataFrame([(1, "\n".join(["x" * 40] * 10)), (2, ""), (3, None)], "doc_id long, text string")
    parts = assemble.split_lines(df, 32).where("doc_id = 1").orderBy("chunk_index").collect()
    assert [(p["start_line"], p["end_line"]) for p in parts] == [(1, 2), (3, 4), (5, 6), (7, 8), (9, 10)]
    assert assemble.split_lines(df, 32).where("doc_id <> 1").count() == 2
    chunks = spark.sql("select array(named_struct('kind','header','token_count',3,'end_line',1), named_struct('kind','block','token_count',5,'end_line',2), named_struct('kind','block','token_count',50,'end_line',9)) c")
    assert [(x["token_count"], x["end_line"]) for x in chunks.select(assemble.merge_small(F.col("c")).alias("m")).first()["m"]] == [(8, 2), (50, 9)]
    cut = spark.createDataFrame([("a" * 4000 + "\nb",)], "t string").select(assemble.truncate(F.col("t"), 10).alias("c")).first()["c"]
    assert cut["lines"] == 1  # the first line always stays


def test_siblings(spark):
    rows = [(1, "f", i, 10 + 40 * i, 49 + 40 * i, 500, f"p{i}", 0.1 * i) for i in range(3)]
    df = spark.createDataFrame(rows, "file long, name string, chunk_index int, start_line int, end_line int, token_count int, content string, score double")
    r = assemble.merge_siblings(df, ["file", "name"]).first()
    assert (r["start_line"], r["end_line"], r["token_count"], r["content"]) == (10, 129, 1500, "p0\np1\np2") and abs(r["score"] - 0.2) < 1e-9


def test_symbol_diff(spark):
    old = spark.createDataFrame([("a", "s", 1), ("b", "s", 2), ("c", "s", 3), ("d", "s", 4)], "name string, signature string, line int")
    new = spark.createDataFrame([("a", "s", 1), ("b", "t", 2), ("c", "s", 9), ("e", "s", 4)], "name string, signature string, line int")
    assert {r[0]: r[1] for r in temporal.symbol_diff(old, new).collect()} == {"b": "signature_changed", "c": "modified", "d": "removed", "e": "added"}


def test_breaker_doubles_at_the_first_opening(spark):
    log = [(0.0, False), (1.0, False), (2.0, False), (11.0, True), (12.5, False), (20.0, True), (33.0, True)]
    df = spark.createDataFrame([(log,)], "log array<struct<minute:double,ok:boolean>>")
    assert df.select(temporal.breaker(F.col("log")).alias("s")).first()["s"] == ["closed", "closed", "open", "open", "open", "open", "closed"]


def test_metrics(spark):
    results = spark.createDataFrame([("q", 1, "x"), ("q", 2, "a"), ("q", 3, "a")], "query string, rank int, item string")
    expected = spark.createDataFrame([("q", "a"), ("p", "z")], "query string, item string")
    got = {r["query"]: (r["recall"], r["precision"], r["rr"]) for r in rank.metrics(results, expected, 10).collect()}
    assert got == {"q": (1.0, round(2 / 3, 6), 0.5), "p": (0.0, 0.0, 0.0)}  # results count, and recall is 1 at most


def test_store(spark, tmp_path):
    s = store.Store(spark, str(tmp_path))
    a = spark.createDataFrame([("p", "h1"), ("q", "h2")], "path string, content_hash string")
    s.commit({"files": a})
    b = store.upsert(s.read("files"), spark.createDataFrame([("q", "h3"), ("r", "h4")], a.schema), ["path"])
    s.commit({"files": b})
    assert {r[0]: r[1] for r in s.read("files").collect()} == {"p": "h1", "q": "h3", "r": "h4"} and s.pointer["serial"] == 2
    assert [r["path"] for r in store.changed(b, a, "path").orderBy("path").collect()] == ["q", "r"]
    s.purge()
    assert s.read("files") is None


def test_status(spark):
    c = spark.createDataFrame([(1, 10, False), (1, 11, False), (2, 20, True), (2, 21, False)], "file_id long, chunk_id long, embedded boolean")
    done = spark.createDataFrame([(10,), (11,), (11,)], "chunk_id long")
    got = lambda df: {r[0]: r["embedding_status"] for r in store.embedding_status(df).collect()}
    assert got(c) == {1: "pending", 2: "partial"} and got(store.mark_embedded(c, done)) == {1: "complete", 2: "partial"}


def test_schemas(spark):
    df = spark.createDataFrame([(1, 2, 3, "calls", None), (2, 2, 3, "renames", None)], schemas.TABLES["edges"])
    assert schemas.violations(df, "edges").count() == 1


def test_config(tmp_path):
    p = tmp_path / "c.toml"
    p.write_text("max_results = 20\nmin_score = 0.3\nunknown = 1\n")
    c = config.load(str(p), {"CODELOOM_MIN_SCORE": "0.5"}, token_budget=512)
    assert (c.max_results, c.min_score, c.token_budget) == (20, 0.5, 512)
    with pytest.raises(ValueError):
        config.load(None, {}, max_results=201)
    assert duration("1h30m").total_seconds() == 5400 and duration("9000h").total_seconds() == 720 * 3600
    with pytest.raises(ValueError):
        duration("2d")


def test_paths(spark):
    df = spark.createDataFrame([("src/a_test.go",), ("tests/x.py",), ("a/tests/b.py",), ("src/tests.py",), ("src/a.go",)], "p string")
    assert [r[0] for r in df.select(fn.is_test(F.col("p"), ["*_test.go", "tests/"])).collect()] == [True, True, True, False, False]
    got = spark.createDataFrame([("a/x.log",), ("keep.log",), ("out/b.py",), ("a/out.py",)], "p string").select(scan.ignored(F.col("p"), ["# c", "*.log", "!keep.log", "out/"])).collect()
    assert [r[0] for r in got] == [True, False, True, False]


SOURCES = {
    "go": ("package p\nimport \"fmt\"\n\ntype S struct {\n  x int\n}\n\nfunc (s *S) Run(n int) {\n  fmt.Println(n)\n  help()\n}\n\nfunc help() {}\n", {"S": "type", "Run": "method", "help": "function"}, ("Run", "help", "calls")),
    "rust": ("use std::fmt;\npub trait Draw {\n  fn draw(&self);\n}\nimpl Draw for Dot {\n  fn draw(&self) { paint(1); }\n}\nmod inner {\n  pub fn go() {}\n}\n", {"Draw": "interface", "draw": "function", "inner": "namespace", "go": "function", "Dot": "type"}, ("Dot", "Draw", "implements")),
    "java": ("package a;\nimport java.util.List;\npublic class Acc extends Base implements Runnable {\n  private static final int MAX = 3;\n  public void run() {\n    list(MAX);\n  }\n}\n", {"Acc": "class", "MAX": "constant", "run": "method"}, ("Acc", "Base", "inherits")),
    "ruby": ("module M\n  class A < B\n    def hello(x)\n      greet(x)\n    end\n  end\nend\n", {"M": "class", "A": "class", "hello": "method"}, ("hello", "greet", "calls")),
    "bash": ("#!/bin/bash\ndeploy() {\n  echo hi\n}\n", {"deploy": "function"}, None),
    "typescript": ("import { A } from './a'\nexport interface I {\n  x: number\n}\nexport class C extends D implements I {\n  run(x: number) {\n    return helper(x)\n  }\n}\nexport const K = 1\nnamespace N {\n  export function f() {}\n}\n", {"I": "interface", "C": "class", "run": "method", "K": "constant", "N": "namespace", "f": "function"}, ("run", "helper", "calls")),
    "python": ("from a import b\n@dec\nclass C(Base):\n    def m(self):\n        return b()\n\nasync def f():\n    pass\n", {"C": "class", "m": "method", "f": "function"}, ("C", "Base", "inherits")),
}


@pytest.mark.parametrize("language", sorted(SOURCES))
def test_parser(language):
    source, names, edge = SOURCES[language]
    rows = list(parse.parse("f", source, language))
    assert {r["name"]: r["kind"] for r in rows if r["tag"] == "symbol"} == names
    if edge:
        assert edge in {(r["name"], r["target"], r["kind"]) for r in rows if r["tag"] == "edge"}
    chunks = [r for r in rows if r["tag"] == "chunk"]
    assert [c["chunk_index"] for c in chunks] == list(range(len(chunks))) and all(c["token_count"] <= 1024 for c in chunks)


@pytest.mark.parametrize("language,source,want", [
    ("typescript", "export const a = 1, b = f(2, 3), c = [4, { d: 5 }]\nlet x: number, y = 'p, q'\n", {"a": "constant", "b": "constant", "c": "constant", "x": "variable", "y": "variable"}),
    ("go", "package p\n\nvar (\n\tone, two = 1, 2\n\tThree int\n)\n\nconst (\n\tA = iota\n\tB\n)\n\nvar m, n int\n", {"one": "variable", "two": "variable", "Three": "variable", "A": "constant", "B": "constant", "m": "variable", "n": "variable"}),
    ("java", "class C {\n  private int i = 1, j;\n  private Map<String, Integer> k = new HashMap<>();\n}\n", {"C": "class", "i": "variable", "j": "variable", "k": "variable"}),
])
def test_declarations_of_several_names(language, source, want):
    rows = list(parse.parse("f", source, language))
    assert {r["name"]: r["kind"] for r in rows if r["tag"] == "symbol"} == want
    assert all(c["kind"] for c in rows if c["tag"] == "chunk")


def test_parser_reports_errors_and_splits():
    assert [r["tag"] for r in parse.parse("f", "def x(:\n", "python")] == ["error"]
    long = "def f():\n" + "".join(f"    value_{i} = compute_something({i})\n" for i in range(400))
    chunks = [r for r in parse.parse("f", long, "python") if r["tag"] == "chunk"]
    assert len(chunks) > 2 and all(c["token_count"] < 1024 for c in chunks) and chunks[-1]["end_line"] == 401
    assert list(parse.parse("f", "", "go")) == []


def test_index_and_ask(spark, tmp_path):
    root = tmp_path / "proj"
    os.makedirs(root / "app/tests")
    os.makedirs(root / "node_modules")
    (root / "app/auth.py").write_text("import os\n\ndef hash_token(t):\n    return digest(t)\n\ndef login(user, token):\n    return hash_token(token) == user.stored\n")
    (root / "app/tests/test_auth.py").write_text("def test_hash():\n    assert hash_token('a') == hash_token('a')\n")
    (root / "node_modules/a.js").write_text("function no() {}\n")
    (root / "app/bin.py").write_bytes(b"\x00\x01binary")
    e = Engine(spark, str(tmp_path / "store"))
    (root / "app/nul.py").write_bytes(b"0\n\x00\x01")
    (root / "app/latin.py").write_bytes(b"# caf\xe9\ndef cafe():\n    pass\n")
    assert e.index(str(root)) == {"changed": 3, "deleted": 0, "errors": 0, "embedded": 4}
    serial = e.store.pointer["serial"]
    assert e.index(str(root)) == {"changed": 0, "deleted": 0, "errors": 0} and e.store.pointer["serial"] == serial
    found = e.search("hash token", min_score=0.0, record=False).collect()
    assert found and all("tests/" not in r["path"] for r in found)
    assert {r["name"] for r in e.dependencies("hash_token", "callers", 1, "all").collect()} == {"login", "test_hash"}
    assert [r["role"] for r in e.symbols("digest").collect()] == ["referenced_by"]
    assert [r["role"] for r in e.symbols("hash_token").collect()] == ["definition"]
    (root / "app/auth.py").write_text("def hash_token(t, salt):\n    return digest(t)\n")
    os.remove(root / "app/tests/test_auth.py")
    assert e.index(str(root)) == {"changed": 1, "deleted": 1, "errors": 0, "embedded": 1}
    assert not e.search("login", min_score=0.0, scope="all", record=False).where("symbol_name = 'login'").count()  # its postings are dead
    log = {(r["path"], r["change"]) for r in e.diff("1h", scope="all").collect()}
    assert ("app/tests/test_auth.py", "delete") in log and ("app/auth.py", "modify") in log
    assert any("hash_token (signature_changed)" in (r["affected"] or []) for r in e.diff("1h").collect())
    with pytest.raises(ValueError):
        e.search("x", max_results=0)


def tree(root, files):
    for name, body in files.items():
        os.makedirs(os.path.dirname(f"{root}/{name}"), exist_ok=True)
        with open(f"{root}/{name}", "w") as f:
            f.write(body)


def test_search_merges_the_parts_of_a_symbol(spark, tmp_path):
    long = "def large(x):\n" + "".join(f"    gamma_{i} = compute_gamma({i}, x)\n" for i in range(400))
    tree(tmp_path / "p", {"a.py": long, "b.py": "def compute_gamma(i, x):\n    return small_helper(i) + x\n\ndef small_helper(i):\n    return i\n"})
    e = Engine(spark, str(tmp_path / "s"))
    e.index(str(tmp_path / "p"))
    assert e.store.read("chunks").where("symbol_name = 'large'").count() > 1
    found = e.search("compute_gamma gamma_7", 10, 0.0, record=False).where("symbol_name = 'large'").collect()
    assert len(found) == 1 and (found[0]["start_line"], found[0]["end_line"]) == (1, 401) and found[0]["content"].count("compute_gamma(") == 400
    got = e.context("compute_gamma", 300).collect()
    assert got[0]["position"] == 0 and sum(r["token_count"] for r in got) <= 300 + max(r["token_count"] for r in got)
    package = e.context_package("compute_gamma", 4096)
    assert package["strategy"] == "hybrid" and package["total_tokens"] == sum(c["token_count"] for c in package["chunks"]) > 0
    scores = {r["query"]: r for r in e.evaluate([{"query": "small_helper", "files": ["b.py"], "symbols": ["small_helper"]}, {"query": "absent_word", "files": ["z.py"]}]).collect()}
    assert scores["small_helper"]["rr"] >= 0.5 and scores["small_helper"]["recall"] >= 0.5 and scores["absent_word"]["recall"] == 0.0 and set(scores) == {"small_helper", "absent_word", "mean"}
    assert render.text(e.symbols("small_helper"), "symbols") == "function small_helper  b.py:4"
    assert json.loads(render.as_json(e.symbols("small_helper")))[0]["path"] == "b.py"
    assert render.text(e.dependencies("small_helper", "callers", 1), "dependencies") == "function compute_gamma  b.py:1"
    assert render.text(e.summary(), "summary").startswith("2 files") and "a.py" in render.text(e.diff(), "diff")
    assert e.search("gamma", record=False).count() and "score:" in render.text(e.search("gamma", 5, 0.0, record=False), "locate")
    assert render.text(e.context("small_helper"), "context").startswith("--- ")
    pages, after = [], None
    while page := [r[0] for r in e.embed_page(after, 2, done=True).collect()]:
        pages, after = pages + page, page[-1]
    assert pages == sorted(r[0] for r in e.store.read("embeddings").select("chunk_id").collect()) and e.embed_page().count() == 0


def test_without_an_index_files_answer(spark, tmp_path):
    tree(tmp_path / "p", {"a.py": "x = 1\n" * 100, "b.py": "y = 2\n" * 10_000, "c.py": "z = 3\n"})
    e = Engine(spark, str(tmp_path / "s"), config.Config(root=str(tmp_path / "p"), token_budget=512))
    assert e.level() == "filesystem"
    found = e.search("anything", record=False).collect()
    assert [(r["path"], r["token_count"]) for r in found] == [("a.py", 150), ("b.py", 362)] and all(r["score"] == 0.1 for r in found)
    assert [r["path"] for r in e.context("anything", 256).collect()] == ["a.py", "b.py"]


def test_projects_and_settings_are_kept_apart(spark, tmp_path):
    tree(tmp_path / "p", {"a.py": "def one():\n    return 1\n"})
    tree(tmp_path / "q", {"a.py": "def two():\n    return 2\n"})
    p, q = (Engine(spark, str(tmp_path / "s"), project=x) for x in ("p", "q"))
    assert (p.project_id, q.project_id, Engine(spark, str(tmp_path / "s"), project="p").project_id) == (1, 2, 1)
    p.index(str(tmp_path / "p"))
    q.index(str(tmp_path / "q"))
    assert [r["name"] for r in p.symbols("one").collect()] == ["one"] and p.symbols("two").count() == 0 and q.symbols("two").count() == 1
    p.set("k", "1")
    p.set("k", "2")
    assert (p.get("k"), p.get("source"), q.get("k"), q.get("k", "0")) == ("2", str(tmp_path / "p"), None, "0")
    p.purge()
    assert p.store.read("files") is None and q.store.read("files").count() == 1
    assert not os.path.exists(f"{p.store.root}/chunks")


def test_embedding_survives_a_poor_embedder(spark, tmp_path):
    calls = []

    def poor(texts):
        calls.append(len(texts))
        if any("poison" in t for t in texts):
            raise embed.Refused("poison")
        if len(texts) > 2:
            raise OSError("too many")
        return hashing(texts)

    found = embed.patiently(poor, ["a", "b", "poison", "c", "d"])
    assert [e is None for _, e in found] == [True, True, False, True, True] and "refused" in found[2][1]
    assert [v is None for v, _ in embed.patiently(lambda t: (_ for _ in ()).throw(RuntimeError("down")), ["a", "b"])] == [True, True]
    assert embed.query_vector("hash token") is embed.query_vector("hash token")


def test_following_a_folder(spark, tmp_path):
    tree(tmp_path / "p", {"a.py": "def one():\n    return 1\n"})
    e = Engine(spark, str(tmp_path / "s"))
    e.follow(str(tmp_path / "p"), str(tmp_path / "cp")).awaitTermination(120)
    assert [r["path"] for r in e.symbols("one").collect()] == ["a.py"]
    tree(tmp_path / "p", {"deep/er/b.py": "def two():\n    return one()\n", ".hidden/c.py": "def three(): pass\n", "d.txt": "none"})
    e.follow(str(tmp_path / "p"), str(tmp_path / "cp")).awaitTermination(120)
    assert {r["path"] for r in e.store.read("files").collect()} == {"a.py", "deep/er/b.py"}
    assert {r["name"] for r in e.dependencies("one", "callers", 1).collect()} == {"two"}
    assert e.embed() == {"embedded": 2, "refused": 0} and e.level() == "hybrid"


def test_store_writes_changed_parts_alone(spark, tmp_path):
    s = store.Store(spark, str(tmp_path))
    rows = spark.createDataFrame([(f"f{i}", i) for i in range(60)], "path string, n long")
    s.commit({"t": rows, "log": rows.limit(1)})
    before = s.pointer["tables"]["t"]
    part = rows.where("path = 'f7'").select(s.part()).first()[0]
    s.commit({"t": s.read("t", [part]).withColumn("n", F.col("n") + 100), "log": rows.limit(2)}, parts=[part], append=("log",))
    after = s.pointer["tables"]["t"]
    assert {p for p in after if after[p] != before[p]} == {str(part)}
    assert s.read("t").count() == 60 and s.read("t").where("path = 'f7'").first()["n"] == 107 and s.read("log").count() == 3
    s.commit({"t": s.read("t", [part]).limit(0)}, parts=[part])
    assert s.read("t").count() == 60 - spark.createDataFrame([(f"f{i}",) for i in range(60)], "path string").where(s.part() == part).count()
    assert not os.path.exists(tmp_path / before[str(part)]) and s.read("none") is None


def test_parents(spark):
    c = spark.createDataFrame([(1, None), (2, 5), (3, 6)], "chunk_id long, parent long")
    new = spark.createDataFrame([(1, 9), (2, 8), (2, 7)], "chunk_id long, parent long")
    assert {r[0]: r[1] for r in store.update_parents(c, new).select("chunk_id", "parent").collect()} == {1: 9, 2: 7, 3: 6}


def test_embedder(spark):
    assert (hashing(["a b", "a b"])[0] == hashing(["a b"])[0]).all()
    got = embed.embedded(spark.createDataFrame([(i, t) for i, t in enumerate(["hello world", None] * 150)], "id long, t string"), "id", "t").collect()
    assert len(got) == 300 and all(len(r["embedding"]) == 128 and r["error"] is None for r in got)


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    os.makedirs(src)
    rows = [{"event_id": i, "user_id": i % 3, "ts": f"2024-01-01T00:00:{i:02d}"} for i in range(12)] + [{"event_id": 99, "user_id": 0, "ts": "2024-01-01T05:00:00"}]
    (src / "a.json").write_text("\n".join(map(json.dumps, rows)))
    read = lambda: spark.readStream.schema("event_id long, user_id long, ts timestamp").json(str(src))

    def run(df, name, mode):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name).collect()

    assert sorted((r["user_id"], r["n"]) for r in run(streams.debounced(read(), "user_id", "ts", "30 seconds"), "bursts", "append"))[:3] == [(0, 4), (1, 4), (2, 4)]
    assert {(r["user_id"], r["n"]) for r in run(streams.sessions(read(), "user_id"), "sess", "update")} == {(0, 5), (1, 4), (2, 4)}
    seen = []
    streams.on_changes(read(), "user_id", lambda df: seen.append(df.count()), lambda: seen.append("rescan"), str(tmp_path / "cp")).awaitTermination(120)
    assert seen == [3]
