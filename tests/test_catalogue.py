"""Every catalogue query against its SQL in DuckDB, over a small scale factor."""

import math
import os

import numpy as np
import pytest

duckdb = pytest.importorskip("duckdb")
from pyspark.sql import functions as F  # noqa: E402

from codeloom.functions import scalar as fn  # noqa: E402
from codeloom.operators import rank, text, vector  # noqa: E402
from codeloom.plans import catalogue  # noqa: E402

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the benchmark tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def cells(df):
    def cell(x):
        if x is None or x != x:
            return None
        return round(x, 6) if isinstance(x, float) and math.isfinite(x) else str(x)

    return sorted((tuple(cell(x) for x in r) for r in df[sorted(df.columns)].itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SF).toPandas()
    if name in catalogue.ORACLE_SQL:
        want = duck.sql(catalogue.ORACLE_SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert cells(got) == cells(want)
    else:
        assert len(got)


def test_recall_of_inverted_lists(spark):
    """Over all queries, those whose id is divisible by 20, against brute force over all rows."""
    d = "/root/testdata/sf0.01"
    if not os.path.isdir(d):
        pytest.skip("needs the benchmark tables")
    near = {(r["vec_id"], r["neighbour"]) for r in catalogue.QUERIES["vector_ann_ivf"](spark, d).collect()}
    exact = {(r["vec_id"], r["neighbour"]) for r in vector.knn_join(spark.read.parquet(f"{d}/embeddings.parquet"), 10).where("vec_id % 20 = 0").collect()}
    assert len({q for q, _ in exact}) == 25 and len(near) == len(exact) == 250
    assert len(near & exact) / len(exact) >= 0.9


def test_odd_vectors(spark):
    """Null, empty, ragged and spoilt vectors take no part; empty tables give none."""
    rows = [(i, [float(i % 3), 1.0 + i, 2.0]) for i in range(12)] + [(20, None), (21, []), (22, [1.0]), (23, [float("nan"), 1.0, 1.0]), (24, [0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = vector.knn_join(df, 2, block_rows=4).collect()
    assert {r["vec_id"] for r in got} == {r["neighbour"] for r in got} | set(range(12)) == set(range(12)) and len(got) == 24
    index = vector.ivf_index(df, 3)
    assert {r["vec_id"] for r in vector.ivf_search(index, df, 2, 3).collect()} == set(range(12))
    none = df.limit(0)
    assert vector.knn_join(none, 2).count() == 0 and vector.ivf_search(vector.ivf_index(none, 3), none, 2, 3).count() == 0
    base = spark.createDataFrame([(1, [1.0, 1.0, 1.0]), (2, [2.0, 2.0, 2.0])], "chunk_id long, embedding array<float>")
    new = spark.createDataFrame([(2, [5.0, 5.0, 5.0]), (3, [0.0, 0.0, 0.0]), (4, [1.0, 2.0, 3.0])], "chunk_id long, embedding array<float>")
    merged = vector.upsert_vectors(base, new, 3)
    assert {r[0]: r[1][0] for r in merged.collect()} == {1: 1.0, 2: 5.0, 4: 1.0}
    assert {r[0] for r in vector.delete_vectors(merged, spark.createDataFrame([(1,), (1,), (9,)], "chunk_id long")).collect()} == {2, 4}


def test_metrics_by_class_build_no_pairs(spark):
    """Counted a label and by all pairs of queries and items alike: several labels, none, repeats, a query's own row."""
    labels = [(i, i % 3) for i in range(30)] + [(4, 2), (4, 2), (5, None), (40, 9), (0, 1)]
    e = spark.createDataFrame(labels, "query long, label int")
    judged = e.where("query % 2 = 0").withColumnRenamed("query", "item")
    results = spark.createDataFrame([(q, r, (q * r) % 17) for q in range(0, 30, 2) for r in range(1, 6)], "query long, rank int, item long")
    pairs = e.join(judged, "label").where("query <> item").select("query", "item")
    want = sorted(map(tuple, rank.metrics(results, pairs, 4).collect()))
    got = rank.class_metrics(results, e, judged, 4)
    assert sorted(map(tuple, got.collect())) == want and len(want) == 30


def test_neighbours_of_lists_are_sent_in_packs(spark):
    """Ties and float precision as by single comparisons, over several blocks and packs; few shuffled rows, not one a pair."""
    rng = np.random.default_rng(3)
    points = np.repeat(rng.normal(size=(150, 8)).astype(np.float32), 4, axis=0) * rng.integers(1, 3, (600, 1)).astype(np.float32)
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "vec_id long, embedding array<float>")
    unit = points.astype(float) / np.linalg.norm(points.astype(float), axis=1, keepdims=True)
    s = np.round(unit @ unit.T, 6)
    np.fill_diagonal(s, -np.inf)
    want = {(i, r + 1, int(j)) for i in range(600) for r, j in enumerate(np.lexsort((np.arange(600), -s[i]))[:5])}
    knn = vector.knn_join(df, 5, block_rows=50)
    ivf = vector.ivf_search(vector.ivf_index(df, 6), df, 5, 6, block_rows=50)
    for found in (knn, ivf):
        assert {(r["vec_id"], r["rank"], r["neighbour"]) for r in found.collect()} == want
        assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_stored_index_gives_what_a_scan_gives(spark, tmp_path):
    rows = [(1, "validateToken checks", "a"), (2, "token here token", "b"), (3, "nothing", "a"), (4, None, "a"), (5, "", "b"), (6, "Token, work", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, part string")
    index = text.Index.build(df, str(tmp_path), keep=["part"])
    for query in ("token work", "absent", "* -", "nothing TOKEN"):
        want = sorted(map(tuple, text.top_keyword(df.where("text is not null or true"), query, 9).collect()))
        assert sorted(map(tuple, index.top(query, 9).collect())) == want
    assert [r[0] for r in index.top("token", 9, F.col("part") == "a").collect()] == [6]
    plan = index.top("token", 9)._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "documents" not in plan


def test_index_exchanges_postings_once(spark, tmp_path, monkeypatch):
    """Terms are counted within a text; large buckets are several files; repeated ids are added up as before."""
    rows = [(i, f"b a{i % 5} B c c{i % 3} a", f"p{i}") for i in range(40)] + [(50, None, "n"), (51, "", "e")]
    repeated = [*rows, rows[7], (8, "b b", "other")]
    monkeypatch.setattr(text, "TASK_ROWS", 1)
    plans, plain = [], type(spark.range(1)).repartitionById

    def seen(df, *args):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return plain(df, *args)

    monkeypatch.setattr(type(spark.range(1)), "repartitionById", seen)
    for case, given in (("one", rows), ("more", repeated)):
        df = spark.createDataFrame(given, "doc_id long, text string, path string")
        index = text.Index.build(df, str(tmp_path / case), keep=["path"])
        split = df.select("doc_id", "path", fn.tokens(F.col("text")).alias("t"))
        want = split.select("doc_id", "path", F.size("t").alias("len"), F.explode("t").alias("term")).groupBy("doc_id", "path", "len", "term").agg(F.count("*").alias("tf"))
        columns = ["doc_id", "path", "len", "term", "tf"]
        assert sorted(map(tuple, index.postings().select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))
        assert index.postings(["b"]).select("doc_id").distinct().count() == 40
    assert "Exchange" not in plans[0] and "Exchange" in plans[1]


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
