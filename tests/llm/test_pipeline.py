"""The pipeline: each stage alone, then all of it, on a table with planted cases."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from codeloom.llm import simhash

pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 8))) for _ in range(500)]
    rows, labels = [], []
    for i in range(400):
        words = [rng.choice(vocabulary) for _ in range(150)]
        if i % 8 == 0:
            for _ in range(3):
                words[rng.randrange(150)] = rng.choice(["scumbag", "scum"])
        rows.append([i, " ".join(words), "en", f"src{i % 3}", 0])
        if i % 2 == 0:
            labels.append((i, 1, int(i % 8 == 0)))
    rows += [[1000, rows[1][1], "en", "s", 0], [1001, rows[1][1] + " end", "en", "s", 0], [1002, rows[2][1] + " token = abcdefghijklmnop", "en", "s", 0], [1003, None, "en", "s", None], [1004, "", None, "s", 0], [1003, None, "en", "s", None]]
    for r in rows:
        r[4] = None if r[1] is None else len(r[1])
    d = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d, rows


def test_stages(spark, folder, tmp_path):
    d, rows = folder
    # Columns named like those that stages or operators use themselves.
    clash = ["row", "box", "__row", "__low", "__postings", "__spans", "__score", "component", "id", "set", "key"]
    docs = spark.read.parquet(f"{d}/documents.parquet").select("*", *[F.concat(F.lit(c), F.col("doc_id")).alias(c) for c in clash])
    columns = docs.columns
    seen = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, d).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 3:
            assert docs.columns == columns
            seen.append({r["doc_id"]: r for r in docs.collect()})
            assert all(r[c] == f"{c}{r['doc_id']}" for r in seen[-1].values() for c in clash)
    ids = [set(s) for s in seen]
    gone = {r[0] for r in rows} - ids[0]
    toxic = set(range(0, 400, 8))
    assert len(gone & toxic) > 45 and len(gone - toxic) <= 4
    assert {1000, 1001, 1002} <= ids[0] and not {1000, 1001, 1002} & ids[1]
    assert len(ids[0] - ids[1]) <= 5  # besides those three, rows without words are one group
    assert ids[1] == ids[2]
    packed = {r["doc_id"] for r in docs.collect()}
    assert packed == ids[2]


def test_near_copies_by_fingerprints(spark):
    """Texts whose fingerprints op2 links are near copies, too, where their shingles are less alike than 0.8."""
    rng = random.Random(5)
    words = ["".join(rng.choice("aeioulnrst") for _ in range(6)) for _ in range(900)]
    line, rows = " ".join(words[:12]), []
    for i in range(6):
        rows.append((i, line + (" " + line) * 40 + " " + " ".join(words[20 + 20 * i : 40 + 20 * i]), "en", "s", 0))
    rows += [(10 + i, " ".join(words[200 + 60 * i : 260 + 60 * i]), "en", "s", 0) for i in range(6)]
    fps = [simhash.fingerprint(r[1]) for r in rows]
    sets = [simhash.shingles(r[1]) for r in rows]
    linked = [(i, j) for j in range(len(rows)) for i in range(j) if (fps[i] ^ fps[j]).bit_count() <= 3]
    assert linked and all(len(sets[i] & sets[j]) / len(sets[i] | sets[j]) < 0.8 for i, j in linked)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()}
    groups = {r["component_id"] for r in simhash.near_duplicates(docs).collect()}
    assert kept == groups and len(kept) < len(rows)


def test_run_and_empty(spark, folder, tmp_path):
    d, _ = folder
    assert corpus_pipeline.run(spark, d).count() > 0
    e = str(tmp_path)
    spark.read.parquet(f"{d}/documents.parquet").limit(0).write.parquet(f"{e}/documents.parquet")
    spark.read.parquet(f"{d}/labels.parquet").limit(0).write.parquet(f"{e}/labels.parquet")
    assert corpus_pipeline.run(spark, e).count() == 0
