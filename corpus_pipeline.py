"""From documents to packed training sequences: toxic ones go, near copies go, secrets are masked, the rest is packed.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents (and any
other columns that docs has). Null and empty texts pass all stages (their near copies, all texts without words, are one
group of which one stays); empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm import packing, secret_scan, simhash, toxicity
from codeloom.llm.common import by_key, stored, table


def boxed(docs: DataFrame, *columns: str) -> DataFrame:
    """The named columns beside one struct `box` with all columns of docs, so no column of docs can clash with a stage's own."""
    return docs.select(*[F.col(f"`{c}`") for c in columns], F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("box"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score, fitted on the labelled ones among them, is under 0.5."""
    model = toxicity.train(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return toxicity.score(boxed(docs), model, text_col="box.text", keep=["box"]).where("__score < 0.5").select("box.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (that of the least doc_id) of each group of near copies.

    Near copies have SimHash fingerprints within three bits (op2's groups), or five-word shingles of a Jaccard similarity of 0.8.
    """
    # Row numbers have to stay with their rows, so they are written down.
    numbered, _ = stored(boxed(docs).withColumn("row", F.monotonically_increasing_id()))
    groups = simhash.similar(numbered.select("row", "box.doc_id", "box.text"), "row", radius=simhash.RADIUS)
    gone = groups.where("row <> component").select("row")
    return numbered.join(by_key(gone), "row", "left_anti").select("box.*")


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced by a mark; n_chars follows the text."""
    masked = secret_scan.redacted(boxed(docs, "text"))
    length = F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("box.n_chars"))
    new = {"text": F.col("text"), "n_chars": length}
    return masked.select(*[new.get(c, F.col(f"box.`{c}`")).alias(c) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences, as op7_packing returns them."""
    return packing.pack_documents(docs)


STAGES = [("toxicity", drop_toxic), ("simhash near-dedup", drop_near_duplicates), ("secret scan", mask_secrets), ("packing", pack)]
#: A fitted classifier, bit-wise fingerprints and tokenizers have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs, _ = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
