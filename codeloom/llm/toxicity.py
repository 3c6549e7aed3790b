"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the presence of words and their stems, of stem bigrams and of skip-grams (a stem and the one after next) in
2**BITS hashed places. FTRL keeps a learning rate for each place and sets places of little use to zero by L1, so the weights that
remain are few (2**BITS at most, a proven bound) and travel to every task.

The model is fitted on labelled rows, `MAX_ROWS` at most (those with the least hash of the id); every row is scored.
Null and empty texts hold no feature and score the bias. Labels that are null are left out; if no label 1 or no label 0
is left, every score is 0. Ids that repeat train once. An empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

import zlib
from math import exp, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, strings, table

BITS = 18
#: Bound of the labelled sample.
MAX_ROWS = 16384
EPOCHS, ALPHA, BETA, L1, L2 = 6, 0.5, 1.0, 6.0, 0.5
#: Letters of a stem.
STEM = 5
STRIP = ".,;:!?\"'()[]{}<>|*#-_"


class Features:
    """Words count in lower case without punctuation, once whole and once as a stem of STEM letters."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def _hash(self, raw: str) -> int:
        """The word's hash above, the stem's below."""
        if len(self.known) > 500_000:
            self.known.clear()
        word = raw.strip(STRIP).lower()
        value = self.known[raw] = (zlib.crc32(word.encode()) << 32 | zlib.crc32(word[:STEM].encode())) or 1
        return value

    def places(self, text: str) -> np.ndarray:
        """Hashed places of all n-grams, repeats included."""
        known, new = self.known.get, self._hash
        both = np.array([known(w) or new(w) for w in text.split()], np.uint64)
        word, h = both >> np.uint64(32), both & np.uint64(0xFFFFFFFF)
        one, mix = h * np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
        pair = (one[:-1] ^ (h[1:] * np.uint64(0xC2B2AE3D27D4EB4F))) * mix
        skip = (one[:-2] ^ (h[2:] * np.uint64(0x165667B19E3779F9)) ^ np.uint64(0x5851F42D4C957F2D)) * mix
        return np.concatenate([one, word * np.uint64(0xA0761D6478BD642F), pair, skip]) >> np.uint64(64 - BITS)


def fit(rows: list[tuple[np.ndarray, int]]) -> tuple[np.ndarray, float]:
    """FTRL-proximal over (unique places, label) in the given order; -> weights, bias."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    zb = nb = bias = 0.0
    for _ in range(EPOCHS):
        for at, y in rows:
            own_z, own_n = z[at], n[at]
            w = np.where(np.abs(own_z) <= L1, 0.0, (np.sign(own_z) * L1 - own_z) / ((BETA + np.sqrt(own_n)) / ALPHA + L2))
            g = 1 / (1 + exp(-max(-35.0, min(35.0, w.sum() + bias)))) - y
            sigma = (np.sqrt(own_n + g * g) - np.sqrt(own_n)) / ALPHA
            z[at] = own_z + g - sigma * w
            n[at] = own_n + g * g
            zb += g - (sqrt(nb + g * g) - sqrt(nb)) / ALPHA * bias
            nb += g * g
            bias = -zb / ((BETA + sqrt(nb)) / ALPHA)
    return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2)), bias


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = MAX_ROWS) -> tuple[np.ndarray, float] | None:
    """Weights and bias from the labelled documents, fitted in one task; None if one of the labels is missing."""
    small_batches(docs.sparkSession)
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).cast("int").alias("__y"))
    sample = known.orderBy(F.xxhash64(id_col), id_col).limit(max_rows)
    # The sample has max_rows rows at most, so it may be broadcast.
    rows = docs.select(id_col, F.col(text_col).alias("__t")).join(F.broadcast(sample), id_col).groupBy(id_col, "__y").agg(F.min("__t").alias("__t"))

    def places(batches):
        features = Features()
        for batch in batches:
            found = [np.unique(features.places(t)).astype("<u4").tobytes() for t in strings(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.binary())], [id_col, "y", "places"])

    kind = docs.schema[id_col].dataType.simpleString()
    featured = rows.select(id_col, "__y", "__t").mapInArrow(places, f"`{id_col}` {kind}, y int, places binary").select(F.xxhash64(id_col).alias("o"), "y", "places")

    def fitted(frames):
        held = sorted(((o, y, p) for f in frames for o, y, p in zip(f.o, f.y, f.places)), key=lambda x: (x[0], x[1]))
        if len({y for _, y, _ in held}) == 2:
            weights, bias = fit([(np.frombuffer(p, "<u4"), y) for _, y, p in held])
            at = np.flatnonzero(weights)
            yield pd.DataFrame({"at": [at.astype("<u4").tobytes()], "w": [weights[at].tobytes()], "bias": [bias]})

    got = featured.repartition(1).mapInPandas(fitted, "at binary, w binary, bias double").first()
    if got is None:
        return None
    weights = np.zeros(1 << BITS)
    weights[np.frombuffer(got["at"], "<u4")] = np.frombuffer(got["w"])
    return weights, got["bias"]


def score(docs: DataFrame, model: tuple[np.ndarray, float] | None, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Per row: score, and the id or the columns named in `keep` as they are (of any type and name but __score).

    text_col may be a field of a kept struct (`box.text`), which then isn't sent twice.
    """
    small_batches(docs.sparkSession)
    at = np.flatnonzero(model[0]).astype("<u4") if model else np.zeros(0, "<u4")
    sent = docs.sparkSession.sparkContext.broadcast((at, model[0][at] if model else np.zeros(0), model[1] if model else None))
    kept = keep if keep is not None else [id_col]
    outer, _, inner = text_col.partition(".")
    sent_columns = kept if outer in kept else [*kept, outer]
    at_text, at_field = sent_columns.index(outer), docs.schema[outer].dataType.fieldNames().index(inner) if inner else None
    schema = docs.select(*[F.col(f"`{c}`") for c in kept]).schema.add("__score", "double")

    def run(batches):
        places, w, bias = sent.value
        weights, features = np.zeros(1 << BITS), Features()
        weights[places] = w
        useful = weights != 0
        for batch in batches:
            scores = []
            texts = batch.column(at_text)
            for text in strings(texts if at_field is None else texts.field(at_field)):
                if bias is None:
                    scores.append(0.0)
                    continue
                own = features.places(text)
                x = weights[np.unique(own[useful[own]])].sum() + bias
                scores.append(1 / (1 + exp(-max(-35.0, min(35.0, x)))))
            n = len(kept)
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(scores, pa.float64())], schema=pa.schema([*list(batch.schema)[:n], pa.field("__score", pa.float64())]))

    return docs.select(*[F.col(f"`{c}`") for c in sent_columns]).mapInArrow(run, schema)


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string")) % 5 == 0


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train(docs, labels.where(~held_out()))
    scored = score(docs, model)
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), F.col("__score").alias("score"), F.when(F.col("__score") >= 0.5, 1).otherwise(0).alias("predicted"))
