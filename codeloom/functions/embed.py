"""A deterministic embedder without a model: signed hashes of words, unit length. Others follow the same signature."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

Embedder = Callable[[list[str]], np.ndarray]
DIMS = 128


def hashing(texts: list[str], dims: int = DIMS) -> np.ndarray:
    out = np.zeros((len(texts), dims), np.float32)
    for i, t in enumerate(texts):
        for w in re.findall(r"\w+", t.lower()):
            h = zlib.crc32(w.encode())
            out[i, h % dims] += 1 if h >> 31 else -1
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


EMBEDDERS: dict[str, Embedder] = {"hashing": hashing}


class Refused(ValueError):
    """What an embedder raises for input that no retry will help."""


@lru_cache(100)
def query_vector(text: str, embedder: str = "hashing") -> tuple[float, ...]:
    """The vector of a query with its prefix; the last hundred are kept."""
    return tuple(float(x) for x in EMBEDDERS[embedder]([text])[0])


def patiently(embed: Embedder, texts: list[str], retries: int = 3) -> list[tuple[np.ndarray | None, str | None]]:
    """(vector, error) of each text. A batch that fails is tried again, then halved, so one poisonous text costs no other."""
    error = ""
    for _ in range(retries):
        try:
            return [(v, None) for v in embed(texts)]
        except Refused as e:
            error = f"refused: {e}"
            break
        except (OSError, RuntimeError) as e:
            error = f"failed: {e}"
    if len(texts) <= 1:
        return [(None, error)] * len(texts)
    half = len(texts) // 2
    return patiently(embed, texts[:half], retries) + patiently(embed, texts[half:], retries)


def embedded(df: DataFrame, id_col: str, text_col: str, embedder: str = "hashing", batch: int = 128, retries: int = 3) -> DataFrame:
    """(id, embedding, error): one is null. Batches of `batch` texts at most go to the embedder."""

    def run(frames):
        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch]
                found = patiently(EMBEDDERS[embedder], [t or "" for t in part[text_col]], retries)
                yield pd.DataFrame({id_col: part[id_col].to_numpy(), "embedding": [None if v is None else v.tolist() for v, _ in found], "error": [e for _, e in found]})

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInPandas(run, f"`{id_col}` {kind}, embedding array<float>, error string")
