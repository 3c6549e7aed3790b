"""Packing into token sequences: first-fit decreasing with a tournament tree, within randomised groups.

A document's ids and an end id are cut at every `length` ids; only the last piece is shorter. Documents are dealt by a
hash into groups of about `GROUP_ROWS`; in each, pieces go by falling length into the first sequence that has room,
which a tournament tree over the sequences' room finds in logarithmic time. What a task holds is one group's lengths.

An added token's literal in a text (`<|endoftext|>`) gives its one id, as the tokenizer file says. Null and empty texts give the
end id alone. Repeated rows are packed one by one (the dealing hashes a row number, too, so
no id can fill a group); an empty table gives no rows; columns beyond id and text are left out.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, small_batches, strings, table

LENGTH, END, GROUP_ROWS = 2048, 1, 8192


class Tokenizer:
    """ids of the tokenizer file as it is, added tokens included. Texts within Latin-1 that hold no literal of an added token go
    through the faster reader of the same vocabulary, where both agree."""

    def __init__(self, path: str, ranks_path: str | None, pattern: str | None):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer as File

        self.file = File.from_file(path)
        #: Literals that the file reads as one added token; only its own reader knows their rules.
        self.added = [t.content for t in self.file.get_added_tokens_decoder().values()]
        self.fast = None
        if ranks_path:
            import base64

            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> list[int]:
        if self.fast is not None and not any(literal in text for literal in self.added):
            try:
                text.encode("latin-1")
                return self.fast.encode_ordinary(text)
            except UnicodeEncodeError:
                pass
        return self.file.encode(text, add_special_tokens=False).ids


@lru_cache(2)
def tokenizer(path: str, ranks_path: str | None, pattern: str | None) -> Tokenizer:
    return Tokenizer(path, ranks_path, pattern)


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each of the lengths, which fall. The tree's leaves are bins, its nodes the most room below."""
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    size = 1
    while size < max(1, len(lengths)):
        size *= 2
    room = [capacity] * (2 * size)
    for i, n in enumerate(lengths.tolist()):
        at = 1
        while at < size:
            at *= 2
            if room[at] < n:
                at += 1
        bins[i], offsets[i] = at - size, capacity - room[at]
        room[at] -= n
        while at > 1:
            at //= 2
            most = room[2 * at] if room[2 * at] >= room[2 * at + 1] else room[2 * at + 1]
            if room[at] == most:
                break
            room[at] = most
    return bins, offsets


def pack(df: DataFrame, tokenizer_path: str, ranks_path: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, end: int = END, group_rows: int = GROUP_ROWS, keep_ids: bool = True) -> DataFrame:
    """Per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and with keep_ids the `ids` themselves."""
    small_batches(df.sparkSession)
    groups = max(1, -(-df.count() // group_rows))
    kind = df.schema[id_col].dataType.simpleString()
    names = ["group", id_col, "start", "length", "ids_crc32", "doc_tokens", *["ids"] * keep_ids]
    columns = f"`{id_col}` {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * keep_ids

    def pieces(batches):
        t = tokenizer(tokenizer_path, ranks_path, pattern)
        for batch in batches:
            texts = strings(batch.column(2))
            for a, b in slices(texts):
                row, start, size, crc, total, ids = [], [], [], [], [], []
                for i in range(a, b):
                    own = t.ids(texts[i])
                    own.append(end)
                    data = np.array(own, "<u4")
                    for s in range(0, len(data), length):
                        part = data[s : s + length]
                        row.append(i)
                        start.append(s)
                        size.append(len(part))
                        crc.append(zlib.crc32(part))
                        total.append(len(data))
                        if keep_ids:
                            ids.append(part.astype(np.int32))
                at = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *(pa.array(x, pa.int64()) for x in (start, size, crc, total)), *([pa.array(ids, pa.list_(pa.int32()))] if keep_ids else [])], names)

    dealt = df.select(F.pmod(F.xxhash64(F.col(id_col), F.monotonically_increasing_id()), F.lit(groups)).cast("int").alias("group"), id_col, text_col)

    def packed(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(["length", id_col, "start", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        bins, offsets = first_fit_decreasing(own["length"].to_numpy(), length)
        return own.assign(sequence_id=own.group.astype("int64") * (1 << 32) + bins, offset=offsets).drop(columns="group")

    order = ", sequence_id long, offset long"
    return dealt.mapInArrow(pieces, f"group int, {columns}").groupBy("group").applyInPandas(packed, columns + order)


def pack_documents(docs: DataFrame, keep_ids: bool = False) -> DataFrame:
    import public_tokenizers as public

    return pack(docs, public.path("byte_bpe_50k.json"), public.path("byte_bpe_50k.tiktoken"), public.PATTERN, keep_ids=keep_ids)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
