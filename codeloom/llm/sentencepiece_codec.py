"""SentencePiece encoding with source offsets, and decoding.

The library segments; the normaliser here repeats its normalisation (longest prefix in the model's compiled character
map, else one character as it is) and records for every normalised byte the source byte it came from. Piece lengths in
normalised bytes, summed up, then project every piece on a span of the original UTF-8 bytes.

Null texts count as empty; an empty text gets the begin and end ids alone. Repeated rows are encoded one by one, and an
empty table gives an empty result. Only `id_col` and the outputs are returned, so other columns can't clash.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import slices, small_batches, strings, table

ESCAPED_SPACE = "▁".encode()


class CharsMap:
    """A compiled character map: a double-array trie over UTF-8 prefixes, then NUL-ended replacements."""

    def __init__(self, blob: bytes):
        self.units: tuple[int, ...] = ()
        if blob:
            (size,) = struct.unpack_from("<I", blob)
            self.units = struct.unpack_from(f"<{size // 4}I", blob, 4)
            self.replacements = blob[4 + size :]

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 512) >> 6)

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest prefix of data[at:] in the map and its replacement."""
        if not self.units:
            return None
        found, node = None, self._offset(self.units[0])
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(self.units) or self.units[node] & 0x800000FF != data[i]:
                break
            unit = self.units[node]
            node ^= self._offset(unit)
            if unit >> 8 & 1:
                found = i + 1 - at, self.units[node] & 0x7FFFFFFF
        if found is None:
            return None
        end = self.replacements.index(b"\0", found[1])
        return found[0], self.replacements[found[1] : end]


class Normalizer:
    """data -> (normalised bytes, for each of them and for the end the source byte it came from)."""

    def __init__(self, spec, whitespace_as_suffix: bool = False):
        self.map = CharsMap(spec.precompiled_charsmap)
        self.dummy, self.squeeze, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        self.suffix = whitespace_as_suffix

    def __call__(self, data: bytes) -> tuple[bytes, np.ndarray]:
        if not data:
            return b"", np.zeros(1, np.int64)
        if not self.map.units and not self.squeeze and self.escape and not self.suffix:
            return self._identity(data)
        return self._general(data)

    def _identity(self, data: bytes) -> tuple[bytes, np.ndarray]:
        source = np.frombuffer(data, np.uint8)
        ends = np.repeat(np.arange(len(source)), np.where(source == 32, 3, 1))
        head = np.zeros(3 * self.dummy, np.int64)
        return ESCAPED_SPACE * self.dummy + data.replace(b" ", ESCAPED_SPACE), np.concatenate([head, ends, [len(source)]])

    def _steps(self, data: bytes) -> Iterator[tuple[int, int, bytes]]:
        at = 0
        while at < len(data):
            if hit := self.map.longest(data, at):
                length, new = hit
            else:
                lead = data[at]
                length = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                new = data[at : at + length]
            yield at, length, new
            at += length

    def _general(self, data: bytes) -> tuple[bytes, np.ndarray]:
        space = ESCAPED_SPACE if self.escape else b" "
        out, origin, consumed = bytearray(), [], 0
        steps = list(self._steps(data))
        if self.squeeze:
            while steps and steps[0][2] == b" ":
                at, length, _ = steps.pop(0)
                consumed = at + length
            if not steps:
                return b"", np.array([consumed])
        if self.dummy and not self.suffix:
            out += space
            origin += [consumed] * len(space)
        after_space = self.squeeze
        for at, length, new in steps:
            if self.squeeze and after_space:
                new = new.lstrip(b" ")
            for byte in new:
                got = space if byte == 32 else bytes([byte])
                out += got
                origin += [at] * len(got)
            if new:
                after_space = self.squeeze and new.endswith(b" ")
            consumed = at + length
        if self.squeeze:
            while out.endswith(space):
                consumed = origin[len(out) - len(space)]
                del out[-len(space) :], origin[-len(space) :]
        if self.dummy and self.suffix:
            out += space
            origin += [consumed] * len(space)
        return bytes(out), np.array([*origin, consumed])


class Codec:
    def __init__(self, model_path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        self.processor = sentencepiece.SentencePieceProcessor(model_file=model_path)
        model = pb.ModelProto()
        with open(model_path, "rb") as f:
            model.ParseFromString(f.read())
        self.normalizer = Normalizer(model.normalizer_spec, model.trainer_spec.treat_whitespace_as_suffix)
        self.unknown = self.processor.unk_id()
        # Normalised bytes of each piece: a byte piece (type 6) has one, a control symbol (type 3) none.
        self.width = np.array([1 if p.type == 6 else 0 if p.type == 3 else len(p.piece.encode()) for p in model.pieces], np.int64)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.processor.encode(texts, num_threads=1, add_bos=True, add_eos=True)

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.processor.decode(ids, num_threads=1)

    def spans(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begin and end of every piece in the UTF-8 bytes of the text."""
        data = text.encode()
        normal, origin = self.normalizer(data)
        widths = self.width[ids]
        if (unknown := ids == self.unknown).any():  # of models without byte pieces: an unknown run's length is its surface's
            pieces = self.processor.encode_as_immutable_proto(text).pieces
            widths[unknown] = [len(self.normalizer(p.surface.encode())[0]) - 3 * self.normalizer.dummy for p in pieces if p.id == self.unknown]
        ends = np.cumsum(widths)
        if len(ends) and ends[-1] != len(normal):
            raise ValueError(f"pieces cover {ends[-1]} of {len(normal)} normalised bytes")
        return origin[ends - widths], origin[ends]


@lru_cache(2)
def codec(model_path: str) -> Codec:
    return Codec(model_path)


def encode(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, `ids` with begin and end ids, and the original byte spans `begins`, `ends` of the pieces."""
    small_batches(df.sparkSession)

    def run(batches):
        c = codec(model_path)
        for batch in batches:
            texts = strings(batch.column(1))
            for a, b in slices(texts):
                ids = c.encode(texts[a:b])
                spans = [c.spans(t, np.array(i)) for t, i in zip(texts[a:b], ids)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(ids, pa.list_(pa.int32())), pa.array([s for s, _ in spans], pa.list_(pa.int32())), pa.array([e for _, e in spans], pa.list_(pa.int32()))], [id_col, "ids", "begins", "ends"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>, begins array<int>, ends array<int>")


def decode(df: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Per row: id and the decoded `text` (empty for null ids)."""
    small_batches(df.sparkSession)

    def run(batches):
        c = codec(model_path)
        for batch in batches:
            texts = c.decode([x or [] for x in batch.column(1).to_pylist()]) if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [id_col, "text"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {kind}, text string")


def digests(df: DataFrame, model_path: str) -> DataFrame:
    """Encode, project, and decode each text in one pass, and keep digests of the results alone."""
    small_batches(df.sparkSession)
    sha = lambda x: hashlib.sha256(x).hexdigest()

    def run(batches):
        c = codec(model_path)
        for batch in batches:
            texts = strings(batch.column(1))
            rows = []
            for a, b in slices(texts):
                ids = c.encode(texts[a:b])
                for text, own, back in zip(texts[a:b], ids, c.decode(ids)):
                    own = np.array(own, "<u4")
                    begins, ends = c.spans(text, own)
                    rows.append((len(own), sha(own.tobytes()), sha(back.encode()), sha(begins.astype("<u4").tobytes() + ends.astype("<u4").tobytes())))
            n, *shas = zip(*rows) if rows else ([], [], [], [])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), *(pa.array(x, pa.string()) for x in shas)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256"])

    return df.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_sha256 string")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
