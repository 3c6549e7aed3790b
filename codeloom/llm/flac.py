"""FLAC media columns: 8-bit mono streams, written and read back in bulk with numpy.

Writing: blocks of 4096 samples; each is a constant, a fixed linear predictor of order 0 to 2 with Rice-coded residuals,
or verbatim, whichever is shortest. A stream has STREAMINFO with the MD5 of its samples and a SEEKTABLE with one point a
frame. Reading: frame checksums (CRC-8 of the header, CRC-16 of the frame) and the MD5 are verified. Streams whose seek
points cover all frames are read many frames at a time: every unary end in the bits knows the end that follows it, and
those chains are followed in step for all frames. Any other mono stream of up to 24 bits (LPC, Rice partitions, escapes,
wasted bits) goes through a reader that takes one value after another.

A text's payload is its UTF-8 bytes and zero bytes up to a positive multiple of 64; a byte b is the sample b - 128. Null
counts as empty (64 zero bytes). Bad checksums and streams that are cut off raise an error that names the place; null
media give null. Repeated rows are coded one by one, an empty table gives none; columns beyond id and text are left out.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import small_batches, strings, table

BLOCK, RATE, PAD = 4096, 8000, 64
#: Payload bytes that are coded together.
BULK = 512 << 10


def _crc8_table() -> list[int]:
    out = []
    for i in range(256):
        for _ in range(8):
            i = (i << 1) ^ (0x107 if i & 128 else 0)
        out.append(i & 255)
    return out


CRC8 = _crc8_table()


def crc8(data: bytes) -> int:
    c = 0
    for b in data:
        c = CRC8[c ^ b]
    return c


def _crc16_steps() -> list[np.ndarray]:
    """[j][r]: the register r after 2**(j+1) more zero bytes."""
    r = np.arange(65536, dtype=np.uint32)
    for _ in range(16):
        r = np.where(r & 0x8000, (r << 1) ^ 0x18005, r << 1) & 0xFFFF
    steps = [r.astype(np.uint16)]
    for _ in range(14):
        steps.append(steps[-1][steps[-1]])
    return steps


CRC16 = _crc16_steps()


def crc16(buf: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """CRC-16 of many ranges of a buffer: zeros in front don't change it, so ranges of like size are halved together."""
    out = np.zeros(len(starts), np.uint16)
    level = np.maximum(1, np.ceil(np.log2(np.maximum(sizes, 2))).astype(int))
    for c in np.unique(level):
        of = np.flatnonzero(level == c)
        at = (starts[of] + sizes[of] - (1 << c))[:, None] + np.arange(1 << c)
        data = np.where(at >= starts[of][:, None], buf[np.maximum(at, 0)], 0).astype(np.uint16)
        crc = CRC16[0][data[:, 0::2] << 8 | data[:, 1::2]]
        for j in range(c - 1):
            crc = CRC16[j][crc[:, 0::2]] ^ crc[:, 1::2]
        out[of] = crc[:, 0]
    return out


def _coded_number(n: int) -> bytes:
    if n < 128:
        return bytes([n])
    tail = []
    size = 2
    while n >= 1 << (5 * size + 1):
        size += 1
    for _ in range(size - 1):
        tail.append(128 | n & 63)
        n >>= 6
    return bytes([(0xFF00 >> size) & 255 | n, *reversed(tail)])


def _frame_header(number: int, samples: int) -> bytes:
    full = samples == BLOCK
    head = bytes([0xFF, 0xF8, 0xC4 if full else 0x74, 0x02]) + _coded_number(number) + (b"" if full else struct.pack(">H", samples - 1))
    return head + bytes([crc8(head)])


def payload(text: str | None) -> bytes:
    data = (text or "").encode()
    return data + bytes(-len(data) % PAD if data else PAD)


def encode(payloads: list[bytes]) -> list[bytes]:
    """One stream for each payload (of at least 16 bytes)."""
    out: list[bytes] = []
    at = 0
    while at < len(payloads):
        end, held = at, 0
        while end < len(payloads) and (end == at or held + len(payloads[end]) <= BULK):
            held += len(payloads[end])
            end += 1
        out += _encode(payloads[at:end])
        at = end
    return out


def _encode(payloads: list[bytes]) -> list[bytes]:
    x = np.frombuffer(b"".join(payloads), np.uint8).astype(np.int32) - 128
    counts = [-(-len(p) // BLOCK) for p in payloads]
    sizes = np.array([min(BLOCK, len(p) - i) for p in payloads for i in range(0, len(p), BLOCK)])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    heads = [_frame_header(i, n) for i, n in zip((i for c in counts for i in range(c)), sizes.tolist())]
    # Residuals of the fixed predictors; warm-up samples count in none.
    e1 = np.diff(x, prepend=0)
    e2 = np.diff(e1, prepend=0)
    residuals = np.stack([x, e1, e2])
    cost = np.abs(residuals)
    cost[:, starts] = 0
    cost[:, starts + 1] = 0
    sums = np.add.reduceat(cost, starts, axis=1)
    order = np.argmin(sums, axis=0)
    e = np.take_along_axis(residuals, np.repeat(order, sizes)[None], 0)[0]
    u = (e << 1) ^ (e >> 31)
    within = np.arange(len(x)) - np.repeat(starts, sizes)
    coded = within >= np.repeat(order, sizes)
    mean = np.add.reduceat(np.where(coded, u, 0), starts) / np.maximum(1, sizes - order)
    k = np.clip(np.floor(np.log2(np.maximum(mean * 0.6931, 1))), 0, 9).astype(np.int32)
    kk = np.repeat(k, sizes)
    lengths = np.where(coded, (u >> kk) + 1 + kk, 0)
    rice = np.add.reduceat(lengths, starts)
    constant = (np.maximum.reduceat(x, starts) == np.minimum.reduceat(x, starts))
    verbatim = ~constant & (8 * order + 10 + rice >= 8 * sizes)
    fixed = ~constant & ~verbatim
    body = np.where(constant, 8, np.where(verbatim, 8 * sizes, 8 * order + 10 + rice))
    head_bytes = np.array([len(h) for h in heads])
    frame_bytes = head_bytes + 1 + (body + 7) // 8 + 2
    frame_starts = np.concatenate([[0], np.cumsum(frame_bytes)[:-1]])
    bits = np.zeros(8 * int(frame_bytes.sum()), np.uint8)
    rice_starts = 8 * (frame_starts + head_bytes + 1 + order) + 10
    total = np.cumsum(lengths)
    shift = rice_starts - (total[starts] - lengths[starts])
    chosen = coded & np.repeat(fixed, sizes)
    ends = (total + np.repeat(shift, sizes))[chosen]
    u, kk = u[chosen], kk[chosen]
    bits[ends - kk - 1] = 1
    for b in range(int(kk.max(initial=0))):
        on = (kk > b) & (u >> b & 1 == 1)
        bits[ends[on] - 1 - b] = 1
    for b in range(4):
        bits[rice_starts[fixed] - 1 - b] = k[fixed] >> b & 1
    buf = np.packbits(bits)
    for i, (at, head, start, n, o) in enumerate(zip(frame_starts.tolist(), heads, starts.tolist(), sizes.tolist(), order.tolist())):
        buf[at : at + len(head)] = np.frombuffer(head, np.uint8)
        at += len(head)
        if fixed[i]:
            buf[at] = (8 | o) << 1
            buf[at + 1 : at + 1 + o] = x[start : start + o] & 255
        elif constant[i]:
            buf[at + 1] = x[start] & 255
        else:
            buf[at] = 2
            buf[at + 1 : at + 1 + n] = x[start : start + n] & 255
    crc = crc16(buf, frame_starts, frame_bytes - 2)
    buf[frame_starts + frame_bytes - 2] = crc >> 8
    buf[frame_starts + frame_bytes - 1] = crc & 255
    out, first, sample = [], 0, 0
    for data, c in zip(payloads, counts):
        own = slice(first, first + c)
        begin, sizes_ = int(frame_starts[first]), frame_bytes[own]
        md5 = hashlib.md5(bytes(np.frombuffer(data, np.uint8) ^ 128)).digest()
        info = struct.pack(">HH", BLOCK, BLOCK) + int(sizes_.min()).to_bytes(3, "big") + int(sizes_.max()).to_bytes(3, "big") + (RATE << 44 | 0 << 41 | 7 << 36 | len(data)).to_bytes(8, "big") + md5
        points = b"".join(struct.pack(">QQH", BLOCK * i, int(frame_starts[first + i]) - begin, int(sizes[first + i])) for i in range(c))
        out.append(b"fLaC" + b"\x00" + (34).to_bytes(3, "big") + info + b"\x83" + len(points).to_bytes(3, "big") + points + buf[begin : begin + int(sizes_.sum())].tobytes())
        first += c
    return out


class Stream:
    """Metadata of a stream: depth, samples, md5, where frames begin, and the seek points (sample, byte offset, samples)."""

    def __init__(self, data: bytes):
        if data[:4] != b"fLaC":
            raise ValueError("no FLAC stream")
        at, last, self.points, info = 4, False, [], None
        while not last:
            last, kind, size = bool(data[at] & 128), data[at] & 127, int.from_bytes(data[at + 1 : at + 4], "big")
            block = data[at + 4 : at + 4 + size]
            if len(block) < size:
                raise ValueError(f"metadata cut off at byte {at}")
            if kind == 0:
                info = block
            elif kind == 3:
                self.points = [p for p in struct.iter_unpack(">QQH", block) if p[0] != 0xFFFFFFFFFFFFFFFF]
            at += 4 + size
        if info is None:
            raise ValueError("no STREAMINFO")
        packed = int.from_bytes(info[10:18], "big")
        self.rate, self.channels, self.depth, self.samples = packed >> 44, (packed >> 41 & 7) + 1, (packed >> 36 & 31) + 1, packed & (1 << 36) - 1
        self.block, self.md5, self.frames_at, self.data = struct.unpack(">H", info[2:4])[0], info[18:34], at, data


class Bits:
    def __init__(self, data: bytes, at: int):
        self.data, self.at = data, 8 * at

    def read(self, n: int) -> int:
        if self.at + n > 8 * len(self.data):
            raise ValueError(f"stream cut off at byte {len(self.data)}")
        a, b = self.at >> 3, (self.at + n + 7) >> 3
        self.at += n
        return int.from_bytes(self.data[a:b], "big") >> (-self.at & 7) & (1 << n) - 1

    def signed(self, n: int) -> int:
        v = self.read(n)
        return v - (1 << n) if n and v >> (n - 1) else v

    def unary(self) -> int:
        n = 0
        while not self.read(1):
            n += 1
        return n


def _header(data: bytes, at: int, depth: int) -> tuple[int, int, int]:
    """(header bytes, samples, coded number) of the frame at a byte; its CRC-8 is verified."""
    if data[at] != 0xFF or data[at + 1] & 0xFC != 0xF8:
        raise ValueError(f"no frame at byte {at}")
    size_code, rate_code, bits = data[at + 2] >> 4, data[at + 2] & 15, data[at + 3] >> 1 & 7
    if data[at + 3] >> 4 or bits and {1: 8, 2: 12, 4: 16, 5: 20, 6: 24}.get(bits) != depth:
        raise ValueError(f"only mono frames of the stream's depth are read; byte {at}")
    lead = data[at + 4]
    extra = 0 if lead < 128 else (lead ^ 255).bit_length()
    n = 1 if lead < 128 else 8 - extra
    number = lead if lead < 128 else lead & (1 << (7 - n)) - 1
    for b in data[at + 5 : at + 4 + n]:
        number = number << 6 | b & 63
    end = at + 4 + n
    if size_code == 6:
        samples, end = data[end] + 1, end + 1
    elif size_code == 7:
        samples, end = int.from_bytes(data[end : end + 2], "big") + 1, end + 2
    else:
        samples = 192 if size_code == 1 else 576 << (size_code - 2) if size_code < 6 else 256 << (size_code - 8)
    end += {12: 1, 13: 2, 14: 2}.get(rate_code, 0)
    if crc8(data[at:end]) != data[end]:
        raise ValueError(f"header checksum of the frame at byte {at}")
    return end + 1 - at, samples, number


FIXED = [[], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1]]


def _subframe(bits: Bits, n: int, depth: int) -> list[int]:
    bits.read(1)
    kind = bits.read(6)
    wasted = bits.unary() + 1 if bits.read(1) else 0
    depth -= wasted
    if kind == 0:
        out = [bits.signed(depth)] * n
    elif kind == 1:
        out = [bits.signed(depth) for _ in range(n)]
    elif 8 <= kind <= 12 or kind >= 32:
        order = kind - 8 if kind < 32 else kind - 31
        out = [bits.signed(depth) for _ in range(order)]
        factors, shift = FIXED[order] if kind < 32 else None, 0
        if factors is None:
            precision, shift = bits.read(4) + 1, bits.signed(5)
            factors = [bits.signed(precision) for _ in range(order)]
        wide = 5 if bits.read(2) else 4
        parts = 1 << bits.read(4)
        for part in range(parts):
            k = bits.read(wide)
            raw = bits.read(5) if k == (1 << wide) - 1 else None
            for _ in range(n // parts - (order if part == 0 else 0)):
                if raw is not None:
                    e = bits.signed(raw)
                else:
                    u = bits.unary() << k | bits.read(k)
                    e = u >> 1 ^ -(u & 1)
                out.append(e + (sum(f * s for f, s in zip(factors, reversed(out[len(out) - order :]))) >> shift))
    else:
        raise ValueError(f"reserved subframe type {kind}")
    return [s << wasted for s in out] if wasted else out


def decode_one(data: bytes) -> np.ndarray:
    """Samples of any mono stream, one value after another."""
    s = Stream(data)
    if s.channels != 1:
        raise ValueError("only mono streams are read")
    at, out = s.frames_at, []
    while at < len(data):
        size, n, _ = _header(data, at, s.depth)
        bits = Bits(data, at + size)
        out += _subframe(bits, n, s.depth)
        end = (bits.at + 7) // 8
        if int(crc16(np.frombuffer(data, np.uint8), np.array([at]), np.array([end - at]))[0]) != int.from_bytes(data[end : end + 2], "big"):
            raise ValueError(f"checksum of the frame at byte {at}")
        at = end + 2
    out = np.array(out, np.int64)
    width = (s.depth + 7) // 8
    raw = out.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()
    if s.md5 != bytes(16) and hashlib.md5(raw).digest() != s.md5 or s.samples and s.samples != len(out):
        raise ValueError("the samples' MD5 or number isn't the stream's")
    return out


def decode(streams: list[bytes]) -> list[bytes]:
    """Payload bytes (sample + 128) of each 8-bit mono stream."""
    out: list[bytes] = []
    at = 0
    while at < len(streams):
        end, held = at, 0
        while end < len(streams) and (end == at or held + len(streams[end]) <= BULK):
            held += len(streams[end])
            end += 1
        out += _decode(streams[at:end])
        at = end
    return out


def _slow(data: bytes) -> bytes:
    return (decode_one(data) + 128).astype(np.uint8).tobytes()


def _decode(streams: list[bytes]) -> list[bytes]:
    parsed = [Stream(d) for d in streams]
    simple = [s.depth == 8 and s.channels == 1 and s.points and sum(p[2] for p in s.points) == s.samples and s.points[0][1] == 0 for s in parsed]
    base = np.concatenate([[0], np.cumsum([len(d) for d in streams])])
    buf = np.frombuffer(b"".join(streams) + bytes(4), np.uint8)
    frames, ok = [], []  # frame: stream, byte, end, first bit of the Rice codes or -1, samples, order, k
    for i, (s, good) in enumerate(zip(parsed, simple)):
        own = []
        if good:
            ends = [p[1] for p in s.points[1:]] + [len(s.data) - s.frames_at]
            for (_, offset, n), end in zip(s.points, ends):
                at = s.frames_at + offset
                size, samples, _ = _header(s.data, at, 8)
                kind = s.data[at + size]
                order = (kind >> 1) - 8
                if samples != n or kind & 129 or not (kind in (0, 2) or 0 <= order <= 2):
                    break
                where, k = -1, 0
                if kind not in (0, 2):
                    first = at + size + 1 + order
                    code = int.from_bytes(s.data[first : first + 2], "big") >> 6
                    k = code & 15
                    if code >> 4 or k > 9:  # partitions, or parameters that this encoder doesn't write
                        break
                    where = 8 * (int(base[i]) + first) + 10
                own.append((i, int(base[i]) + at, int(base[i]) + s.frames_at + end, where, n, order, k, size))
        ok.append(len(own) == len(s.points) > 0)
        if ok[-1]:
            frames += own
    bodies: dict[int, list] = {i: [] for i in range(len(streams))}
    if frames:
        starts, ends = np.array([f[1] for f in frames]), np.array([f[2] for f in frames])
        want = buf[ends - 2].astype(np.uint16) << 8 | buf[ends - 1]
        if (bad := np.flatnonzero(crc16(buf, starts, ends - starts - 2) != want)).size:
            raise ValueError(f"checksum of the frame at byte {frames[bad[0]][1] - int(base[frames[bad[0]][0]])}")
        rice = _rice(buf, [f for f in frames if f[3] >= 0])
        for i, at, _, where, n, order, _, size in frames:
            if where < 0:
                own = np.full(n, buf[at + size + 1]) if buf[at + size] == 0 else buf[at + size + 1 : at + size + 1 + n]
                bodies[i].append(own)
                continue
            e = next(rice)
            warm = buf[at + size + 1 : at + size + 1 + order].view(np.int8).astype(np.int64)
            if order == 1:
                e = np.cumsum(np.concatenate([warm, e]))
            elif order == 2:
                e = np.cumsum(np.concatenate([warm[:1], np.cumsum(np.concatenate([[warm[1] - warm[0]], e]))]))
            bodies[i].append((e & 255).astype(np.uint8))
    out = []
    for i, s in enumerate(parsed):
        if not ok[i]:
            out.append(_slow(s.data))
            continue
        signed = np.concatenate(bodies[i])
        if hashlib.md5(signed).digest() != s.md5:
            raise ValueError("the samples' MD5 isn't the stream's")
        out.append((signed ^ 128).tobytes())
    return out


def _rice(buf: np.ndarray, frames: list[tuple]) -> Iterator[np.ndarray]:
    """Residuals of each frame. Chains of unary ends are followed for all frames in step, longest frames first."""
    if not frames:
        return iter(())
    bits = np.unpackbits(buf)
    ones = np.flatnonzero(bits).astype(np.int32)
    rank = np.cumsum(bits, dtype=np.int32)
    start, k = np.array([f[3] for f in frames]), np.array([f[6] for f in frames])
    n = np.array([f[4] - f[5] for f in frames])
    # Each one bit's parameter is that of its frame; bits between frames don't matter.
    of = np.zeros(len(ones), np.int32)
    edges = rank[start - 1]
    of[: edges[0]] = k[0]
    of[edges[0] :] = np.repeat(k.astype(np.int32), np.diff(np.append(edges, len(ones))))
    of += ones
    following = rank[np.minimum(of, len(bits) - 1, out=of)]
    np.minimum(following, len(ones) - 1, out=following)
    by = np.argsort(-n, kind="stable")
    now, steps = edges[by].copy(), np.empty((int(n.max(initial=0)), len(frames)), np.int32)
    active = len(frames) - np.searchsorted(np.sort(n), np.arange(len(steps)), side="right")
    for i, a in enumerate(active.tolist()):
        steps[i, :a] = now[:a]
        now[:a] = following[now[:a]]
    place = np.empty(len(by), np.int64)
    place[by] = np.arange(len(by))
    columns = np.ascontiguousarray(steps.T)

    def residuals():
        for i in range(len(frames)):
            own_k = int(k[i])
            ends = ones[columns[place[i], : n[i]]]
            unary = np.diff(ends, prepend=start[i] - own_k - 1) - own_k - 1
            at = ends + 1
            byte = at >> 3
            window = buf[byte].astype(np.int64) << 8 | buf[byte + 1]
            low = window >> (16 - (at & 7) - own_k) & (1 << own_k) - 1
            u = unary << own_k | low
            yield u >> 1 ^ -(u & 1)

    return residuals()


def features(data: bytes) -> str:
    """Mean, root mean square and sign changes of the samples."""
    x = np.frombuffer(data, np.uint8).astype(np.int64) - 128
    return f"mean={int(x.sum()) / len(x):.4f} rms={(int((x * x).sum()) / len(x)) ** 0.5:.4f} crossings={int(((x[1:] < 0) != (x[:-1] < 0)).sum())}"


def store(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_bytes, media (a FLAC stream)."""
    small_batches(df.sparkSession)

    def run(batches):
        for batch in batches:
            texts = strings(batch.column(1))
            media = encode([payload(t) for t in texts])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(media, pa.binary())], [id_col, "n_bytes", "media"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, media binary")


def pcm_blocks(df: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """Per frame: id, block, sample_offset, frame_offset (byte of the stream where reading can begin), pcm (unsigned bytes)."""
    small_batches(df.sparkSession)

    def run(batches):
        for batch in batches:
            media = batch.column(1).to_pylist()
            rows = []
            known = [m for m in media if m is not None]
            back = iter(decode(known))
            for i, m in enumerate(media):
                if m is None:
                    continue
                data, s, at = next(back), Stream(m), 0
                offsets = {p[0]: s.frames_at + p[1] for p in s.points}
                for j, a in enumerate(range(0, len(data), s.block or BLOCK)):
                    rows.append((i, j, a, offsets.get(a), data[a : a + (s.block or BLOCK)]))
            i, j, a, o, pcm = zip(*rows) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(i, pa.int64())), pa.array(j, pa.int32()), pa.array(a, pa.int64()), pa.array(o, pa.int64()), pa.array(pcm, pa.binary())], [id_col, "block", "sample_offset", "frame_offset", "pcm"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, media_col).mapInArrow(run, f"`{id_col}` {kind}, block int, sample_offset long, frame_offset long, pcm binary")


def digests(stored: DataFrame) -> DataFrame:
    """What is read back from stored(doc_id, n_bytes, media)."""
    small_batches(stored.sparkSession)
    sha = lambda x: hashlib.sha256(x).hexdigest()
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches):
        for batch in batches:
            media = batch.column(2).to_pylist()
            back = decode(media)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(map(len, back), pa.int64()), pa.array(map(sha, back), pa.string()), pa.array((zlib.crc32(p[-PAD:]) for p in back), pa.int64()), pa.array(map(len, media), pa.int64()), pa.array(map(sha, media), pa.string()), pa.array(map(features, back), pa.string())], names)

    return stored.select("doc_id", "n_bytes", "media").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op8_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(store(table(spark, sf_dir, "documents")))
