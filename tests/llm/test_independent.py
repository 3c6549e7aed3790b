"""Operators without SQL against second implementations that share no code with them: plain, slow, value by value."""

import hashlib
import math
import random
import re

import numpy as np
import pytest

from codeloom.llm import flac, license_scan, secret_scan, sharding, simhash, toxicity


# --- FLAC: a reader of single bits, after the published format
def read_flac(data):
    assert data[:4] == b"fLaC"
    at, last, samples, md5 = 4, False, 0, b""
    while not last:
        last, kind, n = data[at] >> 7, data[at] & 127, int.from_bytes(data[at + 1 : at + 4], "big")
        body = data[at + 4 : at + 4 + n]
        if kind == 0:
            packed = int.from_bytes(body[10:18], "big")
            assert (packed >> 41) & 7 == 0 and (packed >> 36) & 31 == 7  # mono, 8 bits
            samples, md5 = packed & (1 << 36) - 1, body[18:34]
        at += 4 + n
    out = []
    while at < len(data):
        start, bits = at, "".join(f"{b:08b}" for b in data[at : at + 3 * 4096])
        pos = 0

        def take(n):
            nonlocal pos
            pos += n
            return int(bits[pos - n : pos] or "0", 2)

        assert take(15) == 0b111111111111100 and take(1) in (0, 1)
        size, rate, channel, depth, zero = take(4), take(4), take(4), take(3), take(1)
        assert channel == 0 and zero == 0 and depth in (0, 1)
        more = len(re.match("1*", bits[pos : pos + 8])[0])
        take(8 * max(1, more))
        n = {1: 192, 6: None, 7: None}.get(size, 256 << size - 8 if size >= 8 else 576 << max(0, size - 2))
        n = take(8) + 1 if size == 6 else take(16) + 1 if size == 7 else n
        if rate in (12, 13, 14):
            take(8 if rate == 12 else 16)
        take(8)
        take(1)
        kind = take(6)
        assert take(1) == 0

        def signed(k):
            v = take(k)
            return v - (1 << k) if v >> k - 1 else v

        if kind == 0:
            own = [signed(8)] * n
        elif kind == 1:
            own = [signed(8) for _ in range(n)]
        else:
            order = kind - 8
            assert 0 <= order <= 4
            own = [signed(8) for _ in range(order)]
            width, parts = (4, 5)[take(2)], take(4)
            for p in range(1 << parts):
                k, count = take(width), (n >> parts) - (order if p == 0 else 0)
                assert k < (1 << width) - 1
                for _ in range(count):
                    q = bits.index("1", pos) - pos
                    pos += q + 1
                    u = q << k | take(k)
                    e = u >> 1 if u % 2 == 0 else -(u >> 1) - 1
                    x = own
                    own.append(e + (0 if order == 0 else x[-1] if order == 1 else 2 * x[-1] - x[-2] if order == 2 else 3 * x[-1] - 3 * x[-2] + x[-3] if order == 3 else 4 * x[-1] - 6 * x[-2] + 4 * x[-3] - x[-4]))
        pos += -pos % 8
        crc = 0
        for b in data[start : start + pos // 8]:
            crc ^= b << 8
            for _ in range(8):
                crc = (crc << 1 ^ 0x8005) & 0xFFFF if crc & 0x8000 else crc << 1
        assert take(16) == crc
        at = start + pos // 8
        out += own
    assert len(out) == samples and hashlib.md5(np.array(out, np.int8).tobytes()).digest() == md5
    return bytes(s + 128 for s in out)


def test_flac_is_what_another_reader_reads():
    rng = random.Random(1)
    texts = ["", None, "a", "z" * 9000, "Some prose, as it comes. " * 400, "é中 " * 3000, "".join(chr(rng.randrange(1, 0x250)) for _ in range(6000)), "ab" * 4096, "0123456789abcdef" * 300]
    for media, text in zip(flac.encode([flac.payload(t) for t in texts]), texts):
        assert read_flac(media) == flac.payload(text)


def test_flac_of_no_rows_and_of_a_long_text(spark):
    df = spark.createDataFrame([(1, "sentence of a long text. " * 80_000)], "doc_id long, text string")
    assert flac.digests(flac.store(df.limit(0))).count() == 0
    row = flac.digests(flac.store(df)).first()
    data = flac.payload("sentence of a long text. " * 80_000)
    assert (row["n_bytes"], row["payload_sha256"]) == (2_000_000, hashlib.sha256(data).hexdigest())


# --- FTRL, one coordinate after another
def test_ftrl_against_the_published_updates():
    rng = random.Random(3)
    rows = [(np.array(sorted(rng.sample(range(40), rng.randint(1, 12))), np.uint32), rng.randint(0, 1)) for _ in range(150)]
    z, n, zb, nb = {}, {}, 0.0, 0.0
    a, b, l1, l2 = toxicity.ALPHA, toxicity.BETA, toxicity.L1, toxicity.L2

    def weight(i):
        zi = z.get(i, 0.0)
        return 0.0 if abs(zi) <= l1 else -(zi - math.copysign(l1, zi)) / ((b + math.sqrt(n.get(i, 0.0))) / a + l2)

    for _ in range(toxicity.EPOCHS):
        for at, y in rows:
            w = {i: weight(i) for i in at.tolist()}
            bias = -zb / ((b + math.sqrt(nb)) / a)
            g = 1 / (1 + math.exp(-(sum(w.values()) + bias))) - y
            for i, wi in w.items():
                old = n.get(i, 0.0)
                z[i] = z.get(i, 0.0) + g - (math.sqrt(old + g * g) - math.sqrt(old)) / a * wi
                n[i] = old + g * g
            zb += g - (math.sqrt(nb + g * g) - math.sqrt(nb)) / a * bias
            nb += g * g
    weights, bias = toxicity.fit(rows)
    assert np.allclose([weights[i] for i in range(40)], [weight(i) for i in range(40)], atol=1e-9) and not weights[40:].any()
    assert abs(bias + zb / ((b + math.sqrt(nb)) / a)) < 1e-9 and 0 < (weights != 0).sum() < 40


def test_toxicity_of_no_rows(spark, tmp_path):
    d = str(tmp_path)
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    assert toxicity.op6_toxicity(spark, d).count() == 0


# --- shards, one row after another
def test_shards_against_a_walk_over_all_rows(spark):
    rng = random.Random(8)
    texts = ["hot text " * 9] * 150 + [f"t{rng.randrange(60)} " * rng.randint(1, 30) for _ in range(300)] + [None, "", "é" * 50] * 3 + ["x" * 4000]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    got = sorted(tuple(r) for r in sharding.shard(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), 16).select("doc_id", "size", "shard", "slot").collect())
    sized = sorted((hashlib.md5((t or "").encode()).hexdigest(), i, len((t or "").encode()) + 1) for i, t in rows)
    total, at, placed = sum(s for *_, s in sized), 0, []
    for digest, i, s in sized:
        placed.append([digest, i, s, at, min(15, at * 16 // total)])
        at += s
    for digest in {p[0] for p in placed}:
        own = [p for p in placed if p[0] == digest]
        size = sum(p[2] for p in own)
        if own[0][4] < own[-1][4] and size * 16 * 8 <= total:
            for p in own:
                p[4] = min(15, (own[0][3] + size // 2) * 16 // total)
    want, slots = [], {}
    for _, i, s, _, shard in placed:
        want.append((i, s, shard, slots.setdefault(shard, 0)))
        slots[shard] += 1
    assert got == sorted(want)
    bytes_of = {k: sum(s for _, s, shard, _ in want if shard == k) for k in range(16)}
    assert max(bytes_of.values()) - min(bytes_of.values()) <= total / 16 / 4 + 2 * 4001


# --- licences: sentences looked for one by one in the normalised text
def test_license_sequences_against_a_plain_search(spark):
    rng = random.Random(4)
    sentences = license_scan.SENTENCES
    texts = []
    for _ in range(120):
        parts = []
        for _ in range(rng.randint(0, 6)):
            s = sentences[rng.choice(list(sentences))]
            if rng.random() < 0.3:
                s = s.rsplit(" ", 1)[0]  # not the whole sentence
            words = s.split(" ")
            for k in range(0, len(words), 9):
                words[k] = words[k].upper()
            parts.append(rng.choice([" ", "\n# "]).join(words) + rng.choice([".", ";\n", "\n\n"]))
            if rng.random() < 0.4:
                parts.append("some other words here.\n")
        texts.append("".join(p if p[-1] == "\n" else p + " " for p in parts))
    got = {r["doc_id"]: r for r in license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    longest_first = sorted(sentences, key=lambda i: -len(sentences[i]))
    for d, t in enumerate(texts):
        pieces = [re.sub("[^a-z0-9]+", " ", p.lower()).strip() for p in re.split(license_scan.BREAK, t)]
        words, starts, ends = [], set(), set()
        for p in pieces:
            if p:
                starts.add(len(words))
                words += p.split(" ")
                ends.add(len(words))
        found, at = [], 0
        while at < len(words):
            for want in (license_scan.MENTIONS, sentences.keys() - license_scan.MENTIONS):
                hit = next((i for i in longest_first if i in want and words[at : at + len(s := sentences[i].split(" "))] == s and (i not in license_scan.MENTIONS or at in starts and at + len(s) in ends)), None)
                if hit:
                    break
            if hit:
                found.append(hit)
                at += len(sentences[hit].split(" "))
            else:
                at += 1
        left, names = list(found), set()
        for name, rule in license_scan.RULES:
            k = 0
            while k + len(rule) <= len(left):
                if left[k : k + len(rule)] == rule:
                    names.add(name)
                    left[k : k + len(rule)] = [0]
                k += 1
        assert (got[d]["sentence_ids"], got[d]["licenses"]) == (",".join(map(str, found)), ",".join(sorted(names)))


# --- secrets: many matches in one text
def test_secrets_of_a_text_with_many_matches(spark):
    text = "".join(f"token={i:012d}z 0123456789abcdef{i:08x} é " for i in range(20_000))
    row = secret_scan.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (row["n_assign"], row["n_hex"]) == (20_000, 20_000)
    last = row["base_spans"].rsplit(",", 1)[1].split(":")
    assert text[int(last[1]) : int(last[2])] == f"0123456789abcdef{19_999:08x}"
    masked = secret_scan.redacted(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()["text"]
    assert masked == "[SECRET] [SECRET] é " * 20_000


# --- near copies: recall and precision against exact counts
@pytest.mark.parametrize("seed", [1, 2])
def test_recall_of_similar_texts(spark, seed):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(400)]
    texts = []
    for _ in range(60):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(5, 300))]
        for _ in range(rng.randint(1, 4)):
            own = list(words)
            for _ in range(rng.randint(0, max(1, len(words) // 30))):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            texts.append(" ".join(own))
    sets = [simhash.shingles(t) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) and root[i] != root[j]:
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    got = {r["row"]: r["component"] for r in simhash.similar(spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "row long, doc_id long, text string"), "row").collect()}
    assert [got[i] for i in range(len(texts))] == root
