"""SimHash near duplicates by multi-index hashing.

A 64-bit fingerprint is cut into two halves. Two fingerprints that differ in at most three bits differ in at most one
bit of one of the halves, so each half probes the table of its own kind with the 33 values of its Hamming ball of radius
one, and every match is verified over all 64 bits. Equal fingerprints are merged before that. Matches are united within
their table entry (each linked to one other of its class, never all pairs), and the links' components are the groups.

An entry that many different fingerprints share or probe (near copies of one text) is divided further: among those that
differ in at most three bits of the other half, one of its four bytes agrees, or two of five pieces, three of six, five of
eight; the more members, the finer the pieces. This loses no link.

Null and wordless texts have fingerprint zero and are linked like any other. Repeated rows keep their own result rows,
an empty table gives none; columns beyond id and text are left out.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_key, checkpointed, discard, small_batches, stored, strings, table
from .components import connected_components

RADIUS = 3
#: Table entries with more members than this are divided by pieces of the other half, so many of them.
DIVISIONS = [(512, 4), (1 << 15, 5), (1 << 19, 6), (1 << 22, 8)]


def fingerprint(text: str, shingle: int = 3, seed: int = 42) -> int:
    """Majority of each bit over the XXH64 of all word shingles, repeats included; A-Z count as a-z."""
    words = text.encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(joined, seed)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], seed) for a, b in zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist())]
    ones = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp long) of each row."""
    small_batches(df.sparkSession)

    def run(batches):
        for batch in batches:
            found = np.array([fingerprint(t, shingle) for t in strings(batch.column(1))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], [id_col, "fp"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, fp long")


def spanning_links(bits: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Index pairs that connect the rows of `bits` (words of fingerprints) as all pairs within the radius would.

    Breadth first; what was reached isn't compared again, so a group of near copies costs about one pass over it.
    """
    links, left = [], np.arange(len(bits))
    while len(left) > 1:
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            i = queue.pop()
            near = np.bitwise_count(bits[left] ^ bits[i]).sum(1, dtype=np.int32) <= radius
            if near.any():
                found = left[near].tolist()
                links += [(j, i) for j in found]
                queue += found
                left = left[~near]
    return links


#: Entries of up to so many rows are compared together, each row with the next one, the one after next, and so on.
SHORT = 24


def linked(keyed: DataFrame, radius: int, words: int = 1) -> DataFrame:
    """keyed(table, key, part, node long[, bits binary]) -> links(u, v) of nodes that share an entry and differ in at most
    `radius` bits, as many as connect them. With words = 1 the node is its own fingerprint."""

    def run(batches):
        """Rows come sorted by entry; an entry may go on in the next batch."""
        held: list[pa.RecordBatch] = []

        def links(t: pa.Table, last: bool):
            entry = [t.column(c).to_numpy() for c in ("table", "key", "part")]
            change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in entry], axis=0)) + 1
            bounds = np.array([0, *change, *([t.num_rows] if last else [])])
            node = t.column("node").to_numpy()
            bits = node.view(np.uint64)[:, None] if words == 1 else np.frombuffer(b"".join(t.column("bits").to_pylist()), "<u8").reshape(-1, words)
            sizes = np.diff(bounds)
            done = int(bounds[-1])
            end = np.repeat(bounds[1:], sizes)
            short = np.repeat(sizes <= SHORT, sizes)
            pairs = []
            for d in range(1, min(SHORT, int(sizes.max(initial=0)))):
                i = np.flatnonzero(short & (np.arange(done) + d < end))
                for a in range(0, len(i), 1 << 17):
                    own = i[a : a + (1 << 17)]
                    near = own[np.bitwise_count(bits[own] ^ bits[own + d]).sum(1, dtype=np.int32) <= radius]
                    pairs.append((node[near], node[near + d]))
            for a, b in zip(bounds[:-1][sizes > SHORT].tolist(), bounds[1:][sizes > SHORT].tolist()):
                if found := spanning_links(bits[a:b], radius):
                    i, j = np.array(found).T + a
                    pairs.append((node[i], node[j]))
            u, v = (np.concatenate(x) for x in zip(*pairs)) if pairs else (np.zeros(0, np.int64),) * 2
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"]), done

        def key(batch: pa.RecordBatch, i: int):
            return [batch.column(c)[i].as_py() for c in ("table", "key", "part")]

        for batch in batches:
            if not batch.num_rows:
                continue
            if held and key(held[-1], -1) != key(batch, 0) or key(batch, 0) != key(batch, -1):
                t = pa.Table.from_batches([*held, batch])
                out, done = links(t, False)
                yield out
                held = [b for b in t.slice(done).to_batches() if b.num_rows]
            else:
                held.append(batch)
        if held:
            yield links(pa.Table.from_batches(held), True)[0]

    return keyed.repartition("table", "key", "part").sortWithinPartitions("table", "key", "part").mapInArrow(run, "u long, v long")


def fingerprint_links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """fps(fp), distinct -> links(u, v) with the components of all pairs within the radius (three at most)."""
    return linked(divided(entries(fps)), radius)


def entries(fps: DataFrame) -> DataFrame:
    """-> (table, key, node): every fingerprint under its own halves, and under those at one bit from them that some other has."""
    halves = F.array(F.struct(F.lit(0).alias("table"), F.shiftrightunsigned("fp", 32).alias("key")), F.struct(F.lit(1).alias("table"), F.col("fp").bitwiseAND(0xFFFFFFFF).alias("key")))
    stored = fps.select("fp", F.inline(halves))
    known = stored.select("table", "key").distinct()
    flips = F.array(*[F.lit(1 << i).cast("long") for i in range(32)])
    probes = stored.select("fp", "table", "key", F.explode(flips).alias("flip")).select("fp", "table", F.col("key").bitwiseXOR(F.col("flip")).alias("key"))
    # Only probes that meet a table entry go on; both sides are spread over the 2**32 values of a half.
    return stored.union(probes.select("fp", "table", "key")).join(by_key(known), ["table", "key"]).select("table", "key", F.col("fp").alias("node"))


def divided(members: DataFrame) -> DataFrame:
    """members with the column `part`; entries of many members, probes included, are parted by bits of the other half.

    Of m pieces of that half three differing bits leave m - 3 equal, so each member goes under every choice of m - 3 pieces.
    """
    members = checkpointed(members)
    counts = members.groupBy("table", "key").agg(F.count("*").alias("n"))
    other = F.when(F.col("table") == 0, F.col("node").bitwiseAND(0xFFFFFFFF)).otherwise(F.shiftrightunsigned("node", 32))
    choices, number = F.array(F.lit(0).cast("long")), 1
    for over, pieces in DIVISIONS:
        cuts = [32 * i // pieces for i in range(pieces + 1)]
        masks = [sum((1 << cuts[i + 1]) - (1 << cuts[i]) for i in own) for own in combinations(range(pieces), pieces - RADIUS)]
        parts = [other.bitwiseAND(m).bitwiseOR(F.lit((number + i) << 32).cast("long")) for i, m in enumerate(masks)]
        number += len(masks)
        choices = F.when(F.col("n") > over, F.array(*parts)).otherwise(choices)
    return members.join(by_key(counts), ["table", "key"]).select("table", "key", "node", F.explode(choices).alias("part"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = RADIUS) -> DataFrame:
    """(id, fp long, component_id): component_id is the least id reachable over links of at most `radius` bits."""
    prints = checkpointed(fingerprints(df, id_col, text_col, shingle))
    classes = prints.groupBy("fp").agg(F.min(id_col).alias("least"))
    grouped = connected_components(fingerprint_links(classes.select("fp"), radius))
    roots = classes.join(by_key(grouped), classes.fp == grouped.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    least = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(by_key(roots.join(by_key(least), "root").select("fp", "component_id")), "fp").select(id_col, "fp", "component_id")


# Similarity of 0.8 is often beyond three bits of 64. It is counted exactly, on the sets of five-word shingles.

#: Texts that are looked at for frequent shingles, and how many of those are known at most. Neither changes what is found.
SAMPLE, FREQUENT = 16384, 65536


def shingles(text: str, size: int = 5) -> set[tuple]:
    """Distinct word shingles; a shorter text is one shingle, a wordless one has none. A-Z count as a-z."""
    words = text.encode().lower().split()
    return set(zip(*(words[i:] for i in range(size)))) if len(words) >= size else {tuple(words)} - {()}


def shingle_hashes(text: str, size: int = 5) -> np.ndarray:
    """64-bit hashes of the distinct shingles, ascending."""
    words = text.encode().lower().split()
    known: dict[bytes, int] = {}
    h = np.fromiter((known[w] if w in known else known.setdefault(w, xxhash.xxh64_intdigest(w, 42)) for w in words), np.uint64, len(words))
    size = min(size, max(1, len(words)))
    n = len(h) - size + 1 if len(h) else 0
    x = np.full(n, size, np.uint64)
    for i in range(size):
        x = (x ^ h[i : n + i]) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return np.unique((x ^ (x >> np.uint64(31))).view(np.int64))


def set_number(hashes: np.ndarray) -> int:
    """Texts of equal sets have equal numbers."""
    return int(np.int64(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes(), 7)).view(np.int64)))


def frequent_shingles(texts: DataFrame, text_col: str, rows: int) -> np.ndarray:
    """Hashes of shingles that several texts of a sample hold, the rarer first."""

    def run(batches):
        for batch in batches:
            found = [shingle_hashes(t) for t in strings(batch.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *found]))], ["key"])

    part = texts.sample(min(1.0, SAMPLE / max(1, rows)), 42) if rows > SAMPLE else texts
    counts = part.select(text_col).mapInArrow(run, "key long").groupBy("key").count().where("count > 2")
    found = counts.orderBy(F.desc("count"), "key").limit(FREQUENT).collect()
    return np.array([r["key"] for r in reversed(found)], np.int64)


def shared_keys(texts: DataFrame, text_col: str, frequent: np.ndarray, similarity: float) -> DataFrame:
    """-> distinct (key, set, n, at): keys that several sets hold, one for the same sets; two sets of at least this similarity share one.

    Shingles have one order in all texts, the frequent ones last. Of n shingles only the first n - ceil(similarity * n) + 1
    are keys, whatever the order is (prefix filter); `at` is a key's place in that order.
    """
    order = np.argsort(frequent)
    by_hash = frequent[order]

    def keys(batches):
        for batch in batches:
            found, sizes, places, sets = [], [], [], []
            for t in strings(batch.column(0)):
                h = shingle_hashes(t)
                sets.append(set_number(h))
                if len(frequent):
                    at = np.minimum(np.searchsorted(by_hash, h), len(by_hash) - 1)
                    often = by_hash[at] == h
                    h = np.concatenate([h[~often], frequent[np.sort(order[at[often]])]])
                kept = len(h) - math.ceil(similarity * len(h) - 1e-9) + 1 if len(h) else 0
                found.append(h[:kept])
                sizes.append(len(h))
                places.append(np.arange(kept, dtype=np.int32))
            counts = [len(x) for x in found]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *found])), pa.array(np.repeat(np.array(sets, np.int64), counts)), pa.array(np.repeat(np.array(sizes, np.int32), counts)), pa.array(np.concatenate([np.zeros(0, np.int32), *places]))], ["key", "set", "n", "at"])

    # Repeated texts give equal rows, which go where the keys are; the rows are exchanged once.
    keyed = texts.select(text_col).mapInArrow(keys, "key long, set long, n int, at int").repartition("key").distinct()
    held = keyed.groupBy("key").agg(F.min("set").alias("least"), F.max("set").alias("most"), F.count("*").alias("sets"), F.expr("bit_xor(xxhash64(set))").alias("hash"), F.sum("n").alias("size"), F.min("at").alias("at")).where("least <> most")
    # Of the keys that the same sets hold the first bounds each pair best, and the others tell nothing more.
    firsts = held.groupBy("least", "most", "sets", "hash", "size").agg(F.min(F.struct("at", "key")).alias("first")).select("first.key")
    return keyed.join(by_key(firsts), "key", "left_semi")


def several(keyed: DataFrame, what: str) -> DataFrame:
    """The rows of keys under which `what` has more than one value."""
    keys = keyed.groupBy("key").agg(F.min(what).alias("least"), F.max(what).alias("most")).where("least <> most").select("key")
    return keyed.join(by_key(keys), "key", "left_semi")


def parity(hashes: np.ndarray) -> bytes:
    """Which of 64 to 4096 places an odd number of the hashes falls on; four places a hash where they are enough.

    Two such maps differ in no more places than the sets differ in members, and halves laid over each other (by
    exclusive or) are the map of half the places.
    """
    places = min(4096, max(64, 1 << (4 * len(hashes) - 1).bit_length())) if len(hashes) else 64
    odd = np.bincount(hashes.view(np.uint64).astype(np.int64) & (places - 1), minlength=places) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def proposed(keyed: DataFrame, similarity: float, every: bool) -> DataFrame:
    """keyed(key, node, n, at, part[, parity]) -> (u, v), u < v, of different parts that may be similar enough.

    Bounds from above are the lengths of the sets, the places of the shared key and the parity maps; none leaves out a pair
    of at least this similarity. Without `every`, of each node's pairs with lesser nodes only that of the best bound.
    """
    mapped = "parity" in keyed.columns
    most = (1 - similarity) / (1 + similarity)

    def pairs(t: pa.Table):
        key, node, n, at, part = (t.column(c).to_numpy() for c in ("key", "node", "n", "at", "part"))
        change = np.flatnonzero(key[1:] != key[:-1]) + 1
        bounds = np.array([0, *change, t.num_rows])
        end = np.repeat(bounds[1:], np.diff(bounds))

        def batch(j: np.ndarray, bound: np.ndarray, u: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(node[j], pa.int64()), pa.array(bound, pa.float64()), pa.array(u, pa.int64())], ["v", "bound", "u"])

        n, at = n.astype(np.int64), at.astype(np.int64)
        maps, width = {}, None
        if mapped:
            width = pc.binary_length(t.column("parity")).to_numpy()
            raw = t.column("parity").to_pylist()
            for w in sorted({*width.tolist()}, reverse=True):
                # Wider maps are folded to this width; narrower ones aren't compared at it.
                own = np.zeros((t.num_rows, w // 8), np.uint64)
                at_w = np.flatnonzero(width == w)
                own[at_w] = np.frombuffer(b"".join(raw[i] for i in at_w.tolist()), "<u8").reshape(-1, w // 8)
                wider = min((x for x in maps if x > w), default=None)
                if wider is not None:
                    over, x = np.flatnonzero(width > w), maps[wider]
                    folded = x[over]
                    while folded.shape[1] > w // 8:
                        half = folded.shape[1] // 2
                        folded = folded[:, :half] ^ folded[:, half:]
                    own[over] = folded
                maps[w] = own
        # Of rows i and i + d of one key the latter has the larger node.
        best, partner = np.full(t.num_rows, np.inf), np.zeros(t.num_rows, np.int64)
        held, active = [], np.arange(t.num_rows)
        for d in range(1, int(np.diff(bounds).max(initial=0))):
            active = active[active + d < end[active]]
            for a in range(0, len(active), 1 << 14):
                i = active[a : a + (1 << 14)]
                i = i[part[i] != part[i + d]]
                j = i + d
                both = n[i] + n[j]
                fits = (np.minimum(n[i], n[j]) >= np.maximum(n[i], n[j]) * similarity - 1e-9) & (np.minimum(n[i] - at[i], n[j] - at[j]) >= both * (similarity / (1 + similarity)) - 1e-9)
                i, j, both = i[fits], j[fits], both[fits]
                apart = np.abs(n[i] - n[j])
                if mapped and len(i):
                    common = np.minimum(width[i], width[j])
                    for w in np.unique(common).tolist():
                        of = np.flatnonzero(common == w)
                        apart[of] = np.bitwise_count(maps[w][i[of]] ^ maps[w][j[of]]).sum(1, dtype=np.int64)
                    near = apart <= both * most + 1e-9
                    i, j, both, apart = i[near], j[near], both[near], apart[near]
                if every:
                    held.append((j, apart / both, node[i]))
                    if sum(len(x[0]) for x in held) > 1 << 18:
                        yield batch(*(np.concatenate(x) for x in zip(*held)))
                        held = []
                else:
                    better = apart / both < best[j]
                    best[j[better]], partner[j[better]] = (apart / both)[better], node[i[better]]
        if held:
            yield batch(*(np.concatenate(x) for x in zip(*held)))
        if not every:
            v = np.flatnonzero(np.isfinite(best))
            yield batch(v, best[v], partner[v])

    def run(batches):
        """Rows come sorted by key and node; a key may go on in the next batch."""
        held, rows = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            if rows >= 16384 and held[0].column(0)[0] != batch.column(0)[-1]:
                t = pa.Table.from_batches(held).combine_chunks()
                key = t.column("key").to_numpy()
                cut = int(np.searchsorted(key, key[-1]))
                yield from pairs(t.slice(0, cut))
                held = t.slice(cut).to_batches()
                rows = t.num_rows - cut
        if held:
            yield from pairs(pa.Table.from_batches(held).combine_chunks())

    columns = ["key", "node", "n", "at", "part"] + ["parity"] * mapped
    found = keyed.select(*columns).repartition("key").sortWithinPartitions("key", "node").mapInArrow(run, "v long, bound double, u long")
    if every:
        return found.select("u", "v").distinct()
    return found.groupBy("v").agg(F.min(F.struct("bound", "u")).alias("best")).select(F.col("best.u").alias("u"), "v")


def similar(docs: DataFrame, row_col: str, text_col: str = "text", id_col: str = "doc_id", similarity: float = 0.8, radius: int | None = None) -> DataFrame:
    """(row, id, component): component is the row (of the least id) that stands for the group of a text's near copies.

    Linked are exactly the texts whose sets of five-word shingles have at least this Jaccard similarity and, with a radius,
    those whose SimHash fingerprints differ in at most so many bits (op2's groups). Groups are the components of these links.
    Texts of equal sets are one class and compared once. Classes that share a key (`shared_keys`, which leaves out no
    similar pair) and that no link joins yet are counted on the words themselves: one pair a text, then one a text by the
    best bound of the parity maps, then every pair that is still apart and within that bound. So rows grow with the
    table; only the last step's pairs are as many as the pairs of a family that lie closely below the similarity.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def numbers(batches):
        for batch in batches:
            texts = strings(batch.column(2))
            hashes = [shingle_hashes(t) for t in texts]
            fps = np.array([fingerprint(t) if radius is not None else 0 for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([set_number(h) for h in hashes], pa.int64()), pa.array(fps, pa.int64()), pa.array([parity(h) for h in hashes], pa.binary())], ["row", "id", "set", "fp", "parity"])

    rows = docs.select(F.col(row_col).alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    prints, prints_path = stored(rows.mapInArrow(numbers, f"row long, id {kind}, set long, fp long, parity binary"))
    classes = checkpointed(prints.groupBy("set").agg(F.min(F.struct("id", "row")).alias("first")).select("set", F.col("first.row").alias("node"), F.col("first.id").alias("id")))
    shared, shared_path = stored(shared_keys(rows, "text", frequent_shingles(rows, "text", prints.count()), similarity).join(by_key(classes.select("set", "node")), "set").select("key", "node", "n", "at"))

    links = docs.sparkSession.createDataFrame([], "u long, v long")
    if radius is not None:
        fps = prints.select("set", "fp").distinct().join(by_key(classes.select("set", "node")), "set").select("node", "fp")
        roots = connected_components(fingerprint_links(fps.select("fp").distinct(), radius))
        rooted = checkpointed(fps.join(by_key(roots), fps.fp == roots.node, "left").select(fps.node, F.coalesce("component", "fp").alias("root")))
        links = checkpointed(rooted.join(by_key(rooted.groupBy("root").agg(F.min("node").alias("u"))), "root").where("node <> u").select("u", F.col("node").alias("v")))

    def verified(batches):
        last, own = None, set()
        for batch in batches:
            u, v = [], []
            for a, b, x, y in zip(*(c.to_pylist() for c in batch.columns)):
                if a != last:
                    last, own = a, shingles(x or "")
                other = shingles(y or "")
                both = len(own & other)
                if both and both / (len(own) + len(other) - both) >= similarity:
                    u.append(a)
                    v.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    def linked_of(asked: DataFrame) -> DataFrame:
        nodes = asked.select(F.col("u").alias("node")).union(asked.select(F.col("v").alias("node"))).distinct()
        held = rows.select(F.col("row").alias("node"), "text").join(by_key(nodes), "node", "left_semi")
        read = asked.join(by_key(held.select(F.col("node").alias("v"), F.col("text").alias("b"))), "v").join(by_key(held.select(F.col("node").alias("u"), F.col("text").alias("a"))), "u")
        return checkpointed(read.select("u", "v", "a", "b").mapInArrow(verified, "u long, v long"))

    grouped, tried = connected_components(links), None
    for turn in range(3):
        # Only keys that parts share go on.
        parts = shared.join(by_key(grouped), "node", "left").select("key", "node", "n", "at", F.coalesce("component", "node").alias("part"))
        opened, path = stored(several(parts.repartition("key"), "part"))
        discard(docs.sparkSession, shared_path)
        shared_path = path
        if turn:
            maps = prints.join(by_key(classes.select(F.col("node").alias("row"))), "row", "left_semi").select(F.col("row").alias("node"), "parity")
            asked = proposed(opened.join(by_key(maps), "node"), similarity, turn == 2)
        else:
            asked = proposed(opened, similarity, False)
        asked = checkpointed(asked if tried is None else asked.join(by_key(tried), ["u", "v"], "left_anti"))
        if not asked.isEmpty():
            tried = asked if tried is None else tried.union(asked)
            links = links.union(linked_of(asked))
            grouped = connected_components(links)
        shared = opened.drop("part")
    found = classes.join(by_key(grouped), "node", "left").withColumn("root", F.coalesce("component", "node"))
    best = found.groupBy("root").agg(F.min(F.struct("id", "node")).alias("best")).select("root", F.col("best.node").alias("component"))
    rooted = found.select("set", "root").join(by_key(best), "root").select("set", "component")
    result = checkpointed(prints.join(by_key(rooted), "set").select("row", "id", "component"))
    for path in (shared_path, prints_path):
        discard(docs.sparkSession, path)
    return result


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
