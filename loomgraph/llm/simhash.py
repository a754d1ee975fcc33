"""SimHash near-duplicates by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into three segments, each padded to the 23 bits of the perfect Golay code. The keys of a segment
are the codewords that it and its one-bit neighbours decode to (one or six of them): two segments that differ in at most two
bits share a neighbour and so a key. By the pigeonhole principle two fingerprints that differ in at most two bits agree in
one whole segment, and the next segment differs in at most two bits; so (whole segment, key of the next) finds every link.

Equal fingerprints are one class. In a bucket, links are found without comparing all pairs: two fingerprints are within two
bits exactly if they have a common one-bit neighbour, so the bucket's fingerprints are joined through sorted neighbour lists,
and only a spanning forest of verified links leaves a bucket. Components come from alternating large-star and small-star
steps over settled edge tables; nothing is gathered on the driver.

The pipeline's stage (near_copies) takes these links and, beside them, texts whose shingles of five words are alike by 0.8 or
more, which two bits seldom reach. Their candidates share one of BANDS keys of ROWS least shingle hashes each and are verified
by a sketch of BINS least hashes (its estimate of the similarity errs by 0.025 for long texts, less for short ones). The rows of a
key are sorted by the next key too, so that alike texts lie side by side, dealt by range, so that a large group spreads over many
tasks, and each is compared with the first and the last few before it, which joins large groups in one pass. What share a key and
are in different trees after that are compared block by block, so no candidate is passed over. Of two texts alike by 0.8, 99.7 of
100 share a key.

Null texts have no words, as empty ones; documents without words have fingerprint zero and are linked like any other. Null
doc_ids count as larger than all others when the smallest is sought. Repeated rows stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .bpe import grouped

SHINGLE, SEED, MOST_BITS = 3, 42, 2
#: First bit and bits of each segment.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Fixed value: the generator polynomial of the (23, 12) Golay code.
GENERATOR = 0b101011100011
#: Words whose shingles are counted at once; longer texts are taken in turns.
TURN = 1 << 16
SALTS = 16
#: Near copies: words of a shingle, similarity from which two texts are near copies by the estimate, keys and least hashes of a
#: key, hashes of a sketch, rows that a row is compared with at first, and rows of a block in which the rest are compared.
NEAR_WORDS, ALIKE, BANDS, ROWS, BINS, BEFORE, BLOCK = 5, 0.78, 8, 3, 256, 8, 4096
#: Words whose hashes a worker keeps.
KEPT_WORDS = 250_000
#: Fingerprints of a bucket from which on it is split by the Golay keys of the third segment too, and the part of all
#: fingerprints (one in so many) that shows which buckets those are.
MOST_BUCKET, SHOWN = 20_000, 64


def _remainder(v: int) -> int:
    for bit in range(22, 10, -1):
        if v >> bit & 1:
            v ^= GENERATOR << bit - 11
    return v


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low 12 and high 11 bits, and the error pattern of each syndrome (at most three bits)."""
    low = np.array([_remainder(v) for v in range(1 << 12)], dtype=np.int32)
    high = np.array([_remainder(v << 12) for v in range(1 << 11)], dtype=np.int32)
    bits = [1 << b for b in range(23)]
    errors = [0, *bits, *(a | b for a in bits for b in bits if a < b), *(a | b | c for a in bits for b in bits if a < b for c in bits if b < c)]
    pattern = np.zeros(1 << 11, dtype=np.int32)
    for e in errors:
        pattern[low[e & 0xFFF] ^ high[e >> 12]] = e
    return low, high, pattern


def decode_index(v: np.ndarray) -> np.ndarray:
    """The 12 message bits of the codeword nearest to each 23-bit word."""
    low, high, pattern = _tables()
    return (v ^ pattern[low[v & 0xFFF] ^ high[v >> 12]]) >> 11


def golay_keys(segment: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and key, each once, of segments of so many bits: what they and their one-bit neighbours decode to."""
    flips = np.array([0, *(1 << b for b in range(bits))], dtype=np.int32)
    keys = np.sort(decode_index(segment.astype(np.int32)[:, None] ^ flips), axis=1)
    new = np.ones(keys.shape, dtype=bool)
    new[:, 1:] = keys[:, 1:] != keys[:, :-1]
    rows, _ = np.nonzero(new)
    return rows, keys[new]


def bucket_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and 64-bit bucket key of fingerprints: which segment agrees, its bits, and a Golay key of the next."""
    rows, keys = [], []
    for i in range(len(SEGMENTS)):
        (at, bits), (at2, bits2) = SEGMENTS[i], SEGMENTS[(i + 1) % len(SEGMENTS)]
        whole = prints >> np.uint64(at) & np.uint64((1 << bits) - 1)
        row, code = golay_keys((prints >> np.uint64(at2) & np.uint64((1 << bits2) - 1)).astype(np.int64), bits2)
        rows.append(row)
        keys.append(np.uint64(i) << np.uint64(40) | whole[row] << np.uint64(12) | code.astype(np.uint64))
    return np.concatenate(rows), np.concatenate(keys)


def fingerprint(text: str | None) -> int:
    """A bit is set if it is set in over half of the hashes of the text's shingles."""
    words = (text or "").encode().lower().split()  # bytes: A-Z and ASCII blanks only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    total, n = np.zeros(64, dtype=np.int64), len(words) - SHINGLE + 1
    digest = xxhash.xxh64_intdigest
    for k in range(0, n, TURN):
        cuts = zip(starts[k : min(k + TURN, n)].tolist(), ends[k + SHINGLE - 1 : min(k + TURN, n) + SHINGLE - 1].tolist(), strict=True)
        hashes = np.array([digest(joined[a:b], SEED) for a, b in cuts], dtype="<u8")
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id long, fp long (the fingerprint's bits) of docs(doc_id, text)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(t) for t in batch.column("text").to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(common.released(work), "doc_id long, fp long")


def forest(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links (at most two bits apart) among distinct fingerprints."""
    n = len(prints)
    centres = np.concatenate([prints, *(prints ^ np.uint64(1 << b) for b in range(64))])
    owner = np.tile(np.arange(n), 65)
    order = np.argsort(centres, kind="stable")
    same = centres[order][1:] == centres[order][:-1]
    a, b = owner[order][:-1][same], owner[order][1:][same]
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    left, right = [], []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        p, q = root(x), root(y)
        if p != q:
            parent[max(p, q)] = min(p, q)
            left.append(x)
            right.append(y)
    return prints[left], prints[right]


def finer_keys(prints: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and finer key of fingerprints in buckets: a Golay key of the segment that is not in the bucket's key yet."""
    rows, finer = [], []
    for i in range(len(SEGMENTS)):
        mine = np.flatnonzero(keys >> np.uint64(40) == i)
        at, bits = SEGMENTS[(i + 2) % len(SEGMENTS)]
        row, code = golay_keys((prints[mine] >> np.uint64(at) & np.uint64((1 << bits) - 1)).astype(np.int64), bits)
        rows.append(mine[row])
        finer.append(code.astype(np.int32))
    return np.concatenate(rows), np.concatenate(finer)


def links(prints: DataFrame, most: int = MOST_BUCKET, shown: int = SHOWN) -> DataFrame:
    """a long, b long: links among distinct fingerprints prints(fp) that connect whatever at most two bits connect."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("fp").to_numpy().view(np.uint64)
            for k in range(0, len(fp), TURN):
                rows, keys = bucket_keys(fp[k : k + TURN])
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(fp[k : k + TURN][rows].view(np.int64))], names=["key", "fp"])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp, key = (batch.column(c).to_numpy().view(np.uint64) for c in ("fp", "key"))
            for k in range(0, len(fp), TURN):
                rows, finer = finer_keys(fp[k : k + TURN], key[k : k + TURN])
                yield pa.RecordBatch.from_arrays([pa.array(key[k : k + TURN][rows].view(np.int64)), pa.array(finer), pa.array(fp[k : k + TURN][rows].view(np.int64))], names=["key", "finer", "fp"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [np.empty(0, dtype=np.uint64)], [np.empty(0, dtype=np.uint64)]
            for bucket in batch.column("fps"):
                x, y = forest(np.sort(bucket.values.to_numpy().view(np.uint64)))
                a.append(x)
                b.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (a, b)], names=["a", "b"])

    rows = prints.mapInArrow(keyed, "key long, fp long").withColumn("finer", F.lit(0))
    some = prints.where(F.pmod(F.xxhash64("fp"), F.lit(shown)) == 0).mapInArrow(keyed, "key long, fp long")
    hot = common.settle(some.groupBy("key").count().where(F.col("count") * shown > most).select("key", F.lit(True).alias("hot")), "hot-buckets")
    if not hot.isEmpty():
        marked = common.join_small(rows, hot, ["key"], "left")
        fine = marked.where("hot").select("key", "fp").mapInArrow(split, "key long, finer int, fp long")
        rows = marked.where("hot is null").select("key", "fp", "finer").unionByName(fine)
    buckets = rows.groupBy("key", "finer").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    return buckets.select("fps").mapInArrow(joined, "a long, b long").distinct()


def components(edges: DataFrame, name: str = "edges") -> DataFrame:
    """node long, root long: each node of edges(a, b) with its component's least node; alternating star steps until nothing changes."""
    spark = edges.sparkSession
    path = common.scratch(spark, name)
    edges.select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b")).where("a <> b").distinct().write.parquet(path)
    read = lambda at: spark.read.schema("a long, b long").parquet(at)
    edges, seen = read(path), None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        # large star: larger neighbours point to the least of the neighbourhood
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: the node and its smaller neighbours point to the least of these
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).distinct()
        before, path = path, common.scratch(spark, name)
        small.write.parquet(path)
        edges = read(path)
        common.delete(spark, before)  # a round's table is all that the next one needs
        sums = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if (sums.n, sums.s) == seen:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = (sums.n, sums.s)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (least doc_id reachable) of docs(doc_id, text)."""
    prints = common.settle(fingerprints(docs), "fingerprints")
    classes = common.settle(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    roots = components(links(classes.select("fp")), "links")
    grouped = classes.join(roots, classes.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = grouped.groupBy("root").agg(F.min("first").alias("component_id"))
    named = grouped.join(least, "root").select("fp", "component_id")
    # a class of copies may be large, so documents are spread over salts and the classes copied to each
    copies = named.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = prints.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    return salted.join(copies, ["fp", "salt"]).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


class Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word, SEED)
        return h


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


@lru_cache(1)
def _permutations() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    return rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64), rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)


def sketches(texts: list[str | None], known: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A mark of each text's words, its band keys and its sketch (0: no hash in that place); texts without words have no keys."""
    docs = [(t or "").encode().lower().split() for t in texts]
    sizes = np.fromiter(map(len, docs), dtype=np.int64, count=len(docs))
    ends = np.cumsum(sizes)
    w = np.fromiter((h for d in docs for h in map(known.__getitem__, d)), dtype=np.uint64, count=int(ends[-1]) if len(docs) else 0)
    marks = np.array([xxhash.xxh64_intdigest(w[e - n : e].tobytes(), SEED) for n, e in zip(sizes.tolist(), ends.tolist(), strict=True)], dtype=np.uint64)
    n = max(len(w) - NEAR_WORDS + 1, 0)
    h = np.zeros(n, dtype=np.uint64)
    for k in range(NEAR_WORDS):
        h = h * np.uint64(0x9E3779B97F4A7C15) + w[k : k + n]
    owner = np.repeat(np.arange(len(docs)), sizes)
    whole = np.flatnonzero((ends[owner] - np.arange(len(w)))[:n] >= NEAR_WORDS)
    short = np.flatnonzero((sizes > 0) & (sizes < NEAR_WORDS))  # one shingle, the whole sequence
    h, owner = _mix(np.concatenate([h[whole], marks[short]])), np.concatenate([owner[whole], short])
    order = np.argsort(owner, kind="stable")
    h, owner = h[order], owner[order]
    sketch = np.full(len(docs) * BINS, np.iinfo(np.uint64).max, dtype=np.uint64)
    np.minimum.at(sketch, owner * BINS + (h >> np.uint64(56)).astype(np.int64), h)
    sketch = np.where(sketch == np.iinfo(np.uint64).max, 0, sketch % np.uint64(255) + np.uint64(1)).astype(np.uint8).reshape(-1, BINS)
    keys = np.zeros((len(docs), BANDS), dtype=np.uint64)
    if len(h):
        first = np.flatnonzero(np.diff(owner, prepend=-1))
        seeds, factors = _permutations()
        for band in range(BANDS):
            key = np.full(len(first), band, dtype=np.uint64)
            for k in range(band * ROWS, (band + 1) * ROWS):
                key = _mix(key * np.uint64(31) + np.minimum.reduceat((h ^ seeds[k]) * factors[k], first))
            keys[owner[first], band] = key
    return marks, keys, sketch


def alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated similarity of pairs of sketches: equal hashes among the places that either has one in."""
    some = np.maximum(((a > 0) | (b > 0)).sum(axis=1), 1)
    same = ((a == b) & (a > 0)).sum(axis=1) / some
    return (same - 1 / 255) / (1 - 1 / 255)


class Forest:
    """Links of which only those that join two trees are kept."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        at = self.parent
        while (up := at.setdefault(x, x)) != x:
            at[x] = at[up]
            x = at[x]
        return x

    def join(self, x: int, y: int) -> bool:
        p, q = self.root(x), self.root(y)
        self.parent[max(p, q)] = min(p, q)
        return p != q


def shared_keys(nodes: DataFrame) -> DataFrame:
    """key, next, mark: the keys of nodes(mark, bands array<long>) that several of them have."""
    keyed = nodes.select("mark", "bands", F.posexplode("bands").alias("band", "key"))
    keyed = keyed.select("key", F.get("bands", (F.col("band") + 1) % BANDS).alias("next"), "mark")
    keys = common.settle(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "near-keys")
    return common.settle(common.join_small(keyed, keys, ["key"]), "shared-keys")


def _sketched(batch: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("sketch").to_pylist()), dtype=np.uint8).reshape(-1, BINS)


LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def near_links(nodes: DataFrame, shared: DataFrame) -> DataFrame:
    """a long, b long: links among alike texts of nodes(mark, sketch binary) that lie near each other under a key of shared_keys().

    They join what is plainly one group in one pass; apart_links() finds what they leave out.
    """
    n = common.partitions_for(nodes)

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, held = Forest(), None  # held: the last rows, with the first row of the last key before them
        for batch in batches:
            key, mark = (batch.column(c).to_numpy() for c in ("key", "mark"))
            rows = _sketched(batch)
            if held is not None:
                key, mark, rows = np.concatenate([held[0], key]), np.concatenate([held[1], mark]), np.concatenate([held[2], rows])
            start = np.maximum.accumulate(np.where(np.diff(key, prepend=key[:1] - 1) != 0, np.arange(len(key)), 0))
            left, right = [], []
            at = np.arange(len(key))
            for i in [start, *(at - back for back in range(1, BEFORE + 1))]:
                pair = np.flatnonzero((i >= 0) & (i < at) & (key[np.maximum(i, 0)] == key))
                for k in range(0, len(pair), 4096):
                    p = pair[k : k + 4096]
                    good = p[alike(rows[p], rows[i[p]]) >= ALIKE]
                    for x, y in zip(mark[good].tolist(), mark[i[good]].tolist(), strict=True):
                        if x != y and forest.join(x, y):
                            left.append(x)
                            right.append(y)
            if left:
                yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], schema=LINKS)
            keep = np.unique(np.concatenate([[start[-1]], at[max(0, len(at) - BEFORE) :]])) if len(at) else at
            held = key[keep], mark[keep], rows[keep]

    dealt = shared.join(nodes.select("mark", "sketch"), "mark").repartitionByRange(n, "key", "next", "mark").sortWithinPartitions("key", "next", "mark")
    return dealt.select("key", "mark", "sketch").mapInArrow(common.released(linked), "a long, b long")


def apart_links(nodes: DataFrame, shared: DataFrame, roots: DataFrame, block: int = BLOCK) -> DataFrame:
    """a long, b long: links between alike texts that share a key and are in different trees of roots(node, root), enough to connect them.

    Keys under which all is one tree are done. The texts of any other key are compared, whatever their number: dealt to blocks of
    about `block`, every two blocks meet in a task, which holds no more than these and compares what is in different trees.
    """
    rooted = shared.select("key", "mark").join(roots, F.col("mark") == F.col("node"), "left").select("key", "mark", F.coalesce("root", "mark").alias("root"))
    rooted = common.settle(rooted, "rooted")
    mixed = common.settle(rooted.groupBy("key").agg(F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key", F.ceil(F.col("n") / block).cast("int").alias("blocks")), "mixed-keys")
    rows = common.join_small(rooted, mixed, ["key"]).withColumn("own", F.pmod(F.xxhash64("mark"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "mark", "root").join(nodes.select("mark", "sketch"), "mark")

    def compared(own: np.ndarray, mark: np.ndarray, root: np.ndarray, sketch: np.ndarray, forest: Forest) -> Iterator[tuple[int, int]]:
        tree = np.array([forest.root(x) for x in root.tolist()], dtype=np.int64)  # what links found so far make of the trees
        first, last = np.flatnonzero(own == own.min()), np.flatnonzero(own == own.max())
        for x in first.tolist():
            left = last[(tree[last] != tree[x]) & ((last > x) | (own[last] != own[x]))]
            for k in range(0, len(left), 1024):
                some = left[k : k + 1024]
                some = some[tree[some] != tree[x]]
                for y in some[alike(np.broadcast_to(sketch[x], (len(some), BINS)), sketch[some]) >= ALIKE].tolist():
                    if forest.join(int(root[x]), int(root[y])):
                        tree[tree == tree[y]] = tree[x]
                        yield int(mark[x]), int(mark[y])

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, held = Forest(), None
        for batch in batches:
            rows = [batch.column(c).to_numpy() for c in ("key", "i", "j", "own", "mark", "root")] + [_sketched(batch)]
            if held is not None:
                rows = [np.concatenate([a, b]) for a, b in zip(held, rows, strict=True)]
            ends = np.flatnonzero(np.any([np.diff(c) != 0 for c in rows[:3]], axis=0)) + 1 if len(rows[0]) else np.zeros(0, dtype=np.int64)
            cuts = [0, *ends.tolist()]
            found = [x for a, b in zip(cuts, cuts[1:], strict=False) for x in compared(*(c[a:b] for c in rows[3:]), forest)]
            held = [c[cuts[-1] :] for c in rows]  # the last group may go on
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], schema=LINKS)
        if held is not None and len(held[0]) and (found := list(compared(*held[3:], forest))):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], schema=LINKS)

    dealt = rows.repartition(common.partitions_for(nodes), "key", "i", "j").sortWithinPartitions("key", "i", "j")
    return dealt.select("key", "i", "j", "own", "mark", "root", "sketch").mapInArrow(common.released(linked), "a long, b long")


def near_copies(docs: DataFrame) -> DataFrame:
    """doc_id, component_id (least doc_id reachable) of docs(doc_id, text): linked are fingerprints at two bits and texts alike by five words."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words()
        for batch in batches:
            at = 0
            for group in grouped(batch.column("text").to_pylist(), 1_000_000):
                marks, keys, sketch = sketches(group, known)
                prints = np.array([fingerprint(t) for t in group], dtype=np.uint64)
                some = [k.tolist() if s.any() else [] for k, s in zip(keys.view(np.int64), sketch, strict=True)]
                ids = batch.column("doc_id").slice(at, len(group))
                at += len(group)
                yield pa.RecordBatch.from_arrays([ids, pa.array(prints.view(np.int64)), pa.array(marks.view(np.int64)), pa.array(some, pa.list_(pa.int64())), pa.array([x.tobytes() for x in sketch], pa.binary())], names=["doc_id", "fp", "mark", "bands", "sketch"])

    rows = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(common.released(work), "doc_id long, fp long, mark long, bands array<bigint>, sketch binary")
    prints = common.settle(rows, "sketches")
    nodes = common.settle(prints.groupBy("mark").agg(F.min("doc_id").alias("first"), F.min(F.struct("fp", "bands", "sketch")).alias("s")).select("mark", "first", "s.*"), "texts")
    heads = common.settle(nodes.groupBy("fp").agg(F.min("mark").alias("head")), "classes")
    a, b = (heads.select(F.col("fp").alias(x), F.col("head").alias(f"head_{x}")) for x in ("a", "b"))
    near = links(heads.select("fp")).join(a, "a").join(b, "b").select(F.col("head_a").alias("a"), F.col("head_b").alias("b"))
    own = nodes.select("fp", "mark").join(heads, "fp").where("mark <> head").select(F.col("mark").alias("a"), F.col("head").alias("b"))
    shared = shared_keys(nodes.select("mark", "bands"))
    sketched = nodes.select("mark", "sketch")
    found = common.settle(near.unionByName(own).unionByName(near_links(sketched, shared)), "found-links")
    roots = common.settle(components(found, "near-links"), "roots")
    more = common.settle(apart_links(sketched, shared, roots), "more-links")
    if not more.isEmpty():
        roots = components(found.unionByName(more), "near-links")
    grouped_ = nodes.select("mark", "first").join(roots, F.col("mark") == F.col("node"), "left").select("mark", "first", F.coalesce("root", "mark").alias("root"))
    named = common.settle(grouped_.join(grouped_.groupBy("root").agg(F.min("first").alias("component_id")), "root").select("mark", "component_id"), "components")
    return common.join_small(prints.select("doc_id", "mark"), named, ["mark"], rows=0).select("doc_id", "component_id")


def keep_first(docs: DataFrame) -> DataFrame:
    """The documents of docs that are the first of their near copies; a doc_id goes if none of its rows is, and stays whole otherwise."""
    found = near_copies(docs).groupBy("doc_id").agg(F.bool_or(F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("first"))
    gone = common.settle(found.where("not first").select("doc_id"), "copies")
    key = common.unused(docs, "_id")
    kept = docs.join(gone.select(F.col("doc_id").alias(key)).hint("merge"), F.col("doc_id").cast("long").eqNullSafe(F.col(key)), "left_anti")
    return kept.select(*map(common.quoted, docs.columns))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with fingerprint and component; see near_duplicates."""
    return near_duplicates(common.documents(spark, sf_dir, "doc_id", "text"))
