"""Exact substring deduplication by fixed-block anchors.

Every window of WINDOW words of a document holds one of its aligned blocks of BLOCK words, as WINDOW = 2 x BLOCK - 1. So the
aligned blocks are indexed, every rolling block of every document probes that index, and where two documents meet in a block,
the hit is extended to both sides: the windows around it are compared by keys of 128 bits, window by window, which gives the
maximal exact repeat (for 10^13 windows two different ones have equal keys with a chance of 10^-13), and each repeat keeps its copy
in the document with the least doc_id.

Documents are dealt into batches of ascending doc_id ranges. A batch sends one sorted list of short block hashes to each hash
bucket; the bucket answers with a bit per entry. The batch then sends the strong keys around its hits the same way, and the
answer tells which occur in an earlier batch. What happens within a batch it settles itself, so a passage that is in a third
of all documents costs one entry per batch, never a pair.

Null texts have no words. Null doc_ids count as larger than all others. Rows with equal doc_id do not remove each other's
words. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

BLOCK = 7
WINDOW = 2 * BLOCK - 1
#: Bytes of text in a batch, and words whose hashes meet in a bucket, about.
BATCH_BYTES, BUCKET_WORDS = 2_500_000, 2_000_000
MOST_BATCHES = 1 << 20
LAST_ID = (1 << 63) - 1
SENT = "bucket int, batch int, step int, n int, body binary"
OUT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


class Words(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def _rolling(w: np.ndarray, size: int, factor: int) -> np.ndarray:
    """A hash of the words from each place on; the last places have none."""
    n = max(len(w) - size + 1, 0)
    h = np.zeros(n, dtype=np.uint64)
    for k in range(size):
        h = h * np.uint64(factor) + w[k : k + n]
    return _mix(h)


class Batch:
    """The words of a batch's documents, end to end."""

    def __init__(self, table: pa.Table):
        order = np.argsort(table.column("rank").to_numpy(), kind="stable")
        ids, ranks, texts = table.column("doc_id").to_pylist(), table.column("rank").to_numpy(), table.column("text").to_pylist()
        self.ids = [ids[i] for i in order]
        ranks = ranks[order]
        self.docs = [(texts[i] or "").encode().split() for i in order]
        known = Words()
        sizes = np.fromiter(map(len, self.docs), dtype=np.int64, count=len(self.docs))
        self.starts = np.concatenate([[0], np.cumsum(sizes)])
        self.w = np.fromiter((h for d in self.docs for h in map(known.__getitem__, d)), dtype=np.uint64, count=self.starts[-1])
        # rows of one doc_id are one document as far as order goes
        number = np.concatenate([[0], np.cumsum(np.diff(ranks) != 0)]) if len(ranks) else np.zeros(0, dtype=np.int64)
        self.doc = np.repeat(number, sizes)
        self.place = np.arange(self.starts[-1]) - np.repeat(self.starts[:-1], sizes)
        self.left = np.repeat(sizes, sizes) - self.place

    def blocks(self) -> tuple[np.ndarray, np.ndarray]:
        """Places of the rolling blocks and their hashes."""
        at = np.flatnonzero(self.left >= BLOCK)
        return at, _rolling(self.w, BLOCK, 0x9E3779B97F4A7C15)[at]

    def sent_blocks(self, buckets: int) -> tuple[np.ndarray, np.ndarray, list]:
        """Places, entry of each place, and per bucket the sorted entries with flags (1 aligned, 2 in two documents)."""
        at, h = self.blocks()
        # a bucket and 40 bits name a block
        value = (h % np.uint64(buckets)) << np.uint64(40) | h >> np.uint64(24)
        values, entry = np.unique(value, return_inverse=True)
        flags = np.zeros(len(values), dtype=np.uint8)
        flags[entry[self.place[at] % BLOCK == 0]] = 1
        low, high = np.full(len(values), LAST_ID), np.full(len(values), -1)
        np.minimum.at(low, entry, self.doc[at])
        np.maximum.at(high, entry, self.doc[at])
        flags[low < high] |= 2
        return at, entry, values, flags

    def repeats(self, hit: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Windows around hits: their places, entries, and the entries' sorted keys (64 bits and 64 more)."""
        near = np.zeros(len(self.w) + WINDOW + 1, dtype=np.int64)
        marks = at[hit]
        np.add.at(near, np.maximum(marks - BLOCK + 1, 0), 1)
        np.add.at(near, marks + 1, -1)
        places = np.flatnonzero((np.cumsum(near)[: len(self.w)] > 0) & (self.left >= WINDOW))
        if not len(places):
            return places, places, np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.uint64)
        a = _rolling(self.w, WINDOW, 0xD6E8FEB86659FD93)[places]
        b = _rolling(self.w, WINDOW, 0xA0761D6478BD642F)[places]
        order = np.lexsort((b, a))
        new = np.ones(len(order), dtype=bool)
        new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
        entry = np.empty(len(order), dtype=np.int64)
        entry[order] = np.cumsum(new) - 1
        return places, entry, a[order][new], b[order][new]


def _rows(batch: int, step: int, bucket_of: np.ndarray, bodies) -> list[dict]:
    """A row for each bucket; entries are sorted by bucket."""
    found = []
    cuts = np.flatnonzero(np.diff(bucket_of)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(bucket_of)], strict=True):
        if b > a:
            found.append({"bucket": int(bucket_of[a]), "batch": batch, "step": step, "n": b - a, "body": bodies(a, b)})
    return found


SENT_ARROW = pa.schema([("bucket", pa.int32()), ("batch", pa.int32()), ("step", pa.int32()), ("n", pa.int32()), ("body", pa.binary())])


def _pack_sorted(v: np.ndarray, flags: np.ndarray) -> bytes:
    """Sorted 40-bit values as 32-bit differences (those that need more follow), and two flags each."""
    d = np.diff(v, prepend=np.uint64(0))
    big = d >= 0xFFFFFFFF
    short = np.where(big, np.uint64(0xFFFFFFFF), d).astype("<u4")
    return short.tobytes() + d[big].astype("<u8").tobytes() + np.packbits(flags & 1).tobytes() + np.packbits(flags >> 1).tobytes()


def _unpack_sorted(body: bytes, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    d = np.frombuffer(body, dtype="<u4", count=n).astype(np.uint64)
    big = np.flatnonzero(d == 0xFFFFFFFF)
    d[big] = np.frombuffer(body, dtype="<u8", count=len(big), offset=4 * n)
    bits = np.frombuffer(body, dtype=np.uint8, offset=4 * n + 8 * len(big))
    half = -(-n // 8)
    return np.cumsum(d, dtype=np.uint64), np.unpackbits(bits[:half], count=n), np.unpackbits(bits[half:], count=n)


def _strong_order(a: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    bucket = (a % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    return order, bucket[order]


def _answers(replies: pa.Table, step: int) -> np.ndarray:
    """The bits of one step's entries, in the order in which they were sent."""
    rows = sorted((r for r in replies.to_pylist() if r["step"] == step), key=lambda r: r["bucket"])
    bits = [np.unpackbits(np.frombuffer(r["body"], dtype=np.uint8), count=r["n"]) for r in rows]
    return np.concatenate(bits).astype(bool) if bits else np.zeros(0, dtype=bool)


def _ask_blocks(buckets: int):
    def ask(key, table):
        batch = Batch(table)
        _, _, values, flags = batch.sent_blocks(buckets)
        low = values & np.uint64((1 << 40) - 1)
        return pa.Table.from_pylist(_rows(key[0].as_py(), 1, (values >> np.uint64(40)).astype(np.int64), lambda a, b: _pack_sorted(low[a:b], flags[a:b])), schema=SENT_ARROW)

    return ask


def _answer_blocks(table):
    """Which entries are an aligned block somewhere and occur in two documents."""
    rows = table.to_pylist()
    parts = [_unpack_sorted(r["body"], r["n"]) for r in rows]
    values, entry = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    aligned = np.zeros(len(values), dtype=bool)
    aligned[entry[np.concatenate([p[1] for p in parts]) > 0]] = True
    shared = np.bincount(entry, minlength=len(values)) > 1
    shared[entry[np.concatenate([p[2] for p in parts]) > 0]] = True
    return _reply(rows, (aligned & shared)[entry])


def _answer_repeats(table):
    """Which keys occur in an earlier batch."""
    rows = table.to_pylist()
    a = np.concatenate([np.frombuffer(r["body"], dtype="<u8", count=r["n"]) for r in rows])
    b = np.concatenate([np.frombuffer(r["body"], dtype="<u8", count=r["n"], offset=8 * r["n"]) for r in rows])
    batch = np.repeat([r["batch"] for r in rows], [r["n"] for r in rows])
    order = np.lexsort((batch, b, a))
    earlier = np.zeros(len(a), dtype=bool)
    earlier[order[1:]] = (a[order][1:] == a[order][:-1]) & (b[order][1:] == b[order][:-1])
    return _reply(rows, earlier)


def _reply(rows: list[dict], bits: np.ndarray) -> pa.Table:
    ends = np.cumsum([r["n"] for r in rows])
    return pa.Table.from_pylist([r | {"body": np.packbits(bits[e - r["n"] : e]).tobytes()} for r, e in zip(rows, ends.tolist(), strict=True)], schema=SENT_ARROW)


def _found(table: pa.Table, replies: pa.Table, buckets: int) -> tuple:
    """The batch, and its windows around hits as repeats() gives them."""
    batch = Batch(table)
    at, entry, values, _ = batch.sent_blocks(buckets)
    hits = _answers(replies, 1)
    assert len(hits) == len(values), "answers do not fit what was asked"
    return batch, *batch.repeats(hits[entry] if len(values) else np.zeros(0, dtype=bool), at)


def _ask_repeats(buckets: int):
    def ask(key, table, replies):
        if not table.num_rows:
            return SENT_ARROW.empty_table()
        _, _, _, a, b = _found(table, replies, buckets)
        order, bucket = _strong_order(a, buckets)
        a, b = a[order], b[order]
        return pa.Table.from_pylist(_rows(key[0].as_py(), 2, bucket, lambda i, j: a[i:j].astype("<u8").tobytes() + b[i:j].astype("<u8").tobytes()), schema=SENT_ARROW)

    return ask


def _remove(buckets: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])

    def remove(key, table, replies):
        if not table.num_rows:
            return schema.empty_table()
        batch, places, entry, a, _ = _found(table, replies, buckets)
        order, _ = _strong_order(a, buckets)
        earlier = np.zeros(len(a), dtype=bool)
        earlier[order] = _answers(replies, 2)
        first = np.full(len(a), LAST_ID)
        np.minimum.at(first, entry, batch.doc[places])
        gone = places[earlier[entry] | (first[entry] < batch.doc[places])]
        cover = np.zeros(len(batch.w) + WINDOW + 1, dtype=np.int64)
        np.add.at(cover, gone, 1)
        np.add.at(cover, gone + WINDOW, -1)
        kept = np.cumsum(cover)[: len(batch.w)] == 0
        rows = []
        for doc, words, s in zip(batch.ids, batch.docs, batch.starts.tolist(), strict=False):
            mine = kept[s : s + len(words)]
            left = words if mine.all() else [words[i] for i in np.flatnonzero(mine).tolist()]
            rows.append((doc, len(words), len(words) - len(left), hashlib.sha256(b" ".join(left)).hexdigest()))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return remove


def remove_repeats(docs: DataFrame, batch_bytes: int = BATCH_BYTES, bucket_words: int = BUCKET_WORDS) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of each row of docs(doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    batches = min(MOST_BATCHES, max(1, -(-size // batch_bytes)))
    buckets = max(1, size // 6 // bucket_words)
    bounds = docs.agg(F.percentile_approx("doc_id", [k / batches for k in range(1, batches)], 20 * batches)).first()[0] if batches > 1 else []
    bounds = np.unique(np.array(bounds or [], dtype=np.int64))

    def place(parts):
        for part in parts:
            ids = part.column("doc_id")
            rank = ids.fill_null(LAST_ID).to_numpy(zero_copy_only=False).astype(np.int64)
            batch = np.searchsorted(bounds, rank, side="left").astype(np.int32)
            yield pa.RecordBatch.from_arrays([ids, part.column("text"), pa.array(rank), pa.array(batch)], names=["doc_id", "text", "rank", "batch"])

    placed = docs.mapInArrow(place, "doc_id long, text string, rank long, batch int")
    blocks = placed.groupBy("batch").applyInArrow(_ask_blocks(buckets), SENT).groupBy("bucket").applyInArrow(_answer_blocks, SENT)
    repeats = placed.groupBy("batch").cogroup(blocks.groupBy("batch")).applyInArrow(_ask_repeats(buckets), SENT).groupBy("bucket").applyInArrow(_answer_repeats, SENT)
    return placed.groupBy("batch").cogroup(blocks.unionByName(repeats).groupBy("batch")).applyInArrow(_remove(buckets), OUT)


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the words of passages that an earlier document has; see remove_repeats."""
    return remove_repeats(common.documents(spark, sf_dir, "doc_id", "text"))
