"""Token-ID files of patched frame-of-reference blocks.

A file set is a Parquet table in a shared folder with one row per page: whole documents in ascending doc_id order, whose ids
are packed in blocks of BLOCK ids. A block stores its least id, the others as differences from it in so many bits as the
PERCENTILE of its differences needs, and the differences that need more in an exception list. An index of the blocks' starts
lets a reader open any block. Shards are the parts of one range partitioning by doc_id; the place of a document is its
shard's start (sums over one row per shard) plus its place in the shard.

Null texts are encoded as empty ones, null doc_ids come first, repeated doc_ids stay next to each other, an empty table gives
no pages. The tokenizers library does the encoding. Vocabulary files with settings that this way of asking it doesn't keep to are refused.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .bpe import LATIN, SPACE, byte_chars, checked_settings, default_vocabulary, slices

BLOCK, PERCENTILE = 128, 90
#: Chunks that a worker keeps in each of two generations; asking the library again is what costs most here.
KEPT = 500_000
#: Texts are encoded in runs of about so many bytes.
GROUP_BYTES = 8_000_000
#: The white space of bpe.SPACE as the characters themselves, which is what Arrow's patterns take.
RUN_SPACE = SPACE.encode().decode("unicode_escape")
#: A page is closed once it holds so many ids.
PAGE_IDS = 1 << 18
HEAD = np.dtype([("base", "<u4"), ("width", "u1"), ("count", "u1"), ("exceptions", "u1"), ("spare", "u1")])
PAGE = "shard int, page int, first long, n_ids long, doc_ids array<bigint>, sizes array<bigint>, starts binary, payload binary"


def pack(ids: np.ndarray) -> tuple[bytes, bytes]:
    """Block starts (unsigned 32-bit) and blocks of ids below 2^32."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    if not blocks:
        return b"", b""
    padded = np.full(blocks * BLOCK, ids[-1], dtype=np.uint32)
    padded[:n] = ids
    padded = padded.reshape(blocks, BLOCK)
    base = padded.min(axis=1)
    deltas = padded - base[:, None]
    chosen = np.partition(deltas, BLOCK * PERCENTILE // 100 - 1, axis=1)[:, BLOCK * PERCENTILE // 100 - 1]
    width = np.ceil(np.log2(chosen.astype(np.float64) + 1)).astype(np.int64)
    over = deltas >> np.minimum(width, 31)[:, None].astype(np.uint32) > 0
    over[width >= 32] = False
    exceptions = over.sum(axis=1)
    head = np.zeros(blocks, dtype=HEAD)
    head["base"], head["width"], head["exceptions"], head["count"] = base, width, exceptions, BLOCK
    head["count"][-1] = n - (blocks - 1) * BLOCK
    # blocks start at multiples of eight bytes
    size = HEAD.itemsize + width * (BLOCK // 8) + -(-exceptions * 5 // 8) * 8
    starts = np.concatenate([[0], np.cumsum(size)])
    out = np.zeros(starts[-1], dtype=np.uint8)
    out32, first = out.view("<u4"), starts[:-1] // 4
    out32[first[:, None] + np.arange(2)] = head.view("<u4").reshape(blocks, 2)
    for w in np.unique(width).tolist():
        mine = np.flatnonzero(width == w)
        if w:
            low = (deltas[mine] & np.uint32(((1 << w) - 1) & 0xFFFFFFFF)).T.astype(np.uint64)
            words = np.zeros((len(mine), BLOCK * w // 32 + 1), dtype=np.uint64)
            for k in range(BLOCK):  # each value goes to one or two words of 32 bits
                at, shift = divmod(k * w, 32)
                moved = low[k] << np.uint64(shift)
                words[:, at] |= moved & np.uint64(0xFFFFFFFF)
                if shift + w > 32:
                    words[:, at + 1] |= moved >> np.uint64(32)
            out32[first[mine, None] + 2 + np.arange(BLOCK * w // 32)] = words[:, : BLOCK * w // 32]
    rows, places = np.nonzero(over)
    if len(rows):
        nth = np.arange(len(rows)) - (np.cumsum(exceptions) - exceptions)[rows]
        at = starts[rows] + HEAD.itemsize + width[rows] * (BLOCK // 8)
        out[at + nth] = places
        values = deltas[rows, places].astype("<u4").view(np.uint8).reshape(-1, 4)
        out[(at + exceptions[rows] + 4 * nth)[:, None] + np.arange(4)] = values
    return starts[:-1].astype("<u4").tobytes(), out.tobytes()


def unpack(starts: bytes, payload: bytes) -> np.ndarray:
    """The ids that pack() was given."""
    at = np.frombuffer(starts, dtype="<u4").astype(np.int64)
    if not len(at):
        return np.empty(0, dtype=np.uint32)
    raw, raw32 = np.frombuffer(payload, dtype=np.uint8), np.frombuffer(payload, dtype="<u4")
    head = raw32[at[:, None] // 4 + np.arange(2)].view(HEAD).reshape(-1)
    width, exceptions = head["width"].astype(np.int64), head["exceptions"].astype(np.int64)
    deltas = np.zeros((len(at), BLOCK), dtype=np.uint32)
    for w in np.unique(width).tolist():
        if not w:
            continue
        mine = np.flatnonzero(width == w)
        words = np.zeros((BLOCK * w // 32 + 1, len(mine)), dtype=np.uint64)
        words[:-1] = raw32[at[mine, None] // 4 + 2 + np.arange(BLOCK * w // 32)].T
        mask = np.uint64((1 << w) - 1)
        got = np.empty((BLOCK, len(mine)), dtype=np.uint32)
        for k in range(BLOCK):
            i, shift = divmod(k * w, 32)
            value = words[i] >> np.uint64(shift)
            if shift + w > 32:
                value = value | words[i + 1] << np.uint64(32 - shift)
            got[k] = value & mask
        deltas[mine] = got.T
    if exceptions.any():
        rows = np.repeat(np.arange(len(at)), exceptions)
        nth = np.arange(len(rows)) - np.repeat(np.cumsum(exceptions) - exceptions, exceptions)
        place = at[rows] + HEAD.itemsize + width[rows] * (BLOCK // 8)
        values = np.ascontiguousarray(raw[(place + exceptions[rows] + 4 * nth)[:, None] + np.arange(4)]).view("<u4").reshape(-1)
        deltas[rows, raw[place + nth]] = values
    ids = (deltas + head["base"][:, None]).reshape(-1)
    return ids[: (len(at) - 1) * BLOCK + int(head["count"][-1])]


class Chunks(dict):
    """Ids of words after `lead`, asked of the library once; the generation before the current one is kept too.

    words has the ids of what has no lead. Words with marks after them are put together and not kept.
    """

    def __init__(self, library: Library, lead: str, words: Chunks | None = None):
        self.library, self.lead, self.words = library, lead, self if words is None else words
        self.mark, self.old = lead.translate(library.chars), {}

    def __missing__(self, chunk: str) -> bytes:
        found, library = self.old.get(chunk), self.library
        if found is None:
            if chunk[:1] == "\n" and self.lead and chunk != "\n":
                return self["\n"] + self.words[chunk[1:]]
            parts = library.parts(chunk)
            if parts is None:
                found = library.whole("\n" if chunk == "\n" else self.lead + chunk)
            elif parts[2]:
                return self[parts[1]] + self.words[parts[2]]
            else:
                word = chunk if chunk.isascii() else chunk.encode().decode("latin1").translate(library.chars)
                found = array("I", [t.id for t in library.model.tokenize(self.mark + word)]).tobytes()
        if len(self) >= library.kept:
            self.old = dict(self)
            self.clear()
        self[chunk] = found
        return found


class Library:
    """This worker's encoder over the tokenizers library.

    Texts are cut at lone spaces and line ends, where pre-tokens begin; Arrow finds a batch's different words, and the library is
    asked for those that are not known yet. Texts with runs of white space or with special tokens go to the library whole.
    """

    def __init__(self, path: str, kept: int = KEPT):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            self.special = [t for t in checked_settings(json.load(f)) if t]
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model, self.chars, self.kept = self.tokenizer.model, byte_chars(), kept
        # letters that are one pre-token with the space before them, and visible ASCII marks, another one, after them
        self.parts = re.compile(rf"([{LATIN}]+)([!-/:-@\[-`{{-~]*)").fullmatch
        self.bare = Chunks(self, "")
        self.spaced = Chunks(self, " ", self.bare)

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each followed by end_id, and how many each has; texts without nulls."""
        hard = pc.match_substring_regex(texts, f"[{RUN_SPACE}]{{2}}")
        for t in self.special:
            hard = pc.or_(hard, pc.match_substring(texts, t))
        # a line end between words is a pre-token of its own; it goes to the word after it
        words = pc.split_pattern(pc.replace_substring(pc.if_else(hard, "", texts), "\n", " \n"), " ")
        cuts = words.offsets.to_numpy().astype(np.int64)
        # the first word of a text has no space before it; a text that is not cut counts as one
        first = words.flatten().take(pa.array(cuts[:-1])).to_pylist()
        for i in np.flatnonzero(hard.to_numpy(zero_copy_only=False)).tolist():
            first[i] = self.whole(texts[i].as_py())
        coded = words.flatten().dictionary_encode()
        known = list(map(self.spaced.__getitem__, coded.dictionary.to_pylist()))
        n = len(known)
        known += [x if isinstance(x, bytes) else self.bare[x] if x else b"" for x in first]
        known.append(np.array([end_id], dtype="<u4").tobytes())
        codes = coded.indices.to_numpy().copy()
        codes[cuts[:-1]] = n + np.arange(len(first))
        codes = np.insert(codes, cuts[1:], np.int32(len(known) - 1))
        size = np.fromiter(map(len, known), dtype=np.int64, count=len(known)) // 4
        at, ids = np.cumsum(size) - size, np.frombuffer(b"".join(known), dtype="<u4")
        size, at = size[codes], at[codes]
        ends = np.cumsum(size)
        at -= ends
        at += size
        place = np.repeat(at, size)
        place += np.arange(len(place))
        return ids[place], np.diff(ends[cuts[1:] + np.arange(len(first))], prepend=0)


_LIBRARY: dict[str, Library] = {}


def library_encoder(path: str) -> Library:
    if path not in _LIBRARY:
        _LIBRARY[path] = Library(path)
    return _LIBRARY[path]


def write_files(df: DataFrame, path: str, out: str, end_id: int = 2, shards: int | None = None) -> None:
    """Write the ids of df(doc_id, text) and an end_id for each document, in ascending doc_id order, to the folder out."""
    texts = df.select(F.col("doc_id").cast("long"), "text")
    shards = shards or common.partitions_for(texts)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = library_encoder(path)
        shard, page, first = TaskContext.get().partitionId(), 0, 0
        docs, sizes, held = [], [], []

        def closed() -> pa.RecordBatch:
            ids = np.concatenate(held)
            row = {"shard": shard, "page": page, "first": first, "n_ids": len(ids), "doc_ids": docs, "sizes": sizes}
            row["starts"], row["payload"] = pack(ids)
            return pa.RecordBatch.from_pylist([row], schema=schema)

        schema = pa.schema([("shard", pa.int32()), ("page", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("starts", pa.binary()), ("payload", pa.binary())])
        pending = 0
        for batch in batches:
            doc_ids, given = batch.column("doc_id").to_pylist(), batch.column("text").fill_null("")
            for a, b in slices(given, GROUP_BYTES):
                ids, n = encoder.encode(given.slice(a, b - a), end_id)
                ends = np.cumsum(n)
                at = 0  # documents of this run that are in pages
                while at < len(n):
                    before = int(ends[at - 1]) if at else 0
                    to = min(len(n), int(np.searchsorted(ends, before + PAGE_IDS - pending, side="left")) + 1)
                    docs += doc_ids[a + at : a + to]
                    sizes += n[at:to].tolist()
                    held.append(ids[before : ends[to - 1]])
                    pending += int(ends[to - 1]) - before
                    at = to
                    if pending >= PAGE_IDS:
                        yield closed()
                        page, first, pending = page + 1, first + pending, 0
                        docs, sizes, held = [], [], []
        if docs:
            yield closed()

    ordered = texts.repartitionByRange(shards, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first())
    ordered.mapInArrow(common.released(work), PAGE).write.option("compression", "uncompressed").parquet(out)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document in the file set, from its blocks."""
    pages = spark.read.schema(PAGE).parquet(path)
    # one row per shard, so few rows meet in this window
    totals = pages.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    bases = totals.select("shard", (F.coalesce(F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("base"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                raw = unpack(row["starts"], row["payload"]).astype("<u4").tobytes()
                sizes = np.array(row["sizes"], dtype=np.int64)
                ends = np.cumsum(sizes)
                cuts = [0, *(ends * 4).tolist()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["shard"]] * len(sizes), pa.int32()), pa.array(row["doc_ids"], pa.int64()), pa.array(row["first"] + ends - sizes), pa.array(sizes), pa.array([zlib.crc32(raw[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)], pa.int64())],
                    names=["shard", "doc_id", "place", "n_tokens", "ids_crc32"],
                )

    found = pages.select("shard", "first", "doc_ids", "sizes", "starts", "payload").mapInArrow(work, "shard int, doc_id long, place long, n_tokens long, ids_crc32 long")
    # bases has one row per file shard, of which there are as many as write partitions
    return found.join(F.broadcast(bases), "shard").select("doc_id", (F.col("base") + F.col("place")).alias("start"), "n_tokens", "ids_crc32")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written as token files and read back; see read_files."""
    out = common.scratch(spark, "token-files")
    write_files(common.documents(spark, sf_dir, "doc_id", "text"), default_vocabulary(), out)
    return read_files(spark, out)
