"""Byte-level BPE encoding and decoding with a pair occurrence index.

The encoder gathers the distinct pre-tokens that a batch of texts brings, lays their symbols out in one array and maps each
mergeable pair to all its positions. Active ranks are applied in ascending order; each merge updates the position lists of the
pairs that it creates. Encodings of chunks are kept between the batches of a task in a bounded table.

Nulls are encoded as the empty text (no ids). Repeated rows give repeated results. Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: The pre-token pattern of byte-level BPE, and Unicode's white space.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPACE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Latin letters, all of them in Unicode's class L.
LATIN = r"A-Za-z\xc0-\xd6\xd8-\xf6\xf8-ɏ"
#: Chunks (pre-tokens among them) that a task keeps; beyond it the tables start anew, and a task's end frees them for the next stage.
KEPT = 800_000
#: Pre-tokens that are laid out and indexed together.
AT_ONCE = 50_000
#: Texts are encoded in groups of at least so many characters.
GROUP_CHARS = 2_500_000
#: The same two for texts that are encoded in a column, beside all else that a pipeline's executors hold.
COLUMN_KEPT, COLUMN_CHARS = 100_000, 500_000


def byte_chars() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary: itself where visible, else 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = (b for b in range(256) if b not in set(plain))
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


def checked_settings(data: dict) -> dict[str, int]:
    """The special tokens of a vocabulary file; files that ask for anything but plain byte-level BPE are refused."""
    pre, model = data.get("pre_tokenizer") or {}, data["model"]
    odd = [k for k in ("normalizer", "post_processor") if data.get(k)]
    odd += [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges") if model.get(k)]
    odd += [f"added token {t['content']}" for t in data["added_tokens"] if t.get("single_word") or t.get("lstrip") or t.get("rstrip")]
    if pre.get("type") != "ByteLevel" or pre.get("add_prefix_space", True) or not pre.get("use_regex", True):
        odd.append("pre_tokenizer")
    if (data.get("decoder") or {}).get("type") != "ByteLevel":
        odd.append("decoder")
    if odd:
        raise ValueError(f"not a plain byte-level BPE: {', '.join(odd)}")
    return {t["content"]: t["id"] for t in data["added_tokens"]}


class Vocabulary:
    """What the vocabulary file says: token bytes, merge ranks and special tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        model = data["model"]
        to_byte = {c: b for b, c in byte_chars().items()}
        ids = model["vocab"]
        self.special = checked_settings(data)
        self.bytes = [b""] * (1 + max(*ids.values(), *self.special.values(), 0))
        for token, i in ids.items():
            self.bytes[i] = bytes(to_byte[c] for c in token)
        for token, i in self.special.items():
            self.bytes[i] = token.encode()
        self.of_byte = np.zeros(256, dtype=np.int64)
        for c, b in to_byte.items():
            self.of_byte[b] = ids[c]
        self.rank: dict[int, int] = {}
        self.merged: list[int] = []
        made = dict.fromkeys((int(x) for x in self.of_byte), -1)
        for r, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            left, right, both = ids[a], ids[b], ids[a + b]
            if max(made.get(left, r), made.get(right, r)) >= r or made.setdefault(both, r) != r:
                raise ValueError(f"merge {r} uses a token that no earlier merge makes; ranks can't be applied in one ascending pass")
            self.rank[left << 20 | right] = r
            self.merged.append(both)


class PairIndex:
    """Encodes many distinct pre-tokens at once."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary

    def encode(self, tokens: list[bytes]) -> list[bytes]:
        """The ids of each pre-token, as little-endian unsigned 32-bit integers."""
        if not tokens:
            return []
        v, rank, merged = self.v, self.v.rank, self.v.merged
        sizes = np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens))
        raw = np.frombuffer(b"".join(tokens), dtype=np.uint8)
        first = np.concatenate([[0], np.cumsum(sizes)])
        symbols = v.of_byte[raw]
        n = len(raw)
        last = np.zeros(n, dtype=bool)
        last[first[1:][sizes > 0] - 1] = True
        # the pairs of bytes, by rank; positions ascend within each rank
        keys = np.flatnonzero(~last[:-1]) if n > 1 else np.empty(0, dtype=np.int64)
        pairs = symbols[keys] << 20 | symbols[keys + 1]
        distinct, where = np.unique(pairs, return_inverse=True)
        ranks = np.array([rank.get(p, -1) for p in distinct.tolist()], dtype=np.int64)[where] if len(pairs) else pairs
        keys, ranks = keys[ranks >= 0], ranks[ranks >= 0]
        order = np.argsort(ranks, kind="stable")
        keys, ranks = keys[order], ranks[order]
        cuts = np.flatnonzero(np.diff(ranks)) + 1
        starts = ranks[np.concatenate([[0], cuts])].tolist() if len(ranks) else []
        at = dict(zip(starts, (x.tolist() for x in np.split(keys, cuts)), strict=True)) if len(ranks) else {}
        active = list(at)  # ascending, so a heap
        s = symbols.tolist()
        after = list(range(1, n + 1))
        for i in np.flatnonzero(last).tolist():
            after[i] = -1
        before = list(range(-1, n - 1))
        for i in first[:-1][sizes > 0].tolist():
            before[i] = -1
        while active:
            r = heapq.heappop(active)
            positions = at.pop(r)
            new = merged[r]
            # what a position held when it was listed may have been merged since
            for i in sorted(positions):
                j = after[i]
                if j < 0 or s[i] < 0 or rank.get(s[i] << 20 | s[j]) != r:
                    continue
                s[i], s[j] = new, -1
                k = after[i] = after[j]
                if k >= 0:
                    before[k] = i
                    q = rank.get(new << 20 | s[k])
                    if q is not None:
                        if q in at:
                            at[q].append(i)
                        else:
                            at[q] = [i]
                            heapq.heappush(active, q)
                p = before[i]
                if p >= 0:
                    q = rank.get(s[p] << 20 | new)
                    if q is not None:
                        if q in at:
                            at[q].append(p)
                        else:
                            at[q] = [p]
                            heapq.heappush(active, q)
        final = np.array(s, dtype=np.int64)
        alive = final >= 0
        ends = np.concatenate([[0], np.cumsum(alive)])[first] * 4
        out = final[alive].astype("<u4").tobytes()
        ends = ends.tolist()
        return [out[a:b] for a, b in zip(ends, ends[1:], strict=False)]


class Encoder:
    """Encodes texts by chunks: pieces that begin at a lone space, which no pre-token crosses.

    encode_tokens turns a list of distinct pre-tokens (UTF-8) into the ids of each; split turns a chunk into pre-tokens.
    """

    def __init__(self, encode_tokens, special: dict[str, int], kept: int = KEPT):
        self.encode_tokens, self.kept = encode_tokens, kept
        self.special = {k: np.array([i], dtype="<u4").tobytes() for k, i in special.items() if k}
        self.at_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.runs = re.compile(f"([{SPACE}]{{2,}})")
        self.tokens_of = regex.compile(PRE_TOKEN).findall
        self.is_word = re.compile(f"[{LATIN}]+").fullmatch
        # for chunks of Latin letters and visible ASCII the same pattern without Unicode classes
        self.is_latin = re.compile(rf"[\x21-\x7e{LATIN}]+").fullmatch
        self.latin_tokens_of = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LATIN}]+| ?[0-9]+| ?[^\s{LATIN}0-9]+").findall
        self.bare: dict[str, bytes] = {}  # chunks without a space before them
        self.spaced: dict[str, bytes] = {}  # chunks after a space, which the key leaves out

    def _pieces(self, text: str) -> Iterator[tuple[dict | None, list[str] | str]]:
        """The chunks of a text in order, each list with the table that it belongs to."""
        for part in self.at_special.split(text) if self.at_special else [text]:
            if part in self.special:
                yield None, part
            elif part:
                runs = self.runs.split(part)
                for k in range(0, len(runs), 2):
                    words = runs[k].split(" ")
                    led = False
                    if k:
                        gap = runs[k - 1]
                        if not runs[k]:  # white space at the end of the text is one pre-token
                            yield self.bare, [gap]
                            continue
                        yield self.bare, [gap[:-1]]
                        led = gap[-1] == " "
                        if not led:
                            yield self.bare, [gap[-1]]
                    if words[0] or led:
                        yield (self.spaced if led else self.bare), words[:1]
                    if len(words) > 1:
                        yield self.spaced, words[1:]

    def forget(self) -> None:
        """Free what is kept between calls."""
        for table in (self.bare, self.spaced):
            table.clear()

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers."""
        if len(self.bare) + len(self.spaced) > self.kept:
            self.bare.clear()
            self.spaced.clear()
        plans = [list(self._pieces(t)) for t in texts]
        bare, spaced = set(), set()
        for plan in plans:
            for table, words in plan:
                if table is self.spaced:
                    spaced.update(words)
                elif table is not None:
                    bare.update(words)
        self._learn(self.bare, list(bare.difference(self.bare)), "")
        self._learn(self.spaced, list(spaced.difference(self.spaced)), " ")
        return [b"".join([b"".join(map(table.__getitem__, words)) if table is not None else self.special[words] for table, words in plan]) for plan in plans]

    def _place(self, token: str) -> tuple[dict[str, bytes], str]:
        """Where a pre-token is kept: with the chunk of the same text."""
        return (self.spaced, token[1:]) if token[0] == " " else (self.bare, token)

    def _learn(self, table: dict[str, bytes], chunks: list[str], lead: str) -> None:
        """Add chunks to their table, asking once for each pre-token not known yet."""
        is_word, is_latin, place = self.is_word, self.is_latin, self._place
        split = [[lead + c] if is_word(c) else self.latin_tokens_of(lead + c) if is_latin(c) else self.tokens_of(lead + c) for c in chunks]
        fresh = dict.fromkeys([s[0] for s in split if len(s) == 1])
        for t in {t for s in split if len(s) > 1 for t in s}:
            at, key = place(t)
            if key not in at:
                fresh[t] = None
        todo = list(fresh)
        for k in range(0, len(todo), AT_ONCE):
            some = todo[k : k + AT_ONCE]
            for t, ids in zip(some, self.encode_tokens([t.encode() for t in some]), strict=True):
                at, key = place(t)
                at[key] = ids
        for c, s in zip(chunks, split, strict=True):
            if len(s) > 1 or c not in table:  # white space that begins with a space is kept in the other table first
                table[c] = b"".join([at[key] for at, key in map(place, s)])


_ENCODERS: dict[tuple, tuple] = {}


def _index_encoder(path: str, kept: int = KEPT) -> tuple[Encoder, Vocabulary]:
    """This worker's encoder for a vocabulary file."""
    if (path, kept) not in _ENCODERS:
        v = Vocabulary(path)
        _ENCODERS[path, kept] = Encoder(PairIndex(v).encode, v.special, kept), v
    return _ENCODERS[path, kept]


def grouped(texts: Iterable, least: int = GROUP_CHARS) -> Iterator[list]:
    """Consecutive texts of about `least` characters together."""
    group, size = [], 0
    for t in texts:
        group.append(t)
        size += len(t) if t is not None else 0
        if size >= least:
            yield group
            group, size = [], 0
    if group:
        yield group


def slices(texts: pa.Array, most_bytes: int = GROUP_CHARS) -> Iterator[tuple[int, int]]:
    """Where to cut texts into runs of at most about so many bytes."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy())
    at = 0
    while at < len(texts):
        before = sizes[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(sizes, before + most_bytes, side="right")))
        yield at, to
        at = to


def decode(ids: np.ndarray, pieces: list[bytes]) -> str:
    """The text of ids; bytes that aren't UTF-8 become U+FFFD."""
    return b"".join(map(pieces.__getitem__, ids.tolist())).decode("utf-8", "replace")


def encode_column(df: DataFrame, path: str, text: str = "text", kept_chunks: int = COLUMN_KEPT, chars: int = COLUMN_CHARS) -> DataFrame:
    """df without `text`, with ids array<int> and decoded string. Clashing columns of df named ids or decoded are replaced."""
    kept = [c for c in df.columns if c.lower() not in {text, "ids", "decoded"}]
    given = common.plainly_named(df.select(*map(common.quoted, kept), F.col(text)))
    at_text, names = len(kept), given.columns[: len(kept)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, v = _index_encoder(path, kept_chunks)
        for batch in batches:
            for at, to in slices(batch.column(at_text), chars):
                rows = batch.slice(at, to - at)
                group = rows.column(at_text).to_pylist()
                ids = [np.frombuffer(x, dtype="<u4") for x in encoder.encode([t or "" for t in group])]
                yield pa.RecordBatch.from_arrays(
                    [*(rows.column(k) for k in range(at_text)), pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())), pa.array([decode(x, v.bytes) for x in ids], pa.string())],
                    names=[*names, "ids", "decoded"],
                )
        encoder.forget()

    schema = T.StructType([*given.schema.fields[:at_text], T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])
    return given.mapInArrow(common.released(work), schema).toDF(*kept, "ids", "decoded")


def digests(df: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row of df(doc_id, text)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, v = _index_encoder(path)
        decimal = [str(i) for i in range(len(v.bytes))]
        sha = hashlib.sha256
        for batch in batches:
            doc = batch.column("doc_id")
            for at, to in slices(batch.column("text")):
                group = batch.column("text").slice(at, to - at).to_pylist()
                n, a, b = [], [], []
                for x in encoder.encode([t or "" for t in group]):
                    ids = np.frombuffer(x, dtype="<u4").tolist()
                    n.append(len(ids))
                    a.append(sha(",".join(map(decimal.__getitem__, ids)).encode()).hexdigest())
                    b.append(sha(b"".join(map(v.bytes.__getitem__, ids)).decode("utf-8", "replace").encode()).hexdigest())
                yield pa.RecordBatch.from_arrays([doc.slice(at, len(group)), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        encoder.forget()

    return df.select(F.col("doc_id").cast("long"), "text").mapInArrow(common.released(work), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def default_vocabulary() -> str:
    """Where the public byte-level vocabulary lies."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """Every document encoded and decoded again; see digests."""
    return digests(common.documents(spark, sf_dir, "doc_id", "text"), path or default_vocabulary())
