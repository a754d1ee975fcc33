"""Collocations by Apriori passes over n-grams, level by level.

Texts are cut into pieces at marks and line ends and pieces into words; a phrase is a run of words within a piece, and everything is
counted per language. The first pass counts words. Each later pass reads the texts again and emits only those k-grams both of whose
overlapping (k-1)-grams are frequent, which every k-gram that occurs often enough is; what a task emits it has summed before. The
frequent (k-1)-grams are broadcast as a bit per hash, in a map that is never larger than MOST_BITS whatever the corpus: a hash that
two phrases share lets a rare k-gram be emitted, which its exact count then removes, so results do not depend on the map.
Cuts are scored from the tables of the levels.

A null text has no words; a null language is `und`. Repeated rows count each time. An empty table gives an empty result, extra
columns change nothing. Ties in rank go by phrase, which is unique in a language. Texts of any length are taken a run of pieces at a
time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

LEAST, LONGEST, TOP = 10, 3, 2000
#: A phrase goes if a longer one that holds it has at least this share, in percent, of its occurrences.
SHADOW = 50
#: Bytes of text whose n-grams are summed at once, rows of them that are sent on together, and how many bits the map of a level's frequent phrases has.
GROUP_BYTES, SENT_ROWS, LEAST_BITS, MOST_BITS, BITS_EACH = 5_000_000, 100_000, 1 << 20, 1 << 29, 32
MARK = re.compile(rb"[.,;:!?\x0A-\x0D]")
#: Marks become line ends and tabs blanks.
PLAIN = bytes.maketrans(b".,;:!?\x0b\x0c\r\t", b"\n" * 9 + b" ")
COUNTED = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("n", pa.int64())])


class Known(dict):
    """Numbers of words by first appearance; the end of a piece is 0 and the empty word 1."""

    def __init__(self):
        super().__init__({b"\n": 0, b"": 1})

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def hashes(words: list[bytes], lang: bytes) -> np.ndarray:
    seed = xxhash.xxh64_intdigest(lang)
    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), dtype=np.uint64, count=len(words))


def extended(h: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The hash of a phrase of hash h with one more word, of hash last."""
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + last
    return h ^ (h >> np.uint64(32))


def admitted(h: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Which hashes have their bit set."""
    at = h & np.uint64(len(bits) * 8 - 1)
    return (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def summed(texts: list[bytes], lang: bytes, maps: list[np.ndarray]) -> tuple[pa.Array, np.ndarray]:
    """The grams of one level more than there are maps, and how often each occurs in the texts; with words, the empty one: their number."""
    known = Known()
    parts = b"\n".join(texts).lower().translate(PLAIN).replace(b"\n", b" \n ").split(b" ")
    gram = np.fromiter(map(known.__getitem__, parts), dtype=np.int64, count=len(parts))
    del parts
    words = pa.array(known, pa.binary())
    gram = gram[gram != 1]
    if not maps:
        counts = np.bincount(gram, minlength=len(words))
        counts[1] = counts[2:].sum()
        return words[1:], counts[1:]
    word = hashes(list(known), lang)
    # of each gram its words and its hash; number 0 is no gram
    of, h = [np.arange(len(words))], word
    for level, bits in enumerate(maps):
        good = admitted(h, bits)
        good[: 2 if level == 0 else 1] = False
        gram = np.where(good[gram], gram, 0)
        live = np.flatnonzero((gram[:-1] > 0) & (gram[1:] > 0))
        pairs, entry, counts = np.unique(gram[live] * len(h) + gram[live + 1], return_inverse=True, return_counts=True)
        head, tail = pairs // len(h), of[-1][pairs % len(h)]
        h = np.concatenate([h[:1], extended(h[head], word[tail])])
        of = [np.concatenate([[0], x]) for x in (*(x[head] for x in of), tail)]
        gram = np.zeros(max(len(gram) - 1, 0), dtype=np.int64)
        gram[live] = entry + 1
    return pc.binary_join_element_wise(*[words.take(pa.array(x[1:])) for x in of], b" "), counts


def _runs(text: bytes) -> Iterator[bytes]:
    """A text in runs of whole pieces, of about GROUP_BYTES each."""
    at = 0
    while len(text) - at > GROUP_BYTES and (cut := MARK.search(text, at + GROUP_BYTES)):
        yield text[at : cut.end()]
        at = cut.end()
    yield text[at:] if at else text


def _counter(maps: list):
    """The partial sums of a task."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[bytes]] = {}
        size = 0
        values = [m.value for m in maps]

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, texts in held.items():
                names, counts = summed(texts, lang.encode(), values)
                for k in range(0, len(names), SENT_ROWS):
                    some = names[k : k + SENT_ROWS].cast(pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array([lang]).take(pa.array(np.zeros(len(some), dtype=np.int32))), some, pa.array(counts[k : k + SENT_ROWS], pa.int64())], schema=COUNTED)
            held.clear()

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                for run in _runs(text):
                    held.setdefault(lang, []).append(run)
                    size += len(run)
                    if size >= GROUP_BYTES:
                        yield from flush()
                        size = 0
        yield from flush()

    return common.released(work)


def counted(docs: DataFrame, maps: list) -> DataFrame:
    """lang, phrase, f of the next level's grams; docs(lang, text) has no nulls."""
    return docs.mapInArrow(_counter(maps), "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("f"))


def bit_map(frequent: DataFrame) -> np.ndarray:
    """A bit for each hash of the frequent phrases; at most MOST_BITS of them, whatever their number."""
    n_bits = LEAST_BITS
    wanted = BITS_EACH * frequent.count()
    while n_bits < min(wanted, MOST_BITS):
        n_bits *= 2

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, phrases, at = batch.column("lang"), batch.column("phrase").cast(pa.binary()), [np.zeros(0, dtype=np.uint64)]
            for lang in langs.unique():
                split = pc.split_pattern(phrases.filter(pc.equal(langs, lang)), b" ")
                known = Known()
                word = np.fromiter(map(known.__getitem__, split.flatten().to_pylist()), dtype=np.int64).reshape(len(split), -1)
                of = hashes(list(known), lang.as_py().encode())
                h = of[word[:, 0]]
                for k in range(1, word.shape[1]):
                    h = extended(h, of[word[:, k]])
                at.append(h & np.uint64(n_bits - 1))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(at).astype(np.int64))], names=["at"])

    # at most a row per 64 bits comes to the driver
    bits = frequent.select("lang", "phrase").mapInArrow(work, "at long").groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits")).toArrow()
    found = np.zeros(n_bits // 64, dtype=np.int64)
    found[bits.column("word").to_numpy()] = bits.column("bits").to_numpy()
    return found.astype("<i8").view(np.uint8)


def levels(docs: DataFrame, least: int = LEAST, longest: int = LONGEST) -> tuple[list[DataFrame], DataFrame]:
    """For each length the frequent phrases (lang, phrase, f), settled; and the words of each language (lang, n)."""
    spark, maps, found = docs.sparkSession, [], []
    for k in range(1, longest + 1):
        rows = common.settle(counted(docs, maps).where((F.col("f") >= least) | (F.col("phrase") == "")), f"grams{k}")
        found.append(rows.where("phrase != ''"))
        if k == 1:
            totals = rows.where("phrase = ''").select("lang", F.col("f").alias("n"))
        if k < longest:
            maps.append(spark.sparkContext.broadcast(bit_map(found[-1])))
    return found, totals


def scored(found: list[DataFrame]) -> DataFrame:
    """lang, phrase, a, l, r, score of every phrase of several words, by its lowest-scoring cut (the first of equals)."""
    cuts, longest = None, len(found)
    for size in range(2, len(found) + 1):
        ks = F.explode(F.sequence(F.lit(1), F.lit(size - 1))).alias("k")
        part = found[size - 1].select("lang", "phrase", F.col("f").alias("a"), ks).withColumn("words", F.split("phrase", " "))
        part = part.select("lang", "phrase", "a", "k", F.array_join(F.slice("words", 1, F.col("k")), " ").alias("first"), F.array_join(F.slice("words", F.col("k") + 1, F.lit(size)), " ").alias("rest"))
        cuts = part if cuts is None else cuts.unionByName(part)
    parts = found[0]
    for level in found[1:-1]:
        parts = parts.unionByName(level)
    left = parts.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l"))
    right = parts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    # what a word begins or ends is no more than its language's frequent phrases; AQE splits what is hot in it
    both = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"])
    whole = lambda c: F.col(c).cast("decimal(19,0)")
    both = both.withColumns({"top": whole("a") * whole("a") * F.lit(1_000_000).cast("decimal(7,0)"), "below": whole("l") * whole("r")}).withColumn("score", F.expr("top div below"))
    # a score is at most 1,000,000, so score and cut fit in one number
    both = both.withColumn("cut", F.col("score") * longest + F.col("k"))
    best = both.groupBy("lang", "phrase", "a").agg(F.min("cut").alias("cut"), F.min_by("l", "cut").alias("l"), F.min_by("r", "cut").alias("r"))
    return best.select("lang", "phrase", "a", "l", "r", F.floor(F.col("cut") / longest).alias("score"))


def shadows(found: list[DataFrame]) -> DataFrame:
    """lang, phrase, most: how often the most frequent longer candidate occurs that holds the phrase."""
    parts = None
    for size in range(3, len(found) + 1):
        words = F.split("phrase", " ")
        for short in range(2, size):
            runs = F.array(*[F.array_join(F.slice(words, i, short), " ") for i in range(1, size - short + 2)])
            part = found[size - 1].select("lang", F.explode(runs).alias("phrase"), "f")
            parts = part if parts is None else parts.unionByName(part)
    return parts.groupBy("lang", "phrase").agg(F.max("f").alias("most"))


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, shadow: int = SHADOW) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of docs(lang, text): each language's first `top` phrases of 2 to `longest` words."""
    given = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    found, totals = levels(given, least, longest)
    rows = scored(found)
    if longest > 2:
        rows = rows.join(shadows(found), ["lang", "phrase"], "left").where(F.col("most").isNull() | (100 * F.col("most") < shadow * F.col("a")))
    # a limit on the rank reaches the map side, so a language's phrases do not meet before it
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    first = rows.withColumn("rank", rank).where(F.col("rank") <= top)
    return common.join_small(first, totals, ["lang"]).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The collocations of each language of the documents."""
    return collocations(common.documents(spark, sf_dir, "lang", "text"))


ORACLE = r"""WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
g AS (SELECT lang, t.s AS size, array_to_string(w[u.i:u.i + t.s - 1], ' ') AS phrase FROM w, range(1, 4) AS t(s), unnest(range(1, len(w) - t.s + 2)) AS u(i)),
f AS (SELECT lang, size, phrase, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE size = 1 GROUP BY lang),
c AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE size > 1 AND f >= 10),
k AS (SELECT c.*, t.k, array_to_string(w[1:t.k], ' ') AS head, array_to_string(w[t.k + 1:size], ' ') AS rest FROM c, range(1, 3) AS t(k) WHERE t.k < size),
s AS (SELECT k.lang, k.phrase, k.size, k.a, k.k, x.f AS l, y.f AS r, (1000000::HUGEINT * k.a * k.a) // (x.f::HUGEINT * y.f) AS score FROM k JOIN f x ON x.lang = k.lang AND x.phrase = k.head JOIN f y ON y.lang = k.lang AND y.phrase = k.rest),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
h AS (SELECT lang, phrase, max(a) AS most FROM (SELECT lang, a, array_to_string(w[i:i + 1], ' ') AS phrase FROM c, range(1, 3) AS t(i) WHERE size = 3) GROUP BY ALL),
d AS (SELECT b.* FROM b LEFT JOIN h USING (lang, phrase) WHERE h.most IS NULL OR 100 * h.most < 50 * b.a)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM d) JOIN n USING (lang) WHERE rank <= 2000"""
