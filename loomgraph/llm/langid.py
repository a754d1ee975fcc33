"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

Texts become lower-case letters with one blank symbol for everything else; n-grams of one to three symbols are hashed into
buckets. A feature is an n-gram's share of the text times its inverse document frequency. The weights are learnt by
follow-the-regularised-leader with elastic-net penalties, and a temperature is fitted on rows kept out of that. Prediction
sees nothing but the text. Every labelled language is learnt, from a bounded sample of labelled texts cut into pieces (documented
parameters: PER_LANG different pieces of each language, or an equal part of MOST_ROWS where there are more languages, of PIECE
characters), drawn by hash from all pieces of all labelled texts, however long; every whole text is predicted. The number of
labels is the bound of the model, which takes about 1.5 MB a label while it is learnt.

A null text or one without a letter is `und` with score 0, as is every text where no labelled row is left to learn from.
Null doc_ids are neither held out nor learnt from. Rows equal in doc_id, text and label are learnt from once. Extra columns
change nothing.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .bpe import grouped

ORDERS, BITS = (1, 2, 3), 15
PER_LANG, MOST_ROWS, PIECE = 1500, 96_000, 10_000
SCALE, ALPHA, BETA, L1, L2, EPOCHS, SEED = 10.0, 0.3, 1.0, 0.02, 0.1, 3, 6
NONE = "und"


@lru_cache(1)
def _letters() -> np.ndarray:
    """For each character of the basic plane: its lower-case form if it is a letter, else 0."""
    table = np.zeros(1 << 16, dtype=np.uint32)
    for c in range(1 << 16):
        if unicodedata.category(chr(c))[0] == "L":
            table[c] = ord(chr(c).lower()[0])
    return table


def symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts, a blank before and two after each, and where each text starts."""
    raw = np.frombuffer("".join(f"\n{t}\n\n" for t in texts).encode("utf-32-le"), dtype="<u4")
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 3
    table = _letters()
    # beyond the basic plane every character is a symbol of its own
    return np.where(raw < 1 << 16, table[np.minimum(raw, 0xFFFF)], raw), np.concatenate([[0], np.cumsum(sizes)])


def buckets(s: np.ndarray, starts: np.ndarray, order: int) -> np.ndarray:
    """The bucket of the n-gram that starts at each symbol; that of the last two symbols of a text is the order's first."""
    h = s.astype(np.uint32) * np.uint32(2654435761)
    for k in range(1, order):
        h = (h ^ (h >> np.uint32(15))) * np.uint32(2246822519)
        h[: len(s) - k] += s[k:] * np.uint32(3266489917)
    h ^= h >> np.uint32(13)
    h *= np.uint32(668265263)
    found = (h >> np.uint32(32 - BITS)).astype(np.int64)
    found[starts[1:] - 1] = found[starts[1:] - 2] = 0
    return found + ((order - 1) << BITS)


def train(texts: list[str], langs: list[str], fold: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray, float]:
    """Languages, weights with IDF (buckets x languages), biases, temperature. fold: rows for the temperature."""
    names = sorted(set(langs))
    place = {x: k for k, x in enumerate(names)}
    y = np.array([place[x] for x in langs])
    rows = []
    for group in grouped(texts, 500_000):  # the n-grams of a few texts at a time
        s, starts = symbols(group)
        grams = [buckets(s, starts, k).astype(np.int32) for k in ORDERS]
        for a, b in zip(starts, starts[1:], strict=False):
            f, n = np.unique(np.concatenate([g[a:b] for g in grams]), return_counts=True)
            rows.append((f, (n / max(b - a, 1)).astype(np.float32)))
    size = len(ORDERS) << BITS
    df = np.zeros(size, dtype=np.int64)
    for f, _ in rows:
        df[f] += 1
    idf = np.log((1 + len(rows)) / (1 + df)) + 1
    z, n2 = np.zeros((size + 1, len(names))), np.zeros((size + 1, len(names)))

    def weights(z: np.ndarray, n2: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= L1, 0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n2)) / ALPHA + L2))

    def softmax(v: np.ndarray) -> np.ndarray:
        e = np.exp(v - v.max(axis=-1, keepdims=True))
        return e / e.sum(axis=-1, keepdims=True)

    rows = [(np.append(f, np.int32(size)), np.append(SCALE * tf * idf[f], 1.0).astype(np.float32)) for f, tf in rows]
    learn, rng = np.flatnonzero(~fold), np.random.default_rng(SEED)
    for _ in range(EPOCHS):
        for i in rng.permutation(learn):
            f, x = rows[i]
            w = weights(z[f], n2[f])
            p = softmax(x @ w)
            p[y[i]] -= 1
            g = x[:, None] * p
            z[f] += g - (np.sqrt(n2[f] + g * g) - np.sqrt(n2[f])) / ALPHA * w
            n2[f] += g * g
    w = weights(z, n2)
    kept = np.flatnonzero(fold) if fold.any() else learn
    logits = np.array([x @ w[f] for f, x in (rows[i] for i in kept)])

    def loss(log_t: float) -> float:
        return float(-np.log(softmax(logits / math.exp(log_t))[np.arange(len(kept)), y[kept]] + 1e-12).mean())

    low, high = math.log(0.05), math.log(20)
    for _ in range(60):
        a, b = low + (high - low) * 0.382, low + (high - low) * 0.618
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return names, (SCALE * idf[:, None] * w[:size]).astype(np.float32), w[size].astype(np.float32), math.exp((low + high) / 2)


def predict(texts: list[str | None], model: tuple) -> tuple[list[str], np.ndarray]:
    """Language and calibrated probability of each text."""
    names, weights, bias, temperature = model
    given = ["" if t is None else t for t in texts]
    s, starts = symbols(given)
    size = np.maximum(np.diff(starts), 1)
    logits = np.zeros((len(given), len(names)), dtype=np.float64) + bias
    for k in ORDERS:
        logits += np.add.reduceat(weights[buckets(s, starts, k)], starts[:-1], axis=0) / size[:, None]
    logits /= temperature
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    p = e / e.sum(axis=1, keepdims=True)
    best = p.argmax(axis=1)
    lettered = np.maximum.reduceat(np.where(s < 1 << 16, s, 0), starts[:-1]) > 0
    for i in np.flatnonzero(~lettered).tolist():
        lettered[i] = any(map(str.isalpha, given[i]))
    return [names[b] if ok else NONE for b, ok in zip(best.tolist(), lettered.tolist(), strict=True)], np.where(lettered, p[np.arange(len(best)), best], 0.0)


def held_out() -> F.Column:
    """Whether crc32 of doc_id's text leaves no remainder by 5."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, per_lang: int = PER_LANG, most_rows: int = MOST_ROWS, piece: int = PIECE) -> tuple | None:
    """The model, learnt from docs(doc_id, text, lang) that are not held out; None without labelled rows."""
    spark = docs.sparkSession
    usable = docs.select("doc_id", "text", "lang").where(F.col("doc_id").isNotNull() & (F.col("lang") != NONE) & (F.length("text") > 0) & ~held_out())
    n_pieces = F.ceil(F.length("text") / piece).cast("int")
    counts = usable.groupBy("lang").agg(F.sum(n_pieces).alias("count")).collect()  # a row per label
    if not counts:
        return None
    # the share of each language that gives about so many pieces, so no more than that is ever gathered
    per_lang = min(per_lang, most_rows / len(counts))
    share = spark.createDataFrame([(r["lang"], min(1.0, per_lang / r["count"])) for r in counts], "lang string, share double")
    marked = usable.withColumns({"mark": F.xxhash64("doc_id", "text", F.lit(SEED)), "n_pieces": n_pieces})
    draw = lambda k: F.pmod(F.xxhash64(F.col("mark"), k), F.lit(1 << 40)) / (1 << 40)
    # one row per label is broadcast; only texts that a piece is drawn of are cut
    drawn = marked.join(F.broadcast(share), "lang").where(F.exists(F.sequence(F.lit(0), F.col("n_pieces") - 1), lambda k: draw(k) < F.col("share")))
    pieces = F.transform(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{piece}}}"), F.lit(0)), lambda x, k: F.struct(draw(k).alias("draw"), x.alias("text")))
    sample = drawn.select("lang", F.inline(F.filter(pieces, lambda x: x["draw"] < F.col("share")))).dropDuplicates(["lang", "draw"])

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        given = list(batches)
        if sum(map(len, given)):
            rows = pd.concat(given).sort_values(["draw", "text", "lang"], ignore_index=True)
            fold = np.arange(len(rows)) % 5 == 0
            names, weights, bias, temperature = train(rows["text"].tolist(), rows["lang"].tolist(), fold)
            yield pd.DataFrame({"names": [names], "weights": [weights.tobytes()], "bias": [bias.tobytes()], "temperature": [temperature]})

    got = sample.repartition(1).mapInPandas(common.released(work), "names array<string>, weights binary, bias binary, temperature double").first()
    if got is None:
        return None
    k = len(got.names)
    return list(got.names), np.frombuffer(got.weights, dtype=np.float32).reshape(-1, k), np.frombuffer(got.bias, dtype=np.float32), got.temperature


def identify(docs: DataFrame, model: tuple | None) -> DataFrame:
    """doc_id, lang_pred, score of docs(doc_id, text)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for group in grouped(batch.column("text").to_pylist(), 500_000):
                langs, score = predict(group, model) if model else ([NONE] * len(group), np.zeros(len(group)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, len(group)), pa.array(langs, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])
                at += len(group)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(common.released(work), "doc_id long, lang_pred string, score double")


def accepted(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """docs without the rows whose text has no letter or whose language gets a probability under `least`.

    Each row is judged by its own text, in the pass that reads it. Where no labelled row is left to learn from, nothing is
    recognised as foreign and every text with a letter stays.
    """
    model = fit(docs.select("doc_id", "text", "lang"))
    if model is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    text = docs.columns.index("text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for group in grouped(batch.column(text).to_pylist(), 500_000):
                langs, score = predict(group, model)
                good += [x != NONE and s >= least for x, s in zip(langs, score.tolist(), strict=True)]
            yield batch.filter(pa.array(good, pa.bool_()))

    plain = common.plainly_named(docs)
    return plain.mapInArrow(common.released(work), plain.schema).toDF(*docs.columns)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents, learnt from those that are not held out."""
    docs = common.documents(spark, sf_dir, "doc_id", "text", "lang")
    return identify(docs, fit(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
