"""Quality and toxicity by a document classifier and hierarchical empirical Bayes over hosts and paths.

The classifier is logistic regression on hashed words and a few measures of style, learnt from a bounded sample of labelled
documents of any length (documented parameter SAMPLE: about so many labels are drawn), whose features are gathered, not their texts. Its probabilities over all documents are grouped by host and by path. Method-of-moments
estimates give how strongly hosts vary around the global mean and paths around their host; the posterior mean of a host shrinks
to the global prior, and that of a path to its host's, the more the sparser they are. A document's odds are then multiplied by
how its path's posterior odds differ from the global odds.

Null texts count as empty. Null hosts or paths form a group of their own. A document without labels anywhere to learn from gets
probability 0.5. Rows with equal doc_id are kept; a single one of them is learnt from, with each different label that it has. An
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .bpe import grouped

BUCKETS, SAMPLE, SEED = 1 << 20, 6000, 3
#: Standard errors that a word's share of labelled documents must stray by to become a feature.
STRAY = 4.0
EPOCHS, RATE, RIDGE = 12, 0.5, 1e-5
HEADS = ("quality", "toxic")
#: Measures of style: words in upper case, symbols a word (ASCII marks that are not of sentences), repeats of the word before,
#: different words, each as a share of the words, and a tenth of the mean length of a word.
STYLES = 5
SYMBOLS = b"#$%&*+/<=>@[\\]^_`{|}~"


class Hashed(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh32_intdigest(word) % BUCKETS
        return h


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of each word, where each text's words start, and each text's style shares."""
    table, starts, flat, style = Hashed(), [0], [], np.zeros((len(texts), STYLES))
    for k, t in enumerate(texts):
        raw = (t or "").encode()
        words = raw.split()
        n = max(len(words), 1)
        flat += map(table.__getitem__, [w.lower().strip(b".,!?") for w in words])
        starts.append(len(flat))
        style[k] = sum(map(bytes.isupper, words)) / n, (len(raw) - len(raw.translate(None, SYMBOLS))) / n, sum(a == b for a, b in zip(words, words[1:], strict=False)) / n, len(set(words)) / n, sum(map(len, words)) / n / 10
    return np.array(flat, dtype=np.int64), np.array(starts), style


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def learn(rows: list[np.ndarray], style: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word weights (buckets x heads) and style weights with a bias, by adaptive gradient steps over single documents.

    rows are the buckets of each document's words, each once; toxic words weigh the same in long and short texts.
    """
    w, v = np.zeros((BUCKETS, len(HEADS))), np.zeros((STYLES + 1, len(HEADS)))
    gw, gv = np.full(w.shape, 1e-2), np.full(v.shape, 1e-2)
    df = np.bincount(np.concatenate(rows), minlength=BUCKETS)
    useful = np.zeros(BUCKETS, dtype=bool)
    for k in range(len(HEADS)):
        rate = min(1 - 1e-6, max(1e-6, labels[:, k].mean()))
        hits = np.bincount(np.concatenate(rows), weights=np.repeat(labels[:, k], [len(r) for r in rows]), minlength=BUCKETS)
        useful |= np.abs(hits - df * rate) > STRAY * np.sqrt(np.maximum(df, 1) * rate * (1 - rate))
    rows = [r[useful[r]] for r in rows]
    extra = np.hstack([style, np.ones((len(rows), 1))])
    rng = np.random.default_rng(SEED)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            f, x = rows[i], extra[i]
            g = _sigmoid(w[f].sum(axis=0) + x @ v) - labels[i]
            gw[f] += g * g
            w[f] -= RATE * 0.2 * (g + RIDGE * w[f]) / np.sqrt(gw[f])
            step = x[:, None] * g
            gv += step * step
            v -= RATE * step / np.sqrt(gv)
    return w.astype(np.float32), v


def classify(texts: list[str | None], model: tuple) -> np.ndarray:
    """Probabilities (texts x heads)."""
    at, some, v = model
    w = np.zeros((BUCKETS, len(HEADS)), dtype=np.float32)
    w[at] = some
    known = np.zeros(BUCKETS, dtype=bool)
    known[at] = True
    flat, starts, style = features(texts)
    total = np.hstack([style, np.ones((len(texts), 1))]) @ v
    owner = np.repeat(np.arange(len(texts)), np.diff(starts))[known[flat]]
    once = np.unique(owner * BUCKETS + flat[known[flat]])
    for k in range(len(HEADS)):
        total[:, k] += np.bincount(once // BUCKETS, weights=w[once % BUCKETS, k], minlength=len(texts))
    return _sigmoid(total)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple | None:
    """The classifier from docs(doc_id, text) and labels(doc_id, quality, toxic)."""
    known = labels.where("doc_id is not null and quality is not null and toxic is not null").select(F.col("doc_id").cast("long"), *HEADS).distinct()
    draw = F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1 << 40)) / (1 << 40)
    chosen = known.where(draw < min(1.0, sample / max(known.count(), 1))).withColumn("draw", draw)
    # about `sample` rows of three numbers are broadcast, whatever the size of labels
    rows = docs.where("text is not null").select("doc_id", "text", F.xxhash64("text").alias("mark")).join(F.broadcast(chosen), "doc_id")

    def featured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            flat, starts, style = features(pdf["text"].tolist())
            words = [np.unique(flat[a:b]).astype(np.int32).tobytes() for a, b in zip(starts, starts[1:], strict=False)]
            yield pdf[["draw", "mark", *HEADS]].assign(words=words, style=[x.tobytes() for x in style])

    heads = ", ".join(f"{h} double" for h in HEADS)
    found = rows.select("draw", "mark", "text", *[F.col(h).cast("double").alias(h) for h in HEADS]).mapInPandas(featured, f"draw double, mark long, {heads}, words binary, style binary")
    # of many rows of one doc_id a single one is learnt from, so what is gathered is bounded by the labels drawn
    found = found.groupBy("draw", *HEADS).agg(F.min(F.struct("mark", "words", "style")).alias("row")).select("draw", *HEADS, "row.*")

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        given = list(batches)
        if sum(map(len, given)):
            pdf = pd.concat(given).sort_values(["draw", "mark", *HEADS], ignore_index=True)
            w, v = learn([np.frombuffer(x, dtype=np.int32) for x in pdf["words"]], np.array([np.frombuffer(x) for x in pdf["style"]]), pdf[list(HEADS)].to_numpy(float))
            at = np.flatnonzero(w.any(axis=1)).astype(np.int32)
            yield pd.DataFrame({"at": [at.tobytes()], "w": [w[at].tobytes()], "v": [v.tobytes()]})

    got = found.repartition(1).mapInPandas(common.released(work), "at binary, w binary, v binary").first()
    return (np.frombuffer(got.at, dtype=np.int32), np.frombuffer(got.w, dtype=np.float32).reshape(-1, len(HEADS)), np.frombuffer(got.v).reshape(-1, len(HEADS))) if got else None


def evidence(docs: DataFrame, model: tuple | None) -> DataFrame:
    """doc_id, host, path, p_quality, p_toxic of docs(doc_id, text, host, path)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for group in grouped(batch.column("text").to_pylist(), 1_000_000):
                p = classify(group, model) if model else np.full((len(group), len(HEADS)), 0.5)
                kept = [batch.column(c).slice(at, len(group)) for c in ("doc_id", "host", "path")]
                yield pa.RecordBatch.from_arrays([*kept, *(pa.array(np.ascontiguousarray(p[:, k])) for k in range(len(HEADS)))], names=["doc_id", "host", "path", *(f"p_{h}" for h in HEADS)])
                at += len(group)

    fields = ", ".join(f"p_{h} double" for h in HEADS)
    return docs.select("doc_id", "text", "host", "path").mapInArrow(common.released(work), f"doc_id long, host string, path string, {fields}")


def _strength(groups: DataFrame, prior: Column, head: str) -> float:
    """Prior documents' worth of a level, by the method of moments: how far group means stray beyond what their size explains."""
    rate = F.col(f"sum_{head}") / F.col("n")
    spread = F.greatest(prior * (1 - prior), F.lit(1e-6))
    got = groups.agg(F.sum(F.col("n") * F.pow(rate - prior, 2) / spread).alias("q"), F.count("*").alias("k"), F.sum("n").alias("n"), F.sum(F.pow(F.col("n").cast("double"), 2)).alias("n2")).first()
    if not got.k or got.k < 2 or got.n <= got.n2 / got.n:
        return 100.0
    excess = (got.q - (got.k - 1)) / (got.n - got.n2 / got.n)
    return float(min(1e6, max(1.0, 1 / excess - 1))) if excess > 0 else 1e6


def posteriors(found: DataFrame) -> DataFrame:
    """host, path, and for each head the global mean and the posterior of the path; found is evidence()."""
    sums = [F.sum(f"p_{h}").alias(f"sum_{h}") for h in HEADS]
    paths = common.settle(found.groupBy("host", "path").agg(F.count("*").alias("n"), *sums), "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), *[F.sum(f"sum_{h}").alias(f"sum_{h}") for h in HEADS])
    whole = paths.agg(F.sum("n").alias("n"), *[F.sum(f"sum_{h}").alias(f"sum_{h}") for h in HEADS]).first()
    for h in HEADS:
        mean = min(1 - 1e-6, max(1e-6, whole[f"sum_{h}"] / whole["n"])) if whole["n"] else 0.5
        k = _strength(hosts, F.lit(mean), h)
        hosts = hosts.withColumn(f"mean_{h}", F.lit(mean)).withColumn(f"host_{h}", (F.lit(k * mean) + F.col(f"sum_{h}")) / (F.lit(k) + F.col("n")))
    hosts = common.settle(hosts.drop("n", *[f"sum_{h}" for h in HEADS]), "hosts")
    both = paths.join(hosts, paths["host"].eqNullSafe(hosts["host"])).drop(hosts["host"])
    for h in HEADS:
        k = _strength(both, F.col(f"host_{h}"), h)
        both = both.withColumn(f"path_{h}", (F.lit(k) * F.col(f"host_{h}") + F.col(f"sum_{h}")) / (F.lit(k) + F.col("n")))
    return both.select("host", "path", *[f"{a}_{h}" for h in HEADS for a in ("mean", "host", "path")])


def _combined(head: str) -> Column:
    odds = lambda c: F.col(c) / (1 - F.col(c))
    safe = F.least(F.greatest(F.col(f"p_{head}"), F.lit(1e-9)), F.lit(1 - 1e-9))
    total = safe / (1 - safe) * odds(f"path_{head}") / odds(f"mean_{head}")
    return total / (1 + total)


def combined(found: DataFrame) -> DataFrame:
    """doc_id and for each head the evidence, host and path posteriors and all together; found is evidence(), settled."""
    joined = common.join_small(found, common.settle(posteriors(found), "posteriors"), ["host", "path"])
    return joined.select("doc_id", *[c for h in HEADS for c in (F.col(f"p_{h}"), F.col(f"host_{h}"), F.col(f"path_{h}"), _combined(h).alias(h))])


def assess(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """combined() and keep, of docs(doc_id, text, host, path)."""
    key = lambda c: F.coalesce(F.concat(F.lit("+"), F.col(c)), F.lit("")).alias(c)
    docs = docs.select(F.col("doc_id").cast("long"), "text", key("host"), key("path"))
    shown = combined(common.settle(evidence(docs, fit(docs, labels)), "evidence"))
    return shown.withColumn("keep", (F.col("quality") >= 0.5) & (F.col("toxic") < 0.5))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents assessed; the source is the host, and the source with the language the path."""
    docs = common.documents(spark, sf_dir, "doc_id", "text", "source", "lang").select("doc_id", "text", F.col("source").alias("host"), F.concat_ws("/", "source", "lang").alias("path"))
    return assess(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
