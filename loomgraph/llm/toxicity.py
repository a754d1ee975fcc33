"""Toxicity by weak supervision: voters, a generative model of their votes, and a linear classifier learnt from its posteriors.

Units are words and beginnings of words. Those that stray upward in a bounded sample of labelled documents (LABELLED of them, drawn
by hash) are dealt into lexicons (words) and patterns (beginnings), each of which is a voter; marks of style vote too. Votes of all
documents that may be learnt from are multiplied into one matrix of moments. In the generative model each voter fires with a
probability of its own in toxic and in clean documents; the difference, its accuracy, is fitted to the covariances with all voters
that it does not depend on, the label being one voter more, and what covariances are left beyond that are the correlations: the
strongest of them, as a forest, correct the posterior. A logistic classifier on the units of the labelled sample and of UNLABELLED
drawn documents learns the posteriors, and it alone gives scores: they depend on the text and on nothing else.

A null text counts as empty. Rows whose doc_id is null or held out are not learnt from; a doc_id is learnt from once with each
label that it has. Labels other than 0 and 1 are passed over; without any left every score is 0. Repeated rows get equal scores, an
empty table gives an empty result, extra columns change nothing, texts of any length are scored whole.
"""

from __future__ import annotations

import math
import operator
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .bpe import grouped
from .langid import held_out

#: Documents that are learnt from, about: labelled ones and others.
LABELLED, UNLABELLED, SEED = 20_000, 10_000, 11
#: Lengths of beginnings; documents that a unit is in at least; standard errors that it strays by; units at most.
LENGTHS, LEAST_DOCS, STRAY, MOST_UNITS = (4, 5, 6, 7), 4, 4.0, 20_000
LEXICONS, PATTERNS = 12, 12
#: Style voters: many words in upper case, words beside themselves, marks that are not of sentences, runs of ! and ?.
STYLES = 4
VOTERS = LEXICONS + PATTERNS + STYLES
#: Correlation from which a pair of voters counts as dependent, rounds of the fit, least probability, how sure a label is,
#: and how many labels tell as much of a voter as all other voters.
CORRELATED, ROUNDS, LEAST_P, SURE, DOUBT = 0.1, 20, 1e-4, 0.99, 1000
EPOCHS, RATE, RIDGE = 12, 0.1, 1e-5
AROUND = ".,!?;:|$%&*#\"'()"
#: Words whose units a task remembers.
KEPT = 500_000


def units_of(word: str) -> list[str]:
    """A word, and its beginnings, in lower case and without marks around it."""
    bare = word.strip(AROUND)
    return [f"={bare}", *(f"^{bare[:k]}" for k in LENGTHS if len(bare) > k)] if bare else []


class Table(dict):
    """A number for each set of units that words have; 0 is the set without any."""

    def __init__(self, units: dict[str, int]):
        super().__init__()
        self.units, self.sets, self.numbers = units, [()], {(): 0}

    def __missing__(self, word: str) -> int:
        if len(self) > KEPT:
            self.clear()
        has = tuple(u for x in units_of(word) if (u := self.units.get(x)) is not None)
        if has not in self.numbers:
            self.numbers[has] = len(self.sets)
            self.sets.append(has)
        self[word] = n = self.numbers[has]
        return n


def styled(text: str) -> tuple[bool, ...]:
    """The style votes of a text."""
    words = text.split()
    n = len(words) + 5
    return 3 * sum(map(str.isupper, words)) > n, 10 * sum(map(operator.eq, words, words[1:])) > n, 2 * sum(map(text.count, "#$%&*+<=>@^|~")) > n, 20 * (text.count("!!") + text.count("??")) > n


def counted(texts: list[str | None], table: Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the units in texts: the text, the unit and how often; each text's number of words."""
    sizes, flat = [], []
    for text in texts:
        words = (text or "").lower().split()
        sizes.append(len(words))
        flat += map(table.__getitem__, words)
    sizes = np.array(sizes, dtype=np.int64)
    found = np.array(flat, dtype=np.int64)
    owner = np.repeat(np.arange(len(texts)), sizes)[found > 0]
    found = found[found > 0]
    width = np.array([len(s) for s in table.sets])
    starts = np.concatenate([[0], np.cumsum(width)])
    members = np.array([u for s in table.sets for u in s], dtype=np.int64)
    each = width[found]
    # the units of each word, end to end
    at = np.repeat(starts[found], each) + np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
    keys, times = np.unique(np.repeat(owner, each) * max(len(table.units), 1) + members[at], return_counts=True)
    return keys // max(len(table.units), 1), keys % max(len(table.units), 1), times, sizes


def values(times: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Units in a hundred words, less in short texts."""
    return 100 * times / (sizes + 50)


def voters_of(units: list[str]) -> np.ndarray:
    """The lexicon or pattern that a unit is dealt to."""
    lot = [xxhash.xxh32_intdigest(u.encode(), SEED) for u in units]
    return np.array([h % LEXICONS if u[0] == "=" else LEXICONS + h % PATTERNS for h, u in zip(lot, units, strict=True)], dtype=np.int64)


def votes(texts: list[str | None], found: tuple, voter: np.ndarray, upward: np.ndarray) -> np.ndarray:
    """Which voters fire (texts x voters): a lexicon at any word, a pattern at one beginning in 200 words; found: counted()."""
    docs, units, times, sizes = found
    n = len(sizes)
    mine = upward[units]
    hits = np.bincount(docs[mine] * VOTERS + voter[units[mine]], weights=times[mine], minlength=n * VOTERS).reshape(n, VOTERS)
    fired = np.zeros((n, VOTERS), dtype=bool)
    fired[:, :LEXICONS] = hits[:, :LEXICONS] > 0
    fired[:, LEXICONS : LEXICONS + PATTERNS] = 200 * hits[:, LEXICONS : LEXICONS + PATTERNS] >= sizes[:, None] + 50
    fired[:, LEXICONS + PATTERNS :] = [styled(t or "") for t in texts]
    return fired


class LabelModel:
    """How often voters fire in toxic and clean documents, and how pairs of them depend on each other."""

    def __init__(self, n: float, pairs: np.ndarray, share: float, gold: np.ndarray, labelled: int):
        """n documents with `pairs` of votes; the share of toxic labels; gold: each voter's difference of rates between so many labels."""
        rate = np.diag(pairs) / n
        covariance = pairs / n - np.outer(rate, rate)
        c = share * (1 - share)
        spread = np.sqrt(np.maximum(rate * (1 - rate), LEAST_P))
        off = ~np.eye(len(rate), dtype=bool)
        delta = gold.copy()
        for _ in range(ROUNDS):
            rest = covariance - c * np.outer(delta, delta)
            free = off & (np.abs(rest) / np.outer(spread, spread) < CORRELATED)
            other = np.where(free, c * delta[None, :], 0)
            # the label is a voter whose difference is 1, the more to be believed the more of it there is
            known = c * c * labelled / (labelled + DOUBT)
            delta = ((covariance * other).sum(axis=1) + known * gold) / ((other**2).sum(axis=1) + known)
        kept = lambda p: np.clip(p, LEAST_P, 1 - LEAST_P)
        self.share, self.delta = share, delta
        self.fires = np.array([kept(rate - share * delta), kept(rate + (1 - share) * delta)])
        self.rest = covariance - c * np.outer(delta, delta)
        strength = np.abs(self.rest) / np.outer(spread, spread)
        self.forest = spanning(np.where(off & (strength >= CORRELATED), strength, 0))
        self.prior = math.log(share / (1 - share))

    def log_odds(self, fired: np.ndarray) -> np.ndarray:
        """Posterior log odds of toxicity of votes (documents x voters)."""
        p0, p1 = self.fires
        total = self.prior + np.where(fired, np.log(p1 / p0), np.log((1 - p1) / (1 - p0))).sum(axis=1)
        for i, j in self.forest:
            # a pair correlates as much in toxic documents as in clean ones
            spreads = [math.sqrt(p[i] * (1 - p[i]) * p[j] * (1 - p[j])) for p in (p0, p1)]
            alike = self.rest[i, j] / ((1 - self.share) * spreads[0] + self.share * spreads[1])
            shift = np.zeros((2, 2))
            for sign, p, spread in ((1, p1, spreads[1]), (-1, p0, spreads[0])):
                both = np.clip(p[i] * p[j] + min(max(alike, -1.0), 1.0) * spread, max(0, p[i] + p[j] - 1) + LEAST_P**2, min(p[i], p[j]) - LEAST_P**2)
                joint = np.maximum(np.array([[1 - p[i] - p[j] + both, p[j] - both], [p[i] - both, both]]), LEAST_P**2)
                shift += sign * np.log(joint / np.outer([1 - p[i], p[i]], [1 - p[j], p[j]]))
            total += shift[fired[:, i].astype(int), fired[:, j].astype(int)]
        return total


def spanning(strength: np.ndarray) -> list[tuple[int, int]]:
    """The strongest pairs that form no circle."""
    group = list(range(len(strength)))
    found = []
    order = sorted(((strength[i, j], i, j) for i in range(len(strength)) for j in range(i) if strength[i, j] > 0), key=lambda x: (-x[0], x[1], x[2]))
    for _, i, j in order:
        if group[i] != group[j]:
            found.append((i, j))
            old = group[j]
            group = [group[i] if g == old else g for g in group]
    return found


def learn(rows: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, n_units: int) -> tuple[np.ndarray, float]:
    """Weights and bias of the logistic classifier, by adaptive steps over single documents; targets are probabilities."""
    w, gw, bias, gb = np.zeros(n_units), np.full(n_units, 1e-2), 0.0, 1e-2
    rng = np.random.default_rng(SEED)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            f, x = rows[i]
            g = 1 / (1 + math.exp(-max(-30.0, min(30.0, float(w[f] @ x) + bias)))) - target[i]
            step = g * x
            gw[f] += step * step
            w[f] -= RATE * (step + RIDGE * w[f]) / np.sqrt(gw[f])
            gb += g * g
            bias -= RATE * g / math.sqrt(gb)
    return w, bias


def sampled(docs: DataFrame, labels: DataFrame, labelled: int, unlabelled: int) -> DataFrame:
    """toxic (null: not labelled), text: the documents that are learnt from, settled; none is held out."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).select(F.col("doc_id").cast("long"), F.col("toxic").cast("int")).distinct()
    share = lambda wanted, n: min(1.0, wanted / max(n, 1))
    lot = lambda *on: F.pmod(F.xxhash64(*on, F.lit(SEED)), F.lit(1 << 40)) / (1 << 40)
    # about `labelled` rows of two numbers are broadcast, whatever the size of labels
    chosen = F.broadcast(known.where(lot("doc_id") < share(labelled, known.count())))
    usable = docs.where(F.col("doc_id").isNotNull() & ~held_out()).withColumn("mark", F.xxhash64("text"))
    rows = usable.join(chosen, "doc_id", "left").where(F.col("toxic").isNotNull() | (lot("mark") < share(unlabelled, docs.count())))
    # copies are learnt from once
    found = rows.groupBy("toxic", F.when(F.col("toxic").isNotNull(), F.col("doc_id")).otherwise(F.col("mark")).alias("which")).agg(F.min("text").alias("text"))
    return common.settle(found, "learnt")


def straying(sample: DataFrame) -> list[tuple[str, bool]]:
    """The units that stray from the share of toxic labels, and whether upward; the furthest MOST_UNITS of them."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, bad = Counter(), Counter()
            for toxic, text in zip(batch.column("toxic").to_pylist(), batch.column("text").to_pylist(), strict=True):
                has = {u for w in set((text or "").lower().split()) for u in units_of(w)}
                n.update(has)
                if toxic:
                    bad.update(has)
            yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64()), pa.array([bad[u] for u in n], pa.int64())], names=["unit", "n", "bad"])

    labelled = sample.where("toxic is not null")
    got = labelled.agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("bad")).first()
    if not got.n:
        return []
    p = (got.bad + 0.5) / (got.n + 1)
    sums = labelled.select("toxic", "text").mapInArrow(common.released(work), "unit string, n long, bad long").groupBy("unit").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).where(F.col("n") >= LEAST_DOCS)
    off = (F.col("bad") - F.col("n") * p) / F.sqrt(F.col("n") * p * (1 - p))
    rows = sums.withColumn("off", off).where(F.abs("off") > STRAY).orderBy(F.desc(F.abs("off")), "unit").limit(MOST_UNITS).collect()
    return [(r.unit, r.off > 0) for r in rows]


def moments(docs: DataFrame, units: list[tuple[str, bool]]) -> tuple[int, np.ndarray]:
    """How many documents may be learnt from, and in how many of them each pair of voters fires."""
    names = {u: k for k, (u, _) in enumerate(units)}
    voter, upward = voters_of(list(names)), np.array([up for _, up in units], dtype=bool)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, n, total = Table(names), 0, np.zeros((VOTERS, VOTERS), dtype=np.int64)
        for batch in batches:
            for group in grouped(batch.column("text").to_pylist(), 1_000_000):
                fired = votes(group, counted(group, table), voter, upward).astype(np.float32)
                n += len(group)
                total += (fired.T @ fired).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, VOTERS * VOTERS), pa.int32()), pa.array([n, *total.ravel().tolist()], pa.int64())], names=["at", "n"])

    rows = docs.where(F.col("doc_id").isNotNull() & ~held_out()).select("text").mapInArrow(common.released(work), "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()
    found = np.zeros(VOTERS * VOTERS + 1)
    for r in rows:  # a number for each pair of voters
        found[r["at"] + 1] = r["n"]
    return int(found[0]), found[1:].reshape(VOTERS, VOTERS)


def fit(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, unlabelled: int = UNLABELLED) -> tuple | None:
    """Units, weights, bias and label model, from docs(doc_id, text) and labels(doc_id, toxic); None without labels."""
    sample = sampled(docs.select(F.col("doc_id").cast("long"), "text"), labels, labelled, unlabelled)
    if not sample.where("toxic is not null").limit(1).count():
        return None
    units = straying(sample)
    names = {u: k for k, (u, _) in enumerate(units)}
    n, pairs = moments(docs, units)
    voter, upward = voters_of(list(names)), np.array([up for _, up in units], dtype=bool)

    def featured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = Table(names)
        for pdf in batches:
            for a in range(0, len(pdf), 500):
                part = pdf.iloc[a : a + 500]
                texts = part["text"].tolist()
                docs_at, unit, times, sizes = found = counted(texts, table)
                fired = votes(texts, found, voter, upward)
                ends = np.searchsorted(docs_at, np.arange(len(part) + 1))
                x = values(times, sizes[docs_at])
                yield pd.DataFrame({"toxic": part["toxic"].astype("float64").to_numpy(), "which": part["which"].to_numpy(), "fired": [f.tobytes() for f in fired], "units": [unit[i:j].astype(np.int32).tobytes() for i, j in zip(ends, ends[1:], strict=False)], "x": [x[i:j].tobytes() for i, j in zip(ends, ends[1:], strict=False)]})

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(["which", "toxic"], ignore_index=True)
        fired = np.array([np.frombuffer(f, dtype=bool) for f in rows["fired"]])
        toxic = rows["toxic"].to_numpy()
        bad, good = fired[toxic == 1], fired[toxic == 0]
        gold = (bad.sum(axis=0) + 0.5) / (len(bad) + 1) - (good.sum(axis=0) + 0.5) / (len(good) + 1)
        share = min(max((len(bad) + 0.5) / (len(bad) + len(good) + 1), 1e-3), 1 - 1e-3)
        model = LabelModel(max(n, 1), pairs, share, gold, len(bad) + len(good))
        odds = model.log_odds(fired) + math.log(SURE / (1 - SURE)) * np.where(toxic == 1, 1, np.where(toxic == 0, -1, 0))
        target = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        w, bias = learn([(np.frombuffer(u, dtype=np.int32), np.frombuffer(x)) for u, x in zip(rows["units"], rows["x"], strict=True)], target, len(names))
        yield pd.DataFrame({"w": [w.tobytes()], "bias": [bias], "delta": [model.delta.tobytes()], "forest": [str(model.forest)]})

    # a bounded number of documents, as the few units of theirs that stray
    got = sample.mapInPandas(common.released(featured), "toxic double, which long, fired binary, units binary, x binary").repartition(1).mapInPandas(common.released(work), "w binary, bias double, delta binary, forest string").first()
    return names, np.frombuffer(got.w), got.bias, np.frombuffer(got.delta), got.forest


def scores(docs: DataFrame, model: tuple | None) -> DataFrame:
    """doc_id, score of docs(doc_id, text)."""
    names, w, bias = model[:3] if model else ({}, np.zeros(0), -math.inf)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table(names)
        for batch in batches:
            at = 0
            for group in grouped(batch.column("text").to_pylist(), 1_000_000):
                docs_at, unit, times, sizes = counted(group, table)
                total = bias + np.bincount(docs_at, weights=w[unit] * values(times, sizes[docs_at]), minlength=len(group))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, len(group)), pa.array(1 / (1 + np.exp(-np.clip(total, -700, 700))) if model else np.zeros(len(group)))], names=["doc_id", "score"])
                at += len(group)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(common.released(work), "doc_id long, score double")


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored by what those that are not held out teach."""
    docs = common.documents(spark, sf_dir, "doc_id", "text")
    found = scores(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
