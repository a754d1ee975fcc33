"""Weak supervision: the label model on votes whose making is known, moments against counting, held-out accuracy."""

import itertools
import math
from zlib import crc32

import numpy as np

from loomgraph.llm import toxicity


def made(n, seed):
    """Truth and votes of voters of known rates; the last two copy the one before them three times in four."""
    rng = np.random.default_rng(seed)
    fires = np.array([[0.05, 0.6], [0.1, 0.5], [0.02, 0.4], [0.2, 0.2], [0.05, 0.7], [0.05, 0.5], [0.05, 0.5], [0.05, 0.5]])
    truth = (rng.random(n) < 0.2).astype(int)
    fired = rng.random((n, 8)) < fires[:, truth].T
    for j in (6, 7):
        fired[:, j] = np.where(rng.random(n) < 0.75, fired[:, j - 1], fired[:, j])
    return truth, fired


def model_of(truth, fired, labelled):
    f = fired.astype(float)
    bad, good = f[:labelled][truth[:labelled] == 1], f[:labelled][truth[:labelled] == 0]
    return toxicity.LabelModel(len(f), f.T @ f, 0.2, bad.mean(axis=0) - good.mean(axis=0), labelled)


def test_label_model_finds_accuracies_and_correlations():
    truth, fired = made(60_000, 1)
    model = model_of(truth, fired, 200)
    right = np.array([fired[truth == 1, j].mean() - fired[truth == 0, j].mean() for j in range(8)])
    rough = np.array([fired[:200][truth[:200] == 1, j].mean() - fired[:200][truth[:200] == 0, j].mean() for j in range(8)])
    # 60,000 documents without labels tell more than 200 labels alone
    assert np.abs(model.delta - right).max() < 0.08 and np.abs(model.delta - right).mean() < np.abs(rough - right).mean()
    assert {(6, 5), (7, 6)} <= set(model.forest) and all(min(p) >= 5 for p in model.forest)


def test_posterior_of_independent_voters_is_bayes_rule():
    truth, fired = made(50_000, 2)
    model = model_of(truth, fired[:, :5], 50_000)
    assert not model.forest
    for votes in itertools.product([False, True], repeat=5):
        joint = [0.2 if y else 0.8 for y in (0, 1)]
        for y in (0, 1):
            for j, v in enumerate(votes):
                joint[y] *= model.fires[y][j] if v else 1 - model.fires[y][j]
        assert math.isclose(model.log_odds(np.array([votes]))[0], math.log(joint[1] / joint[0]), abs_tol=1e-9)


def test_correlations_make_posteriors_honest():
    truth, fired = made(80_000, 3)
    model = model_of(truth, fired, 80_000)
    loss = lambda odds: np.mean(np.logaddexp(0, np.where(truth == 1, -odds, odds)))
    naive = model.prior + np.where(fired, np.log(model.fires[1] / model.fires[0]), np.log((1 - model.fires[1]) / (1 - model.fires[0]))).sum(axis=1)
    assert loss(model.log_odds(fired)) < loss(naive)


def test_moments_against_counting(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    units = [("=idiot", True), ("=the", True), ("^ther", True), ("=of", False)]
    n, pairs = toxicity.moments(docs, units)
    voter = toxicity.voters_of([u for u, _ in units])
    want, rows = np.zeros((toxicity.VOTERS, toxicity.VOTERS)), [r for r in docs.collect() if crc32(str(r.doc_id).encode()) % 5]
    for r in rows:
        words = [w.strip(toxicity.AROUND) for w in (r.text or "").lower().split()]
        fired = np.zeros(toxicity.VOTERS)
        hits = {v: 0 for v in range(toxicity.LEXICONS + toxicity.PATTERNS)}
        for k, (u, up) in enumerate(units):
            hits[voter[k]] += up * sum(w == u[1:] if u[0] == "=" else w.startswith(u[1:]) and len(w) > 4 for w in words)
        for v, h in hits.items():
            fired[v] = h > 0 if v < toxicity.LEXICONS else 200 * h >= len(words) + 50
        fired[toxicity.LEXICONS + toxicity.PATTERNS :] = toxicity.styled(r.text or "")
        want += np.outer(fired, fired)
    assert n == len(rows) and (pairs == want).all()


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in toxicity.op11_toxicity(spark, sf).collect()}
    held = [r for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if got[r.doc_id].held_out]
    share = np.mean([got[r.doc_id].predicted == r.toxic for r in held])
    caught = np.mean([got[r.doc_id].predicted for r in held if r.toxic])
    print("held-out accuracy and recall", share, caught)
    assert share > 0.98 and caught > 0.9
    assert all(r.held_out == (crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in got.values())


def test_edges(spark):
    texts = [None, "", " \n", "you scum " * 30_000, "you scum", "you scum", "hello there"]
    docs = spark.createDataFrame([(k if k else None, t, 0.5, 1) for k, t in enumerate(texts)], "doc_id long, text string, score double, toxic int")
    none = spark.createDataFrame([(None, 1), (1, None), (2, 7)], "doc_id long, toxic int")
    assert toxicity.fit(docs, none) is None and all(r.score == 0 for r in toxicity.scores(docs, None).collect())
    for labels in ([(1, 0)], [(k, 1) for k in range(9)], [(k, k % 2) for k in range(9)] * 2):
        got = toxicity.scores(docs, toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))).collect()
        assert len(got) == len(texts) and all(0 <= r.score <= 1 for r in got)
        assert len({r.score for r in got if r.doc_id in (4, 5)}) == 1 and len({r.score for r in got if r.doc_id in (None, 1, 2)}) == 1
    assert toxicity.scores(docs.limit(0), None).collect() == []
    assert toxicity.fit(docs.limit(0), none) is None
    many = spark.createDataFrame([(k, "scum of the earth" if k % 3 == 0 else "salt of the earth") for k in range(200)] + [(0, "x")] * 5, "doc_id long, text string")
    model = toxicity.fit(many, spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(200)], "doc_id long, toxic int"))
    by = {r.doc_id: r.score for r in toxicity.scores(many, model).collect()}
    assert all((s > 0.5) == (k % 3 == 0) for k, s in by.items() if k)
