from collections import defaultdict
from zlib import crc32

import numpy as np
from pyspark.sql import functions as F

from loomgraph.llm import quality


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", F.col("source").alias("host"), F.col("lang").alias("path"))
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    test = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    got = {r.doc_id: r for r in quality.assess(docs, labels.where(~test)).collect()}
    held = [r for r in labels.collect() if crc32(str(r.doc_id).encode()) % 5 == 0]
    share = lambda column, label: sum((got[r.doc_id][column] >= 0.5) == (r[label] == 1) for r in held) / len(held)
    shares = {c: share(c, c.removeprefix("p_")) for c in ("quality", "p_quality", "toxic", "p_toxic")}
    print("held-out accuracy with posteriors and without (p_)", shares)
    assert shares["quality"] > 0.95 and shares["toxic"] > 0.95, shares
    # posteriors do no harm where the classifier alone is nearly always right
    assert shares["quality"] >= shares["p_quality"] - 0.005 and shares["toxic"] >= shares["p_toxic"] - 0.005, shares


def test_posteriors_help_weak_evidence(spark):
    """Where a document says little of itself, its host's and path's posteriors settle it."""
    rng = np.random.default_rng(8)
    rows, truth = [], {}
    for k in range(3000):
        host = int(rng.integers(12))
        good = rng.random() < (0.9 if host % 2 else 0.1)
        truth[k] = good
        rows.append((k, f"h{host}", f"h{host}/{k % 3}", float(np.clip(rng.normal(0.6 if good else 0.4, 0.2), 0.02, 0.98)), 0.1))
    found = quality.common.settle(spark.createDataFrame(rows, "doc_id long, host string, path string, p_quality double, p_toxic double"), "t")
    got = {r.doc_id: r for r in quality.combined(found).collect()}
    share = lambda c: np.mean([(got[k][c] >= 0.5) == t for k, t in truth.items()])
    assert share("quality") > share("p_quality") + 0.05


def brute_combined(rows):
    """doc_id to the combined quality, in plain Python; rows (doc_id, host, path, p_quality)."""

    def strength(groups):  # (n, mean, prior)
        n, n2 = sum(g[0] for g in groups), sum(g[0] ** 2 for g in groups)
        if len(groups) < 2 or n <= n2 / n:
            return 100.0
        q = sum(g[0] * (g[1] - g[2]) ** 2 / max(g[2] * (1 - g[2]), 1e-6) for g in groups)
        excess = (q - (len(groups) - 1)) / (n - n2 / n)
        return min(1e6, max(1.0, 1 / excess - 1)) if excess > 0 else 1e6

    mean = sum(r[3] for r in rows) / len(rows)
    by_host, by_path = defaultdict(list), defaultdict(list)
    for _, host, path, p in rows:
        by_host[host].append(p)
        by_path[host, path].append(p)
    k = strength([(len(v), sum(v) / len(v), mean) for v in by_host.values()])
    hosts = {h: (k * mean + sum(v)) / (k + len(v)) for h, v in by_host.items()}
    k = strength([(len(v), sum(v) / len(v), hosts[h]) for (h, _), v in by_path.items()])
    paths = {x: (k * hosts[x[0]] + sum(v)) / (k + len(v)) for x, v in by_path.items()}
    odds = lambda p: p / (1 - p)
    total = {d: odds(min(max(p, 1e-9), 1 - 1e-9)) * odds(paths[h, x]) / odds(mean) for d, h, x, p in rows}
    return hosts, paths, {d: t / (1 + t) for d, t in total.items()}


def test_posteriors_against_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = [(k, f"h{int(rng.integers(9)) ** 2 // 9}", f"p{int(rng.integers(4))}", float(rng.beta(2, 1 + k % 3))) for k in range(400)] + [(900, "", "", 1.0), (901, "lone", "x", 0.0)]
    found = quality.common.settle(spark.createDataFrame([(*r, 0.3) for r in rows], "doc_id long, host string, path string, p_quality double, p_toxic double"), "t")
    hosts, paths, want = brute_combined(rows)
    for r in quality.posteriors(found).collect():
        assert abs(r.host_quality - hosts[r.host]) < 1e-9 and abs(r.path_quality - paths[r.host, r.path]) < 1e-9
    for r in quality.combined(found).collect():
        assert abs(r.quality - want[r.doc_id]) < 1e-9


def test_long_and_repeated_rows_are_learnt_from(spark):
    texts = {0: "good words here " * 30_000, 1: "bad awful stuff " * 30_000}
    docs = spark.createDataFrame([(k, texts[k % 2]) for k in range(40)] + [(1, f"bad awful {i}") for i in range(500)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1 - k % 2, 0) for k in range(40)] * 2, "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels, sample=1000)
    assert (quality.classify(["good words here", "bad awful stuff"], model)[:, 0] > 0.5).tolist() == [True, False]


def test_sparse_hosts_shrink_to_the_mean(spark):
    rows = [(i, "big", "p", 0.9, 0.1) for i in range(300)] + [(i, "low", "p", 0.2, 0.1) for i in range(300)] + [(999, "one", "p", 0.2, 0.1), (998, "few", "q", 0.2, 0.1)]
    found = spark.createDataFrame(rows, "doc_id long, host string, path string, p_quality double, p_toxic double")
    got = {r.host: r for r in quality.posteriors(found).collect()}
    assert 0.85 < got["big"].host_quality <= 0.9 and 0.2 <= got["low"].host_quality < 0.25
    assert got["low"].host_quality < got["one"].host_quality < got["one"].mean_quality


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, None, None), (2, "", "h", "p"), (2, "", "h", "p"), (None, "a b", "h", None), (3, "w " * 60000, "h", "p")], "doc_id long, text string, host string, path string")
    labels = spark.createDataFrame([(1, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = quality.assess(docs.selectExpr("*", "1 as n", "2 as quality"), labels).collect()
    assert len(got) == 5 and all(r.p_quality == 0.5 for r in got)
    assert quality.assess(docs.limit(0), labels).count() == 0
    some = spark.createDataFrame([(2, 0, 1), (3, 1, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
    assert len(quality.assess(docs, some).collect()) == 5
