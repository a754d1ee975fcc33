import random
import re
from hashlib import sha256

from loomgraph.llm import substrings


def brute(rows):
    words = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows]
    first = {}
    for d, w in words:
        for i in range(len(w) - 12):
            g = tuple(w[i : i + 13])
            first[g] = min(first.get(g, d), d)
    out = []
    for d, w in words:
        gone = {k for i in range(len(w) - 12) if first[tuple(w[i : i + 13])] < d for k in range(i, i + 13)}
        out.append((d, len(w), len(gone), sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()))
    return sorted(out)


def test_query(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = brute(rows)
    assert sorted(map(tuple, substrings.op9_substrings(spark, sf).collect())) == want and sum(r[2] for r in want) > 100


def test_many_batches_and_buckets(spark):
    rng = random.Random(3)
    passages = [[f"p{k}_{i}" for i in range(rng.choice([12, 13, 14, 20, 60]))] for k in range(20)]
    rows = []
    for d in range(150):
        w = []
        for _ in range(rng.randrange(6)):
            w += rng.choice(passages)[rng.randrange(3) :] if rng.random() < 0.6 else [rng.choice("abc") for _ in range(rng.randrange(30))]
        rows.append((d * 3 - 50, " ".join(w)))
    rows.append((10_000, "z " * 70_000))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, substrings.remove_repeats(df, batch_bytes=3000, bucket_words=300).collect())) == brute(rows)


def test_edges(spark):
    text = " ".join(map(str, range(30)))
    rows = [(1, None), (2, ""), (5, text), (5, text), (4, text), (None, text), (None, text), (3, "a\x0bb\tc")]
    df = spark.createDataFrame([(*r, "x", 9) for r in rows], "doc_id long, text string, batch string, rank int")
    got = {(r.doc_id, r.n_words, r.n_removed) for r in substrings.remove_repeats(df).collect()}
    assert got == {(1, 0, 0), (2, 0, 0), (4, 30, 0), (5, 30, 30), (None, 30, 30), (3, 3, 0)}
    assert substrings.remove_repeats(df.limit(0)).count() == 0
