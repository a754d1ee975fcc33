import random
import re
from collections import defaultdict

import numpy as np
import pytest

from loomgraph.llm import mixing


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    whole, full = 1.5 * sum(sizes.values()), set()
    while True:
        rest = whole - sum(2 * sizes[s] for s in full)
        free = sum(weight[s] for s in names if s not in full)
        target = {s: 2.0 * sizes[s] if s in full else rest * weight[s] / free for s in names}
        over = {s for s in names if target[s] > 2 * sizes[s] and s not in full}
        if not over:
            return target
        full |= over


def check(got, rows):
    sizes = defaultdict(int)
    for d, t, s in rows:
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    target, taken = brute_targets(sizes), defaultdict(int)
    source = {d: s for d, _, s in rows}
    assert len(got) == len(rows)
    for r in got:
        s = source[r.doc_id]
        assert 0 <= r.taken <= 2 * r.size and r.source_size == sizes[s] and r.target == pytest.approx(target[s])
        taken[s] += r.taken
    for s, t in target.items():
        assert abs(taken[s] - t) <= max(2 * mixing.BLOCK, 0.01 * t), (s, taken[s], t)


def test_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source").collect()]
    got = mixing.op5_mixing(spark, sf).collect()
    check(got, rows)
    assert sorted(got) == sorted(mixing.op5_mixing(spark, sf).collect())


def test_hot_source_nulls_and_ties(spark):
    rng = random.Random(5)
    rows = [(d, " ".join(["w"] * rng.randrange(60)) if d % 17 else None, rng.choice(["hot"] * 5 + ["é", "z", "a", None, "tiny"])) for d in range(800)]
    rows += [(9000, "w " * 50_000, "long"), (9001, "", "empty")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 as size", "'k' as key", "2 as shard")
    check(mixing.mix(df, shard_words=500).collect(), rows)
    assert mixing.mix(df.limit(0)).count() == 0
    again = mixing.repeat_documents(df)
    assert again.columns == df.columns and 0 < again.count() < 2 * len(rows)
    twice = spark.createDataFrame([(1, "a b", "s"), (1, "a b", "s"), (None, "c", None)], "doc_id long, text string, source string")
    assert mixing.mix(twice).count() == 3


def test_highest_quotients():
    rng = np.random.default_rng(2)
    for _ in range(50):
        sizes, seats = rng.integers(0, 1000, rng.integers(1, 12)), int(rng.integers(0, 200))
        want = np.zeros(len(sizes), dtype=int)
        for _ in range(seats if sizes.sum() else 0):
            want[np.argmax(sizes / (2 * want + 1))] += 1
        assert mixing.highest_quotients(sizes, seats, np.full(len(sizes), 10**9)).tolist() == want.tolist()


def test_blocks_of_sources_by_quotients(spark):
    rng = np.random.default_rng(7)
    for k in range(6):
        sizes = rng.integers(0, [9, 60, 5000][k % 3], 40)
        if k > 2:
            sizes[:] = sizes[0] + 1  # ties
        rows = [(f"+s{i:02}", f"s{i:02}", int(n)) for i, n in enumerate(sizes)] + [("", None, 10 * k)]
        table = mixing.targets(spark.createDataFrame(rows, "key string, source string, source_size long"))
        table = mixing.common.settle(table, "t")
        got = {r.source: r for r in mixing.source_blocks(table, 8).collect()}
        order = sorted((s for _, s, _ in rows if s), key=str) + [None]
        target = np.array([got[s].target for s in order])
        caps = np.array([-(-got[s].source_size // 8) * 2 for s in order])
        want = np.zeros(len(order), dtype=int)
        for _ in range(int(round(target.sum() / 8, 6) + 0.5)):
            want[np.argmax(np.where(want < caps, target / (2 * want + 1), -1))] += 1
        assert [got[s].blocks for s in order] == want.tolist()


def test_columns_of_any_name_are_kept(spark):
    df = spark.createDataFrame([(k, "a b c", "s", 1, 2, 3, 4) for k in range(30)], "doc_id long, text string, source string, _id int, _nth int, _times int, `a.b` int")
    got = mixing.repeat_documents(df)
    assert got.columns == df.columns and {tuple(r)[3:] for r in got.collect()} == {(1, 2, 3, 4)}


def test_repeated_documents_keep_small_sources(spark):
    small = [*(f"s{k}" for k in range(40)), None]
    rows = [(d, "w " * 500, "large") for d in range(100)] + [(1000 + 10 * k + i, "w " * 50, s) for k, s in enumerate(small) for i in range(10)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    target = brute_targets({"large": 50_000} | dict.fromkeys(small, 500))
    words = defaultdict(int)
    for r in mixing.repeat_documents(df).collect():
        words[r.source] += len(r.text.split())
    size = defaultdict(lambda: 50, large=500)
    # each of a source's documents is rounded to whole copies by a draw of its own
    assert all(abs(words[s] - t) <= 4 * 0.5 * size[s] * (100 if s == "large" else 10) ** 0.5 + 2 * mixing.BLOCK for s, t in target.items())


def copies_by_hand(spark, rows):
    """doc_ids, as often as the pipeline's stage gives them, for rows (dicts): what the mix takes, with a seeded draw about parts."""
    docs = spark.createDataFrame([(r["doc_id"], r["text"], r["source"]) for r in rows], "doc_id long, text string, source string")
    taken = mixing.mix(docs).collect()
    check(taken, [(r["doc_id"], r["text"], r["source"]) for r in rows])
    draws = {r.doc_id: r.draw / (1 << 30) for r in docs.selectExpr("doc_id", f"pmod(xxhash64(doc_id, {mixing.SEED + 1}), {1 << 30}) as draw").collect()}
    return sorted(r.doc_id for r in taken if r.size for _ in range(int(r.taken / r.size + draws[r.doc_id])))
