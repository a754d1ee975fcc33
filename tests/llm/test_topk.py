import math

import numpy as np

from loomgraph.llm import topk

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows):
    """Every row but the query's own is a candidate."""
    fine = []
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v):
            fine.append((i, [math.floor(256 * float(np.float32(x))) for x in v]))
    out = []
    for at, (q, a) in enumerate(fine):
        if q % 50 == 0:
            found = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for k, (i, b) in enumerate(fine) if k != at and len(b) == len(a))
            out += [(q, k + 1, i, -s) for k, (s, i) in enumerate(found[:5])]
    return sorted(out)


def test_query(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert sorted(map(tuple, topk.op8_topk(spark, sf).collect())) == brute(rows)


def test_blocks_copies_and_edges(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 8)) * 3
    rows = [(i, (centres[rng.integers(6)] + rng.normal(size=8) * 0.2).tolist()) for i in range(900)]
    rows += [(i, [1.0] * 8) for i in range(1000, 1600)]  # one very common vector
    rows += [(2000, None), (2050, [1.0, None] + [0.0] * 6), (2100, [float("nan")] * 8), (2150, [float("inf")] * 8), (-50, [0.5] * 8), (None, [1.0] * 8), (3000, [1.0, 2.0]), (3001, [2.0, 2.0]), (3050, [])]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(map(tuple, topk.top_k(df, block_rows=100, most_blocks=8).collect())) == brute(rows)
    assert topk.top_k(df.limit(0)).count() == 0
    assert sorted(map(tuple, topk.top_k(df.unionAll(df), block_rows=100).collect())) == brute(rows * 2)
    one = [(100, (rng.normal(size=8)).tolist()) for _ in range(300)] + [(k, (rng.normal(size=8)).tolist()) for k in range(100)]  # one vec_id on most rows
    assert sorted(map(tuple, topk.top_k(spark.createDataFrame(one, SCHEMA), block_rows=64, most_blocks=4).collect())) == brute(one)


def test_trees_cover_separate_and_nest():
    rng = np.random.default_rng(2)
    points = np.concatenate([rng.normal(size=(900, 6)) * 50, np.repeat(rng.normal(size=(1, 6)), 300, axis=0)])
    waiting, seen = [topk.Node(points, np.arange(len(points)), points.mean(axis=0))], 0
    while waiting:
        node = waiting.pop()
        away = np.sqrt(((points[node.members] - node.centre) ** 2).sum(axis=1))
        assert away.max() <= node.radius + 1e-9
        if not node.children:
            assert len(node.members) <= topk.LEAF or node.radius == 0
            continue
        seen += 1
        assert sorted(np.concatenate([c.members for c in node.children]).tolist()) == sorted(node.members.tolist())
        centres = np.array([c.centre for c in node.children])
        assert all(np.sqrt(((points[c.members] - c.centre) ** 2).sum(axis=1)).max() <= node.cover + 1e-9 for c in node.children)
        apart = np.sqrt(((centres[:, None] - centres[None]) ** 2).sum(axis=2))[~np.eye(len(centres), dtype=bool)]
        assert apart.min() >= node.cover - 1e-9
        assert (np.sqrt(((centres - node.centre) ** 2).sum(axis=1)).min() <= away.min() + 1e-9)
        waiting += node.children
    assert seen > 3
