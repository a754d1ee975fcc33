"""Exact top-k inner products by dual-tree search over cover trees.

Vectors are dealt to pivots (a bounded sample of them), and each pivot's to blocks of about BLOCK_ROWS rows by a hash of the row,
so a block's size does not grow with the data. Each block's data and the queries sent to it get a cover tree each. A node has a
centre, the radius that holds its points, and children around centres chosen farthest first, the node's own among them (nesting):
all points lie within the level's radius of their child's centre (covering), and the centres at least as far apart (separation).
Levels' radii are what at most FAN centres reach instead of powers of a base. Pairs of nodes are descended best bound first and
pruned where cq.cd + |cq| rd + |cd| rq + rq rd is below the worst kth score of the node's queries. A query first searches its own
block; the kth score found there prunes whole pivots by centre and radius, and the query goes to the blocks of those that are
left. There are at most MOST_BLOCKS pivots, so what the driver holds is bounded.

Scores are integers held in doubles, exact below 2^53. Vectors that are null or hold a null or non-finite component take no part, nor do
rows without a vec_id. Every row is a candidate for every query but itself, rows of one vec_id among them, and a query for each
row whose vec_id is asked for. Vectors are compared with those of their own length.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

K, EVERY, SCALE = 5, 50, 256
BLOCK_ROWS, MOST_BLOCKS, LEAF, FAN = 4096, 1024, 128, 16
RESULT = "query long, query_id long, vec_id long, score double"


class Node:
    __slots__ = ("centre", "children", "cover", "members", "norm", "radius")

    def __init__(self, points: np.ndarray, members: np.ndarray, centre: np.ndarray):
        self.centre, self.members, self.children = centre, members, []
        self.norm = float(np.sqrt(centre @ centre))
        away = np.sqrt(((points[members] - centre) ** 2).sum(axis=1))
        self.radius = self.cover = float(away.max())
        if len(members) <= LEAF or self.radius == 0:
            return
        # farthest first, until half the radius covers what is left or the fan is full
        chosen, nearest, owner = [int(away.argmin())], None, None
        while len(chosen) < FAN:
            d = np.sqrt(((points[members] - points[members[chosen[-1]]]) ** 2).sum(axis=1))
            if nearest is None:
                nearest, owner = d, np.zeros(len(members), dtype=np.int64)
            else:
                closer = d < nearest
                nearest[closer], owner[closer] = d[closer], len(chosen) - 1
            if nearest.max() <= self.radius / 2 and len(chosen) > 1:
                break
            chosen.append(int(nearest.argmax()))
        self.cover = float(nearest.max())
        for c in np.unique(owner).tolist():
            self.children.append(Node(points, members[owner == c], points[members[chosen[c]]]))


def search(queries: np.ndarray, query_ids: np.ndarray, floor: np.ndarray, data: np.ndarray, ids: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """Scores and ids (queries x k) of the best data for each query, -inf and -1 where there are fewer or they fall below floor."""
    score, best = np.full((len(queries), k), -np.inf), np.full((len(queries), k), -1, dtype=np.int64)
    if not len(queries) or not len(data):
        return score, best
    worst = floor.astype(np.float64).copy()
    everyone = np.arange(len(data))
    # of equal vectors only the k + 1 smallest ids can be among the best k of a query
    order = np.lexsort((ids, *data.T[::-1]))
    same = np.concatenate([[False], (data[order][1:] == data[order][:-1]).all(axis=1)])
    nth = everyone - np.maximum.accumulate(np.where(same, 0, everyone))
    everyone = np.sort(order[nth <= k])
    roots = Node(queries, np.arange(len(queries)), queries.mean(axis=0)), Node(data, everyone, data[everyone].mean(axis=0))

    def bound(q: Node, d: Node) -> float:
        b = float(q.centre @ d.centre) + q.norm * d.radius + d.norm * q.radius + q.radius * d.radius
        return b + abs(b) * 1e-9 + 1e-3

    stack = [roots]
    while stack:
        q, d = stack.pop()
        if bound(q, d) < worst[q.members].min():
            continue
        if not q.children and not d.children:
            m = q.members
            found = queries[m] @ data[d.members].T
            who = np.broadcast_to(ids[d.members], found.shape)
            found = np.where((who == query_ids[m][:, None]) | (found < floor[m][:, None]), -np.inf, found)
            good = found >= worst[m][:, None]  # equal scores may have smaller ids
            rows = np.flatnonzero(good.any(axis=1))
            if not len(rows):
                continue
            columns, m = np.flatnonzero(good[rows].any(axis=0)), m[rows]
            found, who = found[np.ix_(rows, columns)], who[np.ix_(rows, columns)]
            s, i = np.concatenate([score[m], found], axis=1), np.concatenate([best[m], who], axis=1)
            pick = np.lexsort((i, -s), axis=1)[:, :k]
            score[m], best[m] = np.take_along_axis(s, pick, axis=1), np.take_along_axis(i, pick, axis=1)
            worst[m] = np.maximum(floor[m], score[m, -1])
        elif d.children and (not q.children or d.radius >= q.radius):
            stack += sorted(((q, c) for c in d.children), key=lambda p: bound(*p))
        else:
            stack += [(c, d) for c in q.children]
    best[np.isneginf(score)] = -1
    return score, best


def _block_search(queries: pd.DataFrame, data: pd.DataFrame) -> pd.DataFrame:
    if not len(queries) or not len(data):
        return pd.DataFrame({c: pd.Series(dtype="int64") for c in ("query", "query_id", "vec_id")} | {"score": pd.Series(dtype="float64")})
    # rows are told apart by their place in the order of ties
    data = data.sort_values(["vec_id", "row"])
    place = {x: k for k, x in enumerate(data["row"].tolist())}
    q, d = np.stack(queries["v"].to_numpy()), np.stack(data["v"].to_numpy())
    own = np.array([place.get(x, -2) for x in queries["query"].tolist()], dtype=np.int64)
    score, best = search(q, own, queries["floor"].to_numpy(), d, np.arange(len(data)))
    good = ~np.isneginf(score)
    each = lambda c: np.repeat(queries[c].to_numpy(), K).reshape(-1, K)[good]
    return pd.DataFrame({"query": each("query"), "query_id": each("query_id"), "vec_id": data["vec_id"].to_numpy()[best[good]], "score": score[good]})


def top_k(vectors: DataFrame, every: int = EVERY, scale: int = SCALE, block_rows: int = BLOCK_ROWS, most_blocks: int = MOST_BLOCKS) -> DataFrame:
    """query_id, rank, vec_id, score of vectors(vec_id, embedding): queries are the rows whose vec_id is divisible by `every`."""
    spark = vectors.sparkSession
    fine = F.col("vec_id").isNotNull() & F.coalesce(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False)) & (F.size("embedding") > 0)
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("double"))
    clean = common.settle(vectors.where(fine).select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long"), whole.alias("v")), "vectors")
    n = clean.count()
    pivots = clean.orderBy(F.xxhash64("vec_id", "row"), "row").limit(max(1, min(most_blocks, n // block_rows))).collect()
    by_length = {k: np.array([r.v for r in pivots if len(r.v) == k]) for k in {len(r.v) for r in pivots}}
    at_length = {k: [i for i, r in enumerate(pivots) if len(r.v) == k] for k in by_length}

    def deal(parts):
        for pdf in parts:
            pivot, away = np.zeros(len(pdf), dtype=np.int32), np.zeros(len(pdf))
            length = pdf["v"].map(len).to_numpy()
            for k in np.unique(length).tolist():
                rows = np.flatnonzero(length == k)
                v = np.stack(pdf["v"].to_numpy()[rows])
                if k in by_length:
                    p = by_length[k]
                    near = ((p**2).sum(axis=1)[None, :] - 2 * v @ p.T).argmin(axis=1)
                    pivot[rows], away[rows] = np.array(at_length[k])[near], np.sqrt(((v - p[near]) ** 2).sum(axis=1))
                else:
                    pivot[rows], away[rows] = -k, np.sqrt((v**2).sum(axis=1))  # around zero
            yield pd.DataFrame({"row": pdf["row"], "vec_id": pdf["vec_id"], "v": pdf["v"], "pivot": pivot, "away": away, "length": length.astype(np.int32)})

    dealt = common.settle(clean.mapInPandas(deal, "row long, vec_id long, v array<double>, pivot int, away double, length int"), "dealt")
    groups = dealt.groupBy("pivot", "length").agg(F.count("*").alias("n"), F.max("away").alias("away")).collect()  # a row per pivot
    split = spark.createDataFrame([(r.pivot, r.length, -(-r.n // block_rows)) for r in groups] or [(0, 0, 1)], "pivot int, length int, parts int")
    # at most one row per pivot is broadcast
    blocks = dealt.join(F.broadcast(split), ["pivot", "length"]).withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int")).drop("parts")
    blocks = common.settle(blocks, "blocks")
    # pivots by length: their numbers, centres (zero where no pivot has that length) and radii
    around: dict[int, tuple] = {}
    for k in {r.length for r in groups}:
        mine = [r for r in groups if r.length == k]
        centres = np.array([np.asarray(pivots[r.pivot].v) if r.pivot >= 0 else np.zeros(k) for r in mine])
        around[k] = np.array([r.pivot for r in mine], dtype=np.int32), centres, np.array([r.away for r in mine])
    keys = ["pivot", "part", "length"]
    queries = blocks.where(F.col("vec_id") % every == 0).withColumn("floor", F.lit(float("-inf"))).withColumnsRenamed({"vec_id": "query_id", "row": "query"})
    at_home = common.settle(queries.groupBy(*keys).cogroup(blocks.groupBy(*keys)).applyInPandas(_block_search, RESULT), "at-home")
    kth = at_home.groupBy("query").agg(F.when(F.count("*") >= K, F.min("score")).otherwise(float("-inf")).alias("floor"))
    asking = queries.drop("floor").join(kth, "query", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))

    def send(parts):
        for pdf in parts:
            out = []
            for k, rows in pdf.groupby("length"):
                number, centres, radius = around[int(k)]
                for at in range(0, len(rows), 256):
                    some = rows.iloc[at : at + 256]
                    v = np.stack(some["v"].to_numpy())
                    bound = v @ centres.T + np.sqrt((v**2).sum(axis=1))[:, None] * radius
                    q, p = np.nonzero(bound + np.abs(bound) * 1e-9 + 1e-3 >= some["floor"].to_numpy()[:, None])
                    found = some.iloc[q][["query", "query_id", "v", "floor", "pivot", "part", "length"]]
                    out.append(found.rename(columns={"pivot": "home", "part": "home_part"}).assign(pivot=number[p]))
            yield pd.concat(out) if out else pd.DataFrame(columns=["query", "query_id", "v", "floor", "home", "home_part", "length", "pivot"])

    sent = asking.mapInPandas(send, "query long, query_id long, v array<double>, floor double, home int, home_part int, length int, pivot int")
    sent = sent.join(F.broadcast(split), ["pivot", "length"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).where("pivot <> home or part <> home_part")
    away = sent.select(*keys, "query", "query_id", "v", "floor").groupBy(*keys).cogroup(blocks.groupBy(*keys)).applyInPandas(_block_search, RESULT)
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    ranked = at_home.unionByName(away).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= K)
    return ranked.select("query_id", F.col("rank").cast("int"), "vec_id", F.col("score").cast("long"))


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best vectors for every 50th; see top_k."""
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
