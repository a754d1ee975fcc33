"""Mixing sources to target weights by Sainte-Laguë apportionment of equal blocks of words.

Sources, in code point order, weigh 3, 1, 2 and so on; their targets share 150 % of all words, none above twice its source.
The blocks that the mix has go to sources one by one by the highest quotient target / (2 x blocks so far + 1): the divisor that
hands out as many is searched for with sums over sources, and quotients that tie with it go in the sources' order. A source is
cut into shards by a seeded hash of its rows, and its blocks go to its shards by highest quotients. In a shard, documents lie end
to end in a seeded order; the shard's quota takes every block the same number of times and the blocks of a seeded, evenly spaced
selection once more, so no block is taken more than twice. What a document gives is found from its place by arithmetic, so
blocks are never listed.

Null sources form one source of their own, last in order. Null texts have size 0; documents of size 0 give no words. Rows with
equal doc_id and text lie next to each other in one shard. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

WEIGHTS = (3, 1, 2)
SHARE, MOST = 1.5, 2
BLOCK, SHARD, SHARDS, SEED = 8, 1 << 16, 1 << 16, 20
#: Divisors that one pass over the sources tries.
TRIED = 32


def highest_quotients(sizes: np.ndarray, seats: int, caps: np.ndarray) -> np.ndarray:
    """Seats for each size by Sainte-Laguë, ties to the first, none above its cap."""
    sizes = sizes.astype(np.float64)
    if seats <= 0 or not sizes.sum():
        return np.zeros(len(sizes), dtype=np.int64)

    def at(divisor: float) -> np.ndarray:
        return np.minimum(np.floor(sizes / divisor + 0.5), caps).astype(np.int64)

    low, high = sizes.sum() / seats / 4, 4 * sizes.sum() / seats + 4 * sizes.max()  # high: at most the seats wanted
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (low, middle) if at(middle).sum() <= seats else (middle, high)
    got = at(high)
    heap = [(-s / (2 * g + 1), i) for i, (s, g, c) in enumerate(zip(sizes.tolist(), got.tolist(), caps.tolist(), strict=True)) if s and g < c]
    heapq.heapify(heap)
    for _ in range(seats - int(got.sum())):
        if not heap:
            break
        _, i = heapq.heappop(heap)
        got[i] += 1
        if got[i] < caps[i]:
            heapq.heappush(heap, (-sizes[i] / (2 * got[i] + 1), i))
    return got


def targets(sources: DataFrame, share: float = SHARE, most: int = MOST, weights: tuple = WEIGHTS) -> DataFrame:
    """sources(source, source_size) with weight and target; the excess above most x size is reshared by weight."""
    # one row per source
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weighed = common.settle(sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int")).cast("double")), "sources")
    level, cap = 0.0, F.col("source_size") * most
    whole = share * (weighed.agg(F.sum("source_size")).first()[0] or 0)
    while whole:
        full = cap <= F.col("weight") * level
        s = weighed.agg(F.sum(F.when(full, cap)).alias("full"), F.sum(F.when(~full, F.col("weight"))).alias("weight")).first()
        new = (whole - (s.full or 0)) / s.weight if s.weight else level
        if new <= level:
            break
        level = new
    return weighed.withColumn("target", F.least(cap.cast("double"), F.col("weight") * level))


def source_blocks(sources: DataFrame, block: int, most: int = MOST) -> DataFrame:
    """sources(key, source, source_size, target, ...) with blocks: all that the targets hold together, by highest quotients."""
    cap = F.ceil(F.col("source_size") / block) * most
    # sums of doubles may differ in their last digits from run to run, which must not decide about a half
    seats = int(round((sources.agg(F.sum("target")).first()[0] or 0) / block, 6) + 0.5)

    def at(divisor: float) -> Column:
        return F.least(F.floor(F.col("target") / F.lit(divisor) + 0.5), cap).cast("long")

    def handed_out(divisors: list[float]) -> list[int]:
        return [x or 0 for x in sources.agg(*[F.sum(at(d)).alias(f"d{k}") for k, d in enumerate(divisors)]).first()]

    if not seats:
        return sources.withColumn("blocks", F.lit(0).cast("long"))
    low, high = block / 2, 2.0 * block
    while handed_out([low])[0] < seats and low > 1e-9:
        low /= 64
    while handed_out([high])[0] > seats:
        high *= 64
    # low hands out at least the seats, high at most; between them in the end no source has more than one quotient
    for _ in range(20):
        tried = [low * (high / low) ** (k / TRIED) for k in range(1, TRIED)]
        sums = handed_out(tried)
        k = sum(x > seats for x in sums)
        low, high = tried[k - 1] if k else low, tried[k] if k < len(tried) else high
        open_ = sources.agg(F.max(at(low) - at(high)), F.sum(at(high))).first()
        if open_[0] <= 1 or high / low - 1 < 1e-15:
            break
    given = sources.withColumn("blocks", at(high)).withColumn("_more", at(low) - at(high))
    left = seats - open_[1]
    if not left:
        return given.drop("_more")
    order = [F.desc(F.col("target") / (2 * F.col("blocks") + 1)), F.col("source").asc_nulls_last()]
    extra = given.where("_more > 0").orderBy(*order).limit(left).select("key", F.lit(1).alias("_one"))
    return given.join(extra, "key", "left").withColumn("blocks", F.col("blocks") + F.coalesce("_one", F.lit(0))).drop("_more", "_one")


def mix(docs: DataFrame, block: int = BLOCK, seed: int = SEED, shard_words: int = SHARD, most_shards: int = SHARDS) -> DataFrame:
    """doc_id, size, source_size, target, taken of each row of docs(doc_id, text, source)."""
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    key = F.coalesce(F.concat(F.lit("+"), F.col("source")), F.lit(""))
    mark = F.xxhash64(F.lit(seed), F.col("doc_id").cast("long"), "text").alias("mark")
    sized = common.settle(docs.select(F.col("doc_id").cast("long"), key.alias("key"), "source", size.alias("size"), mark), "sizes")
    per_source = source_blocks(targets(sized.groupBy("key", "source").agg(F.sum("size").alias("source_size"))), block)
    shards = F.least(F.lit(most_shards), F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words))).cast("int")
    per_source = common.settle(per_source.select("key", "source_size", "target", shards.alias("shards"), "blocks"), "targets")
    placed = common.join_small(sized.select("doc_id", "key", "size", "mark"), per_source, ["key"]).withColumn("shard", F.pmod(F.xxhash64("mark"), F.col("shards")).cast("int"))

    def quotas(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("shard", ignore_index=True)
        words = pdf["words"].to_numpy()
        n = -(-words // block)
        # the last block of a shard is shorter, so the source's words are some more blocks here
        seats = int(round(int(pdf["blocks"].iloc[0]) * block * n.sum() / max(words.sum(), 1)))
        return pd.DataFrame({"key": pdf["key"], "shard": pdf["shard"], "n_blocks": n, "quota": highest_quotients(words, min(seats, int(n.sum()) * MOST), n * MOST)})

    # at most most_shards rows a source
    per_shard = placed.groupBy("key", "shard").agg(F.sum("size").alias("words"), F.first("blocks").alias("blocks")).groupBy("key").applyInPandas(quotas, "key string, shard int, n_blocks long, quota long")
    order = Window.partitionBy("key", "shard").orderBy("mark", "doc_id", "size")
    lain = placed.withColumn("end", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))).join(per_shard, ["key", "shard"])
    lain = lain.withColumns({"full": F.expr("if(n_blocks = 0, 0, quota div n_blocks)"), "extra": F.expr("if(n_blocks = 0, 0, quota % n_blocks)"), "offset": F.expr(f"if(n_blocks = 0, 0, pmod(xxhash64({seed}, key, shard), n_blocks))")})

    def chosen(x: str) -> str:
        """Words of the blocks taken once more that lie before place x."""
        j = f"(({x}) div {block})"
        before = f"(({j} * extra + offset) div n_blocks)"
        return f"({block} * {before} + ((({j} + 1) * extra + offset) div n_blocks - {before}) * (({x}) - {block} * {j}))"

    taken = F.expr(f"if(n_blocks = 0, 0, full * size + {chosen('end')} - {chosen('end - size')})").cast("long")
    return lain.select("doc_id", "size", "source_size", "target", taken.alias("taken"))


def repeat_documents(docs: DataFrame, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """docs with each document as often as the mix takes its words; a seeded draw decides about parts of a document.

    Rows of one doc_id share what they were given. Columns of any name are kept.
    """
    taken = mix(docs.select("doc_id", "text", "source"), block, seed).where("taken > 0 and size > 0").select("doc_id", (F.col("taken") / F.col("size")).alias("times"))
    draw = F.pmod(F.xxhash64("doc_id", F.lit(seed + 1)), F.lit(1 << 30)) / (1 << 30)
    key, times, nth = (common.unused(docs, x) for x in ("_id", "_times", "_nth"))
    whole = taken.groupBy("doc_id").agg(F.avg("times").alias("times")).select(F.col("doc_id").alias(key), F.floor(F.col("times") + draw).cast("int").alias(times)).where(F.col(times) > 0)
    # the columns of docs go as they are, apart from what is joined
    joined = docs.join(whole, F.col("doc_id").cast("long").eqNullSafe(F.col(key)))
    return joined.withColumn(nth, F.explode(F.sequence(F.lit(1), times))).select(*map(common.quoted, docs.columns))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents; see mix."""
    return mix(common.documents(spark, sf_dir, "doc_id", "text", "source"))
