"""Document fingerprints: one-permutation MinHash with optimal densification and b-bit values.

The hash of each shingle of five words falls into one of BINS bins by its top bits; a bin keeps its least hash. An empty bin
takes the value of the first non-empty bin that its own sequence of attempts meets: attempt t of bin b goes to bin
(a_b t + c_b) mod BINS with a_b odd, so every bin is met. Of each value the low 8 bits are stored, and likenesses are corrected for
values that agree by chance. Everything is a SQL expression; no row is compared with another but its neighbour.

A null text counts as empty. A text of fewer than five words has one shingle, its whole sequence; one without words has the
empty fingerprint, which is like itself (1) and like nothing else (0). Documents are in descending order of doc_id, null
doc_ids last; rows of one doc_id are ordered by their text's hash. A lone document is its own next.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

WORDS, BITS = 5, 7
BINS = 1 << BITS
LOWEST = -(1 << 63)


def _constants(factor: int) -> list[int]:
    return [(b * factor + (b * b * 37 >> 3) + 11) % BINS for b in range(BINS)]


#: The inverse of a_b (odd) and c_b, for each bin.
INVERSE, SHIFT = [x | 1 for x in _constants(89)], _constants(53)


def with_fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """df with out array<tinyint>: BINS values of the non-null column text, or none for a text without words."""
    t = [f"_{out}{k}" for k in range(5)]
    blanks = " \t\n\x0b\f\r"
    trimmed = F.btrim(F.col(text), F.lit(blanks))
    df = df.withColumn(t[0], F.transform(F.split(trimmed, common.BLANKS), lambda w: F.xxhash64(w)))

    def at(i: Column) -> Column:
        return F.xxhash64(*[F.get(F.col(t[0]), i + k) for k in range(WORDS)])

    many = F.transform(F.sequence(F.lit(0), F.size(t[0]) - WORDS), at)
    few = F.array(F.xxhash64(*[F.get(F.col(t[0]), F.lit(k)) for k in range(WORDS - 1)], F.size(t[0])))
    df = df.withColumn(t[1], F.sort_array(F.when(F.size(t[0]) >= WORDS, many).otherwise(few)))
    bin_of = lambda h: F.shiftrightunsigned(h, 64 - BITS)
    df = df.withColumn(t[2], F.filter(t[1], lambda h, i: (i == 0) | (bin_of(h) != bin_of(F.get(F.col(t[1]), i - 1)))))
    df = df.withColumn(t[3], F.transform(t[2], lambda h: bin_of(h).cast("int"))).withColumn(t[4], F.transform(t[2], lambda h: h.bitwiseAND(F.lit(255)).cast("int")))

    def first_met(b: Column) -> Column:
        """The value of the non-empty bin whose attempt comes first."""
        c, a = F.get(F.lit(SHIFT), b), F.get(F.lit(INVERSE), b)
        tried = F.zip_with(t[3], t[4], lambda j, v: ((j - c) * a).bitwiseAND(F.lit(BINS - 1)) * 256 + v)
        return F.array_min(tried).bitwiseAND(F.lit(255))

    places = F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda b: F.struct(b.alias("b"), F.array_position(F.col(t[3]), b).cast("int").alias("p")))
    filled = F.transform(places, lambda s: (F.when(s["p"] > 0, F.get(F.col(t[4]), s["p"] - 1)).otherwise(first_met(s["b"])) - 128).cast("tinyint"))
    return df.withColumn(out, F.when(trimmed == "", F.array().cast("array<tinyint>")).otherwise(filled)).drop(*t)


def packed(values: Column) -> Column:
    """The values as lower-case hex digits, two each."""
    digits = [f"{v:02x}" for v in range(256)]
    return F.array_join(F.transform(values, lambda v: F.get(F.lit(digits), v.cast("int") + 128)), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated share of common shingles: agreeing values, less those that agree by chance (1 in 256)."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda z: z)) / BINS
    corrected = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (same - 1 / 256) / (1 - 1 / 256)))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), (F.size(a) == F.size(b)).cast("double")).otherwise(corrected)


def bucket_of(rank: Column, bounds: list[int]) -> Column:
    """How many of the ascending bounds lie below rank; coarse bounds first, then those between two of them."""
    step = max(1, int(len(bounds) ** 0.5))
    groups = [bounds[k : k + step] for k in range(0, len(bounds), step)]
    if not groups:
        return F.lit(0)
    below = lambda xs: F.size(F.filter(xs, lambda x: x < rank))
    coarse = F.greatest(below(F.lit([g[0] for g in groups])) - 1, F.lit(0))
    return coarse * step + below(F.get(F.array(*[F.lit(g) for g in groups]), coarse))


def with_next(df: DataFrame, carried: list[str], buckets: int | None = None) -> DataFrame:
    """df(doc_id, ...) with next_<c> for each carried column: that of the next document, the first's after the last.

    Buckets of doc_id ranges are ordered each on its own; the first row of each also goes, as a ghost, to the end of the
    bucket before it. The driver gets one bound and one doc_id per bucket.
    """
    spark = df.sparkSession
    n = buckets or 4 * common.partitions_for(df)
    ranked = df.withColumn("_rank", F.coalesce(F.col("doc_id"), F.lit(LOWEST)))
    ids = ranked.select("_rank")
    bounds = sorted(set(ids.agg(F.percentile_approx("_rank", [k / n for k in range(1, n)], 20 * n)).first()[0] or []))
    bucket = bucket_of(F.col("_rank"), bounds)
    firsts = sorted((r.b, r.m) for r in ids.groupBy(bucket.alias("b")).agg(F.max("_rank").alias("m")).collect())
    ghosts = spark.createDataFrame([(m, firsts[(k + 1) % len(firsts)][0]) for k, (_, m) in enumerate(firsts)], "_rank long, _to int")
    # one ghost per bucket is broadcast
    placed = ranked.withColumn("_bucket", bucket).join(F.broadcast(ghosts), "_rank", "left")
    stay = F.struct(F.col("_bucket").alias("bucket"), F.lit(False).alias("ghost"))
    dealt = placed.withColumn("_at", F.explode(F.when(F.col("_to").isNull(), F.array(stay)).otherwise(F.array(stay, F.struct(F.col("_to").alias("bucket"), F.lit(True).alias("ghost"))))))
    dealt = dealt.withColumns({"_bucket": F.col("_at.bucket"), "_ghost": F.col("_at.ghost")}).drop("_at", "_to")
    order = Window.partitionBy("_bucket").orderBy(F.col("_ghost"), F.col("_rank").desc(), F.xxhash64(*carried))
    return dealt.withColumns({f"next_{c}": F.lead(c).over(order) for c in carried}).where(~F.col("_ghost")).drop("_ghost", "_bucket", "_rank")


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of docs(doc_id, text)."""
    base = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    both = with_next(with_fingerprint(base, "text", "print"), ["text", "print"])
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    both = both.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "print", "next_print")
    both = with_fingerprint(both, "edited", "edited_print")
    return both.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), packed(F.col("print")).alias("fingerprint"), packed(F.col("edited_print")).alias("edited_fingerprint"),
        likeness(F.col("print"), F.col("edited_print")).alias("near_edited"), likeness(F.col("print"), F.col("next_print")).alias("near_next"),
    )


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and their edited texts; see fingerprint_edits."""
    return fingerprint_edits(common.documents(spark, sf_dir, "doc_id", "text"))
