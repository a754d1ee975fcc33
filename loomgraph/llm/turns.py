"""Repair of the structure of conversations at least cost.

A repaired conversation's roles, by their first characters, are `(s?(ua)+)?`. Keeping a turn costs 0, giving it the role user or
assistant 2, deleting it 3, inserting an empty turn of either role 2; a truncated turn that is not deleted costs 1 more, and blank
and repeated turns have to go. A backward pass gives the cost to go of each turn and grammar state, and a greedy forward walk takes
the ASCII-least edit (D, I, K, R) among those that are tight, so of the cheapest audits the least is found.

What a turn may become and costs is a matrix of costs between grammar states, and such matrices multiply (least sum in place of
sum of products). So conversations are sorted by range, which splits a long one over many tasks, and cut into segments; the matrix
of a segment is found where it lies, only matrices of a conversation meet, and each segment is then walked by itself. Texts stay
behind: what is sorted is a digest of each, and only the turns that are kept are joined with their texts, by turn and digest.

Turns are ordered by turn (nulls first), then by role and by the digest of the text; equal rows are adjacent. A null role or text
is one space; a null conv_id is a conversation of its own. A role of no characters fits nowhere. Conversations without rows have
zeros, no edits and no repaired turns. gaps beyond 64 bits are null. Extra columns change nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from . import common

#: Turns in a segment at most.
SEGMENT = 4096
SOUND, BLANK, REPEATED, TRUNCATED = range(4)
INITIALS = "sua"
REROLE, DELETE, INSERT, CUT_OFF = 2, 3, 2, 1
#: Grammar states: nothing yet, after s, after u, after a; what the next user or assistant turn is, where it leads, and what an end costs.
STATES = range(4)
ROLE_AT, NEXT_AT, END = ("user", "user", "assistant", "user"), (2, 2, 3, 2), (0, 4, 2, 0)
KEPT_AT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
NEVER = 1 << 60
#: A turn's key: the digest's last byte says which of conv_id and turn are null, so keys are never null.
KEYS = ["conv_key", "turn_key", "role", "mark"]

#: A turn's code is its fault times 4 and the place of its role's initial in INITIALS and one, or 0.
RAW = "conv_id long, seg long, turns array<long>, roles array<string>, marks array<binary>, codes array<int>, copies array<long>, costs array<long>"


def with_marks(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, mark (digest of the text, and a byte), and KEYS; nulls in roles and texts are one space."""
    filled = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")])
    digest = F.concat(F.substring(F.sha2("text", 256), 1, 32), F.lit("0"), (F.col("conv_id").isNull().cast("int") * 2 + F.col("turn").isNull().cast("int")).cast("string"))
    return filled.select("*", F.unhex(digest).alias("mark"), F.coalesce("conv_id", F.lit(0)).alias("conv_key"), F.coalesce("turn", F.lit(0)).alias("turn_key"))


def coded(marked: DataFrame) -> DataFrame:
    """conv_id, turn, role, mark, code, copies: one row per different turn, its code for the first of its copies."""
    bare = F.rtrim(F.translate("text", "\t\n\x0b\x0c\r", "     "))
    initial = F.position(F.substring("role", 1, 1), F.lit(INITIALS))
    light = marked.select("conv_id", "turn", "role", "mark", F.when(F.length("role") > 0, initial).otherwise(0).alias("initial"), (bare == "").alias("blank"), (~F.substring(bare, -1, 1).isin(".", "!", "?")).alias("cut"))
    rows = light.groupBy("conv_id", "turn", "role", "mark", "initial", "blank", "cut").agg(F.count("*").alias("copies"))
    at = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    rows = rows.withColumn("digest", F.substring("mark", 1, 16))
    firsts = rows.groupBy("conv_id", "role", "digest").agg(F.min(at).alias("first")).toDF("conv", "said_by", "said", "first")
    same = rows["conv_id"].eqNullSafe(firsts["conv"]) & (rows["role"] == firsts["said_by"]) & (rows["digest"] == firsts["said"])
    fault = F.when(F.col("blank"), BLANK).when(~F.col("turn").eqNullSafe(F.col("first.turn")), REPEATED).when(F.col("cut"), TRUNCATED).otherwise(SOUND)
    return rows.join(firsts, same).select("conv_id", "turn", "role", "mark", (fault * 4 + F.col("initial")).cast("int").alias("code"), "copies")


@lru_cache(maxsize=16)
def choices(code: int) -> tuple:
    """For each state: (letter, cost, next state) of a turn of this code, ASCII-least letters first; inserts come apart."""
    fault, initial = divmod(code, 4)
    if fault in (BLANK, REPEATED):
        return tuple((("D", DELETE, q),) for q in STATES)
    more, by_state = CUT_OFF if fault == TRUNCATED else 0, []
    for q in STATES:
        kept = KEPT_AT[q].get(INITIALS[initial - 1]) if initial else None
        by_state.append((("D", DELETE, q), *((("K", more, kept),) if kept else ()), ("R", REROLE + more, NEXT_AT[q])))
    return tuple(by_state)


def backward(codes: list[int], copies: list[int], end: tuple) -> list[tuple]:
    """Cost to go before each turn and at the end, by state; inserts before a turn are in it. end: that of what follows."""
    found = [tuple(end)]
    for code, n in zip(reversed(codes), reversed(copies), strict=True):
        after, extra = found[-1], DELETE * (n - 1)
        best = [min(cost + after[to] for _, cost, to in here) + extra for here in choices(code)]
        # two inserts lead from any state to any that inserts reach
        for _ in range(2):
            best = [min(b, INSERT + best[NEXT_AT[q]]) for q, b in enumerate(best)]
        found.append(tuple(min(b, NEVER) for b in best))
    found.reverse()
    return found


def walk(codes: list[int], copies: list[int], to_go: list[tuple], state: int, last: bool) -> tuple[str, int]:
    """The ASCII-least of the cheapest edits from a state on, and the state that they lead to."""
    edits = []
    for i, (code, n) in enumerate(zip(codes, copies, strict=True)):
        while True:
            left, extra = to_go[i][state], DELETE * (n - 1)
            tight = [(letter, to) for letter, cost, to in choices(code)[state] if cost + extra + to_go[i + 1][to] == left]
            if tight and tight[0][0] == "D" or INSERT + to_go[i][NEXT_AT[state]] != left:
                letter, state = tight[0]
                edits.append(letter + "D" * (n - 1))
                break
            edits.append("I")
            state = NEXT_AT[state]
    while last and END[state]:
        edits.append("I")
        state = NEXT_AT[state]
    return "".join(edits), state


def _packed(size: int):
    """Runs of sorted turns of one conversation as segments of at most `size`, numbered in the order of the sort."""

    def segment(number: int, held: list[dict]) -> dict:
        codes, copies = [r["code"] for r in held], [r["copies"] for r in held]
        costs = [min(x, NEVER) for e in STATES for x in backward(codes, copies, tuple(0 if q == e else NEVER for q in STATES))[0]]
        return {"conv_id": held[0]["conv_id"], "seg": number, "turns": [r["turn"] for r in held], "roles": [r["role"] for r in held], "marks": [r["mark"] for r in held], "codes": codes, "copies": copies, "costs": costs}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = TaskContext.get().partitionId() << 32, []
        for batch in batches:
            found: list[dict] = []
            for row in batch.to_pylist():
                if held and (held[0]["conv_id"] != row["conv_id"] or len(held) == size):
                    found.append(segment(number, held))
                    number, held = number + 1, []
                held.append(row)
            yield pa.RecordBatch.from_pylist(found, schema=RAW_ARROW)
        if held:
            yield pa.RecordBatch.from_pylist([segment(number, held)], schema=RAW_ARROW)

    return common.released(run)


RAW_ARROW = pa.schema([("conv_id", pa.int64()), ("seg", pa.int64()), ("turns", pa.list_(pa.int64())), ("roles", pa.list_(pa.string())), ("marks", pa.list_(pa.binary())), ("codes", pa.list_(pa.int32())), ("copies", pa.list_(pa.int64())), ("costs", pa.list_(pa.int64()))])


def segments(marked: DataFrame, size: int = SEGMENT) -> DataFrame:
    """The turns of with_marks() as settled segments."""
    rows = coded(marked)
    order = [F.col("conv_id"), F.col("turn").isNotNull(), F.col("turn"), F.col("role"), F.col("mark")]
    ordered = rows.repartitionByRange(common.partitions_for(marked), *order).sortWithinPartitions(*order)
    return common.settle(ordered.select("conv_id", "turn", "role", "mark", "code", "copies").mapInArrow(_packed(size), RAW), "segments")


def _per_row(work, schema: pa.Schema):
    """A function over Arrow batches that maps each row to rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pylist([out for row in batch.to_pylist() for out in work(row)], schema=schema)

    return common.released(run)


def _chained(row: dict) -> Iterator[dict]:
    """Cost to go at the end of each segment of a conversation."""
    end, found = END, []
    for k, s in enumerate(reversed(row["segs"])):
        found.append({"seg": s["seg"], "to_go": list(end), "last": k == 0})
        end = tuple(min(s["costs"][4 * e + q] + end[e] for e in STATES) for q in STATES)
    return iter(found)


def _walked(row: dict) -> Iterator[dict]:
    """The edits of a segment from each state, and where they lead."""
    to_go = backward(row["codes"], row["copies"], tuple(row["to_go"]))
    # no turn leads back to the state of nothing yet; a state from which nothing is possible is never entered
    ways = [walk(row["codes"], row["copies"], to_go, q, row["last"]) if to_go[0][q] < NEVER else ("", q) for q in STATES]
    return iter([{"conv_id": row["conv_id"], "seg": row["seg"], "turns": row["turns"], "roles": row["roles"], "marks": row["marks"], "codes": row["codes"], "copies": row["copies"], "cost": list(to_go[0]), "ways": [w for w, _ in ways], "ends": [q for _, q in ways]}])


def _started(row: dict) -> Iterator[dict]:
    """The state that each segment of a conversation starts in."""
    state = 0
    for s in row["segs"]:
        yield {"seg": s["seg"], "start": state}
        state = s["ends"][state]


def _edited(row: dict) -> Iterator[dict]:
    """What is kept and inserted in a segment, in order."""
    i, state, seen = -1, row["start"], 0
    for k, letter in enumerate(row["ways"][state]):
        if letter != "I":
            # copies of a turn beyond the first are deleted after it
            if seen == 0:
                i, seen = i + 1, row["copies"][i + 1]
            seen -= 1
        if letter == "D":
            continue
        given = ROLE_AT[state] if letter in "IR" else None
        state = NEXT_AT[state] if given else KEPT_AT[state][row["roles"][i][0]]
        old = (row["turns"][i], row["roles"][i], row["marks"][i]) if letter != "I" else (None, None, None)
        yield {"conv_id": row["conv_id"], "seg": row["seg"], "k": k, "letter": letter, "given": given, "turn": old[0], "role": old[1], "mark": old[2]}


def walks(segs: DataFrame) -> DataFrame:
    """The segments with their start state and, by start state, edits and cost to go; settled."""
    chains = segs.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("seg", "costs"))).alias("segs"))
    ends = chains.mapInArrow(_per_row(_chained, pa.schema([("seg", pa.int64()), ("to_go", pa.list_(pa.int64())), ("last", pa.bool_())])), "seg long, to_go array<long>, last boolean")
    lists = "conv_id long, seg long, turns array<long>, roles array<string>, marks array<binary>, codes array<int>, copies array<long>, cost array<long>, ways array<string>, ends array<int>"
    arrow = pa.schema([*[f for f in RAW_ARROW if f.name != "costs"], ("cost", pa.list_(pa.int64())), ("ways", pa.list_(pa.string())), ("ends", pa.list_(pa.int32()))])
    walked = common.settle(segs.drop("costs").join(ends, "seg").mapInArrow(_per_row(_walked, arrow), lists), "walks")
    lines = walked.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("seg", "ends"))).alias("segs"))
    starts = lines.mapInArrow(_per_row(_started, pa.schema([("seg", pa.int64()), ("start", pa.int32())])), "seg long, start int")
    return common.settle(walked.join(starts, "seg"), "starts")


def repaired(marked: DataFrame, walked: DataFrame) -> DataFrame:
    """conv_id, seg, k, letter, role, text: the turns of repaired conversations, ordered by seg and k."""
    arrow = pa.schema([("conv_id", pa.int64()), ("seg", pa.int64()), ("k", pa.int32()), ("letter", pa.string()), ("given", pa.string()), ("turn", pa.int64()), ("role", pa.string()), ("mark", pa.binary())])
    edits = walked.select("conv_id", "seg", "turns", "roles", "marks", "copies", "ways", "start").mapInArrow(_per_row(_edited, arrow), "conv_id long, seg long, k int, letter string, given string, turn long, role string, mark binary")
    kept = edits.where("letter != 'I'").withColumns({"conv_key": F.coalesce("conv_id", F.lit(0)), "turn_key": F.coalesce("turn", F.lit(0))}).drop("turn")
    # rows that are copies of each other are one turn; grouping and join share one layout, which deals the turns of a conversation out
    texts = marked.groupBy(*KEYS).agg(F.first("text").alias("text")).join(kept, KEYS)
    out = texts.select("conv_id", "seg", "k", "letter", F.coalesce("given", "role").alias("role"), "text")
    return out.unionByName(edits.where("letter = 'I'").select("conv_id", "seg", "k", "letter", F.col("given").alias("role"), F.lit("").alias("text")))


def report(walked: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit of every conversation that has turns."""
    row = walked.select("conv_id", "seg", "turns", "start", "cost", F.element_at("ways", F.col("start") + 1).alias("way"), F.arrays_zip(F.col("codes").alias("code"), F.col("copies").alias("n")).alias("rows"))
    total = lambda pick: F.aggregate("rows", F.lit(0).cast("long"), lambda s, x: s + pick(F.floor(x["code"] / 4), x["code"] % 4, x["n"]))
    rest = lambda f, k: F.when(f == k, F.lit(1).cast("long")).otherwise(F.lit(0).cast("long"))
    legal = lambda a, b: F.concat(a.cast("string"), b.cast("string")).isin("12", "23", "32")
    first, last = F.element_at("rows", 1)["code"] % 4, F.element_at("rows", -1)["code"] % 4
    # neighbours in a segment, and copies of a turn beside each other
    pairs = F.zip_with(F.slice("rows", 1, F.size("rows") - 1), F.slice("rows", 2, F.size("rows")), lambda x, y: (~legal(x["code"] % 4, y["code"] % 4)).cast("long"))
    row = row.select(
        "conv_id", "seg", "way", "turns", first.alias("first"), last.alias("last"), F.when(F.col("start") == 0, F.element_at("cost", 1)).alias("cost"),
        total(lambda f, i, n: F.when(f == BLANK, n).otherwise(0)).alias("blank"), total(lambda f, i, n: F.when(f == REPEATED, n).when(f == BLANK, 0).otherwise(n - 1)).alias("duplicate"), total(lambda f, i, n: rest(f, TRUNCATED)).alias("truncated"),
        (total(lambda f, i, n: n - 1) + F.aggregate(pairs, F.lit(0).cast("long"), lambda s, x: s + x)).alias("illegal"),
    )
    known = F.filter("turns", lambda t: t.isNotNull())
    row = row.withColumns({"low": F.array_min(known), "high": F.array_max(known), "distinct": F.size(F.array_distinct(known)).cast("long")}).drop("turns")
    # a conversation's segments, a few numbers each
    by = F.struct("seg", "way", "first", "last", "cost", "low", "high", "distinct")
    sums = row.groupBy("conv_id").agg(F.sort_array(F.collect_list(by)).alias("segs"), *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")])
    meet = lambda pick: F.aggregate(F.zip_with(F.slice("segs", 1, F.size("segs") - 1), F.slice("segs", 2, F.size("segs")), pick), F.lit(0).cast("long"), lambda s, x: s + x)
    spread = F.try_subtract(F.array_max("segs.high"), F.array_min("segs.low"))
    twice = meet(lambda x, y: F.coalesce((x["high"] == y["low"]).cast("long"), F.lit(0).cast("long")))
    distinct = F.aggregate("segs.distinct", F.lit(0).cast("long"), lambda s, x: s + x) - twice
    return sums.select(
        "conv_id", F.when(F.array_min("segs.low").isNull(), 0).otherwise(F.try_add(spread, 1 - distinct)).cast("long").alias("gaps"), "blank", "duplicate", "truncated",
        (F.col("illegal") + meet(lambda x, y: (~legal(x["last"], y["first"])).cast("long"))).alias("illegal"), F.element_at("segs", 1)["cost"].alias("cost"), F.array_join("segs.way", "").alias("audit"),
    )


def repair(turns: DataFrame, size: int = SEGMENT) -> tuple[DataFrame, DataFrame]:
    """The report of turns(conv_id, turn, role, text), and the repaired turns."""
    marked = with_marks(turns)
    walked = walks(segments(marked, size))
    return report(walked), repaired(marked, walked)


def digests(found: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256 of the turns of repaired(), as `role:text` lines.

    A digest runs over a conversation from end to end, so its turns stream, sorted, through one task, which holds a turn at a time.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, digest, done = None, None, []
        for batch in batches:
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if digest is None or conv != at:
                    if digest is not None:
                        done.append((at, digest.hexdigest()))
                    at, digest = conv, hashlib.sha256()
                else:
                    digest.update(b"\n")
                digest.update(f"{role}:{text}".encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), (pa.int64(), pa.string()), strict=True)], names=["conv_id", "repaired_sha256"])
                done = []
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([digest.hexdigest()])], names=["conv_id", "repaired_sha256"])

    return found.select("conv_id", "seg", "k", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "seg", "k").mapInArrow(common.released(work), "conv_id long, repaired_sha256 string")


def damaged(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after damage by the crc32 of `conv_id:turn` by 20 (nulls: one space)."""
    text, space = F.coalesce("text", F.lit(" ")), F.lit(" ")
    lot = F.crc32(F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), space), F.coalesce(F.col("turn").cast("string"), space)).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", F.coalesce("role", space).alias("role"), text.alias("text"), lot.alias("lot")).where("lot != 0")
    changed = F.when(F.col("lot") == 1, "").when(F.col("lot") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("lot") == 4, "user").otherwise(F.col("role")).alias("role"), changed.alias("text"), F.explode(F.when(F.col("lot") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))
    return rows.drop("copy")


def op12_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, damaged and repaired."""
    given = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    found, turns = repair(damaged(given))
    hashes = digests(turns).withColumnRenamed("conv_id", "conv")
    every = given.select(F.col("conv_id").cast("long").alias("every")).distinct()
    joined = every.join(found, every["every"].eqNullSafe(found["conv_id"]), "left").join(hashes, F.col("every").eqNullSafe(hashes["conv"]), "left")
    numbers = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")]
    gaps = F.when(F.col("audit").isNull(), 0).otherwise(F.col("gaps")).cast("long").alias("gaps")
    return joined.select(F.col("every").alias("conv_id"), gaps, *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))

