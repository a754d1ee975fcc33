"""Conversation repair against a search of all edits in order of cost and letters."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from loomgraph.llm import turns

SCHEMA = "conv_id long, turn long, role string, text string"


def shown(x):
    return " " if x is None else str(x)


def damage(rows):
    for conv, turn, role, text in rows:
        lot = zlib.crc32(f"{shown(conv)}:{shown(turn)}".encode()) % 20
        role, text = shown(role), shown(text)
        if lot == 1:
            text = ""
        elif lot == 2:
            text = re.sub("[.!?]", "", text)
        elif lot == 4:
            role = "user"
        yield from [(conv, turn, role, text)] * (lot != 0) * (2 if lot == 3 else 1)


def after(state, initial):
    return {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}.get((state, initial))


def cheapest(rows, faults):
    """(cost, audit, lines) of the cheapest edits, then ASCII-least."""
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, state, lines = heapq.heappop(heap)
        if i == len(rows) and state in ("", "a"):
            return cost, audit, lines
        if (i, state) in done:
            continue
        done.add((i, state))
        roles = [(r, after(state, r[0])) for r in ("user", "assistant") if after(state, r[0])]
        for role, to in roles:
            heapq.heappush(heap, (cost + 2, audit + "I", i, to, (*lines, f"{role}:")))
        if i == len(rows):
            continue
        _, role, text = rows[i]
        heapq.heappush(heap, (cost + 3, audit + "D", i + 1, state, lines))
        if faults[i] in ("", "truncated"):
            more = faults[i] == "truncated"
            if role and after(state, role[0]):
                heapq.heappush(heap, (cost + more, audit + "K", i + 1, after(state, role[0]), (*lines, f"{role}:{text}")))
            for given, to in roles:
                heapq.heappush(heap, (cost + 2 + more, audit + "R", i + 1, to, (*lines, f"{given}:{text}")))


def brute(rows, every):
    convs = {c: [] for c in every}
    for conv, *row in rows:
        convs[conv].append(tuple(row))
    found = {}
    for conv, these in convs.items():
        these.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
        faults, seen = [], set()
        for _, role, text in these:
            bare = re.sub(r"[\x20\x09-\x0D]", "", text)
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        known = [t for t, _, _ in these if t is not None]
        cost, audit, lines = cheapest(these, faults)
        found[conv] = {
            "conv_id": conv,
            "gaps": max(known) - min(known) + 1 - len(set(known)) if known else 0,
            **{f: faults.count(f) for f in ("blank", "duplicate", "truncated")},
            "illegal": sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(these, these[1:], strict=False)),
            "cost": cost,
            "audit": audit,
            "repaired_sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        }
    return found


def got(spark, rows, size):
    found, repaired = turns.repair(spark.createDataFrame(rows, SCHEMA), size)
    hashes = {r.conv_id: r.repaired_sha256 for r in turns.digests(repaired).collect()}
    return {r.conv_id: r.asDict() | {"repaired_sha256": hashes.get(r.conv_id, hashlib.sha256().hexdigest())} for r in found.collect()}


def awkward(n, seed, convs=40):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "well", "", " \t\n", "Why?\n ", "é.", "x" * 3000, None, "."]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "uncle"]
    return [(rng.choice([None, *range(convs)]), rng.choice([None, *range(12)]), rng.choice(roles), rng.choice(texts)) for _ in range(n)]


@pytest.mark.parametrize("size", [1, 3, 4096])
def test_against_all_edits(spark, size):
    rows = awkward(700, size)
    filled = [(c, t, shown(r), shown(x)) for c, t, r, x in rows]
    want = brute(filled, {r[0] for r in rows})
    assert got(spark, rows, size) == want


def test_one_long_conversation_is_cut(spark):
    rng = random.Random(5)
    rows = [(7, t, rng.choice(["user", "assistant", "system"]), rng.choice([f"text {t}.", "again.", "cut", ""])) for t in range(3000)]
    want = brute(rows, [7])
    assert got(spark, rows, 100) == want


def test_query(spark, sf, tmp_path):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()] + awkward(200, 9, 300)
    spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA + ", audit int, seg string").write.parquet(f"{tmp_path}/conversations.parquet")
    want = brute(damage(rows), {r[0] for r in rows})
    assert {r.conv_id: r.asDict() for r in turns.op12_turns(spark, str(tmp_path)).collect()} == want
    # a conversation whose rows are all dropped is among them
    assert any(not w["audit"] for w in want.values())


def test_empty_and_far_turns(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    assert turns.op12_turns(spark, str(tmp_path)).collect() == []
    found = got(spark, [(1, -(1 << 63), "user", "a."), (1, (1 << 63) - 1, "assistant", "b.")], 10)
    assert found[1]["gaps"] is None and found[1]["audit"] == "KK"
