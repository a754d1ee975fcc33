import random
import re

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from loomgraph.llm import simhash


def brute_print(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute(rows):
    prints = {d: brute_print(t) for d, t in rows}
    least = {d: d for d in prints}
    again = True
    while again:
        again = False
        for a in prints:
            for b in prints:
                if (prints[a] ^ prints[b]).bit_count() <= 2 and least[a] > least[b]:
                    least[a], again = least[b], True
    return sorted((d, f"{prints[d]:016x}", least[d]) for d in prints)


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 2**64 - 1), st.lists(st.integers(0, 63), max_size=2))
def test_two_bits_share_a_key(fp, flips):
    other = fp
    for b in flips:
        other ^= 1 << b
    keys = [set(simhash.bucket_keys(np.array([x], dtype=np.uint64))[1].tolist()) for x in (fp, other)]
    assert keys[0] & keys[1]


def test_golay_code_is_perfect():
    v = np.arange(1 << 23)
    counts = np.bincount(simhash.decode_index(v))
    assert len(counts) == 4096 and (counts == 2048).all()


def test_query(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(map(tuple, simhash.op10_simhash(spark, sf).collect())) == brute(rows)


def test_chain_of_links(spark):
    rng, fp = random.Random(1), 0x0123456789ABCDEF
    chain = [fp]
    for _ in range(300):  # each two bits from the one before
        fp ^= 1 << rng.randrange(64) | 1 << rng.randrange(64)
        chain.append(fp)
    signed = [x - (1 << 64) if x >> 63 else x for x in dict.fromkeys(chain)]
    far = (signed[0] ^ 0x00FF00FF00FF00) | 0x7
    df = spark.createDataFrame([(x,) for x in signed] + [(far,)], "fp long")
    roots = {r.node: r.root for r in simhash.components(simhash.links(df)).collect()}
    assert {roots.get(x, x) for x in signed} == {min(signed)} and roots.get(far, far) == far


def test_edges(spark):
    rows = [(5, None), (4, ""), (3, "a b"), (2, "A  B"), (9, "x y z w"), (9, "x y z w"), (7, "w " * 90000), (8, "é É")]
    got = sorted(map(tuple, simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert [g for g in got if g[0] != 9] == [g for g in brute(rows) if g[0] != 9] and sum(g[0] == 9 for g in got) == 2
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    nulls = spark.createDataFrame([(None, "q r s"), (1, "q r s"), (None, "other")], "doc_id long, text string")
    assert sorted(str(r.component_id) for r in simhash.near_duplicates(nulls).collect()) == ["1", "1", "None"]
    extra = nulls.selectExpr("*", "1 as fp", "2 as root", "3 as salt")
    assert simhash.keep_first(extra).columns == extra.columns


def shingles(text, k=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} or ({tuple(words)} if words else set())


def brute_near(rows, least):
    """Least doc_id reachable over links at two bits and over texts alike by `least`, for rows (doc_id, text)."""
    prints, sets = [brute_print(t) for _, t in rows], [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if (prints[a] ^ prints[b]).bit_count() <= 2 or both and both / len(sets[a] | sets[b]) >= least:
                p, q = root(a), root(b)
                parent[max(p, q)] = min(p, q)
    found = {}
    for k, (d, _) in enumerate(rows):
        found.setdefault(root(k), []).append(d)
    return {d: min(ds) for ds in found.values() for d in ds}


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"edit{rng.randrange(10**6)}"
    return " ".join(out)


def test_near_copies_are_found_and_others_are_not(spark):
    rng = random.Random(11)
    vocabulary = [f"w{k}" for k in range(3000)]
    rows, pairs = [], []
    for k in range(300):
        words = rng.choices(vocabulary, k=rng.choice([30, 80, 300, 1500]))
        rows += [(2 * k, " ".join(words)), (2 * k + 1, edited(rng, words, max(1, len(words) // 80)))]
        a, b = shingles(rows[-1][1]), shingles(rows[-2][1])
        pairs.append(len(a & b) / len(a | b))
    got = {r.doc_id: r.component_id for r in simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    asked = [k for k, x in enumerate(pairs) if x >= 0.8]
    assert len(asked) > 150 and sum(got[2 * k + 1] == 2 * k for k in asked) / len(asked) >= 0.95
    assert all(c in (d, d - 1) for d, c in got.items()) and not [k for k, x in enumerate(pairs) if x < 0.6 and got[2 * k + 1] == 2 * k]


def test_a_large_group_of_near_copies(spark):
    rng = random.Random(12)
    words = [f"w{rng.randrange(900)}" for _ in range(200)]
    rows = [(k, edited(rng, words, 2)) for k in range(3000)] + [(10_000 + k, " ".join(rng.choices(words, k=200))) for k in range(300)]
    rows += [(20_000, None), (20_001, "  "), (20_002, "a b"), (20_003, "A\nb"), (None, "a b"), (None, "q r s t u v w")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    kept = sorted((r.doc_id for r in simhash.keep_first(df.selectExpr("*", "1 as mark", "2 as `x.y`", "3 as _id")).collect()), key=str)
    assert [d for d in kept if d is not None and d < 10_000] == [0] and sum(d is not None and 10_000 <= d < 20_000 for d in kept) == 300
    assert [d for d in kept if d is None or d >= 20_000] == [20_000, 20_002, None, None]
    assert simhash.keep_first(df.limit(0)).count() == 0


def test_large_buckets_are_split(spark):
    rng, base = random.Random(3), 0x0F0F33335555AAAA
    prints = {base ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(400)} | {rng.getrandbits(64) for _ in range(200)}
    signed = sorted(x - (1 << 64) if x >> 63 else x for x in prints)
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    plain, split = ({r.node: r.root for r in simhash.components(simhash.links(df, **how)).collect()} for how in ({}, {"most": 3, "shown": 1}))
    assert plain == split and len(set(plain.values())) < len(plain)


def test_all_candidates_of_a_key_are_compared(spark):
    """Alike texts far apart under a key, among many that are not alike: every tree is found, whatever the blocks."""
    rng = np.random.default_rng(5)
    sketches = rng.integers(1, 256, (120, simhash.BINS), dtype=np.uint8)
    for k in range(0, 100, 5):  # chains of alike texts over the whole key
        sketches[(k + 60) % 120] = sketches[k]
        sketches[(k + 60) % 120, :40] = rng.integers(1, 256, 40)
    want = {}
    close = [(x, y) for x in range(120) for y in range(x) if simhash.alike(sketches[x : x + 1], sketches[y : y + 1])[0] >= simhash.ALIKE]
    forest = simhash.Forest()
    for x, y in close:
        forest.join(x, y)
    want = {x: forest.root(x) for x in range(120)}
    rows = [(x, [77, 1000 + x % 9], sketches[x].tobytes()) for x in range(120)]
    nodes = spark.createDataFrame(rows, "mark long, bands array<long>, sketch binary")
    shared = simhash.shared_keys(nodes.select("mark", "bands"))
    none = spark.createDataFrame([], "node long, root long")
    some = spark.createDataFrame([(x, want[x]) for x in range(0, 120, 2)], "node long, root long")
    for block, roots in ((4096, none), (7, none), (50, some)):
        got = simhash.Forest()
        for r in roots.collect():
            got.join(r.node, r.root)
        for r in simhash.apart_links(nodes.select("mark", "sketch"), shared, roots, block).collect():
            assert (max(r.a, r.b), min(r.a, r.b)) in close
            got.join(r.a, r.b)
        assert {x: got.root(x) for x in range(120)} == want and len(set(want.values())) < 110


def test_recall_of_near_copies(spark):
    """Of the pairs of different texts on sf0.1 that are alike by 0.8 or more at least nine in ten are in one component."""
    rows = {}
    for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text").collect():
        rows.setdefault(" ".join((r.text or "").lower().split()), r.doc_id)
    sets = {d: shingles(t) for t, d in rows.items()}
    holders = {}
    for d, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(d)
    near = {(min(a, b), max(a, b)) for h in holders.values() if 1 < len(h) <= 300 for i, a in enumerate(h) for b in h[:i]}
    pairs = [(a, b) for a, b in near if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    docs = spark.createDataFrame([(d, t) for t, d in rows.items()], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.near_copies(docs).collect()}
    found = sum(got[a] == got[b] for a, b in pairs)
    print("pairs alike by 0.8", len(pairs), "linked", found)
    assert len(pairs) > 20 and found >= 0.9 * len(pairs)
