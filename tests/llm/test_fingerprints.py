import re
from hashlib import sha256
from statistics import mean

from loomgraph.llm import fingerprints

SCHEMA = "doc_id long, text string"


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def brute(rows):
    rows = sorted(((d, t or "") for d, t in rows), key=lambda r: -r[0])
    for k, (d, t) in enumerate(rows):
        nxt = rows[(k + 1) % len(rows)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        yield d, (len(t), sha256(edited.encode()).hexdigest(), jaccard(t, edited), jaccard(t, nxt), t)


def check(got, rows, tolerance):
    want = dict(brute(rows))
    assert len(got) == len(want)
    by_text = {}
    for r in got:
        n, sha, near_edited, near_next, text = want[r.doc_id]
        assert (r.n_chars, r.edited_sha256) == (n, sha)
        assert abs(r.near_edited - near_edited) < 0.25 and abs(r.near_next - near_next) < 0.25, (r, near_edited, near_next)
        assert by_text.setdefault(text, r.fingerprint) == r.fingerprint
    assert mean(abs(r.near_edited - want[r.doc_id][2]) for r in got) < tolerance
    assert abs(mean(r.near_edited - want[r.doc_id][2] for r in got)) < tolerance / 2


def test_query(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    check(fingerprints.op4_fingerprints(spark, sf).collect(), rows, 0.05)


def test_edges(spark):
    rows = [(1, None), (2, ""), (9, "one two"), (-5, "é 🙂\x0bx y z w q"), (7, "w " * 30000), (8, "a b c d e f g h")]
    got = fingerprints.fingerprint_edits(spark.createDataFrame([(*r, 1, True) for r in rows], SCHEMA + ", next_text int, _ghost boolean")).collect()
    want = dict(brute(rows))
    assert {r.doc_id: (r.n_chars, r.edited_sha256) for r in got} == {d: w[:2] for d, w in want.items()}
    assert {r.doc_id: r.fingerprint for r in got}[1] == ""
    assert fingerprints.fingerprint_edits(spark.createDataFrame([], SCHEMA)).count() == 0
    one = fingerprints.fingerprint_edits(spark.createDataFrame([(4, "a b c d e f g h i j")], SCHEMA)).first()
    assert one.near_next == 1.0
    same = spark.createDataFrame([(4, "a b"), (4, "a b"), (4, "c"), (None, "d"), (None, None)], SCHEMA)
    assert fingerprints.fingerprint_edits(same).count() == 5


def test_next_over_many_buckets(spark):
    rows = [(d * d, f"t{d}") for d in range(200)]
    got = {r.doc_id: r.next_text for r in fingerprints.with_next(spark.createDataFrame(rows, SCHEMA), ["text"], buckets=50).collect()}
    assert got == {d * d: f"t{(d - 1) % 200}" for d in range(200)}
