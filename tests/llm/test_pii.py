import random
import re
import time
from collections import Counter
from hashlib import sha256
from math import log

from hypothesis import given, settings
from hypothesis import strategies as st

from loomgraph.llm import pii

#: As the contract writes them.
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(sum(divmod(2 * int(c), 10)) if k % 2 else int(c) for k, c in enumerate(reversed(digits))) % 10 == 0


def fine(kind, m):
    d = re.sub("[^0-9]", "", m)
    return {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m.split(".")), "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]


def brute(text):
    return [(k, m.start(), m.end()) for k, p in PLAIN.items() for m in re.finditer(p, text or "") if fine(k, m.group())]


def row(doc, text):
    found = brute(text)
    return doc, *[sum(k == x for x, _, _ in found) for k in PLAIN], sha256(",".join(f"{k}:{a}:{b}" for k, a, b in found).encode()).hexdigest()


CASES = [
    None, "", "a@b.c%d@e.f", "x@y x@y.z, 1.2.3.4.5.6.7.8 0000255.1.1.1 256.1.1.1", "é4111 1111 1111 1111 ü 4111-1111-1111-1112", "+1 (743) 555-3824 +12 +1-2-3-4-5-6-7-8-9 + 1",
    "0" * 30000, "5 " * 30000, "a" * 50000, "+1" + " " * 30000, "me.@x--.y-.z me@host.com " * 1500, "4111111111111111.1.2.3@a.b", "🙂 me@x.org 🙂 10.0.0.1",
]


def test_cases_and_edges(spark):
    rows = list(enumerate(CASES)) + [(3, CASES[3]), (None, "q@r.s")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as row", "2 as base")
    got = sorted((tuple(r)[:6] for r in pii.digest(df).collect()), key=str)
    assert got == sorted((row(*r) for r in rows), key=str)
    assert pii.digest(df.limit(0)).count() == 0
    clean = {r.doc_id: r for r in pii.sanitise(df).collect()}
    assert clean[0].text is None and clean[1].text == "" and clean[2].text == "[EMAIL][EMAIL]" and clean[12].text == "🙂 [EMAIL] 🙂 [IP]"
    assert pii.sanitise(df).columns == df.columns


@settings(max_examples=12, deadline=None)
@given(st.lists(st.text("a1.@+-% (,é4", max_size=40), min_size=200, max_size=400))
def test_random_texts(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(tuple(r)[:6] for r in pii.digest(df).collect()) == [row(d, t) for d, t in enumerate(texts)]


def test_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(tuple(r)[:6] for r in pii.op7_pii(spark, sf).collect()) == sorted(row(*r) for r in rows)


def test_disclosing_terms(spark):
    rows = [(d, f"Write to Jane Quillfeather at jq@mail.org about item {d} of the list") for d in range(10)]
    rows += [(d, f"the list of item {d} and the rest of the words about to write at") for d in range(100, 400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.spans.split(",") for r in pii.digest(df).collect()}
    for d in range(10):
        assert got[d] == ["email:30:41", "removed:9:13", "removed:14:26"]
    assert all(got[d] == [""] for d in range(100, 400))
    clean = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    assert clean[3] == "Write to   at [EMAIL] about item 3 of the list" and clean[200] == dict(rows)[200]


def test_rare_entities_and_far_terms(spark):
    far = "the list of the rest and the words about to write " * 4
    rows = [(0, f"Quillfeather has {far} one@mail.org"), (1, f"+1 (743) 555-3824 {far} Marmaduke"), (2, f"MARMADUKE {far} +1 (743) 555-3824"), (3, f"10.0.0.1 and {far} Commonly")]
    rows += [(d, f"commonly has {far}" if d % 2 else far) for d in range(100, 400)]
    got = {r.doc_id: r.spans.split(",") for r in pii.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    ends = {d: len(t) for d, t in rows}
    assert got[0] == [f"email:{ends[0] - 12}:{ends[0]}", "generalised:0:12"]  # one document
    assert got[1] == ["phone:0:17", f"generalised:{ends[1] - 9}:{ends[1]}"]  # two documents
    assert got[2] == [f"phone:{ends[2] - 17}:{ends[2]}", "generalised:0:9"]
    assert got[3] == ["ip:0:8"] and all(got[d] == [""] for d in range(100, 400))


def brute_words(text):
    found = brute(text)
    return {text[a:b].lower() for _, a, b in found}, {w.lower() for w in re.findall(r"[^\W_][\w'-]*", "".join(" " if any(a <= i < b for _, a, b in found) else c for i, c in enumerate(text)))}


def brute_told(rows):
    docs = list(map(brute_words, rows))
    n, told = len(rows), []
    ce, ct, both = Counter(e for es, _ in docs for e in es), Counter(w for _, ws in docs for w in ws), Counter((e, w) for es, ws in docs for e in es for w in ws)
    for es, ws in docs:
        score = {w: max((1 + log((both[e, w] + 0.5 * ce[e] / n) / (ct[w] + 0.5)) / log(n / ce[e]) for e in es if ce[e] < n), default=0) for w in ws}
        told.append({w: "removed" if x >= 0.98 else "generalised" for w, x in score.items() if x >= 0.9})
    return told


def test_disclosing_against_brute_force(spark):
    rng = random.Random(3)
    rows = [" ".join(rng.choices([f"w{rng.randrange(rng.choice([9, 99, 999]))}x" for _ in range(6)] + [f"u{rng.randrange(rng.choice([3, 40]))}@h.org"] * (k % 3), k=9)) for k in range(300)]
    rows += ["ada lovelace z1@h.org z2@h.org"] * 40
    rows += [f"{'long' * 700}{k} one {'x' * 70} q{k}@h.org" for k in range(3)]
    got = {r.doc_id: r.spans for r in pii.digest(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    for d, want in enumerate(brute_told(rows)):
        seen = {rows[d][int(a) : int(b)].lower(): k for k, a, b in (x.split(":") for x in got[d].split(",") if x) if k in pii.TERM_KINDS}
        assert seen == want
    assert brute_told(rows)[339] == {"ada": "removed", "lovelace": "removed"}


def test_short_terms_are_terms(spark):
    rows = [(d, f"李明 wrote to zz about x at jq@mail.org and the list {d}") for d in range(10)] + [(d, f"the list and what one wrote to all about x at item {d}") for d in range(100, 400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.spans.split(",") for r in pii.digest(df).collect()}
    assert all(got[d][1:] == ["removed:0:2", "removed:12:14"] for d in range(10)) and got[200] == [""]
    assert {r.doc_id: r.text for r in pii.sanitise(df).collect()}[3] == " wrote to  about x at [EMAIL] and the list 3"


def test_overlaps_across_parts(spark):
    rng = random.Random(6)
    rows = ["".join(rng.choice(["é", "word ", "a@b.cd ", "+1 (743) 555-3824 ", "4111 1111 1111 1111.1.2.3@a.b ", "10.0.0.1", "🙂", "x" * 990]) for _ in range(rng.randrange(1, 400))) for _ in range(30)]
    got = {r.doc_id: r.text for r in pii.sanitise(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    spans = {r.doc_id: r.spans for r in pii.digest(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    for d, text in enumerate(rows):
        out, upto = "", 0
        for a, b, kind in sorted(((int(a), -int(b), k) for k, a, b in (x.split(":") for x in spans[d].split(",") if x))):
            if a >= upto:
                out, upto = out + text[upto:a] + pii.LABELS[kind], -b
            upto = max(upto, -b)
        assert got[d] == out + text[upto:]


def test_many_spans_in_one_text(spark):
    """The work on a text grows about as its length does: four times the spans take no sixteen times as long."""
    took = {}
    for n in (10_000, 40_000):
        text = " ".join(f"n{k}@h{k % 7}.org and w{k % 11}" for k in range(n))
        df = spark.createDataFrame([(1, text), (2, "and more words")], "doc_id long, text string")
        start = time.perf_counter()
        got = {r.doc_id: r for r in pii.digest(df).collect()}
        clean = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
        took[n] = time.perf_counter() - start
        assert got[1].n_email == n and clean[1].count("[EMAIL]") == n and "@" not in clean[1]
    assert took[40_000] < 10 * took[10_000] and took[40_000] < 120, took
