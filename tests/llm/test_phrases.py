"""Collocations against counting every n-gram."""

import random
import re
from collections import Counter

import pytest

from loomgraph.llm import phrases


def brute(rows, least, longest, top, shadow=50):
    n, f = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                f.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    candidates = {g: a for g, a in f.items() if len(g[1]) > 1 and a >= least}
    out = []
    for (lang, g), a in candidates.items():
        inside = lambda h: any(h[i : i + len(g)] == g for i in range(len(h) - len(g) + 1))  # noqa: E731, B023
        if any(x == lang and len(h) > len(g) and 100 * b >= shadow * a and inside(h) for (x, h), b in candidates.items()):
            continue
        cuts = [(1_000_000 * a * a // (f[lang, g[:k]] * f[lang, g[k:]]), k) for k in range(1, len(g))]
        score, k = min(cuts)
        out.append((lang, -score, -a, " ".join(g).encode(), f[lang, g[:k]], f[lang, g[k:]]))
    found = []
    for lang in n:
        for rank, (_, score, a, g, l, r) in enumerate(sorted(x for x in out if x[0] == lang)[:top], 1):
            found.append((lang, rank, g.decode(), -a, l, r, n[lang], -score))
    return sorted(found)


def corpus(seed, n=150):
    rng = random.Random(seed)
    words = ["Ab", "ab", "c", "É", "é", "d-d", " ", "x y", "%", "zz"]
    gaps = [" ", " ", " ", "  ", "\t", ". ", "\r\n", "\x0b", ";", " \x1f "]
    return [(rng.choice(["en", "de", None, ""]), rng.choice([None, "", "".join(rng.choice(words) + rng.choice(gaps) for _ in range(rng.randrange(60)))])) for _ in range(n)]


@pytest.mark.parametrize("bits", [64, phrases.LEAST_BITS])
@pytest.mark.parametrize("longest", [2, 3, 4])
def test_against_all_grams(spark, monkeypatch, bits, longest):
    # 64 bits say of nearly every phrase that it may be frequent; results stay exact
    monkeypatch.setattr(phrases, "LEAST_BITS", bits)
    monkeypatch.setattr(phrases, "MOST_BITS", bits)
    rows = corpus(longest)
    docs = spark.createDataFrame([(*r, 1, "f") for r in rows], "lang string, text string, f int, phrase string")
    got = sorted(map(tuple, phrases.collocations(docs, 10, longest, 30).collect()))
    assert got == brute(rows, 10, longest, 30) and got


def test_only_admitted_grams_are_emitted():
    text = b"a b c a b d a b"
    names, counts = phrases.summed([text], b"en", [])
    assert dict(zip(names.to_pylist(), counts.tolist(), strict=True)) == {b"": 8, b"a": 3, b"b": 3, b"c": 1, b"d": 1}
    bits = phrases.np.zeros(1 << 13, dtype=phrases.np.uint8)
    for h in phrases.hashes([b"a", b"b"], b"en").tolist():
        bits[(h & 0xFFFF) >> 3] |= 1 << (h & 7)
    assert phrases.summed([text], b"en", [bits])[0].to_pylist() == [b"a b"]


def test_long_texts_are_cut_at_marks(monkeypatch):
    monkeypatch.setattr(phrases, "GROUP_BYTES", 50)
    text = b"one two three, four five. " * 40 + b"no mark " * 40
    runs = list(phrases._runs(text))
    assert b"".join(runs) == text and len(runs) > 10 and all(phrases.MARK.match(r[-1:]) for r in runs[:-1])
    assert list(phrases._runs(b"")) == [b""]


def test_empty(spark):
    docs = spark.createDataFrame([], "lang string, text string")
    assert phrases.collocations(docs).collect() == []
    assert phrases.collocations(spark.createDataFrame([("en", None), (None, "a b")], "lang string, text string")).collect() == []
