import math
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np

from loomgraph.llm import langid


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    got = langid.op6_language_id(spark, sf).collect()
    assert len(got) == len(truth) and all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.97


def test_prediction_depends_on_the_text_alone(spark):
    texts = ["the cat and the dog", "le chat et la souris", "x", "", "12 !!", None, "été", "\U00010400"]
    names, *rest = langid.train(["the cat and dog of the house"] * 6 + ["le chat et la souris du jardin"] * 6, ["en"] * 6 + ["fr"] * 6, (langid.np.arange(12) % 5 == 0))
    model = (names, *rest)
    together, score = langid.predict(texts, model)
    assert together[:2] == ["en", "fr"] and together[3:6] == ["und"] * 3 and together[7] != "und" and score[3] == 0
    for t, want, s in zip(texts, together, score, strict=True):
        alone, p = langid.predict([t], model)
        assert alone == [want] and abs(p[0] - s) < 1e-6


def test_edges(spark):
    df = spark.createDataFrame([(1, "abc", None), (None, None, "en"), (2, "", "en"), (3, "y " * 80000, None)], "doc_id long, text string, lang string")
    assert langid.fit(df) is None or langid.fit(df)[0]
    assert {r.lang_pred for r in langid.identify(df, None).collect()} == {"und"}
    assert langid.identify(df.limit(0), None).count() == 0
    clash = df.selectExpr("*", "0.5 as score", "'q' as lang_pred")
    assert langid.accepted(clash).columns == clash.columns


def test_every_labelled_language_is_learnt(spark):
    langs = [f"l{k:02}" for k in range(70)]
    rows = [(100 * k + i, f"{chr(0x4E00 + k) * 3} " * (i % 5 + 2), lang) for k, lang in enumerate(langs) for i in range(12 if k < 64 else 10)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df)
    assert model[0] == langs
    assert langid.predict([chr(0x4E00 + k) * 3 for k in range(70)], model)[0] == langs
    few = langid.fit(df, most_rows=350)  # about five rows each
    assert len(few[0]) > 64


def test_unlabelled_documents_with_letters_are_accepted(spark):
    df = spark.createDataFrame([(1, "abc", None), (2, "été", "und"), (3, "12 !", None), (4, None, None), (None, "x", None)], "doc_id long, text string, lang string")
    assert sorted(r.text for r in langid.accepted(df).collect()) == ["abc", "x", "été"]


def test_long_and_repeated_texts_are_learnt_from(spark):
    long = [(k, f"{a} " * 60_000, lang) for k, (a, lang) in enumerate([("the house of cats", "en"), ("le chat du jardin", "fr")] * 4)]
    again = [(77, "le chien", "fr")] * 3000
    df = spark.createDataFrame(long + again, "doc_id long, text string, lang string")
    model = langid.fit(df)
    assert model[0] == ["en", "fr"] and langid.predict(["the cats", "du jardin"], model)[0] == ["en", "fr"]


def test_training_against_a_plain_version():
    rng = np.random.default_rng(5)
    words = {"en": "the house of cats and dogs".split(), "fr": "le chat du jardin et la souris".split(), "de": "der hund und die katze".split()}
    langs = [str(x) for x in rng.choice(sorted(words), 40)]
    texts = [" ".join(rng.choice(words[x], 7)) for x in langs]
    fold = np.arange(40) % 5 == 0
    names, weights, bias, temperature = langid.train(texts, langs, fold)
    # the same in plain Python: one dictionary of weights, one text and one label at a time
    grams = []
    for t in texts:
        s, starts = langid.symbols([t])
        grams.append(Counter(int(b) for k in langid.ORDERS for b in langid.buckets(s, starts, k)))
    size = [len(t) + 3 for t in texts]
    df = Counter(g for c in grams for g in c)
    idf = lambda g: math.log(41 / (1 + df[g])) + 1
    z, n = defaultdict(float), defaultdict(float)

    def weight(key):
        if abs(z[key]) <= langid.L1:
            return 0.0
        return -(z[key] - math.copysign(langid.L1, z[key])) / ((langid.BETA + math.sqrt(n[key])) / langid.ALPHA + langid.L2)

    def features(i):
        return {g: langid.SCALE * (c / size[i]) * idf(g) for g, c in grams[i].items()} | {"bias": 1.0}

    def logits(i):
        return [sum(x * weight((g, lang)) for g, x in features(i).items()) for lang in names]

    def softmax(v):
        e = [math.exp(x - max(v)) for x in v]
        return [x / sum(e) for x in e]

    order = np.random.default_rng(langid.SEED)
    for _ in range(langid.EPOCHS):
        for i in order.permutation(np.flatnonzero(~fold)):
            p, f = softmax(logits(i)), features(i)
            for k, lang in enumerate(names):
                for g, x in f.items():
                    d, key = x * (p[k] - (lang == langs[i])), (g, lang)
                    w = weight(key)
                    z[key] += d - (math.sqrt(n[key] + d * d) - math.sqrt(n[key])) / langid.ALPHA * w
                    n[key] += d * d
    for k, lang in enumerate(names):
        assert abs(bias[k] - weight(("bias", lang))) < 1e-3
        for g in df:
            assert abs(weights[g, k] - langid.SCALE * idf(g) * weight((g, lang))) < 1e-2
    kept = np.flatnonzero(fold)
    loss = lambda t: -sum(math.log(softmax([x / t for x in logits(i)])[names.index(langs[i])] + 1e-12) for i in kept)
    assert loss(temperature) <= min(loss(temperature * s) for s in (0.7, 0.9, 1.1, 1.4)) + 1e-3
    model = (names, weights, bias, temperature)
    got, score = langid.predict(texts, model)
    for i, (g, x) in enumerate(zip(got, score, strict=True)):
        p = softmax([v / temperature for v in logits(i)])
        assert g == names[int(np.argmax(p))] and abs(max(p) - x) < 1e-3


def test_scores_are_calibrated(spark):
    """Over held-out rows the mean score comes near the share that is right, as close as without the temperature or closer."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text", "lang")
    model = langid.fit(docs)
    held = [r for r in docs.collect() if crc32(str(r.doc_id).encode()) % 5 == 0 and r.lang is not None and r.text]

    def loss(model):
        names, weights, bias, temperature = model
        total = 0.0
        for k in range(0, len(held), 500):
            part = held[k : k + 500]
            got, score = langid.predict([r.text for r in part], model)
            total -= sum(math.log(max(1e-6, s if g == r.lang else 1 - s)) for g, s, r in zip(got, score, part, strict=True))
        return total / len(held)

    assert loss(model) <= loss((*model[:3], 1.0)) + 1e-3
    got, score = langid.predict([r.text for r in held], model)
    right = np.mean([g == r.lang for g, r in zip(got, held, strict=True)])
    assert right > 0.97 and abs(score.mean() - right) < 0.05


def kept_by_hand(spark, rows, least=0.5):
    """doc_ids that the pipeline's stage keeps of rows (dicts): a letter, and a language of at least that score by the plain formula."""
    docs = spark.createDataFrame([(r["doc_id"], r["text"], r["lang"]) for r in rows], "doc_id long, text string, lang string")
    names, weights, bias, temperature = langid.fit(docs)
    kept = []
    for r in rows:
        text = r["text"] or ""
        s, starts = langid.symbols([text])
        z = [float(b) for b in bias]
        for order in langid.ORDERS:
            for g in langid.buckets(s, starts, order).tolist():
                z = [a + float(x) / (len(text) + 3) for a, x in zip(z, weights[g], strict=True)]
        e = [math.exp((x - max(z)) / temperature) for x in z]
        if any(c.isalpha() for c in text) and max(e) / sum(e) >= least:
            kept.append(r["doc_id"])
    return sorted(kept)
