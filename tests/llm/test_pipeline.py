from pathlib import Path

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from loomgraph.llm import bpe  # noqa: E402

from .test_pii import brute as brute_pii  # noqa: E402
from .test_langid import kept_by_hand  # noqa: E402
from .test_mixing import copies_by_hand  # noqa: E402
from .test_simhash import brute_near  # noqa: E402

tokenizers = pytest.importorskip("tokenizers")


def test_each_stage_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, corpus_pipeline.common.settle(stage(spark, docs, sf), "t")
        seen[name] = ([r.asDict() for r in before.collect()], [r.asDict() for r in docs.collect()])
        assert name == "tokens" or docs.columns == columns
    before, after = seen["language"]
    assert sorted(r["doc_id"] for r in after) == kept_by_hand(spark, before) and len(after) > 0.95 * len(before)
    before, after = seen["near_duplicates"]
    rows, kept = [(r["doc_id"], r["text"]) for r in before], {r["doc_id"] for r in after}
    # texts that are surely alike are one, and one that goes has another that is at least nearly so
    sure, loose = brute_near(rows, 0.86), brute_near(rows, 0.7)
    assert {d for d, c in loose.items() if c == d} <= kept <= {d for d, c in sure.items() if c == d}
    before, after = seen["personal_data"]
    texts = {r["doc_id"]: r["text"] for r in after}
    assert len(texts) == len(before)
    for r in before:
        assert (texts[r["doc_id"]] == r["text"]) == (not brute_pii(r["text"])) and not [k for k in brute_pii(texts[r["doc_id"]]) if k[0] != "card"]
    before, after = seen["mixture"]
    assert sorted(r["doc_id"] for r in after) == copies_by_hand(spark, before)
    before, after = seen["tokens"]
    theirs = tokenizers.Tokenizer.from_file(bpe.default_vocabulary())
    want = {r["doc_id"]: theirs.encode(r["text"], add_special_tokens=False).ids for r in before}
    assert len(before) == len(after) and all(r["ids"] == want[r["doc_id"]] for r in after)


def test_stages_at_the_edge(spark, sf):
    """Nulls, ties, repeated rows and clashing names in, the same columns out; empty tables give empty ones."""
    rows = [(k % 7, t, lang, s, 1, 2, "x", 3.0, 4, 5) for k, (t, lang, s) in enumerate([("the house and the cat by the sea", "en", "a"), ("le chat et la souris du jardin", "fr", None), (None, "en", "b"), ("", None, None), ("12 !", "en", "a"), ("write to me@host.org now", None, "a")] * 3)]
    rows.append((None, None, None, None, None, None, None, None, None, None))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, _id int, `a.b` int, row string, score double, ids int, mark int")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, df, sf)
        # the last stage gives ids in place of texts, and of columns of those names
        want = df.columns if name != "tokens" else [c for c in df.columns if c not in ("text", "ids")] + ["ids", "decoded"]
        assert out.columns == want, name
        got = out.collect()
        assert name in ("language", "near_duplicates", "mixture") or len(got) == len(rows), name
        assert stage(spark, df.limit(0), sf).count() == 0


def test_run(spark, sf):
    at = Path(corpus_pipeline.common.shared_dir(spark).removeprefix("file:").replace("//", "/"))
    before = {p.name for p in at.iterdir()}
    assert set(corpus_pipeline.run(spark, sf).columns) >= {"doc_id", "lang", "source", "n_chars", "ids", "decoded"}
    left = {p.name for p in at.iterdir()} - before
    assert len(left) == 1 and left.pop().startswith("tokens-")  # the result alone stays


def test_no_folder_of_one_machine_on_a_cluster(spark, monkeypatch):
    from loomgraph.llm import common
    from loomgraph.sources import tables

    class Context:
        master = "spark://host:7077"

        class _jsc:
            sc = staticmethod(lambda: type("S", (), {"getCheckpointDir": lambda self: type("O", (), {"isDefined": lambda self: False})()})())

    fake = type("F", (), {"sparkContext": Context, "conf": type("C", (), {"get": staticmethod(lambda *_: None)})})
    for shared in (common.shared_dir, tables.shared_folder):
        with pytest.raises(RuntimeError, match="checkpoint"):
            shared(fake)
