from hashlib import sha256

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomgraph.llm import bpe

tokenizers = pytest.importorskip("tokenizers")
PATH = bpe.default_vocabulary()
THEIRS = tokenizers.Tokenizer.from_file(PATH)
OURS, VOCABULARY = bpe._index_encoder(PATH)
CASES = ["", " ", "  ", "a", "aaaaaaa", "don't  stop\n\n now ", "\t x\n y  ", "a <|endoftext|> b", "x  <|endoftext|>  y", "<|endoftext|>", "12 345.6", "žluťoučký 漢字 🙂  　x", "a\x1cb \x85 c", "word " * 30000]


def ids(texts):
    import numpy as np

    return [np.frombuffer(x, dtype="<u4").tolist() for x in OURS.encode(texts)]


def test_cases_equal_the_library():
    assert ids(CASES) == [THEIRS.encode(t, add_special_tokens=False).ids for t in CASES]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from(" \n\t'ste.,1é"), st.characters(exclude_categories=["Cs", "Cn"]))), max_size=5))
def test_any_text_equals_the_library(texts):
    assert ids(texts) == [THEIRS.encode(t, add_special_tokens=False).ids for t in texts]


def test_query(spark, sf):
    rows = {r.doc_id: r for r in bpe.op1_bpe(spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        want = THEIRS.encode(r.text or "", add_special_tokens=False).ids
        got = rows[r.doc_id]
        assert got.n_tokens == len(want)
        assert got.ids_sha256 == sha256(",".join(map(str, want)).encode()).hexdigest()
        assert got.decoded_sha256 == sha256(THEIRS.decode(want, skip_special_tokens=False).encode()).hexdigest()


def test_rows_at_the_edge(spark):
    df = spark.createDataFrame([(1, None), (None, "x"), (2, ""), (2, "")], "doc_id long, text string")
    assert sorted((r.doc_id or -1, r.n_tokens) for r in bpe.digests(df, PATH).collect()) == [(-1, 1), (1, 0), (2, 0), (2, 0)]
    assert bpe.digests(df.limit(0), PATH).count() == 0
    clash = df.selectExpr("doc_id", "text", "1 as ids", "'q' as decoded", "'z' as extra")
    assert bpe.encode_column(clash, PATH).columns == ["doc_id", "extra", "ids", "decoded"]
    assert sorted(r.decoded for r in bpe.encode_column(clash, PATH).collect()) == ["", "", "", "x"]
