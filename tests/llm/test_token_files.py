import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomgraph.llm import bpe, common, token_files

tokenizers = pytest.importorskip("tokenizers")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=700))
def test_blocks_round_trip(ids):
    got = token_files.unpack(*token_files.pack(np.array(ids, dtype=np.uint32)))
    assert got.tolist() == ids


def brute(rows):
    theirs = tokenizers.Tokenizer.from_file(bpe.default_vocabulary())
    start, out = 0, []
    for doc, text in sorted(rows, key=lambda r: r[0]):
        ids = [*theirs.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((doc, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    return out


def test_any_text_equals_the_library():
    rng, library = random.Random(5), token_files.Library(bpe.default_vocabulary(), kept=300)
    parts = list(" \n\t'ste.,1é 漢🙂　 \x85\x1c\x0b!-ABß") + [" "] * 8 + ["\n"] * 2 + ["'s", "'ll", "<|endoftext|>", "word", "the"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 40))) for _ in range(6000)]
    for k in range(0, len(texts), 997):
        ids, sizes = library.encode(pa.array(texts[k : k + 997]), 2)
        ends = np.cumsum(sizes)
        for t, n, end in zip(texts[k : k + 997], sizes.tolist(), ends.tolist(), strict=True):
            assert ids[end - n : end].tolist() == [*library.tokenizer.encode(t, add_special_tokens=False).ids, 2], t


def test_other_kinds_of_vocabulary_are_refused():
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    for read in (token_files.Library, bpe.Vocabulary):
        with pytest.raises(ValueError, match="normalizer"):
            read(path)


def test_query(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted(map(tuple, token_files.op2_token_files(spark, sf).select("doc_id", "start", "n_tokens", "ids_crc32").collect()))
    assert got == brute(rows)


def test_edges(spark):
    rows = [(3, None), (1, ""), (2, "word " * 40000), (4, "x <|endoftext|> y"), (5, "  \n ")]
    out = common.scratch(spark, "t")
    token_files.write_files(spark.createDataFrame(rows, "doc_id long, text string"), bpe.default_vocabulary(), out, shards=3)
    assert sorted(map(tuple, token_files.read_files(spark, out).collect())) == brute(rows)
    out = common.scratch(spark, "t")
    token_files.write_files(spark.createDataFrame([], "doc_id long, text string, shard int"), bpe.default_vocabulary(), out)
    assert token_files.read_files(spark, out).count() == 0
    out = common.scratch(spark, "t")
    token_files.write_files(spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "a")], "doc_id long, text string"), bpe.default_vocabulary(), out)
    assert sorted((r.doc_id or 0, r.start, r.n_tokens) for r in token_files.read_files(spark, out).collect()) == [(0, 0, 2), (1, 2, 3), (1, 5, 3)]
