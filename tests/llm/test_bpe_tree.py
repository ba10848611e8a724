"""The segment tree encoder against the tokenizers library, and its exact round trip."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import types as T

from flintglass.llm import bpe_tree
from flintglass.llm.registry import QUERIES, byte_tokenizer

SF = "/root/testdata/sf0.001"
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("ids", T.StringType()), T.StructField("n_tokens", T.StringType())])
TEXTS = [None, "", " ", "  \n\t x", "it's we'll 'tis", "<|endoftext|>", "a<|endoftext|> b<|endoftext|><|endoftext|>", "x" * 40_000, "ab" * 30_000 + " " * 999, "日本語 テキスト \U0001f600 é̂ ٣²½", "\x1c a\x85\xa0b\x1f", "Zażółć ÿ×÷ª", "hugging hugging hugging", "<|endoftext", "é" * 33 + "1234567890" * 5]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(byte_tokenizer())
    model.no_truncation(), model.no_padding()
    return model


def digests(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_query_equals_the_library(spark, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    found = QUERIES["op11_segment_bpe"](spark, SF).collect()
    assert len(found) == len(texts)
    for r in found:
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == digests(library, texts[r.doc_id])


def test_odd_texts_rows_and_columns(spark, library):
    rows = [(k % 5 or None, t, "x", "y") for k, t in enumerate(TEXTS)] * 2
    docs = spark.createDataFrame(rows, SCHEMA)
    encoded = bpe_tree.encode(docs, byte_tokenizer())
    want = sorted(repr((i, library.encode(t or "", add_special_tokens=False).ids)) for i, t, *_ in rows)
    assert sorted(repr((r.doc_id, np.frombuffer(r.ids, "<u4").tolist())) for r in encoded.collect()) == want
    assert sorted(repr(tuple(r)) for r in bpe_tree.decode(encoded, byte_tokenizer()).collect()) == sorted(repr((i, t or "")) for i, t, *_ in rows)
    assert bpe_tree.encode(spark.createDataFrame([], SCHEMA), byte_tokenizer(), decoded=True).count() == 0


def test_trees_alone_and_in_arrays_are_leftmost_lowest_rank():
    bpe, rng = bpe_tree.ByteBpe(byte_tokenizer()), random.Random(5)
    words = ["".join(rng.choice("aaabinther ing") for _ in range(rng.randrange(1, 33))).encode() for _ in range(400)]

    def plain(data):
        ids = [bpe.byte_ids[b] for b in data]
        while True:
            ranks = [(bpe.rank[p], i) for i, p in enumerate(a << 32 | b for a, b in zip(ids, ids[1:], strict=False)) if p in bpe.rank]
            if not ranks:
                return ids
            r, i = min(ranks)
            ids[i : i + 2] = [bpe.made[r]]

    want = [plain(w) for w in words]
    assert [bpe.merged(w) for w in words] == want
    assert [np.frombuffer(x, "<u4").tolist() for x in bpe.merged_together(words, 32)] == want


def test_the_store_is_emptied_and_ids_stay_right(monkeypatch, library):
    monkeypatch.setattr(bpe_tree, "STORE", 500)
    bpe = bpe_tree.ByteBpe(byte_tokenizer())
    for k in range(30):
        text = f"word{k} other{k * 7} the end"
        assert np.frombuffer(bpe.encode([text])[0], "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
        assert bpe.stored < 1_500
