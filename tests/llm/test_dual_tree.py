"""The dual-tree search against scores of all pairs."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import types as T

from flintglass.llm import dual_tree
from flintglass.llm.registry import QUERIES

SF = "/root/testdata/sf0.001"
DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("rank", T.StringType()), T.StructField("n_terms", T.StringType())])
ITEMS = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("score", T.StringType())])
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return [t.translate(UPPER) for t in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]


def brute(docs, items, k=10):
    counts = [(i, Counter(terms(t))) for i, t in docs]
    n = [sum(c.values()) for _, c in counts]
    big_n, big_l = sum(x > 0 for x in n), sum(n)
    df = Counter(t for _, c in counts for t in c)
    w = {t: math.floor(1000 * math.log((2 * big_n + 2) / (2 * d + 1))) for t, d in df.items()}
    out = []
    for item_id, text in items:
        found = []
        for (doc_id, c), size in zip(counts, n, strict=True):
            m = 100 - 90 + 90 * size * big_n // big_l if big_l else 0
            score = sum(w[t] * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if t in c)
            if score > 0:
                found.append((-score, doc_id is None, doc_id or 0))
        out += [(item_id, r + 1, None if null else d, -s) for r, (s, null, d) in enumerate(sorted(found)[:k])]
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def test_query(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    assert got(QUERIES["op13_dual_tree_search"](spark, SF)) == brute(docs, items)


@pytest.fixture(scope="module")
def made():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)] + ["É", "é", "Straße", "日本", "x1", "THE"]
    docs = [(rng.choice([None, 5, 6, *range(100, 400)]), " ".join(rng.choices(words[: rng.randrange(3, 66)], k=rng.randrange(0, 40)))) for _ in range(300)]
    docs += [(7, "the same text here"), (7, "the same text here"), (2, "THE SAME text, here!"), (1, None), (3, ""), (4, "..."), (8, "rare " + "w1 " * 20_000)]
    items = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 12)))) for i in range(40)]
    items += [(40, None), (41, "-"), (None, "same text"), (42, "the same"), (42, "the same"), (43, "unknown words only"), (44, "rare " * 30), (45, "é"), (46, "É É")]
    return docs, items


@pytest.mark.parametrize("block,sample,leaf", [(200_000, 20_000, 32), (25, 20, 2), (60, 1, 1)])
def test_made_rows(spark, made, monkeypatch, block, sample, leaf):
    monkeypatch.setattr(dual_tree, "LEAF", leaf)
    docs, items = made
    found = dual_tree.rank(spark.createDataFrame([(*d, "x", "y") for d in docs], DOCS), spark.createDataFrame([(*i, "x") for i in items], ITEMS), block_terms=block, sample=sample)
    assert got(found) == brute(docs, items)


def test_empty_tables(spark, made):
    docs, items = made
    no_docs, no_items = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    assert got(dual_tree.rank(no_docs, spark.createDataFrame([(*i, "x") for i in items], ITEMS))) == []
    assert got(dual_tree.rank(spark.createDataFrame([(*d, "x", "y") for d in docs], DOCS), no_items)) == []


def test_batches_are_left_out():
    """Topics of their own: most pairs are never scored, and the best stay."""
    rng = np.random.default_rng(1)
    topic = lambda n: [np.sort(rng.choice(50, 8, replace=False) + 50 * (i % 20)) for i in range(n)]
    rows, items, weight = topic(2_000), topic(100), np.full(1_000, 7)
    state = dual_tree.Search(dual_tree.Items(items, weight), np.zeros(100, np.int64), 3)
    state.add(list(range(2_000)), np.cumsum([0, *map(len, rows)]), np.concatenate(rows), np.ones(16_000, np.int64))
    scores = np.array([[7 * len(np.intersect1d(a, b)) for b in rows] for a in items])
    assert state.scored < 0.1 * scores.size
    want = [(i, d, int(scores[i, d])) for i in range(100) for d in np.lexsort((np.arange(2_000), -scores[i]))[:3].tolist() if scores[i, d]]
    assert sorted(state.found()) == sorted(want)
