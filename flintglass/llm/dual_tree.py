"""Ranked lexical search: the k documents of the highest score for each item, exactly, by dual-tree search.

A document's weight at a term lies between 0 and what its count and length give; an item's is the term's rarity or 0. A
tree over the items of a block and trees over runs of documents hold, in each node, the largest weight at each term below
it. The product of an item node and a document node bounds the score of every pair below both; where it stays under the
weakest k-th score among the node's items, all these pairs are left out at once, and where it does not, both nodes open.
Only documents of surviving leaves are scored, exactly and in integers.

Tasks search their documents by themselves and give at most k rows an item. They begin with the k-th scores within a
sample of documents, which are lower bounds of the final ones, and give only rows that reach them. Items are dealt into
blocks of bounded vocabulary, each of which reads the documents once.

Defined results: null text = no terms; a document for each row, also with null or repeated ids (null ids come last among
equal scores); an item for each row of the items, also with null or repeated ids; items without terms and empty tables
give no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.shared import fresh_folder
from .textops import alnum_words, cut, hash_below, slices

K = 10
#: Distinct terms of its items that a block has, about; documents of a tree and of one of its leaves; sampled documents.
BLOCK_TERMS, TREE, LEAF, SAMPLE = 200_000, 2_048, 32, 20_000
#: Rounds of the two means that divide a node.
ROUNDS = 3
_FOUND = "item int, doc_id long, score long"


def spans(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the half-open ranges one after the other, and where each range begins among them."""
    sizes = ends - starts
    first = np.cumsum(sizes) - sizes
    return np.arange(int(sizes.sum())) + np.repeat(starts - first, sizes), first


def divided(owner: np.ndarray, terms: np.ndarray, weight: np.ndarray, n: int) -> tuple[np.ndarray, int]:
    """n rows in an order whose first part (of the size given) is unlike its second: two means, begun with two unlike rows."""
    value = weight[terms].astype(float)
    value /= np.sqrt(np.bincount(owner, value * value, n)).clip(1e-9)[owner]

    def mean(picked: np.ndarray) -> np.ndarray:
        return np.bincount(terms[picked], value[picked], len(weight)) / max(1, len(np.unique(owner[picked])))

    def along(axis: np.ndarray) -> np.ndarray:
        return np.bincount(owner, value * axis[terms], n)

    one = mean(owner == along(mean(owner == 0)).argmin())
    axis = one - mean(owner == along(one).argmin())
    for _ in range(ROUNDS):
        side = (along(axis) > 0)[owner]
        axis = mean(side) - mean(~side)
    place = along(axis)
    return np.argsort(-place, kind="stable"), int(np.clip((place > 0).sum(), max(1, n // 8), n - max(1, n // 8)))


class Tree:
    """A binary tree over rows of sparse vectors; rows of a node are alike where possible. A node with more than `leaf`
    rows is divided so that no part has less than an eighth of them; its children are `kid` and `kid` + 1."""

    def __init__(self, starts: np.ndarray, terms: np.ndarray, values: np.ndarray, weight: np.ndarray, leaf: int):
        self.order = order = np.arange(len(starts) - 1)
        self.lo, self.hi, self.kid = [0], [len(order)], [-1]
        at = 0
        while at < len(self.lo):
            lo, hi = self.lo[at], self.hi[at]
            if hi - lo > leaf:
                rows = order[lo:hi]
                flat, _ = spans(starts[rows], starts[rows + 1])
                by, first = divided(np.repeat(np.arange(hi - lo), starts[rows + 1] - starts[rows]), terms[flat], weight, hi - lo)
                order[lo:hi], mid = rows[by], lo + first
                self.kid[at] = len(self.lo)
                self.lo += [lo, mid]
                self.hi += [mid, hi]
                self.kid += [-1, -1]
            at += 1
        self.boxes: list[tuple[np.ndarray, np.ndarray]] = [None] * len(self.lo)
        for at in range(len(self.lo) - 1, -1, -1):
            if self.kid[at] < 0:
                rows = order[self.lo[at] : self.hi[at]]
                flat, _ = spans(starts[rows], starts[rows + 1])
                self.boxes[at] = largest(terms[flat], values[flat])
            else:
                (a, x), (b, y) = self.boxes[self.kid[at]], self.boxes[self.kid[at] + 1]
                self.boxes[at] = largest(np.concatenate([a, b]), np.concatenate([x, y]))


def largest(terms: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each term once, with its largest value."""
    by = np.argsort(terms, kind="stable")
    terms, values = terms[by], values[by]
    first = np.flatnonzero(np.concatenate([[True], terms[1:] != terms[:-1]])) if len(terms) else np.zeros(0, np.int64)
    return terms[first], np.maximum.reduceat(values, first) if len(terms) else values


class Items:
    """The items of a block as a tree down to single items; `weight` by term."""

    def __init__(self, rows: list[np.ndarray], weight: np.ndarray):
        starts, terms = np.cumsum([0, *map(len, rows)]), np.concatenate(rows)
        tree = Tree(starts, terms, weight[terms], weight, 1)
        self.weight, self.order = weight, tree.order
        self.lo, self.hi, self.kid = (np.array(x) for x in (tree.lo, tree.hi, tree.kid))
        self.starts = np.cumsum([0, *(len(t) for t, _ in tree.boxes)])
        self.terms = np.concatenate([t for t, _ in tree.boxes])

    def opened(self, nodes: np.ndarray) -> np.ndarray:
        """Children of the nodes; single items stay."""
        kids = self.kid[nodes]
        return np.concatenate([nodes[kids < 0], kids[kids >= 0], kids[kids >= 0] + 1])


class Search:
    """The best k documents so far for each item of a block, in the order of the item tree."""

    def __init__(self, items: Items, floor: np.ndarray, k: int):
        self.items, self.k, self.scored = items, k, 0
        self.least = floor[items.order].astype(np.int64)
        self.best: list[list[tuple[int, bool, int]]] = [[] for _ in items.order]
        self.box, self.place = np.zeros(len(items.weight), np.int64), np.full(len(items.weight), -1)

    def surviving(self, nodes: np.ndarray) -> np.ndarray:
        """Nodes whose bound with the present box is above 0 and reaches the weakest k-th score among their items."""
        it = self.items
        flat, first = spans(it.starts[nodes], it.starts[nodes + 1])
        terms = it.terms[flat]
        bound = np.add.reduceat(it.weight[terms] * self.box[terms], first)
        ends = np.stack([it.lo[nodes], it.hi[nodes]], 1).ravel()
        weakest = np.minimum.reduceat(np.append(self.least, np.iinfo(np.int64).max), ends)[::2]
        return nodes[(bound > 0) & (bound >= weakest)]

    def add(self, ids: list[int | None], starts: np.ndarray, terms: np.ndarray, values: np.ndarray) -> None:
        """Searches documents, given as sparse vectors."""
        if not len(terms):
            return
        tree = Tree(starts, terms, values, self.items.weight, LEAF)
        waiting = [(0, np.zeros(1, np.int64))]
        while waiting:
            at, nodes = waiting.pop()
            where, most = tree.boxes[at]
            self.box[where] = most
            nodes = self.surviving(nodes)
            while tree.kid[at] < 0 and len(nodes) and (self.items.kid[nodes] >= 0).any():
                nodes = self.surviving(self.items.opened(nodes))
            self.box[where] = 0
            if not len(nodes):
                continue
            if tree.kid[at] < 0:
                self.score(ids, tree.order[tree.lo[at] : tree.hi[at]], nodes, where, starts, terms, values)
            else:
                below = self.items.opened(nodes)
                waiting += [(tree.kid[at] + 1, below), (tree.kid[at], below)]

    def score(self, ids, rows, nodes, where, starts, terms, values) -> None:
        it = self.items
        flat, _ = spans(starts[rows], starts[rows + 1])
        self.place[where] = np.arange(len(where))
        x = np.zeros((len(rows), len(where)), np.int64)
        x[np.repeat(np.arange(len(rows)), starts[rows + 1] - starts[rows]), self.place[terms[flat]]] = values[flat]
        of, _ = spans(it.starts[nodes], it.starts[nodes + 1])
        owner, column = np.repeat(np.arange(len(nodes)), it.starts[nodes + 1] - it.starts[nodes]), self.place[it.terms[of]]
        there = column >= 0  # every surviving item has such a term
        first = np.searchsorted(owner[there], np.arange(len(nodes)))
        scores = np.add.reduceat(x[:, column[there]] * it.weight[it.terms[of]][there], first, axis=1)
        self.place[where] = -1
        self.scored += scores.size
        items = it.lo[nodes]
        for r, c in zip(*(y.tolist() for y in np.nonzero((scores > 0) & (scores >= self.least[items]))), strict=True):
            doc_id, item = ids[rows[r]], int(items[c])
            best = self.best[item]
            best.append((-int(scores[r, c]), doc_id is None, doc_id or 0))
            if len(best) >= 4 * self.k:
                self.shorten(item)

    def shorten(self, item: int) -> None:
        best = self.best[item]
        best.sort()
        del best[self.k :]
        if len(best) == self.k:
            self.least[item] = max(self.least[item], -best[-1][0])

    def found(self) -> Iterator[tuple[int, int | None, int]]:
        """(item, doc_id, score), where items have their numbers of before."""
        for at, item in enumerate(self.items.order.tolist()):
            self.shorten(at)
            for score, null, doc_id in self.best[at]:
                yield item, None if null else doc_id, -score


def vectors(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, n_terms, and the terms of the vocabulary that each document holds, with their counts."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_terms", pa.int64()), ("terms", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sizes, terms, counts = [], [], []
            for text in batch.column(1).to_pylist():
                words = alnum_words(text)
                seen = Counter(map(vocabulary.get, words))
                seen.pop(None, None)
                sizes.append(len(words))
                terms.append(list(seen.keys()))
                counts.append(list(seen.values()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, f.type) for v, f in zip((sizes, terms, counts), list(schema)[1:], strict=True))], schema=schema)

    return docs.selectExpr("CAST(doc_id AS LONG) AS doc_id", "text").mapInArrow(run, "doc_id long, n_terms long, terms array<int>, counts array<int>")


def search(rows: DataFrame, items: Items, floor: np.ndarray, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """item, doc_id, score and rank of the best k documents of each item, of rows of vectors()."""
    schema = pa.schema([("item", pa.int32()), ("doc_id", pa.int64()), ("score", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = Search(items, floor, k)
        for batch in slices(batches, TREE):
            lists, counts = batch.column(2), batch.column(3).flatten().to_numpy().astype(np.int64)
            starts = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy().astype(np.int64))]).astype(np.int64)
            size = batch.column(1).to_numpy()
            m = np.repeat(100 - 90 + (90 * size * n_docs) // max(n_terms, 1), np.diff(starts))
            state.add(batch.column(0).to_pylist(), starts, lists.flatten().to_numpy().astype(np.int64), (1_000_000_000 * counts) // (1000 * counts + 8 * m))
        found = list(zip(*state.found(), strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(found, schema, strict=True)], schema=schema)

    best = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return rows.mapInArrow(run, _FOUND).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def item_terms(items: DataFrame) -> DataFrame:
    """item_id and the distinct terms of each item that has any."""
    schema = pa.schema([("item_id", pa.int64()), ("terms", pa.list_(pa.binary()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            terms = [sorted(set(alnum_words(t))) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(terms, schema.field(1).type)], schema=schema)

    return items.selectExpr("CAST(item_id AS LONG) AS item_id", "text").mapInArrow(run, "item_id long, terms array<binary>").filter(F.size("terms") > 0)


def rank_block(docs: DataFrame, items: list, k: int, sample: int) -> DataFrame:
    """item_id, rank, doc_id, score for the items (rows of item_terms) of one block."""
    spark = docs.sparkSession
    vocabulary = {bytes(t): i for i, t in enumerate(sorted({bytes(t) for r in items for t in r.terms}))}
    folder = fresh_folder(spark, "vectors")
    vectors(docs, vocabulary).write.parquet(folder)
    rows = spark.read.parquet(folder)
    n_rows, n_docs, n_terms = rows.agg(F.count("*"), F.count_if(F.col("n_terms") > 0), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    weight = np.zeros(len(vocabulary), np.int64)
    for term, df in rows.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # a row a term of the block
        weight[term] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
    tree = Items([np.array([vocabulary[bytes(t)] for t in r.terms], np.int64) for r in items], weight)
    held, floor = rows.filter(F.size("terms") > 0), np.zeros(len(items), np.int64)
    drawn = search(held.filter(hash_below("doc_id", sample, n_rows)), tree, floor, n_docs, n_terms, k)
    for r in drawn.filter(F.col("rank") == k).select("item", "score").collect():  # a row an item of the block
        floor[r.item] = r.score
    found = search(held, tree, floor, n_docs, n_terms, k)
    names = spark.createDataFrame([(i, r.item_id) for i, r in enumerate(items)], "item int, item_id long")
    return found.join(names, "item").select("item_id", "rank", "doc_id", "score")


def rank(docs: DataFrame, items: DataFrame, k: int = K, block_terms: int = BLOCK_TERMS, sample: int = SAMPLE) -> DataFrame:
    """item_id, rank (from 1), doc_id and score of the k best documents of each item with a score above 0."""
    terms = cut(item_terms(items).withColumn("row", F.monotonically_increasing_id()))
    total = terms.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()[0]
    blocks = -(-total // block_terms)
    found = None
    for b in range(blocks):
        rows = terms.filter(F.pmod(F.xxhash64("row"), F.lit(blocks)) == b).collect()  # about block_terms terms
        if rows:
            part = rank_block(docs, rows, k, sample)
            found = part if found is None else found.unionByName(part)
    return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long") if found is None else found


SQL = r"""
WITH t AS (SELECT u, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS term FROM (SELECT row_number() OVER () AS u, doc_id, text FROM documents) d),
 f AS (SELECT u, doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
 n AS (SELECT u, sum(tf) AS n FROM f GROUP BY u),
 s AS (SELECT count(*) AS big_n, sum(n) AS big_l FROM n),
 w AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(big_n) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM f CROSS JOIN s GROUP BY term),
 i AS (SELECT v, item_id, unnest(list_distinct(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'))) AS term FROM (SELECT row_number() OVER () AS v, item_id, text FROM benchmark) b),
 r AS (SELECT v, item_id, u, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * big_n) // big_l)))) AS BIGINT) AS score FROM i JOIN f USING (term) JOIN w USING (term) JOIN n USING (u) CROSS JOIN s GROUP BY v, item_id, u, doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY v ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM r WHERE score > 0) q WHERE rank <= 10
"""
