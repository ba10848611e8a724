"""Prefix trie of rebuilt conversations by whole-sequence collapse.

Identical rebuilt conversations are grouped into one weighted sequence with its smallest member; sequences that are
proper prefixes of others are found by a join against all proper prefixes, the others are the leaves. Only one copy of
each sequence is then expanded into its prefixes, whose weights are aggregated into nodes. A prefix is known by its
depth and 128 bits, the exclusive or of hashes of (place, turn) over its turns, which segments of a long conversation can
compute side by side.

Each node belongs to the smallest leaf sequence below it, its owner. The nodes of an owner are the deepest ones of its
path, so that the sum over a node's subtree is the sum of the totals of all leaf sequences through it less what its owner
owns above it; no step walks the trie level by level.

Defined results: null role or text = empty; turns of equal number stand in order of role, then of the text's SHA-256;
repeated rows are turns of their own; rows with a null conv_id belong to no conversation; an empty table gives no nodes;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.segments import numbered, running
from .textops import cut

#: Each hundred conversations share the opening of the first of them, of fewer than HEADS turns.
SHARED, HEADS = 100, 6
#: Turns of a conversation that one task holds; member ids joined into one row.
SEGMENT, CHUNK = 65_536, 8_192
_NODE = ["p1", "p2", "depth"]
_NONE = hashlib.sha256(b"").hexdigest()


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, idx (from 0), turn_hash and n_chars of each turn."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    said = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"),
        F.unhex(F.sha2(text, 256)).alias("text_hash"), F.length(text).cast("long").alias("n_chars"),
    )
    placed = numbered(said, ["conv_id"], [F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("text_hash").asc()], "idx")
    return placed.select("conv_id", "idx", F.unhex(F.sha2(F.concat("text_hash", F.encode("role", "UTF-8")), 256)).alias("turn_hash"), "n_chars")


def rebuilt(said: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rebuilt conversations: (conv_id, n_turns), and their turns (conv_id, pos, turn_hash, n_chars, n_turns)."""
    base, h = F.col("conv_id") - F.col("conv_id") % SHARED, F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS
    convs = said.groupBy("conv_id").agg(F.count("*").alias("own")).withColumns({"base": base, "h": h})
    heads = said.filter((F.col("idx") < HEADS - 1) & (F.col("conv_id") % SHARED == 0)).withColumnRenamed("conv_id", "base")
    sizes = heads.groupBy("base").agg(F.count("*").alias("there"))
    convs = convs.join(sizes, "base", "left").withColumn("lent", F.least("h", F.coalesce("there", F.lit(0).cast("long"))))
    convs = cut(convs.withColumn("n_turns", F.col("lent") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).drop("own", "there"))
    lent = convs.select("conv_id", "base", "h", "n_turns").join(heads, "base").filter("idx < h").select("conv_id", F.col("idx").alias("pos"), "turn_hash", "n_chars", "n_turns")
    kept = said.join(convs, "conv_id").filter("idx >= h").select("conv_id", (F.col("idx") - F.col("h") + F.col("lent")).alias("pos"), "turn_hash", "n_chars", "n_turns")
    return convs.select("conv_id", "n_turns"), lent.unionByName(kept)


def prefixes(rows: DataFrame) -> DataFrame:
    """Each turn with the prefix that ends with it (p1, p2, depth) and the one before (q1, q2)."""
    hashed = rows.select("conv_id", "pos", "n_chars", "n_turns", F.xxhash64("turn_hash", "pos").alias("x1"), F.xxhash64("pos", "turn_hash").alias("x2"), F.floor(F.col("pos") / SEGMENT).alias("segment"))
    both = running(hashed, ["conv_id"], "segment", ["pos"], {"p1": ("xor", "x1"), "p2": ("xor", "x2")})
    return both.select("conv_id", (F.col("pos") + 1).alias("depth"), "p1", "p2", F.col("p1").bitwiseXOR(F.col("x1")).alias("q1"), F.col("p2").bitwiseXOR(F.col("x2")).alias("q2"), "n_chars", "n_turns")


def end_digests(ends: DataFrame) -> DataFrame:
    """SHA-256 of each sequence's sorted member ids, comma-joined.

    Ids are dealt by ranges of sequence and id, so that a sequence with many members is sorted and joined into chunks by
    many tasks; one task then reads a sequence's chunks in order, a chunk at a time."""
    chunked = pa.schema([("p1", pa.int64()), ("p2", pa.int64()), ("depth", pa.int64()), ("first", pa.int64()), ("ids", pa.string())])
    digest = pa.schema([("p1", pa.int64()), ("p2", pa.int64()), ("depth", pa.int64()), ("ends_sha256", pa.string())])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids = None, []
        for batch in batches:
            rows = []
            for *node, conv_id in zip(*(batch.column(c).to_pylist() for c in ("p1", "p2", "depth", "conv_id")), strict=True):
                if ids and (node != key or len(ids) == CHUNK):
                    rows.append((*key, ids[0], ",".join(map(str, ids))))
                    ids = []
                key = node
                ids.append(conv_id)
            yield pa.RecordBatch.from_pylist([dict(zip(chunked.names, r, strict=True)) for r in rows], schema=chunked)
        if ids:
            yield pa.RecordBatch.from_pylist([dict(zip(chunked.names, (*key, ids[0], ",".join(map(str, ids))), strict=True))], schema=chunked)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            rows = []
            for *node, ids in zip(*(batch.column(c).to_pylist() for c in ("p1", "p2", "depth", "ids")), strict=True):
                if node != key:
                    if state:
                        rows.append((*key, state.hexdigest()))
                    key, state = node, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield pa.RecordBatch.from_pylist([dict(zip(digest.names, r, strict=True)) for r in rows], schema=digest)
        if state:
            yield pa.RecordBatch.from_pylist([dict(zip(digest.names, (*key, state.hexdigest()), strict=True))], schema=digest)

    dealt = ends.select(*_NODE, "conv_id").repartitionByRange(*_NODE, "conv_id").sortWithinPartitions(*_NODE, "conv_id")
    chunks = dealt.mapInArrow(join, "p1 long, p2 long, depth long, first long, ids string")
    return chunks.repartition(*_NODE).sortWithinPartitions(*_NODE, "first").mapInArrow(finish, "p1 long, p2 long, depth long, ends_sha256 string")


def trie(conversations: DataFrame) -> DataFrame:
    """One row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    convs, rows = rebuilt(turns(conversations))
    steps = cut(prefixes(rows))
    zero = F.lit(0).cast("long")
    turnless = convs.filter("n_turns = 0").select(zero.alias("p1"), zero.alias("p2"), zero.alias("depth"), "conv_id")
    ends = steps.filter("depth = n_turns").select(*_NODE, "conv_id").unionByName(turnless)
    sequences = cut(ends.groupBy(*_NODE).agg(F.count("*").alias("w"), F.min("conv_id").alias("conv_id")))
    opened = convs.filter("n_turns > 0").select(zero.alias("p1"), zero.alias("p2"), zero.alias("depth"))
    proper = steps.filter("depth < n_turns").select(*_NODE).unionByName(opened).distinct()
    leaf = sequences.join(proper, _NODE, "left_anti").withColumn("leaf", F.lit(True))
    inner = sequences.join(proper, _NODE, "left_semi").withColumn("leaf", F.lit(False))
    weighted = cut(leaf.unionByName(inner).select("conv_id", "w", "leaf"))
    paths = steps.select("conv_id", *_NODE, "q1", "q2", "n_chars").join(weighted, "conv_id")
    nothing = F.lit(None).cast("long")
    paths = cut(paths.unionByName(weighted.withColumns({"p1": zero, "p2": zero, "depth": zero, "q1": nothing, "q2": nothing, "n_chars": zero})))
    nodes = paths.groupBy(*_NODE).agg(
        F.sum("w").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.count_if("leaf").alias("n_leaves"),
        F.min(F.when(F.col("leaf"), F.col("conv_id"))).alias("owner"), F.max("n_chars").alias("n_chars"), F.max("q1").alias("q1"), F.max("q2").alias("q2"),
    )
    nodes = cut(nodes.withColumns({"saved": (F.col("n_convs") - 1) * F.col("n_chars"), "segment": F.floor(F.col("depth") / SEGMENT)}).drop("n_chars"))
    totals = nodes.groupBy(F.col("owner").alias("conv_id")).agg(F.sum("saved").alias("total"))
    through = paths.filter("leaf").select("conv_id", *_NODE).join(totals, "conv_id").groupBy(*_NODE).agg(F.sum("total").alias("through"))
    owned = running(nodes, ["owner"], "segment", ["depth"], {"so_far": ("sum", "saved")})
    children = nodes.filter("depth > 0").groupBy(F.col("q1").alias("p1"), F.col("q2").alias("p2"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    parents = nodes.select(F.col("p1").alias("q1"), F.col("p2").alias("q2"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("parent_conv_id"))
    found = owned.join(through, _NODE).join(children, _NODE, "left").join(end_digests(ends), _NODE, "left").join(parents, ["q1", "q2", "depth"], "left")
    return found.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", zero).alias("n_children"), "n_leaves",
        (F.col("through") - F.col("so_far") + F.col("saved")).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(_NONE)).alias("ends_sha256"),
    )


#: crc32 of decimal text by its bits, prefixes as lists of turns; for DuckDB.
SQL = """
WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(coalesce(text, ''))) - 1 AS i FROM conversations WHERE conv_id IS NOT NULL),
 b AS (SELECT unnest(range(256)) AS k),
 tab AS (SELECT list(list_reduce(list_prepend(k, [CAST(0 AS BIGINT)] || range(7)), lambda a, s: CASE WHEN a % 2 = 1 THEN xor(CAST(3988292384 AS BIGINT), a // 2) ELSE a // 2 END) ORDER BY k) AS f FROM b),
 c AS (SELECT c, own, c - c % 100 AS base, xor(CAST(4294967295 AS BIGINT), list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(c AS VARCHAR), ''), lambda z: CAST(ascii(z) AS BIGINT))), lambda a, z: xor(f[1 + xor(a, z) % 256], a // 256))) % 6 AS h FROM (SELECT c, count(*) AS own FROM t GROUP BY c) g CROSS JOIN tab),
 s AS (SELECT c.c, coalesce(list_slice(coalesce(o.l, []), 1, h), []) || coalesce(list_slice(w.l, h + 1, own), []) AS l
  FROM c LEFT JOIN (SELECT c, list({'r': r, 'x': x} ORDER BY i) AS l FROM t GROUP BY c) o ON o.c = c.base JOIN (SELECT c, list({'r': r, 'x': x} ORDER BY i) AS l FROM t GROUP BY c) w ON w.c = c.c),
 p AS (SELECT c, l, d, list_slice(l, 1, d) AS q FROM (SELECT c, l, unnest(range(len(l) + 1)) AS d FROM s)),
 n AS (SELECT q, d, min(c) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (len(l) = d), '')) AS ends_sha256, (count(*) - 1) * (CASE WHEN d = 0 THEN 0 ELSE length(q[d].x) END) AS own FROM p GROUP BY q, d),
 k AS (SELECT list_slice(q, 1, d - 1) AS q, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1),
 a AS (SELECT n.q, n.d, n.own, coalesce(n_children, 0) AS kids, unnest(range(n.d + 1)) AS e FROM n LEFT JOIN k ON k.q = n.q AND len(k.q) = n.d),
 u AS (SELECT list_slice(q, 1, e) AS q, sum(own) AS saved, count(*) FILTER (kids = 0) AS n_leaves FROM a GROUP BY 1)
SELECT n.conv_id, n.d AS depth, m.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children, u.n_leaves, CAST(u.saved AS BIGINT) AS saved_tokens, n.ends_sha256
 FROM n JOIN u ON u.q = n.q LEFT JOIN k ON k.q = n.q LEFT JOIN n m ON n.d > 0 AND m.d = n.d - 1 AND m.q = list_slice(n.q, 1, n.d - 1)
"""
