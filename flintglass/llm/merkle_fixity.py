"""Merkle fixity audit of two replicas of a record table.

Every record gets a digest. The records of one offset fold into one digest by sums over their digests (a multiset
hash that tasks combine before the shuffle, so that an offset with a third of all rows is no hot group), ordered ranges
of `leaf` offsets form leaves, and `fanout` neighbouring nodes form a node of the next level up to one root. The audit
compares the roots, descends only into branches that differ, and compares records only under mismatching leaves. Both
replicas go through the same steps as one table with a side; every level and every list of suspects is written to the
checkpoint folder, so that the plan of a step does not grow with the height of the tree.

The sums find accidental damage; they are no protection against records forged to give equal sums.

Defined results: a null payload has a digest of its own (differs from the empty one); records with a null offset belong
to one range of their own (leaf null); repeated offsets are compared as multisets, so that a second copy counts as
extra; an empty replica makes all records of the other missing or extra; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textops import cut

LEAF, FANOUT = 64, 16
#: Hex digits of one summand, four summands a digest; sums of longs as decimals hold for 10^19 records of one offset.
LANE = 15


def floor_div(name: str, size: int) -> Column:
    """Exact floor of a column of longs divided by `size`."""
    return F.expr(f"`{name}` div {size} - CASE WHEN `{name}` % {size} < 0 THEN 1 ELSE 0 END")


def record_digests(records: DataFrame, offset: str, payload: list[str]) -> DataFrame:
    """(off, digest): SHA-256 of the payload columns of each record."""
    parts = [F.coalesce(F.concat(F.lit("v"), F.length(c).cast("string"), F.lit(":"), F.col(c)), F.lit("n")) for c in payload]
    return records.select(F.col(offset).cast("long").alias("off"), F.sha2(F.concat(*parts), 256).alias("digest"))


def offset_digests(digests: DataFrame) -> DataFrame:
    """(side, off, digest): number and sums of the record digests of an offset, hashed."""
    lanes = [F.conv(F.substring("digest", 1 + i * LANE, LANE), 16, 10).cast("decimal(19,0)") for i in range(4)]
    sums = [F.sum(x).cast("string") for x in lanes]
    return digests.groupBy("side", "off").agg(F.sha2(F.concat_ws(",", F.count("*").cast("string"), *sums), 256).alias("digest"))


def _digest_of(key: str) -> Column:
    """Digest of a node from its children's (key, digest) in order of the key; a node has `leaf` or `fanout` at most."""
    parts = F.array_sort(F.collect_list(F.struct(key, "digest")))
    return F.sha2(F.array_join(F.transform(parts, lambda x: F.concat_ws("=", x[key].cast("string"), x["digest"])), ","), 256)


def tree_levels(digests: DataFrame, leaf: int, fanout: int, low: int, height: int) -> list[DataFrame]:
    """Levels 0 (leaves) to `height` (root) of both sides as (side, node, digest); leaves count from `low`."""
    leaves = offset_digests(digests).groupBy("side", (floor_div("off", leaf) - low).alias("node")).agg(_digest_of("off").alias("digest"))
    levels = [cut(leaves)]
    for _ in range(height):
        level = levels[-1].groupBy("side", floor_div("node", fanout).alias("up")).agg(_digest_of("node").alias("digest"))
        levels.append(cut(level.withColumnRenamed("up", "node")))
    return levels


def _differing(level: DataFrame) -> DataFrame:
    """Nodes (as `top`) that one side lacks or whose digests differ."""
    side = lambda s: F.max(F.when(F.col("side") == s, F.col("digest")))
    both = level.groupBy(F.col("node").alias("top")).agg(side(0).alias("a"), side(1).alias("b"))
    return both.filter(~F.col("a").eqNullSafe(F.col("b"))).select("top")


def audit(a: DataFrame, b: DataFrame, offset: str, payload: list[str], leaf: int = LEAF, fanout: int = FANOUT) -> DataFrame:
    """(off, leaf, fault): fault is altered, missing (only in a) or extra (only in b)."""
    sides = [record_digests(x, offset, payload).withColumn("side", F.lit(i)) for i, x in enumerate((a, b))]
    digests = cut(sides[0].union(sides[1]))
    ends = digests.agg(F.min("off").alias("low"), F.max("off").alias("high")).select(floor_div("low", leaf), floor_div("high", leaf)).first()
    low, width, height = ends[0] or 0, (ends[1] or 0) - (ends[0] or 0), 0
    while width:
        width, height = width // fanout, height + 1
    levels = tree_levels(digests, leaf, fanout, low, height)
    suspects = cut(_differing(levels.pop()))
    while levels:
        suspects = cut(_differing(levels.pop().join(suspects, floor_div("node", fanout).eqNullSafe(F.col("top")), "left_semi")))

    under = digests.join(suspects, (floor_div("off", leaf) - low).eqNullSafe(F.col("top")), "left_semi")
    number = lambda s: F.count_if(F.col("side") == s)
    records = under.groupBy("off", "digest").agg((number(0) - number(1)).alias("more")).filter("more <> 0")
    faults = records.groupBy("off").agg(F.bool_or(F.col("more") > 0).alias("lost"), F.bool_or(F.col("more") < 0).alias("found"))
    fault = F.when(~F.col("found"), "missing").when(~F.col("lost"), "extra").otherwise("altered")
    return faults.select("off", floor_div("off", leaf).alias("leaf"), fault.alias("fault"))
