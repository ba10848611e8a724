"""Running aggregates over groups of any size, made in segments that many tasks share."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: How a running value is made inside a segment, and how it joins what came before; every one has nulls ignored.
_KINDS = {
    "sum": (F.sum, lambda a, b: a + b), "xor": (F.bit_xor, lambda a, b: a.bitwiseXOR(b)),
    "max": (F.max, F.greatest), "min": (F.min, F.least),
}


def same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    """Equal keys, null with null."""
    return reduce(and_, (left[k].eqNullSafe(right[k]) for k in keys))


def running(df: DataFrame, keys: list[str], segment: str, order: list, values: dict[str, tuple]) -> DataFrame:
    """Adds the running aggregate of each value: {name: ("sum" | "xor" | "max" | "min", column)} up to and with the row, or
    up to the row before with a third element "before". Null where no value came yet.

    `segment` numbers bounded runs of a group's rows in the order of `order`. A task holds one segment; what the earlier
    segments of the group amount to is a row a segment and is joined to their rows, so that a group with a large part of
    all rows is worked on by as many tasks as it has segments."""
    within = Window.partitionBy(*keys, segment).orderBy(*order)
    value = {n: F.col(v[1]) if isinstance(v[1], str) else v[1] for n, v in values.items()}
    made, joint = ({n: _KINDS[v[0]][i] for n, v in values.items()} for i in (0, 1))
    last = {n: -1 if v[2:] == ("before",) else Window.currentRow for n, v in values.items()}
    totals = df.groupBy(*keys, segment).agg(*(made[n](value[n]).alias("_t_" + n) for n in values))
    earlier = Window.partitionBy(*keys).orderBy(segment).rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(*keys, segment, *(made[n]("_t_" + n).over(earlier).alias("_b_" + n) for n in values))
    before = before.filter(reduce(or_, (F.col("_b_" + n).isNotNull() for n in values)))
    rows = df.withColumns({n: made[n](value[n]).over(within.rowsBetween(Window.unboundedPreceding, last[n])) for n in values})
    joined = rows.join(before, same(rows, before, [*keys, segment]), "left")
    both = {n: F.when(before["_b_" + n].isNull(), rows[n]).when(rows[n].isNull(), before["_b_" + n]).otherwise(joint[n](before["_b_" + n], rows[n])) for n in values}
    return joined.select(*(rows[c] for c in df.columns if c not in values), *(c.alias(n) for n, c in both.items()))


def numbered(df: DataFrame, keys: list[str], order: list[Column], name: str) -> DataFrame:
    """Adds each row's place (from 0) in its group, for groups of any size.

    The rows are dealt by ranges of keys and order and written; a group that spans several ranges gets the counts of the
    earlier ones added. At most one group a range began before it, which bounds what is broadcast."""
    from .shared import cut

    part, first = "_range_" + name, "_first_" + name
    dealt = cut(df.repartitionByRange(*(F.col(k) for k in keys), *order).withColumn(part, F.spark_partition_id()))
    counts = dealt.groupBy(*keys, part).agg(F.count("*").alias("_n"))
    before = counts.withColumn(first, F.sum("_n").over(Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1))).filter(F.col(first).isNotNull()).drop("_n")
    placed = dealt.withColumn(name, F.row_number().over(Window.partitionBy(*keys, part).orderBy(*order)).cast("long") - 1)
    joined = placed.join(F.broadcast(before), same(placed, before, [*keys, part]), "left")
    return joined.select(*(placed[c] for c in df.columns), (placed[name] + F.coalesce(before[first], F.lit(0).cast("long"))).alias(name))
