"""Address ranges: nested ones flattened to disjoint intervals by a sweep, and lookups by order.

An address is a key: `4` and 8 hexadecimal digits, or `6` and 32, so that text order is address order and the families
stay apart. A boundary is a key and a mark: `0` where a range begins, `9` behind its last address; points have `5`."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.segments import running
from ..plans.shared import cut

#: First characters of a key that name the run of addresses that one task looks up, by family: 2^16 addresses, a /40.
RUN = {"4": 5, "6": 11}
OPENS, POINT, ENDS = "0", "5", "9"


def number_key(ip: Column) -> Column:
    """The key of an IPv4 address given as a number; null outside of the family."""
    return F.when(ip.between(0, 2**32 - 1), F.concat(F.lit("4"), F.lower(F.lpad(F.hex(ip.cast("long")), 8, "0"))))


def address_key(ip: Column) -> Column:
    """The key of an IPv4 or IPv6 address in text; null for anything else."""
    text = F.lower(F.trim(ip))
    parts = F.split(text, r"\.")
    plain = text.rlike(r"^\d{1,3}(\.\d{1,3}){3}$")
    number = F.aggregate(parts, F.lit(0).cast("long"), lambda a, p: a * 256 + p.try_cast("long"))
    four = F.when(plain & F.forall(parts, lambda p: p.try_cast("int") <= 255), number_key(number))
    groups = lambda side: F.filter(F.split(side, ":"), lambda g: g != "")
    cut_short = F.contains(text, F.lit("::"))
    left, right = groups(F.substring_index(text, "::", 1)), groups(F.when(cut_short, F.substring_index(text, "::", -1)).otherwise(""))
    missing = F.greatest(F.lit(0), 8 - F.size(left) - F.size(right))
    full = F.when(cut_short, F.concat(left, F.array_repeat(F.lit("0"), missing), right)).otherwise(left)
    good = text.rlike(r"^[0-9a-f]{0,4}(:[0-9a-f]{0,4}){2,8}$|^::$") & ~text.rlike(r":::|::.*::|^:[^:]|[^:]:$") & (F.size(full) == 8) & (~cut_short | (missing > 0))
    return F.when(plain, four).when(good, F.concat(F.lit("6"), F.array_join(F.transform(full, lambda g: F.lpad(g, 4, "0")), "")))


def block_range(block: Column) -> Column:
    """Struct of first, last (keys) and prefix_len of a block in text, such as 10.0.0.0/8 or 2001:db8::/32; without a length
    it is one address. Null where it is no block."""
    text = F.trim(block)
    key = address_key(F.substring_index(text, "/", 1))
    most = F.when(F.startswith(key, F.lit("4")), 32).otherwise(128)
    bits = F.when(F.contains(text, F.lit("/")), F.substring_index(text, "/", -1).try_cast("int")).otherwise(most)
    whole, left = F.floor(bits / 4).cast("int"), F.pmod(bits, F.lit(4))
    step = F.pow(F.lit(2), 4 - left).cast("int")  # values that the digit cut by the prefix may take
    digit = F.conv(F.substr(key, whole + 2, F.lit(1)), 16, 10).cast("int")
    low = (F.floor(digit / step) * step).cast("int")
    cut_digit = lambda d: F.when(left > 0, F.lower(F.hex(d))).otherwise("")
    rest = (most / 4).cast("int") - whole - F.when(left > 0, 1).otherwise(0)
    side = lambda fill, d: F.concat(F.substr(key, F.lit(1), whole + 1), cut_digit(d), F.repeat(F.lit(fill), rest))
    return F.when(key.isNotNull() & bits.between(0, most), F.struct(side("0", low).alias("first"), side("f", low + step - 1).alias("last"), bits.alias("prefix_len")))


def _sweep(ranges: pd.DataFrame, low: str | None, high: str | None) -> Iterator[tuple[str, int]]:
    """(key, row of the narrowest range that holds what follows, or -1) at each boundary from `low` on and below `high`."""
    bounds = sorted([(f + OPENS, i) for i, f in enumerate(ranges["first"])] + [(e + ENDS, i) for i, e in enumerate(ranges["last"])])
    rank = list(zip((-ranges["_length"]).tolist(), ranges["first"].tolist(), ranges["_row"].tolist(), strict=True))
    ended, open_ranges, now, at = set(), [], -1, 0
    while at < len(bounds):
        key = bounds[at][0]
        while at < len(bounds) and bounds[at][0] == key:
            i = bounds[at][1]
            if key.endswith(OPENS):
                heapq.heappush(open_ranges, (rank[i], i))
            else:
                ended.add(i)
            at += 1
        while open_ranges and open_ranges[0][1] in ended:
            heapq.heappop(open_ranges)
        best = open_ranges[0][1] if open_ranges else -1
        if best != now and (low is None or key >= low) and (high is None or key < high):
            yield key, best
        now = best


def flattened(ranges: DataFrame, keep: list[str]) -> DataFrame:
    """Disjoint intervals of ranges (first, last: keys; prefix_len): a row (key, held, ..keep) at each place from which
    another range is the narrowest one that holds the addresses. Ranges of equal length give way to the one that begins
    first; `held` is false, and `keep` null, where none holds them.

    The ranges are dealt by where they begin. A part is swept by one task, together with the few earlier ranges that
    reach into it: as ranges are nested, no more than there are lengths. Ranges with a null or wrong end are left out."""
    good = ranges.filter("first <= last AND left(first, 1) = left(last, 1)").select("first", "last", F.coalesce("prefix_len", F.lit(0)).alias("_length"), *keep)
    dealt = cut(good.repartitionByRange("first").withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id()))
    starts = [(r["_part"], r["low"] + OPENS) for r in dealt.groupBy("_part").agg(F.min("first").alias("low")).orderBy("low").collect()]  # a row a part
    reach = F.array(*(F.struct(F.lit(p).alias("part"), F.lit(low).alias("low")) for p, low in starts)) if starts else F.array().cast("array<struct<part:int,low:string>>")
    mine = F.concat(F.col("first"), F.lit(OPENS))
    into = F.filter(reach, lambda s: (s["part"] == F.col("_part")) | ((s["low"] > mine) & (s["low"] <= F.concat(F.col("last"), F.lit(ENDS)))))
    spread = dealt.withColumn("_to", F.explode(F.transform(into, lambda s: s["part"])))
    begins = dict(starts)
    ends = {p: nxt[1] for (p, _), nxt in zip(starts, starts[1:], strict=False)}
    schema = T.StructType([T.StructField("key", T.StringType()), T.StructField("held", T.BooleanType()), *(T.StructField(f.name, f.dataType) for f in good.select(*keep).schema)])

    def run(part: pd.DataFrame) -> pd.DataFrame:
        to = int(part["_to"].iloc[0])
        part = part.sort_values("_row").reset_index(drop=True)
        first = starts[0][0] == to
        found = list(_sweep(part, None if first else begins[to], ends.get(to)))
        rows = part[keep].reindex([i for _, i in found]).reset_index(drop=True)
        rows.insert(0, "key", [k for k, _ in found])
        rows.insert(1, "held", [i >= 0 for _, i in found])
        return rows

    return spread.groupBy("_to").applyInPandas(run, schema)


def looked_up(points: DataFrame, key: Column, intervals: DataFrame, keep: list[str]) -> DataFrame:
    """The points with the `keep` columns of the interval (of flattened()) that holds the address with the key; null where
    none does. The last interval that begins at or before a point is found over runs of addresses, which many tasks share;
    each address is looked up once."""
    rows = points.withColumn("_key", key)
    value, none = F.struct("key", "held", *keep), intervals.select(F.struct("key", "held", *keep).alias("v")).schema[0].dataType
    asked = rows.select("_key").filter("_key IS NOT NULL").distinct()
    both = asked.select(F.concat("_key", F.lit(POINT)).alias("at"), "_key", F.lit(None).cast(none).alias("_value"))
    both = both.unionByName(intervals.select(F.col("key").alias("at"), F.lit(None).cast("string").alias("_key"), value.alias("_value")))
    both = both.withColumn("_family", F.substring("at", 1, 1)).withColumn("_run", F.substring("at", 1, F.when(F.col("_family") == "4", RUN["4"]).otherwise(RUN["6"])))
    found = running(both, ["_family"], "_run", ["at"], {"_last": ("max", "_value")})
    hits = found.filter("_key IS NOT NULL AND _last.held").select("_key", *(F.col(f"_last.{k}").alias(k) for k in keep))
    return rows.join(hits, "_key", "left").select(*points.columns, *keep)


def block_owners(points: DataFrame, ip: str, blocks: DataFrame) -> DataFrame:
    """block, asn and owner of the narrowest block (block in text, asn, owner) that holds each address in text; empty text
    where none does, and where a block has no asn or owner."""
    ranges = blocks.select(block_range(F.col("block")).alias("r"), "block", "asn", "owner").select("r.*", "block", "asn", "owner")
    found = looked_up(points, address_key(F.col(ip)), flattened(ranges, ["block", "asn", "owner"]), ["block", "asn", "owner"])
    return found.select(*points.columns, *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("block", "asn", "owner")))
