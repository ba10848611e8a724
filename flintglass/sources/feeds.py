"""Indicator feeds: unique by construction, written as CSV without a header."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def indicators(rows: DataFrame, key: str, ts: str) -> DataFrame:
    """(value, kind, day): one MD5, IPv4, Domain and URL indicator for each key; the address spells the key in mixed bases."""
    k = F.col(key)
    md5 = F.md5(F.concat(F.lit("ind"), k.cast("string")))
    parts = (k % 223 + 1, F.floor(k / 223) % 256, F.floor(k / 57088) % 256, F.floor(k / 14614528))
    ip = F.concat_ws(".", *(p.cast("string") for p in parts))
    host = F.concat(F.lit("host"), k.cast("string"), F.lit(".example.com"))
    url = F.concat(F.lit("http://"), host, F.lit("/"), (k % 97).cast("string"))
    every = F.array(*(F.struct(v.alias("value"), F.lit(n).alias("kind")) for n, v in (("MD5", md5), ("IP", ip), ("Domain", host), ("URL", url))))
    return rows.select(F.explode(every).alias("i"), F.col(ts).cast("date").alias("day")).select("i.value", "i.kind", "day")


def write_csv(feed: DataFrame, path: str) -> None:
    """CSV without a header, quoted only where needed."""
    feed.write.csv(path, header=False, quote='"', escape='"')


def write_entries(entries: DataFrame, path: str, name: str) -> None:
    """A list as JSON lines, sorted by name."""
    entries.orderBy(name).write.json(path)


def write_files(files: DataFrame, path: str) -> None:
    """Found files as Parquet, a folder for each category and day of their first packet (null: none known), sorted by
    addresses inside; the rows of a folder are dealt by ranges of addresses, so that a large one has several writers."""
    dated = files.withColumn("day", F.to_date(F.timestamp_micros("first_us")))
    order = ["category", "day", "ip_src", "ip_dst"]
    dated.repartitionByRange(*order).sortWithinPartitions(*order).write.partitionBy("category", "day").parquet(path)
