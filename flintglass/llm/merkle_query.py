"""The registered fixity query: the pages table against a replica that Spark derives from the same rows.

The given tables hold no second replica, so the damage is simulated by rules over the urls; the audit knows nothing of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .merkle_fixity import audit


def damaged_replica(pages: DataFrame) -> DataFrame:
    """A replica that lost the records of mobile hosts, holds altered bytes where the url carries a referrer and has
    the records of anchored urls once more under a new offset."""
    kept = pages.filter(~F.coalesce(F.contains("url", F.lit("//m.")), F.lit(False)))
    altered = kept.withColumn("html", F.when(F.contains("url", F.lit("ref=x")), F.concat("html", F.lit("\n"))).otherwise(F.col("html")))
    again = pages.filter(F.contains("url", F.lit("#top"))).withColumn("page_id", -F.col("page_id") - 1)
    return altered.union(again)


def query(pages: DataFrame) -> DataFrame:
    pages = pages.select("page_id", "url", "html")
    return audit(pages, damaged_replica(pages), "page_id", ["url", "html"]).withColumnRenamed("off", "page_id")


SQL = """
SELECT page_id, CAST(floor(page_id / 64) AS BIGINT) AS leaf, 'missing' AS fault FROM pages WHERE url LIKE '%//m.%'
UNION ALL
SELECT page_id, CAST(floor(page_id / 64) AS BIGINT), 'altered' FROM pages WHERE url LIKE '%ref=x%' AND url NOT LIKE '%//m.%' AND html IS NOT NULL
UNION ALL
SELECT -page_id - 1, CAST(floor((-page_id - 1) / 64) AS BIGINT), 'extra' FROM pages WHERE url LIKE '%#top%'
"""
