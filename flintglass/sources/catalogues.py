"""Landed catalogue files: build properties, base references, manifests, policy lists, tag pages, package lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import version_line


def landed_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of text files."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def build_properties(files: DataFrame) -> DataFrame:
    """(path, props): `key=value` lines split at the first `=`, the last line of a key; lines that start with # are comments."""
    lines = files.select("path", F.posexplode(F.split("content", r"\r?\n")).alias("pos", "line")).withColumn("line", F.trim("line"))
    pairs = lines.filter("line LIKE '%=%' AND line NOT LIKE '#%'").select("path", "pos", F.trim(F.substring_index("line", "=", 1)).alias("k"), F.trim(F.expr("substring(line, instr(line, '=') + 1)")).alias("v"))
    last = pairs.groupBy("path", "k").agg(F.max_by("v", "pos").alias("v"))
    return last.groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("props"))


def image_bases(files: DataFrame) -> DataFrame:
    """One row for each FROM reference of a build file."""
    return files.select("path", "content", F.explode(F.regexp_extract_all("content", F.lit(r"(?m)^FROM (\S+)"), F.lit(1))).alias("ref"))


def python_requirements(files: DataFrame) -> DataFrame:
    """The interpreter version of Pipfile and pyproject manifests."""
    return files.select("path", F.regexp_extract(version_line(F.col("content"), F.col("path")), '"([^"]*)"', 1).alias("version"))


def ordered_list(files: DataFrame, field: str, element: str) -> DataFrame:
    """A JSON list under `field` of each file, with the place of each entry as `ord`; element: fields as `name: type`."""
    rows = files.select("path", F.from_json("content", f"{field} array<struct<{element}>>")[field].alias("list"))
    return rows.select("path", F.posexplode("list").alias("ord", "e")).select("path", "ord", "e.*")


def registry_tags(pages: DataFrame) -> DataFrame:
    """Tags of landed registry pages (image, page, body: JSON with `results`, or a plain list of names), in order of page and place."""
    body = F.col("body")
    full = F.from_json(body, "results array<struct<name: string, last_updated: timestamp>>")["results"]
    plain = F.transform(F.from_json(body, "array<string>"), lambda n: F.struct(n.alias("name"), F.lit(None).cast("timestamp").alias("last_updated")))
    listed = F.when(F.startswith(F.ltrim(body), F.lit("[")), plain).otherwise(full)
    return pages.select("image", "page", F.posexplode(listed).alias("pos", "t")).select("image", (F.col("page") * 1_000_000 + F.col("pos")).alias("ord"), "t.name", "t.last_updated")


def package_inventory(rows: DataFrame, text: str) -> DataFrame:
    """Packages of a JSON column that holds a list or one object."""
    kind = "struct<name:string,version:string>"
    trimmed = F.trim(F.col(text))
    listed = F.when(F.startswith(trimmed, F.lit("[")), trimmed).otherwise(F.concat(F.lit("["), trimmed, F.lit("]")))
    return rows.select(*[c for c in rows.columns if c != text], F.inline(F.from_json(listed, f"array<{kind}>")))
