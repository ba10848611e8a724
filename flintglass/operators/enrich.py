"""Enrichment and compliance: range joins of addresses, host names, licence matching."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_public
from .intervals import flattened, looked_up, number_key


def range_join(points: DataFrame, ranges: DataFrame, ip: str) -> DataFrame:
    """Left join of `ip` with (first_ip, last_ip, prefix_len, ...): the narrowest range that holds it, then the one that
    begins first."""
    names = [c for c in ranges.columns if c not in ("first_ip", "last_ip")]
    keyed = ranges.select(number_key(F.col("first_ip")).alias("first"), number_key(F.col("last_ip")).alias("last"), *names)
    return looked_up(points, number_key(F.col(ip)), flattened(keyed, names), names)


def ip_locations(points: DataFrame, places: DataFrame, ip: str) -> DataFrame:
    """Latitude, longitude, region (`Unknown` where the place has none) and country of public addresses."""
    rows = points.withColumn("_public", F.when(is_public(F.col(ip)), F.col(ip)))
    found = range_join(rows, places, "_public")
    return found.select(*points.columns, "latitude", "longitude", F.when(F.col("country").isNotNull(), F.coalesce("region", F.lit("Unknown"))).alias("region"), "country")


def merge_host_names(one: DataFrame, two: DataFrame) -> DataFrame:
    """(ip, host, error) of two providers without repeats; an address without any name keeps its error."""
    both = one.unionByName(two)
    names = both.filter("host IS NOT NULL").select("ip", "host").distinct().withColumn("error", F.lit(None).cast("string"))
    failed = both.groupBy("ip").agg(F.count("host").alias("n"), F.min("error").alias("error")).filter("n = 0 AND error IS NOT NULL")
    return names.unionByName(failed.select("ip", F.lit(None).cast("string").alias("host"), "error"))


def policy_rules(policy: DataFrame, most: int = 1_000) -> list[tuple[str, str]]:
    """(name, regex) of a policy table (ord, name, regex) in order; a table of more than `most` rows is no policy."""
    rows = policy.select("ord", "name", "regex").orderBy("ord").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} licence rules")
    return [(r.name, r.regex) for r in rows]


def known_or(packages: DataFrame, known: DataFrame, found: str) -> DataFrame:
    """A known licence of a package takes the place of what was looked up."""
    listed = known.groupBy("pkg").agg(F.min("license").alias("_known"))
    return packages.join(listed, "pkg", "left").withColumn(found, F.coalesce("_known", found)).drop("_known")


def found_licenses(packages: DataFrame, known: DataFrame, plain: str = "License :: OSI Approved") -> DataFrame:
    """One row for each licence text of a package (image, pkg, classifiers, license_expression, shown, repository): the
    known licence or the classifiers that name one, and the expression; else the shown line, else the repository's licence."""
    listed = known.groupBy("pkg").agg(F.min("license").alias("_known"))
    rows = packages.join(listed, "pkg", "left")
    classifiers = F.when(F.col("_known").isNotNull(), F.array("_known")).otherwise(F.coalesce("classifiers", F.array().cast("array<string>")))
    named = F.filter(classifiers, lambda c: F.startswith(c, F.lit("License ::")) & (c != plain))
    expression = F.when(F.col("_known").isNull() & (F.coalesce("license_expression", F.lit("")) != ""), F.array("license_expression")).otherwise(F.array().cast("array<string>"))
    shown = F.when(F.contains("shown", F.lit("UNKNOWN")), F.coalesce("repository", F.lit("NOT_FOUND"))).otherwise(F.col("shown"))
    last = F.when(F.col("shown").isNull(), F.array().cast("array<string>")).otherwise(F.array(shown))
    every = F.concat(named, expression)
    return rows.select("image", "pkg", F.explode(F.when(F.size(every) > 0, every).otherwise(last)).alias("license"))


def uri_licenses(modules: DataFrame, approved: DataFrame, known: DataFrame) -> DataFrame:
    """(image, pkg, license, reason) of modules (image, pkg, uri, first_line): a known one, one without a uri, an approved
    uri, else the first rule of the policy (ord, name, regex, url, additional_urls) that the licence's first line matches."""
    urls = approved.select("ord", "name", F.explode(F.array_append(F.coalesce("additional_urls", F.array().cast("array<string>")), F.col("url"))).alias("uri")).filter("uri IS NOT NULL")
    first = urls.groupBy("uri").agg(F.min_by("name", "ord").alias("_by_uri"))
    rows = modules.join(known.groupBy("pkg").agg(F.min("license").alias("_known")), "pkg", "left").join(first, "uri", "left")
    line = F.coalesce(*(F.when(F.col("first_line").rlike(regex), F.lit(name)) for name, regex in policy_rules(approved)))
    missing = F.coalesce("uri", F.lit("")) == ""
    reason = F.when(F.col("_known").isNotNull(), "known").when(missing, "no uri").when(F.col("_by_uri").isNotNull(), "uri").when(line.isNotNull(), "text").otherwise("not approved")
    return rows.select("image", "pkg", F.coalesce("_known", F.when(~missing, F.coalesce("_by_uri", line))).alias("license"), reason.alias("reason"))


def license_matches(found: DataFrame, approved: list[tuple[str, str]], keys: list[str], text: str = "license") -> DataFrame:
    """Each found licence with the first approved entry (name, regex) whose pattern it holds, else null."""
    first = F.coalesce(*(F.when(F.col(text).rlike(regex), F.lit(name)) for name, regex in approved))
    return found.select(*keys, text, first.alias("approved"))


def apply_exclusions(packages: DataFrame, exclusions: DataFrame) -> DataFrame:
    """Drops packages that are excluded for all images or for one whose name the image holds."""
    e = exclusions.select(F.col("pkg").alias("x_pkg"), "docker_images")
    listed = F.coalesce("docker_images", F.array().cast("array<string>"))
    hit = (F.col("pkg") == F.col("x_pkg")) & ((F.size(listed) == 0) | F.exists(listed, lambda i: F.contains(F.col("image"), i)))
    return packages.join(e, hit, "left_anti")


def compliance(matches: DataFrame, image: str) -> DataFrame:
    """Verdict of each image: all licences approved, the failures counted and the first of them."""
    bad = F.col("approved").isNull()
    return matches.groupBy(image).agg(F.bool_and(~bad).alias("passes"), F.count_if(bad).alias("n_failed"), F.min(F.when(bad, F.col("license"))).alias("first_failed"))
