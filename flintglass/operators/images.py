"""Image catalogues: versions, tag families, staleness, dependency closure, audits and list upkeep."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import parse_versions, rewrite_date, tag_family_regex
from ..plans.segments import numbered
from ..plans.shared import cut

#: Items of one row of a large group.
CHUNK = 10_000
# Fixed value: what begins the line with a build file's date.
DATE_LINE = "# Last modified:"


def latest_tag_by_version(tags: DataFrame, keys: list[str]) -> DataFrame:
    """The tag with the greatest version list of each image; equal versions take the smallest name."""
    ranked = tags.groupBy(*keys, "name").agg(F.min("ord").alias("ord")).withColumn("versions", parse_versions(F.col("name")))
    best = ranked.groupBy(*keys).agg(F.max("versions").alias("top"))
    top = ranked.join(best, keys).filter(F.col("versions") == F.col("top"))
    return top.groupBy(*keys).agg(F.min("name").alias("latest"))


def in_family(tags: DataFrame, current: DataFrame, keys: list[str]) -> DataFrame:
    """Tags that have the form of the image's current tag (column `current`)."""
    return tags.join(current, keys).filter(F.regexp_like("name", F.concat(F.lit("^"), tag_family_regex(F.col("current")))))


def outdated(current: DataFrame, latest: DataFrame, keys: list[str], by_time: bool = False) -> DataFrame:
    """Images whose current version list is smaller than the newest tag's; by_time: also those of the same tag that was
    updated (`last_updated`) after the image was modified (`last_modified`)."""
    both = current.join(latest, keys)
    old = parse_versions(F.col("current")) < parse_versions(F.col("latest"))
    if by_time:
        old = old | ((F.col("current") == F.col("latest")) & F.coalesce(F.col("last_updated") > F.col("last_modified"), F.lit(False)))
    return both.filter(old)


def base_kind(ref: Column, orgs: tuple[str, ...]) -> Column:
    """`internal` for references of one of the own organisations, else `external`."""
    return F.when(ref.rlike("(" + "|".join(orgs) + ")/"), "internal").otherwise("external")


def active(images: DataFrame, devonly: bool = False) -> DataFrame:
    """Images (deprecated, devonly as property texts, tag) that are in use and have a tag to update."""
    is_true = lambda c: F.coalesce(F.col(c), F.lit("")) == "true"
    rows = images.filter(~is_true("deprecated") & (F.coalesce("tag", F.lit("")) != ""))
    return rows if devonly else rows.filter(~is_true("devonly"))


def without_ignored(images: DataFrame, ignored: DataFrame, name: str, now: Column) -> DataFrame:
    """Drops images of the list (name, permanent, valid_until as dd/MM/yyyy), but for entries that are no longer valid."""
    past = F.to_timestamp("valid_until", "dd/MM/yyyy") < now
    holding = ignored.filter(F.coalesce("permanent", F.lit(False)) | ~F.coalesce(past, F.lit(False)))
    return images.join(holding.select(name).distinct(), name, "left_anti")


def content_images(files: DataFrame, org: str, keep_deprecated: bool = False) -> DataFrame:
    """Distinct images that files (text) refer to; files that are deprecated at their top level do not count."""
    rows = files if keep_deprecated else files.filter(~F.coalesce(F.col("text").rlike(r"(?m)^deprecated ?: ?true"), F.lit(False)))
    return rows.select(F.explode(F.regexp_extract_all("text", F.lit(rf"{org}/([A-Za-z0-9-]+):"), F.lit(1))).alias("image")).distinct()


def changed_files(changes: DataFrame, root: str) -> DataFrame:
    """(image, path, status) of changes (path, status) below the folders of images."""
    image = F.regexp_extract("path", rf"^{root}/([^/]+)/", 1)
    return changes.select(image.alias("image"), "path", "status").filter("image <> ''")


def changed_images(images: DataFrame, changes: DataFrame, root: str, pattern: str | None = None) -> DataFrame:
    """Images with a changed file, and whose folder matches the pattern where one is given."""
    found = images.join(changed_files(changes, root).select("image").distinct(), "image", "left_semi")
    return found if pattern is None else found.filter(F.concat(F.lit(f"{root}/"), "image").rlike(pattern))


def superseded_branches(branches: DataFrame, bases: DataFrame, external: bool = True) -> DataFrame:
    """(base, branch) of update branches that aim at a version below the base's newest tag; bases: (repo, image, latest).

    A branch may name an image by any of its parts up to an underscore; each of them is looked up, so that the join is by equality."""
    if external:
        rest, target = F.regexp_extract("branch", r"^origin/autoupdate/.*?Update_(.*)$", 1), F.when(F.contains("branch", F.lit("_to_")), F.substring_index("branch", "_to_", -1))
        key = F.concat("repo", F.lit("_"), "image")
    else:
        rest, target = F.regexp_extract("branch", r"^origin/autoupdate/(.*)$", 1), F.when(F.contains("branch", F.lit("_")), F.substring_index("branch", "_", -1))
        key = F.concat("repo", F.lit("/"), "image")
    parts = F.split(rest, "_")
    heads = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "_"))
    named = branches.filter(rest != "").select("branch", target.alias("target"), F.explode(heads).alias("key"))
    both = named.join(bases.select(key.alias("key"), F.concat("repo", F.lit("/"), "image").alias("base"), "latest"), "key")
    return both.filter(parse_versions(F.col("target")) < parse_versions(F.col("latest"))).select("base", "branch").distinct()


def update_totals(images: DataFrame, base: str) -> DataFrame:
    """Updated, skipped and processed images (outdated, pushed) of each base."""
    done = F.col("outdated") & F.col("pushed")
    return images.groupBy(base).agg(F.count_if(done).alias("n_updated"), F.count_if(~F.col("outdated")).alias("n_skipped"), F.count("*").alias("n_processed"))


def not_set_apart(images: DataFrame, devonly: DataFrame, apart: tuple[str, ...]) -> DataFrame:
    """Images that are neither for development only nor among those that are built apart."""
    rows = images.join(devonly.select("image").distinct(), "image", "left_anti")
    return rows.filter(~F.col("image").rlike("(" + "|".join(apart) + ")")) if apart else rows


def is_sha_tag(name: Column) -> Column:
    return (F.length(name) >= 20) & name.rlike("^[0-9A-Fa-f]+$")


def latest_tag_by_time(tags: DataFrame, keys: list[str]) -> DataFrame:
    """The newest tag that is not a hash; equal times keep the first."""
    return tags.filter(~is_sha_tag(F.col("name"))).groupBy(*keys).agg(F.max_by("name", F.struct(F.col("last_updated"), -F.col("ord"))).alias("latest"))


def dependents_in_chunks(edges: DataFrame, size: int = CHUNK) -> DataFrame:
    """(base, chunk, dependents): the sorted dependents of each base in arrays of at most `size`, numbered from 0, so that a
    base of any number of images is many rows, made by many tasks."""
    rows = numbered(edges.select("base", "dependent"), ["base"], [F.col("dependent").asc()], "_at").withColumn("chunk", F.floor(F.col("_at") / size))
    return rows.groupBy("base", "chunk").agg(F.array_sort(F.collect_list("dependent")).alias("dependents"))


def dependents_by_base(edges: DataFrame) -> DataFrame:
    """The dependents of each base as one array, for bases whose images fit in a row (see dependents_in_chunks)."""
    return edges.groupBy("base").agg(F.count("*").alias("n_dependents"), F.array_sort(F.collect_list("dependent")).alias("dependents"))


def _gathered(parts: list[DataFrame]) -> DataFrame:
    """The union of the rounds so far; many are written as one, so that plans stay short."""
    if len(parts) > 20:
        parts[:] = [cut(reduce(DataFrame.union, parts))]
    return reduce(DataFrame.union, parts)


def base_closure(spark: SparkSession, edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(image, level): all images that are built on the roots, with the longest way.

    Rounds of joins, one row for each image, at any depth. Images on a cycle and those built on them have no longest way:
    their level is null. An edge of an image to itself is ignored."""
    edges = cut(edges.filter("dependent <> base").select("base", "dependent").distinct())
    fresh = cut(roots.select(F.col("base").alias("image")).distinct())
    reached, level, again = [fresh.withColumn("level", F.lit(0).cast("long"))], 0, False
    while True:
        level += 1
        ahead = edges.join(fresh.withColumnRenamed("image", "base"), "base", "left_semi").select(F.col("dependent").alias("image")).distinct()
        ahead = cut(ahead.join(_gathered(reached).select("image", F.lit(True).alias("known")), "image", "left"))
        n, n_known = ahead.agg(F.count("*"), F.count("known")).first()
        again = again or n_known > 0
        if n == n_known:
            break
        fresh = ahead.filter("known IS NULL").select("image")
        reached.append(fresh.withColumn("level", F.lit(level).cast("long")))
    found = _gathered(reached)
    return _longest(edges, cut(found.select("image"))) if again else found


def _longest(edges: DataFrame, images: DataFrame) -> DataFrame:
    """(image, level) where ways of several lengths or cycles exist: an image is settled after all of its bases.

    The images are closed under dependents, so that those without a base among them are roots."""
    inside = cut(edges.join(images.withColumnRenamed("image", "base"), "base", "left_semi"))
    need = cut(inside.groupBy(F.col("dependent").alias("image")).agg(F.count("*").alias("need")))
    ready = cut(images.filter("image IS NULL").union(images.join(need, "image", "left_anti").filter("image IS NOT NULL")))
    settled, level, waiting = [], 0, None
    while not ready.isEmpty():
        settled.append(ready.withColumn("level", F.lit(level).cast("long")))
        level += 1
        got = inside.join(ready.withColumnRenamed("image", "base"), "base", "left_semi").groupBy(F.col("dependent").alias("image")).agg(F.count("*").alias("got"))
        got = got if waiting is None else got.union(waiting).groupBy("image").agg(F.sum("got").alias("got"))
        step = cut(got.join(need, "image"))
        ready, waiting = step.filter("got = need").select("image"), step.filter("got < need").select("image", "got")
        _gathered(settled)
    if not settled:
        return images.withColumn("level", F.lit(None).cast("long"))
    done = _gathered(settled)
    endless = images.filter("image IS NOT NULL").join(done, "image", "left_anti").withColumn("level", F.lit(None).cast("long"))
    return done.union(endless)


def list_difference(one: DataFrame, two: DataFrame, name: str) -> DataFrame:
    """Names that stand in one list only, with the side."""
    a, b = one.select(name).distinct(), two.select(name).distinct()
    return a.exceptAll(b).withColumn("side", F.lit("first")).unionByName(b.exceptAll(a).withColumn("side", F.lit("second")))


def insert_if_absent(entries: DataFrame, new: DataFrame, name: str) -> DataFrame:
    """The list with new entries of unknown name and a reason."""
    return entries.unionByName(new.filter("reason IS NOT NULL AND reason <> ''").join(entries.select(name), name, "left_anti"))


def carry_created(rebuilt: DataFrame, previous: DataFrame, name: str, now: Column) -> DataFrame:
    old = previous.groupBy(name).agg(F.min("created").alias("old"))
    return rebuilt.join(old, name, "left").select(name, F.coalesce("old", now).alias("created"))


def duplicate_entries(entries: DataFrame, name: str) -> DataFrame:
    return entries.groupBy(name).agg(F.count("*").alias("n")).filter("n > 1")


def without(images: DataFrame, name: str, *lists: DataFrame) -> DataFrame:
    """Images that stand in none of the lists (each with the column `name`)."""
    for other in lists:
        images = images.join(other.select(name).distinct(), name, "left_anti")
    return images


def batches(rows: DataFrame, base: str, order: str, size: int) -> DataFrame:
    """Slices of `size` rows a base, in order, for bases of any number of rows."""
    return numbered(rows, [base], [F.col(order)], "batch").withColumn("batch", F.floor(F.col("batch") / size).cast("long"))


def first_per_base(rows: DataFrame, base: str, order: str, most: int) -> DataFrame:
    rn = F.row_number().over(Window.partitionBy(base).orderBy(order))
    return rows.withColumn("rn", rn).filter(F.col("rn") <= most).withColumn("rn", F.col("rn").cast("long"))


def build_summary(events: DataFrame, run: str) -> DataFrame:
    """Steps, successes, failures, first and last day and duration in seconds of each run."""
    return events.groupBy(run).agg(
        F.count("*").alias("n_total"), F.count_if("ok").alias("n_ok"), F.count_if(~F.col("ok")).alias("n_failed"), F.min("at").cast("date").alias("first_day"), F.max("at").cast("date").alias("last_day"),
        (F.unix_seconds(F.max("at")) - F.unix_seconds(F.min("at"))).alias("seconds"),
    )


def _failures(events: DataFrame, run: str) -> DataFrame:
    return events.groupBy(run, "image").agg(F.max(F.when(~F.col("ok"), F.col("step"))).alias("step"))


def failure_report(events: DataFrame, run: str) -> DataFrame:
    """The failed images of each run with their step, as one JSON object in order of the image; `{}` without a failure. For
    runs whose failures fit in a row (see failure_chunks)."""
    failed = F.array_sort(F.collect_list(F.when(F.col("step").isNotNull(), F.struct("image", F.struct("step").alias("at")))))
    return _failures(events, run).groupBy(run).agg(F.to_json(F.map_from_entries(failed)).alias("report"))


def failure_chunks(events: DataFrame, run: str, size: int = CHUNK) -> DataFrame:
    """(run, chunk, report): the failed images of each run in order, as JSON objects of at most `size` images, numbered
    from 0; a run without a failure has one of none."""
    last = _failures(events, run)
    failed = numbered(last.filter("step IS NOT NULL"), [run], [F.col("image").asc()], "_at").withColumn("chunk", F.floor(F.col("_at") / size))
    entries = F.map_from_entries(F.array_sort(F.collect_list(F.struct("image", F.struct("step").alias("at")))))
    reports = failed.groupBy(run, "chunk").agg(F.to_json(entries).alias("report"))
    good = last.groupBy(run).agg(F.count("step").alias("n")).filter("n = 0")
    return reports.unionByName(good.select(run, F.lit(0).cast("long").alias("chunk"), F.lit("{}").alias("report")))


def stale_files(files: DataFrame, folder: str, now: Column) -> DataFrame:
    """Build files (path, content) under a folder (a pattern) that have a last-modified line, with the content as of `now`
    and whether that changes it."""
    chosen = files.filter(F.col("path").rlike(folder) & F.contains("content", F.lit(DATE_LINE)))
    renewed = chosen.withColumn("renewed", rewrite_date(F.col("content"), now))
    return renewed.withColumn("stale", F.col("renewed") != F.col("content"))


def aligned_with_interpreter(images: DataFrame, base: str, interpreter: str = "python") -> DataFrame:
    """Images whose base carries the interpreter's name; only their manifests follow the base's version."""
    return images.filter(F.contains(F.col(base), F.lit(interpreter)))
