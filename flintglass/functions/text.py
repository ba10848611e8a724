"""Column functions over versions, image references, constraints and dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Constraint operators in the order in which they are tried; forms of versions and names.
OPERATORS = ("^", "<=", ">=", "<", ">", "!=", "~=", "~", "===", "==", "=")
PYTHON_IN_TAG = r"3.\d{1,3}.\d{1,3}"
KEBAB = r"^([a-z][a-z0-9]*)(-[a-z0-9]+)*$"


def parse_versions(text: Column) -> Column:
    """All dotted numbers (or a trailing one) as structs of four numbers, missing parts 0."""
    def one(v: Column) -> Column:
        parts = F.split(v, r"\.")
        return F.struct(*(F.coalesce(F.get(parts, i).cast("long"), F.lit(0).cast("long")).alias(n) for i, n in enumerate(("major", "minor", "micro", "revision"))))

    return F.transform(F.regexp_extract_all(text, F.lit(r"(\d+(?:\.\d+)+)|(\d+)$"), F.lit(0)), one)


def tag_family_regex(tag: Column) -> Column:
    """A pattern for tags of the same form: each version's last part and a trailing number may be any number."""
    escaped = F.regexp_replace(tag, r"[.+]", r"\\$0")
    return F.concat(F.regexp_replace(escaped, r"(\d+(?:\\\.\d+)*\\\.)\d+|\d+$", r"$1[\\d]+"), F.lit("$"))


def split_image_ref(ref: Column) -> Column:
    """repo, name and tag; the repo is `library` without a slash, the tag null without a colon."""
    tagged = F.element_at(F.split(ref, "/"), -1)
    repo = F.when(F.contains(ref, F.lit("/")), F.regexp_extract(ref, r"^(.*)/[^/]*$", 1)).otherwise("library")
    tag = F.when(F.contains(tagged, F.lit(":")), F.substring_index(tagged, ":", -1))
    return F.struct(repo.alias("repo"), F.substring_index(tagged, ":", 1).alias("name"), tag.alias("tag"))


def constraint(text: Column) -> Column:
    """(operator, version): the first operator of the list that occurs anywhere, and what stands behind its first place."""
    found = F.struct(F.lit("").alias("operator"), text.alias("version"))
    for o in reversed(OPERATORS):
        behind = F.substr(text, F.instr(text, o) + len(o))
        found = F.when(F.contains(text, F.lit(o)), F.struct(F.lit(o).alias("operator"), behind.alias("version"))).otherwise(found)
    return found


def version_conformance(base: Column, text: Column, tilde: bool) -> Column:
    """Whether a constraint names exactly the major and minor of the base version, and the right form; an empty base passes."""
    parts = F.split(constraint(base)["version"], r"\.")
    right = F.concat(F.lit("~" if tilde else ""), F.concat_ws(".", parts[0], F.coalesce(F.get(parts, 1), F.lit("0"))))
    return F.struct(((base == "") | (text == right)).alias("ok"), right.alias("correct"))


def version_to_write(version: Column, path: Column) -> Column:
    """Major and minor of a version of numbers (with a tilde for pyproject files); other versions stay."""
    parts = F.split(version, r"\.")
    short = F.concat(F.when(F.contains(path, F.lit("pyproject")), "~").otherwise(""), parts[0], F.lit("."), F.get(parts, 1))
    return F.when(version.rlike(r"^\d+(\.\d+)+$"), short).otherwise(version)


def version_line(content: Column, path: Column) -> Column:
    """The interpreter version line of a manifest, empty where it has none."""
    pip = F.regexp_extract(content, r'python_version = "[^"]*"', 0)
    return F.when(F.contains(path, F.lit("Pipfile")), pip).otherwise(F.regexp_extract(content, r'(?m)^python = "[^"]*"', 0))


def rewrite_manifest(content: Column, path: Column, version: Column) -> Column:
    """(content, changed): the version line renewed where it differs."""
    old = version_line(content, path)
    name = F.when(F.contains(path, F.lit("Pipfile")), "python_version").otherwise("python")
    new = F.concat(name, F.lit(' = "'), version_to_write(version, path), F.lit('"'))
    changed = (old != "") & (old != new)
    return F.struct(F.when(changed, F.replace(content, old, new)).otherwise(content).alias("content"), changed.alias("changed"))


def python_version_in_tag(tag: Column) -> Column:
    """The first interpreter version that a tag holds, else null."""
    found = F.regexp_extract(tag, PYTHON_IN_TAG, 0)
    return F.when(found != "", found)


def image_full_name(org: Column, image: Column, version: Column, revision: Column) -> Column:
    return F.concat(org, F.lit("/"), image, F.lit(":"), F.coalesce(version, F.lit("1.0.0")), F.lit("."), revision.cast("string"))


def archive_name(full_name: Column) -> Column:
    return F.concat(F.replace(F.replace(full_name, F.lit("/"), F.lit("__")), F.lit(":"), F.lit("_")), F.lit(".tar"))


def same_release(one: Column, two: Column) -> Column:
    """Whether the first three dotted parts of two versions are equal."""
    head = lambda v: F.slice(F.split(v, r"\."), 1, 3)
    return head(one) == head(two)


def external_branch(repo: Column, image: Column, old: Column, new: Column) -> Column:
    return F.concat(F.lit("autoupdate/Update_"), repo, F.lit("_"), image, F.lit("_from_"), old, F.lit("_to_"), new)


def internal_branch(base: Column, names: Column, new: Column) -> Column:
    """names: array of the images of one batch."""
    return F.concat(F.lit("autoupdate/"), base, F.lit("_"), F.array_join(names, "-"), F.lit("_"), new)


def file_time_text(epoch: Column) -> Column:
    """Epoch seconds as UTC text without colons and blanks; `unknown` for null."""
    return F.coalesce(F.replace(F.date_format(F.timestamp_seconds(epoch), "yyyy-MM-dd HH-mm-ss"), F.lit(" "), F.lit("_")), F.lit("unknown"))


def title_matches(title: Column, author: Column, prefix: str, name: str) -> Column:
    """Requests whose title starts with a prefix and whose author is the given one."""
    return F.startswith(title, F.lit(prefix)) & (author == name)


def rewrite_date(content: Column, now: Column) -> Column:
    """The date of the last-modified comment renewed."""
    return F.regexp_replace(content, F.lit(r"# Last modified: .*"), F.concat(F.lit("# Last modified: "), now))


def last_modified(content: Column) -> Column:
    found = F.regexp_extract(content, r"# Last modified: (.*)", 1)
    return F.coalesce(F.try_to_timestamp(F.when(found != "", found)), F.to_timestamp(F.lit("2000-01-01 12:00:00")))


def rewrite_base(content: Column, name: Column, old: Column, new: Column, now: Column) -> Column:
    """A build file with its base reference moved to the new tag and its date line renewed."""
    moved = F.replace(content, F.concat(name, F.lit(":"), old), F.concat(name, F.lit(":"), new))
    return rewrite_date(moved, now)


def ip_to_long(ip: Column) -> Column:
    """A dotted IPv4 text as a number; null where it is none."""
    parts = F.split(ip, r"\.")
    valid = ip.rlike(r"^\d{1,3}(\.\d{1,3}){3}$")
    number = sum((F.get(parts, i).try_cast("long") * (256 ** (3 - i)) for i in range(4)), F.lit(0).cast("long"))
    return F.when(valid, number)


def is_public(ip: Column) -> Column:
    """False for private ranges and for null."""
    private = ip.between(167772160, 184549375) | ip.between(2886729728, 2887778303) | ip.between(3232235520, 3232301055) | ip.between(2130706432, 2147483647)
    return F.coalesce(~private, F.lit(False))


def kebab(name: Column) -> Column:
    return name.rlike(KEBAB)
