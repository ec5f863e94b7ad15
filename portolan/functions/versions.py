"""Version ordering without Python, after the public PEP 440 scheme."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed value: the public version grammar
VERSION = (
    r"^\s*v?(?:(\d+)!)?(\d+(?:\.\d+)*)"
    r"(?:[-_.]?(a|b|c|rc|alpha|beta|pre|preview)[-_.]?(\d*))?"
    r"(?:-(\d+)|[-_.]?(?:post|rev|r)[-_.]?(\d*))?"
    r"(?:[-_.]?(dev)[-_.]?(\d*))?"
    r"(?:\+([a-z0-9]+(?:[-_.][a-z0-9]+)*))?\s*$"
)
FAR = 2**62


def _part(v: Column, i: int) -> Column:
    return F.nullif(F.regexp_extract(v, VERSION, i), F.lit(""))


def is_version(version: Column) -> Column:
    return F.lower(version).rlike(VERSION)


def release(version: Column) -> Column:
    """Release numbers as given, null when the text is no version."""
    v = F.lower(version)
    return F.when(v.rlike(VERSION), F.transform(F.split(F.regexp_extract(v, VERSION, 2), r"\."), lambda x: x.cast("bigint")))


def major(version: Column) -> Column:
    return release(version)[0]


def minor(version: Column) -> Column:
    return F.coalesce(F.get(release(version), 1), F.when(is_version(version), F.lit(0).cast("bigint")))


def is_prerelease(version: Column) -> Column:
    v = F.lower(version)
    return v.rlike(VERSION) & (_part(v, 3).isNotNull() | _part(v, 7).isNotNull())


def version_key(version: Column) -> Column:
    """A struct that sorts as versions do; null for an invalid version.

    A development build sorts below its pre-releases, those below the release, a
    post-release above it; trailing zeros do not count.
    """
    v = F.lower(version)
    nums = F.transform(F.split(F.regexp_extract(v, VERSION, 2), r"\."), lambda x: x.cast("bigint"))
    size = F.aggregate(
        F.transform(nums, lambda x, i: F.when(x > 0, i + 1).otherwise(0)), F.lit(0), lambda acc, x: F.greatest(acc, x)
    )
    number = lambda i: F.coalesce(_part(v, i).cast("bigint"), F.lit(0).cast("bigint"))
    pre, dev = _part(v, 3), _part(v, 7)
    has_post = v.rlike(r"-\d+(?:[-_.]?dev[-_.]?\d*)?(?:\+.*)?\s*$|[-_.]?(post|rev|r)[-_.]?\d*(?:[-_.]?dev[-_.]?\d*)?(?:\+.*)?\s*$") & (
        _part(v, 5).isNotNull() | v.rlike(r"\d[-_.]?(post|rev|r)[-_.]?\d*")
    )
    stage = (
        F.when(pre.isin("a", "alpha"), 0)
        .when(pre.isin("b", "beta"), 1)
        .when(pre.isNotNull(), 2)
        .when(dev.isNotNull() & ~has_post, -1)
        .otherwise(3)
    )
    return F.when(
        v.rlike(VERSION),
        F.struct(
            number(1).alias("epoch"),
            F.slice(nums, 1, size).alias("release"),
            stage.alias("stage"),
            F.when(pre.isNotNull(), number(4)).otherwise(0).alias("pre"),
            F.when(has_post, F.coalesce(number(5) + number(6), F.lit(0).cast("bigint"))).otherwise(-1).alias("post"),
            F.when(dev.isNotNull(), number(8)).otherwise(F.lit(FAR)).alias("dev"),
            F.coalesce(_part(v, 9), F.lit("")).alias("local"),
        ),
    )


# fixed value: range syntax [1.0,2.0)
RANGE = r"^([\[\(])([^,\]\)]*),?\s*([^,\]\)]*)?([\]\)])"


def parse_range(text: Column) -> Column:
    """Bounds of a version range; a bare version is an inclusive minimum."""
    ranged = text.rlike(r"[\[\]()]")
    grab = lambda i: F.nullif(F.trim(F.regexp_extract(text, RANGE, i)), F.lit(""))
    return F.struct(
        F.when(ranged, grab(2)).otherwise(F.nullif(text, F.lit(""))).alias("min"),
        F.when(ranged, grab(3)).alias("max"),
        F.when(ranged, F.regexp_extract(text, RANGE, 1) == "[").otherwise(True).alias("min_inc"),
        F.when(ranged, F.regexp_extract(text, RANGE, 4) == "]").otherwise(False).alias("max_inc"),
    )


def version_in_range(version: Column, text: Column) -> Column:
    """False for an invalid version or bound."""
    r, v = parse_range(text), version_key(version)
    low, high = version_key(r["min"]), version_key(r["max"])
    above = F.when(r["min"].isNull(), True).when(r["min_inc"], v >= low).otherwise(v > low)
    below = F.when(r["max"].isNull(), True).when(r["max_inc"], v <= high).otherwise(v < high)
    return F.coalesce(v.isNotNull() & above & below, F.lit(False))


def major_version_differs(versions: Column) -> Column:
    """More than one distinct whole-number first part."""
    heads = F.transform(versions, lambda v: F.split(v, r"\.")[0])
    return F.size(F.array_distinct(F.transform(F.filter(heads, lambda h: h.rlike(r"^\d+$")), lambda h: h.cast("bigint")))) > 1


def conflict_severity(versions: Column) -> Column:
    """How far a set of versions of one artifact is apart."""
    given = F.filter(versions, lambda v: v.isNotNull() & (v != "") & (v != "*"))
    majors = F.array_distinct(F.transform(given, major))
    minors = F.array_distinct(F.transform(given, minor))
    return (
        F.when(F.exists(given, lambda v: ~is_version(v)), "medium")
        .when(F.size(given) == 0, "low")
        .when(F.size(majors) > 1, "critical")
        .when(F.size(minors) > 2, "high")
        .when(F.exists(given, is_prerelease), "high")
        .otherwise("medium")
    )
