"""What the text operators share: keys, lower case, regex spans in columns."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space as the contracts write it: space and the controls from tab to carriage return.
SPACE = "[ \\t-\\r]+"


def fresh(name: str, *frames: DataFrame) -> str:
    """``name``, with underscores added until no frame has such a column."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def whole(text: Column | str = "text") -> Column:
    """The whole text; null counts as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def row_key(doc_id: Column, text: Column) -> Column:
    """A never null key that only rows of equal id and equal text share.

    Such repeated rows have equal results, so joining results by this key is right for them too.
    """
    return F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("null")), F.md5(text))


def span_list(text: Column, pattern: str, fails: Column | None = None) -> Column:
    """Leftmost non-overlapping matches of a Java pattern as ``array<struct<start, end, part>>``.

    Offsets count code points, ends are exclusive. What lies between the matches comes from
    ``split``, so running lengths give the offsets. The pattern must not match the empty string.
    """
    pieces = F.transform(F.split(text, pattern, -1), F.char_length)
    parts = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    kind = "array<struct<start:int,end:int,part:string>>"
    start = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("found"))

    def step(acc, x):
        at = acc["at"] + x["gap"]
        end = at + F.char_length(x["part"])
        return F.struct(end.alias("at"), F.array_append(acc["found"], F.struct(at.alias("start"), end.alias("end"), x["part"].alias("part"))).cast(kind).alias("found"))

    zipped = F.transform(parts, lambda p, i: F.struct(F.get(pieces, i).alias("gap"), p.alias("part")))
    return F.when(text.rlike(pattern), F.aggregate(zipped, start, step)["found"]).otherwise(F.array().cast(kind))


def joined_spans(spans: Column, names: list[str]) -> Column:
    """``kind:start:end`` by start, then kind in the order of ``names``, comma-joined.

    ``spans`` is ``array<struct<start, rank, end>>``, rank the place of the kind in ``names``.
    """
    label = F.array(*map(F.lit, names))
    return F.concat_ws(",", F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(label, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))))


def ranked(spans: Column, rank: int) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end")))


def sha(text: Column) -> Column:
    return F.sha2(text, 256)
