"""G: ranking, top-k and windows that stay parallel when one key holds much of the data.

Top-n per group goes through ``row_number() <= n``, which Spark limits on the map side
before the shuffle; best-of-group is a plain aggregate. Frames over a whole series are
cut into time slices, and each slice gets just the neighbouring rows its frame needs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from portolan.session import written


def best_per_group(df: DataFrame, keys: list[str], order: list[str], largest: bool = True) -> DataFrame:
    """The row with the largest (or smallest) ``order`` per group, by aggregation."""
    pick = F.max_by if largest else F.min_by
    rest = [c for c in df.columns if c not in keys]
    row = pick(F.struct(*rest), F.struct(*order)).alias("r")
    return df.groupBy(*keys).agg(row).select(*keys, "r.*")


def keep_first(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """One row per key, the first in the given order."""
    return first_n_per_group(df, [key], order, 1)


def top_k(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    """The global top k; give a key as the last order column to break ties."""
    return df.orderBy(*order).limit(k)


def first_n_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str | None = None) -> DataFrame:
    """The first ``n`` rows per group; ``rank`` names a column to keep their position in."""
    pos = rank or "_pos"
    kept = df.withColumn(pos, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(pos) <= n)
    return kept if rank else kept.drop(pos)


def latest_per_key(df: DataFrame, key: str, ts: list[str]) -> DataFrame:
    """The newest row per key."""
    return best_per_group(df, [key], ts)


def order_by(df: DataFrame, spec: list[tuple[str, str]]) -> DataFrame:
    """Sort by several columns, each ``asc`` or ``desc``."""
    return df.orderBy(*[F.col(c).desc() if how == "desc" else F.col(c).asc() for c, how in spec])


def page(df: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """One page with the total row count and whether more rows follow."""
    total = df.agg(F.count("*").alias("total")).scalar()
    return (
        df.orderBy(*order)
        .offset(offset)
        .limit(limit)
        .withColumn("total", total)
        .withColumn("has_next", F.col("total") > offset + limit)
    )


def with_rank(df: DataFrame, keys: list[str], order: list[str], name: str = "rank") -> DataFrame:
    """The position of every row in its group.

    The rows are range-sorted over all tasks and written with their place in the sort;
    a group's ranks are then places minus the group's first place, so a large group
    is spread over as many tasks as it fills.
    """
    placed = df.orderBy(*keys, *order).withColumn("_id", F.monotonically_increasing_id())
    spot = written(
        placed.select("*", F.shiftright("_id", 33).alias("_part"), F.col("_id").bitwiseAND((1 << 33) - 1).alias("_off")).drop("_id"),
        "sorted",
    )
    # one row per task of the sort
    sizes = spot.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select(
        "_part",
        (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"),
    )
    at = spot.join(F.broadcast(before), "_part").withColumn("_at", F.col("_before") + F.col("_off"))
    first = at.groupBy(*keys).agg(F.min("_at").alias("_first"))
    return at.join(first, keys).select(*df.columns, (F.col("_at") - F.col("_first") + 1).alias(name))


def _epoch(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


# rows of one key that one task may be handed at once
ROWS_PER_SLICE = 1_000_000


def densest_rate(df: DataFrame, keys: list[str], ts: str) -> float:
    """Rows per second of the key that has most of them; one aggregated row reaches the driver."""
    us = _epoch(ts)
    spans = df.groupBy(*keys).agg(F.count("*").alias("n"), ((F.max(us) - F.min(us)) / 1_000_000).alias("s"))
    top = spans.agg(F.max(F.col("n") / F.greatest(F.col("s"), F.lit(1.0)))).first()[0]
    return float(top or 0.0)


def slice_width(df: DataFrame, keys: list[str], ts: str) -> int:
    """Seconds per slice so that the densest key puts about ROWS_PER_SLICE rows in each."""
    return max(1, int(ROWS_PER_SLICE / max(densest_rate(df, keys, ts), 1e-9)))


def with_preceding(df: DataFrame, keys: list[str], order: list[str], n: int, slice_col: str) -> DataFrame:
    """Rows plus, per time slice, copies of the ``n`` rows before it (column ``_copy``).

    ``slice_col`` must not decrease along ``order`` within a key. Only the last ``n`` rows
    of each slice take part in the look-back, so this costs ``n`` rows per slice.
    """
    desc = [F.col(c).desc() for c in order]
    ends = first_n_per_group(df, [*keys, slice_col], desc, n)
    by_key = Window.partitionBy(*keys).orderBy(slice_col, *order)
    ends = ends.withColumn("_i", F.row_number().over(by_key))
    starts = ends.groupBy(*keys, slice_col).agg(F.min("_i").alias("_j")).withColumnRenamed(slice_col, "_to")
    copies = (
        ends.withColumn("_j", F.explode(F.sequence(F.col("_i") + 1, F.col("_i") + n)))
        .join(starts, [*keys, "_j"])
        .drop(slice_col)
        .withColumnRenamed("_to", slice_col)
    )
    return df.withColumn("_copy", F.lit(False)).unionByName(copies.select(*df.columns, F.lit(True).alias("_copy")))


def rolling(
    df: DataFrame, keys: list[str], order: list[str], ts: str, n: int, aggs: dict[str, Column], slice_seconds: int | None = None
) -> DataFrame:
    """Aggregates over the current and the ``n - 1`` rows before it, per key.

    ``order`` starts with ``ts``. ``aggs`` maps names to aggregate columns. The slice
    length follows from the densest key unless given.
    """
    slice_seconds = slice_seconds or slice_width(df, keys, ts)
    cut = df.withColumn("_slice", F.floor(_epoch(ts) / (slice_seconds * 1_000_000)))
    ready = with_preceding(cut, keys, order, n - 1, "_slice") if n > 1 else cut.withColumn("_copy", F.lit(False))
    frame = Window.partitionBy(*keys, "_slice").orderBy(*order).rowsBetween(-(n - 1), 0)
    out = ready.select("*", *[c.over(frame).alias(name) for name, c in aggs.items()])
    return out.where("not _copy").drop("_copy", "_slice")


def rolling_mean(df: DataFrame, keys: list[str], order: list[str], ts: str, value: str, n: int) -> DataFrame:
    """Mean of the latest ``n`` values up to each row."""
    return rolling(df, keys, order, ts, n, {"rolling_mean": F.avg(value)})


def next_row(df: DataFrame, keys: list[str], order: list[str], ts: str, cols: dict[str, str], slice_seconds: int | None = None) -> DataFrame:
    """Columns of the following row per key, null on the last one.

    ``cols`` maps new names to source columns. Works like ``rolling`` in reverse time:
    each slice is handed the first row of the next slice that has any.
    """
    slice_seconds = slice_seconds or slice_width(df, keys, ts)
    spec = F.struct(*order)
    cut = df.withColumn("_slice", F.floor(_epoch(ts) / (slice_seconds * 1_000_000)))
    firsts = cut.groupBy(*keys, "_slice").agg(F.min_by(F.struct(*df.columns), spec).alias("_row"))
    ahead = firsts.withColumn("_next", F.lead("_row").over(Window.partitionBy(*keys).orderBy("_slice")))
    within = Window.partitionBy(*keys, "_slice").orderBy(*order)
    led = cut.withColumn("_lead", F.lead(F.struct(*df.columns)).over(within))
    return (
        led.join(ahead.select(*keys, "_slice", "_next"), [*keys, "_slice"])
        .withColumn("_after", F.coalesce("_lead", "_next"))
        .select(*df.columns, *[F.col(f"_after.{c}").alias(name) for name, c in cols.items()])
    )


def trailing_count(df: DataFrame, keys: list[str], ts: str, seconds: int, name: str = "trailing_count", row_id: str = "event_id") -> DataFrame:
    """Rows of the same key in the ``seconds`` up to and including each row.

    The frame is open at its far end: a row exactly ``seconds`` old no longer counts.
    Slices are as long as the frame, so a row is needed in its own slice and the next.
    Where a key packs too many rows into one frame, running counts over shorter slices
    are subtracted instead; ``row_id`` tells the rows apart.
    """
    width = seconds * 1_000_000
    rate = densest_rate(df, keys, ts)
    if rate * seconds > ROWS_PER_SLICE:
        return _dense_trailing_count(df, keys, ts, width, name, row_id, int(ROWS_PER_SLICE / rate * 1_000_000) + 1)
    at = df.withColumn("_us", _epoch(ts)).withColumn("_slice", F.floor(F.col("_us") / width))
    both = at.withColumn("_copy", F.lit(False)).unionByName(
        at.withColumn("_slice", F.col("_slice") + 1).withColumn("_copy", F.lit(True))
    )
    frame = Window.partitionBy(*keys, "_slice").orderBy("_us").rangeBetween(-(width - 1), 0)
    return both.withColumn(name, F.count("*").over(frame)).where("not _copy").drop("_copy", "_us", "_slice")


def _dense_trailing_count(df: DataFrame, keys: list[str], ts: str, width: int, name: str, row_id: str, cut: int) -> DataFrame:
    """Count up to each row minus count up to one frame before it.

    A running count is the total of the slices before plus the count inside the slice,
    so slices may be as short as the data asks for.
    """
    here = df.select(*keys, row_id, _epoch(ts).alias("_us"))
    points = here.withColumn("_sign", F.lit(1)).unionByName(here.withColumn("_us", F.col("_us") - width).withColumn("_sign", F.lit(-1)))
    points = points.withColumn("_slice", F.floor(F.col("_us") / cut))
    rows = F.when(F.col("_sign") == 1, 1).otherwise(0)
    totals = points.groupBy(*keys, "_slice").agg(F.sum(rows).alias("_n"))
    before = totals.select(*keys, "_slice", (F.sum("_n").over(Window.partitionBy(*keys).orderBy("_slice")) - F.col("_n")).alias("_before"))
    inside = F.sum(rows).over(Window.partitionBy(*keys, "_slice").orderBy("_us").rangeBetween(Window.unboundedPreceding, 0))
    running = points.withColumn("_in", inside).join(before, [*keys, "_slice"])
    counts = running.groupBy(row_id).agg(F.sum(F.col("_sign") * (F.col("_in") + F.col("_before"))).alias(name))
    return df.join(counts, row_id).select(*df.columns, name)
