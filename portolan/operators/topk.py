"""Top-k of every query over all rows, scored in blocks inside tasks.

No pair of rows is ever emitted: a task scores a block of rows against a block of
queries as one numpy matrix and hands on only the best k per query. A query side of
checked size goes to every task; a larger one is split into blocks that are matched
with blocks of rows by shuffling both. Both ways give the same, exact result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from portolan.operators.rank import first_n_per_group

# a query block of at most this many rows is sent to every task
MAX_QUERIES = 2048
ROWS_PER_CELL = 50_000
ROWS_PER_SLICE = 2048
DIGITS = 6

Score = Callable[[pd.DataFrame, pd.DataFrame], np.ndarray]


def _best(queries: pd.DataFrame, rows: pd.DataFrame, score: Score, k: int, least: float | None, same: str | None) -> pd.DataFrame:
    """The k best rows per query; ties go to the smaller id."""
    rows = rows.sort_values("id", kind="stable").reset_index(drop=True)
    points = np.round(score(queries, rows), DIGITS)
    if same is not None:
        points[queries[same].to_numpy()[:, None] == rows[same].to_numpy()[None, :]] = -np.inf
    points[np.isnan(points)] = -np.inf
    if least is not None:
        points[points < least] = -np.inf
    if points.shape[1] > k:
        floor = np.partition(points, -k, axis=1)[:, -k]
    else:
        floor = np.full(points.shape[0], -np.inf)
    q, r = np.nonzero((points >= floor[:, None]) & (points > -np.inf))
    out = pd.DataFrame({"q": q, "r": r, "score": points[q, r]})
    out = out.sort_values(["q", "score", "r"], ascending=[True, False, True], kind="stable")
    out = out[out.groupby("q").cumcount() < k]
    return pd.DataFrame(
        {"query_id": queries["query_id"].to_numpy()[out["q"]], "id": rows["id"].to_numpy()[out["r"]], "score": out["score"].to_numpy()}
    )


def _slices(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
    for at in range(0, len(rows), ROWS_PER_SLICE):
        yield rows.iloc[at : at + ROWS_PER_SLICE]


def blocked_topk(
    queries: DataFrame,
    rows: DataFrame,
    score: Score,
    k: int,
    least: float | None = None,
    same: str | None = None,
    max_queries: int = MAX_QUERIES,
    rows_per_cell: int | None = None,
) -> DataFrame:
    """Rows ``(query_id, id, score, rank)``: the ``k`` best rows per query.

    ``queries`` has ``query_id`` and ``rows`` has ``id``, next to what ``score`` needs.
    Rows scoring below ``least`` are left out, as are rows that agree with the query in
    the column ``same``. Scores are rounded to six digits before they are compared.
    ``max_queries`` and ``rows_per_cell`` bound what one task holds of either side.
    """
    kind = lambda df, c: df.schema[c].dataType.simpleString()
    schema = f"query_id {kind(queries, 'query_id')}, id {kind(rows, 'id')}, score double"
    block = queries.limit(max_queries + 1).toPandas()
    if len(block) <= max_queries:
        sent = queries.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for part in _slices(batch):
                    if len(part) and len(sent.value):
                        yield _best(sent.value, part, score, k, least, same)

        partial = rows.mapInPandas(run, schema)
    else:
        over = max(1, ceil(queries.count() / max_queries))
        cores = rows.sparkSession.sparkContext.defaultParallelism
        down = max(1, ceil(rows.count() / (rows_per_cell or ROWS_PER_CELL)), ceil(cores / over))
        spread = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n))
        cell = lambda d, q: (d * over + q).alias("_cell")
        left = queries.withColumn("_d", F.explode(F.sequence(F.lit(0), F.lit(down - 1)))).select(
            "*", cell(F.col("_d"), spread("query_id", over))
        ).drop("_d")
        right = rows.withColumn("_q", F.explode(F.sequence(F.lit(0), F.lit(over - 1)))).select(
            "*", cell(spread("id", down), F.col("_q"))
        ).drop("_q")

        def pair(some: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
            got = [_best(some, part, score, k, least, same) for part in _slices(block)] if len(some) else []
            return pd.concat(got) if got else pd.DataFrame({"query_id": [], "id": [], "score": []})

        partial = left.groupBy("_cell").cogroup(right.groupBy("_cell")).applyInPandas(pair, schema)
    return first_n_per_group(partial, ["query_id"], [F.desc("score"), F.col("id")], k, "rank")
