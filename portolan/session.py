"""Session set-up and the written tables that cut lineage in loops."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def local_session(cores: str = "*", app: str = "portolan") -> SparkSession:
    """A session for tests and the local bench; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def scratch_root(spark: SparkSession) -> str:
    """Shared folder for written intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``. Only a local master, where
    driver and executors share one disk, gets a folder of its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        root = tempfile.mkdtemp(prefix="portolan-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


class RoundTable:
    """A table written in rounds; every round adds one folder of Parquet files.

    A loop reads its last round or all rounds back from storage, so lineage stays
    one round long and a lost executor costs no earlier round.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
        self.rounds: list[str] = []
        self.schema = None
        self.rows = 0
        self.marks: dict = {}

    def add(self, df: DataFrame, **marks: Column) -> DataFrame:
        """Write a round; ``rows`` and the aggregates ``marks`` are taken while writing."""
        where = f"{self.path}/round{len(self.rounds):04d}"
        self.schema = self.schema or df.schema
        seen = Observation()
        df.observe(seen, F.count(F.lit(1)).alias("rows"), *[c.alias(n) for n, c in marks.items()]).write.parquet(where)
        self.marks = dict(seen.get)
        self.rows = self.marks.get("rows", 0)
        self.rounds.append(where)
        return self.spark.read.schema(self.schema).parquet(where)

    def all(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*self.rounds)


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """The same rows read back from a written table."""
    return RoundTable(df.sparkSession, name).add(df)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partitioned by ``keys`` over all cores, also where the data is small.

    For what costs much per row, such as Python work; a grouping by ``keys`` that
    follows needs no other shuffle.
    """
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(n, *keys)


def widen(df: DataFrame) -> DataFrame:
    """``df`` dealt out to all cores when its scan has fewer splits than there are cores.

    For callers that know their input to be few files with costly work per row; no operator does it by itself.
    """
    splits = df._jdf.queryExecution().toRdd().getNumPartitions()
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if splits < cores else df


def fits(df: DataFrame, rows: int) -> bool:
    """True when ``df`` has at most ``rows`` rows; reads no more than ``rows + 1``."""
    return df.limit(rows + 1).count() <= rows
