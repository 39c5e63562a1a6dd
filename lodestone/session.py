"""Session helpers shared by every operator."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: int | str = 8, name: str = "lodestone", memory: str = "12g") -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Give a Python stage at least one partition per core.

    A file with a single row group is one scan task whatever its size; only then the rows are
    dealt out. Inputs that already have enough partitions, and plans that shuffle anyway (adaptive
    ones), are left alone, so that no shuffle is added and nothing runs ahead of time.
    """
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if too_few(df) else df


def too_few(df: DataFrame) -> bool:
    """Whether a plan without a shuffle has fewer partitions than there are cores."""
    plan = df._jdf.queryExecution()
    if plan.executedPlan().getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        return False
    return plan.toRdd().getNumPartitions() < df.sparkSession.sparkContext.defaultParallelism


#: Buckets of keys that ``distinct_rows`` tells apart; a set of them (8 bytes each) is the most it broadcasts.
BUCKETS = 1 << 20


def distinct_rows(rows: DataFrame, key: str = "id", flag: str | None = None) -> DataFrame:
    """The distinct rows, of which only those whose key may occur more than once cross the network.

    A narrow aggregate over the keys alone finds those that occur again; the buckets of their hashes are
    broadcast, at most ``BUCKETS`` numbers whatever the table's size. Rows in other buckets are passed on
    where they are, those in the marked ones go through a hash aggregate that combines on the map side.
    A bucket that is marked for another key only costs its rows the shuffle; with more repeated keys than
    buckets all rows are shuffled. ``flag`` names a column that
    is false for rows whose key occurs once for certain. Rows that lie in too few partitions have to be dealt
    out anyway (``spread``); then the one shuffle does both, unless the flag is wanted.
    """
    if too_few(rows):
        if flag is None:
            return rows.distinct()
        rows = spread(rows)
    bucket = F.pmod(F.xxhash64(key), F.lit(BUCKETS))
    again = F.broadcast(rows.groupBy(key).agg(F.count("*").alias("_n")).filter(F.col("_n") > 1).select(bucket.alias("_b")).distinct())
    rows = rows.withColumn("_b", bucket)
    once, more = rows.join(again, "_b", "left_anti").drop("_b"), rows.join(again, "_b", "left_semi").drop("_b").distinct()
    if flag is not None:
        once, more = once.withColumn(flag, F.lit(False)), more.withColumn(flag, F.lit(True))
    return once.unionByName(more)


def cut_lineage(df: DataFrame) -> DataFrame:
    """checkpoint() into the folder all executors share (``checkpoint_folder``).

    With ``spark.cleaner.referenceTracking.cleanCheckpoints``, which ``local_session`` sets and a cluster
    should, Spark deletes the files once nothing refers to the result any more."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Without that setting a temporary one, but only in local
    mode, where all tasks see it; on a cluster it must be named."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not sc.master.startswith("local"):
            raise RuntimeError("name a folder that all executors share in spark.checkpoint.dir")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="lodestone-"))
    return sc._jsc.sc().getCheckpointDir().get()
