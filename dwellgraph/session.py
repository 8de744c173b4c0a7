"""Session settings and lineage cutting."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cores: int | str = 8, app: str = "dwellgraph", memory: str = "8g") -> SparkSession:
    """A local session for tests and the benchmark; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # Small local data: keep all cores busy instead of merging small partitions.
        .config("spark.sql.adaptive.coalescePartitions.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder for checkpoints: the one the cluster names, a temporary one only in local mode."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = context.getCheckpointDir()
    if named:
        if current is None:
            context.setCheckpointDir(named)
        return named
    if current is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="dwellgraph-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialize on shared storage, so that neither plan nor recovery goes further back."""
    shared_dir(df.sparkSession)
    return _bounded(df.checkpoint(eager=True))


def _bounded(df: DataFrame) -> DataFrame:
    """A checkpointed frame without its reckoned size where that is beyond all bounds. Spark reckons a join as the product of its sides and hands that on through
    checkpoints, so in a chain of joins of a frame with itself the number of its digits doubles each time, until they fill the driver."""
    if df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 2**63:
        return df
    spark, plan = df.sparkSession, df._jdf.queryExecution().logical()
    sql, none = spark._jvm.org.apache.spark.sql, spark._jvm.scala.Option.empty()
    held = (plan.output(), plan.rdd(), plan.outputPartitioning(), plan.outputOrdering(), plan.isStreaming(), plan.stream())
    return DataFrame(sql.classic.Dataset.ofRows(spark._jsparkSession, sql.execution.LogicalRDD(*held, spark._jsparkSession, none, none)), spark)


def freed(spark: SparkSession) -> None:
    """Have the shuffle files deleted that nothing reads any more, as those of what was checkpointed. Spark deletes them when the driver's JVM happens to collect the
    frames they belong to, and in a loop that may be long after they have filled the disk."""
    gc.collect()  # frames in reference cycles
    spark._jvm.System.gc()


def stored(df: DataFrame, *by: str) -> DataFrame:
    """As `cut`, but in compressed columns, for frames of many narrow rows; these take several times the disk as a checkpoint. Order and partitions are not kept.
    A filter on the columns in by reads their files alone."""
    spark = df.sparkSession
    folder = f"{shared_dir(spark).rstrip('/')}/stored-{uuid.uuid4().hex}"
    freed(spark)  # of checkpoints before
    was = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")  # the files of this write's exchanges, which nothing else reads
    try:
        df.write.option("compression", "zstd").parquet(folder, partitionBy=list(by))
    finally:
        spark.conf.set(CLEANUP, was)
    return spark.read.schema(df.schema).parquet(folder)


def cut_partitioned(df: DataFrame, *by: str) -> DataFrame:
    """Materialize partitioned and sorted by columns, in a way that later joins on them know and use.

    A checkpoint keeps the partitioning of its plan only if that plan is not an adaptive one, so df is planned without adaptive execution; what
    needs that should be materialized before.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartition(parts, *by).sortWithinPartitions(*by)
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        done = _bounded(placed.checkpoint(eager=True))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    del df, placed
    freed(spark)
    return done


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python, once for a session's context, for clusters where it is not installed."""
    context = spark.sparkContext
    if getattr(context, "_dwellgraph_shipped", False):
        return
    package = os.path.dirname(os.path.abspath(__file__))
    staged = os.path.join(tempfile.mkdtemp(prefix="dwellgraph-"), "dwellgraph.zip")  # the driver's copy, from which Spark serves it
    with zipfile.ZipFile(staged, "w", zipfile.ZIP_DEFLATED) as archive:
        for folder, _, names in sorted(os.walk(package)):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    archive.write(path, os.path.join("dwellgraph", os.path.relpath(path, package)))
    context.addPyFile(staged)
    context._dwellgraph_shipped = True
