"""Session helpers shared by every operator that keeps state between steps."""

from __future__ import annotations

import gc
import re
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int = 8, app: str = "strandloom") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package's code to the executors, once an application; they need not have it installed."""
    if spark.sparkContext.applicationId not in _shipped:
        package = Path(__file__).resolve().parent
        archive = shutil.make_archive(str(Path(tempfile.mkdtemp(prefix="strandloom-code-")) / package.name), "zip", package.parent, package.name)
        spark.sparkContext.addPyFile(archive)
        _shipped.add(spark.sparkContext.applicationId)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder named in spark.checkpoint.dir; a local one only where none is named and all runs on one machine.

    Checkpoints that are no longer needed are removed where ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="strandloom-checkpoint-"))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the rows to the shared checkpoint folder; later steps survive the loss of any executor."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def drop_shuffles(spark: SparkSession) -> None:
    """Let Spark remove the files of shuffles and checkpoints that nothing refers to any more; it does so only after the
    driver has collected its garbage, which between large steps may come too late for the disk."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Tasks of a step that sets their number by the size of its input; beyond it the partitions grow.
MOST_PARTITIONS = 50_000


def planned_bytes(df: DataFrame) -> int:
    """The size of the tables ``df`` reads, as Spark plans with it; 0 where it is not known. No data is read for it."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(n for n in sizes if n < 1 << 60)  # an unknown size is given as the largest number


def partitions_for(spark: SparkSession, df: DataFrame | None = None, each: int = 32 << 20, most: int = MOST_PARTITIONS) -> int:
    """The number of partitions the session is set to shuffle into or, where that is more, as many as give each ``each``
    bytes of the tables that ``df`` reads, and at most ``most``."""
    count = max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    return count if df is None else max(count, min(-(-planned_bytes(df) // each), most))
