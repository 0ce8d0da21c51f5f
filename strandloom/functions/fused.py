"""The search of pairs by a Java class, which Spark's own compiler makes on the driver; executors get it as a jar."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NAME = "strandloom_pairs"
#: Pairs of one batch.
BATCH = 1_000_000

_made: dict[str, object] = {}


def _udf(spark: SparkSession) -> object:
    """An instance of the class, made once an application."""
    app = spark.sparkContext.applicationId
    if app not in _made:
        jvm, gateway = spark._jvm, spark.sparkContext._gateway
        compiler = jvm.org.codehaus.janino.SimpleCompiler()
        compiler.setParentClassLoader(jvm.Thread.currentThread().getContextClassLoader())
        compiler.cook((Path(__file__).parent / "PairSweep.java").read_text())
        jar = Path(tempfile.mkdtemp(prefix="strandloom-pairs-")) / "strandloom-pairs.jar"
        with zipfile.ZipFile(jar, "w") as out:
            for name, code in dict(compiler.getBytecodes()).items():
                out.writestr(f"{name.replace('.', '/')}.class", bytes(code))
        spark.sparkContext._jsc.addJar(str(jar))
        kind = compiler.getClassLoader().loadClass("PairSweep")
        _made[app] = kind.getConstructor(gateway.new_array(jvm.Class, 0)).newInstance(gateway.new_array(jvm.Object, 0))
    return _made[app]


def met_pairs(sides: DataFrame, limit: int, keep: int, halves: bool) -> DataFrame:
    """(a, b, d, n) of the two sides (idx, read, side) of each group (p, q): every pair within ``keep`` edits, and beyond it up
    to ``limit`` only how many there are (a, b null). With ``halves`` a group of p = q is one block that meets itself, and
    a < b; else a comes from side 0 and b from side 1."""
    spark = sides.sparkSession
    spark._jsparkSession.udf().register(NAME, _udf(spark), spark._jvm.org.apache.spark.sql.types.DataTypes.BinaryType)
    own = lambda c, side: F.collect_list(F.when(F.col("side") == side, F.col(c))).alias(f"{c}{side}")
    inner = F.col("p") == F.col("q") if halves else F.lit(False)
    groups = sides.where("read is not null").withColumn("idx", F.col("idx").cast("long")).groupBy("p", "q").agg(*[own(c, side) for side in (0, 1) for c in ("idx", "read")])
    found = groups.select("idx0", F.when(inner, F.col("idx0")).otherwise(F.col("idx1")).alias("idx1"), F.call_function(NAME, "read0", F.when(inner, F.col("read0")).otherwise(F.col("read1")), F.lit(limit), F.lit(keep), inner).alias("found"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y, found in zip(batch.column(0), batch.column(1), batch.column(2)):
                blob = found.as_buffer()
                far, near = np.frombuffer(blob, np.int64, limit + 1), np.frombuffer(blob, np.int32, offset=8 * (limit + 1)).reshape(-1, 3)
                x, y, beyond = x.values.to_numpy(), y.values.to_numpy(), np.flatnonzero(far)
                none = pa.nulls(len(beyond), pa.int64())
                yield pa.RecordBatch.from_arrays([none, none, pa.array(beyond, pa.int32()), pa.array(far[beyond], pa.int64())], names=["a", "b", "d", "n"])
                for at in range(0, len(near), BATCH):
                    i, j, d = near[at : at + BATCH].T
                    a, b = x[i], y[j]
                    if halves:
                        a, b = np.minimum(a, b), np.maximum(a, b)
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(d), pa.array(np.ones(len(a), np.int64))], names=["a", "b", "d", "n"])

    return found.mapInArrow(rows, "a long, b long, d int, n long")
