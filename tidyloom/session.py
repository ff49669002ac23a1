"""Session settings and the checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    # Headers that differ only in case are different columns.
    "spark.sql.caseSensitive": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Many cell expressions in one projection give a generated method beyond the size
    # that the JVM compiles; from there on, separate smaller methods are faster.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # Recording the Python line of each expression doubles the time to plan wide tables.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(app_name: str = "tidyloom", **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    for key, value in {**SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder of the cluster, ``spark.checkpoint.dir``; in local mode a temporary one."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if configured:
            context.setCheckpointDir(configured)
        elif context.master.startswith("local"):
            context.setCheckpointDir(tempfile.mkdtemp(prefix="tidyloom-checkpoint-"))
        else:
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return context.getCheckpointDir()


# Paths of the tables that `cut` has written, by application.
_CUTS: dict[str, list[str]] = {}


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and go on from that table.

    Unlike a checkpoint of its partitions, a table lets each later step read only the
    columns it needs. It outlives the executors that wrote it.
    """
    if not df.columns:
        return df
    path = f"{checkpoint_dir(df.sparkSession)}/tidyloom-{uuid.uuid4()}"
    df.write.parquet(path)
    _CUTS.setdefault(df.sparkSession.sparkContext.applicationId, []).append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release_cuts(spark: SparkSession) -> int:
    """Delete the tables that ``cut`` has written in this application; how many there were.

    Call it when the results have been written: tables that were not yet read to the end
    depend on them.
    """
    paths = _CUTS.pop(spark.sparkContext.applicationId, [])
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in paths:
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(conf).delete(place, True)
    return len(paths)


def fit_shuffles(spark: SparkSession, paths: str | Sequence[str], task_bytes: int = 128 << 20) -> int:
    """Set ``spark.sql.shuffle.partitions`` so that the input, shuffled once, gives tasks of ``task_bytes``.

    Adaptive execution merges small partitions but adds none, so the default of 200 is too few
    from about 25 GB on. Sizes come from the listing; no file is read. Never lowers the setting.
    """
    listed = [paths] if isinstance(paths, str) else list(paths)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(listed)
    total = files.select("length").groupBy().sum().first()[0] or 0
    width = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // task_bytes))
    spark.conf.set("spark.sql.shuffle.partitions", str(width))
    return width
