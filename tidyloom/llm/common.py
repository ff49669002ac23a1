"""Helpers that several operators share."""

from __future__ import annotations

import io
import sys
import types
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidyloom.names import HIDDEN
from tidyloom.session import checkpoint_dir, cut

#: Bytes and rows of one Arrow batch, so that a worker's memory does not depend on the lengths of texts.
BATCH_BYTES, BATCH_ROWS = 8 << 20, 2000


#: Rows up to which a counted table is broadcast: of a few numbers or one word each, so below 100 MB in memory.
BROADCAST_ROWS = 500_000


def column(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def narrow(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the identifier and the text; other columns, whatever their names, are left behind."""
    return df.select(column(id_col).alias("doc_id"), column(text_col).alias("text"))


def batches(spark: SparkSession) -> None:
    """Bound the batches that the session sends to Python workers, in bytes too."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def map_pandas(
    df: DataFrame, function: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str
) -> DataFrame:
    """``mapInPandas`` with batches of bounded bytes."""
    batches(df.sparkSession)
    return df.mapInPandas(function, schema)


def sized(df: DataFrame) -> DataFrame:
    """A table cut to the shared folder, marked for broadcasting if it was counted to be small."""
    df = cut(df)
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def fold(id_col: str | Column, n: int) -> Column:
    """crc32 of the identifier as text, modulo ``n``; null for a null identifier."""
    c = column(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(c.cast("string")) % F.lit(n)


def worker_state() -> dict:
    """A dict that lives as long as the Python worker, which Spark uses for many tasks."""
    name = "tidyloom_worker_state"
    return sys.modules.setdefault(name, types.ModuleType(name)).__dict__


def parquet(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def stratified(
    df: DataFrame, id_col: str, label_col: str, per_label: int, max_labels: int = 64, exact: bool = False, seed: int = 7
) -> DataFrame:
    """About ``per_label`` rows of each of the ``max_labels`` most frequent labels, chosen by a hash of the row.

    The choice depends on the rows only (not on their order or number), so a repeated run takes the same. A draw
    from rows that were drawn before needs another ``seed``: with the same, all of them have passed already. No
    label gets more than ``2 * per_label`` rows, however often rows or identifiers repeat, and none is
    crowded out by another; of more, those with the least hashes stay.
    """
    known = df.where(column(label_col).isNotNull() & column(id_col).isNotNull())
    counts = known.groupBy(column(label_col).alias("label")).count()
    counts = counts.orderBy(F.desc("count"), "label").limit(max_labels).collect()
    if not counts:
        return df.limit(0)
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["label"], min(1.0, per_label / r["count"]))])
    number, rank = HIDDEN + "number", HIDDEN + "rank"
    hashed = known.withColumn(number, F.xxhash64(*[column(c) for c in known.columns], F.lit(seed)))
    drawn = hashed.where(F.pmod(F.col(number), F.lit(1 << 20)) / F.lit(float(1 << 20)) < share[column(label_col)])
    order = W.partitionBy(column(label_col)).orderBy(number)
    return drawn.withColumn(rank, F.row_number().over(order)).where(F.col(rank) <= 2 * per_label).drop(number, rank)


def labelled_texts(docs: DataFrame, labels: DataFrame, label_col: str, per_label: int) -> DataFrame:
    """``(doc_id, text, label)`` of about ``per_label`` documents of each label, 0 and 1, in ``labels``.

    The labels are drawn first, so their number has a bound and the texts are not shuffled to meet them.
    """
    known = labels.select(F.col("doc_id").alias("label_id"), column(label_col).cast("int").alias("label"))
    drawn = stratified(known.where("label in (0, 1)").distinct(), "label_id", "label", per_label, 2)
    texts = narrow(docs, "doc_id", "text")
    return texts.join(F.broadcast(drawn.limit(4 * per_label)), F.col("doc_id") == F.col("label_id")).drop("label_id")


def join_hot(left: DataFrame, right: DataFrame, key: str | list[str], weight: str, parts: int = 1000) -> DataFrame:
    """Inner join where ``right`` has one row per key and ``weight``, the number of left rows of that key.

    Keys with more than 1/``parts`` of all left rows, of which there can be at most ``parts``, are
    broadcast, and their left rows are taken out before the rest is shuffled, in which no key can fill a task.
    """
    total = right.agg(F.sum(weight)).first()[0] or 0
    hot = F.broadcast(right.where(F.col(weight) > total / parts))
    rest = right.where(F.col(weight) <= total / parts)
    keys = [key] if isinstance(key, str) else key
    return left.join(hot, key).unionByName(left.join(F.broadcast(hot.select(*keys)), key, "left_anti").join(rest, key))


def new_folder(spark: SparkSession, name: str) -> str:
    """A new folder for files in the shared folder of the cluster, as a URI."""
    base = checkpoint_dir(spark)
    if base.startswith("/"):
        base = "file://" + base
    elif base.startswith("file:/") and not base.startswith("file://"):
        base = "file://" + base.removeprefix("file:")
    return f"{base}/tidyloom-{name}-{uuid.uuid4()}"


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    """The store and the path in it; any store that Arrow can open."""
    return fs.FileSystem.from_uri(uri)


def save_arrays(folder: str, **arrays: np.ndarray) -> str:
    """Write arrays to a file of a new name; its path."""
    store, base = file_system(folder)
    store.create_dir(base, recursive=True)
    name, data = f"{uuid.uuid4()}.npz", io.BytesIO()
    np.savez(data, **arrays)
    with store.open_output_stream(f"{base}/{name}") as out:
        out.write(data.getvalue())
    return f"{folder}/{name}"


def load_arrays(path: str) -> dict[str, np.ndarray]:
    store, at = file_system(path)
    with store.open_input_file(at) as stream:
        return dict(np.load(io.BytesIO(stream.read())))


def one_file_a_task(files: DataFrame) -> DataFrame:
    """Deal a counted list of files to as many tasks."""
    return files.repartition(max(1, min(files.count(), 100_000)))
