"""Shared helpers of the training-data operators."""

from __future__ import annotations

import gc
import tempfile
import uuid
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions.shipping import ship

#: Documents whose crc32(doc_id as text) mod FOLDS is HELD_OUT are never learnt from.
FOLDS, HELD_OUT = 4, 2


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; a temporary one where it is unset on one machine (tests), an error on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="leafmill-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def saved(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back: cuts the lineage, survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.saved_at = path
    return out


def bucketed(df: DataFrame, by: str, key: list[str], label: str) -> DataFrame:
    """One row of each ``key`` (which holds ``by``), saved in buckets of ``by``, one for each shuffle partition: joins on it exchange only their other side."""
    spark, name = df.sparkSession, f"{label}_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = f"{shared_dir(spark)}/{name}"
    df.repartition(buckets, F.col(by)).dropDuplicates(key).write.bucketBy(buckets, by).option("path", path).saveAsTable(name)
    out = spark.table(name)
    out.saved_at, out.saved_as = path, name
    return out


def discard(df: DataFrame) -> None:
    """Delete the files of a :func:`saved` or :func:`bucketed` table that nothing will read again."""
    spark, path = df.sparkSession, df.saved_at
    if name := getattr(df, "saved_as", None):
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of finished steps, which it does when the driver's garbage is collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have yet, compared without case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def row_key(doc_id: Column, text_key: Column) -> Column:
    """Names a row by its doc_id and text, never null, so that joins need no null-safe comparison."""
    return F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("-")), text_key.cast("string"))


def without_marked(docs: DataFrame, key: Column, marked: DataFrame) -> DataFrame:
    """``docs`` without the rows whose ``key`` is in ``marked`` (key, stays), but for one row of each key that stays.

    The marks grow with the input, so they are merged with the documents at every size and never broadcast.
    """
    mine = fresh(docs, "_key")
    told, marked = docs.withColumn(mine, key), marked.withColumnRenamed("key", mine)
    left = told.join(marked.select(mine).hint("merge"), mine, "left_anti")
    if marked.where("stays").limit(1).count():
        left = left.unionByName(told.join(marked.where("stays").select(mine).hint("merge"), mine, "left_semi").dropDuplicates([mine]))
    return left.drop(mine)


#: A key is hot if it has more than one in so many of all rows; there are fewer such keys than that.
SHARE, LEAST_HOT = 1000, 10_000


def join_one(rows: DataFrame, one: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` (read more than once: a saved table) joined with ``one``, which has one row of each key at most; no key is null.

    The rows of hot keys stay where they are: their side of ``one``, fewer than SHARE rows at any size, is broadcast.
    All others meet by key.
    """
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > max(LEAST_HOT, rows.count() // SHARE))
    found = counts.select(*keys).collect()
    if not found:
        return rows.join(one, keys)
    hot = F.broadcast(rows.sparkSession.createDataFrame(found, counts.select(*keys).schema))
    return rows.join(hot, keys, "left_semi").join(F.broadcast(one.join(hot, keys, "left_semi")), keys).unionByName(rows.join(hot, keys, "left_anti").join(one, keys))


def held_out(doc_id: Column) -> Column:
    """True for the fold that no model may learn from; rows without a doc_id count as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(True))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/documents.parquet")


#: Rows that hold a vector of counts are cut into so many parts, and summed in so many groups first.
PARTS, GROUPS = 64, 64


def count_rows(counts: np.ndarray) -> pa.RecordBatch:
    """A vector of counts as rows (part, grp, counts), to be summed by :func:`summed`."""
    cuts = np.split(counts.astype("<i8"), PARTS)
    group = int(TaskContext.get().partitionId()) % GROUPS
    return pa.record_batch([pa.array(range(PARTS), pa.int32()), pa.array([group] * PARTS, pa.int32()), pa.array([zlib.compress(c.tobytes(), 1) for c in cuts], pa.binary())], ["part", "grp", "counts"])


COUNT_ROWS = "part int, grp int, counts binary"


def _sum(rows: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(zlib.decompress(b), "<i8") for b in rows["counts"])
    return pd.DataFrame({"part": [rows["part"].iloc[0]], "grp": [0], "counts": [zlib.compress(total.tobytes(), 1)]}).astype({"part": "int32", "grp": "int32"})


def summed(rows: DataFrame, size: int) -> np.ndarray:
    """The exact sum of all count vectors, in two levels; what comes to the driver has ``size`` numbers whatever the input."""
    total = rows.groupBy("part", "grp").applyInPandas(_sum, COUNT_ROWS).groupBy("part").applyInPandas(_sum, COUNT_ROWS)
    found = {r["part"]: np.frombuffer(zlib.decompress(r["counts"]), "<i8") for r in total.collect()}
    return np.concatenate([found.get(p, np.zeros(size // PARTS, "<i8")) for p in range(PARTS)])
