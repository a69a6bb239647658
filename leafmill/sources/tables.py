"""Tables that a plan reads several times, kept in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder where it is unset on one machine, an error on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="leafmill-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def kept(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back: computed once, and lost executors cost nothing."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def met(left: DataFrame, right: DataFrame, on: Sequence[str] | Column, how: str = "inner") -> DataFrame:
    """A join of two tables that grow with the corpus: both are exchanged and merged, none is broadcast.

    Spark takes a kept table for as large as its file. Columns that say the same of every document vanish in it: what it takes for
    4 MB, and would send through the driver, can be some hundred MB of rows.
    """
    return left.join(right.hint("merge"), on if isinstance(on, Column) else list(on), how)
