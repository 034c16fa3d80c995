"""Cutting lineage through the cluster's checkpoint folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Partitions for each core in ``spread``.
SHARES = 4


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where the session names none, a temporary one in local mode, and on a cluster an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.match(r"local($|\[)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="larkfield-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read from there, for tables that several parts of a job read."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, *by: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, whose size the optimiser knows; in folders by the values of ``by``, if given."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *by: str) -> DataFrame:
    """``df`` dealt by ``by`` over more partitions than there are cores, for rows that few files hold and that are much work each."""
    n = SHARES * df.sparkSession.sparkContext.defaultParallelism
    if by and n == int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        n += 1  # else this is taken for the shuffle of a join before it, whose partitions are put together while they are small
    return df.repartition(n, *by)
