"""Intermediate tables that several branches of one report read.

They are computed once and written to the cluster's shared folder. What reads them is planned from the stored rows, so the
work below is neither planned nor run again, and an executor that is lost later costs no recomputation.
"""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Only a local session that names none gets a temporary one."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
        found = sc.getCheckpointDir()
    return found


def shared(df: DataFrame) -> DataFrame:
    """``df`` as stored rows. For rows that are few next to the tables they come from: cohorts, counts, lists of keys."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
