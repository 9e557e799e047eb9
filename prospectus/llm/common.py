"""What several operators need: tables, cut lineage, connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The whole table ``name`` below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``); only where that is unset, a temporary one."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
        found = sc.getCheckpointDir()
    return found


def cut(df: DataFrame) -> DataFrame:
    """``df`` checkpointed in the shared folder: for narrow rows that several jobs read."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as a Parquet table in the shared folder and read again: for wide rows that several jobs read."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/tables/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def components(links: DataFrame) -> DataFrame:
    """Connected components of the undirected ``links`` (``a``, ``b``, longs): rows (``node``, ``component``).

    ``component`` is the smallest node reachable. Alternating large and small stars: every node is tied to the smallest
    node it sees, until nothing changes. Links with a null end, loops and repeats count for nothing; no links give no
    rows. A node with very many links is a join key only; Spark splits such keys of its sort-merge joins.
    """
    ends = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    stars = cut(ends)
    state = _state(stars)
    while state[0]:
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lows = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("low"))
        large = both.where("v > u").join(lows, "u").select(F.col("v").alias("u"), F.col("low").alias("v"))
        large = large.distinct()
        lows = large.groupBy("u").agg(F.min("v").alias("low"))
        small = large.join(lows, "u").select(
            F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("low").alias("v")), F.struct("u", F.col("low").alias("v")))).alias("x")
        )
        stars = cut(small.select("x.*").where("u > v").distinct())
        now = _state(stars)
        if now == state:
            break
        state = now
    roots = stars.groupBy(F.col("v").alias("node")).agg(F.min("v").alias("component"))
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _state(stars: DataFrame) -> tuple[int, int]:
    """Number and order-free hash of the links; equal states mean that nothing changed."""
    row = stars.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], int(row[1] or 0)
