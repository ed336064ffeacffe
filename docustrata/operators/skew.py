"""Equi-joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot from this share of all rows on; at most 1 / HOT_SHARE keys can be hot, which bounds the broadcast.
HOT_SHARE = 0.002
SALTS = 16


def hot_keys(df: DataFrame, keys: list[str], share: float = HOT_SHARE) -> DataFrame:
    """The keys that hold at least ``share`` of all rows: at most ``1 / share`` of them. Null keys are never hot."""
    counts = df.dropna(subset=keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n").alias("_all"))
    return counts.join(F.broadcast(total), F.col("_n") >= F.col("_all") * share).where(F.col("_n") > 1000).select(*keys)


def salted(df: DataFrame, hot: DataFrame, keys: list[str], spread: str, salts: int = SALTS) -> DataFrame:
    """Add column _salt: rows of hot keys are spread over ``salts`` values by the hash of ``spread``, others get 0."""
    marked = df.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), keys, "left")
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")).otherwise(F.lit(0))
    return marked.withColumn("_salt", salt).drop("_hot")


def replicated(df: DataFrame, hot: DataFrame, keys: list[str], salts: int = SALTS) -> DataFrame:
    """Copy the rows of hot keys once for each salt; rows of other keys stay single."""
    marked = df.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), keys, "left")
    copies = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    return marked.withColumn("_salt", F.explode(copies)).drop("_hot")
