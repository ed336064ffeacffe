"""Small relational building blocks: unique rows, bounded windows, shards, neighbours, prefix and family joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docustrata.session import durable


def unique(df: DataFrame, key: str, *columns: str) -> DataFrame:
    """One row per key of the given columns; of differing rows the least. Null keys are left out."""
    picked = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*columns)).alias("_v"))
    return picked.select(key, "_v.*")


def top(df: DataFrame, by: list[str], order: list[Column], k: int, rank: str = "rk") -> DataFrame:
    """The first k rows of each group with their rank; Spark cuts to k before the shuffle (window group limit)."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= k)


def place_in(by: list[str], order: list[Column]) -> Column:
    """The place of a row in its group, from 1."""
    return F.row_number().over(Window.partitionBy(*by).orderBy(*order))


def lookup(df: DataFrame, key: str, values: list) -> DataFrame:
    """The rows of the named keys; the list reaches the scan as a filter. No values give no rows."""
    return df.where(F.col(key).isin(*values)) if values else df.limit(0)


def tail(df: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """The last n rows of each group; ``order`` is the reverse of the order."""
    return top(df, by, order, n, "_rk").drop("_rk")


#: Rows of ordered groups that a task holds about.
PART_ROWS = 200_000


def _parted(df: DataFrame, by: list[str], order: list[str], part_rows: int | None) -> DataFrame:
    """Rows in range partitions of the group and order, each with its number: a group of any size lies over consecutive parts."""
    df = durable(df)
    return durable(df.repartitionByRange(max(1, -(-df.count() // (part_rows or PART_ROWS))), *by, *order).withColumn("_part", F.spark_partition_id()))


def with_previous(df: DataFrame, by: list[str], order: list[str], columns: list[str], name: str, part_rows: int | None = None) -> DataFrame:
    """Add the given columns of the row before in the same group, as a struct; null for a group's first row. The order must be total.

    Windows hold one part of a group; where a part begins, the row before is the last one of the part before it.
    """
    placed = _parted(df, by, order, part_rows)
    own = F.struct(*columns)
    inner = placed.withColumn("_lag", F.lag(own).over(Window.partitionBy("_part", *by).orderBy(*order)))
    ends = placed.groupBy("_part", *by).agg(F.max_by(own, F.struct(*order)).alias("_end")).withColumn("_part", F.col("_part") + 1)
    return inner.join(ends, ["_part", *by], "left").withColumn(name, F.coalesce("_lag", "_end")).drop("_part", "_lag", "_end")


def numbered(df: DataFrame, by: list[str], order: list[str], name: str, part_rows: int | None = None) -> DataFrame:
    """Add the place of each row in its group, from 1: its place in a part of the group, and the rows of the parts before."""
    placed = _parted(df, by, order, part_rows)
    sizes = placed.groupBy("_part", *by).agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    inner = placed.withColumn("_at", F.row_number().over(Window.partitionBy("_part", *by).orderBy(*order)))
    return inner.join(before, ["_part", *by]).withColumn(name, (F.col("_at") + F.col("_before")).cast("int")).drop("_part", "_at", "_before")


def shard_of(key: Column, shards: int) -> Column:
    """The number of a key's shard: the start of its digest, so every engine deals alike and no global numbering is needed."""
    return (F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("bigint") % shards).cast("int")


def shard(df: DataFrame, key: str, shards: int, index: int) -> DataFrame:
    """One of ``shards`` disjoint parts of a table."""
    if not 0 <= index < shards:
        raise ValueError("index lies between 0 and shards")
    return df.where(shard_of(F.col(key), shards) == index)


def neighbours(anchors: DataFrame, nodes: DataFrame, window: int = 2) -> DataFrame:
    """Nodes within ``window`` positions of an anchor in the same version: anchor_order, order_index, score 1.0 for the anchor, 0.8 beside it.

    The band becomes an equi-join: each anchor asks for 2 * window + 1 positions.
    """
    asked = anchors.select("version_id", F.col("order_index").alias("anchor_order"), F.explode(F.sequence(F.col("order_index") - window, F.col("order_index") + window)).alias("order_index"))
    found = asked.join(nodes, ["version_id", "order_index"])
    return found.withColumn("score", F.when(F.col("order_index") == F.col("anchor_order"), F.lit(1.0)).otherwise(F.lit(0.8)))


def enclosing(points: DataFrame, ranges: DataFrame, width: int = 64) -> DataFrame:
    """Ranges (version_id, start_order, end_order) that hold a point (version_id, order_index): an equi-join on version and band."""
    banded = ranges.withColumn("_band", F.explode(F.sequence(F.floor(F.col("start_order") / width), F.floor(F.col("end_order") / width))))
    asked = points.withColumn("_band", F.floor(F.col("order_index") / width))
    return asked.join(banded, ["version_id", "_band"]).where(F.col("order_index").between(F.col("start_order"), F.col("end_order"))).drop("_band")


def prefix_matches(prefixes: DataFrame, values: DataFrame, prefix: str, value: str, boundary: str = "./ -") -> DataFrame:
    """Pairs whose value is the prefix or goes on with a boundary character: values are cut at their boundaries and joined by equality."""
    cuts = F.transform(F.filter(F.sequence(F.lit(1), F.length(value)), lambda i: F.contains(F.lit(boundary), F.substring(F.col(value), i, F.lit(1)))), lambda i: F.substring(F.col(value), F.lit(1), i - 1))
    stems = F.array_distinct(F.concat(cuts, F.array(F.col(value))))
    spread = values.where(F.col(value).isNotNull()).withColumn("_stem", F.explode(stems)).where("_stem <> ''")
    return prefixes.withColumn("_stem", F.col(prefix)).join(spread, "_stem").drop("_stem")
