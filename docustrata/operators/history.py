"""History of changing attributes from periodic snapshots: gaps and islands over all snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN_END = "9999-12-31"


def folded_status(c: Column) -> Column:
    """A status as it is compared: trimmed, lower case, blank as null."""
    return F.nullif(F.lower(F.trim(F.regexp_replace(c, r"^\s+|\s+$", ""))), F.lit(""))


def attribute_history(snapshots: DataFrame, entity: str, day: str, loaded: str, attributes: dict[str, Column]) -> DataFrame:
    """One row per run of equal states: entity, the attributes, valid_from, valid_to, n_snapshots, is_current.

    Of several loads of one entity and day the last counts (equal load times: the greatest attribute values, so ties are
    settled alike every time); that choice is a partial aggregate, so an entity with very many repeated loads is reduced
    before it is shuffled, and a window holds at most one row per entity and day. Rows without entity or day have no place
    in a history and are left out. Nulls equal each other. A missing period ends nothing, a state that returns is a new run,
    and the last run is open until 9999-12-31.
    """
    names = list(attributes)
    state = F.struct(*[attributes[a].alias(a) for a in names])
    rows = snapshots.where(F.col(entity).isNotNull() & F.col(day).isNotNull()).select(F.col(entity).alias("_entity"), F.col(day).alias("_day"), F.struct(F.col(loaded).alias("at"), state.alias("state")).alias("_load"))
    last = rows.groupBy("_entity", "_day").agg(F.max("_load").alias("_load")).select("_entity", "_day", "_load.state")
    hashed = last.withColumn("_hash", F.sha2(F.to_json("state", {"ignoreNullFields": "false"}), 256))
    by_day = Window.partitionBy("_entity").orderBy("_day")
    marked = hashed.withColumn("_new", (~F.col("_hash").eqNullSafe(F.lag("_hash").over(by_day))).cast("int"))
    islands = marked.withColumn("_island", F.sum("_new").over(by_day))
    runs = islands.groupBy("_entity", "_island").agg(F.first("state").alias("state"), F.min("_day").alias("valid_from"), F.count(F.lit(1)).alias("n_snapshots"))
    following = F.lead("valid_from").over(Window.partitionBy("_entity").orderBy("_island"))
    runs = runs.withColumn("_next", following)
    return runs.select(F.col("_entity").alias(entity), *[F.col(f"state.{a}").alias(a) for a in names], "valid_from", F.coalesce("_next", F.lit(OPEN_END).cast("date")).alias("valid_to"), "n_snapshots", F.col("_next").isNull().alias("is_current"))


def document_history(snapshots: DataFrame) -> DataFrame:
    """The history of a document's status, current version and date of its text."""
    attributes = {"status_normalized": folded_status(F.col("status_normalized")), "current_version_id": F.col("current_version_id"), "text_actualized_at": F.col("text_actualized_at")}
    return attribute_history(snapshots, "document_id", "snapshot_date", "loaded_at", attributes)
