"""The general training-data queries: orphans, histories, hierarchies. Each runs over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docustrata.operators.hierarchy import descendants_of, hierarchy
from docustrata.operators.history import document_history
from docustrata.operators.orphans import final_ledger, periodic_counts
from docustrata.session import durable
from docustrata.sources.tables import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """References that are orphans after the last step: reference_id, field_name."""
    ledger = final_ledger(table(spark, folder, "document_references"), table(spark, folder, "document_registry"))
    return ledger.orphans().select("reference_id", "field_name").distinct()


def p1_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Orphans per field and month of created_at, after the last step."""
    return final_ledger(table(spark, folder, "document_references"), table(spark, folder, "document_registry")).snapshot()


def p1_snapshots(spark: SparkSession, folder: str) -> DataFrame:
    """Orphans per field and month of created_at at the end of every span: as_of (a day, 'end' for the last), field_name, period, n_references, n_orphans."""
    counts = periodic_counts(table(spark, folder, "document_references"), table(spark, folder, "document_registry"))
    return counts.select(F.coalesce(F.date_format("as_of", "yyyy-MM-dd"), F.lit("end")).alias("as_of"), "field_name", "period", "n_references", "n_orphans")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of equal states: document_id, valid_from, valid_to."""
    runs = document_history(table(spark, folder, "document_snapshots"))
    return runs.select("document_id", F.date_format("valid_from", "yyyy-MM-dd").alias("valid_from"), F.date_format("valid_to", "yyyy-MM-dd").alias("valid_to"))


def p2_history(spark: SparkSession, folder: str) -> DataFrame:
    """The full history with its states."""
    return document_history(table(spark, folder, "document_snapshots"))


def node_label() -> "F.Column":
    """The heading of a node, as it enters a path: label and title; a title node's text; none for other nodes without title."""
    own = F.concat_ws(" ", F.nullif(F.trim("label"), F.lit("")), F.nullif(F.trim("title"), F.lit("")))
    return F.when(F.nullif(F.trim("title"), F.lit("")).isNotNull(), own).when(F.col("node_type") == "title", F.trim("text"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Root and depth of every node: node_id, root_id, tree_depth."""
    nodes = table(spark, folder, "document_nodes").select("id", "parent_node_id", "version_id", "order_index")
    return hierarchy(nodes).select("node_id", "root_id", "tree_depth")


def p5_paths(spark: SparkSession, folder: str) -> DataFrame:
    """Root, depth and path of every node, and whether the stored heading_path agrees."""
    nodes = table(spark, folder, "document_nodes")
    tree = hierarchy(nodes, label=node_label())
    stored = nodes.where("id is not null").groupBy(F.col("id").alias("node_id")).agg(F.min("heading_path").alias("heading_path"))
    joined = tree.join(stored, "node_id", "left")
    verdict = F.when(F.col("is_cyclic"), "cyclic").when(F.col("heading_path").isNull(), "missing").when(F.col("heading_path") == F.col("path"), "equal").otherwise("differs")
    return joined.select("node_id", "root_id", "tree_depth", "path", "heading_path", verdict.alias("stored_path"))


def p5_intervals(spark: SparkSession, folder: str) -> DataFrame:
    """How many descendants each node has, and how long its interval on the tour is: node_id, n_descendants, span."""
    nodes = table(spark, folder, "document_nodes").select("id", "parent_node_id", "version_id", "order_index")
    return hierarchy(nodes).where("not is_cyclic").select("node_id", "n_descendants", (F.col("exit") - F.col("entry")).alias("span"))


def p5_descendants(spark: SparkSession, folder: str) -> DataFrame:
    """All descendants of every node: ancestor_id, node_id."""
    nodes = table(spark, folder, "document_nodes").select("id", "parent_node_id", "version_id", "order_index")
    return descendants_of(durable(hierarchy(nodes)))


QUERIES = {"p1_found": p1_found, "p1_counts": p1_counts, "p1_snapshots": p1_snapshots, "p2_found": p2_found, "p2_history": p2_history, "p5_found": p5_found, "p5_paths": p5_paths, "p5_intervals": p5_intervals, "p5_descendants": p5_descendants}
