"""File sources and sinks: JSON lines, settings, state files, appends, deletes, databases and the metrics text."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, fields, replace

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Settings:
    """What the engine can be told; defaults are the published ones."""

    block_min_chars: int = 700
    block_target_chars: int = 1200
    block_max_chars: int = 1800
    block_max_nodes: int = 12
    card_max_headings: int = 16
    discover_top_k: int = 8
    shortlist: int = 6
    lexical_top_k: int = 30
    dense_top_k: int = 30
    merged_top_k: int = 36
    rerank_top_k: int = 16
    evidence_pack: int = 8
    neighbour_window: int = 2
    ocr_low_confidence: float = 0.7
    chars_per_token: float = 4.0

    @classmethod
    def load(cls, path: str | None = None, **overrides) -> Settings:
        """From a JSON object; unknown names are an error, later overrides win."""
        told = json.loads(open(path, encoding="utf-8").read()) if path else {}
        told |= overrides
        unknown = set(told) - {f.name for f in fields(cls)}
        if unknown:
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        return replace(cls(), **told)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines under a schema; blank lines are skipped, a line that doesn't fit fails the query."""
    lines = spark.read.text(path).where(F.length(F.trim("value")) > 0)
    return lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("v")).select("v.*")


def append(df: DataFrame, path: str) -> None:
    """Add rows to a table."""
    df.write.mode("append").parquet(path)


def append_new(df: DataFrame, path: str, key: list[str]) -> int:
    """Add the rows whose key the table doesn't hold yet, and tell how many; running it again adds nothing. Repeated keys in ``df`` count once."""
    rows = df.dropDuplicates(key)
    if os.path.exists(path) or "://" in path:
        have = df.sparkSession.read.parquet(path).select(*key).distinct()
        rows = rows.join(have, key, "left_anti")
    seen = Observation()
    rows.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("append").parquet(path)
    return seen.get["n"]


def without_keys(df: DataFrame, gone: DataFrame, key: list[str]) -> DataFrame:
    """The rows that stay after a delete by key."""
    return df.join(gone.select(*key).distinct(), key, "left_anti")


def cascade(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Children whose parent still exists."""
    return children.join(parents.select(key).distinct(), key, "left_semi")


def read_state(path: str) -> dict:
    """A JSON state file, {} if there is none yet."""
    return json.loads(open(path, encoding="utf-8").read()) if os.path.exists(path) else {}


def write_state(path: str, state: dict) -> None:
    """Replace a JSON state file in one step."""
    with open(f"{path}.new", "w", encoding="utf-8") as f:
        json.dump(state, f, ensure_ascii=False, sort_keys=True)
    os.replace(f"{path}.new", path)


def read_database(spark: SparkSession, url: str, name: str, key: str | None = None, bounds: tuple[int, int, int] | None = None) -> DataFrame:
    """A database table through JDBC, read in ``bounds`` = (low, high, parts) ranges of an integer key where given."""
    options = {"url": url, "dbtable": name}
    if key and bounds:
        options |= {"partitionColumn": key, "lowerBound": str(bounds[0]), "upperBound": str(bounds[1]), "numPartitions": str(bounds[2])}
    return spark.read.format("jdbc").options(**options).load()


def write_database(df: DataFrame, url: str, name: str, mode: str = "append") -> None:
    """Rows into a database table through JDBC; a partition is one transaction."""
    df.write.format("jdbc").options(url=url, dbtable=name).mode(mode).save()


def write_metrics(lines: DataFrame, path: str) -> None:
    """Samples (column line) of the metrics text as one file; there is one row per metric and label set."""
    lines.select("line").coalesce(1).write.mode("overwrite").text(path)
