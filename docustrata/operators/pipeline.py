"""Whole passes put together from the operators: derived tables of a corpus, and their rebuild in resumable parts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docustrata.functions.codes import is_placeholder
from docustrata.functions.text import chunk_hash, distinct_tokens, is_blank, locator, normalize_code, squeeze
from docustrata.operators import blocks, versions
from docustrata.operators.relational import shard, unique


def derived_units(documents: DataFrame, nodes: DataFrame, aliases: DataFrame) -> DataFrame:
    """Retrieval units of the documents' current versions: one card each and the semantic blocks; units of other versions are not made.

    documents: document_id, normalized_code, display_code, title, current_version_id. A node with several rows counts once.
    """
    nodes = unique(nodes, "id", "version_id", "order_index", "node_type", "label", "title", "text", "locator_normalized", "heading_path")
    docs = documents.where("current_version_id is not null").withColumnRenamed("current_version_id", "version_id")
    wanted = nodes.join(docs.select("version_id").distinct(), "version_id", "left_semi")
    packed = blocks.semantic_blocks(wanted).select("version_id", F.lit("semantic_block").alias("unit_type"), "start_order", "end_order", "locator", "heading_path", "text")
    cards = blocks.document_cards(docs, aliases, nodes).join(docs.select("document_id", "version_id"), "document_id")
    empty = F.lit(None).cast("int")
    both = packed.unionByName(cards.select("version_id", F.lit("document_card").alias("unit_type"), empty.alias("start_order"), empty.alias("end_order"), F.lit(None).cast("string").alias("locator"), F.lit(None).cast("string").alias("heading_path"), F.col("card_text").alias("text")))
    hashed = chunk_hash(*[F.col(c) for c in ("version_id", "unit_type", "start_order", "end_order", "text")])
    return both.withColumn("chunk_hash", hashed)


def pending_part(documents: DataFrame, done: DataFrame, shards: int, index: int) -> DataFrame:
    """The documents of one shard that a resumed rebuild still has to do."""
    return shard(documents, "document_id", shards, index).join(done.select("document_id").distinct(), "document_id", "left_anti")


def indexed_tokens(nodes: DataFrame, active: DataFrame) -> DataFrame:
    """Search tokens of the nodes of active versions; those of others are null, as an index clears them."""
    marked = nodes.join(active.select("version_id", F.lit(True).alias("_active")).distinct(), "version_id", "left")
    return marked.select("id", "version_id", F.when(F.col("_active"), distinct_tokens(F.col("text"))).alias("tokens"))


def rebuilt_aliases(documents: DataFrame, old: DataFrame, urls: DataFrame | None = None) -> DataFrame:
    """All aliases after a rebuild of ``documents``: theirs anew, those of other documents as they were."""
    new = versions.built_aliases(documents, urls)
    kept = old.join(documents.select("document_id").distinct(), "document_id", "left_anti")
    return kept.select(*new.columns).unionByName(new)


def enriched(nodes: DataFrame) -> DataFrame:
    """Nodes with the lookup form of their raw locator where they have none of their own."""
    return nodes.withColumn("locator_normalized", F.coalesce(F.nullif(F.trim("locator_normalized"), F.lit("")), locator(F.col("locator_raw"))))


def reindexed(documents: DataFrame, known: DataFrame, nodes: DataFrame) -> DataFrame:
    """Counts of a reindex of all documents (document_id, current_version_id): one row: documents_processed, indexed_documents, indexed_node_count, cleared_node_count.

    ``known``: all versions (document_id, version_id); nodes: id, version_id, text. Nodes of a current version are indexed, those of the
    document's other versions are cleared where they have tokens. Nodes are counted by version before anything is joined.
    """
    sizes = nodes.where("version_id is not null").groupBy("version_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.size(distinct_tokens(F.col("text"))) > 0).alias("filled"))
    own = known.where("version_id is not null").select("document_id", "version_id").distinct().join(documents.select("document_id", "current_version_id"), "document_id")
    counted = own.join(sizes, "version_id", "left").withColumn("_active", F.col("version_id") == F.col("current_version_id"))
    sums = counted.agg(F.coalesce(F.sum(F.when(F.col("_active"), F.col("n"))), F.lit(0)).alias("indexed_node_count"), F.coalesce(F.sum(F.when(~F.col("_active"), F.col("filled"))), F.lit(0)).alias("cleared_node_count"))
    docs = documents.agg(F.count(F.lit(1)).alias("documents_processed"), F.count("current_version_id").alias("indexed_documents"))
    return docs.withColumn("_one", F.lit(1)).join(sums.withColumn("_one", F.lit(1)), "_one").drop("_one")


def rebuilt_units(old: DataFrame, new: DataFrame, versions: DataFrame) -> DataFrame:
    """The unit table after a rebuild: of the versions that were looked at (version_id) only the new units, all others as they were.

    Rebuilding the same versions again changes nothing, so a part that was lost can be done anew.
    """
    kept = old.join(versions.select("version_id").distinct(), "version_id", "left_anti")
    return kept.select(*new.columns).unionByName(new)


def embedded(units: DataFrame, key: str, text: str, embed: Callable[[list[str]], list[list[float]]], batch: int = 64) -> DataFrame:
    """Vectors of texts from an outside model, ``batch`` texts at a call: key, embedding. Null and blank texts have none, and are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, batch):
                part = whole.slice(lo, batch)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(embed(part.column(1).to_pylist()), pa.list_(pa.float32()))], [key, "embedding"])

    pending = units.where(~is_blank(F.col(text))).select(key, text)
    return pending.mapInArrow(run, f"`{key}` {units.schema[key].dataType.simpleString()}, embedding array<float>")


def repaired_corpus(documents: DataFrame, codes: DataFrame | None = None) -> DataFrame:
    """What a repair does with each document (document_id, normalized_code, display_code, title): document_id, action.

    Placeholders are deleted: documents known by a stub code alone, and those whose code is listed (codes: code); all others stay.
    """
    listed = F.lit(False)
    if codes is not None:
        named = codes.select(normalize_code(F.col("code")).alias("normalized_code"), F.lit(True).alias("_listed")).distinct()
        documents, listed = documents.join(named, "normalized_code", "left"), F.coalesce("_listed", F.lit(False))
    return documents.select("document_id", F.when(listed | is_placeholder(F.col("display_code"), F.col("title")), "delete").otherwise("keep").alias("action"))


def persisted_cards(cards: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What the last card of each document makes of the registry: the documents after the upsert, and a download job for each accepted card.

    cards: card_id, document_id, document_code, document_title, card_status_raw, source_list_status_raw, seen_at; documents: document_id, display_code,
    title, status_normalized. Inactive and unknown cards change nothing; a known document takes the card's code and title where they are filled; a new one
    is added. Running it again gives the same.
    """
    taken = versions.accepted_cards(cards, documents).where("action in ('update', 'insert')")
    said = cards.select("card_id", "document_id", F.nullif(squeeze(F.col("document_code")), F.lit("")).alias("_code"), F.nullif(squeeze(F.col("document_title")), F.lit("")).alias("_title"))
    said = said.groupBy("card_id", "document_id").agg(F.min(F.struct("_code", "_title")).alias("c")).select("card_id", "document_id", "c.*")
    fresh = taken.join(said, ["card_id", "document_id"]).withColumn("_new", F.lit(True))
    after = documents.select("document_id", "display_code", "title", "status_normalized").join(fresh, "document_id", "full")
    rows = after.select("document_id", F.coalesce("_code", "display_code").alias("display_code"), F.coalesce("_title", "title").alias("title"), F.when(F.col("_new"), "active").otherwise(F.col("status_normalized")).alias("status_normalized"))
    return rows, fresh.select(F.lit("download_artifacts").alias("job_type"), "document_id", "card_id", "action")


def refreshed(old: DataFrame, new: DataFrame, failed: DataFrame, key: str = "document_id") -> tuple[DataFrame, DataFrame]:
    """Rows after a refresh, and its events: documents with new rows have only these, unless their rebuild failed (failed: key): those keep the old ones."""
    broken = failed.select(key).distinct()
    good = new.join(broken, key, "left_anti")
    touched = new.select(key).distinct()
    rows = old.join(good.select(key).distinct(), key, "left_anti").unionByName(good.select(*old.columns))
    events = touched.unionByName(broken).distinct().join(broken.withColumn("_broken", F.lit(True)), key, "left").select(key, F.when(F.col("_broken"), "refresh_failed").otherwise("refresh_completed").alias("status"))
    return rows, events
