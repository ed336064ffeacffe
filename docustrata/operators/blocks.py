"""Retrieval units: semantic blocks packed greedily in document order, and document cards."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docustrata.functions.text import context_key, heading_label, rendered_node
from docustrata.session import durable
from docustrata.sources.files import Settings

MIN_CHARS, TARGET_CHARS, MAX_CHARS, MAX_NODES = 700, 1200, 1800, 12
CARD_HEADINGS, CARD_ALIASES, CARD_FRAGMENTS = 16, 12, 3


#: Nodes that a task packs about.
PART_ROWS = 200_000


class _Packer:
    """Packs nodes of one version after the other; ``state`` is (version, characters, nodes, last context) of the open block."""

    def __init__(self, least: int, target: int, most: int, max_nodes: int, state: tuple = (None, 0, 0, None)) -> None:
        self.bounds, self.state = (least, target, most, max_nodes), state

    def starts(self, versions: list, contexts: list, kinds: list, sizes: list) -> list[bool]:
        """Whether each node begins a block."""
        least, target, most, max_nodes = self.bounds
        version, chars, count, last = self.state
        out = []
        for v, ctx, kind, n in zip(versions, contexts, kinds, sizes):
            if v != version:
                version, chars, count, last = v, 0, 0, None
            if count:
                closed = chars >= least and (count >= max_nodes or chars >= most or ctx != last or kind in ("section", "appendix", "table"))
                if closed or chars + n + 1 > most:
                    chars, count = 0, 0
            out.append(not count)
            chars, count, last = chars + n + (1 if count else 0), count + 1, ctx
            if chars >= target or count >= max_nodes:
                chars, count = 0, 0
        self.state = version, chars, count, last if count else None
        return out


def block_numbers(nodes: DataFrame, least: int = MIN_CHARS, target: int = TARGET_CHARS, most: int = MAX_CHARS, max_nodes: int = MAX_NODES, part_rows: int | None = None) -> DataFrame:
    """Add block_no: version_id, order_index, id, ctx, node_type, n_chars -> the same with the number of the node's block.

    A block is closed before a node once it has ``least`` characters and is full or the node opens another context, or if the node
    doesn't fit; and after a node at ``target``. Packing is sequential, but what is open at a point hardly ever depends on what was open
    a few blocks before. So rows are range-partitioned in order, a version of any size over many tasks; each task packs as if nothing were
    open at its start, and the tasks whose start turns out to be another are packed again with what the one before left open, until no
    start changes (the second round, as a rule). A task streams over its rows and reports one row.
    """
    spark = nodes.sparkSession
    own = nodes.select("version_id", "order_index", "id", "ctx", "node_type", "n_chars")
    own = durable(own)
    count = max(1, -(-own.count() // (part_rows or PART_ROWS)))
    order = ["version_id", "order_index", "id"]
    placed = durable(own.repartitionByRange(count, *order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()))
    bounds = least, target, most, max_nodes

    def packed(batches: Iterator[pa.RecordBatch], opened: dict[int, tuple]) -> Iterator[tuple]:
        packer = None
        for batch in batches:
            if not batch.num_rows:
                continue
            version, ctx, kind, size = (batch.column(i).to_pylist() for i in (0, 3, 4, 5))
            if packer is None:
                packer = _Packer(*bounds, opened.get(batch.column(6)[0].as_py(), (None, 0, 0, None)))
            yield batch, version, packer.starts(version, ctx, kind, size), packer

    def reports(only: list[int] | None, opened: dict[int, tuple]) -> dict[int, tuple]:
        shared = spark.sparkContext.broadcast(opened)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            first, last, begun, part, packer = None, None, 0, None, None
            for batch, version, starts, packer in packed(batches, shared.value):
                first, part = version[0] if part is None else first, batch.column(6)[0].as_py()
                for v, s in zip(version, starts):
                    last, begun = v, (begun if v == last else 0) + s
            if part is not None:
                yield pa.RecordBatch.from_pydict({"part": [part], "first": [first], "last": [last], "begun": [begun], "chars": [packer.state[1]], "count": [packer.state[2]], "ctx": [packer.state[3]]}, pa.schema([("part", pa.int32()), ("first", pa.string()), ("last", pa.string()), ("begun", pa.int64()), ("chars", pa.int64()), ("count", pa.int64()), ("ctx", pa.string())]))

        rows = placed if only is None else placed.where(F.col("_part").isin(only))
        return {r.part: (r["first"], r["last"], r.begun, (r["last"], r.chars, r["count"], r.ctx)) for r in rows.mapInArrow(run, "part int, first string, last string, begun bigint, chars bigint, count bigint, ctx string").collect()}

    told = reports(None, {})
    opened: dict[int, tuple] = {}
    while True:
        line = sorted(told)
        left = {b: told[a][3] for a, b in zip(line, line[1:]) if told[a][3][0] == told[b][0] and told[a][3][2]}
        changed = [p for p in line if left.get(p) != opened.get(p)]
        opened = left
        if not changed:
            break
        told |= reports(changed, opened)
    before: dict[int, int] = {}
    for a, b in zip(line, line[1:]):  # blocks of the part's first version that began in parts before it
        if told[a][1] == told[b][0]:
            before[b] = told[a][2] + (before.get(a, 0) if told[a][0] == told[a][1] else 0)
    shared = spark.sparkContext.broadcast((opened, before))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, at, begun = None, None, shared.value[1]
        for batch, version, starts, _ in packed(batches, shared.value[0]):
            out = []
            for v, s in zip(version, starts):
                if at is None:
                    last, at = v, begun.get(batch.column(6)[0].as_py(), 0)
                elif v != last:
                    last, at = v, 0
                at += s
                out.append(at - 1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(out, pa.int32())], [*batch.schema.names[:6], "block_no"])

    return placed.mapInArrow(number, "version_id string, order_index int, id string, ctx string, node_type string, n_chars int, block_no int")


def block_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes with text, one row per id, ready for packing: the rendered text, its length and context key."""
    one = nodes.where("id is not null and version_id is not null").groupBy("id").agg(F.min(F.struct("version_id", "order_index", "node_type", "label", "locator_normalized", "heading_path", "text")).alias("v")).select("id", "v.*")
    shown = rendered_node(F.col("label"), F.col("locator_normalized"), F.col("text"))
    filled = one.where(F.length(F.trim(F.coalesce("text", F.lit("")))) > 0)
    return filled.select("id", "version_id", "order_index", "node_type", "locator_normalized", "heading_path", shown.alias("rendered"), F.coalesce(context_key(F.col("heading_path")), F.lit("")).alias("ctx")).withColumn("n_chars", F.length("rendered"))


def semantic_blocks(nodes: DataFrame, settings: Settings = Settings()) -> DataFrame:  # noqa: B008
    """One row per block: version_id, block_no, start_order, end_order, n_nodes, anchor_order, locator, heading_path, text.

    The anchor is the last node with a locator, else the first heading, else the first node.
    """
    ready = block_nodes(nodes)
    limits = settings.block_min_chars, settings.block_target_chars, settings.block_max_chars, settings.block_max_nodes
    numbered = block_numbers(ready, *limits).select("id", "block_no").join(ready, "id")
    head = F.col("node_type").isin("title", "section", "subsection", "appendix", "table")
    at = F.struct("order_index", "id")
    who = F.struct("order_index", "locator_normalized", "heading_path")
    grouped = numbered.groupBy("version_id", "block_no").agg(
        F.min("order_index").alias("start_order"),
        F.max("order_index").alias("end_order"),
        F.count(F.lit(1)).alias("n_nodes"),
        F.coalesce(F.max_by(who, F.when(F.length(F.coalesce("locator_normalized", F.lit(""))) > 0, at)), F.min_by(who, F.when(head, at)), F.min_by(who, at)).alias("a"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("order_index", "id", "rendered"))), lambda x: x["rendered"]), "\n").alias("text"),
    )
    return grouped.select("version_id", "block_no", "start_order", "end_order", "n_nodes", F.col("a.order_index").alias("anchor_order"), F.col("a.locator_normalized").alias("locator"), F.col("a.heading_path").alias("heading_path"), "text")


def document_cards(documents: DataFrame, aliases: DataFrame, nodes: DataFrame) -> DataFrame:
    """One card per document (document_id, display_code, normalized_code, title, version_id): document_id, card_text.

    Code, canonical code, title, then up to 12 aliases that are no URLs, 16 headings and 3 fragments, each in order. Lists are cut by
    ranks before they are collected, so nothing unbounded is gathered.
    """
    from docustrata.operators.relational import top

    names = top(aliases.where("alias_raw is not null and not contains(alias_raw, '://')").select("document_id", "alias_raw").distinct(), ["document_id"], [F.asc("alias_raw")], CARD_ALIASES)
    alias_text = names.groupBy("document_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rk", "alias_raw"))), lambda x: x["alias_raw"]), "; ").alias("aliases"))
    own = nodes.join(documents.select("document_id", "version_id"), "version_id").withColumn("heading", heading_label(F.col("node_type"), F.col("label"), F.col("title"), F.col("text")))
    heads = top(own.where("heading is not null and node_type in ('title', 'section', 'subsection', 'appendix')"), ["document_id"], [F.asc("order_index"), F.asc("id")], CARD_HEADINGS)
    heading_text = heads.groupBy("document_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rk", "heading"))), lambda x: x["heading"]), "; ").alias("headings"))
    pieces = top(own.where("node_type not in ('title', 'section') and length(trim(text)) > 0"), ["document_id"], [F.asc("order_index"), F.asc("id")], CARD_FRAGMENTS)
    fragment_text = pieces.groupBy("document_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rk", F.trim("text").alias("t")))), lambda x: x["t"]), "\n").alias("fragments"))
    joined = documents.join(alias_text, "document_id", "left").join(heading_text, "document_id", "left").join(fragment_text, "document_id", "left")
    return joined.select("document_id", F.concat_ws("\n", "display_code", "normalized_code", "title", "aliases", "headings", "fragments").alias("card_text"))
