"""From hits to evidence: locator lookup, fusion and reranking, local context, evidence packs and their quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docustrata.functions.scores import locator_score
from docustrata.operators.relational import enclosing, top

#: What each kind of hit gains when hits are merged.
KIND_BONUS = {
    "retrieval_unit_locator": 0.42,
    "retrieval_unit_locator_context": 0.30,
    "retrieval_unit_context": 0.22,
    "document_node_locator": 0.02,
    "document_node_locator_context": -0.02,
    "retrieval_unit_lexical": 0.18,
    "retrieval_unit_dense": 0.15,
    "document_card_dense": 0.15,
    "document_node": -0.04,
}
LOCATOR_BONUS = 0.05
MERGED, SURVIVORS, PACK, CONTEXT_HITS, WINDOW = 36, 16, 8, 4, 2
#: Columns of a hit; hit_id names the node or unit and is unique within its kind.
HIT = ["source_kind", "score", "version_id", "hit_id", "order_index", "locator", "heading_path"]


def locator_hits(asked: DataFrame, items: DataFrame, qid: str, k: int = 30) -> DataFrame:
    """Items (kind, version_id, hit_id, order_index, locator, heading_path) that answer a question's locator (qid, version_id, wanted): hits.

    The source kind is the item's with _locator for the same locator, _locator_context for one near it; k for each question, version and
    locator. Null locators and headings count as ''.
    """
    joined = asked.join(items, "version_id")
    score = locator_score(F.col("wanted"), F.col("locator"), F.col("heading_path"))
    kind = F.concat("kind", F.when(F.col("locator") == F.col("wanted"), "_locator").otherwise("_locator_context"))
    hits = joined.select(qid, "wanted", kind.alias("source_kind"), score.alias("score"), "version_id", "hit_id", "order_index", "locator", "heading_path").where("score > 0")
    return top(hits, [qid, "version_id", "wanted"], order(), k).select(qid, *HIT)


def order() -> list[Column]:
    """Hits by score, then position, then kind and id, so ranks never depend on the order of rows."""
    return [F.desc("score"), F.asc(F.coalesce("order_index", F.lit(0))), F.asc("source_kind"), F.asc("hit_id")]


def merged(hits: DataFrame, qid: str, with_locators: DataFrame | None = None, merge: int = MERGED, keep: int = SURVIVORS, final_order: str = "raw") -> DataFrame:
    """Merge hits: each (kind, id) once with its best score, the first ``merge`` reranked by kind, ``keep`` of them kept: hits and rk.

    ``with_locators``: the questions (qid) that name a locator; their hits with one gain more. The kept hits have their raw scores and,
    by default, that order; final_order='rerank' keeps the rerank's.
    """
    best = top(hits, [qid, "source_kind", "hit_id"], [F.desc("score"), F.asc(F.coalesce("order_index", F.lit(0)))], 1).drop("rk")
    first = top(best, [qid], order(), merge, "_first")
    bonus = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in KIND_BONUS.items() for x in p]), F.col("source_kind")), F.lit(0.0))
    extra = F.lit(0.0)
    if with_locators is not None:
        first = first.join(with_locators.select(qid, F.lit(True).alias("_asked")).distinct(), qid, "left")
        extra = F.when(F.col("_asked") & (F.length(F.coalesce("locator", F.lit(""))) > 0), F.lit(LOCATOR_BONUS)).otherwise(F.lit(0.0))
    lifted = first.withColumn("_lifted", F.bround(F.col("score") + bonus + extra, 4))
    kept = top(lifted, [qid], [F.desc("_lifted"), F.asc(F.coalesce("order_index", F.lit(0))), F.asc("source_kind"), F.asc("hit_id")], keep, "_kept")
    by = order() if final_order == "raw" else [F.asc("_kept")]
    return kept.withColumn("rk", F.row_number().over(Window.partitionBy(qid).orderBy(*by))).select(qid, *HIT, "rk")


def with_context(hits: DataFrame, qid: str, blocks: DataFrame, nodes: DataFrame) -> DataFrame:
    """Hits (from merged) with what lies around the first four of them that are nodes: enclosing blocks at score + 0.12 up to 1.1, nodes beside at 0.8.

    blocks: version_id, hit_id, start_order, end_order, order_index, locator, heading_path; nodes: version_id, hit_id, order_index, locator, heading_path.
    """
    seeds = top(hits.where("startswith(source_kind, 'document_node') and order_index is not null"), [qid], [F.asc("rk")], CONTEXT_HITS, "_seed")
    around = enclosing(seeds.select(qid, "version_id", "order_index", F.col("score").alias("_s")), blocks.select("version_id", "hit_id", "start_order", "end_order", F.col("order_index").alias("block_order"), "locator", "heading_path"))
    context = around.groupBy(qid, "version_id", "hit_id", F.col("block_order").alias("order_index"), "locator", "heading_path").agg(F.max(F.bround(F.least(F.lit(1.1), F.col("_s") + 0.12), 4)).alias("score")).withColumn("source_kind", F.lit("retrieval_unit_context"))
    asked = seeds.select(qid, "version_id", F.col("order_index").alias("_anchor"), F.explode(F.sequence(F.col("order_index") - WINDOW, F.col("order_index") + WINDOW)).alias("order_index"))
    near = asked.join(nodes.select("version_id", "order_index", "hit_id", "locator", "heading_path"), ["version_id", "order_index"]).groupBy(qid, "version_id", "hit_id", "order_index", "locator", "heading_path").agg(F.max(F.when(F.col("order_index") == F.col("_anchor"), F.lit(1.0)).otherwise(F.lit(0.8))).alias("score")).withColumn("source_kind", F.lit("document_node"))
    return hits.select(qid, *HIT).unionByName(context.select(qid, *HIT)).unionByName(near.select(qid, *HIT))


def evidence_pack(hits: DataFrame, qid: str, blocks: DataFrame, nodes: DataFrame, with_locators: DataFrame | None = None, size: int = PACK) -> DataFrame:
    """Merged hits, their context, merged again, by raw score, the first ``size``: hits, rk and evidence_id (ev-0001 on)."""
    once = merged(hits, qid, with_locators)
    again = merged(with_context(once, qid, blocks, nodes), qid, with_locators)
    pack = again.where(F.col("rk") <= size)
    return pack.withColumn("evidence_id", F.format_string("ev-%04d", "rk"))


def evidence_quality(pack: DataFrame, qid: str, documents_of: DataFrame) -> DataFrame:
    """Per question: n_items, n_units, n_documents, dominant (hits of the most frequent document), has_locator, quality.

    A unit counts 4, a node 1, a locator 1 more, a heading path 1 more. documents_of: version_id, document_id.
    """
    joined = pack.join(documents_of, "version_id", "left")
    is_unit = F.startswith("source_kind", F.lit("retrieval_unit"))
    has = F.length(F.coalesce("locator", F.lit(""))) > 0
    headed = F.length(F.coalesce("heading_path", F.lit(""))) > 0
    per = joined.groupBy(qid, "document_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(is_unit).alias("u"), F.max(has.cast("int")).alias("l"), F.sum(F.when(is_unit, 4).otherwise(1) + has.cast("int") + headed.cast("int")).alias("q"))
    return per.groupBy(qid).agg(F.sum("n").alias("n_items"), F.sum("u").alias("n_units"), F.count("document_id").alias("n_documents"), F.max("n").alias("dominant"), (F.max("l") == 1).alias("has_locator"), F.sum("q").alias("quality"))


def suggested_mode(quality: DataFrame, mode: Column, explicit_document: Column, explicit_locator: Column, n_tokens: Column) -> DataFrame:
    """Add suggested_mode to evidence_quality's rows: clarify for short questions over scattered evidence, direct for strong evidence, else partial."""
    u, d, m, n, has = (F.col(c) for c in ("n_units", "n_documents", "dominant", "n_items", "has_locator"))
    clarify = ~explicit_document & ~explicit_locator & (n_tokens <= 4) & (d >= 2) & (m < 2) & ~has
    strong = (d == 1) & ((u >= 2) | ((u >= 1) & (has | (m >= 3) | (n >= 4))))
    dominant = (d <= 2) & (u >= 2) & (m >= 3) & (has | explicit_document | (n >= 4))
    direct = (strong | dominant) & (explicit_document | explicit_locator | has | (mode != "partial"))
    weak = mode.isin("no_answer", "clarify", "partial")
    out = F.when(n == 0, mode).when(clarify, "clarify").when(weak & direct, "direct").when(mode == "no_answer", "partial").otherwise(mode)
    return quality.withColumn("suggested_mode", out)
