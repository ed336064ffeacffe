"""From questions to evidence packs: candidate documents, their versions, and what those versions hold for a question."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docustrata.functions.scores import cosine, hash_embedding
from docustrata.functions.text import distinct_tokens
from docustrata.operators import evidence, lexical, resolve, vector
from docustrata.operators.relational import top
from docustrata.session import durable

SHORTLIST, DISCOVERED, HITS, DIMS = 6, 8, 30, 64


def one_of(c: Column, values: list | None) -> Column:
    """Whether a column is one of the values; no values are no condition."""
    return F.coalesce(c.isin(*values), F.lit(False)) if values else F.lit(True)


def question_vectors(questions: DataFrame, qid: str, text: str, dims: int = DIMS) -> DataFrame:
    """qid and vector (array of ``dims`` numbers, hashed) of each question that has a token."""
    sparse = hash_embedding(questions, qid, text, dims).groupBy(qid).agg(F.map_from_entries(F.collect_list(F.struct("dim", "value"))).alias("_m"))
    return sparse.select(qid, F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.coalesce(F.try_element_at("_m", i), F.lit(0.0))).alias("vector"))


def usable_vector(c: Column, dims: int = DIMS) -> Column:
    """Whether a stored vector can be compared: as many numbers as the questions', all finite, not all nought."""
    return F.coalesce((F.size(c) == dims) & F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(c, lambda x: x != 0), F.lit(False))


def semantic_hits(asked: DataFrame, vectors: DataFrame, units: DataFrame, qid: str, unit_types: list[str] | None = None, k: int = HITS) -> DataFrame:
    """The k units nearest to a question among the versions it is limited to: asked (qid, version_id), vectors (qid, vector): hits.

    units: unit_id, version_id, unit_type, start_order_index, locator_primary, heading_path, embedding; those without a usable vector are no hits.
    """
    pool = units.where(one_of(F.col("unit_type"), unit_types) & usable_vector(F.col("embedding")) & F.col("version_id").isNotNull())
    near = asked.select(qid, "version_id").join(vectors, qid).join(pool, "version_id")
    score = F.bround(F.greatest(F.lit(0.0), cosine(F.col("vector"), F.col("embedding"))), 4)
    hits = near.select(qid, F.lit("retrieval_unit_dense").alias("source_kind"), score.alias("score"), "version_id", F.col("unit_id").alias("hit_id"), F.col("start_order_index").alias("order_index"), F.col("locator_primary").alias("locator"), "heading_path")
    return top(hits, [qid], [F.desc("score"), F.asc("hit_id")], k).drop("rk")


def near_cards(vectors: DataFrame, units: DataFrame, documents: DataFrame, qid: str, k: int = HITS) -> DataFrame:
    """Documents (document_id, version_id) of the k document cards nearest to each question: qid, document_id, distance."""
    cards = units.where((F.col("unit_type") == "document_card") & usable_vector(F.col("embedding")))
    near = vector.search(vectors.withColumnRenamed("vector", "embedding"), cards, qid, "unit_id", "embedding", k)
    of = cards.select("unit_id", "version_id").join(documents.where("version_id is not null").groupBy("version_id").agg(F.min("document_id").alias("document_id")), "version_id")
    return near.join(of, "unit_id").select(qid, "document_id", (F.lit(1.0) - F.col("score")).alias("distance"))


def candidate_documents(questions: DataFrame, documents: DataFrame, aliases: DataFrame, cards: DataFrame, dense: DataFrame | None = None, qid: str = "item_id", topics: tuple = ()) -> DataFrame:
    """Documents of parsed questions, ranked: those that the codes name; for questions whose codes name none those whose cards fit; else those
    whose code or title has a token of the question: qid, document_id, display_code, score, rk.

    documents: document_id, normalized_code, display_code, title, status_normalized; cards: document_id, card_text; dense: qid, document_id, distance.
    """
    named = durable(resolve.resolved(questions, qid, documents, aliases).select(qid, "document_id", "score"))
    open_ = durable(questions.join(named.select(qid).distinct(), qid, "left_anti").select(qid, "normalized_text"))
    found = durable(resolve.discovered(open_, cards, None if dense is None else dense.join(open_.select(qid), qid, "left_semi"), qid, "normalized_text", DISCOVERED).select(qid, "document_id", "score"))
    rest = open_.join(found.select(qid).distinct(), qid, "left_anti")
    plain = documents.select("document_id", F.concat_ws(" ", "display_code", "normalized_code", "title").alias("_text"))
    last = lexical.best_overlaps(rest, plain, qid, "normalized_text", "document_id", "_text", DISCOVERED).select(qid, "document_id", "score")
    status = F.lower(F.coalesce("status_normalized", F.lit("")))
    facts = documents.select("document_id", "display_code", "title", (status == "active").alias("is_active"), (status == "inactive").alias("is_outdated"))
    every = named.unionByName(found).unionByName(last).join(facts, "document_id").join(questions.select(qid, "codes", "tokens"), qid)
    ranked = resolve.reranked(every, qid, DISCOVERED, topics)
    explicit = named.select(qid, F.lit(SHORTLIST).alias("_most")).distinct()
    return ranked.join(explicit, qid, "left").where(F.col("rk") <= F.coalesce("_most", F.lit(DISCOVERED))).drop("_most")


def scoped_versions(candidates: DataFrame, questions: DataFrame, versions: DataFrame, qid: str) -> DataFrame:
    """The versions (document_id, version_id) that each question is limited to: qid, version_id, rk."""
    return resolve.scope(candidates.join(versions, "document_id"), questions, qid)


def locator_items(units: DataFrame, nodes: DataFrame) -> DataFrame:
    """Units and nodes as a locator is looked up in them: kind, version_id, hit_id, order_index, locator, heading_path."""
    u = units.select(F.lit("retrieval_unit").alias("kind"), "version_id", F.col("unit_id").alias("hit_id"), F.col("start_order_index").alias("order_index"), F.col("locator_primary").alias("locator"), "heading_path")
    n = nodes.select(F.lit("document_node").alias("kind"), "version_id", F.col("id").alias("hit_id"), "order_index", F.col("locator_normalized").alias("locator"), "heading_path")
    return u.unionByName(n)


def question_hits(questions: DataFrame, scope: DataFrame, units: DataFrame, nodes: DataFrame, vectors: DataFrame, qid: str = "item_id") -> DataFrame:
    """All hits of questions within their versions: by locator, by words, and by vectors of semantic blocks."""
    wanted = scope.select(qid, "version_id").join(questions.select(qid, F.explode("locators").alias("wanted")), qid)
    by_locator = evidence.locator_hits(wanted, locator_items(units, nodes), qid, HITS)
    asked = scope.select(qid, "version_id").join(questions.select(qid, "tokens"), qid)
    by_words = lexical.scoped_overlaps(asked, lexical.version_pool(units, nodes), qid, HITS)
    by_vector = semantic_hits(scope, vectors, units, qid, ["semantic_block"])
    columns = [qid, *evidence.HIT]
    return by_locator.select(columns).unionByName(by_words.select(columns)).unionByName(by_vector.select(columns))


def read_nodes(wanted: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes by their ids (wanted: id) as hits of score 1.0; ids without a node give none."""
    got = nodes.join(wanted.select("id").distinct(), "id", "left_semi")
    return got.select(F.lit("document_node").alias("source_kind"), F.lit(1.0).alias("score"), "version_id", F.col("id").alias("hit_id"), "order_index", F.col("locator_normalized").alias("locator"), "heading_path")


def substantial(tokens: Column, codes: Column, filler: list[str]) -> Column:
    """Whether a question says something besides codes and filler words: a token longer than two characters that is neither."""
    coded = F.flatten(F.transform(codes, distinct_tokens))
    return F.exists(tokens, lambda t: (F.length(t) > 2) & ~t.isin(*filler) & ~F.array_contains(coded, t))
