"""Lexical search: token sets, document frequencies, and overlap ranking of texts against a block of questions."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from docustrata.functions.text import distinct_tokens
from docustrata.operators.relational import top
from docustrata.session import kept

#: Questions that are sent to the workers at once; further ones make further passes.
QUERY_BLOCK = 5_000
#: Cells of texts by questions that a worker counts at once.
CELLS = 4_000_000


def postings(texts: DataFrame, key: str, text: str) -> DataFrame:
    """One row per key and distinct token."""
    return texts.select(key, text).select(F.col(key), F.explode(distinct_tokens(F.col(text))).alias("token"))


def document_frequencies(texts: DataFrame, key: str, text: str) -> DataFrame:
    """In how many texts each token occurs."""
    return postings(texts, key, text).groupBy("token").agg(F.count(F.lit(1)).alias("df"))


class _Index:
    """Which questions of a block hold a token."""

    def __init__(self, questions: list[tuple]) -> None:
        held: dict[str, list[int]] = {}
        for i, (_, tokens) in enumerate(questions):
            for t in tokens:
                held.setdefault(t, []).append(i)
        self.held = {t: np.array(v) for t, v in held.items()}
        self.sizes = np.array([max(1, len(tokens)) for _, tokens in questions])


def best_overlaps(queries: DataFrame, texts: DataFrame, qid: str, qtext: str, key: str, text: str, k: int, share: bool = True, carry: tuple[str, ...] = (), least: float = 0.0) -> DataFrame:
    """The k texts with the most tokens of each query in common: qid, key, carried columns, score, rk; ties by key.

    The score is the share of the query's distinct tokens to 4 places, or with ``share`` false their number. The queries go to the
    workers in blocks of a fixed size; a text is scored where it lies, and each task keeps k for each query, so what is shuffled is
    bounded by queries and tasks, not by pairs. Texts without a common token or without a key are no hits; of a key with several rows the best one counts.
    """
    kinds = {c: texts.schema[c].dataType.simpleString() for c in (key, *carry)}
    schema = ", ".join([f"`{qid}` {queries.schema[qid].dataType.simpleString()}", *(f"`{c}` {t}" for c, t in kinds.items()), "score double"])
    id_type = to_arrow_type(queries.schema[qid].dataType)
    rows = texts.where(F.col(key).isNotNull()).select(key, *carry, distinct_tokens(F.col(text)).alias("_tokens"))

    def scan_for(block: list[tuple]) -> DataFrame:
        shared = queries.sparkSession.sparkContext.broadcast({"questions": block})

        def first(found: pa.Table) -> pa.Table:
            """The k best of each query."""
            found = found.take(pc.sort_indices(found, sort_keys=[("_q", "ascending"), ("score", "descending"), (key, "ascending")]))
            q = found["_q"].to_numpy()
            at = np.arange(len(q))
            start = np.maximum.accumulate(np.where(np.r_[True, q[1:] != q[:-1]], at, 0)) if len(q) else at
            return found.filter(pa.array(at - start < k))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = kept(shared, "index", lambda fields: _Index(fields["questions"]))
            n, best = len(index.sizes), None
            for whole in batches:
                for lo in range(0, whole.num_rows, max(1, CELLS // n)):
                    batch = whole.slice(lo, max(1, CELLS // n))
                    cells = [index.held[t] + r * n for r, tokens in enumerate(batch.column("_tokens").to_pylist()) for t in tokens if t in index.held]
                    if not cells:
                        continue
                    cell, count = np.unique(np.concatenate(cells), return_counts=True)
                    row, q = cell // n, cell % n
                    score = np.round(count / index.sizes[q], 4) if share else count.astype(np.float64)
                    found = pa.Table.from_batches([batch.drop_columns(["_tokens"])]).take(pa.array(row)).append_column("_q", pa.array(q)).append_column("score", pa.array(score))
                    best = first(found if best is None else pa.concat_tables([best, found]))
            if best is not None:
                ids = pa.array([q for q, _ in shared.value["questions"]], id_type)
                out = best.append_column(qid, ids.take(best["_q"].combine_chunks())).select([qid, key, *carry, "score"])
                yield from out.combine_chunks().to_batches()

        return rows.mapInArrow(scan, schema)

    asked = queries.where(F.col(qid).isNotNull()).select(F.col(qid), distinct_tokens(F.col(qtext)).alias("t")).where(F.size("t") > 0)
    found, block = [], []
    for r in asked.toLocalIterator():
        block.append((r[0], list(r[1])))
        if len(block) == QUERY_BLOCK:
            found.append(scan_for(block))
            block = []
    if block or not found:
        found.append(scan_for(block or [(None, [])]))
    every = reduce(DataFrame.unionByName, found)
    every = every.where(F.col("score") >= least) if least else every
    best = top(every, [qid, key], [F.desc("score"), *[F.asc(c) for c in carry]], 1, "_one").drop("_one")
    return top(best, [qid], [F.desc("score"), F.asc(key)], k)


def search(queries: DataFrame, texts: DataFrame, qid: str = "item_id", qtext: str = "question", key: str = "doc_id", text: str = "text", k: int = 30) -> DataFrame:
    """The k texts with the greatest share of a query's tokens: query, key, score, rk; ties by key."""
    return best_overlaps(queries, texts, qid, qtext, key, text, k).select(qid, key, "score", "rk")


def search_counts(queries: DataFrame, texts: DataFrame, qid: str = "item_id", qtext: str = "question", key: str = "doc_id", text: str = "text", k: int = 10) -> DataFrame:
    """The k texts with the most tokens in common: query, key, overlap, rk."""
    return best_overlaps(queries, texts, qid, qtext, key, text, k, share=False).select(qid, key, F.col("score").cast("int").alias("overlap"), "rk")


def version_pool(units: DataFrame, nodes: DataFrame) -> DataFrame:
    """What is searched of each version: its units where it has any, else its nodes: source_kind, version_id, hit_id, order_index, locator, heading_path, text.

    units: unit_id, version_id, start_order_index, locator_primary, heading_path, text; nodes: id, version_id, order_index, locator_normalized, heading_path, text.
    """
    rest = nodes.join(units.select("version_id").distinct(), "version_id", "left_anti")
    kind = lambda k, i, o, c: [F.lit(k).alias("source_kind"), "version_id", F.col(i).alias("hit_id"), F.col(o).alias("order_index"), F.col(c).alias("locator"), "heading_path", "text"]
    return units.select(*kind("retrieval_unit_lexical", "unit_id", "start_order_index", "locator_primary")).unionByName(rest.select(*kind("document_node", "id", "order_index", "locator_normalized")))


def search_versions(queries: DataFrame, units: DataFrame, nodes: DataFrame, qid: str = "item_id", qtext: str = "question", k: int = 30) -> DataFrame:
    """Per version its units where it has any, else its nodes, ranked together: query, source_kind, version_id, hit_id, score, rk."""
    found = best_overlaps(queries, version_pool(units, nodes), qid, qtext, "hit_id", "text", k, carry=("source_kind", "version_id"))
    return found.select(qid, "source_kind", "version_id", "hit_id", "score", "rk")


def scoped_overlaps(asked: DataFrame, pool: DataFrame, qid: str, k: int) -> DataFrame:
    """The k items of a question's own versions with the most of its tokens: asked (qid, version_id, tokens), pool as version_pool gives it: qid, hit columns, score, rk.

    A question names few versions, so the join on the version is an equi-join whose rows are the items of those versions; the score is
    taken beside the text, and only keys and scores go on to the ranking.
    """
    own = F.array_distinct("tokens")
    joined = pool.where(F.col("version_id").isNotNull()).join(asked.select(qid, "version_id", own.alias("_asked")), "version_id")
    common: Column = F.size(F.array_intersect("_asked", distinct_tokens(F.col("text"))))
    scored = joined.select(qid, "source_kind", F.bround(common / F.nullif(F.size("_asked"), F.lit(0)), 4).alias("score"), "version_id", "hit_id", "order_index", "locator", "heading_path").where("score > 0")
    return top(scored, [qid], [F.desc("score"), F.asc("source_kind"), F.asc("hit_id")], k)
