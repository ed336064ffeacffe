"""Vector search: a stated set of query vectors against all rows, in blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from docustrata.operators.relational import top

#: Query vectors that are sent to the workers at once; further ones make further passes.
QUERY_BLOCK = 20_000


def search(queries: DataFrame, vectors: DataFrame, qid: str, key: str, vector: str, k: int) -> DataFrame:
    """The k rows nearest to each query by cosine similarity (others than itself): qid, key, score to 4 places, rk; ties by key.

    Queries go to the workers in blocks of a fixed size; each worker keeps k for each query and block, so what is shuffled is
    bounded by queries, not by pairs. Null vectors, vectors of nought and of another length than the query's are never near.
    """
    found, block = None, []
    kinds = to_arrow_type(queries.schema[qid].dataType), to_arrow_type(vectors.schema[key].dataType)

    def scan_for(block: list[tuple]) -> DataFrame:
        shared = queries.sparkSession.sparkContext.broadcast(([q for q, _ in block], [v for _, v in block]))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, rows = shared.value
            q = np.array(rows, np.float64).reshape(len(ids), -1)
            q = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)
            for batch in batches:
                keep = [(i, v) for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if v is not None and len(v) == q.shape[1] and any(v)]
                if not keep or not ids:
                    continue
                names = np.array([i for i, _ in keep])
                m = np.array([v for _, v in keep], np.float64)
                m /= np.linalg.norm(m, axis=1, keepdims=True)
                out: tuple[list, list, list] = ([], [], [])
                for lo in range(0, len(ids), 256):
                    s = np.round(q[lo : lo + 256] @ m.T, 4) + 0.0
                    for r, own in enumerate(ids[lo : lo + 256]):
                        row = np.where(names == own, -9.0, s[r])
                        best = np.lexsort((names, -row))[:k]
                        best = best[row[best] > -9]
                        out[0].extend([own] * len(best))
                        out[1].extend(names[best].tolist())
                        out[2].extend(row[best].tolist())
                yield pa.RecordBatch.from_arrays([pa.array(out[0], kinds[0]), pa.array(out[1], kinds[1]), pa.array(out[2], pa.float64())], [qid, key, "score"])

        names = queries.schema[qid].dataType.simpleString(), vectors.schema[key].dataType.simpleString()
        return vectors.where(F.col(key).isNotNull()).select(key, vector).mapInArrow(scan, f"`{qid}` {names[0]}, `{key}` {names[1]}, score double")

    for row in queries.where(F.col(vector).isNotNull()).select(F.col(qid), F.col(vector)).toLocalIterator():
        block.append((row[0], list(row[1])))
        if len(block) == QUERY_BLOCK:
            found = scan_for(block) if found is None else found.unionByName(scan_for(block))
            block = []
    if block or found is None:
        found = scan_for(block) if found is None else found.unionByName(scan_for(block))
    return top(found, [qid], [F.desc("score"), F.asc(key)], k)


def vote(neighbours: DataFrame, labels: DataFrame, qid: str, key: str, label: str) -> DataFrame:
    """The most frequent label among each query's neighbours (the least on a tie), and its share."""
    counted = neighbours.join(labels.select(F.col(key), F.col(label).alias("_label")), key).groupBy(qid, "_label").agg(F.count(F.lit(1)).alias("votes"))
    best = top(counted, [qid], [F.desc("votes"), F.asc("_label")], 1)
    return best.select(qid, F.col("_label").alias("predicted"), "votes")
