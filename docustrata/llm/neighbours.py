"""The k most similar vectors of every vector, by shifted space-filling curves.

Vectors are scaled to length one and projected on the main directions of cluster centres, which are fitted on a bounded sample.
Each of CURVES Hilbert curves runs through another random rotation and shift of the projections. All (curve, key) rows are range-
partitioned and sorted in Spark; windows of neighbouring keys, which overlap, are compared densely on vectors of one byte a number,
each vector keeps its best of a window, and the lists of all curves merge. The merged candidates are reranked: each pair of them is
compared once on the stored vectors. Work per vector is CURVES windows, whatever the size of the table.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docustrata.operators.relational import top
from docustrata.session import durable

K = 5
CURVES = 16
#: Vectors whose neighbours are sought at once, and the share of a window that is looked at beyond either end of it.
WINDOW, MARGIN = 3328, 8
#: Vectors a task sorts; only at its ends a window has no margin.
TASK_ROWS = 12 * WINDOW
#: Entries of a window's list and of the merged one beyond k: what the rerank chooses from.
LIST_MORE, MERGED_MORE = 1, 3
#: Vectors per table, about, from which the directions and ranges are fitted; every vector is indexed.
SAMPLE = 20_000
_DIRECTIONS, _AXES, _BITS = 16, 8, 7


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Positions on the Hilbert curve of integer points, one row each; bits times axes must fit in 63."""
    x = cells.astype(np.int64).T.copy()
    axes = len(x)
    for level in range(bits - 1, 0, -1):
        low = (1 << level) - 1
        for i in range(axes):
            high = (x[i] >> level) & 1
            swap = np.where(high == 1, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(high == 1, low, swap)
            if i:
                x[i] ^= swap
    for i in range(1, axes):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        flip ^= np.where((x[-1] >> level) & 1 == 1, (1 << level) - 1, 0)
    x ^= flip
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for i in range(axes):
            key = (key << 1) | ((x[i] >> level) & 1)
    return key


class Curves:
    """Projection, ranges, rotations and shifts, fitted on a sample of unit vectors."""

    def __init__(self, sample: np.ndarray, curves: int, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        dims = sample.shape[1]
        self.mean = sample.mean(0) if len(sample) else np.zeros(dims, np.float32)
        keep = min(_DIRECTIONS, dims)
        centres = self._centres(sample, rng)
        _, _, directions = np.linalg.svd(np.vstack([centres - centres.mean(0), 1e-6 * np.eye(dims)]), full_matrices=False)
        axes = min(_AXES, keep)
        self.maps, self.low, self.scale = [], [], []
        for _ in range(curves):
            turn = np.linalg.qr(rng.standard_normal((keep, keep)))[0][:, :axes]
            to = (directions[:keep].T @ turn).astype(np.float32)
            seen = (sample - self.mean) @ to if len(sample) else np.zeros((1, axes))
            low, high = np.quantile(seen, 0.001, axis=0), np.quantile(seen, 0.999, axis=0)
            width = 2 * np.maximum(high - low, 1e-9)  # the sample fills half the range, the shift moves it in the other half
            self.maps.append(to)
            self.low.append(low - rng.random(axes) * width / 2)
            self.scale.append(1 / width)

    @classmethod
    def of(cls, fields: dict) -> Curves:
        """From the plain fields, as they are broadcast."""
        self = cls.__new__(cls)
        self.__dict__.update(fields)
        return self

    @staticmethod
    def _centres(sample: np.ndarray, rng: np.random.Generator, count: int = 256, rounds: int = 8) -> np.ndarray:
        if len(sample) <= count:
            return sample if len(sample) else np.zeros((1, sample.shape[1]))
        centres = sample[rng.choice(len(sample), count, replace=False)]
        for _ in range(rounds):
            nearest = (sample @ centres.T).argmax(1)
            sums = np.zeros_like(centres)
            np.add.at(sums, nearest, sample)
            norm = np.linalg.norm(sums, axis=1, keepdims=True)
            centres = np.where(norm > 0, sums / np.maximum(norm, 1e-12), centres)
        return centres

    def keys(self, vectors: np.ndarray, curve: int) -> np.ndarray:
        unit = ((vectors - self.mean) @ self.maps[curve] - self.low[curve]) * self.scale[curve]
        return hilbert_keys(np.clip(unit * (1 << _BITS), 0, (1 << _BITS) - 1).astype(np.int64), _BITS)


def usable(vectors: DataFrame, key: str, vector: str, dims: int) -> DataFrame:
    """One row per key: _id and the vector _v of the rows with exactly ``dims`` numbers, all finite and not all nought."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.where(F.col(key).isNotNull() & F.col(vector).isNotNull() & (F.size(vector) == dims)).where(finite & F.exists(vector, lambda x: x != 0))
    return rows.select(F.col(key).alias("_id"), F.col(vector).alias("_e")).groupBy("_id").agg(F.max("_e").alias("_v"))


def _unit(column: pa.Array) -> np.ndarray:
    """Vectors of length one; scaled by their largest number first, so none is too large or small for its length to be told."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    flat = flat / np.abs(flat).max(1, keepdims=True)
    return (flat / np.linalg.norm(flat, axis=1, keepdims=True)).astype(np.float32)


def _matrix(column: pa.Array, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def _binary(rows: np.ndarray) -> pa.Array:
    rows = np.ascontiguousarray(rows)
    width = rows.shape[1] * rows.itemsize
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(rows), [None, pa.py_buffer(rows.tobytes())]).cast(pa.binary())


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), _binary(_unit(batch.column(3)))], ["t", "vid", "_id", "u"])


def _best(block: np.ndarray, lo: int, hi: int, numbers: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and similarities of the k best others in the block of each of its rows lo to hi, padded with -1."""
    n = len(block)
    take = min(k, n - 1)
    who, how = np.full((hi - lo, k), -1, np.int64), np.full((hi - lo, k), -1, np.float32)
    for a in range(lo, hi if take else lo, 1024):
        b = min(a + 1024, hi)
        s = block[a:b] @ block.T
        rows = np.arange(b - a)
        s[rows, a + rows] = -9
        top = np.argpartition(s, n - take - 1, axis=1)[:, n - take :]
        who[a - lo : b - lo, :take], how[a - lo : b - lo, :take] = numbers[top], np.take_along_axis(s, top, 1)
    return who, how


def _windows(k: int, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held)
            numbers = t["vid"].to_numpy()
            flat = _matrix(t["v"], np.int8)
            edges = np.linspace(0, len(numbers), max(1, round(len(numbers) / window)) + 1).astype(int)
            for lo, hi in zip(edges, edges[1:]):
                first, end = max(0, lo - window // MARGIN), min(len(numbers), hi + window // MARGIN)
                block = flat[first:end].astype(np.float32)
                block /= np.linalg.norm(block, axis=1, keepdims=True)
                who, how = _best(block, lo - first, hi - first, numbers[first:end], k)
                step = np.clip(np.rint((how + 1) * 32767), 0, 65535).astype(np.uint16)  # similarities in steps of 3e-5
                both = np.concatenate([who.view(np.uint8).reshape(hi - lo, -1), step.view(np.uint8).reshape(hi - lo, -1)], axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(numbers[lo:hi]), _binary(both)], ["vid", "best"])
            held.clear()

        curve = None
        for batch in batches:
            if not batch.num_rows:
                continue
            c = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(c)) + 1).tolist(), len(c)]
            for a, b in zip(cuts, cuts[1:]):
                if held and curve != c[a]:
                    yield from flush()
                curve = c[a]
                held.append(batch.slice(a, b - a))
        if held:
            yield from flush()

    return run


def _merge(k: int, keep: int):
    """Lists of ``k`` from all curves to the ``keep`` best distinct candidates of each vector, as pairs with the smaller number first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            raw = np.frombuffer(b"".join(lists.flatten().to_pylist()), np.uint8).reshape(-1, k * 10)
            own = np.repeat(np.repeat(batch.column(0).to_numpy(), np.diff(lists.offsets.to_numpy())), k)
            who, how = raw[:, : k * 8].copy().view(np.int64).ravel(), raw[:, k * 8 :].copy().view(np.uint16).ravel().astype(np.int32)
            some = who >= 0
            own, who, how = own[some], who[some], how[some]
            order = np.lexsort((who, -how, own))
            own, who = own[order], who[order]
            # the same neighbour from several curves has the same score up to rounding: its first place counts
            seen = np.lexsort((np.arange(len(own)), who, own))
            first = np.ones(len(seen), bool)
            first[1:] = (own[seen][1:] != own[seen][:-1]) | (who[seen][1:] != who[seen][:-1])
            only = np.zeros(len(seen), bool)
            only[seen[first]] = True
            own, who = own[only], who[only]
            new = np.r_[True, own[1:] != own[:-1]] if len(own) else np.zeros(0, bool)
            place = np.arange(len(own))
            top = place - np.maximum.accumulate(np.where(new, place, 0)) < keep
            own, who = own[top], who[top]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(own, who)), pa.array(np.maximum(own, who))], ["a", "b"])

    return run


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Similarities of pairs of stored vectors, each pair in both directions."""
    for batch in batches:
        if batch.num_rows:
            a, b = batch.column(0), batch.column(1)
            s = pa.array(np.einsum("ij,ij->i", _matrix(batch.column(2), np.float32).astype(np.float64), _matrix(batch.column(3), np.float32).astype(np.float64)))
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([a, b]), pa.concat_arrays([b, a]), pa.concat_arrays([s, s])], ["vid", "nvid", "similarity"])


def nearest(tables: list[tuple[str, DataFrame, str, str]], dims: int, k: int = K, curves: int = CURVES, window: int = WINDOW) -> DataFrame:
    """The k nearest by cosine similarity within each table: table_name, id, neighbour_id, rank, similarity.

    ``tables`` names (table_name, rows, key column, vector column). Vectors of other lengths, with nulls or non-finite numbers, or all
    nought are unusable and left out; a key with several rows counts once (the greatest vector). A table of one usable vector has no
    rows. Equal vectors are each other's neighbours; ties go to any of them. Copies sort by number within a key, so a vector with
    very many copies is spread over windows like any others.
    """
    parts = [usable(rows, key, vector, dims).select(F.lit(i).alias("t"), "_id", "_v") for i, (_, rows, key, vector) in enumerate(tables)]
    numbered = reduce(DataFrame.unionByName, parts).withColumn("vid", F.monotonically_increasing_id()).select("t", "vid", "_id", "_v")
    prepared = durable(numbered.mapInArrow(_units, f"t int, vid bigint, _id {numbered.schema['_id'].dataType.simpleString()}, u binary"))
    sizes = {r.t: r.n for r in prepared.groupBy("t").agg(F.count(F.lit(1)).alias("n")).collect()}
    fitted = {}
    for t, n in sizes.items():
        # each row is in the sample or not by the hash of its key: no task gathers more than its share
        some = prepared.where((F.col("t") == t) & (F.pmod(F.xxhash64("_id"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, SAMPLE / n))))
        fitted[t] = vars(Curves(_matrix(some.select("u").toArrow()["u"].combine_chunks(), np.float32).reshape(-1, dims), curves))
    shared = prepared.sparkSession.sparkContext.broadcast(fitted)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            table, numbers, unit = batch.column(0).to_numpy(), batch.column(1).to_numpy(), _matrix(batch.column(2), np.float32)
            for t in np.unique(table):
                own, vectors = numbers[table == t], unit[table == t]
                stored = _binary(np.rint(vectors * (127 / np.abs(vectors).max(1, keepdims=True))).astype(np.int8))
                fit = Curves.of(shared.value[t])
                for c in range(curves):
                    lane = pa.array(np.full(len(own), int(t) * curves + c, np.int32))
                    yield pa.RecordBatch.from_arrays([lane, pa.array(fit.keys(vectors, c)), pa.array(own), stored], ["lane", "key", "vid", "v"])

    rows = prepared.select("t", "vid", "u").mapInArrow(spread, "lane int, key bigint, vid bigint, v binary")
    count = max(1, -(-sum(sizes.values()) * curves // TASK_ROWS))
    ordered = rows.repartitionByRange(count, "lane", "key", "vid").sortWithinPartitions("lane", "key", "vid").select("lane", "vid", "v")
    lists = ordered.mapInArrow(_windows(k + LIST_MORE, window), "vid bigint, best binary")
    candidates = lists.groupBy("vid").agg(F.collect_list("best").alias("lists")).mapInArrow(_merge(k + LIST_MORE, k + MERGED_MORE), "a bigint, b bigint").distinct()
    stored = prepared.select("vid", "u")
    pairs = candidates.join(stored.toDF("a", "ua"), "a").join(stored.toDF("b", "ub"), "b").select("a", "b", "ua", "ub")
    ranked = top(pairs.mapInArrow(_compare, "vid bigint, nvid bigint, similarity double"), ["vid"], [F.desc("similarity"), F.asc("nvid")], k, "rank")
    names = F.element_at(F.array(*[F.lit(n) for n, *_ in tables]), F.col("t") + 1)
    ids = prepared.select("vid", names.alias("table_name"), F.col("_id").alias("id"))
    others = prepared.select(F.col("vid").alias("nvid"), F.col("_id").alias("neighbour_id"))
    return ranked.join(ids, "vid").join(others, "nvid").select("table_name", "id", "neighbour_id", "rank", "similarity")


def neighbour_pairs(found: DataFrame) -> DataFrame:
    """Distinct unordered pairs: table_name, id_a, id_b with id_a before id_b."""
    pair = found.select("table_name", F.least("id", "neighbour_id").alias("id_a"), F.greatest("id", "neighbour_id").alias("id_b"))
    return pair.distinct()
