"""Encoding of a whole corpus with a public byte-level BPE vocabulary.

Texts are cut into words by the vocabulary's own pattern. A word is merged as a contiguous array of part boundaries with the rank of
each adjacent pair beside it: scan for the minimum, delete that boundary, refresh the two neighbouring ranks, repeat. Words
longer than LONG_WORD bytes, for which repeated scans would cost the square of their length, take the same minima from a heap over
a linked list. Every distinct word is merged once per worker; a text's ids are then joined from the words' packed ids.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from docustrata.session import kept, spread

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the word pattern that belongs to the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LONG_WORD = 200
#: Distinct words a worker remembers; beyond it the memory is emptied, which changes no result.
REMEMBERED = 400_000
_NONE = 1 << 60


def load_ranks(path: str) -> dict[bytes, int]:
    """The vocabulary: base64 of a part and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one word by the contiguous rank array."""
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    if len(word) > LONG_WORD:
        return merge_long_word(word, ranks)
    n, get = len(word), ranks.get
    starts = list(range(n + 1))
    rank = [get(word[i : i + 2], _NONE) for i in range(n - 1)]
    while rank:
        low = min(rank)
        if low == _NONE:
            break
        i = rank.index(low)
        del starts[i + 1], rank[i]
        if i < len(rank):
            rank[i] = get(word[starts[i] : starts[i + 2]], _NONE)
        if i:
            rank[i - 1] = get(word[starts[i - 1] : starts[i + 1]], _NONE)
    return [ranks[word[a:b]] for a, b in zip(starts, starts[1:])]


def merge_long_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges, lowest rank and then leftmost first, by a heap over a linked list of boundaries."""
    n = len(word)
    after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    alive = [True] * n
    heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, j, stop = heapq.heappop(heap)
        if not alive[i] or j >= n or not alive[j] or after[i] != j or end[j] != stop:
            continue
        alive[j], end[i], after[i] = False, stop, after[j]
        if after[i] < n:
            before[after[i]] = i
            if (r := ranks.get(word[i : end[after[i]]])) is not None:
                heapq.heappush(heap, (r, i, after[i], end[after[i]]))
        if (h := before[i]) >= 0 and (r := ranks.get(word[h:stop])) is not None:
            heapq.heappush(heap, (r, h, i, stop))
    return [ranks[word[i : end[i]]] for i in range(n) if alive[i]]


class _Words(dict):
    """Word -> its ids as packed 32-bit integers, filled on demand."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        super().__init__()
        self.ranks = ranks

    def __missing__(self, word: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        ids = np.array(merge_word(word.encode("utf-8", "surrogatepass"), self.ranks), dtype=np.int32).tobytes()
        self[word] = ids
        return ids


class Encoder:
    """Encodes texts; made on first use in each worker."""

    def __init__(self, path: str) -> None:
        import regex

        self.words, self.cut = _Words(load_ranks(path)), regex.compile(PATTERN).findall

    def packed(self, text: str | None) -> bytes:
        return b"".join(map(self.words.__getitem__, self.cut(text))) if text else b""

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.packed(text), dtype=np.int32).tolist()


def encode_corpus(documents: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per row: the key and ids, the text's tokens without special tokens. Null and empty texts have the empty list.

    Special tokens' strings in a text are ordinary text. No shuffle; nothing is cut or sampled.
    """

    shared = documents.sparkSession.sparkContext.broadcast({"path": vocabulary})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = kept(shared, "encoder", lambda fields: Encoder(fields["path"])).packed
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                pieces = [packed(t) for t in part.column(1).to_pylist()]
                ends = np.zeros(len(pieces) + 1, dtype=np.int32)
                np.cumsum([len(p) // 4 for p in pieces], out=ends[1:])
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(pieces), dtype=np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], [key, "ids"])

    kind = documents.schema[key].dataType.simpleString()
    return spread(documents.select(key, text)).mapInArrow(run, f"`{key}` {kind}, ids array<int>")
