"""Evaluation passages leaking into training text, found by a Wu-Manber multi-pattern search over words.

The patterns are all runs of RUN consecutive words of the passages. Positions are words and blocks are pairs of words: the shift
table has, for each block that occurs in a pattern, its least distance from the pattern's end; any other block lets the search
skip a whole pattern length. Where the shift is nought the block and the hash of the pattern's first word name a bucket of pattern
positions, and the words themselves are compared. Only the words that the search looks at are brought to their consistent form.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from docustrata.llm.lookalikes import INVISIBLE_RE, LIKE, WIDE
from docustrata.session import kept, spread

RUN = 12
#: Passages are broadcast inside the search (some 30 bytes a character); more characters of them than this are searched in several passes.
PASS_CHARS = 4_000_000
#: Distinct spellings a worker remembers; beyond it the memory is emptied, which changes no result.
REMEMBERED = 500_000
#: A letter or digit, and what follows it in the word; marks that combine with a letter belong to it.
_WORD = re.compile("[^\\W_][\\ẁ-ͯ᪰-᫿᷀-᷿⃐-⃿︠-︯]*")


def _case_classes() -> dict[int, str]:
    """Letters that look alike in either case, each with one letter that stands for all: B looks like В, so b is в."""
    above: dict[str, str] = {}

    def top(c: str) -> str:
        while c in above:
            c = above[c]
        return c

    def join(a: str, b: str) -> None:
        a, b = sorted((top(a), top(b)))
        if a != b:
            above[b] = a

    for a, b in LIKE.items():
        for x in (a, b):
            for y in (x.lower(), x.upper()):
                if len(y) == 1:
                    join(x, y)
        join(a, b)
    return {ord(c): top(c) for c in above}


_CASE = _case_classes()


def word_form(word: str) -> str:
    """A word without regard to case and to the differences of look-alike text: decomposed, each letter as its class or in lower case."""
    return unicodedata.normalize("NFD", word.translate(WIDE)).lower().translate(_CASE)


def split_words(text: str) -> list[str]:
    """Runs of letters and digits as they are written, without what can't be seen."""
    if INVISIBLE_RE.search(text):
        text = INVISIBLE_RE.sub("", text)
    return _WORD.findall(text.replace("_", " ") if "_" in text else text)


def words_of(text: str) -> list[str]:
    """The words of a text in their consistent form."""
    return [word_form(w) for w in split_words(text)]


class _Numbers(dict):
    """Number of a word as it is written; -1 for a word of no passage."""

    def __init__(self, known: dict[str, int]) -> None:
        super().__init__()
        self.known = known

    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = n = self.known.get(word_form(word), -1)
        return n


class WuManber:
    """Patterns are the word runs of the passages; finds the items of which a text holds a run."""

    def __init__(self, passages: list[tuple[int, str]], run: int = RUN) -> None:
        self.run = run
        known: dict[str, int] = {}
        self.words: list[int] = []  # of all passages, one after the other
        self.item: list[int] = []  # of each word's passage
        self.shift: dict[tuple[int, int], int] = {}
        self.buckets: dict[tuple[int, int, int], list[int]] = {}
        for item, passage in passages:
            w = [known.setdefault(x, len(known)) for x in words_of(passage or "")]
            for s in range(len(w) - run + 1):
                for e in range(s + 1, s + run):
                    block, distance = (w[e - 1], w[e]), run - 1 - (e - s)
                    if distance < self.shift.get(block, run):
                        self.shift[block] = distance
                self.buckets.setdefault((w[s + run - 2], w[s + run - 1], w[s]), []).append(len(self.words) + s)
            self.words += w
            self.item += [item] * len(w)
        self.number = _Numbers(known)

    def items(self, text: str) -> set[int]:
        run, shift, number = self.run, self.shift.get, self.number
        words = split_words(text)
        found: set[int] = set()
        at, n = run - 1, len(words)
        while at < n:
            b = number[words[at]]
            if b < 0:  # no pattern holds this word: the next window starts behind it
                at += run
                continue
            a = number[words[at - 1]]
            step = shift((a, b), run - 1)
            if step:
                at += step
                continue
            first = at - run + 1
            starts = self.buckets.get((a, b, number[words[first]]), ())
            if starts:
                window = [number[x] for x in words[first : at + 1]]
                found.update(self.item[s] for s in starts if self.words[s : s + run] == window)
            at += 1
        return found


def find_leaks(documents: DataFrame, passages: DataFrame, run: int = RUN) -> DataFrame:
    """Distinct (doc_id, item_id): the document's text holds ``run`` consecutive words of the item's passage.

    ``passages`` (item_id, passage) is held-out material, read by the driver in passes of a bounded size. Passages of fewer
    words, null texts and null passages are never found.
    """
    found, portion, size = None, [], 0

    def search(portion: list[tuple[int, str]]) -> DataFrame:
        shared = documents.sparkSession.sparkContext.broadcast({"passages": portion})

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = kept(shared, "search", lambda fields: WuManber(fields["passages"], run)).items
            for batch in batches:
                hits = [(d, i) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if t for i in sorted(items(t))]
                yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in hits], pa.int64()), pa.array([i for _, i in hits], pa.int64())], ["doc_id", "item_id"])

        return spread(documents.select("doc_id", "text")).mapInArrow(scan, "doc_id bigint, item_id bigint")

    for row in passages.where("item_id is not null and passage is not null").select("item_id", "passage").toLocalIterator():
        portion.append((row.item_id, row.passage))
        size += len(row.passage)
        if size > PASS_CHARS:
            found = search(portion) if found is None else found.unionByName(search(portion))
            portion, size = [], 0
    if portion or found is None:
        found = search(portion) if found is None else found.unionByName(search(portion))
    return found.distinct()
