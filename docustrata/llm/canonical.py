"""Mapping free-entered values to a canonical list.

The spellings of all reference words, with their transliterations, form one trie, searched with a Levenshtein automaton whose
states are bands of edit distances (a swap of neighbours is one edit); its moves depend only on where the next letter stands near the
diagonal, so they are worked out once and looked up from then on. A second trie holds the entries as paths of words, and alias
paths that mean the same entry: first two words in the other order, linking words left out, words written together. A value walks the
second trie over the words the first one returns, and every entry reached within a distance that depends on length is returned.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docustrata.llm.lookalikes import python_form
from docustrata.session import durable, kept, target_partitions

#: Reference entries are broadcast; more characters of them than this are searched in several shards.
REFERENCE_CHARS = 1_000_000
#: So many letters a word may have more than the typed one and still have its own, larger distance: more than any allowed distance can add.
REACH = 3
#: Distinct values that a task searches about.
VALUES_PER_TASK = 2_000
#: Words that people put around a value without changing what it means.
NOISE = frozenset("по согласно см изд издание ред редакция с поправкой поправками нормы свод правил о требованиях проект документ документа статус уточнено карточку карточка карточке".split())
#: Words that may be left out or written as their first letter.
LINKING = {"для": "д"}
#: Transliteration of Cyrillic letters.
TRANSLIT = dict(zip("абвгдезийклмнопрстуфыэ", "abvgdeziyklmnoprstufye")) | {"ж": "zh", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ъ": "", "ь": "", "ю": "yu", "я": "ya"}
#: The same keys on an English and a Russian keyboard.
KEYS = dict(zip("qwertyuiop[]asdfghjkl;'zxcvbnm,.`", "йцукенгшщзхъфывапролджэячсмитьбюё"))
#: Digits that stand for letters inside a word, and letters for digits inside a number.
DIGIT_LETTER = {"0": "о", "3": "з", "6": "б", "4": "ч"}
LETTER_DIGIT = {"о": "0", "o": "0", "з": "3", "l": "1", "i": "1", "б": "6"}

#: Abbreviations with a stroke and what the word meant starts with.
STROKED = {"ж/б": "железобетон.", "zh/b": "zhelezobeton."}

_TOKEN = re.compile(r"(\d+|[^\W\d_]+)(\.?)")
#: A date beside a value, with the word before it.
_DATE = re.compile(r"(?:(?<![^\W\d_])[сcs]\s+)?(?<!\d)\d{1,2}\.\d{1,2}\.\d{4}(?!\d)")
_DIGITS = re.compile(r"(?<=[^\W\d_])[0346](?=[^\W\d_])")
_LETTERS = re.compile(r"(?<=\d)[оoзliб](?=\d)")
_SHORT = re.compile(r"(?<![^\W\d_])([^\W\d_]{1,2})-([^\W\d_]{2,5})(?![^\W\d_])")


def allowed(length: int) -> int:
    """Edits allowed in a word: none up to two letters, one up to four, two up to eight, three beyond. Numbers allow none."""
    return 0 if length <= 2 else 1 if length <= 4 else 2 if length <= 8 else 3


def folded(text: str) -> str:
    low = unicodedata.normalize("NFKC", text.replace("№", " ")).casefold().replace("ё", "е")
    for short, full in STROKED.items():
        low = low.replace(short, full)
    return low


class Automaton:
    """The Levenshtein automaton for at most ``most`` edits, the same for all words.

    A state is a band: for each place t the distance of what was read to the first j letters of the word, j = read - most + t, and what
    a swap that is half read would cost there. A move is named by the state, by which of the letters around the band equal the one
    that is read, and by the last place of the band that lies within the word.
    """

    def __init__(self, most: int) -> None:
        self.most, self.places = most, 2 * most + 1
        self.far = most + 1
        self.bits = self.places + 2
        self.window = (1 << self.bits) - 1
        far = (self.far,) * self.places
        self.rows: list[tuple[int, ...]] = [tuple(self.far if t < most else t - most for t in range(self.places))]
        self.swaps: list[tuple[int, ...]] = [far]
        self.number = {(self.rows[0], far): 0}
        self.moves: dict[int, int] = {}

    def start(self, n: int) -> int:
        """The state before anything is read of a word of n letters."""
        row = tuple(c if t - self.most <= n else self.far for t, c in enumerate(self.rows[0]))
        return self._state(row, self.swaps[0])

    def _state(self, row: tuple[int, ...], swap: tuple[int, ...]) -> int:
        if (row, swap) not in self.number:
            self.number[row, swap] = len(self.rows)
            self.rows.append(row)
            self.swaps.append(swap)
        return self.number[row, swap]

    def move(self, state: int, near: int, last: int) -> int:
        """The next state, -1 where every distance is too great. ``near``: bit u is the letter read - most - 1 + u; ``last``: the last place within the word."""
        key = (state * self.places + last) << self.bits | near
        if key not in self.moves:
            row, swap, far = self.rows[state], self.swaps[state], self.far
            new, waiting = [], []
            for t in range(self.places):
                cost = far
                if t <= last:
                    cost = min(row[t] + (not near >> t + 1 & 1), new[t - 1] + 1 if t else far, row[t + 1] + 1 if t + 1 < self.places else far, swap[t] if near >> t & 1 else far, far)
                new.append(cost)
                waiting.append(min(row[t] + 1, far) if near >> t + 2 & 1 else far)
            self.moves[key] = self._state(tuple(new), tuple(waiting)) if min(new) <= self.most else -1
        return self.moves[key]


class WordTrie:
    """Spellings of words, searched by a Levenshtein automaton."""

    def __init__(self) -> None:
        self.root: dict = {}
        self.known: dict[str, set[int]] = {}
        self.joined: set[int] = set()
        self._memory: dict[tuple[str, bool, int], dict[int, int]] = {}
        self._automata: dict[int, Automaton] = {}

    def add(self, spelling: str, word: int) -> None:
        self.known.setdefault(spelling, set()).add(word)
        at = self.root
        for ch in spelling:
            at = at.setdefault(ch, {})
        at.setdefault("", set()).add(word)

    def search(self, typed: str, cut: bool, reach: int = 1) -> dict[int, int]:
        """Words and their distances; ``cut``: the typed word is the start of an abbreviated one. The distance allowed is that of the
        longer of the two, of a word more than ``reach`` letters longer than the typed one that of ``reach`` letters more."""
        key = typed, cut, reach
        if key not in self._memory:
            if len(self._memory) > 200_000:
                self._memory.clear()
            self._memory[key] = self._search(typed, cut, reach)
        return self._memory[key]

    def _search(self, typed: str, cut: bool, reach: int) -> dict[int, int]:
        if typed.isdigit():
            return dict.fromkeys(self.known.get(typed, ()), 0)
        n = len(typed)
        most = allowed(n + reach)
        if most not in self._automata:
            self._automata[most] = Automaton(most)
        auto = self._automata[most]
        places, bits, window, rows, known, work_out = auto.places, auto.bits, auto.window, auto.rows, auto.moves.get, auto.move
        at: dict[str, int] = {}
        for i, ch in enumerate(typed):
            at[ch] = at.get(ch, 0) | 1 << i
        found: dict[int, int] = {}
        start_of = cut and n >= 3
        todo = [(self.root, 0, auto.start(n))]
        while todo:
            node, depth, state = todo.pop()
            place = n - depth + most
            if "" in node and 0 <= place < places and rows[state][place] <= min(most, allowed(max(n, depth))):
                d = rows[state][place]
                for w in node[""]:
                    found[w] = min(found.get(w, 99), d)
            last = min(places - 1, place - 1)
            if last < 0:
                continue
            shift = depth - most - 1
            base = state * places + last << bits
            for ch, child in node.items():
                if ch == "":
                    continue
                near = at.get(ch, 0)
                near = (near >> shift if shift >= 0 else near << -shift) & window
                to = known(base | near)
                if to is None:
                    to = work_out(state, near, last)
                if to < 0:
                    continue
                if start_of and depth + 1 >= n - 1 and 0 <= place - 1 < places and rows[to][place - 1] <= (0 if n < 4 else 1):
                    for w in set(self._below(child)) - self.joined:
                        found[w] = min(found.get(w, 99), rows[to][place - 1])
                todo.append((child, depth + 1, to))
        if typed in self.known and not cut:  # a word that is right as it stands isn't two written together, of which one would be made up
            found = {w: d for w, d in found.items() if d == 0 or w not in self.joined}
        return found

    def _below(self, node: dict) -> Iterator[int]:
        todo = [node]
        while todo:
            at = todo.pop()
            for ch, child in at.items():
                if ch == "":
                    yield from child
                else:
                    todo.append(child)

    def contracted(self, head: str, tail: str) -> dict[int, int]:
        """Words of which a contraction keeps the start and the end: what lies below the start in the trie and ends so."""
        node = self.root
        for ch in head:
            if ch not in node:
                return {}
            node = node[ch]
        found: dict[int, int] = {}
        todo = [(node, "")]
        while todo:
            node, rest = todo.pop()
            for ch, child in node.items():
                if ch != "":
                    todo.append((child, rest + ch))
                elif len(rest) > len(tail) and rest.endswith(tail):
                    found.update(dict.fromkeys(child, 0))
        return found


class EntryTrie:
    """One reference list: paths of words that end in entries."""

    def __init__(self, entries: list[tuple[int, str]]) -> None:
        self.words = WordTrie()
        self.number: dict[str, int] = {}
        self.root: dict = {}
        self.exact = {}
        for entry, text in sorted(entries):
            self.exact.setdefault(text, entry)
            tokens = [t for t, *_ in tokens_of(python_form(folded(text)), False)]
            plain = [t for t in tokens if t not in LINKING]
            for path in (tokens, plain, *([[p[1], p[0], *p[2:]] for p in (tokens, plain) if len(p) > 2 and not p[1].isdigit()])):
                self._path(path, entry)
            numbers = [t for t in tokens if t.isdigit()]
            if len(numbers) > 1:  # written without separators
                self._path([*(t for t in tokens if not t.isdigit()), "".join(numbers)], entry)
            if len(tokens) > 5:  # three words run together and cut to the start of the first
                self._path([tokens[0], *tokens[3:]], entry)
            for i in range(len(tokens) - 1):
                if not tokens[i].isdigit() and not tokens[i + 1].isdigit():
                    if tokens[i] + tokens[i + 1] not in self.number:
                        self.words.joined.add(self._word(tokens[i] + tokens[i + 1]))
                    self._path([*tokens[:i], tokens[i] + tokens[i + 1], *tokens[i + 2 :]], entry)
        #: Words to pass over, and the most edits in them.
        self.noise = {self._word(n): int(len(n) >= 4) for n in NOISE}

    def _word(self, spelling: str) -> int:
        spelling = python_form(spelling)
        if spelling not in self.number:
            self.number[spelling] = w = len(self.number)
            self.words.add(spelling, w)
            if not spelling.isdigit():
                self.words.add("".join(TRANSLIT.get(ch, ch) for ch in spelling), w)
            if spelling in LINKING:
                self.words.add(LINKING[spelling], w)
                self.words.add(TRANSLIT[LINKING[spelling]], w)
        return self.number[spelling]

    def _path(self, tokens: list[str], entry: int) -> None:
        at = self.root
        for t in tokens:
            at = at.setdefault(self._word(t), {})
        at.setdefault(-1, set()).add(entry)

    def _options(self, tokens: list[tuple], i: int) -> list[tuple[int, dict[int, int], int]]:
        """(tokens used, words with distances, letters) from position i on."""
        head, tail, dot = tokens[i]
        if tail:
            return [(1, self.words.contracted(head, tail), len(head) + len(tail)), *self._plain([(head + tail, "", False)], 0)]
        options = self._plain(tokens, i)
        if i + 1 < len(tokens) and 0 not in options[0][1].values() and not head.isdigit() and not tokens[i + 1][0].isdigit() and not tokens[i + 1][1]:
            joined = head + tokens[i + 1][0]
            options.append((2, self.words.search(joined, False, REACH), len(joined)))
        return options

    def _plain(self, tokens: list[tuple], i: int) -> list[tuple[int, dict[int, int], int]]:
        head, _, dot = tokens[i]
        words = self.words.search(head, False, REACH)
        if dot:
            cut = self.words.search(head, True, REACH)
            words = {w: min(d, words.get(w, d)) for w, d in cut.items()} | {w: d for w, d in words.items() if w not in cut}
        options = [(1, words, len(head))]
        if head not in self.words.known:  # a word of no meaning written before the next one
            for n in sorted(NOISE):
                if len(n) > 1 and head.startswith(n) and len(head) > len(n) + 1:
                    options.append((1, self.words.search(head[len(n) :], dot, REACH), len(head)))
        return options

    def walk(self, tokens: list[tuple]) -> dict[int, int]:
        """Entries reached by the tokens and their distances."""
        n = len(tokens)
        states: list[dict[int, tuple[dict, int]]] = [{} for _ in range(n + 1)]
        states[0][id(self.root)] = (self.root, 0)
        most = 1 + sum(len(t[0]) for t in tokens) // 6
        for i in range(n):
            if not states[i]:
                continue
            options = self._options(tokens, i)
            for node, cost in states[i].values():
                for used, words, _ in options:
                    for w, d in words.items():
                        total = cost + d
                        if total > most:
                            continue
                        for nxt in ([node[w]] if w in node else []) + ([node] if d <= self.noise.get(w, -1) else []):
                            old = states[i + used].get(id(nxt))
                            if old is None or old[1] > total:
                                states[i + used][id(nxt)] = (nxt, total)
        reached: dict[int, int] = {}
        for node, cost in states[n].values():
            for e in node.get(-1, ()):
                reached[e] = min(reached.get(e, 99), cost)
        return reached

    def matches(self, value: str) -> dict[int, int]:
        """All entries the value may mean, under each of its readings, with the least distance."""
        found: dict[int, int] = {}
        for reading in readings(value):
            for e, d in self.walk(reading).items():
                found[e] = min(found.get(e, 99), d)
        return found


def tokens_of(text: str, repair: bool) -> list[tuple[str, str, bool]]:
    """(word or number, end of a contraction, followed by a dot)."""
    if repair:
        text = _LETTERS.sub(lambda m: LETTER_DIGIT[m[0]], _DIGITS.sub(lambda m: DIGIT_LETTER[m[0]], text))
    out, at = [], 0
    for m in _SHORT.finditer(text):
        out += [(w, "", bool(dot)) for w, dot in _TOKEN.findall(text[at : m.start()])]
        out.append((m[1], m[2], False))
        at = m.end()
    return out + [(w, "", bool(dot)) for w, dot in _TOKEN.findall(text[at:])]


def readings(value: str) -> list[list[tuple]]:
    """The value as it looks, as it is spelled, and as typed on the other keyboard."""
    low = folded(value)
    bare = _DATE.sub(" ", low)
    low = bare if bare.strip() else low
    texts = [python_form(low), low]
    if len(re.findall("[a-z]", low)) > len(re.findall("[а-я]", low)):
        typed = "".join(KEYS.get(ch, ch) for ch in low)
        ends = re.sub(r"[юб](?=\s|$)", lambda m: low[m.start()] if low[m.start()] in ".," else m[0], typed)
        texts += [t.replace("ё", "е") for t in (typed, ends)]
    seen, out = set(), []
    for t in texts:
        got = tokens_of(t, True)
        if got and tuple(got) not in seen:
            seen.add(tuple(got))
            out.append(got)
    return out


def best(found: dict[int, int]) -> int:
    """The nearest entry, the least id on a tie; -1 for none."""
    return min(found, key=lambda e: (found[e], e)) if found else -1


def map_values(values: DataFrame, entries: DataFrame) -> DataFrame:
    """Distinct (list_name, value) to entry_id (-1: none), distance, n_candidates and the candidates (all entries within distance).

    ``values`` has list_name and value; null and blank values are left out; each distinct value is searched once, however often it
    was typed; a value of a list that has no entries means none. ``entries`` (entry_id, list_name, entry_text) is the reference: it is
    read to the driver in shards of at most REFERENCE_CHARS characters (as their sizes are counted first), each value is searched in every
    shard, and the nearest entry of all counts.
    """
    spark = values.sparkSession
    named = entries.where("entry_text is not null and list_name is not null and entry_id is not null").select("entry_id", "list_name", "entry_text")
    size = named.agg(F.coalesce(F.sum(F.length("entry_text")), F.lit(0))).first()[0]
    shards = max(1, -(-size // REFERENCE_CHARS))
    distinct = durable(values.where("list_name is not null and value is not null").select("list_name", "value").distinct())
    # a search costs far more than its row weighs, so tasks are dealt by number of values, not by bytes
    dealt = distinct.repartition(target_partitions(spark, distinct.count(), VALUES_PER_TASK))

    def search(shard: int) -> DataFrame:
        lists: dict[str, list] = {}
        for r in named.where(F.pmod(F.xxhash64("list_name", "entry_id"), F.lit(shards)) == shard).collect():
            lists.setdefault(r.list_name, []).append((r.entry_id, r.entry_text))
        shared = spark.sparkContext.broadcast({"lists": lists})

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tries = kept(shared, "tries", lambda fields: {name: EntryTrie(own) for name, own in fields["lists"].items()})
            for batch in batches:
                rows = []
                for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    trie = tries.get(name)
                    exact = trie.exact.get(text) if trie else None
                    found = {} if trie is None else {exact: 0} if exact is not None else trie.matches(text)
                    e = best(found)
                    rows.append((name, text, e, found.get(e), sorted(found)))
                cols = list(zip(*rows)) if rows else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int32()), pa.array(cols[4], pa.list_(pa.int64()))], ["list_name", "value", "entry_id", "distance", "candidates"])

        return dealt.mapInArrow(run, "list_name string, value string, entry_id bigint, distance int, candidates array<bigint>")

    found = search(0)
    if shards == 1:
        return found
    for shard in range(1, shards):
        found = found.unionByName(search(shard))
    nearest = F.min(F.when(F.col("entry_id") >= 0, F.struct("distance", "entry_id")))
    every = found.groupBy("list_name", "value").agg(nearest.alias("n"), F.sort_array(F.flatten(F.collect_list("candidates"))).alias("candidates"))
    return every.select("list_name", "value", F.coalesce("n.entry_id", F.lit(-1)).cast("bigint").alias("entry_id"), F.col("n.distance").alias("distance"), "candidates")


def typed_values(aliases: DataFrame, cards: DataFrame) -> DataFrame:
    """The registry's hand-typed values: table_name, record_id, list_name, value; null and blank ones are left out.

    An alias_type without a list gives list_name '' (no entry is meant); of a record with differing rows the least value counts.
    """
    full = lambda c: F.length(F.regexp_replace(c, r"(?U)\s+", "")) > 0
    raw = F.when(full("alias_raw"), F.col("alias_raw")).otherwise(F.col("alias_normalized"))
    kind = F.when(F.col("alias_type") == "display_code", "designation").when(F.col("alias_type") == "title", "title").otherwise("")
    a = aliases.select(F.lit("document_aliases").alias("table_name"), F.col("alias_id").alias("record_id"), kind.alias("list_name"), raw.alias("value"))
    c = cards.select(F.lit("document_cards").alias("table_name"), F.col("card_id").alias("record_id"), F.lit("card_status").alias("list_name"), F.col("card_status_raw").alias("value"))
    rows = a.unionByName(c).where(full("value") & F.col("record_id").isNotNull())
    return rows.groupBy("table_name", "record_id").agg(F.min(F.struct("value", "list_name")).alias("v")).select("table_name", "record_id", "v.list_name", "v.value")


def mapped_values(aliases: DataFrame, cards: DataFrame, entries: DataFrame) -> DataFrame:
    """Every hand-typed value that isn't letter for letter an entry, with the entry it means (-1: none)."""
    typed = durable(typed_values(aliases, cards))
    own = entries.select("list_name", F.col("entry_text").alias("value")).distinct()
    strange = typed.join(own, ["list_name", "value"], "left_anti")
    return strange.join(map_values(strange, entries), ["list_name", "value"]).select("table_name", "record_id", "list_name", "value", "entry_id", "distance", "candidates")
