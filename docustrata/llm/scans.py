"""Repair of text from scanned pages: an averaged-perceptron character editor, and page positions for running matter.

Three averaged perceptrons are trained in the query itself. One marks the furniture of a page (running headers and footers, page
numbers, page marks) by the line's shape, its position on the page and its repetition in the version; it learns on synthetic
pages. One, the character editor, predicts keep, replace, delete and insert for each character of a word that the corpus doesn't
know; it learns on rare words of the corpus that lie beside frequent ones, and a correction counts where it gives a known word, or
where the editor is surer of it than of any edit of a known word. One predicts the line-join operation at a hyphen. The lexicon is
counted over all rows, inside lines, where no broken words stand; it holds every word that occurs LEAST_COUNT times and isn't a
misreading of a far more frequent one, at any size of the corpus, but no more than the LEXICON_WORDS most frequent ones, which each
worker holds.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docustrata.llm.perceptron import Weights, predict, scores, train
from docustrata.operators.skew import hot_keys, replicated, salted
from docustrata.session import durable, kept, spread

LEAST_COUNT = 3
#: Bound of what each worker holds: some 2 KB a word.
LEXICON_WORDS = 150_000
#: A longer run of characters is no word: it is neither counted nor judged.
LONGEST = 100
#: A word is a misreading where a word with another letter in one place is RATIO times as frequent, or one with a letter more or less RATIO_LENGTH times.
RATIO, RATIO_LENGTH = 30, 400
#: A word of at most so many letters (a part of a word, an abbreviation) lies beside too many others for every edit to count: besides
#: replacements that give a word of four letters or more, only the operations likeliest to the editor are tried. All edits of longer ones are.
SHORT = 4
#: Bounds of the training data: rare words, synthetic pages, broken words.
RARE_WORDS, PAGES, BREAKS = 6_000, 400, 4_000
HYPHENS = "-\u2010\u00ad\u00ac"
_EDGE = ".,;:!?()[]«»\"“”…|*"
_CYR = re.compile("[а-яё]", re.I)
_TOKEN = re.compile("[^\\s\U00010000-\U0010ffff]+")
_MARK = re.compile(r"[\[({]{1,2}\s*PAGE\s*:?\s*\d+\s*[\])}]{1,2}|-+\s*PAGE\s+\d+\s*-+", re.I)
_CODE = re.compile(r"(?:ГОСТ(?:\s*Р)?|СП|СНиП|СНИП)[\s.,~]*\d[\d\s.,~і-]*", re.I)
#: A code of which one sign is misread: a short word, a number and a year, and nothing else but a note.
_MISREAD_CODE = re.compile(r"\S{1,4}(?:\s+Р)?[\s.,~і0]\s*[\dі][\d.,~і]{2,}-[\d~.,і]{4}\s*(?:\(.*)?")
#: What scanning makes of digits.
_AS_DIGIT = str.maketrans("lIіiОоOoЗз", "1111000033")
_ROMAN = re.compile(r"[ivxlcIVXLC]{1,6}")


def is_word(w: str) -> bool:
    """Whether a token is judged as a word: it holds a Cyrillic letter, or is all Latin letters."""
    return _CYR.search(w) is not None or (w.isascii() and w.isalpha())


def core(token: str) -> str:
    return token.strip(_EDGE)


def words_in(line: str) -> list[tuple[int, str]]:
    """(position, word without outer punctuation) of the tokens that are words; signs beyond the basic plane belong to no word."""
    out = []
    for m in _TOKEN.finditer(line):
        w = m[0].lstrip(_EDGE)
        at = m.start() + len(m[0]) - len(w)
        w = w.rstrip(_EDGE)
        if is_word(w):
            out.append((at, w))
    return out


def broken_end(line: str) -> tuple[str, str] | None:
    """(part of a word, hyphen) where the line ends so."""
    s = line.rstrip()
    if len(s) < 2 or s[-1] not in HYPHENS or not s[-2].isalnum():
        return None
    return core(s[:-1].split()[-1]), s[-1]


# -- lexicon ---------------------------------------------------------------------------------------------------------------


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words and how often they occur; of texts of several lines without what may be a part of a word: a small first word of a line, and one before a hyphen at its end."""
    for batch in batches:
        counts: Counter[str] = Counter()
        for text in batch.column(0).to_pylist():
            lines = (text or "").split("\n")
            for line in lines:
                tokens = line.split()
                if len(lines) > 1 and tokens:
                    tokens = tokens[1 if core(tokens[0])[:1].islower() else 0 : -1 if broken_end(line) else None]
                counts.update(t.lower() for t in tokens)
        merged: Counter[str] = Counter()
        for t, n in counts.items():
            w = core(t)
            if len(w) <= LONGEST and is_word(w):
                merged[w] += n
        yield pa.RecordBatch.from_arrays([pa.array(list(merged), pa.string()), pa.array(list(merged.values()), pa.int64())], ["word", "n"])


def _mixed(word: str) -> bool:
    """A word with something else among its letters; units, classes and compounds are none."""
    bare = re.sub(r"[²³]$", "", word)
    return not re.fullmatch(r"[а-яё]+(?:[-/.][а-яё]+)*|[a-z]+|[а-яё]\d+(?:[.,]\d+)?|\d+(?:[.,]\d+)?[а-яё]+", bare)


class Lexicon:
    """Known words and their masked forms, without those that are misreadings of far more frequent ones."""

    def __init__(self, counts: dict[str, int]) -> None:
        self.masks: dict[str, list[str]] = defaultdict(list)
        top: dict[str, int] = {}
        plain = {w: n for w, n in counts.items() if not _mixed(w)}
        for w, n in plain.items():
            if len(w) > 3:
                for i in range(len(w)):
                    k = f"{w[:i]}*{w[i + 1 :]}"
                    top[k] = max(top.get(k, 0), n)

        def misread(w: str, n: int) -> bool:
            if len(w) <= 3:
                return False
            if n * RATIO <= max(top[f"{w[:i]}*{w[i + 1 :]}"] for i in range(len(w))):
                return True
            longer = max(top.get(f"{w[:i]}*{w[i:]}", 0) for i in range(len(w) + 1))
            shorter = max(plain.get(w[:i] + w[i + 1 :], 0) for i in range(len(w))) if len(w) > 4 else 0
            return n * RATIO_LENGTH <= max(longer, shorter)

        self.counts = {w: n for w, n in plain.items() if not misread(w, n)}
        for w in self.counts:
            if len(w) > 3:
                for i in range(len(w)):
                    self.masks[f"{w[:i]}*{w[i + 1 :]}"].append(w)
        self.heads = {w[: w.rindex("-")] for w in self.counts if "-" in w} | {w[: w.index("-")] for w in self.counts if "-" in w}

    def beside(self, w: str) -> list[tuple[str, list[str]]]:
        """Known words one misreading away, each with the editing operations that lead to it."""
        return beside(w, self.counts, self.masks)


def beside(w: str, known: dict[str, int], masks: dict[str, list[str]]) -> list[tuple[str, list[str]]]:
    """Known words one misreading away, each with the editing operations that lead to it (one per character, one at the end)."""
    found = []
    keep = ["K"] * (len(w) + 1)
    for i in range(len(w)):
        for v in masks.get(f"{w[:i]}*{w[i + 1 :]}", ()):
            found.append((v, [*keep[:i], f"R{v[i]}", *keep[i + 1 :]]))
        if i + 1 < len(w):
            for v in masks.get(f"{w[:i]}*{w[i + 2 :]}", ()):
                found.append((v, [*keep[:i], f"R{v[i]}", "D", *keep[i + 2 :]]))
        if i + 2 < len(w):
            for v in masks.get(f"{w[:i]}*{w[i + 3 :]}", ()):
                found.append((v, [*keep[:i], f"R{v[i]}", "D", "D", *keep[i + 3 :]]))
        if i > 3 and len(w) - i > 4 and w[:i] in known and w[i + 1 :] in known:
            found.append((f"{w[:i]} {w[i + 1 :]}", [*keep[:i], "R ", *keep[i + 1 :]]))
        if len(w) > 4 and w[:i] + w[i + 1 :] in known:
            found.append((w[:i] + w[i + 1 :], [*keep[:i], "D", *keep[i + 1 :]]))
    if len(w) > 4:
        for i in range(len(w) + 1):
            for v in masks.get(f"{w[:i]}*{w[i:]}", ()):
                found.append((v, [*keep[:i], f"I{v[i]}", *keep[i + 1 :]]))
    return found


# -- character editor ------------------------------------------------------------------------------------------------------


def _char_features(w: str, i: int) -> list[str]:
    p = f"^^{w}$$"
    a, b, c, d, e = p[i], p[i + 1], p[i + 2] if i < len(w) else "$", p[i + 3] if i < len(w) else "$", p[i + 4] if i < len(w) else "$"
    return [f"0{c}", f"1{b}{c}", f"2{c}{d}", f"3{b}{c}{d}", f"4{a}{b}{c}", f"5{c}{d}{e}", f"6{b}_{d}", "bias"]


def _apply(w: str, ops: list[str]) -> str:
    out = []
    for ch, op in zip([*w, ""], ops):
        if op[0] == "K":
            out.append(ch)
        elif op[0] == "R":
            out.append(op[1:])
        elif op[0] == "I":
            out += [op[1:], ch]
    return "".join(out)


def editor_examples(lexicon: Lexicon, rare: list[str]) -> list[tuple[list[str], str]]:
    """Characters with their operations: of rare words beside exactly one known word, and of known words, which are kept."""
    examples = []
    for w in rare:
        near = lexicon.beside(w) if w not in lexicon.counts else []
        if near and len({v for v, _ in near}) == 1:
            examples += [(_char_features(w, i), op) for i, op in enumerate(near[0][1])]
    known = sorted(lexicon.counts, key=lambda w: (-lexicon.counts[w], w))[: RARE_WORDS // 3]
    for w in known:
        examples += [(_char_features(w, i), "K") for i in range(len(w) + 1)]
    random.Random(5).shuffle(examples)
    return examples


def corrected(w: str, weights: Weights, known: dict[str, int], masks: dict[str, list[str]]) -> str | None:
    """The known word the editor makes of an unknown one: by its best operations, else by the best single edit that gives one; None if none does."""
    at = [scores(weights, _char_features(w, i)) for i in range(len(w) + 1)]
    greedy = [min(s, key=lambda op: (-s[op], op)) if s else "K" for s in at]
    made = _apply(w, greedy)
    if made != w and made in known:
        return made
    edits = beside(w, known, masks)
    keep = ["K"] * (len(w) + 1)
    if len(w) <= SHORT:
        likely = [(s.get("K", 0.0) - s[op], i, op) for i, s in enumerate(at) for op in sorted(s, key=lambda op: (-s[op], op))[:6] if op != "K"]
        for _, i, op in sorted(likely)[:24]:
            doubled = [[*keep[:i], op, "D", *keep[i + 2 :]]] if op[0] == "R" and i + 1 < len(w) else []
            edits += [(made, ops) for ops in ([*keep[:i], op, *keep[i + 1 :]], *doubled) if (made := _apply(w, ops)) in known]
    if not edits:
        return None

    def rank(edit: tuple[str, list[str]]) -> tuple:
        """An operation that the editor never learned counts as its worst one; of two words of one operation the one that deletes nothing more."""
        i, op = next((i, op) for i, op in enumerate(edit[1]) if op != "K")
        worst = min(at[i].values(), default=0.0)
        return at[i].get("K", worst) - at[i].get(op, worst), i, op, len(w) - len(edit[0]), edit[0]

    return min(edits, key=rank)[0]


def surest(w: str, weights: Weights) -> float:
    """By how much the editor prefers its surest edit of a word to leaving the character as it is; less than nought where it would keep all."""
    at = (scores(weights, _char_features(w, i)) for i in range(len(w) + 1))
    return max((max((x for op, x in s.items() if op != "K"), default=-1e9) - s.get("K", 0.0) for s in at), default=-1e9)


# -- line joins ------------------------------------------------------------------------------------------------------------


def _join_features(head: str, tail: str, hyphen: str, known: dict[str, int], heads: set[str]) -> list[str]:
    joined, apart = (head + tail) in known, f"{head}-{tail}" in known
    shape = f"joined{joined} apart{apart} head{head in heads} tail{bool(tail)}"
    return [shape, f"h{hyphen} {shape}", f"joined{joined}", f"apart{apart}", f"headknown{head in known} tailknown{tail in known}", "bias"]


def join_examples(lexicon: Lexicon) -> list[tuple[list[str], str]]:
    """Known words broken at random, to be joined, and compounds broken at their own hyphen, not to be."""
    rng = random.Random(6)
    plain = sorted(w for w in lexicon.counts if len(w) > 4 and w.isalpha())
    paired = sorted(w for w in lexicon.counts if "-" in w)
    out = []
    for w in rng.sample(plain, min(len(plain), BREAKS)):
        i = rng.randrange(2, len(w) - 1)
        out.append((_join_features(w[:i], w[i:] if rng.random() < 0.85 else "", rng.choice(HYPHENS), lexicon.counts, lexicon.heads), "join"))
    for w in paired * max(1, min(50, BREAKS // (2 * max(1, len(paired))))):
        a, _, b = w.partition("-")
        out.append((_join_features(a, b if rng.random() < 0.85 else "", rng.choice("--‐"), lexicon.counts, lexicon.heads), "keep"))
    rng.shuffle(out)
    return out


# -- furniture -------------------------------------------------------------------------------------------------------------


_LABELLED = re.compile(r"(?:стр|лист|с|page|p)(?:[.,]\s*|\s+)\S{1,4}", re.I)
_NUMBERS = re.compile(r"[\d.,\s]+")
_ARCHIVE = re.compile(r"№\s*\S{1,6}$")
_LOWER = re.compile(r"[а-яёa-z]{4}")
_SPACED = re.compile(r"(?:\b\w\s){4}")
_GAP = re.compile(r"\S\s{3,}\S")
_NUMBERED = re.compile(r"\d+(?:\.\d+)*[.)]?\s+\S")


def _shape(s: str) -> str:
    """What the line looks like."""
    if "PAGE" in s.upper() and _MARK.search(s):
        return "mark"
    if len(s) <= 14:
        bare = s.strip(" .,—–-_[]()|~")
        digits = bare.translate(_AS_DIGIT)
        if digits.isdigit() and len(digits) <= 4:
            if s[0] in "—–-" and s[-1] in "—–-":
                return "dashed"
            return "numberdot" if s.endswith(".") else "number"
        if bare and _ROMAN.fullmatch(bare):
            return "roman"
        if _LABELLED.fullmatch(s):
            return "labelled"
        if _NUMBERS.fullmatch(s):
            return "numbers"
    if "|" in s:
        return "table"
    if "№" in s and len(s) < 70 and _ARCHIVE.search(s):
        return "archive"
    if not _LOWER.search(s):  # capitals or single letters
        letters = [ch for ch in s if ch.isalpha()]
        if len(letters) > 5 and _SPACED.search(s):
            return "spaced"
    else:
        letters = []
    m = _CODE.match(s)
    if m:
        rest = s[m.end() :].strip(" ~.,()")
        return "code" if not rest or re.match(r"[(~]?\s*издание", s[m.end() :].strip(" ~.,"), re.I) or len(rest) < 4 else "codetext"
    if "-" in s and _MISREAD_CODE.fullmatch(s):
        return "code"
    if "   " in s and _GAP.search(s):
        return "gap"
    if len(letters) > 7 and sum(ch.isupper() for ch in letters) > 0.8 * len(letters):
        return "caps"
    if s[0].isdigit() and _NUMBERED.match(s):
        return "numbered"
    return "text"


def line_key(line: str) -> str:
    """The letters of a line, for finding it again elsewhere; empty for a line that can't be running matter."""
    s = line.strip()
    if not s or len(s) > 200 or "|" in s or s[0].islower() or s[-1] in ";,:" + HYPHENS or (s[-1] == "." and len(s) > 30):
        return ""
    letters = "".join(ch for ch in s.casefold() if ch.isalpha())
    return letters if len(letters) >= 5 else ""


def line_features(lines: list[str], repeated: set[int]) -> list[list[str] | None]:
    """Features of each line, None for blank ones. ``repeated``: numbers (from 0) of lines found elsewhere in the version."""
    filled = [i for i, x in enumerate(lines) if x.strip()]
    out: list[list[str] | None] = [None] * len(lines)
    width = sorted(len(lines[i].strip()) for i in filled)[len(filled) * 3 // 4] if filled else 1
    for k, i in enumerate(filled):
        s = lines[i].strip()
        before, after = lines[filled[k - 1]].strip() if k else "", lines[filled[k + 1]].strip() if k + 1 < len(filled) else ""
        top, bottom = min(k, 3), min(len(filled) - 1 - k, 3)
        shape = _shape(s)
        start = "l" if s[0].islower() else "U" if s[0].isupper() else "d" if s[0].isdigit() else "o"
        end = "." if s[-1] in ".!?" else "-" if s[-1] in HYPHENS else ",;" if s[-1] in ",;:" else "w"
        cut = bool(before) and before[-1] not in ".!?:" and bool(after) and after[0].islower() and start != "l"
        again, short = i in repeated, "s" if len(s) < 0.5 * width else "m" if len(s) < 0.85 * width else "f"
        count = min(len(s.split()), 8)
        where = f"t{top}" if top < 2 else f"b{bottom}" if bottom < 2 else "in"
        title = shape == "text" and start == "U" and end == "w" and 2 <= count <= 6 and not re.search(r"\d", s)
        gap = f"{(i == 0 or not lines[i - 1].strip())}{(i + 1 >= len(lines) or not lines[i + 1].strip())}"
        out[i] = [shape, f"{shape} {where}", f"{shape} again{again}", f"{shape} cut{cut}", f"{shape} {where} cut{cut}", f"{shape} {end} {short}", f"title{title} {where} again{again}", f"title{title} {where} n{count}", f"{shape} {where} {gap}", f"{start}{end} {where}", f"again{again} {start}{end} {short}", "bias"]
    return out


def page_examples(lexicon: Lexicon) -> list[tuple[list[str], str]]:
    """Lines of synthetic pages: words by their frequency, wrapped and broken, between headers, footers and numbers of many styles."""
    rng = random.Random(7)
    words = sorted(w for w in lexicon.counts if w.replace("-", "").isalpha())
    if len(words) < 20:
        words = [*words, *(f"слово{c}" for c in "абвгдежзиклмнопрст")]
    weights = [lexicon.counts.get(w, 1) for w in words]
    longer = [w for w in words if len(w) > 4] or words
    phrase = lambda n: " ".join(rng.choices(longer, k=n)).capitalize()
    examples = []

    def body(n_lines: int, width: int) -> list[str]:
        lines: list[str] = []
        while len(lines) < n_lines:
            kind = rng.random()
            if kind < 0.08:
                lines.append(f"{rng.randint(1, 20)} {phrase(rng.randint(3, 5))}")
                continue
            if kind < 0.12:
                lines += [f"{rng.choice('МВС')}{rng.randint(10, 400)} | {rng.randint(1, 99)} | {rng.randint(1, 9)},{rng.randint(0, 9)}" for _ in range(3)]
                continue
            text = f"{rng.randint(1, 9)}.{rng.randint(1, 30)} " if rng.random() < 0.6 else ""
            for _ in range(rng.randint(1, 3)):
                some = rng.choices(words, weights, k=rng.randint(7, 18))
                some = [f"{rng.randint(1, 999)} {w}" if rng.random() < 0.08 else w + "," if rng.random() < 0.07 else w for w in some]
                tail = rng.choice(["", "", "", f" {rng.randint(1, 20)}.{rng.randint(1, 30)}.{rng.randint(1, 9)}", f" {rng.choice('МВС')}{rng.randint(10, 400)}", f" равным {rng.randint(1, 900)} %"])
                text += " ".join(some).capitalize() + tail + ". "
            line = ""
            for w in text.split():
                if len(line) + len(w) + 1 > width:
                    room = width - len(line) - 2
                    if room >= 3 and len(w) - room > 2 and w.isalpha() and rng.random() < 0.5:
                        lines.append(f"{line} {w[:room]}{rng.choice(HYPHENS)}")
                        line = w[room:]
                        continue
                    lines.append(line)
                    line = w
                else:
                    line = f"{line} {w}".strip()
            lines.append(line)
            if rng.random() < 0.3:
                lines.append("")
        return lines[:n_lines]

    for _ in range(PAGES // 4):
        width, code, title, footer = rng.randint(38, 72), f"{rng.choice(['ГОСТ', 'ГОСТ Р', 'СП', 'СНиП'])} {rng.randint(1000, 99999)}-{rng.randint(1990, 2024)}", phrase(rng.randint(3, 5)), f"{phrase(rng.randint(2, 4))} № {rng.randint(1, 999)}"
        head = rng.choice(["code", "official", "caps", "spaced", "title", "codenumber", "titlenumber", "none"])
        number = rng.choice(["plain", "dot", "dash", "long", "стр. ", "Лист ", "roman", "mark", "none"])
        place, foot = rng.random() < 0.3, rng.random() < 0.35
        joined = rng.random() < 0.3  # several pages in one text
        pages = []
        for page in range(1, rng.randint(4, 8)):
            n = {"plain": f"{page}", "dot": f"{page}.", "dash": f"- {page} -", "long": f"— {page} —", "стр. ": f"стр. {page}", "Лист ": f"Лист {page}", "roman": ["i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix", "x", "xi", "xii"][page], "mark": f"[[PAGE:{page}]]", "none": ""}[number]
            h = {"code": code, "official": f"{code} (издание официальное)", "caps": title.upper(), "spaced": "   ".join(" ".join(w) for w in title.upper().split())[: rng.randint(25, 60)], "title": title, "codenumber": f"{code}    {page}", "titlenumber": f"{page}    {title}", "none": ""}[head]
            if h and rng.random() < 0.12:
                i = rng.randrange(len(h))
                h = h[:i] + rng.choice("0з~.тоб") + h[i + 1 :]
            over, under = [x for x in (h, n if place else "") if x], [x for x in (footer if foot else "", "" if place else n) if x]
            if h and rng.random() < 0.15:
                over = over[1:]
            gap = [""] if rng.random() < 0.4 else []
            text = body(rng.randint(8, 26), width)
            pages.append([*((x, True) for x in over), *((x, False) for x in gap), *((x, False) for x in text), *((x, True) for x in under), *([("", False)] if joined else [])])
        if joined:
            pages = [[x for page in pages for x in page]]
        keys = Counter(line_key(x) for page in pages for x, _ in page)
        for page in pages:
            lines = [x for x, _ in page]
            again = {i for i, x in enumerate(lines) if line_key(x) and keys[line_key(x)] > 1}
            for f, (_, label) in zip(line_features(lines, again), page):
                if f:
                    examples.append((f, "furniture" if label else "body"))
    return examples


# -- the operator ----------------------------------------------------------------------------------------------------------


class Model:
    """What the workers need, as plain fields."""

    def __init__(self, counts: dict[str, int], rare: list[str]) -> None:
        lexicon = Lexicon(counts)
        self.known, self.heads, self.masks = lexicon.counts, lexicon.heads, dict(lexicon.masks)
        self.editor = train(editor_examples(lexicon, rare), "K")
        self.joins = train(join_examples(lexicon), "join")
        self.furniture = train(page_examples(lexicon), "body")
        #: The surest edit of a known word: beyond it an edit counts even where it gives no known word.
        common = sorted(self.known, key=lambda w: (-self.known[w], w))[:RARE_WORDS]
        self.margin = max((surest(w, self.editor) for w in common), default=0.0)

    def fields(self) -> dict:
        return vars(self)


class Repairer:
    """Applies the models to texts."""

    def __init__(self, fields: dict) -> None:
        self.known, self.heads, self.masks, self.editor, self.joins, self.weights, self.margin = (fields[k] for k in ("known", "heads", "masks", "editor", "joins", "furniture", "margin"))
        self.backwards = sorted(w[::-1] for w in self.known)
        self.memory: dict[str, str | None] = {}
        self.fine: set[str] = set()

    def fix(self, word: str) -> str | None:
        """The known word meant by a misread one; the word itself, marked, where the editor is sure that it is misread and finds none; None for a sound or unknown one."""
        low = word.lower()
        latin = low.isascii() and low.isalpha()
        if low in self.known or len(low) > LONGEST or (len(low) if latin else len(_CYR.findall(low))) < (4 if latin else 3):
            return None
        if low not in self.memory:
            if len(self.memory) > 300_000:
                self.memory.clear()
            made = corrected(low, self.editor, self.known, self.masks)
            self.memory[low] = low if made is None and not latin and self.misread(low) else made
        made = self.memory[low]
        if made == low:
            return word
        if made is not None:
            return made.upper() if word.isupper() else made.capitalize() if word[0].isupper() else made
        return None

    def mended(self, line: str) -> str:
        """A line with its misread words replaced, whatever stands at its ends."""
        out, last = [], 0
        for at, w in words_in(line):
            made = self.fix(w) if w.lower() not in self.known else None
            if made is not None and made != w:
                out += [line[last:at], made]
                last = at + len(w)
        return "".join(out) + line[last:] if out else line

    def is_rest(self, word: str) -> bool:
        """Whether a word is how a known one ends."""
        back = word[::-1]
        i = bisect_left(self.backwards, back)
        return i < len(self.backwards) and self.backwards[i].startswith(back)

    def misread(self, low: str) -> bool:
        """Whether the editor is surer of an edit in a word or a part of one than of any in a known word."""
        return len(low) <= LONGEST and surest(low, self.editor) > self.margin

    def run(self, text: str, repeated: set[int]) -> tuple[list[tuple[int, str]], str]:
        """(line number from 1, kind) of the traces, and the text as continuous paragraphs."""
        lines = text.split("\n")
        lines = [x.rstrip("\r") for x in lines]
        if len(lines) == 1:
            furniture = set()
        else:
            furniture = {i for i, f in enumerate(line_features(lines, repeated)) if f and predict(self.weights, f, "body") == "furniture"}
        cases = [(i + 1, "furniture") for i in sorted(furniture)]
        body = [i for i, x in enumerate(lines) if x.strip() and i not in furniture]
        paragraphs: list[str] = []
        carry = ""  # the part of a word that a hyphen left at the end of the line before
        carried_from, carried_hyphen, open_line = -1, "", False
        for k, i in enumerate(body):
            line = lines[i]
            end = broken_end(line)
            tokens = line.split() if not carry and end is None else None
            sound = tokens is not None and self.fine.issuperset(tokens)
            found = [] if sound else words_in(line)
            replaced: list[tuple[int, int, str]] = []
            bad = False
            start = 0
            # a capital begins another sentence (or what is no furniture to the model): the rest of the word isn't here
            goes_on = carry and found and found[0][0] <= len(line) - len(line.lstrip()) + 1 and (found[0][1][0].islower() or not found[0][1][0].isalpha() or carry[-1:].isupper())
            if goes_on:
                at, tail = found[0]
                start = 1
                joins = predict(self.joins, _join_features(carry.lower(), core(tail).lower(), carried_hyphen, self.known, self.heads), "join") == "join"
                whole = carry + tail if joins else f"{carry}-{tail}"
                if joins:
                    cases.append((carried_from + 1, "hyphen"))
                made = self.fix(whole)
                if made is not None:
                    in_head, in_tail = self._sides(carry, tail, made)
                    if in_head:
                        cases.append((carried_from + 1, "chars"))
                    bad |= in_tail
                replaced.append((0, at + len(tail), made or whole))
            elif carry:
                if predict(self.joins, _join_features(carry.lower(), "", carried_hyphen, self.known, self.heads), "join") == "join":
                    cases.append((carried_from + 1, "hyphen"))
                replaced.append((0, 0, carry + " "))
            elif not k and len(lines) > 1 and found and found[0][0] <= len(line) - len(line.lstrip()) + 1 and self.is_rest(found[0][1]):
                start = 1  # of a word that the page before began
            stop = len(found)
            if end and found and core(found[-1][1].rstrip(HYPHENS)) and line.rstrip().endswith(found[-1][1]):
                stop -= 1
            carry_next, cut_at = "", len(line)
            if stop < len(found):
                at, w = found[-1]
                if stop >= start:
                    carry_next, cut_at = w.rstrip(HYPHENS), at
                else:
                    stop = start
            for at, w in found[start:stop]:
                made = self.fix(w)
                if made is not None:
                    bad = True
                    replaced.append((at, at + len(w), made))
            if bad:
                cases.append((i + 1, "chars"))
            elif tokens and not sound:
                if len(self.fine) > 300_000:
                    self.fine.clear()
                self.fine.update(t for t in tokens if len(t) <= LONGEST)
            pieces, last = [], 0
            for a, b, new in replaced:
                pieces += [line[last:a], new]
                last = b
            mended = ("".join(pieces) + line[last:cut_at]).strip()
            new_one = not paragraphs or (not open_line and (re.match(r"\s*(?:\d+(?:\.\d+)*[.)]?\s|[-—]\s|РАЗДЕЛ|Примечани|Приложени|Таблица)", line) is not None or "|" in line or (i > 0 and not lines[i - 1].strip()) or "|" in lines[body[k - 1]]))
            if new_one:
                paragraphs.append(mended)
            elif mended:
                paragraphs[-1] = f"{paragraphs[-1]} {mended}".strip()
            carry, carried_from, carried_hyphen = carry_next, i, end[1] if carry_next and end else ""
            open_line = bool(carry) or (bool(mended) and mended[-1] not in ".!?:;")
        if carry:
            if predict(self.joins, _join_features(carry.lower(), "", carried_hyphen, self.known, self.heads), "join") == "join":
                cases.append((carried_from + 1, "hyphen"))
            if self.misread(carry.lower()):
                cases.append((carried_from + 1, "chars"))
            if paragraphs:
                paragraphs[-1] = f"{paragraphs[-1]} {carry}{carried_hyphen}"
        return sorted(set(cases)), "\n\n".join(p for p in paragraphs if p)

    def _sides(self, head: str, tail: str, made: str) -> tuple[bool, bool]:
        """Whether a correction of head + tail changes the head, the tail."""
        low, whole, right = head.lower(), (head + tail).lower(), made.lower()
        if whole == right:  # misread beyond repair
            return self.misread(low), self.misread(tail.lower()) or not self.misread(low)
        a = 0
        while a < min(len(whole), len(right)) and whole[a] == right[a]:
            a += 1
        return a < len(low), a >= len(low)


def _keys(batches: Iterator[pa.RecordBatch], repairer: Repairer) -> Iterator[pa.RecordBatch]:
    """Keys of the lines that may be running matter, with their words repaired: a header is found again also where it is misread."""
    for batch in batches:
        out: tuple[list, ...] = ([], [], [], [], [])
        for t, v, r, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
            for i, line in enumerate(text.split("\n")):
                if k := line_key(line):
                    mended = repairer.mended(line)
                    for col, x in zip(out, (t, v, r, i, k if mended == line else line_key(mended) or k)):
                        col.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.string()), pa.array(out[3], pa.int32()), pa.array(out[4], pa.string())], ["table_name", "version_id", "record_id", "line", "key"])


def repaired(texts: DataFrame) -> DataFrame:
    """One row per text: table_name, record_id, cases (array of line_no, kind) and repaired (continuous paragraphs).

    ``texts`` has table_name, version_id, record_id and text. Null and blank texts have no cases and are left out, as are null
    record_ids; rows that repeat give repeated rows. Lines are numbered from 1 as the text is cut at line feeds.
    """
    texts = spread(texts.where("record_id is not null and length(trim(text)) > 0").select("table_name", "version_id", "record_id", "text"))
    spark = texts.sparkSession
    counts = durable(texts.select("text").mapInArrow(_count_words, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")))
    lexicon = {r.word: r.n for r in counts.where(F.col("n") >= LEAST_COUNT).orderBy(F.desc("n"), F.asc("word")).limit(LEXICON_WORDS).collect()}
    rare = [r.word for r in counts.where((F.col("n") < LEAST_COUNT) & (F.length("word") > 3)).orderBy(F.xxhash64("word")).limit(RARE_WORDS).collect()]
    shared = spark.sparkContext.broadcast(Model(lexicon, rare).fields())
    several = texts.where(F.contains("text", F.lit("\n")))
    keys = several.mapInArrow(lambda batches: _keys(batches, kept(shared, "repairer", Repairer)), "table_name string, version_id string, record_id string, line int, key string").distinct()
    # a header may stand on a third of all pages: its key is counted before it is joined, and the counts are one row each
    keyed = durable(keys)
    place = ["table_name", "version_id", "key"]
    often = keyed.groupBy(*place).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    hot = hot_keys(keyed, place)
    found = salted(keyed, hot, place, "record_id").join(replicated(often.select(*place), hot, place), [*place, "_salt"])
    again = found.groupBy("table_name", "record_id").agg(F.collect_set("line").alias("again"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repairer = kept(shared, "repairer", Repairer)
        cases_type = pa.list_(pa.struct([("line_no", pa.int32()), ("kind", pa.string())]))
        for batch in batches:
            done = [repairer.run(text, set(lines or ())) for text, lines in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            cases = pa.array([[{"line_no": n, "kind": k} for n, k in c] for c, _ in done], cases_type)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), cases, pa.array([t for _, t in done], pa.string())], ["table_name", "record_id", "cases", "repaired"])

    # only texts of several lines can hold repeated ones; the others, by far the most, pass without a shuffle
    marked = several.join(again, ["table_name", "record_id"], "left").select("table_name", "record_id", "text", "again")
    plain = texts.where(~F.contains("text", F.lit("\n"))).select("table_name", "record_id", "text", F.lit(None).cast("array<int>").alias("again"))
    out = "table_name string, record_id string, cases array<struct<line_no:int,kind:string>>, repaired string"
    return marked.unionByName(plain).mapInArrow(run, out)


def found_cases(fixed: DataFrame) -> DataFrame:
    """One row per case: table_name, record_id, line_no, kind."""
    return fixed.select("table_name", "record_id", F.explode("cases").alias("c")).select("table_name", "record_id", "c.line_no", "c.kind").distinct()
