"""The llm operators against brute force, exact round trips and other libraries, and in the awkward cases."""

import random
import unicodedata

import numpy as np
import pytest

from docustrata.llm import canonical, leaks, lookalikes, neighbours, pieces, scans, tokens
from docustrata.llm.perceptron import predict, train

LETTERS = "абвгдеё жзийк lmno\n.,;:!?0123²°🏗ｅ​ '’-"


def rand_text(rng, n, alphabet=LETTERS):
    return "".join(rng.choice(alphabet) for _ in range(n))


# -- neighbours ------------------------------------------------------------------------------------------------------------


def test_hilbert_curve_visits_all_cells_in_neighbouring_steps():
    for axes, bits in ((2, 4), (3, 3)):
        side = 1 << bits
        grid = np.stack(np.meshgrid(*[np.arange(side)] * axes, indexing="ij"), -1).reshape(-1, axes)
        keys = neighbours.hilbert_keys(grid, bits)
        assert sorted(keys.tolist()) == list(range(side**axes))
        path = grid[np.argsort(keys)]
        assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_neighbours_recall_against_brute_force(spark):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((40, 16))
    x = (centres[rng.integers(0, 40, 3000)] + 0.35 * rng.standard_normal((3000, 16))).astype(np.float32)
    rows = [(f"n{i}", [float(v) for v in e], "x") for i, e in enumerate(x)]
    rows += rows[:20] + [("bad1", [1.0], ""), ("bad2", [0.0] * 16, ""), ("bad3", None, ""), ("bad4", [float("nan")] * 16, ""), (None, [1.0] * 16, "")]
    df = spark.createDataFrame(rows, "id string, embedding array<float>, table_name string")
    got = neighbours.nearest([("t", df, "id", "embedding")], 16, window=256).toPandas()
    assert (got.groupby("id").size() == 5).all()
    assert len(got.id.unique()) == 3000
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = unit @ unit.T
    np.fill_diagonal(s, -9)
    best = np.argsort(-s, axis=1)[:, :5]
    found = got.groupby("id").neighbour_id.agg(set).to_dict()
    recall = np.mean([len(found[f"n{i}"] & {f"n{j}" for j in best[i]}) / 5 for i in range(3000)])
    assert recall >= 0.9
    pairs = neighbours.neighbour_pairs(neighbours.nearest([("t", df, "id", "embedding")], 16, window=256))
    assert pairs.where("id_a >= id_b").count() == 0


def test_neighbours_of_copies_and_of_no_rows(spark):
    schema = "id string, embedding array<float>"
    same = spark.createDataFrame([(f"c{i:03}", [1.0, 0.0]) for i in range(300)], schema)
    got = neighbours.nearest([("t", same, "id", "embedding")], 2, window=64).toPandas()
    assert (got.groupby("id").size() == 5).all()
    assert (got.similarity > 0.999).all()
    assert neighbours.nearest([("t", spark.createDataFrame([], schema), "id", "embedding")], 2).count() == 0
    assert neighbours.nearest([("t", spark.createDataFrame([("a", [1.0, 2.0])], schema), "id", "embedding")], 2).count() == 0


# -- pieces ----------------------------------------------------------------------------------------------------------------


def test_pieces_round_trip(spark):
    rng = random.Random(3)
    texts = [rand_text(rng, n) for n in (0, 5, 1799, 1800, 1801, 5000, 20000)] + ["x" * 9000, "слово " * 3000, " \n" + "а" * 1800 + " ", "🏗" * 4000, None, " \n\n ", "Строка.\r\n" * 900]
    df = spark.createDataFrame([(f"i{k}", t, 7) for k, t in enumerate(texts)] + [(None, "y" * 3000, 1), ("i5", texts[5], 7)], "id string, text string, piece_no int")
    got: dict = {}
    for r in pieces.split_texts(df, "id", "text").collect():
        got.setdefault(r.id, []).append(r)
    bare = {f"i{k}": t.strip().strip("﻿") for k, t in enumerate(texts) if t is not None}
    assert set(got) == {k for k, t in bare.items() if len(t) > 1800}
    for k, rows in got.items():
        rows.sort(key=lambda r: r.piece_no)
        assert [r.piece_no for r in rows] == list(range(1, len(rows) + 1))
        whole = ""
        for r in rows:
            assert 0 < len(r.piece) <= 1800
            assert r.piece == bare[k][r.char_start : r.char_end]
            if whole:
                assert r.char_start == len(whole) - 200
                assert r.piece[:200] == whole[-200:]
            whole = whole[: r.char_start] + r.piece
        assert whole == bare[k]


def test_pieces_end_at_the_strongest_boundary(spark):
    text = "а" * 900 + "\n\n" + "б" * 500 + ". " + "в" * 2000
    rows = sorted(pieces.split_texts(spark.createDataFrame([("i", text)], "id string, text string"), "id", "text").collect(), key=lambda r: r.piece_no)
    assert rows[0].piece.endswith("а\n\n")
    assert pieces.split_texts(spark.createDataFrame([], "id string, text string"), "id", "text").count() == 0
    with pytest.raises(ValueError, match="overlap"):
        pieces.split_pattern(10, 10)


def test_pieces_of_a_run_behind_an_early_blank(spark):
    texts = {"run": "abc " + "".join(chr(97 + i % 26) for i in range(3000)), "edge": "а" * 199 + " " + "б" * 3000, "beyond": "а" * 200 + " " + "б" * 3000}
    df = spark.createDataFrame(list(texts.items()), "id string, text string")
    for limit, overlap in ((1800, 200), (300, 250), (10, 9), (2, 1), (50, 0)):
        got: dict = {}
        for r in sorted(pieces.split_texts(df, "id", "text", limit, overlap).collect(), key=lambda r: r.piece_no):
            got.setdefault(r.id, []).append(r)
        for k, text in texts.items():
            end = 0
            for r in got[k]:
                assert r.char_start == (end - overlap if end else 0) >= 0
                assert 0 < len(r.piece) <= limit
                assert r.piece == text[r.char_start : r.char_end]
                assert r.char_end > end
                end = r.char_end
            assert end == len(text)


# -- scans -----------------------------------------------------------------------------------------------------------------

SCAN = "table_name string, version_id string, record_id string, text string, line_no int"
NOUNS = ["кровля", "плита", "балка", "узел", "стена", "труба", "насос", "пандус", "котлован", "фундамент", "покрытие", "устройство", "основание", "сечение", "жёсткость"]


def scan_rows():
    rng = random.Random(4)
    out = []
    for v in range(12):
        for p in range(1, 6):
            words = [rng.choice([*NOUNS, "инженерно-геологический", "допускается", "равным", "через"]) for _ in range(60)]
            lines = [" ".join(words[i : i + 6]) for i in range(0, 60, 6)]
            lines[0] = lines[0].capitalize()
            lines[-1] += "."
            out.append([f"V{v}", f"P{v}-{p}", [f"СП {1000 + v}-2010", *lines, f"- {p} -"]])
    return out


def test_scans_find_and_repair(spark):
    rows = scan_rows()
    rows[0][2][2] = rows[0][2][2] + " фунда-"
    rows[0][2][3] = "мента через " + rows[0][2][3]
    rows[1][2][4] = "насос инженерно-"
    rows[1][2][5] = "геологический через " + rows[1][2][5]
    rows[2][2][3] = "через к0тлован допускается"
    rows[0][2][6] += " фундамента" * 12
    data = [("ocr", v, r, "\n".join(x), 1) for v, r, x in rows]
    data += data[:3] + [("ocr", "V1", "empty", "", 1), ("ocr", None, "null", None, 1), ("ocr", "V1", None, "x", 1), ("ocr", "V1", "long", "а" * 50_000, 1)]
    fixed = scans.repaired(spark.createDataFrame(data, SCAN)).persist()
    cases = {tuple(r)[1:] for r in scans.found_cases(fixed).collect()}
    assert {(r, n, "furniture") for _, r, x in rows for n in (1, len(x))} == {c for c in cases if c[2] == "furniture"}
    assert {c for c in cases if c[2] == "hyphen"} == {("P0-1", 3, "hyphen")}
    assert {c for c in cases if c[2] == "chars"} == {("P0-3", 4, "chars")}
    text = {r.record_id: r.repaired for r in fixed.collect()}
    assert "фундамента через" in text["P0-1"]
    assert "инженерно-геологический" in text["P0-2"].replace("\n", "")
    assert "через котлован допускается" in text["P0-3"]
    assert "СП 1000" not in text["P0-1"]
    assert scans.repaired(spark.createDataFrame([], SCAN)).count() == 0


def test_scans_of_english_pages_and_of_words_split_between_pages(spark):
    rng = random.Random(12)
    english = ["concrete", "foundation", "bearing", "surface", "pressure", "drainage", "section", "thickness"]
    russian = ["тепловозащитный", "фундамент", "основание", "превышает", "сооружение", "допускается"]
    data = []
    for i in range(200):
        vocabulary = english if i % 2 else russian
        lines = [" ".join(rng.choices(vocabulary, k=7)).capitalize() for _ in range(6)]
        data.append(["ocr", f"V{i}", f"P{i}", lines])
    data[1][3][2] = "Bearing surface of foundatlon thickness section"
    data[0][3][0] = "возащитный фундамент допускается основание"
    data[0][3][3] = "Основание преволает фундамент"
    data[2][3][2] = "Основание соору}|{ение фундамент прев|||ает"
    for i in range(20, 80, 2):  # what the editor learns from
        data[i][3][1] = "Основание соору}|{ение фундамент" if i % 4 else "Основание допускаегся фундамент"
    data[3][3][4] = "Bearing xxvii surface, section \U0001d6fc\U0001d6fd\U0001d6fe thickness"
    rows = [(t, v, r, "\n".join(x), 1) for t, v, r, x in data]
    cases = {(r.record_id, r.line_no) for r in scans.found_cases(scans.repaired(spark.createDataFrame(rows, SCAN))).where("kind = 'chars'").collect()}
    assert {("P1", 3), ("P2", 3)} <= cases
    assert {(f"P{i}", 2) for i in range(20, 80, 2)} <= cases
    assert ("P0", 1) not in cases
    assert not {c for c in cases if c[0] == "P3"}


def test_perceptron_learns():
    data = [([f"f{i % 2}", "b"], "yes" if i % 2 else "no") for i in range(40)]
    w = train(data, "no")
    assert predict(w, ["f1", "b"], "no") == "yes"
    assert predict(w, ["f0", "b"], "yes") == "no"
    assert predict({}, ["f0"], "none") == "none"


def test_every_single_edit_is_tried():
    known = dict.fromkeys((f"{a}{b}конструкц{c}" for a in "бвгдклмн" for b in "аеиоу" for c in "ия"), 100) | {"железобетонирование": 100, "вода": 100}
    masks = dict(scans.Lexicon(known).masks)
    labels = [f"R{c}" for c in "бвгдежзийклмн"]
    weights = {"bias": {"K": 9.0, "D": -9.0} | {op: 8.0 - i / 10 for i, op in enumerate(labels)}}
    word = "железобетонирование"
    for i, ch in enumerate(word):
        assert scans.corrected(f"{word[:i]}ъ{word[i + 1 :]}", weights, known, masks) == word
        assert scans.corrected(f"{word[:i]}{word[i + 1 :]}", weights, known, masks) == word
        assert scans.corrected(f"{word[:i]}ъъ{word[i + 1 :]}", weights, known, masks) == word
        assert scans.corrected(f"{word[:i]}ъ{word[i:]}", weights, known, masks) == word
    assert scans.corrected("железобетонъъровъние", weights, known, masks) is None
    assert scans.corrected("воца", weights, known, masks) == "вода"
    assert scans.corrected("экран", weights, known, masks) is None


# -- canonical values ------------------------------------------------------------------------------------------------------

ENTRIES = [(1, "designation", "ГОСТ Р 863-2001"), (2, "designation", "СП 150.1402.2019"), (3, "designation", "СНиП 419-09-1996"), (11, "title", "Плитная камера сейсмической трубы для аэродромного уклона"), (12, "title", "Арматурный зазор осадочного здания для насосного соединения"), (21, "card_status", "имеет силу"), (22, "card_status", "не имеет силы"), (23, "card_status", "имеет силу с изменениями"), (24, "card_status", "вводится в действие")]


@pytest.mark.parametrize(
    ("kind", "typed", "entry"),
    [("designation", t, e) for t, e in (("гостр863—2001", 1), ("№ GOST R 863/2001", 1), ("Г0СТ Р 863-2001 с поправкой", 1), ("ГСОТ Р 863 2001", 1), ("ГОСТ Р 863-2002", -1), ("ГОСТ 863-2001", -1), ("SP 150,1402,2019", 2), ("см. СнП 419-09-1996;", 3), ("СНиП 419-09-1997", -1))]
    + [("title", t, e) for t, e in (("плитная камера сейсмичекой трубы для аэродромного уклона", 11), ("камера Плитная сейсмической трубы для аэродромного уклона (проект)", 11), ("Plitnaya kamera seysmicheskoy truby dlya aerodromnogo uklona", 11), ("Gkbnyfz rfvthf ctqcvbxtcrjq nhe,s lkz f'hjlhjvyjuj erkjyf", 11), ("Плитн. камера сейсмической трубы д/аэродромного уклона", 11), ("Плитная камера сейсмической трубы для аэродромного зазора", -1), ("Плитная камера", -1))]
    + [("card_status", t, e) for t, e in (("ИМЕЕТ_СИЛУ", 21), ("имеет силу с 01.02.2020", 21), ("не имеет сипы!", 22), ("имеет силу с изм.", 23), ("вводится в д-вие", 24), ("xxx", -1), ("статус", -1), ("0", -1))],
)
def test_canonical_values(kind, typed, entry):
    trie = canonical.EntryTrie([(e, t) for e, k, t in ENTRIES if k == kind])
    assert canonical.best(trie.matches(typed)) == entry


def test_word_automaton_matches_brute_force():
    def distance(a, b):
        d = {(i, j): i + j for i in range(len(a) + 1) for j in range(len(b) + 1) if not i or not j}
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
        return d[len(a), len(b)]

    rng = random.Random(5)
    words = list({rand_text(rng, rng.randint(3, 12), "абв") for _ in range(150)})
    trie = canonical.WordTrie()
    for i, w in enumerate(words):
        trie.add(w, i)
    for _ in range(200):
        typed = rand_text(rng, rng.randint(3, 12), "абвг")
        if typed in words:
            continue
        want = {i: x for i, w in enumerate(words) if (x := distance(typed, w)) <= canonical.allowed(max(len(typed), len(w)))and x <= canonical.allowed(len(typed) + 1)}
        assert trie.search(typed, False) == want


def test_known_words_have_neighbours_and_long_words_their_distance():
    trie = canonical.EntryTrie([(1, "Плита кровли насоса"), (2, "Плиты кровли насоса"), (3, "Плита кровли котлована"), (4, "Ось моста")])
    assert trie.matches("плита кровли насоса") == {1: 0, 2: 1}
    assert trie.matches("плиты кровли котлована") == {3: 1}
    assert trie.matches("плита кровли коловна") == {3: 2}
    assert trie.matches("ось мст") == {4: 2}
    rng = random.Random(9)
    words = canonical.WordTrie()
    spellings = sorted({rand_text(rng, rng.randint(3, 12), "абв") for _ in range(150)})
    for i, w in enumerate(spellings):
        words.add(w, i)
    for typed in [*spellings[:60], *(rand_text(rng, rng.randint(3, 12), "абвг") for _ in range(60))]:
        assert words.search(typed, False, canonical.REACH) == words.search(typed, False, 30)
        assert typed not in spellings or words.search(typed, False)[spellings.index(typed)] == 0


def test_mapped_values_tables(spark, monkeypatch):
    aliases = spark.createDataFrame([("A1", "D", "гост р 863-2001", None, "display_code", 1), ("A1", "D", "гост р 863-2001", None, "display_code", 1), ("A2", "D", " ", "сп 150 1402 2019", "display_code", 1), ("A3", None, None, None, "title", 1), ("A4", None, "ГОСТ Р 863-2001", "x", "display_code", 1), ("A5", None, "ы" * 30_000, None, "title", 1), ("A6", None, "x", None, None, 1)], "alias_id string, document_id string, alias_raw string, alias_normalized string, alias_type string, entry_id int")
    cards = spark.createDataFrame([("K1", "имеет силу!"), ("K2", None), ("K3", "???")], "card_id string, card_status_raw string")
    entries = spark.createDataFrame(ENTRIES, "entry_id bigint, list_name string, entry_text string")
    got = {(r.table_name, r.record_id): r.entry_id for r in canonical.mapped_values(aliases, cards, entries).collect()}
    assert got == {("document_aliases", "A1"): 1, ("document_aliases", "A2"): 2, ("document_aliases", "A5"): -1, ("document_aliases", "A6"): -1, ("document_cards", "K1"): 21, ("document_cards", "K3"): -1}
    assert canonical.mapped_values(aliases.limit(0), cards.limit(0), entries).count() == 0
    monkeypatch.setattr(canonical, "REFERENCE_CHARS", 40)  # several shards
    assert {(r.table_name, r.record_id): r.entry_id for r in canonical.mapped_values(aliases, cards, entries).collect()} == got


# -- tokens ----------------------------------------------------------------------------------------------------------------


def test_ids_equal_other_libraries(spark):
    tiktoken = pytest.importorskip("tiktoken")
    import os

    if not os.path.exists(tokens.VOCABULARY):
        pytest.skip("no vocabulary here")
    own = tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=tokens.load_ranks(tokens.VOCABULARY), special_tokens={})
    rng = random.Random(6)
    texts = [rand_text(rng, rng.randint(0, 400)) for _ in range(150)]
    texts += ["<|endoftext|>", "a" * 5000, "ё" * 1500, "абвгд" * 700, "   \n\n  x", "".join(chr(c) for c in range(1, 0x3000) if unicodedata.category(chr(c)) != "Cs"), "🏗" * 300, " ", "\t", "it's I'LL"]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate([*texts, "", None])], "doc_id bigint, text string, ids int")
    got = {r.doc_id: list(r.ids) for r in tokens.encode_corpus(df).collect()}
    for i, t in enumerate(texts):
        assert got[i] == own.encode_ordinary(t), i
    assert got[len(texts)] == [] == got[len(texts) + 1]
    assert tokens.encode_corpus(df.limit(0)).count() == 0


# -- leaks -----------------------------------------------------------------------------------------------------------------


def test_leaks_match_brute_force(spark):
    rng = random.Random(7)
    vocab = [f"слово{i}" for i in range(60)]
    passages = [(i, " ".join(rng.choices(vocab, k=rng.choice([5, 12, 30])))) for i in range(12)]
    texts = []
    for _ in range(120):
        w = rng.choices(vocab, k=40)
        p = rng.choice(passages)[1].split()
        n = rng.choice([8, 11, 12, 13, len(p)])
        at = rng.randrange(max(1, len(p) - n + 1))
        w[10:10] = [x.upper() + rng.choice([",", "", "​", ".\n"]) for x in p[at : at + n]]
        texts.append(" ".join(w).replace("о", rng.choice(["о", "o"])))
    texts += ["", None, "x " * 100_000]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id bigint, text string, item_id int")
    items = spark.createDataFrame([*passages, (99, None)], "item_id bigint, passage string")
    got = {tuple(r) for r in leaks.find_leaks(docs, items).collect()}
    runs = {i: {tuple(w[k : k + 12]) for k in range(len(w) - 11)} for i, w in ((i, leaks.words_of(p)) for i, p in passages)}
    want = set()
    for d, t in enumerate(texts):
        w = leaks.words_of(t or "")
        own = {tuple(w[k : k + 12]) for k in range(len(w) - 11)}
        want |= {(d, i) for i, r in runs.items() if r & own}
    assert got == want
    assert leaks.find_leaks(docs, items.limit(0)).count() == 0
    assert leaks.find_leaks(docs.limit(0), items).count() == 0


def test_leaks_without_regard_to_case_and_look_alikes(spark):
    english = "The Quick brown KITTEN jumps over many small boxes while Tom HELPS Bob make extra copies"
    russian = "Высота камеры и тёплый насос имеют особый вход у края моста Ростехнадзор принимает объект"
    items = spark.createDataFrame([(1, english), (2, russian)], "item_id bigint, passage string")
    like = str.maketrans("аеосрхуАВЕКМНОРСТХ", "aeocpxyABEKMHOPCTX")  # made by hand
    forms = [english, english.upper(), english.lower(), english.title(), english.swapcase(), english.replace(" ", "\u00a0\n"), english.replace("e", "e\u200b"), "".join(chr(ord(c) + 0xFEE0) if c != " " else c for c in english)]
    forms += [x for t in (russian, russian.upper(), russian.lower(), russian.title()) for x in (t, t.translate(like), unicodedata.normalize("NFD", t), t.replace(" ", ", "))]
    off = [" ".join(english.split()[:11]), english.replace("over", "0ver"), russian.replace("тёплый", "теплый").replace("объект", "субъект").replace("Высота", "Ширина").replace("моста", "дома")]
    docs = spark.createDataFrame(list(enumerate([*forms, *off])), "doc_id bigint, text string")
    got = {tuple(r) for r in leaks.find_leaks(docs, items).collect()}
    assert got == {(i, 1 if i < 8 else 2) for i in range(len(forms))}
    assert leaks.split_words("a_b c\u00add \u0301e e\u0301f ²") == ["a", "b", "cd", "e", "e\u0301f", "²"]


# -- look-alikes -----------------------------------------------------------------------------------------------------------


def test_lookalike_pairs(spark):
    base = "Ёлка стоит у дома № 5, 20 м²"
    same = [base, unicodedata.normalize("NFD", base), base.replace("о", "o"), base.replace(" ", " "), base.replace("т", "т​"), base.replace("5", "５")]
    other = [base.lower(), base.replace("²", "2"), base.replace("Ё", "Е"), base.replace(",", "."), base + "\n", "", " ", "​", None, "y" * 50_000]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate([*same, base, *other])], "doc_id bigint, text string, class_id int")
    got = {tuple(r) for r in lookalikes.visual_pairs(df).collect()}
    copies = [*range(len(same)), len(same)]
    assert got == {(a, b) for a in copies for b in copies if a < b and not {a, b} <= {0, len(same)}}
    forms = {r.doc_id: r.canonical_text for r in lookalikes.canonical_texts(df).collect()}
    assert len({forms[i] for i in copies}) == 1
    assert forms[len(same) + 1 + other.index(None)] is None
    assert lookalikes.visual_pairs(df.limit(0)).count() == 0


def test_lookalikes_of_greek_capitals_and_precomposed_letters(spark):
    groups = [["Площадь ПФГ", "Площадь ΠΦΓ", "Площадь ΠФΓ"], ["всё Ёлка", "всë Ëлка", "вс\u0065\u0308 \u0045\u0308лка"], ["Їжак", "Ïжак"], ["café", "cafe\u0301", "саfе\u0301"], ["Ά", "A\u0301", "Á"], ["Ḱ", "К\u0301", "Ќ"]]
    apart = ["все Елка", "Площадь ПФ", "Іжак", "cafe", "cafè", "А", "К"]
    texts = [t for g in groups for t in g] + apart
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {tuple(r) for r in lookalikes.visual_pairs(df).collect()}
    assert got == {(texts.index(a), texts.index(b)) for g in groups for a in g for b in g if texts.index(a) < texts.index(b)}
    forms = [r.f for r in df.orderBy("doc_id").select(lookalikes.visual_form(df.text).alias("f")).collect()]
    assert [lookalikes.python_form(f) for f in forms] == [lookalikes.python_form(t) for t in texts]
    for g in groups:
        assert len({lookalikes.python_form(t) for t in g}) == len({tuple(leaks.words_of(t)) for t in g}) == 1
    assert [len(leaks.words_of(t)) for t in ("élan café", "e\u0301lan cafe\u0301")] == [2, 2]
    assert lookalikes.python_form("Плёнка") == lookalikes.python_form("Плëнка") == "Плёнка"


def test_lookalikes_of_latin_words(spark):
    """The pairs are made by hand or by the standard's own decomposition, not from the operator's tables."""
    words = ["café plan", "schön", "Gdańsk", "naïve façade", "Ångström", "Čeština źdźbło", "ĺúčny ŕáno"]
    rows = [w for w in words] + [unicodedata.normalize("NFD", w) for w in words] + ["Total 15 mm", "Тоtаl 15 mm", "Тotal １５ ｍm", "Total\u202f15\u2009m\u200dm", "Total 16 mm", "total 15 mm", "cafe plan", "Gdansk"]
    n = len(words)
    want = {(i, i + n) for i in range(n)} | {(2 * n + a, 2 * n + b) for a in range(4) for b in range(a + 1, 4)}
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string")
    assert {tuple(r) for r in lookalikes.visual_pairs(df).collect()} == want
    keys = [r.k for r in df.orderBy("doc_id").select(lookalikes.block_key(df.text).alias("k")).collect()]
    assert all(keys[a] == keys[b] for a, b in want)
    assert len(set(keys)) >= n + 2  # Latin texts don't share one block


def test_lookalike_links_count_the_pairs(spark, monkeypatch):
    texts = ["Том А", "Toм A"] * 20 + ["Том А"] * 40 + ["один", "два", " ", None, "два"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, n_links string")
    pairs = [tuple(r) for r in lookalikes.visual_pairs(df).collect()]
    assert len(pairs) == len(set(pairs)) == 60 * 20
    links = {r.doc_id: r.n_links for r in lookalikes.visual_links(df).collect()}
    assert links == {i: sum(i in p for p in pairs) for i in range(len(texts))}
    monkeypatch.setattr(lookalikes, "BROADCAST_BYTES", 0)
    assert sorted(tuple(r) for r in lookalikes.visual_pairs(df).collect()) == sorted(pairs)


def test_column_and_python_forms_agree(spark):
    rng = random.Random(8)
    texts = [rand_text(rng, 80, LETTERS + "ABCxyzΟΡΤСсｆ． ﻿­") for _ in range(60)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = [r.f for r in df.select(lookalikes.visual_form(df.text).alias("f")).collect()]
    assert [unicodedata.normalize("NFC", g) for g in got] == [lookalikes.python_form(t) for t in texts]
