"""One consistent form for text that looks the same but differs in its characters.

A text is mapped in SQL: invisible characters go, every kind of space becomes a blank, width forms become ordinary ones and
look-alike letters of Latin and Greek become one letter. Mapped texts are then grouped under an accent-sensitive Unicode collation, which settles composed
and combining accents; each class takes its member with the least id as its canonical member, which is joined back.
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docustrata.operators.skew import HOT_SHARE, replicated, salted
from docustrata.session import durable, spread

#: Latin letters and the Cyrillic letters they look like.
LATIN = "ABCEHIJKMOPSTXYaceijopsxyhdqw"
CYRILLIC = "АВСЕНІЈКМОРЅТХУасеіјорѕхуһԁԛԝ"
#: Greek letters and the Cyrillic letters they look like.
GREEK = "ΑΒΕΗΙΚΜΝΟΡΤΥΧΖοϲϳ"
GREEK_TO = "АВЕНІКМNОРТУХZосј"
#: Greek capitals beyond those that the queries' SQL maps.
GREEK_MORE, GREEK_MORE_TO = "ΓΠΦ", "ГПФ"
#: Code points shown as nothing (soft hyphen, joiners, zero widths, directions, fillers, variation selectors, tags).
INVISIBLE = r"[\x{0}-\x{8}\x{e}-\x{1f}\x{7f}-\x{84}\x{86}-\x{9f}\x{ad}\x{34f}\x{61c}\x{115f}\x{1160}\x{17b4}\x{17b5}\x{180b}-\x{180f}\x{200b}-\x{200f}\x{202a}-\x{202e}\x{2060}-\x{206f}\x{3164}\x{fe00}-\x{fe0f}\x{feff}\x{ffa0}\x{fff9}-\x{fffb}\x{1d173}-\x{1d17a}\x{e0000}-\x{e0fff}]"
#: Spaces of other widths.
SPACES = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
#: Finds the first character that can be seen, so most texts are told from blank ones by one character.
VISIBLE = rf"[^\s\x{{85}}{SPACES}{INVISIBLE[1:-1]}]"
#: Candidates (a key and a digest, about so many bytes each) that are broadcast at most; beyond it they are joined by shuffle.
BROADCAST_BYTES, CANDIDATE_BYTES = 16_000_000, 100
#: Full-width forms stand at this distance from the ordinary characters.
_WIDE = range(0xFF01, 0xFF5F)


def _pairs() -> tuple[str, str]:
    wide = {chr(c): chr(c - 0xFEE0) for c in _WIDE}
    like = dict(zip(LATIN, CYRILLIC)) | dict(zip(GREEK, GREEK_TO))
    table = {**dict.fromkeys(SPACES, " "), **{w: like.get(o, o) for w, o in wide.items()}, **like}
    return "".join(table), "".join(table.values())


#: What the SQL maps too.
FROM, TO = _pairs()
_ALL_FROM, _ALL_TO = FROM + GREEK_MORE, TO + GREEK_MORE_TO


def _composed() -> dict[str, str]:
    """Precomposed letters whose base has a look-alike, taken apart: as they are, the mapping would pass them over."""
    bases = set(LATIN + GREEK + GREEK_MORE)
    apart = {chr(c): unicodedata.normalize("NFD", chr(c)) for c in range(0x80, 0x3000)}
    return {c: d for c, d in apart.items() if c != d and d[0] in bases}


COMPOSED = _composed()
_ACCENT = re.compile("[\u0300-\u036f]")
#: Ranges that hold them: a class of few ranges is searched far faster than one of many letters.
_COMPOSED = "\u00c0-\u0233\u0386-\u03d4\u1e00-\u1fff\u212a\u212b"
#: Width forms, for str.translate.
WIDE = {c: chr(c - 0xFEE0) for c in _WIDE}
#: Each letter and the one it is mapped to.
LIKE = {**dict(zip(LATIN, CYRILLIC)), **dict(zip(GREEK, GREEK_TO)), **dict(zip(GREEK_MORE, GREEK_MORE_TO))}
INVISIBLE_RE = re.compile(re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: "\\U" + m[1].zfill(8), INVISIBLE))


def _hidden() -> str:
    """The characters of INVISIBLE, one by one."""
    spans = re.findall(r"\\x\{(\w+)\}(?:-\\x\{(\w+)\})?", INVISIBLE)
    return "".join(chr(c) for a, b in spans for c in range(int(a, 16), int(b or a, 16) + 1))


HIDDEN = _hidden()


def _bare() -> tuple[str, str]:
    """For translate: precomposed characters, and the bare mapped letters in their place; then what is left out, marks and all that is seen as nothing or a blank."""
    single = dict(zip(_ALL_FROM, _ALL_TO))
    parts = {chr(c): d for c in (*range(0x80, 0x3100), *range(0xF900, 0xFB50)) if (d := unicodedata.normalize("NFD", chr(c))) != chr(c)}
    letters = single | {c: single.get(d[0], d[0]) for c, d in parts.items()}
    gone = {x for d in parts.values() for x in d[1:]} | {chr(c) for c in range(0x300, 0x10000) if unicodedata.combining(chr(c))} | set(HIDDEN + SPACES + " ")
    kept = {c: x for c, x in letters.items() if c not in gone and x not in gone}
    return "".join([*kept, *sorted(gone | (letters.keys() - kept.keys()))]), "".join(kept.values())


_BARE_FROM, _BARE_TO = _bare()


def _apart(c: Column) -> Column:
    """The text with such letters taken apart; only texts that hold letters of their ranges are cut at them."""
    table = F.create_map(*(F.lit(x) for pair in COMPOSED.items() for x in pair))
    runs = F.regexp_extract_all(c, F.lit(f"[^{_COMPOSED}]+|[{_COMPOSED}]"), F.lit(0))
    return F.when(c.rlike(f"[{_COMPOSED}]"), F.array_join(F.transform(runs, lambda x: F.coalesce(F.try_element_at(table, x), x)), "")).otherwise(c)


def visual_form(c: Column) -> Column:
    """The mapped text; composed and combining accents still differ here and are equal under the collation."""
    return F.translate(_apart(c), _ALL_FROM + HIDDEN, _ALL_TO)


def block_key(c: Column) -> Column:
    """A hash that texts which look the same have in common: of the mapped text without accents and blanks, by one pass of a table."""
    return F.xxhash64(F.translate(c, _BARE_FROM, _BARE_TO))


def python_form(text: str) -> str:
    """The same mapping for use inside a worker, composed; equal forms look the same.

    A mapped letter whose accent no Cyrillic letter has is composed to the precomposed one it looks like, so that it stays one letter.
    """
    if "_t" not in python_form.__dict__:
        single = str.maketrans(_ALL_FROM, _ALL_TO)
        apart = {c: d.translate(single) for c, d in COMPOSED.items()}
        python_form._t = single | str.maketrans(apart)
        python_form._j = {n: c for c, d in sorted(apart.items(), reverse=True) if len(n := unicodedata.normalize("NFC", d)) > 1}
        python_form._m = re.compile("|".join(sorted(python_form._j, key=len, reverse=True)))
    form = unicodedata.normalize("NFC", INVISIBLE_RE.sub("", text).translate(python_form._t))
    return python_form._m.sub(lambda m: python_form._j[m[0]], form) if _ACCENT.search(form) else form


def visual_classes(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row: the key, class_id (the least key whose text looks the same), text_hash and is_canonical.

    Null texts form no class (class_id null); empty and blank texts do, by the blanks that are seen. Extra columns are ignored.
    Texts are read once for their digests and blocks; only texts that share a block with another go on to the collation, and
    from there on digests are moved, not texts. A text with very many copies is one row until its class is joined to its copies, salted.
    """
    rows = documents.select(F.col(key).alias("_id"), F.col(text).alias("_text"))
    digest = F.unhex(F.sha2("_text", 256))
    keyed = durable(spread(rows).select("_id", digest.alias("text_hash"), block_key(F.col("_text")).alias("block")))
    texts = keyed.where("text_hash is not null").groupBy("text_hash", "block").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("n"))
    shared = texts.groupBy("block").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select("block")
    close = durable(texts.join(shared, "block", "left_semi").select(F.col("_first").alias("_id"), "text_hash"))
    wanted = F.broadcast(close) if close.count() * CANDIDATE_BYTES <= BROADCAST_BYTES else close
    formed = rows.join(wanted, "_id").where(digest == F.col("text_hash")).select("_id", "text_hash", F.collate(visual_form(F.col("_text")), "UNICODE").alias("_form"))
    classes = formed.groupBy("_form").agg(F.min("_id").alias("class_id"), F.collect_set("text_hash").alias("hashes"))
    members = classes.select("class_id", F.explode("hashes").alias("text_hash"))
    known = texts.join(members, "text_hash", "left").select("text_hash", "n", F.coalesce("class_id", "_first").alias("class_id"))
    hot = texts.where(F.col("n") > max(1000, keyed.count() * HOT_SHARE)).select("text_hash")
    copied = replicated(known.select("text_hash", "class_id"), hot, ["text_hash"])
    joined = salted(keyed.select("_id", "text_hash"), hot, ["text_hash"], "_id").join(copied, ["text_hash", "_salt"], "left")
    return joined.select(F.col("_id").alias(key), "class_id", "text_hash", (F.col("_id") == F.col("class_id")).alias("is_canonical"))


def canonical_texts(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row's key and canonical_text, the text of its class's canonical member in mapped form; null for null."""
    classes = visual_classes(documents, key, text)
    chosen = documents.select(F.col(key).alias("class_id"), visual_form(F.col(text)).alias("canonical_text")).dropDuplicates(["class_id"])
    return classes.join(chosen, "class_id", "left").select(key, "class_id", "canonical_text")


def _seen_classes(documents: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame, float]:
    """Classes of the texts that aren't blank, each class's size and number of copies of each text, and from which size on a class is hot."""
    classes = durable(visual_classes(documents.where(F.col(text).rlike(VISIBLE)), key, text))
    copies = classes.groupBy("class_id", "text_hash").agg(F.count(F.lit(1)).alias("n_copies"))
    mixed = copies.withColumn("n_members", F.sum("n_copies").over(Window.partitionBy("class_id"))).where("n_members > n_copies")
    return classes, mixed, max(1000, classes.count() * HOT_SHARE)


def visual_links(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row: the key, class_id and n_links, the number of rows whose text differs but looks the same; null and blank texts have none."""
    classes, mixed, many = _seen_classes(documents, key, text)
    hot = mixed.where(F.col("n_copies") > many).select("text_hash")
    links = replicated(mixed.select("text_hash", (F.col("n_members") - F.col("n_copies")).alias("n_links")), hot, ["text_hash"])
    linked = salted(classes, hot, ["text_hash"], key).join(links, ["text_hash", "_salt"], "left").select(F.col(key).alias("_k"), "class_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))
    rest = documents.where(~F.coalesce(F.col(text).rlike(VISIBLE), F.lit(False))).select(F.col(key).alias("_k"), F.lit(None).cast(documents.schema[key].dataType).alias("class_id"), F.lit(0).cast("bigint").alias("n_links"))
    return linked.unionByName(rest).withColumnRenamed("_k", key)


def visual_pairs(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pairs of keys (smaller first) whose texts differ but look the same; blank texts are left out. visual_links has them as one row for each key."""
    classes, mixed, many = _seen_classes(documents, key, text)
    members = classes.join(mixed.select("text_hash"), "text_hash", "left_semi").select("class_id", "text_hash", F.col(key).alias("k"))
    hot = mixed.where(F.col("n_members") > many).select("class_id").distinct()
    left = salted(members.select("class_id", F.col("text_hash").alias("h1"), F.col("k").alias("a")), hot, ["class_id"], "a")
    right = replicated(members.select("class_id", F.col("text_hash").alias("h2"), F.col("k").alias("b")), hot, ["class_id"])
    return left.join(right, ["class_id", "_salt"]).where("a < b and h1 <> h2").select(F.col("a").alias(f"{key}_a"), F.col("b").alias(f"{key}_b"))
