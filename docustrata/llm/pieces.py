"""Splitting oversized texts at natural boundaries, by one regular expression with bounded quantifiers.

The alternatives stand in the order of their boundaries' strength (rest of the text, paragraph, line, sentence, clause, blank) and
each consumes as much as the limit allows; the last one falls back to characters. SQL array functions turn the consumed spans into
pieces that look back over the agreed number of characters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIMIT = 1800
OVERLAP = 200
#: A stronger boundary is preferred to a longer piece from this share of the limit on; a blank is taken wherever there is one.
LEAST_SHARE = 0.4
#: What can't stand at either end of a stripped text.
EDGE = r"[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]+"


def stripped(c: Column) -> Column:
    """The text without leading and trailing blanks and line breaks."""
    return F.regexp_replace(c, rf"^{EDGE}|{EDGE}\z", "")


#: Boundaries from the strongest on, and the most characters each takes up.
BOUNDARIES = ((r"\r?\n[ \t]{0,2}\r?\n", 6), (r"(?:\r?\n|\r|\u2028)", 2), (r"[.!?…][»\")\]]?\s", 3), (r"[;:,]\s", 2), (r"\s[—–-]\s", 3))


def _span(most: int, beyond: int = 0) -> str:
    """One span of at most ``most`` characters, which ends after more than ``beyond`` of them unless the text does."""
    least = max(1, int(most * LEAST_SHARE), beyond)
    strong = [f".{{{least},{most - size}}}{end}" for end, size in BOUNDARIES if most - size >= least]
    blank = max(1, beyond)
    return "|".join([rf".{{1,{most}}}\z", *strong, *([rf".{{{blank},{most - 1}}}\s"] if most > blank else []), f".{{1,{most}}}"])


def split_pattern(limit: int = LIMIT, overlap: int = OVERLAP) -> str:
    """The first span may use the whole limit and is longer than what the second piece looks back over; later ones leave room for that."""
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be smaller than the limit")
    return rf"(?s)\A(?:{_span(limit, overlap)})|(?:{_span(limit - overlap)})"


def split_texts(items: DataFrame, key: str, text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Pieces of the texts longer than ``limit`` code points once stripped: key, piece_no, char_start, char_end, piece.

    char_start and char_end are code points of the stripped text. A piece has at most ``limit`` code points and starts ``overlap``
    code points before the end of the one before it; without the overlaps the pieces are the stripped text. Null, empty and short texts have no pieces. A key with
    several rows counts once (of differing texts the greatest). Rows with a null key are left out.
    """
    bare = items.where(F.col(key).isNotNull() & (F.length(text) > limit)).select(F.col(key).alias("_key"), stripped(F.col(text)).alias("_text"))
    one = bare.where(F.length("_text") > limit).groupBy("_key").agg(F.max("_text").alias("_text"))
    spans = F.regexp_extract_all("_text", F.lit(split_pattern(limit, overlap)), F.lit(0))
    # one fold over the spans makes all pieces: each is the tail of what came before and its own span, so no row carries the whole text
    start = F.struct(F.lit(0).alias("end"), F.lit("").alias("tail"), F.array().cast("array<struct<char_start:int,char_end:int,piece:string>>").alias("pieces"))

    def step(acc: Column, span: Column) -> Column:
        end = acc["end"] + F.length(span)
        piece = F.struct((acc["end"] - F.length(acc["tail"])).alias("char_start"), end.alias("char_end"), F.concat(acc["tail"], span).alias("piece"))
        tail = F.right(F.concat(acc["tail"], span), F.lit(overlap)) if overlap else F.lit("")
        return F.struct(end.alias("end"), tail.alias("tail"), F.array_append(acc["pieces"], piece).alias("pieces"))

    cut = one.select("_key", F.posexplode(F.aggregate(spans, start, step, lambda acc: acc["pieces"])).alias("_i", "_p"))
    return cut.select(F.col("_key").alias(key), (F.col("_i") + 1).alias("piece_no"), "_p.char_start", "_p.char_end", "_p.piece")
