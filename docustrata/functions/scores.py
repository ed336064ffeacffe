"""Scores: overlap, cosine, layer and recognition quality, locator match, safe ratios, hash embeddings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docustrata.functions.text import tokens


def overlap(query_tokens: Column, text_tokens: Column) -> Column:
    """Share of the query's distinct tokens found in the text, to 4 places; 0 where either has none."""
    q, both = F.size(F.array_distinct(query_tokens)), F.size(F.array_intersect(query_tokens, text_tokens))
    return F.when((q == 0) | (F.size(text_tokens) == 0), F.lit(0.0)).otherwise(F.bround(both / F.nullif(q, F.lit(0)), 4))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where a vector is nought, an error where lengths differ."""
    same = F.assert_true(F.size(a) == F.size(b), F.lit("vectors differ in length"))
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(same.isNull(), F.when(norm == 0, F.lit(0.0)).otherwise(dot(a, b) / F.nullif(norm, F.lit(0.0))))


def distance_score(distance: Column) -> Column:
    """A cosine distance as a score from 0 on, to 4 places."""
    return F.bround(F.greatest(F.lit(0.0), F.lit(1.0) - distance), 4)


def ratio_or_one(n: Column, d: Column) -> Column:
    return F.when(d <= 0, F.lit(1.0)).otherwise(n / F.nullif(d, F.lit(0)))


def ratio_or_zero(n: Column, d: Column) -> Column:
    return F.when(d <= 0, F.lit(0.0)).otherwise(F.bround(n / F.nullif(d, F.lit(0)), 4))


def locator_score(query: Column, candidate: Column, heading: Column) -> Column:
    """1.06 for the same locator, 0.96 for one below it, 0.90 for one above it, 0.82 where the heading holds it, else 0."""
    q, c, h = (F.coalesce(x, F.lit("")) for x in (query, candidate, heading))
    inside = F.contains(F.lower(h), F.lower(q))
    return F.when((q == "") | ((c == "") & ~inside), F.lit(0.0)).when(c == q, F.lit(1.06)).when(c.startswith(F.concat(q, F.lit("."))), F.lit(0.96)).when((c != "") & q.startswith(F.concat(c, F.lit("."))), F.lit(0.90)).when(inside, F.lit(0.82)).otherwise(F.lit(0.0))


def recognition_confidence(c: Column) -> Column:
    """Quality of recognized text from the share of useful characters and its length, between 0 and 1."""
    solid = F.length(F.regexp_replace(c, "[ \t\r\n]+", ""))
    useful = F.length(F.regexp_replace(c, "[^0-9A-Za-zА-Яа-яЁё .,;:()\\-]+", ""))
    raw = F.lit(0.65) * useful / F.nullif(solid, F.lit(0)) + F.lit(0.35) * F.least(F.lit(1.0), solid / F.lit(300.0))
    return F.when(F.coalesce(solid, F.lit(0)) == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.bround(raw, 4))))


def is_low_confidence(c: Column, threshold: float = 0.7) -> Column:
    if not 0 <= threshold <= 1:
        raise ValueError("the threshold lies between 0 and 1")
    return F.coalesce(c < F.lit(threshold), F.lit(False))


def layer_score(chars: Column, letters: Column, pages: Column) -> Column:
    """Quality of a PDF's text layer from characters per page and the share of letters, between 0 and 1, to 4 places."""
    density = chars / F.nullif(pages, F.lit(0))
    share = letters / F.nullif(chars, F.lit(0))
    grown = F.when(density >= 400, F.lit(1.0)).when(density >= 100, 0.5 + (density - 100) / F.lit(600.0)).otherwise(density / F.lit(200.0))
    return F.when((F.coalesce(chars, F.lit(0)) == 0) | (F.coalesce(pages, F.lit(0)) == 0), F.lit(0.0)).otherwise(F.bround(grown * F.least(F.lit(1.0), share / F.lit(0.6)), 4))


def hash_embedding(texts: DataFrame, key: str, text: str, dims: int) -> DataFrame:
    """Sparse hashed vectors of length one: key, dim, value.

    Each token adds its sign and weight at the place its digest names: the first four bytes modulo ``dims``, the parity of the fifth, and 1 + sixth / 255.
    """
    if dims <= 0:
        raise ValueError("dims must be positive")
    exploded = texts.select(F.col(key), F.explode(tokens(F.col(text))).alias("token"))
    counted = exploded.groupBy(key, "token").agg(F.count(F.lit(1)).alias("n"))
    digest = F.sha2("token", 256)
    byte = lambda at, n: F.conv(F.substring(digest, at, n), 16, 10).cast("bigint")
    spread = counted.select(key, (byte(1, 8) % dims).cast("int").alias("dim"), (F.when(byte(9, 2) % 2 == 0, F.lit(1.0)).otherwise(F.lit(-1.0)) * (1 + byte(11, 2) / F.lit(255.0)) * F.col("n")).alias("w"))
    summed = spread.groupBy(key, "dim").agg(F.sum("w").alias("w"))
    norm = summed.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return summed.join(norm, key).where("norm > 0").select(key, "dim", (F.col("w") / F.col("norm")).alias("value"))
