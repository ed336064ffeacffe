"""From questions to documents: parsing, resolution by code and alias, discovery by content, and the documents' ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docustrata.functions.codes import alias_form, code_variants, family, is_legacy, is_placeholder, year
from docustrata.functions.scores import distance_score
from docustrata.functions.text import let, locator, squeeze, tokens
from docustrata.operators.lexical import best_overlaps
from docustrata.operators.relational import prefix_matches, top
from docustrata.session import durable

#: Code prefixes, and where codes and locators stand in a question.
PREFIX = "СП|СНИП|ГОСТ|SP|SNIP|GOST"
BEFORE = "(?:^|[^A-Za-zА-Яа-яЁё0-9_])"
CODE = rf"(?iu){BEFORE}((?:{PREFIX}) *[A-Za-zА-Яа-я0-9][A-Za-zА-Яа-я0-9./-]*)"
NUMERIC = rf"(?iu){BEFORE}((?:пункт|раздел|глава|таблица|табл\.?|section|chapter|table|п\.?) *[0-9]+(?:\.[0-9]+)*)"
APPENDIX = rf"(?iu){BEFORE}((?:приложение|прил\.?|appendix) *[A-Za-zА-Яа-я])(?:[^A-Za-zА-Яа-яЁё0-9_]|$)"
COMPACT = rf"(?iu)({BEFORE})({PREFIX})([0-9])"


def parsed(questions: DataFrame, qid: str, text: str) -> DataFrame:
    """qid, normalized_text, codes (variants, each once, in order), locators (numbered first), tokens. Null and blank texts have empty lists."""
    norm = F.regexp_replace(squeeze(F.coalesce(F.col(text), F.lit(""))), COMPACT, "$1$2 $3")
    q = questions.select(F.col(qid), norm.alias("normalized_text"))
    codes = F.array_distinct(F.flatten(F.transform(F.regexp_extract_all("normalized_text", F.lit(CODE), F.lit(1)), code_variants)))
    places = F.concat(*[F.regexp_extract_all("normalized_text", F.lit(p), F.lit(1)) for p in (NUMERIC, APPENDIX)])
    return q.select(qid, "normalized_text", codes.alias("codes"), F.array_distinct(F.array_compact(F.transform(places, locator))).alias("locators"), tokens(F.col("normalized_text")).alias("tokens"))


def resolved(questions: DataFrame, qid: str, documents: DataFrame, aliases: DataFrame, k: int | None = None) -> DataFrame:
    """Documents that a question's codes name: qid, document_id, score, reason, matched_value.

    ``questions`` from parsed; ``documents``: document_id, normalized_code, display_code, title; ``aliases``: document_id, alias_normalized,
    confidence. Canonical codes score 1.15, aliases 1 to 1.08, the 25 best alias prefixes 0.82 to 0.90, families 0.9; the best of a
    document is kept, the stronger reason on a tie; stubs are left out.
    """
    # both are read several times below; the questions' codes are few, the aliases would be derived again each time
    asked = durable(questions.select(qid, F.posexplode("codes").alias("pos", "code")))
    aliases = durable(aliases.select("document_id", "alias_normalized", "confidence"))
    conf = F.least(F.coalesce("confidence", F.lit(0.0)), F.lit(1.0)) * 0.08
    exact = asked.join(documents.select(F.col("normalized_code").alias("code"), "document_id"), "code").select(qid, "document_id", F.lit(1.15).alias("score"), F.lit("explicit_code").alias("reason"), F.lit(1).alias("rank"), F.col("code").alias("matched_value"))
    lowered = asked.withColumn("alias", alias_form(F.col("code")))
    by_alias = lowered.join(aliases.withColumnRenamed("alias_normalized", "alias"), "alias").select(qid, "document_id", (1.0 + conf).alias("score"), F.lit("exact_alias").alias("reason"), F.lit(2).alias("rank"), F.col("alias").alias("matched_value"))
    stems = lowered.select("alias").distinct().withColumnRenamed("alias", "stem")
    near = prefix_matches(stems, aliases.select("document_id", "confidence", "alias_normalized").distinct(), "stem", "alias_normalized")
    near = top(near, ["stem"], [F.desc(F.coalesce("confidence", F.lit(0.0))), F.asc("alias_normalized"), F.asc("document_id")], 25, "_n")
    by_prefix = lowered.join(near.withColumnRenamed("stem", "alias"), "alias").select(qid, "document_id", (0.82 + conf).alias("score"), F.lit("prefix_alias").alias("reason"), F.lit(3).alias("rank"), F.col("alias_normalized").alias("matched_value"))
    kin = asked.withColumn("family", family(F.col("code"))).select(qid, "family").distinct()
    by_family = kin.join(documents.select("document_id", family(F.col("display_code")).alias("family")), "family").select(qid, "document_id", F.lit(0.9).alias("score"), F.lit("explicit_family_fallback").alias("reason"), F.lit(4).alias("rank"), F.col("family").alias("matched_value"))
    found = exact.unionByName(by_alias).unionByName(by_prefix).unionByName(by_family)
    stubs = documents.where(is_placeholder(F.col("display_code"), F.col("title"))).select("document_id")
    best = found.join(stubs, "document_id", "left_anti").withColumn("score", F.bround("score", 4)).groupBy(qid, "document_id").agg(F.min(F.struct((-F.col("score")).alias("s"), "rank", "reason", "matched_value")).alias("b"))
    out = best.select(qid, "document_id", (-F.col("b.s")).alias("score"), F.col("b.reason").alias("reason"), F.col("b.matched_value").alias("matched_value"))
    return out if k is None else top(out, [qid], [F.desc("score"), F.asc("document_id")], k)


def code_bonus(codes: Column, candidate: Column) -> Column:
    """Bonus of a candidate's code for the question's codes, taken in order; a year in conflict counts against it."""

    def fold(own: Column) -> Column:
        def step(best: Column, c: Column) -> Column:
            kin = c["f"] == own["f"]
            gained = F.when(kin & own["c"].startswith(c["c"]), F.lit(0.22)).when(kin & c["c"].startswith(own["c"]), F.lit(0.14)).when(kin, F.lit(0.18)).otherwise(F.lit(0.0))
            clash = F.coalesce(c["y"] != own["y"], F.lit(False))
            return F.when(c["c"] == own["c"], F.greatest(best, F.lit(0.35))).otherwise(F.greatest(best, gained) - F.when(clash, F.lit(0.28)).otherwise(F.lit(0.0)))

        known = F.transform(codes, lambda c: F.struct(c.alias("c"), family(c).alias("f"), year(c).alias("y")))
        return F.aggregate(known, F.lit(0.0).cast("double"), step)

    return let(F.struct(candidate.alias("c"), family(candidate).alias("f"), year(candidate).alias("y")), fold)


def topic_bonus(found: Column, candidate: Column, topics: tuple = ()) -> Column:
    """Bonus of the family that the question's tokens speak for; a candidate has one family, so at most one applies.

    ``topics``: the caller's own table, rows of (token stems, ((family's code, bonus), ...)).
    """

    if not topics:
        return F.lit(0.0)

    def of(own: Column) -> Column:
        cases = [F.lit(0.0)]
        for stems, families in topics:
            pattern = "^(?:" + "|".join(stems) + ")"
            spoken = F.exists(found, lambda t: t.rlike(pattern))  # noqa: B023
            cases += [F.when(spoken & (own == family(F.lit(name))), F.lit(bonus)).otherwise(F.lit(0.0)) for name, bonus in families]
        return F.greatest(*cases)

    return let(family(candidate), of)


def reranked(candidates: DataFrame, qid: str, k: int = 6, topics: tuple = ()) -> DataFrame:
    """Rank candidates (qid, document_id, score, display_code, title, is_active, is_outdated, codes, tokens): qid, document_id, score, rk.

    Bonuses for the code, the topic, an active version (0.1) and the newest edition of a family (0.16, where no year was asked for);
    older editions lose up to 0.24, outdated versions 0.18, and former series 0.08 to 0.40 where modern documents compete.
    """
    code = F.col("display_code")
    rows = candidates.where(~is_placeholder(code, F.col("title"))).withColumns({"_family": family(code), "_year": year(code), "_legacy": is_legacy(code, F.col("title"))})
    kin = Window.partitionBy(qid, "_family")
    rows = rows.withColumns({"_latest": F.max("_year").over(kin), "_modern": F.max((~F.col("_legacy")).cast("int")).over(Window.partitionBy(qid))})
    asked_year = F.exists("codes", lambda c: year(c).isNotNull())
    asked_legacy = F.exists("codes", lambda c: is_legacy(c, F.lit(None).cast("string")))
    explicit = F.size("codes") > 0
    age = F.when(~asked_year & F.col("_year").isNotNull(), F.when(F.col("_year") == F.col("_latest"), F.lit(0.16)).otherwise(-F.least(F.lit(0.24), 0.06 * (F.col("_latest") - F.col("_year"))))).otherwise(F.lit(0.0))
    old = F.when((F.col("_modern") == 1) & ~asked_legacy & F.col("_legacy"), F.when(explicit, F.lit(-0.26)).otherwise(F.lit(-0.32))).otherwise(F.lit(0.0))
    older = F.when(~explicit & ~asked_legacy & F.col("_legacy"), F.lit(-0.08)).otherwise(F.lit(0.0))
    state = F.when(F.col("is_active"), F.lit(0.1)).otherwise(F.lit(0.0)) - F.when(F.col("is_outdated"), F.lit(0.18)).otherwise(F.lit(0.0))
    total = F.col("score") + code_bonus(F.col("codes"), code) + topic_bonus(F.col("tokens"), code, topics) + state + age + old + older
    scored = rows.select(qid, "document_id", "display_code", "_legacy", F.bround(total, 4).alias("score"))
    ranked = top(scored, [qid], [F.desc("score"), F.asc("_legacy"), F.asc("display_code"), F.asc("document_id")], k)
    return ranked.select(qid, "document_id", "display_code", "score", "rk")


def discovered(questions: DataFrame, cards: DataFrame, dense: DataFrame | None, qid: str = "item_id", qtext: str = "question", k: int = 8) -> DataFrame:
    """Documents found by their cards' words (cards: document_id, card_text), and by dense hits (qid, document_id, distance): qid, document_id, score, source_kind, rk.

    Dense hits gain 0.15; the best hit of a document is kept.
    """
    # a document's place among the worded ones is at most k where it is among the k best of all
    worded = best_overlaps(questions, cards, qid, qtext, "document_id", "card_text", k).select(qid, "document_id", "score", F.lit("document_card_lexical").alias("source_kind"))
    if dense is not None:
        worded = worded.unionByName(dense.select(qid, "document_id", F.bround(distance_score(F.col("distance")) + 0.15, 4).alias("score"), F.lit("document_card_dense").alias("source_kind")))
    best = worded.groupBy(qid, "document_id").agg(F.min(F.struct((-F.col("score")).alias("s"), "source_kind")).alias("b")).select(qid, "document_id", (-F.col("b.s")).alias("score"), F.col("b.source_kind").alias("source_kind"))
    return top(best, [qid], [F.desc("score"), F.asc("document_id")], k)


def scope(resolved_documents: DataFrame, questions: DataFrame, qid: str) -> DataFrame:
    """Versions a question is limited to: with explicit codes only that of its first document, else of all (resolved_documents: qid, version_id, rk)."""
    explicit = questions.select(qid, (F.size("codes") > 0).alias("_explicit"))
    have = resolved_documents.where("version_id is not null")
    first = F.row_number().over(Window.partitionBy(qid).orderBy("rk"))
    return have.withColumn("_n", first).join(explicit, qid).where("not _explicit or _n = 1").select(qid, "version_id", "rk")
