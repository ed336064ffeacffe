"""Claims against evidence: salvage of model output, the claim filter and the downgrade of answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docustrata.functions.text import citation, truncate_tail

CLAIMS = "array<struct<text:string,evidence_ids:array<string>>>"


def parsed_claims(raw: Column) -> Column:
    """Claims of a model's JSON: a list of claims, or an object with the list as its field ``claims``; of text around it the outermost brackets are read; none where nothing can be read.

    Only the fields text and evidence_ids are taken.
    """
    text = F.coalesce(raw, F.lit(""))
    inner = F.regexp_extract(text, r"(?s)\[.*\]", 0)
    within = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    listed = F.from_json(F.when((inner != "") & ~text.rlike(r"^[^\[]*\{"), inner), CLAIMS)
    held = F.from_json(F.when(within != "", within), f"struct<claims:{CLAIMS}>")["claims"]
    return F.coalesce(listed, held, F.from_json(F.when(inner != "", inner), CLAIMS), F.array().cast(CLAIMS))


def default_claims(answers: DataFrame, evidence: DataFrame, key: str) -> DataFrame:
    """For answers (key, text) that came without claims: the whole text as one claim on all evidence (key, evidence_id); none without text or evidence."""
    ids = evidence.groupBy(key).agg(F.sort_array(F.collect_set("evidence_id")).alias("evidence_ids"))
    filled = answers.where(F.length(F.trim(F.coalesce("text", F.lit("")))) > 0).join(ids, key)
    return filled.select(key, F.lit(1).alias("claim_no"), F.trim("text").alias("text"), "evidence_ids")


def grounded_mode(mode: Column, n_evidence: Column, least: int = 2, partial_allowed: bool = True) -> Column:
    """The mode an answer's evidence allows: direct on fewer than ``least`` pieces becomes partial (clarify where that isn't allowed); without evidence it stays."""
    return F.when((n_evidence > 0) & (mode == "direct") & (n_evidence < least), "partial" if partial_allowed else "clarify").otherwise(mode)


def is_terminal(mode: Column, n_evidence: Column, least: int = 2) -> Column:
    """Whether another pass over the evidence would add nothing."""
    return F.when(mode.isin("clarify", "no_answer"), F.lit(True)).when(mode == "partial", n_evidence > 0).when(mode == "direct", n_evidence >= least).otherwise(F.lit(False))


def final_mode(n_evidence: Column) -> Column:
    """The mode after the last pass: partial on any evidence, else no_answer."""
    return F.when(n_evidence > 0, "partial").otherwise("no_answer")


def evidence_bundle(pack: DataFrame, qid: str, limit: int = 900) -> DataFrame:
    """The evidence of each question (evidence_id, rk, source_kind, code, locator, heading_path, text) as lines of a prompt: qid, bundle. A pack has a few rows."""
    line = F.concat("evidence_id", F.lit(" | citation="), citation(F.col("code"), F.col("locator"), F.col("heading_path")), F.lit(" | source="), "source_kind", F.lit(" | text="), truncate_tail(F.coalesce("text", F.lit("")), limit))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("rk", line.alias("line")))), lambda x: x["line"])
    return pack.groupBy(qid).agg(F.array_join(lines, "\n").alias("bundle"))


def listed_evidence(evidence: DataFrame, key: str) -> DataFrame:
    """The evidence of each key, a few rows, as one: _all, its number, and _ids; always aggregated alike, so that a query shuffles it once."""
    lists = evidence.groupBy(key).agg(F.collect_list(F.struct("evidence_id")).alias("_held"))
    return lists.select(key, F.size("_held").alias("_all"), F.array_compact(F.col("_held.evidence_id")).alias("_ids"))


def filtered_claims(claims: DataFrame, evidence: DataFrame, key: str) -> DataFrame:
    """Claims (key, claim_no, text, evidence_ids) with the ids that are evidence of the same key: kept_ids, supported.

    Claims without text are dropped; an id counts once, in its first place. ``evidence``: key, evidence_id.
    The join is by merging: of rows that an explode makes, Spark expects too few bytes and would broadcast millions.
    """
    filled = claims.where(F.length(F.trim(F.coalesce("text", F.lit("")))) > 0)
    ids = F.coalesce(F.array_intersect("evidence_ids", "_ids"), F.array().cast("array<string>"))
    joined = filled.join(listed_evidence(evidence, key).hint("merge"), key, "left").withColumn("kept_ids", ids)
    return joined.select(key, "claim_no", "text", "kept_ids", (F.size("kept_ids") > 0).alias("supported"))


def cited_evidence(evidence: DataFrame, claims: DataFrame, key: str) -> DataFrame:
    """Evidence that a supported claim cites."""
    cited = claims.where("supported").select(key, F.explode("kept_ids").alias("evidence_id")).distinct()
    return evidence.join(cited, [key, "evidence_id"], "left_semi")


def verified_answers(answers: DataFrame, claims: DataFrame, evidence: DataFrame, key: str) -> DataFrame:
    """Answers (key, mode, text) after verification: mode, text, n_claims, n_evidence, limitation.

    Without a supported claim the mode is partial, or no_answer without evidence, and a limitation is added; direct answers on
    fewer than two pieces of cited evidence become partial; an empty text becomes the claims' texts. Cited evidence counts once an id.
    Joined by merging, as in filtered_claims.
    """
    supported = claims.where("supported").groupBy(key).agg(F.count(F.lit(1)).alias("n_claims"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("claim_no", "text"))), lambda x: x["text"]), " ").alias("_texts"), F.flatten(F.collect_list("kept_ids")).alias("_cited"))
    j = answers.join(supported.hint("merge"), key, "left").join(listed_evidence(evidence, key).hint("merge"), key, "left")
    n, e, a = (F.coalesce(c, F.lit(0)) for c in (F.col("n_claims"), F.array_size(F.array_intersect("_cited", "_ids")), F.col("_all")))
    mode = F.when(n == 0, F.when(a > 0, "partial").otherwise("no_answer")).when((F.col("mode") == "direct") & (e < 2), "partial").otherwise(F.col("mode"))
    text = F.when(F.length(F.trim(F.coalesce("text", F.lit("")))) > 0, F.col("text")).otherwise(F.coalesce("_texts", F.lit("")))
    return j.select(key, mode.alias("mode"), text.alias("text"), n.cast("bigint").alias("n_claims"), F.when(n == 0, a).otherwise(e).cast("bigint").alias("n_evidence"), F.when(n == 0, "no supported claims").alias("limitation"))


def merged_limitations(lists: Column) -> Column:
    """Limitations of several lists: trimmed, without blanks, each once."""
    return F.array_distinct(F.filter(F.transform(F.flatten(lists), lambda x: F.trim(x)), lambda x: x != ""))
