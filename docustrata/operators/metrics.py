"""Corpus metrics, targets, evaluation reports, embedding workload and worker states."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docustrata.functions.scores import ratio_or_one, ratio_or_zero
from docustrata.functions.text import token_estimate

#: Parameters: targets of an ingestion, by metric; those named 'inactive...' are upper bounds.
TARGETS = {"list_pages_success_rate": 0.95, "active_documents_reaching_card_rate": 0.95, "active_documents_with_raw_rate": 0.90, "active_documents_with_text_rate": 0.85, "active_documents_structured_rate": 0.80, "active_index_documents_with_correct_status_rate": 1.0, "inactive_documents_in_active_index": 0.0}
#: States of update events.
UPDATED, UPDATE_FAILED = ["refresh_completed", "skipped_duplicate", "skipped_inactive_source", "skipped_unknown_source"], ["refresh_failed"]


def unpivoted(panel: DataFrame) -> DataFrame:
    """One row per metric: metric, value."""
    pairs = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in panel.columns])
    return panel.select(F.explode(pairs).alias("m")).select("m.metric", "m.value")


def ingestion_panel(documents: DataFrame, jobs: DataFrame, updates: DataFrame, low_confidence: float = 0.7) -> DataFrame:
    """One row of counts and safe rates over the documents, the jobs and the update events.

    documents, one row each: status, has_version, version_is_active, has_source, has_raw, has_text, has_ocr, parse_confidence, processing_status;
    jobs: job_type, status, payload (JSON text); updates: status. List pages and cards count once for each URL that isn't empty.
    Three aggregates of one row each are put side by side.
    """
    yes = lambda c: F.coalesce(F.col(c).cast("boolean"), F.lit(False))
    active, inactive = F.coalesce(F.col("status") == "active", F.lit(False)), F.coalesce(F.col("status") == "inactive", F.lit(False))
    structured, indexed = F.coalesce(F.col("processing_status").isin("normalized", "indexed"), F.lit(False)), F.coalesce(F.col("processing_status") == "indexed", F.lit(False))
    count = lambda c, name: F.count_if(c).alias(name)
    d = documents.agg(
        F.count(F.lit(1)).alias("documents_total"),
        count(active, "documents_active"),
        count(inactive, "documents_inactive"),
        count(~active & ~inactive, "documents_unknown"),
        count(yes("has_raw"), "documents_with_raw_artifacts"),
        count(yes("has_text"), "documents_with_extracted_text"),
        count(yes("has_ocr"), "documents_with_ocr"),
        count(F.col("parse_confidence") < low_confidence, "documents_with_low_confidence_parse"),
        count(structured, "documents_structured"),
        count(indexed, "documents_indexed"),
        count(active & yes("has_source"), "_card"),
        count(active & yes("has_raw"), "_raw"),
        count(active & yes("has_text"), "_text"),
        count(active & structured, "_structured"),
        count(active & indexed, "active_index_documents_with_correct_status"),
        count(inactive & indexed, "inactive_documents_in_active_index"),
        count(active & ~(yes("has_version") & yes("version_is_active")), "active_documents_without_active_version"),
        count(active & yes("has_version") & ~yes("has_text"), "active_versions_without_text_source"),
    )
    url = lambda field: F.nullif(F.get_json_object("payload", f"$.{field}"), F.lit(""))
    pages = F.when(F.col("job_type") == "parse_list_page", url("list_page_url"))
    j = jobs.agg(
        F.count_distinct(F.when(F.col("status") == "completed", pages)).alias("list_pages_processed_successfully"),
        F.count_distinct(pages).alias("list_pages_total"),
        F.count_distinct(F.when(F.col("job_type") == "process_document_card", url("card_url"))).alias("document_cards_discovered"),
    )
    u = updates.agg(count(F.col("status").isin(*UPDATED, *UPDATE_FAILED), "updates_detected"), count(F.col("status").isin(*UPDATED), "updates_successful"), count(F.col("status").isin(*UPDATE_FAILED), "updates_failed"))
    one = lambda df: df.withColumn("_one", F.lit(1))
    wide = one(d).join(one(j), "_one").join(one(u), "_one").drop("_one")
    rates = {
        "list_pages_success_rate": ("list_pages_processed_successfully", "list_pages_total"),
        "active_documents_reaching_card_rate": ("_card", "documents_active"),
        "active_documents_with_raw_rate": ("_raw", "documents_active"),
        "active_documents_with_text_rate": ("_text", "documents_active"),
        "active_documents_structured_rate": ("_structured", "documents_active"),
        "active_index_documents_with_correct_status_rate": ("active_index_documents_with_correct_status", "documents_indexed"),
    }
    out = wide.withColumns({k: F.bround(ratio_or_one(F.col(n), F.col(of)), 6) for k, (n, of) in rates.items()} | {"active_index_documents_total": F.col("documents_indexed")})
    return out.drop("_card", "_raw", "_text", "_structured")


def compared(metrics: DataFrame, targets: dict[str, float] = TARGETS) -> DataFrame:
    """Metrics against their targets: metric, actual, target, passed; upper bounds for counts named 'inactive...'; and the row 'all'."""
    values = F.create_map(*[x for k, v in targets.items() for x in (F.lit(k), F.lit(v))])
    rows = metrics.withColumn("target", F.element_at(values, F.col("metric"))).where("target is not null")
    passed = F.when(F.startswith("metric", F.lit("inactive")), F.col("value") <= F.col("target")).otherwise(F.col("value") >= F.col("target"))
    each = rows.select("metric", F.col("value").alias("actual"), "target", passed.alias("passed"))
    none = F.lit(None).cast("double")
    return each.unionByName(each.agg(F.bool_and("passed").alias("passed")).select(F.lit("all").alias("metric"), none.alias("actual"), none.alias("target"), "passed"))


def readiness(panel: DataFrame, targets: dict[str, float] = TARGETS) -> DataFrame:
    """Whether an ingestion is ready: check, passed; the row 'ready' for all of them."""
    met = F.lit(True)
    for k, v in targets.items():
        met = met & ((F.col(k) <= v) if k.startswith("inactive") else (F.col(k) >= v))
    checks = {
        "metrics_target_comparison_passed": met,
        "limited_sample_run_passed": (F.col("list_pages_total") > 0) & (F.col("documents_total") > 0) & (F.col("documents_indexed") > 0) & (F.col("documents_with_extracted_text") > 0),
        "inactive_documents_excluded_from_active_index": F.col("inactive_documents_in_active_index") == 0,
        "active_documents_have_active_version": F.col("active_documents_without_active_version") == 0,
        "active_versions_have_text_or_ocr": F.col("active_versions_without_text_source") == 0,
    }
    every = F.lit(True)
    for c in checks.values():
        every = every & c
    pairs = F.array(F.struct(F.lit("report_generated").alias("check"), F.lit(True).alias("passed")), *[F.struct(F.lit(k).alias("check"), c.alias("passed")) for k, c in checks.items()], F.struct(F.lit("ready").alias("check"), every.alias("passed")))
    return panel.select(F.explode(pairs).alias("c")).select("c.check", "c.passed")


RATES = {"document_hit": "document_hit_at_3", "locator_hit": "locator_hit_at_5", "grounded": "grounded_answer_rate", "unsupported": "unsupported_claim_rate", "partial": "partial_answer_rate", "mode_match": "expected_mode_match_rate", "forbidden": "wrong_document_rate"}


def evaluation_report(results: DataFrame) -> DataFrame:
    """Per scenario and for 'all': n and seven rates to 4 places; the locator rate is over the rows that have a verdict, 0 where none has.

    results: scenario, document_hit, locator_hit (nullable), grounded, unsupported, partial, mode_match, forbidden.
    """
    rates = [F.coalesce(F.bround(F.avg(F.col(c).cast("int")), 4), F.lit(0.0)).alias(name) for c, name in RATES.items()]
    own = results.groupBy("scenario").agg(F.count(F.lit(1)).alias("n"), *rates)
    return own.unionByName(results.agg(F.count(F.lit(1)).alias("n"), *rates).select(F.lit("all").alias("scenario"), "n", *RATES.values()))


def selected_questions(questions: DataFrame, order: str, scenario: str | None = None, limit: int | None = None) -> DataFrame:
    """The questions of a scenario (all if none is named), in their order, cut at a limit if there is one."""
    own = questions if scenario is None else questions.where(F.col("scenario") == scenario)
    return own.orderBy(order) if limit is None else own.orderBy(order).limit(limit)


def first_unique(rows: DataFrame, qid: str, value: str, order: str, n: int) -> DataFrame:
    """The first n different values of each question, whatever their case and spaces: qid, key, place."""
    from docustrata.functions.text import squeeze
    from docustrata.operators.relational import top

    seen = rows.where(F.length(F.coalesce(F.trim(value), F.lit(""))) > 0).groupBy(qid, F.lower(squeeze(F.col(value))).alias("key")).agg(F.min(order).alias("_at"))
    return top(seen, [qid], [F.asc("_at"), F.asc("key")], n, "place").select(qid, "key", "place")


def scored_results(found: DataFrame, gold: DataFrame, qid: str, k: int = 3) -> DataFrame:
    """Whether a question's first k distinct documents hold a gold one, exactly or by family: qid, hit, family_hit.

    found: qid, code, rk; gold: qid, code. Repeated documents keep their first place.
    """
    from docustrata.functions.codes import scoring_family
    from docustrata.operators.relational import top

    first = top(found.groupBy(qid, "code").agg(F.min("rk").alias("at")), [qid], [F.asc("at"), F.asc("code")], k)
    exact = first.join(gold.select(qid, "code"), [qid, "code"], "left_semi").select(qid).distinct().withColumn("_hit", F.lit(True))
    kin = first.withColumn("f", scoring_family(F.col("code"))).join(gold.select(qid, scoring_family(F.col("code")).alias("f")), [qid, "f"], "left_semi").select(qid).distinct().withColumn("_kin", F.lit(True))
    asked = gold.select(qid).distinct()
    return asked.join(exact, qid, "left").join(kin, qid, "left").select(qid, F.coalesce("_hit", F.lit(False)).alias("hit"), F.coalesce("_kin", F.lit(False)).alias("family_hit"))


def embedding_workload(units: DataFrame, text: str, embedding: str, dims: int, price_per_million: float = 0.15) -> DataFrame:
    """One row: total, pending, tokens and characters of pending texts, bytes and cost of their embeddings, average length."""
    pending = F.col(embedding).isNull()
    length = F.length(F.coalesce(F.col(text), F.lit("")))
    sums = units.agg(F.count(F.lit(1)).alias("total"), F.count_if(pending).alias("pending"), F.coalesce(F.sum(F.when(pending, token_estimate(F.col(text)))), F.lit(0)).alias("tokens"), F.coalesce(F.sum(F.when(pending, length)), F.lit(0)).cast("bigint").alias("characters"))
    return sums.select("*", (F.col("pending") * dims * 4).alias("bytes"), F.bround(F.col("tokens") * price_per_million / 1e6, 4).alias("cost"), F.bround(ratio_or_zero(F.col("characters"), F.col("pending")), 4).alias("average_chars"))


def worker_rollup(workers: DataFrame) -> DataFrame:
    """One row over workers (status, processed, remaining): status, processed, remaining.

    failed before running or queued before all completed before unknown; the queue is shared, so the least remaining counts.
    """
    any_ = lambda *s: F.coalesce(F.bool_or(F.col("status").isin(*s)), F.lit(False))
    status = F.when(any_("failed"), "failed").when(any_("running", "queued"), "running").when(F.coalesce(F.bool_and(F.col("status") == "completed"), F.lit(False)), "completed").otherwise("unknown")
    return workers.agg(status.alias("status"), F.coalesce(F.sum("processed"), F.lit(0)).cast("bigint").alias("processed"), F.min("remaining").alias("remaining"))


def histogram(rows: DataFrame, labels: list[str], value: str) -> DataFrame:
    """Count and sum of a value per label set, as a metrics registry keeps them."""
    return rows.groupBy(*labels).agg(F.count(value).alias("count"), F.bround(F.sum(value), 4).alias("sum"))


def exposition(rows: DataFrame, name: str, labels: list[str], value: Column) -> DataFrame:
    """Lines of the text exposition format: one sample per row."""
    pairs = F.concat_ws(",", *[F.concat(F.lit(f'{c}="'), F.regexp_replace(F.col(c).cast("string"), '(["\\\\])', r"\\$1"), F.lit('"')) for c in labels])
    return rows.select(F.concat(F.lit(name + "{"), pairs, F.lit("} "), value.cast("string")).alias("line"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
