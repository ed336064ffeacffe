"""A durable job queue as set operations: validated payloads, deduplicated creation, ready jobs, states from an event log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docustrata.functions.dates import retry_at
from docustrata.operators.relational import numbered

MAX_ATTEMPTS, RETRY_SECONDS = 3, 60
#: Fields that the payload of a job type must have.
REQUIRED = {"crawl_seed": ["seed_url"], "parse_list_page": ["list_page_url"], "process_document_card": ["card_url"], "download_artifacts": ["version_id"], "extract_text": ["version_id"], "normalize_document": ["version_id"], "index_document": ["version_id"], "refresh_document": ["document_id"]}
#: Error classes after which a job is tried again.
TEMPORARY = ["timeout", "connection", "rate_limit", "unavailable"]


def missing_fields(kind: Column, payload: Column) -> Column:
    """Required fields of a job's payload (JSON text) that are absent, null or blank; of unknown types ['job_type']."""
    out = F.when(F.lit(False), F.array().cast("array<string>"))
    for name, fields in REQUIRED.items():
        absent = [F.when(F.length(F.trim(F.coalesce(F.get_json_object(payload, f"$.{f}"), F.lit("")))) == 0, F.lit(f)) for f in fields]
        out = out.when(kind == name, F.array_compact(F.array(*absent)))
    return out.otherwise(F.array(F.lit("job_type")))


def dedup_key(kind: Column, payload: Column) -> Column:
    """Type and required fields, trimmed, joined by '|'; the type alone for unknown types."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, fields in REQUIRED.items():
        out = out.when(kind == name, F.concat_ws("|", kind, *[F.trim(F.coalesce(F.get_json_object(payload, f"$.{f}"), F.lit(""))) for f in fields]))
    return out.otherwise(kind)


def created(requests: DataFrame, open_keys: DataFrame | None = None) -> DataFrame:
    """Requests (request_id, job_key, created_at) that make a job: the first of each key that has no pending or running job."""
    first = requests.groupBy("job_key").agg(F.min(F.struct("created_at", "request_id")).alias("f")).select("job_key", F.col("f.request_id").alias("request_id"), F.col("f.created_at").alias("created_at"))
    return first if open_keys is None else first.join(open_keys.select("job_key").distinct(), "job_key", "left_anti")


def ready(jobs: DataFrame, now: Column, k: int | None = None) -> DataFrame:
    """Pending jobs (job_id, status, scheduled_at, created_at) that are due, oldest first, with their place in the queue."""
    due = jobs.where((F.col("status") == "pending") & (F.col("scheduled_at") <= now))
    order = [F.asc("scheduled_at"), F.asc("created_at"), F.asc("job_id")]
    return due.orderBy(*order) if k is None else due.orderBy(*order).limit(k)


def states(events: DataFrame) -> DataFrame:
    """State of each job from its events (job_id, event_id, ts, kind: create, claim, complete, temporary_error, permanent_error).

    The last event decides the status; errors count attempts, and a temporary one leaves the job pending, a minute on in whole
    seconds, until MAX_ATTEMPTS. All parts are partial aggregates, so a job with very many events is folded before the shuffle.
    """
    last = F.max_by(F.struct("kind", "ts"), F.struct("ts", "event_id"))
    error = F.col("kind").isin("temporary_error", "permanent_error")
    folded = events.where("job_id is not null").groupBy("job_id").agg(F.count_if(error).alias("attempts"), F.count(F.lit(1)).alias("n_events"), last.alias("l"), F.min("ts").alias("created_at"))
    again = (F.col("l.kind") == "temporary_error") & (F.col("attempts") < MAX_ATTEMPTS)
    status = F.when(F.col("l.kind") == "create", "pending").when(F.col("l.kind") == "claim", "running").when(F.col("l.kind") == "complete", "completed").when(again, "pending").otherwise("failed")
    return folded.select("job_id", "attempts", "n_events", status.alias("status"), F.when(again, retry_at(F.col("l.ts"), RETRY_SECONDS)).otherwise(F.col("created_at")).alias("scheduled_at"))


def is_temporary(error_class: Column) -> Column:
    return F.coalesce(F.lower(error_class).isin(*TEMPORARY), F.lit(False))


def claim_order(jobs: DataFrame) -> DataFrame:
    """The place of each job within its type, by schedule, creation and id. Jobs without a type have no place and are left out."""
    return numbered(jobs.where("job_type is not null"), ["job_type"], ["scheduled_at", "created_at", "job_id"], "place")
