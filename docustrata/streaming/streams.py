"""The keyed states as Structured Streaming: job states, conversation memory, and the orphan ledger by micro-batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docustrata.functions.text import chunks
from docustrata.operators.jobs import MAX_ATTEMPTS, ready, states
from docustrata.operators.orphans import OrphanLedger, parent_rows, reference_keys


def job_states(events: DataFrame) -> DataFrame:
    """A job's state after each micro-batch (events: job_id, event_id, ts, kind), as operators.jobs.states gives it for all events."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last_ts, last_id, kind, attempts, n = state.get if state.exists else (None, None, None, 0, 0)
        for batch in batches:
            attempts += int(batch["kind"].isin(["temporary_error", "permanent_error"]).sum())
            n += len(batch)
            for ts, i, k in batch.sort_values(["ts", "event_id"])[["ts", "event_id", "kind"]].itertuples(index=False, name=None):
                at = ts.value
                if last_ts is None or (at, int(i)) > (last_ts, last_id):
                    last_ts, last_id, kind = at, int(i), k
        state.update((last_ts, last_id, kind, attempts, n))
        again = kind == "temporary_error" and attempts < MAX_ATTEMPTS
        status = {"create": "pending", "claim": "running", "complete": "completed"}.get(kind, "pending" if again else "failed")
        yield pd.DataFrame({"job_id": [key[0]], "attempts": [attempts], "n_events": [n], "status": [status]})

    kind = events.schema["job_id"].dataType.simpleString()
    return events.where("job_id is not null").groupBy("job_id").applyInPandasWithState(update, f"job_id {kind}, attempts bigint, n_events bigint, status string", "ts bigint, id bigint, kind string, attempts bigint, n bigint", "update", "NoTimeout")


def chat_tails(messages: DataFrame, n: int = 8) -> DataFrame:
    """The last n turns of a conversation after each micro-batch (messages: conv_id, turn, role); the state holds n turns only."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        turns = dict(zip(*state.get)) if state.exists else {}
        for batch in batches:
            turns |= {int(t): r for t, r in zip(batch["turn"], batch["role"])}
            turns = {t: turns[t] for t in sorted(turns)[-n:]}
        state.update((list(turns), list(turns.values())))
        yield pd.DataFrame({"conv_id": [key[0]], "turns": [",".join(str(t) for t in turns)], "n": [len(turns)]})

    kind = messages.schema["conv_id"].dataType.simpleString()
    return messages.where("conv_id is not null").groupBy("conv_id").applyInPandasWithState(update, f"conv_id {kind}, turns string, n bigint", "turns array<bigint>, roles array<string>", "update", "NoTimeout")


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Events per type and window of event time; what comes later than ``late`` is left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def orphan_batches(ledger: OrphanLedger, after: Callable[[OrphanLedger, int], None] | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function over change rows: kind (reference, registered, deleted) and the columns of both tables.

    The ledger's folder holds the number of the last finished batch, so a batch that comes again is passed over, also by a ledger
    that a restarted driver opened on the same folder.
    """

    def step(batch: DataFrame, number: int) -> None:
        if number <= ledger.number:
            return
        batch.persist()
        refs = reference_keys(batch.where("kind = 'reference'"))
        ledger.advance(refs, parent_rows(batch.where("kind = 'registered'")), parent_rows(batch.where("kind = 'deleted'")), number)
        batch.unpersist()
        if after:
            after(ledger, number)

    return step


def answer_events(answers: DataFrame, key: str = "answer_id", size: int = 120) -> DataFrame:
    """The events by which answers (key, mode, text) are sent to a reader: key, seq, kind (start, chunk, end), data. Works on tables and streams alike."""
    parts = F.transform(chunks(F.coalesce("text", F.lit("")), size), lambda x: F.struct(F.lit("chunk").alias("kind"), x.alias("data")))
    ends = lambda kind: F.array(F.struct(F.lit(kind).alias("kind"), F.col("mode").alias("data")))
    return answers.select(key, F.posexplode(F.concat(ends("start"), parts, ends("end"))).alias("seq", "e")).select(key, "seq", "e.kind", "e.data")


def correlated(events: DataFrame, **context: str) -> DataFrame:
    """Events with the run's context (such as a run and a request id) as columns, and a log line that holds both."""
    told = events.withColumns({k: F.lit(v) for k, v in context.items()})
    return told.withColumn("log_line", F.to_json(F.struct(*[F.col(c) for c in told.columns])))


def progress_gauges(states: DataFrame) -> DataFrame:
    """How many jobs are in each status, as states (job_id, status) come in: an update stream of status, n."""
    return states.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def worker_loop(work: Callable[[DataFrame], DataFrame], record: Callable[[DataFrame, int], None], now: Callable[[], datetime]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function over job events: the batch's jobs that are due are worked on, and what became of them is recorded as events.

    ``work`` takes due jobs (job_id, status, scheduled_at, attempts) and gives events (job_id, kind: complete, temporary_error, permanent_error); ``record``
    keeps them under the batch's number, so a batch that comes again replaces its own.
    """

    def step(batch: DataFrame, number: int) -> None:
        due = ready(states(batch), F.lit(now()))
        record(work(due), number)

    return step
