"""References to records that do not exist, kept as incremental pending-orphan state.

The ledger is a folder of written segments, one set for each step, partitioned by key bucket:

* ``parents``: what arrived and what was deleted in the step (the parent index is all of these together);
* ``refs``: the step's new references with their verdicts, and the earlier references whose verdict the step changed;
* ``counts``: how the step changed the counts of each field and month, and a row that says the step is done.

A step writes only what it changes. It reads the parent index in the buckets its keys fall in, to judge the new references, and
the earlier references only in the buckets of keys that something arrived for or was deleted from: an arrival resolves waiting
references, a deletion reopens them. A step counts once its ``counts`` file is there, so a ledger can be opened again after a
failure, and what a lost step left is overwritten. ``compact`` folds all segments into one.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docustrata.functions.text import is_blank, normalize_code
from docustrata.operators.skew import hot_keys, replicated, salted
from docustrata.session import durable, shared_folder

KEY = ["field_name", "ref_key"]
FIELDS = ("referenced_code_normalized", "matched_document_id")
#: References that a bucket of a replay holds about.
BUCKET_ROWS = 250_000
_COUNT = "step int, number bigint, base int, until timestamp, has_refs boolean, has_parents boolean, field_name string, period string, n_references bigint, n_orphans bigint"


def reference_keys(references: DataFrame) -> DataFrame:
    """One row per reference and field that holds a value: reference_id, field_name, ref_key, created_at.

    Null and blank values name nothing and are left out, as is a code of which the code normalization leaves nothing (such as
    ' ,'); repeated rows count once.
    """
    keys = F.array(
        F.struct(F.lit(FIELDS[0]).alias("field_name"), normalize_code(F.col(FIELDS[0])).alias("ref_key"), is_blank(F.col(FIELDS[0])).alias("blank")),
        F.struct(F.lit(FIELDS[1]).alias("field_name"), F.col(FIELDS[1]).alias("ref_key"), is_blank(F.col(FIELDS[1])).alias("blank")),
    )
    rows = references.select(F.col("id").alias("reference_id"), F.col("created_at").alias("created_at"), F.explode(keys).alias("k"))
    rows = rows.where(~F.col("k.blank") & (F.col("k.ref_key") != "")).select("reference_id", "k.field_name", "k.ref_key", "created_at")
    return rows.dropDuplicates(["reference_id", "field_name", "ref_key", "created_at"])


def parent_rows(registry: DataFrame) -> DataFrame:
    """Registry rows under both of their keys: field_name, ref_key, created_at, deleted_at."""
    keys = F.array(
        F.struct(F.lit(FIELDS[0]).alias("field_name"), F.col("normalized_code").alias("ref_key")),
        F.struct(F.lit(FIELDS[1]).alias("field_name"), F.col("document_id").alias("ref_key")),
    )
    rows = registry.select("created_at", "deleted_at", F.explode(keys).alias("k"))
    return rows.where("k.ref_key is not null and created_at is not null").select("k.field_name", "k.ref_key", "created_at", "deleted_at").distinct()


class OrphanLedger:
    """Pending-orphan state; a reference is an orphan while no live parent of its key has created_at up to its own.

    A null created_at of a reference precedes every parent, so the reference is an orphan. A registry row without created_at
    never arrived. Results don't depend on how the rows are dealt to steps; a reference's row must come in one step only. The same
    folder opens the same ledger again, as its last finished step left it.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, buckets: int = 64, hot: DataFrame | None = None) -> None:
        """``folder``: shared storage; a new folder beside the checkpoints if none is given. ``buckets`` must stay the same for a folder.

        ``hot``: keys (field_name, ref_key) that hold a large share of the references, from skew.hot_keys; those of earlier openings stay.
        """
        self.spark, self.folder, self.buckets = spark, folder or shared_folder(spark, "orphans"), buckets
        if hot is not None:
            hot.select(*KEY).write.mode("append").parquet(f"{self.folder}/hot")
        known = self._read("hot") if folder or hot is not None else None
        self.hot = None if known is None or known.isEmpty() else known.select(*KEY).distinct()
        #: Finished steps since the last compaction, oldest first, each with its segments; the number of the last batch; the end of its span.
        self.steps: list[tuple[int, bool, bool]] = []
        self.number, self.until = -1, None
        done = self._counts().where("field_name is null").orderBy("step").collect() if folder else []  # a row for each step
        if done:
            self.steps = [(r.step, r.has_refs, r.has_parents) for r in done if r.step >= done[-1].base]
            self.number, self.until = done[-1].number, done[-1].until

    @property
    def step(self) -> int:
        """The number of the last finished step, 0 before the first."""
        return self.steps[-1][0] if self.steps else 0

    def _read(self, name: str, base: str | None = None) -> DataFrame | None:
        """Written rows, None where there are none."""
        from pyspark.errors import AnalysisException

        try:
            read = self.spark.read if base is None else self.spark.read.option("basePath", f"{self.folder}/{base}")
            return read.parquet(f"{self.folder}/{name}")
        except AnalysisException:  # no folder, or no file to take columns from
            return None

    def _counts(self) -> DataFrame:
        counts = self._read("counts")
        return self.spark.createDataFrame([], _COUNT) if counts is None else counts

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*KEY), F.lit(self.buckets)).cast("int").alias("bucket")

    def _segments(self, name: str) -> DataFrame | None:
        """All rows of a kind, with the step they come from; None where no step has any."""
        at = {"refs": 1, "parents": 2}[name]
        paths = [f"{self.folder}/{name}/step={s[0]}" for s in self.steps if s[at]]
        return self.spark.read.option("basePath", f"{self.folder}/{name}").parquet(*paths) if paths else None

    def _write(self, rows: DataFrame, name: str, step: int) -> DataFrame | None:
        """A step's segment, by bucket, in parts of even size however hot a bucket is; the written rows, None where there are none."""
        rows.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/{name}/step={step}")
        written = self._read(f"{name}/step={step}", name)
        return written if written is not None and "bucket" in written.columns else None

    @staticmethod
    def _firsts(parents: DataFrame, step: int) -> DataFrame:
        """Per key the first live parent before and after the step: before, after. What is deleted before it arrives is never live."""
        old = F.col("step") < step
        rows = parents.repartition("field_name", "ref_key").groupBy(*KEY, "created_at", "deleted_at").agg(
            F.bool_or(F.col("arrived") & old).alias("a0"), F.bool_or(F.col("gone") & old).alias("g0"), F.bool_or("arrived").alias("a1"), F.bool_or("gone").alias("g1")
        )
        return rows.groupBy(*KEY).agg(F.min(F.when(F.col("a0") & ~F.col("g0"), F.col("created_at"))).alias("before"), F.min(F.when(F.col("a1") & ~F.col("g1"), F.col("created_at"))).alias("after"))

    def advance(self, new_refs: DataFrame, arrived: DataFrame, deleted: DataFrame, number: int | None = None, until: datetime | None = None) -> None:
        """One step; ``arrived`` and ``deleted`` are parent rows, of which a deletion names the row that arrived, or will arrive.

        ``number``: of the batch; one that is finished already is passed over. ``until``: the end of the span that the step covers.
        """
        number = self.number + 1 if number is None else number
        if number <= self.number:
            return
        k = self.step + 1
        no, yes = F.lit(False), F.lit(True)
        events = arrived.select(*KEY, "created_at", "deleted_at", yes.alias("arrived"), no.alias("gone")).unionByName(deleted.select(*KEY, "created_at", "deleted_at", no.alias("arrived"), yes.alias("gone")))
        own = self._write(events.withColumn("bucket", self._bucket()), "parents", k)
        fresh = new_refs.select("reference_id", *KEY, "created_at").withColumn("bucket", self._bucket())
        touched = [] if own is None else self._buckets(own)
        asked = sorted({*touched, *(self._buckets(fresh) if self.buckets > 1 else [0])})
        fresh = fresh.withColumn("_salt", F.lit(0)) if self.hot is None else salted(fresh, self.hot, KEY, "reference_id")
        parts = [own.select(*events.columns, "bucket", "step")] if own is not None else []
        if (earlier := self._segments("parents")) is not None:
            parts.append(earlier.where(F.col("bucket").isin(asked)).select(*events.columns, "bucket", "step"))
        index = self._firsts(reduce(DataFrame.unionByName, parts) if parts else events.limit(0).withColumn("step", F.lit(k)), k)
        orphan = lambda c: ~F.coalesce(F.col(c) <= F.col("created_at"), no)
        judged = fresh.join(self._copied(index.select(*KEY, "after")), [*KEY, "_salt"], "left").select("reference_id", *KEY, "created_at", orphan("after").alias("orphan"), yes.alias("is_new"), "_salt", "bucket")
        if touched and (held := self._segments("refs")) is not None:
            changed = index.where("not before <=> after").join(own.select(*KEY).distinct(), KEY, "left_semi")
            waiting = held.where(F.col("is_new") & F.col("bucket").isin(touched)).drop("orphan", "step")
            again = waiting.join(self._copied(changed), [*KEY, "_salt"]).where(orphan("before") != orphan("after"))
            judged = judged.unionByName(again.select("reference_id", *KEY, "created_at", orphan("after").alias("orphan"), no.alias("is_new"), "_salt", "bucket"))
        mine = self._write(judged, "refs", k)
        changes = []
        if mine is not None:
            delta = F.when(F.col("is_new"), F.col("orphan").cast("int")).otherwise(F.when(F.col("orphan"), 1).otherwise(-1))
            months = mine.groupBy("field_name", F.date_format("created_at", "yyyy-MM").alias("period")).agg(F.count_if("is_new").alias("n_references"), F.sum(delta).alias("n_orphans"))
            changes = [tuple(r) for r in months.collect()]  # a row for each field and month
        self._finish(k, number, self.steps[0][0] if self.steps else k, until, changes, mine is not None, own is not None)

    def _copied(self, rows: DataFrame) -> DataFrame:
        """Rows of keys, once for each salt of a hot one."""
        return rows.withColumn("_salt", F.lit(0)) if self.hot is None else replicated(rows, self.hot, KEY)

    @staticmethod
    def _buckets(rows: DataFrame) -> list[int]:
        """The buckets that rows fall in: at most as many as the ledger has."""
        return [r.bucket for r in rows.select("bucket").distinct().collect()]

    def _finish(self, step: int, number: int, base: int, until: datetime | None, changes: list[tuple], has_refs: bool, has_parents: bool) -> None:
        """Write the counts in one file: from then on the step is done."""
        head = (step, number, base, until, has_refs, has_parents)
        rows = [(*head, *c) for c in changes] + [(*head, None, None, None, None)]
        self.spark.createDataFrame(rows, _COUNT).coalesce(1).write.mode("append").parquet(f"{self.folder}/counts")
        self.steps = [s for s in self.steps if s[0] >= base] + [(step, has_refs, has_parents)]
        self.number, self.until = number, until

    def references(self) -> DataFrame:
        """Every reference with its present verdict: reference_id, field_name, ref_key, created_at, orphan, _salt, bucket."""
        columns = ["reference_id", *KEY, "created_at"]
        rows = self._segments("refs")
        if rows is None:
            return self.spark.createDataFrame([], "reference_id string, field_name string, ref_key string, created_at timestamp, orphan boolean, _salt int, bucket int")
        last = rows.groupBy(*columns).agg(F.max_by(F.struct("orphan", "_salt", "bucket"), "step").alias("v"))
        return last.select(*columns, "v.orphan", "v._salt", "v.bucket")

    def orphans(self) -> DataFrame:
        """The references that are orphans now: reference_id, field_name, ref_key, created_at."""
        return self.references().where("orphan").select("reference_id", *KEY, "created_at")

    def snapshot(self) -> DataFrame:
        """Counts as they stand: field_name, period (month of created_at), n_references, n_orphans. Sums of the steps' changes, not a pass over the references."""
        done = self._counts().where(F.col("field_name").isNotNull() & (F.col("step") <= self.step))
        return done.groupBy("field_name", "period").agg(F.sum("n_references").alias("n_references"), F.sum("n_orphans").alias("n_orphans"))

    def snapshots(self) -> DataFrame:
        """The snapshot after every step: step, as_of (end of its span), field_name, period, n_references, n_orphans; running sums of the steps' changes."""
        ends = self._counts().where(F.col("field_name").isNull() & (F.col("step") <= self.step)).select("step", F.col("until").alias("as_of"))
        own = self._counts().where(F.col("field_name").isNotNull() & (F.col("step") <= self.step))
        running = own.select(F.explode(F.sequence(F.col("step"), F.lit(self.step))).alias("step"), "field_name", "period", "n_references", "n_orphans")
        return running.groupBy("step", "field_name", "period").agg(F.sum("n_references").alias("n_references"), F.sum("n_orphans").alias("n_orphans")).join(ends, "step")

    def compact(self) -> None:
        """Fold all segments into one, which later steps read in their place; verdicts and counts stay as they are."""
        if len(self.steps) < 2:
            return
        k = self.step + 1
        refs, parents = self._segments("refs"), self._segments("parents")
        if refs is not None:
            self._write(self.references().withColumn("is_new", F.lit(True)), "refs", k)
        if parents is not None:
            self._write(parents.groupBy(*KEY, "created_at", "deleted_at", "bucket").agg(F.bool_or("arrived").alias("arrived"), F.bool_or("gone").alias("gone")), "parents", k)
        self._finish(k, self.number, k, self.until, [], refs is not None, parents is not None)


def replay(references: DataFrame, registry: DataFrame, max_steps: int = 8) -> Iterator[OrphanLedger]:
    """Feed whole tables to a ledger in at most ``max_steps`` equal spans of time, in whole days; yields the ledger after each, its ``until`` the end of the span.

    The last span is open (``until`` None), so later deletions and rows without a time fall in it.
    """
    refs, parents = durable(reference_keys(references)), durable(parent_rows(registry))
    times = refs.select(F.col("created_at").alias("t")).unionByName(parents.select(F.col("created_at").alias("t")))
    low, high, rows = times.agg(F.min("t"), F.max("t"), F.count(F.lit(1))).first()
    ledger = OrphanLedger(references.sparkSession, None, max(1, -(-rows // BUCKET_ROWS)), hot_keys(refs, KEY))
    for a, b in spans(low, high, max_steps):
        within = lambda c: spanned(F.col(c), a, b)  # noqa: B023, E731
        deleted = parents.where("deleted_at is not null").where(within("deleted_at"))
        ledger.advance(refs.where(within("created_at")), parents.where(within("created_at")), deleted, until=b)
        yield ledger


def spans(low: datetime | None, high: datetime | None, most: int) -> list[tuple[datetime | None, datetime | None]]:
    """At most ``most`` spans of equal whole days between two times; the first has no start and the last no end."""
    if low is None:
        return [(None, None)]
    start = datetime(low.year, low.month, low.day)
    width = -(-((high - start).days + 1) // most)
    cuts = [start + timedelta(days=width * i) for i in range(1, most) if start + timedelta(days=width * i) <= high]
    return list(zip([None, *cuts], [*cuts, None]))


def spanned(c: Column, a: datetime | None, b: datetime | None) -> Column:
    """Times from ``a`` to before ``b``; nulls belong to the span without an end."""
    if b is None:
        return F.lit(True) if a is None else (c >= F.lit(a)) | c.isNull()
    return (c < F.lit(b)) if a is None else (c >= F.lit(a)) & (c < F.lit(b))


def final_ledger(references: DataFrame, registry: DataFrame, max_steps: int = 4) -> OrphanLedger:
    """The ledger after all steps."""
    for ledger in replay(references, registry, max_steps):  # noqa: B007
        pass
    return ledger


def periodic_counts(references: DataFrame, registry: DataFrame, max_steps: int = 8) -> DataFrame:
    """The snapshot after every step: step (from 1), as_of (end of its span, null for the last), field_name, period, n_references, n_orphans."""
    return final_ledger(references, registry, max_steps).snapshots()
