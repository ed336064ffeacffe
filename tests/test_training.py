"""Orphans, histories and hierarchies against brute force and in the awkward cases."""

import datetime as dt
import random
import shutil

import pytest
from pyspark.sql import functions as F

from docustrata.operators.hierarchy import descendants_of, hierarchy
from docustrata.operators.history import document_history
from docustrata.operators.orphans import OrphanLedger, final_ledger, parent_rows, periodic_counts, reference_keys, replay

REF = "id string, referenced_code_normalized string, matched_document_id string, created_at timestamp, field_name string"
REG = "document_id string, normalized_code string, created_at timestamp, deleted_at timestamp"
day = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(days=n)


def orphans_by_hand(refs, regs):
    out = set()
    for i, code, doc, at, _ in refs:
        for field, value, col in (("referenced_code_normalized", code, 1), ("matched_document_id", doc, 0)):
            if i is None or value is None or not value.strip():
                continue
            key = " ".join(value.split()).upper().rstrip(";:,").strip() if col else value
            if not any(r[col] == key and r[2] and at and r[2] <= at and r[3] is None for r in regs):
                out.add((i, field))
    return out


def test_orphans_match_brute_force(spark):
    rng = random.Random(1)
    codes = [f"СП {i}" for i in range(12)]
    regs = [(f"D{i % 12}", codes[i % 12], day(rng.randrange(400)), day(rng.randrange(400)) if rng.random() < 0.4 else None) for i in range(30)]
    refs = [(f"R{i}", rng.choice([*codes, "сп  3;", " ", "", None, "СП 99"]), rng.choice(["D1", "D5", "D77", None, "  "]), rng.choice([None, day(rng.randrange(500))]), "x") for i in range(150)]
    refs += refs[:10]
    got = {tuple(r) for r in final_ledger(spark.createDataFrame(refs, REF), spark.createDataFrame(regs, REG)).orphans().select("reference_id", "field_name").collect()}
    assert got == orphans_by_hand(refs, regs)


def test_ledger_resolves_reopens_and_recovers(spark, tmp_path):
    refs = reference_keys(spark.createDataFrame([("R1", "СП 1", None, day(50), "")], REF))
    parents = parent_rows(spark.createDataFrame([("D1", "СП 1", day(10), day(90))], REG))
    none, folder = parents.limit(0), str(tmp_path / "ledger")
    ledger = OrphanLedger(spark, folder, buckets=3, hot=refs.select("field_name", "ref_key"))
    ledger.advance(refs, none, none)
    assert ledger.orphans().count() == 1
    ledger.advance(refs.limit(0), parents, none)
    assert ledger.orphans().count() == 0
    ledger = OrphanLedger(spark, folder, buckets=3)  # after a restart, with a hot key that is none any more
    assert (ledger.step, ledger.number) == (2, 1)
    ledger.advance(refs, none, none, number=1)  # comes again
    (tmp_path / "ledger" / "refs" / "step=3").mkdir()  # what a lost step left
    ledger.advance(refs.limit(0), none, parents)
    ledger.advance(refs.limit(0), none, none)
    assert ledger.orphans().count() == 1
    for again in (OrphanLedger(spark, folder, buckets=3), ledger):
        row = again.snapshot().first()
        assert (row.period, row.n_references, row.n_orphans) == ("2024-02", 1, 1)
    assert [(r.step, r.n_orphans) for r in ledger.snapshots().orderBy("step").collect()] == [(1, 1), (2, 0), (3, 1), (4, 1)]
    ledger.compact()
    ledger = OrphanLedger(spark, folder, buckets=3)
    assert len(ledger.steps) == 1
    ledger.advance(refs.limit(0), parent_rows(spark.createDataFrame([("D2", "СП 1", day(40), None)], REG)), none)
    assert ledger.orphans().count() == 0
    assert ledger.snapshot().first().n_orphans == 0


def test_a_step_reads_touched_buckets_only(spark, tmp_path):
    rows = [(f"R{i}", f"СП {i}", None, day(50), "") for i in range(200)]
    refs, folder = reference_keys(spark.createDataFrame(rows, REF)), str(tmp_path / "ledger")
    none = parent_rows(spark.createDataFrame([], REG))
    ledger = OrphanLedger(spark, folder, buckets=16)
    ledger.advance(refs, none, none)
    for kept in (tmp_path / "ledger" / "refs" / "step=1").iterdir():
        if kept.name.startswith("bucket=") and kept.name != f"bucket={(one := refs.where("ref_key = 'СП 7'").select(ledger._bucket()).first().bucket)}":
            shutil.rmtree(kept)  # nothing there may be asked for
    ledger.advance(refs.limit(0), parent_rows(spark.createDataFrame([("D7", "СП 7", day(1), None)], REG)), none)
    assert {r.name for r in (tmp_path / "ledger" / "refs" / "step=2").iterdir() if "=" in r.name} == {f"bucket={one}"}
    assert ledger.snapshot().first().n_orphans == 199


def test_codes_that_normalize_to_nothing_name_nothing(spark):
    refs = spark.createDataFrame([("R1", " ,", None, day(1), ""), ("R2", "\u00a0;:", " ", day(1), ""), ("R3", "СП 1 ,", None, day(1), "")], REF)
    assert [r.ref_key for r in reference_keys(refs).collect()] == ["СП 1"]


def test_counts_after_every_step_match_brute_force(spark):
    rng = random.Random(2)
    codes = [f"СП {i}" for i in range(12)]
    regs = [(f"D{i % 12}", codes[i % 12], day(rng.randrange(400)), day(rng.randrange(400)) if rng.random() < 0.5 else None) for i in range(30)]
    refs = [(f"R{i}", rng.choice([*codes, None]), rng.choice(["D1", "D5", None]), rng.choice([None, day(rng.randrange(500))]), "x") for i in range(150)]
    tables = spark.createDataFrame(refs, REF), spark.createDataFrame(regs, REG)
    rows = periodic_counts(*tables, 4).collect()
    untils = {r.step: r.as_of for r in rows}
    assert sorted(untils) == [1, 2, 3, 4]
    assert untils[4] is None
    assert untils[1] < untils[2] < untils[3]
    for step, until in untils.items():
        fed = [r for r in refs if until is None or (r[3] is not None and r[3] < until)]
        arrived = [(*r[:3], r[3] if r[3] and (until is None or r[3] < until) else None) for r in regs if until is None or r[2] < until]
        open_now = orphans_by_hand(fed, arrived)
        want: dict = {}
        for r in fed:
            for field, value in (("referenced_code_normalized", r[1]), ("matched_document_id", r[2])):
                if value is not None:
                    n = want.setdefault((field, r[3].strftime("%Y-%m") if r[3] else None), [0, 0])
                    n[0] += 1
                    n[1] += (r[0], field) in open_now
        assert {(r.field_name, r.period): [r.n_references, r.n_orphans] for r in rows if r.step == step} == want
    last = {(r.field_name, r.period, r.n_references, r.n_orphans) for r in rows if r.step == 4}
    assert last == {tuple(r) for r in final_ledger(*tables).snapshot().collect()}
    assert periodic_counts(tables[0].limit(0), tables[1].limit(0)).count() == 0


def test_orphans_of_empty_tables(spark):
    for ledger in replay(spark.createDataFrame([], REF), spark.createDataFrame([], REG)):
        assert ledger.orphans().count() == 0


SNAP = "document_id string, snapshot_date date, loaded_at timestamp, status_normalized string, current_version_id string, text_actualized_at date, valid_from string"


def test_history_runs(spark):
    d = lambda m: dt.date(2024, m, 1)
    rows = [
        ("A", d(1), day(0), " Active ", "V1", None, "clash"),
        ("A", d(2), day(31), "active", "V1", None, ""),
        ("A", d(2), day(20), "old load", "V9", None, ""),
        ("A", d(4), day(90), "inactive", "V1", None, ""),  # a missing month ends nothing
        ("A", d(5), day(120), "ACTIVE", "V1", None, ""),
        ("A", d(5), day(120), "ACTIVE", "V1", None, ""),
        ("B", d(1), None, " ", None, None, ""),
        ("B", d(2), day(1), None, None, None, ""),
        (None, d(1), day(1), "x", "y", None, ""),
        ("C", None, day(1), "x", "y", None, ""),
    ]
    got = sorted((r.document_id, str(r.valid_from), str(r.valid_to), r.n_snapshots, r.is_current) for r in document_history(spark.createDataFrame(rows, SNAP)).collect())
    assert got == [("A", "2024-01-01", "2024-04-01", 2, False), ("A", "2024-04-01", "2024-05-01", 1, False), ("A", "2024-05-01", "9999-12-31", 1, True), ("B", "2024-01-01", "9999-12-31", 2, True)]
    assert document_history(spark.createDataFrame([], SNAP)).count() == 0


NODE = "id string, version_id string, order_index int, parent_node_id string, label string, block int, path string"


def tree_by_hand(parent):
    out = {}
    for n in parent:
        chain, x = [], n
        while x not in chain and parent[x] is not None and parent[x].strip() and parent[x] in parent:
            chain.append(x)
            x = parent[x]
        out[n] = ("", -1, None) if x in chain else (x, len(chain), " > ".join([x, *reversed(chain)]))
    return out


@pytest.mark.parametrize(("seed", "block"), [(1, 5), (2, 9), (3, 1000)])
def test_hierarchy_matches_brute_force(spark, seed, block):
    rng = random.Random(seed)
    names = [f"n{i}" for i in range(120)]
    parent = {n: rng.choice([names[max(0, i - 1)], names[max(0, i - rng.randint(1, 40))], rng.choice(names), None, " ", "gone"] if i else [None]) for i, n in enumerate(names)}
    rows = [(n, f"v{rng.randrange(3)}", i, p, n, 1, "x") for i, (n, p) in enumerate(parent.items())]
    tree = hierarchy(spark.createDataFrame([*rows, *rows[:7]], NODE), label=F.col("label"), block=block).persist()
    want = tree_by_hand(parent)
    got = {r.node_id: (r.root_id, r.tree_depth, r.path) for r in tree.collect()}
    assert got == want
    below = {n: set() for n in names}
    for n in names:
        x = n
        while want[n][1] >= 0 and x != want[n][0]:
            x = parent[x]
            below[x].add(n)
    assert {r.node_id: r.n_descendants for r in tree.where("not is_cyclic").collect()} == {n: len(below[n]) for n in names if want[n][1] >= 0}
    wanted = tree.where("node_id in ('n0', 'n3')").select("node_id")
    pairs = [tuple(r) for r in descendants_of(tree, wanted).collect()]
    assert sorted(pairs) == sorted((a, x) for a in ("n0", "n3") if want[a][1] >= 0 for x in below[a])
    assert sorted(tuple(r) for r in descendants_of(tree).collect()) == sorted((a, x) for a in names if want[a][1] >= 0 for x in below[a])


def test_hierarchy_long_chain_over_many_blocks(spark):
    rows = [(f"n{i:04}", f"v{i % 7}", i, f"n{i - 1:04}" if i else None, None, 0, "") for i in range(600)]
    got = hierarchy(spark.createDataFrame(rows, NODE), block=20)
    assert {r.node_id: (r.root_id, r.tree_depth) for r in got.collect()} == {f"n{i:04}": ("n0000", i) for i in range(600)}


def test_paths_of_a_deep_labelled_chain_are_streamed(spark, monkeypatch):
    from docustrata.operators import hierarchy as module

    n = 3000
    rows = [(f"n{i:05}", "v", i, f"n{i - 1:05}" if i else None, f"L{i}", 0, "") for i in range(n)]
    for block in (1000, 100_000):
        got = module.hierarchy(spark.createDataFrame(rows, NODE), label=F.col("label"), block=block)
        lengths = {r.node_id: r.n for r in got.select("node_id", F.length("path").alias("n")).collect()}
        want = 0
        for i in range(n):
            want += len(f"L{i}") + (3 if i else 0)
            assert lengths[f"n{i:05}"] == want
    import pyarrow as pa

    monkeypatch.setattr(module, "BATCH_CHARS", 100)
    batch = pa.RecordBatch.from_pydict({"node_id": ["a", "b", "c"], "parent_id": [None, "a", "b"], "root_id": ["a"] * 3, "tree_depth": [0, 1, 2], "entry": [0, 1, 2], "exit": [5, 4, 3], "n_descendants": [2, 1, 0], "is_cyclic": [False] * 3, "open": [0, 1, 2], "label": ["x" * 90, "y", None], "prefix": ["p", None, None]})
    parts = list(module._paths(iter([batch])))
    assert [p.num_rows for p in parts] == [2, 1]
    assert parts[1].column("path").to_pylist() == ["p > " + "x" * 90 + " > y"]


def test_hierarchy_of_no_rows_and_null_ids(spark):
    assert hierarchy(spark.createDataFrame([], NODE)).count() == 0
    assert hierarchy(spark.createDataFrame([(None, "v", 1, None, None, 0, "")], NODE)).count() == 0
