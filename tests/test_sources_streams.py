"""File sources, the artifact store, and streams against their batch counterparts."""

import pytest
from pyspark.sql import functions as F

from docustrata.operators import jobs
from docustrata.operators.orphans import OrphanLedger
from docustrata.sources import artifacts, files
from docustrata.streaming import streams

EVENTS = "job_id string, event_id bigint, ts timestamp, kind string"


def test_store(spark, tmp_path):
    store = artifacts.RawStore(str(tmp_path / "s"))
    store.save("v1/a.html", "<p>x</p>")
    store.save("v1/b.pdf", b"%PDF")
    with pytest.raises(FileExistsError):
        store.save("v1/a.html", "y")
    with pytest.raises(ValueError, match="leads out"):
        store.path("../x")
    rows = {r.relative_path: r for r in artifacts.registered(spark, store.root).collect()}
    assert rows["v1/a.html"].mime_type == "text/html"
    assert rows["v1/b.pdf"].file_size == 4
    assert artifacts.best_artifacts(artifacts.registered(spark, store.root)).first().relative_path == "v1/a.html"
    assert store.cleanup() == 0


def test_jsonl_and_appends(spark, tmp_path):
    (tmp_path / "q.jsonl").write_text('{"id": "a", "n": 1}\n\n{"id": "b", "n": 2}\n')
    df = files.read_jsonl(spark, str(tmp_path / "q.jsonl"), "id string, n int")
    assert df.count() == 2
    out = str(tmp_path / "t")
    files.append_new(df, out, ["id"])
    files.append_new(df, out, ["id"])
    assert spark.read.parquet(out).count() == 2
    assert files.without_keys(df, df.where("n = 1"), ["id"]).first().id == "b"
    files.write_state(str(tmp_path / "s.json"), {"k": 1})
    assert files.read_state(str(tmp_path / "s.json")) == {"k": 1}
    assert files.Settings.load(evidence_pack=3).evidence_pack == 3
    with pytest.raises(ValueError, match="unknown"):
        files.Settings.load(nothing=1)


def test_job_stream_equals_batch(spark, tmp_path):
    rows = [("j1", 1, "2024-01-01 00:00:00", "create"), ("j1", 2, "2024-01-01 00:01:00", "claim"), ("j1", 3, "2024-01-01 00:02:00.5", "temporary_error"), ("j2", 4, "2024-01-01 00:00:00", "create"), ("j2", 5, "2024-01-01 00:05:00", "permanent_error"), (None, 6, "2024-01-01 00:05:00", "create")]
    events = spark.createDataFrame(rows, "job_id string, event_id bigint, ts string, kind string").withColumn("ts", F.to_timestamp("ts"))
    events.where("event_id <= 3").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = streams.job_states(stream).writeStream.outputMode("update").format("memory").queryName("job_states_out").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    events.where("event_id > 3 or event_id is null").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    q.processAllAvailable()
    q.stop()
    got = {r.job_id: (r.attempts, r.n_events, r.status) for r in spark.sql("select * from job_states_out").collect()}
    want = {r.job_id: (r.attempts, r.n_events, r.status) for r in jobs.states(events).collect()}
    assert got == want == {"j1": (1, 3, "pending"), "j2": (1, 2, "failed")}
    assert str(jobs.states(events).where("job_id = 'j1'").first().scheduled_at) == "2024-01-01 00:03:00"


def test_chat_stream_keeps_the_tail(spark, tmp_path):
    m = spark.createDataFrame([("c", i, "user") for i in range(12)], "conv_id string, turn bigint, role string")
    m.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = streams.chat_tails(spark.readStream.schema(m.schema).parquet(str(tmp_path / "in")), 3).writeStream.outputMode("update").format("memory").queryName("tails_out").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select * from tails_out").first().turns == "9,10,11"


def test_orphan_batches(spark, tmp_path):
    schema = "kind string, id string, referenced_code_normalized string, matched_document_id string, created_at timestamp, document_id string, normalized_code string, deleted_at timestamp"
    import datetime as dt

    t = dt.datetime(2024, 1, 1)
    first = spark.createDataFrame([("reference", "R1", "СП 1", None, t, None, None, None)], schema)
    second = spark.createDataFrame([("registered", None, None, None, t, "D1", "СП 1", None)], schema)
    seen = []
    step = streams.orphan_batches(OrphanLedger(spark, str(tmp_path / "ledger")), lambda ledger, n: seen.append((n, ledger.orphans().count())))
    for n, batch in ((0, first), (1, second), (1, second)):
        step(batch, n)
    assert seen == [(0, 1), (1, 0)]


def test_external_boundary(spark):
    df = spark.createDataFrame([("v1", 2, " b  c \n\n"), ("v1", 1, "a"), ("v1", 3, " "), (None, 1, "x")], "version_id string, page_number int, text string")
    upper = artifacts.through(df, lambda pdf: pdf.assign(text=pdf["text"].str.upper()), df.schema.simpleString()[7:-1].replace(":", " "))
    assert artifacts.joined_pages(upper).first().combined_text == "A\n\nB C"


def test_fetching_keeps_its_rate_and_tries_again(spark):
    import pandas as pd

    calls, slept, now = [], [], [0.0]

    def get(url):
        calls.append(url)
        if url == "bad" or (url == "late" and calls.count("late") < 2):
            raise TimeoutError
        return (404 if url == "gone" else 200), b"x"

    def sleep(s):
        slept.append(s)
        now[0] += s

    out = artifacts.fetching(get, 2.0, 3, lambda: now[0], sleep)(pd.DataFrame({"url": ["a", "late", "bad", "gone"]}))
    assert out["error"].tolist() == [None, None, "TimeoutError after 3 tries", "status 404"]
    assert (len(calls), len(slept), set(slept)) == (7, 6, {0.5})


def test_pdf_texts_by_a_reader_of_pages(spark):
    files = spark.createDataFrame([("a", bytearray(b"x" * 900)), ("b", bytearray(b"")), ("c", None)], "path string, content binary")
    got = {r.path: r for r in artifacts.pdf_texts(files, lambda data: [data.decode() + "\n\n y", " "] if data else 1 / 0).collect()}
    assert (got["a"].combined_text, got["a"].n_pages, got["a"].needs_ocr) == ("x" * 900 + "\ny", 2, False)
    assert (got["b"].n_pages, got["b"].needs_ocr, got["c"].combined_text) == (0, True, "")
    assert artifacts.page_images(files, lambda data, dpi: [data[:1], b"2"]).count() == 4


def test_answer_events_gauges_and_worker(spark):
    import datetime as dt

    answers = spark.createDataFrame([("q", "direct", "abcde"), ("n", "no_answer", None)], "answer_id string, mode string, text string")
    events = streams.answer_events(answers, size=2).orderBy("answer_id", "seq").collect()
    assert [(e.answer_id, e.kind, e.data) for e in events] == [("n", "start", "no_answer"), ("n", "end", "no_answer"), ("q", "start", "direct"), ("q", "chunk", "ab"), ("q", "chunk", "cd"), ("q", "chunk", "e"), ("q", "end", "direct")]
    assert '"run":"r1"' in streams.correlated(answers, run="r1").first().log_line
    t = dt.datetime(2024, 1, 1)
    jobs = spark.createDataFrame([("j1", 1, t, "create"), ("j2", 2, t, "create"), ("j2", 3, t, "claim")], "job_id string, event_id bigint, ts timestamp, kind string")
    kept = {}
    step = streams.worker_loop(lambda due: due.select("job_id").withColumn("kind", F.lit("complete")), lambda done, n: kept.update({n: [r.job_id for r in done.collect()]}), lambda: t)
    step(jobs, 4)
    assert kept == {4: ["j1"]}
    from docustrata.operators.jobs import states

    assert {r.status: r.n for r in streams.progress_gauges(states(jobs)).collect()} == {"pending": 1, "running": 1}


def test_several_active_versions_fail_where_that_is_asked(spark):
    from docustrata.operators import versions

    docs = spark.createDataFrame([("D", None)], "document_id string, current_version_id string")
    v = spark.createDataFrame([("D", "V1", True, 1), ("D", "V2", True, 2)], "document_id string, version_id string, is_active boolean, created_at int")
    assert versions.active_versions(docs, v).first().version_id == "V2"
    with pytest.raises(Exception, match="several active versions"):
        versions.active_versions(docs, v, strict=True).collect()
