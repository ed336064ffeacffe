"""Retrieval, pages and derived tables in the awkward cases that the registered queries don't reach."""

from pyspark.sql import functions as F

from docustrata.operators import answers, html, lexical, metrics, pipeline, relational, retrieval


def test_candidates_fall_back_to_code_and_title(spark):
    from docustrata.operators import resolve

    docs = spark.createDataFrame([("D1", "СП 1", "СП 1", "Кровли", "active"), ("D2", "СП 2", "СП 2", "Насосы", "active"), ("D3", None, None, None, None)], "document_id string, normalized_code string, display_code string, title string, status_normalized string")
    cards = spark.createDataFrame([("D1", "совсем другое")], "document_id string, card_text string")
    aliases = spark.createDataFrame([], "document_id string, alias_normalized string, confidence double")
    asked = spark.createDataFrame([(1, "что про насосы"), (2, "другое"), (3, "СП 1"), (4, ""), (5, None), (6, "zzz")], "item_id bigint, t string")
    q = resolve.parsed(asked, "item_id", "t")
    got = {(r.item_id, r.document_id) for r in retrieval.candidate_documents(q, docs, aliases, cards).collect()}
    assert got == {(1, "D2"), (2, "D1"), (3, "D1")}
    assert retrieval.candidate_documents(q.limit(0), docs, aliases, cards).count() == 0


def test_overlaps_in_several_blocks_with_repeated_keys_and_clashing_columns(spark, monkeypatch):
    monkeypatch.setattr(lexical, "QUERY_BLOCK", 2)
    monkeypatch.setattr(lexical, "CELLS", 3)
    q = spark.createDataFrame([(i, t) for i, t in enumerate(["aa bb", "bb cc dd", "zz", None, "aa aa"])], "item_id int, question string")
    texts = spark.createDataFrame([("k1", "aa", 1.0), ("k1", "aa bb", 2.0), ("k2", "cc", 1.0), ("k3", None, 1.0), (None, "aa", 1.0), ("k4", "bb " * 5000, 0.0)], "doc_id string, text string, score double")
    got = {(r.item_id, r.doc_id): (r.score, r.rk) for r in lexical.search(q, texts, k=2).collect()}
    assert got == {(0, "k1"): (1.0, 1), (0, "k4"): (0.5, 2), (1, "k1"): (0.3333, 1), (1, "k2"): (0.3333, 2), (4, "k1"): (1.0, 1)}
    assert lexical.search(q.limit(0), texts).count() == 0
    assert lexical.search(q, texts.limit(0)).count() == 0


def test_semantic_hits_pass_over_unusable_vectors(spark):
    v = lambda *x: [float(i) for i in x] + [0.0] * (64 - len(x))
    units = spark.createDataFrame([("U1", "V", "semantic_block", v(1)), ("U2", "V", "semantic_block", v(1, 1)), ("U3", "V", "document_card", v(1)), ("U4", "V", "semantic_block", v()), ("U5", "V", "semantic_block", [1.0]), ("U6", "V", "semantic_block", None), ("U7", None, "semantic_block", v(1)), ("U8", "V", "semantic_block", v(float("nan")))], "unit_id string, version_id string, unit_type string, embedding array<double>").withColumns({"start_order_index": F.lit(1), "locator_primary": F.lit(None).cast("string"), "heading_path": F.lit("h")})
    asked, vectors = spark.createDataFrame([(1, "V")], "qid int, version_id string"), spark.createDataFrame([(1, v(2))], "qid int, vector array<double>")
    assert [(r.hit_id, r.score) for r in retrieval.semantic_hits(asked, vectors, units, "qid", ["semantic_block"]).orderBy("hit_id").collect()] == [("U1", 1.0), ("U2", 0.7071)]
    assert retrieval.semantic_hits(asked, vectors, units, "qid", []).count() == 3


def test_list_pages_and_cards_of_broken_markup(spark):
    rows = [("a", "http://h/x/mega_doc/l.html", None), ("b", None, '<div class="table_doc"><div class="row"><div class="cell">1<div class="cell">'), ("c", "http://h/Index/c.htm", "<table class=doctab2><tr><td><b>Статус:</b><td>действует<h2>Скачать ГОСТ 1</h2>"), ("d", "http://h/other", "<p>x"), (None, "http://h/mega_doc/d.html", "<title>СП 1. Кровли</title>")]
    pages = spark.createDataFrame(rows, "page_id string, url string, html string")
    assert html.list_rows(pages).count() == 0
    cards = {r.page_id: r for r in html.card_data(pages).collect()}
    assert (cards["c"].source_type, cards["c"].card_status_raw.split(" ")[0]) == ("table_card", "действует")
    assert (cards[None].document_code, cards[None].document_title, cards[None].text_actualized_at) == ("СП 1", "Кровли", None)
    assert cards["d"].source_type is None
    assert html.card_data(pages.limit(0)).count() == html.list_rows(pages.limit(0)).count() == 0
    made = spark.createDataFrame([("p", 2, "u1", "x"), ("p", 1, "u1", "y"), ("p", 3, "", "z"), ("p", 4, "u2", "z")], "page_id string, row_no int, card_url string, status_raw string")
    assert [(r.card_url, r.list_status_raw) for r in html.card_jobs(made, made.where("card_url = 'u2'")).collect()] == [("u1", "y")]


def test_claims_in_an_object_or_a_list(spark):
    raw = ['x [{"text": "a", "evidence_ids": ["e"], "more": 1}] y', '{"mode": "direct", "claims": [{"text": "b", "evidence_ids": ["e"]}]}', "[broken", None, "[]"]
    got = spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "i int, r string").select("i", answers.parsed_claims(F.col("r")).alias("c")).orderBy("i").collect()
    assert [[c.text for c in r.c] for r in got] == [["a"], ["b"], [], [], []]


def test_claims_are_held_against_evidence_without_a_broadcast(spark):
    claims = spark.createDataFrame([(1, 1, "a", ["e2", "e1", "e2", "x", None]), (1, 2, "b", ["e2"]), (2, 1, "c", ["x"]), (3, 1, " ", ["e1"]), (4, 1, "d", ["e1"]), (5, 1, "f", None), (None, 1, "g", ["e1"])], "qid bigint, claim_no int, text string, evidence_ids array<string>")
    evidence = spark.createDataFrame([(1, "e1"), (1, "e2"), (1, None), (2, "e1"), (3, "e1"), (4, "e1"), (4, "e1"), (None, "e1")], "qid bigint, evidence_id string")
    drafts = spark.createDataFrame([(k, "direct", None if k == 1 else "t") for k in (1, 2, 3, 4, 5, None)], "qid bigint, mode string, text string")
    kept = answers.filtered_claims(claims, evidence, "qid")
    got = answers.verified_answers(drafts, kept, evidence, "qid")
    found, verified = kept.collect(), got.collect()
    assert not [df for df in (kept, got) if "Broadcast" in df._jdf.queryExecution().executedPlan().toString()]
    assert {(r.qid, r.claim_no): (r.kept_ids, r.supported) for r in found} == {(1, 1): (["e2", "e1"], True), (1, 2): (["e2"], True), (2, 1): ([], False), (4, 1): (["e1"], True), (5, 1): ([], False), (None, 1): ([], False)}
    no = "no supported claims"
    assert {r.qid: tuple(r)[1:] for r in verified} == {1: ("direct", "a b", 2, 2, None), 2: ("partial", "t", 0, 1, no), 3: ("partial", "t", 0, 1, no), 4: ("partial", "t", 1, 1, None), 5: ("no_answer", "t", 0, 0, no), None: ("no_answer", "t", 0, 0, no)}


def test_embedding_in_batches_and_shards(spark):
    units = spark.createDataFrame([(f"U{i}", "x" * i, 1) for i in range(1, 150)] + [("U0", " ", 1), ("Un", None, 1)], "unit_id string, text string, embedding int")
    done = pipeline.embedded(units, "unit_id", "text", lambda texts: [[float(len(t)), float(len(texts) <= 64)] for t in texts]).collect()
    assert len(done) == 149
    assert all(r.embedding == [float(r.unit_id[1:]), 1.0] for r in done)
    parts = [relational.shard(units, "unit_id", 3, i).count() for i in range(3)]
    assert sum(parts) == 151
    assert min(parts) > 20


def test_report_of_no_results(spark):
    r = metrics.evaluation_report(spark.createDataFrame([], "scenario string, document_hit boolean, locator_hit boolean, grounded boolean, unsupported boolean, partial boolean, mode_match boolean, forbidden boolean")).collect()
    assert [(x.scenario, x.n, x.document_hit_at_3) for x in r] == [("all", 0, 0.0)]


def test_blocks_of_a_version_that_spans_many_tasks(spark):
    import random

    from docustrata.operators import blocks

    rng = random.Random(3)
    rows = [(v, i, f"{v}-{i:04}", rng.choice(["a", "b"]), rng.choice(["paragraph"] * 8 + ["section"]), rng.choice([5, 80, 300, 900, 2000])) for v, n in (("hot", 900), ("v1", 3), ("v2", 1), ("v3", 60)) for i in range(n)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "version_id string, order_index int, id string, ctx string, node_type string, n_chars int")
    want: dict = {}
    for v in ("hot", "v1", "v2", "v3"):
        number = chars = count = 0
        last = None
        for _, _, i, ctx, kind, n in sorted(r for r in rows if r[0] == v):
            if count and ((chars >= 700 and (count >= 12 or chars >= 1800 or ctx != last or kind == "section")) or chars + n + 1 > 1800):
                number, chars, count = number + 1, 0, 0
            want[i] = number
            chars, count, last = chars + n + (1 if count else 0), count + 1, ctx
            if chars >= 1200 or count >= 12:
                number, chars, count = number + 1, 0, 0
    for size in (3, 40, 10_000):
        assert {r.id: r.block_no for r in blocks.block_numbers(df, part_rows=size).collect()} == want
    assert blocks.block_numbers(df.limit(0)).count() == 0


def test_groups_over_many_parts(spark):
    rows = [("hot", i) for i in range(500)] + [("a", 1), ("b", 1), ("b", 2)]
    df = spark.createDataFrame(rows, "g string, i int")
    for size in (7, 10_000):
        got = {(r.g, r.i): r.p for r in relational.numbered(df, ["g"], ["i"], "p", size).collect()}
        assert got == {(g, i): i + 1 if g == "hot" else i for g, i in rows}
        prev = {(r.g, r.i): r.b.i if r.b else None for r in relational.with_previous(df, ["g"], ["i"], ["i"], "b", size).collect()}
        assert prev == {(g, i): i - 1 if (g, i - 1) in rows else None for g, i in rows}
    assert relational.numbered(df.limit(0), ["g"], ["i"], "p").count() == 0
