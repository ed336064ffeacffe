"""Queries on pages, jobs and conversations, with their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docustrata.operators import answers, conversation, html, jobs
from docustrata.plans import sql
from docustrata.sources.tables import table

QUERIES, ORACLES = {}, {}


def query(oracle: str | None = None):
    """Register a query, and its SQL where there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


# -- pages: built from cards on both sides ---------------------------------------------------------------------------------

_CARDS = "c AS (SELECT DISTINCT card_id, coalesce(document_code, '') AS code, coalesce(document_title, '') AS title, coalesce(card_status_raw, '') AS status FROM document_cards WHERE card_id IS NOT NULL)"
_E = lambda x: f"replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
_SQ = sql.squeeze


def pages(s: SparkSession, d: str) -> DataFrame:
    """A card page for every card: menu, table of label and value rows, links to artifacts and to list pages."""
    c = table(s, d, "document_cards").where("card_id is not null").select("card_id", *[F.coalesce(x, F.lit("")).alias(y) for x, y in (("document_code", "code"), ("document_title", "title"), ("card_status_raw", "status"))]).distinct()
    esc = lambda x: F.replace(F.replace(F.replace(F.col(x), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    row = lambda label, x: F.concat(F.lit(f"<tr><td>{label}:</td><td>"), esc(x), F.lit("</td></tr>"))
    body = F.concat(F.lit('<html><head><style>td {x}</style></head><body><div class="top_menu">Menu<p>more</p></div><table class="doctab2">'), row("Code", "code"), row("Title", "title"), row("Status", "status"), F.lit('</table><a href="'), "card_id", F.lit('.pdf">PDF</a><a href="/list/page_2.html">2</a><a href="http://list.example.org/list/page_3.html">3</a><footer>end</footer></body></html>'))
    return c.select("card_id", F.lit("http://list.example.org/list/page.html").alias("url"), body.alias("html"))


@query(f"""WITH {_CARDS} SELECT card_id, 'code' AS label, {_SQ('code')} AS value FROM c UNION ALL SELECT card_id, 'title', {_SQ('title')} FROM c UNION ALL SELECT card_id, 'status', {_SQ('status')} FROM c""")
def card_fields(s: SparkSession, d: str) -> DataFrame:
    return html.card_fields(html.read_pages(pages(s, d), "card_id"), "card_id")


@query(f"""WITH {_CARDS} SELECT card_id, sha256(array_to_string(list_filter(['Code:', {_SQ('code')}, 'Title:', {_SQ('title')}, 'Status:', {_SQ('status')}, 'PDF', '2', '3'], lambda x: x <> ''), chr(10))) AS text_hash FROM c""")
def page_text(s: SparkSession, d: str) -> DataFrame:
    return html.read_pages(pages(s, d), "card_id").select("card_id", F.sha2("text", 256).alias("text_hash"))


@query(f"""WITH {_CARDS} SELECT card_id, sha256(array_to_string(list_filter(['Menu', 'more', 'Code:', {_SQ(_E('code'))}, 'Title:', {_SQ(_E('title'))}, 'Status:', {_SQ(_E('status'))}, 'PDF', '2', '3'], lambda x: x <> ''), chr(10))) AS text_hash FROM c""")
def page_text_columns(s: SparkSession, d: str) -> DataFrame:
    return pages(s, d).select("card_id", F.sha2(html.page_text(F.col("html")), 256).alias("text_hash"))


@query(f"""WITH {_CARDS} SELECT card_id, CAST(0 AS INT) AS link_idx, 'http://list.example.org/list/' || card_id || '.pdf' AS href FROM c UNION ALL SELECT card_id, 1, 'http://list.example.org/list/page_2.html' FROM c UNION ALL SELECT card_id, 2, 'http://list.example.org/list/page_3.html' FROM c""")
def page_links(s: SparkSession, d: str) -> DataFrame:
    return html.read_pages(pages(s, d), "card_id").select("card_id", F.posexplode("links").alias("link_idx", "l")).select("card_id", "link_idx", "l.href")


@query(f"""WITH {_CARDS} SELECT card_id, CAST(2 AS INT) AS page_no, 'http://list.example.org/list/page_2.html' AS url FROM c UNION ALL SELECT card_id, 3, 'http://list.example.org/list/page_3.html' FROM c""")
def pagination(s: SparkSession, d: str) -> DataFrame:
    read = html.read_pages(pages(s, d), "card_id").withColumn("url", F.lit("http://list.example.org/list/page.html"))
    return html.pagination(read, "card_id")


@query(f"""WITH {_CARDS} SELECT DISTINCT card_id, CASE WHEN instr(b, '. ') > 0 THEN substr(b, 1, instr(b, '. ') - 1) END AS code, CASE WHEN instr(b, '. ') > 0 THEN trim(substr(b, instr(b, '. ') + 2), ' ') ELSE b END AS title
FROM (SELECT card_id, trim(regexp_replace({_SQ("'\"' || code || '. ' || title || '\"'")}, '^["«]+|["»]+$', '', 'g'), ' ') AS b FROM c)""")
def title_header(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "document_cards").where("card_id is not null").select("card_id", F.concat(F.lit('"'), F.coalesce("document_code", F.lit("")), F.lit(". "), F.coalesce("document_title", F.lit("")), F.lit('"')).alias("h")).distinct()
    return c.select("card_id", *html.title_header(F.col("h")))


# -- list pages and cards of both layouts, made of the cards: even numbers as a grid or a text, odd ones as a table --------

_LAYOUT = "k AS (SELECT DISTINCT card_id, CAST(right(card_id, 1) AS INT) AS no, coalesce(document_code, '') AS code, coalesce(document_title, '') AS title, coalesce(card_status_raw, '') AS status, text_actualized_at AS ad, published_at AS pd FROM document_cards WHERE card_id IS NOT NULL)"


def _fields(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "document_cards").where("card_id is not null")
    return c.select("card_id", F.right("card_id", F.lit(1)).cast("int").alias("no"), *[F.coalesce(x, F.lit("")).alias(y) for x, y in (("document_code", "code"), ("document_title", "title"), ("card_status_raw", "status"))], F.col("text_actualized_at").alias("ad"), F.col("published_at").alias("pd")).distinct()


def _escaped(x: str) -> Column:
    return F.replace(F.replace(F.replace(F.replace(F.col(x), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))


def list_pages(s: SparkSession, d: str) -> DataFrame:
    """For each card a list page with a header, the card's row, a row that all pages of the same last digit share, and one too short."""
    code, title, status = (_escaped(x) for x in ("code", "title", "status"))
    grid = F.concat(F.lit('<div class="table_doc"><div class="row header"><div class="cell">1</div><div class="cell"><a href="x.html">No</a></div><div class="cell">S</div></div><div class="row"><div class="cell">1</div><div class="cell"><a href="../doc_'), "card_id", F.lit('.html">'), code, F.lit(". "), title, F.lit('</a></div><div class="cell">'), status, F.lit('</div></div><div class="row"><div class="cell">2</div><div class="cell"><a href="../shared_'), F.col("no").cast("string"), F.lit('.html">"Shared. Title" (ред.)</a></div><div class="cell">ok</div></div><div class="row"><div class="cell">3</div></div></div>'))
    tab = F.concat(F.lit('<table class="doctab1"><tr class="m1"><td>1<td>2<td>3<td>4<tr class="m3"><td><a href="../Data2/1.pdf">pdf</a> <a href="../Index2/'), "card_id", F.lit('.htm">'), code, F.lit("</a></td><td>"), title, F.lit("</td><td>1</td><td><b>"), status, F.lit('</b></td></tr><tr class="m3"><td><a href="../Index2/shared_'), F.col("no").cast("string"), F.lit('.htm">Shared</a><td>Title<td>1<td>ok<tr class="m3"><td>short</table>'))
    even = F.col("no") % 2 == 0
    return _fields(s, d).select(F.col("card_id").alias("page_id"), F.when(even, "http://list.example.org/a/mega_doc/list_0.html").otherwise("http://list.example.org/a/list2/1-0.htm").alias("url"), F.when(even, grid).otherwise(tab).alias("html"))


_LIST_ROWS = f"""{_LAYOUT}, j AS (SELECT *, {_SQ("code || '. ' || title")} AS h FROM k), lr AS (SELECT card_id AS page_id, 1 AS row_no, 'http://list.example.org/a/doc_' || card_id || '.html' AS card_url, CASE WHEN len(string_split(h, '"')) > 2 AND string_split(h, '"')[2] <> '' THEN string_split(h, '"')[2] ELSE trim(h, '"') END AS h, NULL AS t, {_SQ('status')} AS status_raw FROM j WHERE no % 2 = 0
UNION ALL SELECT card_id, 2, 'http://list.example.org/a/shared_' || no || '.html', 'Shared. Title', NULL, 'ok' FROM k WHERE no % 2 = 0 UNION ALL SELECT card_id, 1, 'http://list.example.org/a/Index2/' || card_id || '.htm', {_SQ('code')}, {_SQ('title')}, {_SQ('status')} FROM k WHERE no % 2 = 1 UNION ALL SELECT card_id, 2, 'http://list.example.org/a/Index2/shared_' || no || '.htm', 'Shared', 'Title', 'ok' FROM k WHERE no % 2 = 1),
ls AS (SELECT page_id, CAST(row_no AS INT) AS row_no, card_url, CASE WHEN t IS NOT NULL THEN h WHEN instr(h, '. ') > 0 THEN trim(substr(h, 1, instr(h, '. ') - 1), ' ') ELSE h END AS document_code, CASE WHEN t IS NOT NULL THEN t WHEN instr(h, '. ') > 0 THEN trim(substr(h, instr(h, '. ') + 2), ' ') ELSE h END AS title, status_raw FROM lr)"""


@query(f"WITH {_LIST_ROWS} SELECT * FROM ls")
def list_rows(s: SparkSession, d: str) -> DataFrame:
    return html.list_rows(list_pages(s, d))


@query(f"WITH {_LIST_ROWS} SELECT 'process_document_card' AS job_type, card_url, arg_min(status_raw, page_id) AS list_status_raw, min(page_id) AS page_id FROM ls GROUP BY card_url")
def card_job_fanout(s: SparkSession, d: str) -> DataFrame:
    return html.card_jobs(html.list_rows(list_pages(s, d)))


def card_pages(s: SparkSession, d: str) -> DataFrame:
    """A card page for each card: a text whose title names code, title and dates, or a table of fields."""
    code, title, status = (_escaped(x) for x in ("code", "title", "status"))
    ad, pd = F.date_format("ad", "dd.MM.yyyy"), F.date_format("pd", "dd.MM.yyyy")
    text = F.concat(F.lit('<html><head><title>"'), F.replace(code, F.lit("&quot;"), F.lit("")), F.lit(". "), F.replace(title, F.lit("&quot;"), F.lit("")), F.lit('" '), F.coalesce(F.concat(F.lit("(ред. от "), ad, F.lit(") ")), F.lit("")), F.lit('введен 01.02.2003</title></head><body><span class="s4">1 Область применения</span><span class="s2">Scope of  '), "card_id", F.lit('</span><a href="#" title="СП 1">x</a><a href="#" title="">СП 2</a><a href="#" title="СП 1">y</a> Первоначальный текст документа опубликован в издании 1999 г.</body></html>'))
    cell = lambda label, value: F.concat(F.lit(f"<tr><td><b>{label}:</b></td><td>"), value, F.lit("</td></tr>"))
    tab = F.concat(F.lit('<body><h2>Скачать</h2><h2><a href="../pdf/'), "card_id", F.lit('.pdf" title="PDF">p</a><a href="../print.htm" title="Версия для печати">v</a></h2><table class="doctab2">'), cell("Обозначение", F.concat(F.lit('<a class="a1" href="#">'), code, F.lit("</a>"))), cell("Статус", status), cell("Название рус.", title), cell("Дата актуализации", F.coalesce(ad, F.lit("-"))), cell("Дата введения", F.lit("5 марта 2019 г.")), cell("Издан", F.concat(F.lit("Газета № 1 от "), F.coalesce(pd, F.lit("?")))), cell("Нормативные ссылки", F.lit('<ul><li><a href="#">A</a> <a href="#">ГОСТ 1</a><li><a href="#">ГОСТ 2</a></ul>')), F.lit('</table><img class="img2" src="1.gif"/><img class="img2" src="1.gif"></body>'))
    even = F.col("no") % 2 == 0
    url = F.when(even, F.lit("http://list.example.org/mega_doc/c.html")).otherwise("http://list.example.org/a/Index2/c.htm")
    return _fields(s, d).select(F.col("card_id").alias("page_id"), url.alias("url"), F.when(even, text).otherwise(tab).alias("html"))


_Q = lambda x: _SQ(f"replace({x}, chr(34), '')")


@query(f"""WITH {_LAYOUT}, h AS (SELECT *, {_SQ("replace(code, chr(34), '') || '. ' || replace(title, chr(34), '')")} AS t FROM k WHERE no % 2 = 0)
SELECT card_id AS page_id, 'text_card' AS source_type, CASE WHEN instr(t, '. ') > 0 THEN trim(substr(t, 1, instr(t, '. ') - 1), ' ') ELSE t END AS document_code, CASE WHEN instr(t, '. ') > 0 THEN trim(substr(t, instr(t, '. ') + 2), ' ') ELSE t END AS document_title, NULL AS card_status_raw, ad AS text_actualized_at, DATE '2003-02-01' AS effective_from, DATE '1999-01-01' AS published_at, 'Scope of ' || card_id AS scope_text, 'СП 1|СП 2' AS refs, NULL AS pdf_url, 'http://list.example.org/mega_doc/c.html' AS html_url, NULL AS print_url, 0 AS n_images, true AS has_full_html, 'ред. от ' || ad AS edition_label FROM h
UNION ALL SELECT card_id, 'table_card', {_SQ('code')}, {_SQ('title')}, {_SQ('status')}, ad, DATE '2019-03-05', pd, NULL, 'ГОСТ 1|ГОСТ 2', 'http://list.example.org/a/pdf/' || card_id || '.pdf', NULL, 'http://list.example.org/a/print.htm', 1, false, 'актуализация от ' || ad FROM k WHERE no % 2 = 1""")
def card_data(s: SparkSession, d: str) -> DataFrame:
    c = html.card_data(card_pages(s, d))
    return c.withColumns({"refs": F.array_join("normative_references", "|"), "n_images": F.size("image_urls")}).drop("normative_references", "image_urls")


@query("""SELECT text_id, CASE WHEN h >= 200 THEN 'html' WHEN p > 0 AND sc >= 0.5 THEN 'pdf' WHEN h > 0 THEN 'html' WHEN p > 0 THEN 'pdf' ELSE 'none' END AS source, CAST(CASE WHEN h >= 200 THEN 1.0 WHEN p > 0 AND sc >= 0.5 THEN sc WHEN h > 0 THEN 0.8 WHEN p > 0 THEN sc ELSE 0.0 END AS DOUBLE) AS confidence, h = 0 AND p = 0 AS needs_ocr
FROM (SELECT text_id, length(trim(coalesce(combined_text, ''), ' ')) AS p, coalesce(text_layer_score, 0.0) AS sc, CASE CAST(right(text_id, 1) AS INT) % 3 WHEN 0 THEN 250 WHEN 1 THEN 20 ELSE 0 END AS h FROM pdf_texts)""")
def choose_text_source(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "pdf_texts")
    k = F.right("text_id", F.lit(1)).cast("int") % 3
    page = F.when(k == 0, F.repeat(F.lit("x"), 250)).when(k == 1, F.repeat(F.lit("x"), 20))
    picked = html.text_source(page, F.col("combined_text"), F.col("text_layer_score"))
    return t.select("text_id", picked.alias("p")).select("text_id", "p.source", "p.confidence", "p.needs_ocr")


@query("""WITH c AS (SELECT DISTINCT card_id, CAST(right(card_id, 1) AS INT) % 4 AS k FROM document_cards WHERE card_id IS NOT NULL) SELECT card_id, 'html' AS artifact, CASE k WHEN 0 THEN 'h' ELSE 'p' END AS url FROM c WHERE k IN (0, 1) UNION ALL SELECT card_id, 'pdf', 'f' FROM c WHERE k IN (0, 2) UNION ALL SELECT card_id, 'page_image', unnest(['i1', 'i2']) FROM c WHERE k = 3""")
def artifact_downloads(s: SparkSession, d: str) -> DataFrame:
    k = F.right("card_id", F.lit(1)).cast("int") % 4
    c = table(s, d, "document_cards").where("card_id is not null").select("card_id").distinct()
    return html.downloads(c.select("card_id", F.when(k == 0, "h").otherwise("").alias("html_url"), F.when(k == 1, "p").alias("print_url"), F.when(k.isin(0, 2), "f").alias("pdf_url"), F.array(F.lit("i1"), F.lit("i2"), F.lit("i1")).alias("image_urls")))


# -- jobs: the event log as a queue ----------------------------------------------------------------------------------------

_KIND = "CASE event_type WHEN 'signup' THEN 'create' WHEN 'view' THEN 'claim' WHEN 'purchase' THEN 'complete' WHEN 'click' THEN 'temporary_error' ELSE 'permanent_error' END"
_PAY = """'{"seed_url": "s' || user_id || '", "version_id": ' || CASE WHEN event_id % 5 = 0 THEN 'null' ELSE '"v' || (event_id % 50) || '"' END || '}'"""
_TYPE = "CASE event_id % 3 WHEN 0 THEN 'crawl_seed' WHEN 1 THEN 'extract_text' ELSE 'other' END"


def job_events(s: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "signup", "create").when(F.col("event_type") == "view", "claim").when(F.col("event_type") == "purchase", "complete").when(F.col("event_type") == "click", "temporary_error").otherwise("permanent_error")
    payload = F.concat(F.lit('{"seed_url": "s'), F.col("user_id").cast("string"), F.lit('", "version_id": '), F.when(F.col("event_id") % 5 == 0, "null").otherwise(F.concat(F.lit('"v'), (F.col("event_id") % 50).cast("string"), F.lit('"'))), F.lit("}"))
    type_ = F.when(F.col("event_id") % 3 == 0, "crawl_seed").when(F.col("event_id") % 3 == 1, "extract_text").otherwise("other")
    return table(s, d, "events").select(F.col("user_id").alias("job_id"), "event_id", F.col("ts"), kind.alias("kind"), type_.alias("job_type"), payload.alias("payload"))


@query(f"SELECT event_id, CASE {_TYPE} WHEN 'crawl_seed' THEN '' WHEN 'extract_text' THEN CASE WHEN event_id % 5 = 0 THEN 'version_id' ELSE '' END ELSE 'job_type' END AS missing FROM events")
def payload_check(s: SparkSession, d: str) -> DataFrame:
    e = job_events(s, d)
    return e.select("event_id", F.array_join(jobs.missing_fields(F.col("job_type"), F.col("payload")), ",").alias("missing"))


@query(f"""WITH k AS (SELECT event_id, ts, CASE {_TYPE} WHEN 'crawl_seed' THEN 'crawl_seed|s' || user_id WHEN 'extract_text' THEN 'extract_text|' || CASE WHEN event_id % 5 = 0 THEN '' ELSE 'v' || (event_id % 50) END ELSE 'other' END AS job_key FROM events)
SELECT job_key, event_id AS request_id FROM (SELECT *, row_number() OVER (PARTITION BY job_key ORDER BY ts, event_id) AS r FROM k) WHERE r = 1""")
def job_dedup(s: SparkSession, d: str) -> DataFrame:
    e = job_events(s, d)
    asked = e.select(F.col("event_id").alias("request_id"), jobs.dedup_key(F.col("job_type"), F.col("payload")).alias("job_key"), F.col("ts").alias("created_at"))
    return jobs.created(asked).select("job_key", "request_id")


_STATE = f"""f AS (SELECT user_id AS job_id, count(*) FILTER (WHERE k IN ('temporary_error','permanent_error')) AS attempts, count(*) AS n_events, min(ts) AS created_at FROM (SELECT *, {_KIND} AS k FROM events WHERE user_id IS NOT NULL) GROUP BY 1),
l AS (SELECT job_id, k, ts FROM (SELECT user_id AS job_id, {_KIND} AS k, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC NULLS LAST, event_id DESC) AS r FROM events WHERE user_id IS NOT NULL) WHERE r = 1),
st AS (SELECT job_id, attempts, n_events, CASE k WHEN 'create' THEN 'pending' WHEN 'claim' THEN 'running' WHEN 'complete' THEN 'completed' ELSE CASE WHEN k = 'temporary_error' AND attempts < 3 THEN 'pending' ELSE 'failed' END END AS status,
CASE WHEN k = 'temporary_error' AND attempts < 3 THEN date_trunc('second', ts) + INTERVAL 60 SECOND ELSE created_at END AS scheduled_at FROM f JOIN l USING (job_id))"""


@query(f"WITH {_STATE} SELECT job_id, attempts, n_events, status, scheduled_at FROM st")
def job_state(s: SparkSession, d: str) -> DataFrame:
    return jobs.states(job_events(s, d)).select("job_id", "attempts", "n_events", "status", "scheduled_at")


@query(f"WITH {_STATE} SELECT job_id, CAST(row_number() OVER (PARTITION BY status ORDER BY scheduled_at, job_id) AS INT) AS place, status FROM st")
def job_ready(s: SparkSession, d: str) -> DataFrame:
    st = jobs.states(job_events(s, d)).withColumns({"job_type": F.col("status"), "created_at": F.col("scheduled_at")})
    return jobs.claim_order(st).select("job_id", "place", "status")


@query(f"WITH {_STATE}, n AS (SELECT max(ts) - INTERVAL 1 DAY AS now FROM events) SELECT job_id, status FROM st, n WHERE status = 'pending' AND scheduled_at <= now")
def job_due(s: SparkSession, d: str) -> DataFrame:
    """All pending jobs that are due a day before the last event."""
    e = job_events(s, d)
    now = e.agg(F.timestamp_add("DAY", F.lit(-1), F.max("ts"))).first()[0]
    return jobs.ready(jobs.states(e), F.lit(now)).select("job_id", "status")


@query("SELECT event_id, lower(event_type) IN ('timeout', 'connection', 'rate_limit', 'unavailable') OR event_id % 4 = 0 AS temporary FROM events")
def temporary_errors(s: SparkSession, d: str) -> DataFrame:
    error = F.when(F.col("event_id") % 4 == 0, "Timeout").otherwise(F.col("event_type"))
    return table(s, d, "events").select("event_id", jobs.is_temporary(error).alias("temporary"))


# -- conversations: the event log as talk ----------------------------------------------------------------------------------

_MSG = "m AS (SELECT user_id AS conv_id, event_id AS turn, CASE event_id % 2 WHEN 0 THEN 'user' ELSE 'assistant' END AS role, event_type || ' ' || props || CASE event_id % 4 WHEN 0 THEN ' подробнее' WHEN 1 THEN ' а если иначе' ELSE '' END AS text, event_type AS hint FROM events WHERE user_id IS NOT NULL)"


def messages(s: SparkSession, d: str) -> DataFrame:
    more = F.when(F.col("event_id") % 4 == 0, " подробнее").when(F.col("event_id") % 4 == 1, " а если иначе").otherwise("")
    return table(s, d, "events").where("user_id is not null").select(F.col("user_id").alias("conv_id"), F.col("event_id").alias("turn"), F.when(F.col("event_id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat("event_type", F.lit(" "), "props", more).alias("text"), F.col("event_type").alias("hint"))


@query(f"WITH {_MSG} SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM m) WHERE r <= 8")
def chat_tail(s: SparkSession, d: str) -> DataFrame:
    return conversation.last_messages(messages(s, d)).select("conv_id", "turn", "role")


_HINTS = "h AS (SELECT conv_id, turn, hint FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM (SELECT conv_id, min(turn) AS turn, hint FROM m WHERE hint IS NOT NULL GROUP BY conv_id, hint)) WHERE r <= 3)"


@query(f"WITH {_MSG}, {_HINTS} SELECT conv_id, turn, hint FROM h")
def chat_hints(s: SparkSession, d: str) -> DataFrame:
    return conversation.last_hints(messages(s, d).select("conv_id", "turn", "hint"), 3)


@query(f"""WITH {_MSG}, {_HINTS}, t AS (SELECT conv_id, string_agg(role || ': ' || CASE WHEN length(x) <= 180 THEN x ELSE rtrim(substr(x, 1, 177), ' ') || '...' END, chr(10) ORDER BY turn) AS talk FROM (SELECT *, {_SQ("coalesce(text, '')")} AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM m) WHERE r <= 4 GROUP BY 1),
hh AS (SELECT conv_id, string_agg(hint, ', ' ORDER BY turn) AS hints FROM h GROUP BY 1) SELECT conv_id, left(concat_ws(chr(10), 'Documents: ' || hints, 'Messages:' || chr(10) || talk), 1200) AS summary FROM t LEFT JOIN hh USING (conv_id)""")
def chat_summary(s: SparkSession, d: str) -> DataFrame:
    m = messages(s, d)
    return conversation.summaries(m, conversation.last_hints(m.select("conv_id", "turn", "hint"), 3))


@query(f"""WITH {_MSG} SELECT conv_id, turn, CASE WHEN x = '' OR turn % 5 = 0 THEN 'new_question' WHEN contains(x, 'подробнее') OR contains(x, 'разверн') OR contains(x, 'раскрой') OR contains(x, 'expand') OR contains(x, 'more detail') THEN 'expand_answer' WHEN contains(x, 'а если') OR contains(x, 'а для') OR contains(x, 'тогда') OR contains(x, 'также') OR contains(x, 'what about') OR contains(x, 'and if') THEN 'follow_up'
WHEN contains(x, 'уточн') OR contains(x, 'имел в виду') OR contains(x, 'clarif') THEN 'clarify_answer' WHEN len(string_split(x, ' ')) <= 8 THEN 'follow_up' ELSE 'new_question' END AS kind FROM (SELECT *, lower({_SQ("coalesce(text, '')")}) AS x FROM m)""")
def turn_kind(s: SparkSession, d: str) -> DataFrame:
    return messages(s, d).select("conv_id", "turn", conversation.turn_kind(F.col("text"), F.col("turn") % 5 != 0, F.lit(False)).alias("kind"))


_EK = "CASE turn % 4 WHEN 0 THEN 'new_question' WHEN 1 THEN 'follow_up' WHEN 2 THEN 'clarify' ELSE 'expand_answer' END"
_CUT = lambda x, n: f"CASE WHEN length({x}) <= {n} THEN {x} ELSE rtrim(substr({x}, 1, {n - 3}), ' ') || '...' END"
_TEXT = {k: v.replace("'", "''") for k, v in {**conversation.PARTS, **{f"g_{k}": v for k, v in conversation.GUIDANCE.items()}, **{f"q_{k}": v for k, v in conversation.QUESTION.items()}, "end": conversation.OVERRIDE_END}.items()}


@query(f"""WITH {_MSG}, e AS (SELECT *, {_EK} AS k, {_SQ('text')} AS sx FROM m) SELECT conv_id, turn, CASE WHEN k = 'new_question' THEN text ELSE left(trim(concat_ws(chr(10), CASE WHEN turn % 3 <> 0 THEN '{_TEXT['summary']}' || role END,
CASE WHEN turn % 5 = 0 THEN '{_TEXT['override']}' || 'sp ' || (turn % 9) || '{_TEXT['end']}' WHEN hint <> '' THEN '{_TEXT['documents']}' || hint || ', d2.' END, CASE WHEN turn % 2 = 0 THEN '{_TEXT['locators']}' || (turn % 7) || '.' END, CASE WHEN turn % 6 = 1 THEN '{_TEXT['threads']}' || 'a; b.' END,
'{_TEXT['messages']}' || 'user: ' || {_CUT('sx', 180)} || ' | assistant: ok', '{_TEXT['previous']}' || {_CUT('sx', 240)}, CASE k WHEN 'follow_up' THEN '{_TEXT['g_follow_up']}' WHEN 'clarify' THEN '{_TEXT['g_clarify']}' ELSE '{_TEXT['g_expand_answer']}' END,
CASE k WHEN 'follow_up' THEN '{_TEXT['q_follow_up']}' WHEN 'clarify' THEN '{_TEXT['q_clarify']}' ELSE '{_TEXT['q_expand_answer']}' END || ': ' || text), ' '), 2400) END AS query FROM e""")
def effective_query(s: SparkSession, d: str) -> DataFrame:
    t, no = F.col("turn"), F.array().cast("array<string>")
    kind = F.element_at(F.array(*[F.lit(k) for k in ("new_question", "follow_up", "clarify", "expand_answer")]), (t % 4 + 1).cast("int"))
    some = lambda c, *xs: F.when(c, F.array(*xs)).otherwise(no)
    pair = F.array(F.struct(F.lit("user").alias("role"), F.col("text").alias("content")), F.struct(F.lit("assistant").alias("role"), F.lit("ok").alias("content")))
    made = conversation.effective_query(F.col("text"), kind, F.when(t % 3 != 0, F.col("role")), some(t % 5 == 0, F.concat(F.lit("sp "), (t % 9).cast("string"))), some(F.col("hint") != "", F.col("hint"), F.lit("d2")), some(t % 2 == 0, (t % 7).cast("string")), some(t % 6 == 1, F.lit("a"), F.lit("b")), pair, F.col("text"))
    return messages(s, d).select("conv_id", "turn", made.alias("query"))


_AS = "['d' || (turn % 3), 'd' || (turn % 4)] AS active, CASE WHEN turn % 5 = 0 THEN [] ELSE ['d' || (turn % 7)] END AS asked"


@query(f"WITH {_MSG}, e AS (SELECT *, {_AS} FROM m) SELECT conv_id, turn, len(asked) > 0 AND len(string_split({_SQ('text')}, ' ')) > 8 AND NOT list_has_any(active, asked) AS shifted FROM e")
def context_shift(s: SparkSession, d: str) -> DataFrame:
    t = F.col("turn")
    name = lambda n: F.concat(F.lit("d"), (t % n).cast("string"))
    asked = F.when(t % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(name(7)))
    return messages(s, d).select("conv_id", "turn", conversation.is_shift(F.array(name(3), name(4)), asked, F.col("text")).alias("shifted"))


@query(f"""WITH {_MSG}, e AS (SELECT *, CASE turn % 3 WHEN 0 THEN 'partial' WHEN 1 THEN 'direct' ELSE 'no_answer' END AS mode, ['t1', 't2', 't3', 't4', 't5', hint || ' open', 'x'] AS threads FROM m), o AS (SELECT conv_id, turn, CASE mode WHEN 'partial' THEN list_append(threads, text || ' :: ' || left(role, 200))
WHEN 'direct' THEN list_filter(threads, lambda t: NOT list_has_any(string_split(lower(t), ' '), list_filter(string_split(lower({_SQ('text')}), ' '), lambda w: length(w) > 0))) ELSE threads END AS l FROM e) SELECT conv_id, turn, array_to_string(l[greatest(1, len(l) - 5):], '|') AS threads FROM o""")
def open_threads(s: SparkSession, d: str) -> DataFrame:
    t = F.col("turn")
    mode = F.when(t % 3 == 0, "partial").when(t % 3 == 1, "direct").otherwise("no_answer")
    threads = F.array(*[F.lit(x) for x in ("t1", "t2", "t3", "t4", "t5")], F.concat("hint", F.lit(" open")), F.lit("x"))
    return messages(s, d).select("conv_id", "turn", F.array_join(conversation.threads_after(threads, mode, F.col("text"), F.col("role")), "|").alias("threads"))


# -- claims: two per event, citing ids -------------------------------------------------------------------------------------

_CL = """cl AS (SELECT event_id, 1 AS claim_no, 'claim a' AS text, ['ev-' || (event_id % 4), 'ev-' || (event_id % 3), 'ev-' || (event_id % 4)] AS ids FROM events UNION ALL SELECT event_id, 2, CASE WHEN event_id % 6 = 0 THEN ' ' ELSE 'claim b' END, ['ev-9'] FROM events),
ed AS (SELECT event_id, 'ev-' || i AS evidence_id FROM events, range(0, 3) r(i) WHERE i <= event_id % 5),
kc AS (SELECT event_id, claim_no, text, list_filter(CASE WHEN ids[1] = ids[2] THEN [ids[1]] ELSE ids[1:2] END, lambda x: list_contains(es, x)) AS kept FROM cl LEFT JOIN (SELECT event_id, list(evidence_id) AS es FROM ed GROUP BY 1) USING (event_id) WHERE length(trim(text, ' ')) > 0)"""


def claims_of(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = table(s, d, "events").select("event_id")
    ev = lambda n: F.concat(F.lit('"ev-'), (F.col("event_id") % n).cast("string"), F.lit('"'))
    raw = F.concat(F.lit('noise [{"text": "claim a", "evidence_ids": ['), ev(4), F.lit(", "), ev(3), F.lit(", "), ev(4), F.lit(']}, {"text": "'), F.when(F.col("event_id") % 6 == 0, " ").otherwise("claim b"), F.lit('", "evidence_ids": ["ev-9"]}] tail'))
    c = e.select("event_id", F.posexplode(answers.parsed_claims(raw)).alias("p", "c")).select("event_id", (F.col("p") + 1).alias("claim_no"), "c.text", "c.evidence_ids")
    evidence = e.select("event_id", F.explode(F.sequence(F.lit(0), F.least(F.lit(2), F.col("event_id") % 5))).alias("i")).select("event_id", F.concat(F.lit("ev-"), F.col("i").cast("string")).alias("evidence_id"))
    return c, evidence


@query(f"WITH {_CL} SELECT event_id, claim_no, coalesce(array_to_string(kept, ','), '') AS kept_ids, coalesce(len(kept), 0) > 0 AS supported FROM kc")
def claim_filter(s: SparkSession, d: str) -> DataFrame:
    c, e = claims_of(s, d)
    return answers.filtered_claims(c, e, "event_id").select("event_id", "claim_no", F.array_join("kept_ids", ",").alias("kept_ids"), "supported")


@query("SELECT event_id, 1 AS claim_no, 'answer' AS text, array_to_string(list_transform(range(0, 1 + least(2, event_id % 5)), lambda i: 'ev-' || i), ',') AS ids FROM events WHERE event_id % 3 <> 0")
def default_claims(s: SparkSession, d: str) -> DataFrame:
    _, e = claims_of(s, d)
    drafts = table(s, d, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, " ").otherwise(" answer ").alias("text"))
    return answers.default_claims(drafts, e, "event_id").select("event_id", "claim_no", "text", F.array_join("evidence_ids", ",").alias("ids"))


@query("""WITH e AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'direct' WHEN 1 THEN 'partial' WHEN 2 THEN 'clarify' ELSE 'no_answer' END AS mode, event_id % 3 AS n FROM events)
SELECT event_id, CASE WHEN n = 1 AND mode = 'direct' THEN 'partial' ELSE mode END AS grounded, CASE mode WHEN 'partial' THEN n > 0 WHEN 'direct' THEN n >= 2 ELSE true END AS terminal, CASE WHEN n > 0 THEN 'partial' ELSE 'no_answer' END AS last_mode FROM e""")
def grounding(s: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    mode = F.when(i % 4 == 0, "direct").when(i % 4 == 1, "partial").when(i % 4 == 2, "clarify").otherwise("no_answer")
    return table(s, d, "events").select("event_id", answers.grounded_mode(mode, i % 3).alias("grounded"), answers.is_terminal(mode, i % 3).alias("terminal"), answers.final_mode(i % 3).alias("last_mode"))


@query("SELECT event_id, 'a' || CASE WHEN event_id % 2 = 0 THEN '|' || event_type ELSE '' END AS limitations FROM events")
def limitations(s: SparkSession, d: str) -> DataFrame:
    lists = F.array(F.array(F.lit(" a "), F.lit("")), F.array(F.when(F.col("event_id") % 2 == 0, F.col("event_type")).otherwise(" "), F.lit("a")))
    return table(s, d, "events").select("event_id", F.array_join(answers.merged_limitations(lists), "|").alias("limitations"))


@query(f"""WITH {_CL}, sp AS (SELECT event_id, count(*) AS n_claims, string_agg(text, ' ' ORDER BY claim_no) AS texts FROM kc WHERE len(kept) > 0 GROUP BY 1), ci AS (SELECT event_id, count(DISTINCT x) AS n_evidence FROM (SELECT event_id, unnest(kept) AS x FROM kc) GROUP BY 1), al AS (SELECT event_id, count(*) AS a FROM ed GROUP BY 1)
SELECT event_id, CASE WHEN n_claims IS NULL THEN CASE WHEN a > 0 THEN 'partial' ELSE 'no_answer' END WHEN coalesce(n_evidence, 0) < 2 THEN 'partial' ELSE 'direct' END AS mode, CASE WHEN event_id % 2 = 0 THEN 'draft' ELSE coalesce(texts, '') END AS text, coalesce(n_claims, 0) AS n_claims, CASE WHEN n_claims IS NULL THEN coalesce(a, 0) ELSE coalesce(n_evidence, 0) END AS n_evidence
FROM events LEFT JOIN sp USING (event_id) LEFT JOIN ci USING (event_id) LEFT JOIN al USING (event_id)""")
def verified_answers(s: SparkSession, d: str) -> DataFrame:
    c, e = claims_of(s, d)
    drafts = table(s, d, "events").select("event_id", F.lit("direct").alias("mode"), F.when(F.col("event_id") % 2 == 0, "draft").alias("text"))
    return answers.verified_answers(drafts, answers.filtered_claims(c, e, "event_id"), e, "event_id").select("event_id", "mode", "text", "n_claims", "n_evidence")
