"""Queries on strings, codes, dates and scores, with their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docustrata.functions import codes, dates, scores, text
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


def once(df: DataFrame, key: str, *columns: str) -> DataFrame:
    return df.where(F.col(key).isNotNull()).select(key, *columns).distinct()


@query(f"SELECT doc_id, length({sql.squeeze('text')}) AS norm_len, sha256({sql.squeeze('text')}) AS norm_hash FROM documents")
def ws_normalize(s: SparkSession, d: str) -> DataFrame:
    n = text.squeeze(F.col("text"))
    return table(s, d, "documents").select("doc_id", F.length(n).alias("norm_len"), F.sha2(n, 256).alias("norm_hash"))


@query(f"WITH h AS (SELECT doc_id, '<div><p class=\"t\">' || replace(text, chr(10), '</p><p>') || '</p></div>' AS html FROM documents) SELECT doc_id, sha256({sql.squeeze("regexp_replace(html, '<[^>]+>', ' ', 'g')")}) AS text_hash FROM h")
def html_tag_strip(s: SparkSession, d: str) -> DataFrame:
    html = F.concat(F.lit('<div><p class="t">'), F.replace("text", F.lit("\n"), F.lit("</p><p>")), F.lit("</p></div>"))
    return table(s, d, "documents").select("doc_id", F.sha2(text.strip_html(html), 256).alias("text_hash"))


@query(f"""SELECT doc_id, CASE WHEN length(text) <= 160 THEN text ELSE substr(text, 1, 157) || '...' END AS log_text,
CASE WHEN length(s) <= 200 THEN s ELSE rtrim(substr(s, 1, 197), ' ') || '...' END AS short_text FROM (SELECT doc_id, text, {sql.squeeze('text')} AS s FROM documents)""")
def truncate_text(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", text.truncate_for_log(F.col("text")).alias("log_text"), text.truncate_tail(F.col("text"), 200).alias("short_text"))


_TYPE = """CASE WHEN p IN ('СП','SP') THEN 'sp' WHEN p IN ('СНИП','SNIP') THEN 'snip' WHEN p IN ('ГОСТ','GOST') THEN 'gost' WHEN p IN ('ФЗ','ФЕДЕРАЛЬНЫЙ') THEN 'federal_law' ELSE 'unknown' END"""


@query(f"""SELECT id, display, normalized, {_TYPE} AS document_type FROM (SELECT id, {sql.clean_code('referenced_code_normalized')} AS display, {sql.code('referenced_code_normalized')} AS normalized,
split_part({sql.code('referenced_code_normalized')}, ' ', 1) AS p FROM {sql.once('document_references', 'id', 'referenced_code_normalized')})""")
def clean_code(s: SparkSession, d: str) -> DataFrame:
    c = F.col("referenced_code_normalized")
    rows = once(table(s, d, "document_references"), "id", "referenced_code_normalized")
    return rows.select("id", text.clean_code(c).alias("display"), text.normalize_code(c).alias("normalized"), codes.document_type(c).alias("document_type"))


_LOC = f"trim(regexp_replace({sql.squeeze('locator_raw')}, '(?i)^(п\\.?|пункт|раздел|глава|таблица|приложение|section|chapter|table|appendix) +', ''), ' ')"


@query(f"""SELECT id, CASE WHEN b = '' THEN NULL WHEN regexp_full_match(regexp_replace(b, '[ _-]+', '', 'g'), '[0-9]+') THEN regexp_replace(b, '[ _-]+', '', 'g') ELSE lower(b) END AS locator,
node_type || ':' || coalesce(nullif({sql.squeeze("coalesce(label, '')")}, ''), CAST(order_index AS VARCHAR)) AS node_locator
FROM (SELECT *, {_LOC} AS b FROM {sql.once('document_nodes', 'id', 'locator_raw, node_type, label, order_index')})""")
def locator_normalize(s: SparkSession, d: str) -> DataFrame:
    rows = once(table(s, d, "document_nodes"), "id", "locator_raw", "node_type", "label", "order_index")
    return rows.select("id", text.locator(F.col("locator_raw")).alias("locator"), text.node_locator(F.col("node_type"), F.col("label"), F.col("order_index"), F.lit(None).cast("string")).alias("node_locator"))


@query(f"""SELECT doc_id, len(t) AS n_tokens, len(list_distinct(t)) AS n_distinct, t[1] AS first_token,
(SELECT sha256(coalesce(string_agg(x, ' ' ORDER BY p), '')) FROM (SELECT x, min(p) AS p FROM (SELECT unnest(t) AS x, generate_subscripts(t, 1) AS p) GROUP BY x)) AS tsv_hash
FROM (SELECT doc_id, {sql.tokens('text')} AS t FROM documents)""")
def tsv_tokens(s: SparkSession, d: str) -> DataFrame:
    t = text.tokens(F.col("text"))
    return table(s, d, "documents").select("doc_id", t.alias("t")).select("doc_id", F.size("t").alias("n_tokens"), F.size(F.array_distinct("t")).alias("n_distinct"), F.get("t", F.lit(0)).alias("first_token"), F.sha2(F.array_join(F.array_distinct("t"), " "), 256).alias("tsv_hash"))


@query(f"SELECT doc_id, sha256(array_to_string({sql.lines('text')}, chr(10))) AS content_hash FROM documents")
def content_hash(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", text.content_hash(F.col("text")).alias("content_hash"))


@query(f"""SELECT unit_id, sha256(concat_ws('|', version_id, unit_type, concat_ws(',', CAST(start_order_index AS VARCHAR), CAST(end_order_index AS VARCHAR)), {sql.squeeze('text')})) AS chunk_hash,
CAST(greatest(1, ceil(length(coalesce(text, '')) / 4.0)) AS BIGINT) AS tokens FROM {sql.once('retrieval_units', 'unit_id', 'version_id, unit_type, start_order_index, end_order_index, text')}""")
def chunk_hash(s: SparkSession, d: str) -> DataFrame:
    rows = once(table(s, d, "retrieval_units"), "unit_id", "version_id", "unit_type", "start_order_index", "end_order_index", "text")
    h = text.chunk_hash(*[F.col(c) for c in ("version_id", "unit_type", "start_order_index", "end_order_index", "text")])
    return rows.select("unit_id", h.alias("chunk_hash"), text.token_estimate(F.col("text")).alias("tokens"))


@query("""SELECT document_id, coalesce(nullif(regexp_replace(substr(s, 1, 24), '[._-]+$', ''), ''), 'doc') || '-' || substr(sha1(s), 1, 12) AS storage_key, coalesce(nullif(regexp_replace(substr(s, 1, 24), '[._-]+$', ''), ''), 'doc') || '-' || substr(sha1(s), 1, 12) || '/' || document_id || '/page_image.pdf' AS artifact_path,
nullif(lower(regexp_extract(regexp_replace(p, '[?#].*$', ''), '\\.([A-Za-z0-9]+)$', 1)), '') AS extension,
CASE nullif(lower(regexp_extract(regexp_replace(p, '[?#].*$', ''), '\\.([A-Za-z0-9]+)$', 1)), '') WHEN 'html' THEN 'text/html' WHEN 'pdf' THEN 'application/pdf' WHEN 'png' THEN 'image/png' ELSE 'application/octet-stream' END AS mime_type
FROM (SELECT *, CASE WHEN c = '' THEN 'unnamed' ELSE c END AS s FROM (SELECT DISTINCT document_id, display_code, regexp_replace(replace(regexp_replace(trim(regexp_replace(display_code, '\\s+', ' ', 'g'), ' '), '[<>:"/\\\\|?*]+', '_', 'g'), ' ', '_'), '^[._]+|[._]+$', '', 'g') AS c,
'/raw/' || document_id || CASE CAST(right(document_id, 1) AS INT) % 4 WHEN 0 THEN '.PDF?x=1' WHEN 1 THEN '.html' WHEN 2 THEN '' ELSE '.png#a' END AS p FROM document_registry))""".replace("\\\\", "\\"))
def storage_key(s: SparkSession, d: str) -> DataFrame:
    tail = F.element_at(F.array(F.lit(".PDF?x=1"), F.lit(".html"), F.lit(""), F.lit(".png#a")), F.right("document_id", F.lit(1)).cast("int") % 4 + 1)
    rows = table(s, d, "document_registry").select("document_id", "display_code", F.concat(F.lit("/raw/"), "document_id", tail).alias("p")).distinct()
    return rows.select("document_id", text.storage_key(F.col("display_code")).alias("storage_key"), text.artifact_path(F.col("display_code"), F.col("document_id"), F.lit("page image"), F.lit(".PDF")).alias("artifact_path"), text.extension(F.col("p")).alias("extension"), text.mime_type(F.col("p")).alias("mime_type"))


@query(f"""SELECT alias_id, nullif(lower(trim(regexp_replace({sql.squeeze('alias_raw')}, '[ ,;:()\\\\\\[\\]"''`]+', ' ', 'g'), ' ')), '') AS alias_form,
'list.example.org/doc/' || lower(alias_id) || '?v=1' AS url_form FROM {sql.once('document_aliases', 'alias_id', 'alias_raw')}""")
def alias_normalize(s: SparkSession, d: str) -> DataFrame:
    url = F.concat(F.lit("https://List.Example.org/doc/"), "alias_id", F.lit("/?v=1"))
    return once(table(s, d, "document_aliases"), "alias_id", "alias_raw").select("alias_id", codes.alias_form(F.col("alias_raw")).alias("alias_form"), codes.alias_form(url).alias("url_form"))


_REST = "CASE WHEN instr(n, ' ') > 0 THEN substr(n, instr(n, ' ') + 1) ELSE '' END"
_VARIANTS = f"""WITH c AS (SELECT DISTINCT document_id, {sql.code('display_code')} AS n FROM document_registry), p AS (SELECT document_id, n, split_part(n, ' ', 1) AS a, {_REST} AS r FROM c),
q AS (SELECT *, regexp_replace(r, '[-./][0-9]{{4}}$', '') AS y, split_part(r, '.', 1) AS f FROM p)
SELECT DISTINCT document_id, variant FROM (
SELECT document_id, n AS variant FROM q WHERE n <> '' UNION ALL SELECT document_id, a || r FROM q WHERE r <> ''
UNION ALL SELECT document_id, a || ' ' || y FROM q WHERE y <> '' AND y <> r UNION ALL SELECT document_id, a || y FROM q WHERE y <> '' AND y <> r
UNION ALL SELECT document_id, a || ' ' || f FROM q WHERE r <> '' AND f <> '' UNION ALL SELECT document_id, a || f FROM q WHERE r <> '' AND f <> '')"""


@query(_VARIANTS)
def code_variants(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "document_registry").select("document_id", "display_code").distinct()
    return rows.select("document_id", F.explode(codes.code_variants(F.col("display_code"))).alias("variant")).distinct()


@query(f"""SELECT DISTINCT document_id, {sql.family('display_code')} AS family, regexp_replace(lower({sql.squeeze('display_code')}), '[.\\-/][0-9]{{4}}$', '') AS scoring_family,
lower(split_part({sql.code('display_code')}, ' ', 1) || ' ' || split_part(split_part({sql.code('display_code')}, ' ', -1), '.', 1)) AS hint,
CAST(nullif(regexp_extract(display_code, '(?:19|20)[0-9]{{2}}'), '') AS INT) AS edition_year, coalesce(regexp_full_match(display_code, '(?:СП|SP) [0-9]+\\.0') AND title = display_code, false) AS is_placeholder,
coalesce(starts_with(upper(display_code), 'СНИП') OR starts_with(upper(display_code), 'SNIP'), false) OR coalesce(contains(lower(title), 'пособ'), false) AS is_legacy FROM document_registry""")
def document_family(s: SparkSession, d: str) -> DataFrame:
    c = F.col("display_code")
    cols = [codes.family(c).alias("family"), codes.scoring_family(c).alias("scoring_family"), codes.document_hint(c).alias("hint"), codes.year(c).alias("edition_year"), codes.is_placeholder(c, F.col("title")).alias("is_placeholder"), codes.is_legacy(c, F.col("title")).alias("is_legacy")]
    return table(s, d, "document_registry").select("document_id", *cols).distinct()


@query("""SELECT DISTINCT id, CASE WHEN c IS NULL AND l IS NULL AND h IS NULL THEN '-' ELSE concat_ws(' | ', c, 'п. ' || l, h) END AS citation
FROM (SELECT id, nullif(trim(version_id, ' '), '') AS c, nullif(trim(locator_raw, ' '), '') AS l, nullif(trim(heading_path, ' '), '') AS h FROM document_nodes WHERE id IS NOT NULL)""")
def citations(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "document_nodes").where("id is not null").select("id", text.citation(F.col("version_id"), F.col("locator_raw"), F.col("heading_path")).alias("citation")).distinct()


@query("""SELECT item_id, array_to_string(list_transform(range(0, CAST(ceil(length(passage) / 120.0) AS BIGINT)), lambda i: substr(passage, CAST(i * 120 + 1 AS BIGINT), 120)), '|') AS chunks,
CAST(ceil(length(passage) / 120.0) AS INT) AS n_chunks, format('{:.1f} KB', length(passage) * 10 / 1024.0) AS size_text FROM eval_passages""")
def markdown_chunks(s: SparkSession, d: str) -> DataFrame:
    c = text.chunks(F.col("passage"))
    return table(s, d, "eval_passages").select("item_id", F.array_join(c, "|").alias("chunks"), F.size(c).alias("n_chunks"), text.format_bytes(F.length("passage") * 10).alias("size_text"))


@query("""SELECT event_id, list_distinct(regexp_extract_all(t, 'ev-[0-9]{4}')) AS ids, CASE WHEN lower(trim(m, ' ')) IN ('direct','partial','clarify','no_answer') THEN lower(trim(m, ' ')) ELSE 'no_answer' END AS mode
FROM (SELECT event_id, 'see ev-' || lpad(CAST(event_id % 7 AS VARCHAR), 4, '0') || ' and ev-' || lpad(CAST(event_id % 7 AS VARCHAR), 4, '0') AS t, CASE event_id % 3 WHEN 0 THEN ' Direct' WHEN 1 THEN 'partial ' ELSE event_type END AS m FROM events)""")
def answer_texts(s: SparkSession, d: str) -> DataFrame:
    ref = F.concat(F.lit("ev-"), F.lpad((F.col("event_id") % 7).cast("string"), 4, "0"))
    t = F.concat(F.lit("see "), ref, F.lit(" and "), ref)
    m = F.when(F.col("event_id") % 3 == 0, " Direct").when(F.col("event_id") % 3 == 1, "partial ").otherwise(F.col("event_type"))
    return table(s, d, "events").select("event_id", text.evidence_ids(t).alias("ids"), text.answer_mode(m).alias("mode"))


@query("""SELECT card_id, published_at AS dotted, published_at AS after_marker, published_at AS written, make_date(CAST(year(published_at) AS INT), 1, 1) AS year_only, text_actualized_at IS NOT NULL AND (published_at IS NULL OR text_actualized_at > published_at) AS newer
FROM (SELECT DISTINCT card_id, published_at, text_actualized_at FROM document_cards WHERE card_id IS NOT NULL)""")
def card_dates(s: SparkSession, d: str) -> DataFrame:
    rows = once(table(s, d, "document_cards"), "card_id", "published_at", "text_actualized_at")
    dotted = F.date_format("published_at", "dd.MM.yyyy")
    names = F.element_at(F.array(*[F.lit(m) for m in dates.MONTHS]), F.coalesce(F.month("published_at"), F.lit(1)))
    written = F.when(F.col("published_at").isNotNull(), F.concat_ws(" ", F.day("published_at").cast("string"), names, F.year("published_at").cast("string"), F.lit("г.")))
    return rows.select("card_id", dates.dotted_date(dotted).alias("dotted"), dates.date_after(F.concat(F.lit("от 01.01.1900, Опубликован: "), dotted), "опубликован").alias("after_marker"), dates.written_date(written).alias("written"), dates.publication_date(F.year("published_at").cast("string")).alias("year_only"), dates.is_newer(F.col("text_actualized_at"), F.col("published_at")).alias("newer"))


_SOLID = "length(regexp_replace(text, '[ \\t\\r\\n]+', '', 'g'))"
_USEFUL = "length(regexp_replace(text, '[^0-9A-Za-zА-Яа-яЁё .,;:()\\-]+', '', 'g'))"


@query(f"""SELECT DISTINCT page_id, score, score < 0.7 AS is_low FROM (SELECT page_id, CASE WHEN coalesce({_SOLID}, 0) = 0 THEN 0.0 ELSE greatest(0.0, least(1.0,
round_even(CAST(0.65 AS DOUBLE) * {_USEFUL} / nullif({_SOLID}, 0) + CAST(0.35 AS DOUBLE) * least(CAST(1.0 AS DOUBLE), {_SOLID} / CAST(300.0 AS DOUBLE)), 4))) END AS score FROM ocr_pages WHERE page_id IS NOT NULL)""")
def ocr_confidence(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "ocr_pages").where("page_id is not null").select("page_id", scores.recognition_confidence(F.col("text")).alias("score")).distinct()
    return rows.select("page_id", "score", scores.is_low_confidence(F.col("score")).alias("is_low"))


@query("""SELECT text_id, CASE WHEN c = 0 OR p = 0 THEN 0.0 ELSE round_even((CASE WHEN c / p >= 400 THEN 1.0 WHEN c / p >= 100 THEN 0.5 + (c / p - 100) / CAST(600 AS DOUBLE) ELSE c / p / CAST(200 AS DOUBLE) END) * least(CAST(1.0 AS DOUBLE), l / c / CAST(0.6 AS DOUBLE)), 4) END AS layer_score
FROM (SELECT text_id, CAST(coalesce(length(combined_text), 0) AS DOUBLE) AS c, CAST(length(regexp_replace(combined_text, '[^A-Za-zА-Яа-яЁё]+', '', 'g')) AS DOUBLE) AS l, CAST(coalesce(len(string_split(combined_text, chr(10) || chr(10))), 0) AS DOUBLE) AS p FROM pdf_texts)""")
def pdf_layer_score(s: SparkSession, d: str) -> DataFrame:
    c, letters = F.length("combined_text"), F.length(F.regexp_replace("combined_text", "[^A-Za-zА-Яа-яЁё]+", ""))
    pages = F.size(F.split("combined_text", "\n\n"))
    return table(s, d, "pdf_texts").select("text_id", scores.layer_score(c, letters, F.when(F.col("combined_text").isNotNull(), pages)).alias("layer_score"))


@query(f"""WITH t AS (SELECT item_id, unnest({sql.tokens('question')}) AS token FROM eval_passages), n AS (SELECT item_id, token, count(*) AS n FROM t GROUP BY 1, 2),
h AS (SELECT item_id, n, sha256(token) AS x FROM n), w AS (SELECT item_id, CAST(CAST('0x' || substr(x, 1, 8) AS BIGINT) % 64 AS INT) AS dim,
(CASE WHEN CAST('0x' || substr(x, 9, 2) AS BIGINT) % 2 = 0 THEN 1 ELSE -1 END) * (1 + CAST('0x' || substr(x, 11, 2) AS BIGINT) / CAST(255 AS DOUBLE)) * n AS w FROM h),
s AS (SELECT item_id, dim, sum(w) AS w FROM w GROUP BY 1, 2), l AS (SELECT item_id, sqrt(sum(w * w)) AS l FROM s GROUP BY 1)
SELECT item_id, dim, round_even(w / l, 6) AS value FROM s JOIN l USING (item_id) WHERE l > 0""")
def hash_embedding(s: SparkSession, d: str) -> DataFrame:
    made = scores.hash_embedding(table(s, d, "eval_passages"), "item_id", "question", 64)
    return made.select("item_id", "dim", F.bround("value", 6).alias("value"))


_ACTIVE, _INACTIVE = "('имеет силу','имеет силу с изменениями','имеет силу частично')", "('не имеет силы','сила прекращена','снят с применения','замещён новым изданием')"


@query(f"""SELECT card_id, CASE WHEN r IN {_ACTIVE} THEN 'active' WHEN r IN {_INACTIVE} THEN 'inactive' ELSE 'unknown' END AS status, conflict FROM (SELECT card_id,
lower(coalesce(nullif(c, ''), l)) AS r, coalesce(c <> '' AND l <> '' AND lower(c) <> lower(l), false) AS conflict FROM (SELECT card_id, {sql.squeeze('card_status_raw')} AS c, {sql.squeeze('source_list_status_raw')} AS l
FROM {sql.once('document_cards', 'card_id', 'card_status_raw, source_list_status_raw')}))""")
def status_classify(s: SparkSession, d: str) -> DataFrame:
    from docustrata.operators.versions import resolve_status

    rows = once(table(s, d, "document_cards"), "card_id", "card_status_raw", "source_list_status_raw")
    return rows.select("card_id", *resolve_status(F.col("card_status_raw"), F.col("source_list_status_raw")))
