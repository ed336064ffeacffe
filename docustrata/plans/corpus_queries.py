"""Queries on documents, structure, search and evidence, with their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docustrata.functions import text
from docustrata.functions.codes import code_aliases, scoring_family
from docustrata.operators import blocks, evidence, lexical, metrics, relational, resolve, retrieval, structure, vector, versions
from docustrata.functions import scores
from docustrata.plans import sql
from docustrata.session import durable
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


# -- search ----------------------------------------------------------------------------------------------------------------

_POST = f"""q AS (SELECT DISTINCT item_id, unnest({sql.tokens('question')}) AS token FROM eval_passages), n AS (SELECT item_id, count(*) AS n FROM q GROUP BY 1),
p AS (SELECT DISTINCT doc_id, unnest({sql.tokens('text')}) AS token FROM documents), c AS (SELECT item_id, doc_id, count(*) AS c FROM p JOIN q USING (token) GROUP BY 1, 2)"""


@query(f"WITH {_POST} SELECT * FROM (SELECT item_id, doc_id, score, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rk FROM (SELECT item_id, doc_id, round_even(c / n, 4) AS score FROM c JOIN n USING (item_id))) WHERE rk <= 30")
def lexical_search_topk(s: SparkSession, d: str) -> DataFrame:
    return lexical.search(table(s, d, "eval_passages"), table(s, d, "documents"))


@query(f"WITH {_POST} SELECT * FROM (SELECT item_id, doc_id, CAST(c AS INT) AS overlap, CAST(row_number() OVER (PARTITION BY item_id ORDER BY c DESC, doc_id) AS INT) AS rk FROM c) WHERE rk <= 10")
def fts_topk(s: SparkSession, d: str) -> DataFrame:
    return lexical.search_counts(table(s, d, "eval_passages"), table(s, d, "documents"))


@query(f"SELECT token, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest({sql.tokens('text')}) AS token FROM documents) GROUP BY 1")
def vocab_df(s: SparkSession, d: str) -> DataFrame:
    return lexical.document_frequencies(table(s, d, "documents"), "doc_id", "text")


def units(s: SparkSession, d: str, *columns: str) -> DataFrame:
    """Units once each, with the columns that a query reads: others are never scanned or shuffled."""
    return relational.unique(table(s, d, "retrieval_units"), "unit_id", *columns)


def nodes(s: SparkSession, d: str, *columns: str) -> DataFrame:
    """Nodes once each, with the columns that a query reads."""
    return relational.unique(table(s, d, "document_nodes"), "id", *columns)


_UNITS = "u AS (SELECT DISTINCT unit_id, version_id, unit_type, anchor_order_index, start_order_index, end_order_index, heading_path, locator_primary, text FROM retrieval_units WHERE unit_id IS NOT NULL)"
_NODES = "nd AS (SELECT DISTINCT id, version_id, order_index, node_type, label, title, text, locator_normalized, heading_path, parse_confidence FROM document_nodes WHERE id IS NOT NULL)"


@query(f"""WITH {_UNITS}, {_NODES}, pool AS (SELECT 'retrieval_unit_lexical' AS source_kind, version_id, unit_id AS hit_id, text FROM u UNION ALL SELECT 'document_node', version_id, id, text FROM nd WHERE version_id NOT IN (SELECT version_id FROM u WHERE version_id IS NOT NULL) OR version_id IS NULL),
q AS (SELECT DISTINCT item_id, unnest({sql.tokens('question')}) AS token FROM eval_passages), n AS (SELECT item_id, count(*) AS n FROM q GROUP BY 1), p AS (SELECT DISTINCT hit_id, unnest({sql.tokens('text')}) AS token FROM pool),
c AS (SELECT item_id, hit_id, round_even(count(*) / any_value(n), 4) AS score FROM p JOIN q USING (token) JOIN n USING (item_id) GROUP BY 1, 2)
SELECT item_id, source_kind, version_id, hit_id, score, rk FROM (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, hit_id) AS INT) AS rk FROM c) JOIN pool USING (hit_id) WHERE rk <= 30""")
def version_search(s: SparkSession, d: str) -> DataFrame:
    return lexical.search_versions(table(s, d, "eval_passages"), units(s, d, "version_id", "start_order_index", "locator_primary", "heading_path", "text"), nodes(s, d, "version_id", "order_index", "locator_normalized", "heading_path", "text"))


_DOT = "list_sum(list_transform(list_zip(a.e, b.e), lambda z: z[1] * z[2]))"
_COS = f"""WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), n AS (SELECT vec_id, label, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(v.e, lambda y: y * y)))) AS e FROM v),
s AS (SELECT a.vec_id AS qid, b.vec_id AS vec_id, round_even({_DOT}, 4) AS score FROM n a JOIN n b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS INT) AS rk FROM s)"""


@query(f"{_COS} SELECT qid, vec_id, score, rk FROM r WHERE rk <= 30")
def cosine_topk(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "embeddings")
    return vector.search(e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), "embedding"), e, "qid", "vec_id", "embedding", 30)


@query(f"{_COS}, c AS (SELECT qid, label, count(*) AS votes FROM r JOIN v USING (vec_id) WHERE rk <= 10 GROUP BY 1, 2) SELECT qid, predicted, votes FROM (SELECT qid, label AS predicted, votes, row_number() OVER (PARTITION BY qid ORDER BY votes DESC, label) AS k FROM c) WHERE k = 1")
def knn_label_vote(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "embeddings")
    near = vector.search(e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), "embedding"), e, "qid", "vec_id", "embedding", 10)
    return vector.vote(near, e, "qid", "vec_id", "label")


def _hashed(name: str, key: str, col: str) -> str:
    return f"""{name} AS (WITH t AS (SELECT {key}, unnest({sql.tokens(col)}) AS token FROM eval_passages), h AS (SELECT {key}, sha256(token) AS x, count(*) AS n FROM t GROUP BY {key}, token),
s AS (SELECT {key}, CAST('0x' || substr(x, 1, 8) AS BIGINT) % 64 AS dim, sum((CASE WHEN CAST('0x' || substr(x, 9, 2) AS BIGINT) % 2 = 0 THEN 1 ELSE -1 END) * (1 + CAST('0x' || substr(x, 11, 2) AS BIGINT) / CAST(255 AS DOUBLE)) * n) AS w FROM h GROUP BY 1, 2),
l AS (SELECT {key}, sqrt(sum(w * w)) AS l FROM s GROUP BY 1) SELECT {key}, dim, w / l AS v FROM s JOIN l USING ({key}) WHERE l > 0)"""


@query(f"""WITH {_hashed('a', 'item_id', 'question')}, {_hashed('b', 'item_id', 'passage')}, c AS (SELECT a.item_id AS qid, b.item_id AS pid, round_even(greatest(0.0, sum(a.v * b.v)), 4) AS score FROM a JOIN b USING (dim) GROUP BY 1, 2)
SELECT qid, pid, score, rk FROM (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, pid) AS INT) AS rk FROM c) WHERE rk <= 5""")
def semantic_scored(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "eval_passages")
    a = scores.hash_embedding(e, "item_id", "question", 64).select(F.col("item_id").alias("qid"), "dim", F.col("value").alias("x"))
    b = scores.hash_embedding(e, "item_id", "passage", 64).select(F.col("item_id").alias("pid"), "dim", F.col("value").alias("y"))
    c = a.join(b, "dim").groupBy("qid", "pid").agg(scores.distance_score(1 - F.sum(F.col("x") * F.col("y"))).alias("score"))
    return relational.top(c, ["qid"], [F.desc("score"), F.asc("pid")], 5)


# -- structure -------------------------------------------------------------------------------------------------------------

_PAGE = r"(?i)^(?:\[\[ *PAGE[: ]+[0-9]+ *\]\]|\[ *PAGE +[0-9]+ *\]|--- *PAGE +[0-9]+ *---)$"
_LINES = f"""ls AS (SELECT doc_id, list_filter({sql.lines('text')}, lambda l: NOT regexp_matches(l, '{_PAGE}')) AS l FROM documents),
li AS (SELECT doc_id, unnest(l) AS line, CAST(generate_subscripts(l, 1) AS INT) AS order_index FROM ls)"""


@query(f"""WITH al AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, {sql.lines('text')} AS l FROM documents)), pg AS (SELECT *, CASE WHEN regexp_matches(line, '{_PAGE}') THEN CAST(regexp_extract(line, '[0-9]+') AS INT) END AS pn FROM al),
ap AS (SELECT *, last_value(pn IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS page_number FROM pg), kp AS (SELECT * FROM ap WHERE pn IS NULL)
SELECT doc_id, CAST(row_number() OVER w AS INT) AS order_index, sha256(line) AS line_hash, CAST(coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INT) AS char_start, page_number FROM kp WINDOW w AS (PARTITION BY doc_id ORDER BY i)""")
def prepare_lines(s: SparkSession, d: str) -> DataFrame:
    lines = structure.prepared_lines(table(s, d, "documents"), "doc_id", "text")
    return lines.select("doc_id", "order_index", F.sha2("line", 256).alias("line_hash"), "char_start", "page_number")


def _classes() -> str:
    kind, label, title = (["WHEN order_index = 1 THEN " + x] for x in ("'title'", "NULL", "line"))
    for name, pattern, lab, tit in structure.RULES:
        p = pattern.replace("'", "''")
        kind.append(f"WHEN regexp_matches(line, '{p}') THEN '{name}'")
        label.append(f"WHEN regexp_matches(line, '{p}') THEN " + (f"nullif(trim(regexp_extract(line, '{p}', {lab}), ' '), '')" if lab else "NULL"))
        title.append(f"WHEN regexp_matches(line, '{p}') THEN " + (f"coalesce(nullif(trim(regexp_extract(line, '{p}', {tit}), ' '), ''), line)" if tit else "line"))
    return f"cl AS (SELECT *, CASE {' '.join(kind)} ELSE 'paragraph' END AS node_type, CASE {' '.join(label)} END AS label, CASE {' '.join(title)} END AS title FROM li)"


@query(f"WITH {_LINES}, {_classes()} SELECT doc_id, order_index, node_type, label, sha256(coalesce(title, '')) AS title_hash FROM cl")
def classify_lines(s: SparkSession, d: str) -> DataFrame:
    c = structure.classified(structure.numbered_lines(table(s, d, "documents"), "doc_id", "text"))
    return c.select("doc_id", "order_index", "node_type", "label", F.sha2(F.coalesce("title", F.lit("")), 256).alias("title_hash"))


_W = "OVER (PARTITION BY doc_id ORDER BY order_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
_LAST = ", ".join(f"coalesce(last_value(CASE WHEN node_type = '{k}' THEN order_index END IGNORE NULLS) {_W}, 0) AS {n}" for k, n in (("section", "s"), ("subsection", "b"), ("point", "p"), ("subpoint", "u")))
_TREE = f"""op AS (SELECT *, {_LAST} FROM cl), tr AS (SELECT doc_id, order_index, line, node_type, label, title, CAST(CASE WHEN node_type = 'title' THEN NULL WHEN node_type IN ('section','appendix','table','note') THEN 1
WHEN node_type = 'subsection' THEN sc WHEN node_type = 'point' THEN CASE WHEN b > s THEN b ELSE sc END WHEN node_type = 'subpoint' THEN CASE WHEN p > greatest(s, b) THEN p WHEN b > s THEN b ELSE sc END
ELSE CASE WHEN u > greatest(s, b, p) THEN u WHEN p > greatest(s, b) THEN p WHEN b > s THEN b ELSE sc END END AS INT) AS parent_order_index FROM (SELECT *, CASE WHEN s > 0 THEN s ELSE 1 END AS sc FROM op))"""


def _classified(s: SparkSession, d: str) -> DataFrame:
    return structure.classified(structure.numbered_lines(table(s, d, "documents"), "doc_id", "text")).drop("line")


@query(f"WITH {_LINES}, {_classes()}, {_TREE} SELECT doc_id, order_index, parent_order_index FROM tr")
def node_tree(s: SparkSession, d: str) -> DataFrame:
    return structure.tree(_classified(s, d), "doc_id").select("doc_id", "order_index", "parent_order_index")


@query(f"""WITH RECURSIVE {_LINES}, {_classes()}, {_TREE}, ow AS (SELECT *, CASE WHEN node_type = 'title' THEN title WHEN node_type <> 'paragraph' THEN concat_ws(' ', label, title) END AS own FROM tr),
up AS (SELECT doc_id, order_index, own AS path, parent_order_index AS nxt FROM ow UNION ALL SELECT up.doc_id, up.order_index, concat_ws(' > ', ow.own, up.path), ow.parent_order_index FROM up JOIN ow ON ow.doc_id = up.doc_id AND ow.order_index = up.nxt)
SELECT doc_id, order_index, sha256(coalesce(path, '')) AS path_hash FROM up WHERE nxt IS NULL""")
def heading_paths(s: SparkSession, d: str) -> DataFrame:
    return structure.heading_paths(_classified(s, d), "doc_id").select("doc_id", "order_index", F.sha2("heading_path", 256).alias("path_hash"))


@query(f"""WITH RECURSIVE {_LINES}, {_classes()}, {_TREE}, ow AS (SELECT *, CASE WHEN node_type = 'title' THEN title WHEN node_type <> 'paragraph' THEN concat_ws(' ', label, title) END AS own FROM tr),
up AS (SELECT doc_id, order_index, own AS path, parent_order_index AS nxt FROM ow UNION ALL SELECT up.doc_id, up.order_index, concat_ws(' > ', ow.own, up.path), ow.parent_order_index FROM up JOIN ow ON ow.doc_id = up.doc_id AND ow.order_index = up.nxt)
SELECT doc_id, order_index, node_type, node_type || ':' || coalesce(nullif({sql.squeeze("coalesce(label, '')")}, ''), CAST(order_index AS VARCHAR)) AS locator, parent_order_index, sha256(coalesce(path, '')) AS path_hash FROM tr JOIN (SELECT doc_id, order_index, path FROM up WHERE nxt IS NULL) USING (doc_id, order_index)""")
def normalize_structure(s: SparkSession, d: str) -> DataFrame:
    n = structure.structured(table(s, d, "documents"), "doc_id", "text")
    return n.select("doc_id", "order_index", "node_type", "locator", "parent_order_index", F.sha2("heading_path", 256).alias("path_hash"))


_REFS = f"""rf AS (SELECT DISTINCT doc_id, {sql.code("regexp_replace(r, '[.,;:]+$', '')")} AS code FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{structure.REFERENCE}')) AS r FROM documents))"""


@query(f"WITH {_REFS} SELECT * FROM rf")
def references_extract(s: SparkSession, d: str) -> DataFrame:
    return structure.references(table(s, d, "documents").withColumn("_t", F.lit(None).cast("string")), ["doc_id"], "_t", "text").select("doc_id", "code")


@query(f"""WITH {_REFS}, k AS (SELECT normalized_code AS code, min(document_id) AS matched_document_id FROM document_registry GROUP BY 1)
SELECT doc_id, code, matched_document_id, CAST(CASE WHEN matched_document_id IS NULL THEN 0.5 ELSE 1.0 END AS DOUBLE) AS match_confidence FROM rf LEFT JOIN k USING (code)""")
def reference_match(s: SparkSession, d: str) -> DataFrame:
    refs = structure.references(table(s, d, "documents").withColumn("_t", F.lit(None).cast("string")), ["doc_id"], "_t", "text").select("doc_id", "code")
    known = table(s, d, "document_registry").groupBy(F.col("normalized_code").alias("code")).agg(F.min("document_id").alias("document_id"))
    return structure.matched_references(refs, known)


# -- blocks and cards ------------------------------------------------------------------------------------------------------

_HEADTXT = f"array_to_string(list_filter([nullif({sql.squeeze('label')}, ''), CASE WHEN {sql.squeeze('locator_normalized')} = {sql.squeeze('label')} THEN NULL ELSE nullif({sql.squeeze('locator_normalized')}, '') END], lambda x: x IS NOT NULL), ' ')"
_BLOCKS = f"""{_NODES}, rn AS (SELECT id, version_id, order_index, node_type, locator_normalized, heading_path, coalesce(array_to_string(string_split(heading_path, ' > ')[1:2], ' > '), '') AS ctx,
CASE WHEN coalesce({_HEADTXT}, '') IN ('', trim(text, ' ')) THEN trim(text, ' ') ELSE {_HEADTXT} || chr(10) || trim(text, ' ') END AS rendered FROM nd WHERE version_id IS NOT NULL AND length(trim(coalesce(text, ''), ' ')) > 0),
sq AS (SELECT *, length(rendered) AS n, row_number() OVER (PARTITION BY version_id ORDER BY order_index, id) AS i FROM rn),
bl AS (SELECT version_id, i, CASE WHEN n >= 1200 THEN 1 ELSE 0 END AS bn, 0 AS own, CASE WHEN n >= 1200 THEN 0 ELSE n END AS chars, CASE WHEN n >= 1200 THEN 0 ELSE 1 END AS cnt, ctx FROM sq WHERE i = 1
UNION ALL SELECT version_id, i, own + CAST(done AS INT), own, CASE WHEN done THEN 0 ELSE c2 END, CASE WHEN done THEN 0 ELSE k2 END, ctx FROM
(SELECT *, c2 >= 1200 OR k2 >= 12 AS done FROM (SELECT version_id, i, ctx, bn + CAST(cut AS INT) AS own, CASE WHEN cut OR cnt = 0 THEN n ELSE chars + n + 1 END AS c2, CASE WHEN cut THEN 1 ELSE cnt + 1 END AS k2 FROM
(SELECT sq.version_id, sq.i, sq.ctx, sq.n, b.bn, b.chars, b.cnt, b.cnt > 0 AND ((b.chars >= 700 AND (b.cnt >= 12 OR b.chars >= 1800 OR sq.ctx <> b.ctx OR sq.node_type IN ('section','appendix','table'))) OR b.chars + sq.n + 1 > 1800) AS cut FROM bl b JOIN sq ON sq.version_id = b.version_id AND sq.i = b.i + 1))))"""


@query(f"WITH RECURSIVE {_BLOCKS} SELECT version_id, CAST(own AS INT) AS block_no, min(order_index) AS start_order, max(order_index) AS end_order, count(*) AS n_nodes, sha256(string_agg(rendered, chr(10) ORDER BY order_index, id)) AS text_hash FROM bl JOIN sq USING (version_id, i) GROUP BY 1, 2")
def semantic_blocks(s: SparkSession, d: str) -> DataFrame:
    b = blocks.semantic_blocks(table(s, d, "document_nodes"))
    return b.select("version_id", "block_no", "start_order", "end_order", "n_nodes", F.sha2("text", 256).alias("text_hash"))


_CUR = """cur AS (SELECT * FROM (SELECT DISTINCT document_id, normalized_code, display_code, document_type, title, status_normalized, current_version_id, created_at,
row_number() OVER (PARTITION BY document_id ORDER BY created_at DESC NULLS LAST, normalized_code DESC NULLS LAST, display_code DESC NULLS LAST, document_type DESC NULLS LAST, title DESC NULLS LAST, status_normalized DESC NULLS LAST, current_version_id DESC NULLS LAST) AS k
FROM document_registry WHERE deleted_at IS NULL AND document_id IS NOT NULL) WHERE k = 1)"""


def current(s: SparkSession, d: str) -> DataFrame:
    return versions.current_documents(table(s, d, "document_registry"))


def cards(s: SparkSession, d: str) -> DataFrame:
    docs = current(s, d).withColumnRenamed("current_version_id", "version_id")
    return blocks.document_cards(docs, table(s, d, "document_aliases"), nodes(s, d, "version_id", "order_index", "node_type", "label", "title", "text"))


_SQ = sql.squeeze
_HLAB = f"CASE WHEN node_type = 'paragraph' THEN NULL WHEN node_type = 'title' THEN nullif({_SQ("coalesce(text, '')")}, '') ELSE nullif(concat_ws(' ', nullif({_SQ("coalesce(label, '')")}, ''), nullif({_SQ("coalesce(title, '')")}, '')), '') END"
_CARDS = f"""{_CUR}, {_NODES}, al AS (SELECT document_id, string_agg(alias_raw, '; ' ORDER BY alias_raw) AS aliases FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY alias_raw) AS k FROM (SELECT DISTINCT document_id, alias_raw FROM document_aliases WHERE alias_raw IS NOT NULL AND NOT contains(alias_raw, '://'))) WHERE k <= 12 GROUP BY 1),
own AS (SELECT c.document_id, nd.*, {_HLAB.replace('title <', 'nd.title <')} AS heading FROM nd JOIN (SELECT document_id, current_version_id AS version_id FROM cur) c USING (version_id)),
hd AS (SELECT document_id, string_agg(heading, '; ' ORDER BY k) AS headings FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY order_index, id) AS k FROM own WHERE heading IS NOT NULL AND node_type IN ('title','section','subsection','appendix')) WHERE k <= 16 GROUP BY 1),
fr AS (SELECT document_id, string_agg(trim(text, ' '), chr(10) ORDER BY k) AS fragments FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY order_index, id) AS k FROM own WHERE node_type NOT IN ('title','section') AND length(trim(text, ' ')) > 0) WHERE k <= 3 GROUP BY 1),
card AS (SELECT document_id, concat_ws(chr(10), display_code, normalized_code, title, aliases, headings, fragments) AS card_text FROM cur LEFT JOIN al USING (document_id) LEFT JOIN hd USING (document_id) LEFT JOIN fr USING (document_id))"""


@query(f"WITH {_CARDS} SELECT document_id, length(card_text) AS n_chars, sha256(card_text) AS card_hash FROM card")
def document_cards(s: SparkSession, d: str) -> DataFrame:
    return cards(s, d).select("document_id", F.length("card_text").alias("n_chars"), F.sha2("card_text", 256).alias("card_hash"))


# -- versions and aliases --------------------------------------------------------------------------------------------------

_HASH = f"h AS (SELECT doc_id, sha256(array_to_string({sql.lines('text')}, chr(10))) AS content_hash FROM documents)"


@query(f"WITH {_HASH} SELECT content_hash, count(*) AS n, min(doc_id) AS keep_id FROM h GROUP BY 1 HAVING count(*) > 1")
def dedup_groups(s: SparkSession, d: str) -> DataFrame:
    return versions.duplicate_groups(table(s, d, "documents"), "doc_id", "text")


@query(f"WITH {_HASH} SELECT doc_id, content_hash, active_id, doc_id <> active_id AS is_duplicate FROM h JOIN (SELECT content_hash, min(doc_id) AS active_id FROM h GROUP BY 1) USING (content_hash)")
def duplicate_versions(s: SparkSession, d: str) -> DataFrame:
    return versions.duplicates(table(s, d, "documents"), "doc_id", "text")


@query(f"""WITH v AS (SELECT source AS document_id, doc_id AS version_id, seen_at AS created_at, sha256(array_to_string({sql.lines('text')}, chr(10))) AS content_hash FROM documents WHERE source IS NOT NULL),
m AS (SELECT *, lag(content_hash) OVER w AS prev, row_number() OVER w AS k FROM v WINDOW w AS (PARTITION BY document_id ORDER BY created_at NULLS FIRST, version_id)),
e AS (SELECT *, CASE WHEN k > 1 AND prev = content_hash THEN 'skipped_duplicate' ELSE 'activated' END AS event FROM m), l AS (SELECT document_id, version_id AS last FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY created_at DESC NULLS LAST, version_id DESC) AS r FROM e WHERE event = 'activated') WHERE r = 1)
SELECT document_id, version_id, event, CASE WHEN k = 1 THEN 'initial_activation' WHEN event = 'activated' THEN 'new_content_hash' ELSE 'equal_content_hash' END AS reason, version_id = last AS is_active FROM e JOIN l USING (document_id)""")
def version_events(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "documents").where("source is not null")
    return versions.activations(docs.select(F.col("source").alias("document_id"), F.col("doc_id").alias("version_id"), text.content_hash(F.col("text")).alias("content_hash"), F.col("seen_at").alias("created_at")))


@query(f"""WITH {_CUR}, v AS (SELECT DISTINCT document_id, current_version_id AS version_id, created_at FROM document_registry WHERE lower(status_normalized) = 'active' AND current_version_id IS NOT NULL),
n AS (SELECT document_id, version_id AS newest FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY created_at DESC NULLS LAST, version_id DESC) AS r FROM v) WHERE r = 1)
SELECT document_id, coalesce(current_version_id, newest) AS version_id FROM cur LEFT JOIN n USING (document_id)""")
def active_version(s: SparkSession, d: str) -> DataFrame:
    v = table(s, d, "document_registry").where("current_version_id is not null").select("document_id", F.col("current_version_id").alias("version_id"), "created_at", F.coalesce(F.lower("status_normalized") == "active", F.lit(False)).alias("is_active"))
    return versions.active_versions(current(s, d), v)


@query(f"""WITH {_CUR}, f AS (SELECT document_id, {sql.family('display_code')} AS family, CAST(nullif(regexp_extract(display_code, '(?:19|20)[0-9]{{2}}'), '') AS INT) AS y FROM cur)
SELECT family, y AS latest_year, document_id FROM (SELECT *, row_number() OVER (PARTITION BY family ORDER BY y DESC, document_id) AS r FROM f WHERE y IS NOT NULL) WHERE r = 1""")
def latest_edition(s: SparkSession, d: str) -> DataFrame:
    return versions.latest_editions(current(s, d))


_ST = lambda x: f"CASE WHEN lower({_SQ(x)}) IN ('имеет силу','имеет силу с изменениями','имеет силу частично') THEN 'active' WHEN lower({_SQ(x)}) IN ('не имеет силы','сила прекращена','снят с применения','замещён новым изданием') THEN 'inactive' ELSE 'unknown' END"


@query(f"""WITH {_CUR}, l AS (SELECT document_id, max(text_actualized_at) AS d0 FROM document_snapshots WHERE document_id IS NOT NULL GROUP BY 1), c AS (SELECT DISTINCT card_id, document_id, card_status_raw, text_actualized_at FROM document_cards),
x AS (SELECT card_id, coalesce({_ST('card_status_raw')} <> lower(trim(status_normalized, ' ')), false) AS a, text_actualized_at IS NOT NULL AND (d0 IS NULL OR text_actualized_at > d0) AS b FROM c JOIN cur USING (document_id) LEFT JOIN l USING (document_id))
SELECT card_id, a OR b AS needs_refresh, concat_ws(',', CASE WHEN a THEN 'status_changed' END, CASE WHEN b THEN 'newer_source' END) AS reasons FROM x""")
def refresh_required(s: SparkSession, d: str) -> DataFrame:
    local = table(s, d, "document_snapshots").where("document_id is not null").groupBy("document_id").agg(F.max("text_actualized_at").alias("text_actualized_at"))
    docs = current(s, d).join(local, "document_id", "left").select("document_id", "status_normalized", "text_actualized_at")
    return versions.refresh_decisions(table(s, d, "document_cards").select("card_id", "document_id", "card_status_raw", "text_actualized_at").distinct(), docs)


@query(f"""WITH {_CUR}, c AS (SELECT DISTINCT card_id, document_id, card_status_raw, source_list_status_raw, seen_at FROM document_cards WHERE document_id IS NOT NULL), l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY seen_at DESC NULLS LAST, card_id DESC) AS r FROM c) WHERE r = 1),
t AS (SELECT card_id, document_id, {_ST(f"coalesce(nullif({_SQ('card_status_raw')}, ''), source_list_status_raw)")} AS st FROM l)
SELECT card_id, document_id, CASE WHEN st = 'inactive' THEN 'skip_inactive' WHEN st = 'unknown' THEN 'skip_unknown' WHEN cur.document_id IS NOT NULL THEN 'update' ELSE 'insert' END AS action FROM t LEFT JOIN cur USING (document_id)""")
def card_actions(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "document_cards").select("card_id", "document_id", "card_status_raw", "source_list_status_raw", "seen_at").distinct()
    return versions.accepted_cards(c, current(s, d))


_PREF = "CASE upper(split_part(c, ' ', 1)) WHEN 'СП' THEN ['СП','SP'] WHEN 'SP' THEN ['SP','СП'] WHEN 'СНИП' THEN ['СНИП','SNIP','СНиП'] WHEN 'SNIP' THEN ['SNIP','СНИП','СНиП'] WHEN 'ГОСТ' THEN ['ГОСТ','GOST'] WHEN 'GOST' THEN ['GOST','ГОСТ'] ELSE [split_part(c, ' ', 1)] END"


def _code_alias_sql(col: str) -> str:
    return f"""(WITH a AS (SELECT document_id, {sql.clean_code(col)} AS c FROM cur), b AS (SELECT document_id, c, unnest({_PREF}) AS p, CASE WHEN instr(c, ' ') > 0 THEN substr(c, instr(c, ' ') + 1) ELSE '' END AS r FROM a WHERE c <> ''),
t AS (SELECT document_id, c, p, r, unnest([nullif(r, ''), CASE WHEN regexp_matches(r, '^.+-[0-9]{{4}}$') THEN regexp_replace(r, '-[0-9]{{4}}$', '') END, CASE WHEN len(string_split(r, '.')) >= 3 AND regexp_matches(r, '\\.[0-9]{{4}}$') THEN regexp_replace(r, '\\.[0-9]{{4}}$', '') END,
nullif(split_part(r, '.', 1), ''), CASE WHEN len(string_split(r, '.')) >= 2 THEN split_part(r, '.', 1) || '.' || split_part(r, '.', 2) END]) AS tail FROM b WHERE r <> '')
SELECT document_id, c AS alias_raw FROM b UNION SELECT document_id, p || ' ' || tail FROM t WHERE tail IS NOT NULL UNION SELECT document_id, p || tail FROM t WHERE tail IS NOT NULL)"""


_FORM = f"nullif(lower(trim(regexp_replace({_SQ('alias_raw')}, '[ ,;:()\\\\\\[\\]\"''`]+', ' ', 'g'), ' ')), '')"
_ALIAS = f"""{_CUR}, raw AS (SELECT document_id, alias_raw, 'display_code' AS alias_type, 1.0 AS confidence FROM {_code_alias_sql('display_code')} UNION ALL SELECT document_id, alias_raw, 'normalized_code', 1.0 FROM {_code_alias_sql('normalized_code')}
UNION ALL SELECT document_id, {_SQ('title')}, 'title', 0.9 FROM cur UNION ALL SELECT document_id, nullif(split_part({_SQ('title')}, '. ', 1), ''), 'short_title', 0.8 FROM cur),
fa AS (SELECT document_id, {_FORM} AS alias_normalized, alias_raw, alias_type, CAST(confidence AS DOUBLE) AS confidence FROM raw),
ab AS (SELECT document_id, alias_normalized, alias_raw, alias_type, confidence FROM (SELECT *, row_number() OVER (PARTITION BY document_id, alias_normalized ORDER BY confidence DESC, alias_type, alias_raw) AS k FROM fa WHERE alias_normalized IS NOT NULL AND length(alias_normalized) <= 255) WHERE k = 1)"""


@query(f"WITH {_ALIAS} SELECT * FROM ab")
def alias_build(s: SparkSession, d: str) -> DataFrame:
    return versions.built_aliases(current(s, d))


@query("""SELECT alias_id, document_id, alias_normalized, confidence FROM (SELECT *, row_number() OVER (PARTITION BY document_id, alias_normalized ORDER BY coalesce(confidence, 0.0) DESC, alias_type NULLS LAST, alias_id) AS k
FROM (SELECT DISTINCT alias_id, document_id, alias_normalized, alias_type, confidence FROM document_aliases WHERE document_id IS NOT NULL AND alias_normalized IS NOT NULL)) WHERE k = 1""")
def alias_best(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "document_aliases").select("alias_id", "document_id", "alias_normalized", "alias_type", "confidence").distinct()
    return versions.best_aliases(rows).select("alias_id", "document_id", "alias_normalized", "confidence")


@query(f"""WITH {_ALIAS}, p AS (SELECT DISTINCT lower(split_part(entry_text, '-', 1)) AS prefix FROM canonical_entries WHERE list_name = 'designation')
SELECT prefix, alias_normalized, document_id, rk FROM (SELECT prefix, alias_normalized, document_id, CAST(row_number() OVER (PARTITION BY prefix ORDER BY confidence DESC, alias_normalized, document_id) AS INT) AS rk FROM p JOIN ab ON starts_with(alias_normalized, prefix)) WHERE rk <= 25""")
def alias_prefix_lookup(s: SparkSession, d: str) -> DataFrame:
    prefixes = table(s, d, "canonical_entries").where("list_name = 'designation'").select(F.lower(F.split_part("entry_text", F.lit("-"), F.lit(1))).alias("prefix")).distinct()
    return versions.aliases_with_prefix(prefixes, versions.built_aliases(current(s, d)))


# -- resolution ------------------------------------------------------------------------------------------------------------

_ASK = "ask AS (SELECT item_id, question || CASE WHEN item_id % 3 = 0 THEN ' по ' || entry_text || ', п. 4.2 и приложение Б' WHEN item_id % 3 = 1 THEN ' по ' || split_part(entry_text, '-', 1) || ' таблица 3' ELSE '' END AS t FROM eval_passages JOIN canonical_entries ON entry_id = item_id)"


def questions(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "eval_passages").join(table(s, d, "canonical_entries").select(F.col("entry_id").alias("item_id"), "entry_text"), "item_id")
    tail = F.when(F.col("item_id") % 3 == 0, F.concat(F.lit(" по "), "entry_text", F.lit(", п. 4.2 и приложение Б"))).when(F.col("item_id") % 3 == 1, F.concat(F.lit(" по "), F.split_part("entry_text", F.lit("-"), F.lit(1)), F.lit(" таблица 3"))).otherwise("")
    return resolve.parsed(e.select("item_id", F.concat("question", tail).alias("t")), "item_id", "t")


_B = resolve.BEFORE
_RX = {k: v.replace("(?iu)", "(?i)").replace("'", "''") for k, v in {"code": resolve.CODE, "num": resolve.NUMERIC, "app": resolve.APPENDIX, "comp": resolve.COMPACT}.items()}
_LOCF = lambda x: f"regexp_replace(trim(regexp_replace({_SQ(x)}, '(?i)^(п\\.?|пункт|раздел|глава|таблица|приложение|section|chapter|table|appendix) +', ''), ' '), '', '')"
_LOCN = lambda x: f"CASE WHEN {_LOCF(x)} = '' THEN NULL WHEN regexp_full_match(regexp_replace({_LOCF(x)}, '[ _-]+', '', 'g'), '[0-9]+') THEN regexp_replace({_LOCF(x)}, '[ _-]+', '', 'g') ELSE lower({_LOCF(x)}) END"
_PARSE = f"""{_ASK}, nq AS (SELECT item_id, regexp_replace({_SQ('t')}, '{_RX['comp']}', '\\1\\2 \\3', 'g') AS q FROM ask), cq AS (SELECT item_id, unnest(list_transform(regexp_extract_all(q, '{_RX['code']}', 1), lambda x: {sql.code('x')})) AS n FROM nq),
pq AS (SELECT item_id, n, split_part(n, ' ', 1) AS a, CASE WHEN instr(n, ' ') > 0 THEN substr(n, instr(n, ' ') + 1) ELSE '' END AS r FROM cq), yq AS (SELECT *, regexp_replace(r, '[-./][0-9]{{4}}$', '') AS y, split_part(r, '.', 1) AS f FROM pq),
vq AS (SELECT item_id, v FROM (SELECT item_id, unnest([n, CASE WHEN r <> '' THEN a || r END, CASE WHEN y <> '' AND y <> r THEN a || ' ' || y END, CASE WHEN y <> '' AND y <> r THEN a || y END, CASE WHEN r <> '' AND f <> '' THEN a || ' ' || f END, CASE WHEN r <> '' AND f <> '' THEN a || f END]) AS v FROM yq WHERE n <> '') WHERE v IS NOT NULL)"""


@query(f"""WITH {_PARSE} SELECT item_id, coalesce((SELECT string_agg(DISTINCT v, '|' ORDER BY v) FROM vq WHERE vq.item_id = nq.item_id), '') AS codes,
coalesce((SELECT string_agg(DISTINCT x, '|' ORDER BY x) FROM (SELECT unnest(list_transform(regexp_extract_all(q, '{_RX['num']}', 1), lambda z: {_LOCN('z')}) || list_transform(regexp_extract_all(q, '{_RX['app']}', 1), lambda z: {_LOCN('z')})) AS x)), '') AS locators, len({sql.tokens('q')}) AS n_tokens FROM nq""")
def parse_query(s: SparkSession, d: str) -> DataFrame:
    q = questions(s, d)
    return q.select("item_id", F.array_join(F.array_sort("codes"), "|").alias("codes"), F.array_join(F.array_sort("locators"), "|").alias("locators"), F.size("tokens").alias("n_tokens"))


_FAM = sql.family
_RES = f"""{_PARSE}, {_ALIAS.replace(_CUR + ',', '')}, va AS (SELECT DISTINCT item_id, v, nullif(lower(trim(regexp_replace({_SQ('v')}, '[ ,;:()\\\\\\[\\]\"''`]+', ' ', 'g'), ' ')), '') AS al FROM vq),
ca AS (SELECT item_id, document_id, 1.15 AS s, 1 AS r, 'explicit_code' AS reason FROM va JOIN cur ON normalized_code = v UNION ALL SELECT item_id, document_id, 1.0 + least(confidence, 1.0) * 0.08, 2, 'exact_alias' FROM va JOIN ab ON alias_normalized = al
UNION ALL SELECT item_id, document_id, 0.82 + least(confidence, 1.0) * 0.08, 3, 'prefix_alias' FROM va JOIN (SELECT al, document_id, confidence FROM (SELECT al, document_id, confidence, row_number() OVER (PARTITION BY al ORDER BY confidence DESC, alias_normalized, document_id) AS k FROM (SELECT DISTINCT al FROM va) JOIN ab ON alias_normalized = al OR (starts_with(alias_normalized, al) AND substr(alias_normalized, length(al) + 1, 1) IN ('.', '-', '/', ' '))) WHERE k <= 25) USING (al)
UNION ALL SELECT item_id, document_id, 0.9, 4, 'explicit_family_fallback' FROM (SELECT DISTINCT item_id, {_FAM('v')} AS fm FROM vq) JOIN (SELECT document_id, {_FAM('display_code')} AS fm FROM cur) USING (fm)),
res AS (SELECT item_id, document_id, score, reason FROM (SELECT item_id, document_id, round_even(CAST(s AS DOUBLE), 4) AS score, reason, row_number() OVER (PARTITION BY item_id, document_id ORDER BY round_even(CAST(s AS DOUBLE), 4) DESC, r) AS k FROM ca) WHERE k = 1)"""


def _resolved(s: SparkSession, d: str) -> DataFrame:
    docs = current(s, d)
    return resolve.resolved(questions(s, d), "item_id", docs, versions.built_aliases(docs))


@query(f"WITH {_CUR}, {_RES} SELECT item_id, document_id, score, reason, rk FROM (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, document_id) AS INT) AS rk FROM res) WHERE rk <= 6")
def resolve_document(s: SparkSession, d: str) -> DataFrame:
    return relational.top(_resolved(s, d), ["item_id"], [F.desc("score"), F.asc("document_id")], 6).select("item_id", "document_id", "score", "reason", "rk")


#: The queries' own topics: token stems, and families with their bonus.
TOPICS = ((("мост", "насос", "кабел"), (("СНиП 545", 0.2), ("ГОСТ Р 863", 0.28))), (("стен", "темпер"), (("СП 150", 0.2),)))
_YEAR = lambda x: f"CAST(nullif(regexp_extract({x}, '(?:19|20)[0-9]{{2}}'), '') AS INT)"
_LEG = lambda x: f"(starts_with(upper({x}), 'СНИП') OR starts_with(upper({x}), 'SNIP'))"
_TOPIC = "greatest(0.0, " + ", ".join(f"CASE WHEN len(list_filter(tk, lambda t: regexp_matches(t, '^(?:{'|'.join(stems)})'))) > 0 AND fm = {sql.family(chr(39) + name + chr(39))} THEN {bonus} ELSE 0.0 END" for stems, families in TOPICS for name, bonus in families) + ")"
_RERANK = f"""{_RES}, oc AS (SELECT item_id, unnest(c) AS n, generate_subscripts(c, 1) AS o FROM (SELECT item_id, list_transform(regexp_extract_all(q, '{_RX['code']}', 1), lambda x: {sql.code('x')}) AS c FROM nq)),
op AS (SELECT *, split_part(n, ' ', 1) AS a, CASE WHEN instr(n, ' ') > 0 THEN substr(n, instr(n, ' ') + 1) ELSE '' END AS r FROM oc WHERE n <> ''), oy AS (SELECT *, regexp_replace(r, '[-./][0-9]{{4}}$', '') AS y, split_part(r, '.', 1) AS f FROM op),
ol AS (SELECT item_id, o, [n, CASE WHEN r <> '' THEN a || r END, CASE WHEN y <> '' AND y <> r THEN a || ' ' || y END, CASE WHEN y <> '' AND y <> r THEN a || y END, CASE WHEN r <> '' AND f <> '' THEN a || ' ' || f END, CASE WHEN r <> '' AND f <> '' THEN a || f END] AS l FROM oy),
ov AS (SELECT item_id, v, min(o * 10 + i) AS p FROM (SELECT item_id, o, unnest(l) AS v, generate_subscripts(l, 1) AS i FROM ol) WHERE v IS NOT NULL GROUP BY 1, 2), ok AS (SELECT item_id, v, {sql.family('v')} AS vf, {_YEAR('v')} AS vy, row_number() OVER (PARTITION BY item_id ORDER BY p) AS k FROM ov),
rc AS (SELECT res.item_id, document_id, score, display_code AS dc, {sql.family('display_code')} AS fm, {_YEAR('display_code')} AS dy, coalesce({_LEG('display_code')}, false) OR coalesce(contains(lower(title), 'пособ'), false) AS leg, lower(coalesce(status_normalized, '')) AS st FROM res JOIN cur USING (document_id) WHERE NOT coalesce(regexp_full_match(display_code, '(?:СП|SP) [0-9]+\\.0') AND title = display_code, false)),
fo AS (SELECT item_id, document_id, dc, fm, dy, CAST(0 AS BIGINT) AS k, CAST(0 AS DOUBLE) AS best FROM rc UNION ALL SELECT fo.item_id, document_id, dc, fm, dy, ok.k, CAST(CASE WHEN v = dc THEN greatest(best, 0.35) ELSE greatest(best, CASE WHEN vf = fm AND starts_with(dc, v) THEN 0.22 WHEN vf = fm AND starts_with(v, dc) THEN 0.14 WHEN vf = fm THEN 0.18 ELSE 0.0 END) - CASE WHEN coalesce(vy <> dy, false) THEN 0.28 ELSE 0.0 END END AS DOUBLE) FROM fo JOIN ok ON ok.item_id = fo.item_id AND ok.k = fo.k + 1),
lf AS (SELECT item_id, document_id, arg_max(best, k) AS best FROM fo GROUP BY 1, 2), qa AS (SELECT nq.item_id, {sql.tokens('q')} AS tk, count(v) > 0 AS ex, coalesce(bool_or(vy IS NOT NULL), false) AS ay, coalesce(bool_or({_LEG('v')}), false) AS al FROM nq LEFT JOIN ok USING (item_id) GROUP BY nq.item_id, q),
rw AS (SELECT *, max(dy) OVER (PARTITION BY item_id, fm) AS ly, bool_or(NOT leg) OVER (PARTITION BY item_id) AS md FROM rc JOIN lf USING (item_id, document_id) JOIN qa USING (item_id)),
rs AS (SELECT item_id, document_id, dc AS display_code, leg, round_even(CAST(score + best + {_TOPIC} + CASE WHEN st = 'active' THEN 0.1 ELSE 0.0 END - CASE WHEN st = 'inactive' THEN 0.18 ELSE 0.0 END + CASE WHEN NOT ay AND dy IS NOT NULL THEN CASE WHEN dy = ly THEN 0.16 ELSE -least(0.24, 0.06 * (ly - dy)) END ELSE 0.0 END + CASE WHEN md AND NOT al AND leg THEN CASE WHEN ex THEN -0.26 ELSE -0.32 END ELSE 0.0 END + CASE WHEN NOT ex AND NOT al AND leg THEN -0.08 ELSE 0.0 END AS DOUBLE), 4) AS score FROM rw)"""


@query(f"WITH RECURSIVE {_CUR}, {_RERANK} SELECT item_id, document_id, display_code, score, rk FROM (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, leg, display_code, document_id) AS INT) AS rk FROM rs) WHERE rk <= 6")
def rerank_candidates(s: SparkSession, d: str) -> DataFrame:
    status = F.lower(F.coalesce("status_normalized", F.lit("")))
    docs = current(s, d).select("document_id", "display_code", "title", (status == "active").alias("is_active"), (status == "inactive").alias("is_outdated"))
    c = _resolved(s, d).join(docs, "document_id").join(questions(s, d).select("item_id", "codes", "tokens"), "item_id")
    return resolve.reranked(c, "item_id", topics=TOPICS)


@query(f"""WITH {_CARDS}, q AS (SELECT DISTINCT item_id, unnest({sql.tokens('question')}) AS token FROM eval_passages), n AS (SELECT item_id, count(*) AS n FROM q GROUP BY 1), p AS (SELECT DISTINCT document_id, unnest({sql.tokens('card_text')}) AS token FROM card),
c AS (SELECT item_id, document_id, round_even(count(*) / any_value(n), 4) AS score FROM p JOIN q USING (token) JOIN n USING (item_id) GROUP BY 1, 2)
SELECT item_id, document_id, score, rk FROM (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, document_id) AS INT) AS rk FROM c) WHERE rk <= 8""")
def discover_documents(s: SparkSession, d: str) -> DataFrame:
    return resolve.discovered(table(s, d, "eval_passages"), cards(s, d), None).select("item_id", "document_id", "score", "rk")


# -- evidence: the held-out questions as they are, and one question for each document, which names it and a locator ----------

_NO = "CAST(right(document_id, 6) AS INT)"
_ASKED = f"ask AS (SELECT 'E' || item_id AS item_id, question AS t FROM eval_passages UNION ALL SELECT document_id, 'Что установлено в ' || display_code || ', п. ' || (1 + {_NO} % 9) || CASE WHEN {_NO} % 2 = 0 THEN '.' || (1 + {_NO} % 7) ELSE '' END || '?' FROM cur WHERE display_code IS NOT NULL)"


def asked_questions(s: SparkSession, d: str) -> DataFrame:
    """The parsed questions: of eval_passages, which name no document, and of every current document."""
    no = F.right("document_id", F.lit(6)).cast("int")
    place = F.concat((1 + no % 9).cast("string"), F.when(no % 2 == 0, F.concat(F.lit("."), (1 + no % 7).cast("string"))).otherwise(""))
    own = current(s, d).where("display_code is not null").select(F.col("document_id").alias("item_id"), F.concat(F.lit("Что установлено в "), "display_code", F.lit(", п. "), place, F.lit("?")).alias("t"))
    held = table(s, d, "eval_passages").select(F.concat(F.lit("E"), F.col("item_id").cast("string")).alias("item_id"), F.col("question").alias("t"))
    return durable(resolve.parsed(held.unionByName(own), "item_id", "t"))


_FULL_UNITS = "fu AS (SELECT * FROM (SELECT DISTINCT unit_id, version_id, unit_type, start_order_index, locator_primary, heading_path, CAST(embedding AS DOUBLE[]) AS e FROM retrieval_units WHERE unit_id IS NOT NULL) WHERE len(e) = 64 AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0)"


def evidence_units(s: SparkSession, d: str) -> DataFrame:
    return relational.unique(table(s, d, "retrieval_units"), "unit_id", "version_id", "unit_type", "start_order_index", "end_order_index", "locator_primary", "heading_path", "text", "embedding")


def evidence_nodes(s: SparkSession, d: str) -> DataFrame:
    return nodes(s, d, "version_id", "order_index", "locator_normalized", "heading_path", "text")


_SPARSE = f"""qt AS (SELECT item_id, unnest({sql.tokens('q')}) AS token FROM nq), qh AS (SELECT item_id, sha256(token) AS x, count(*) AS n FROM qt GROUP BY item_id, token),
qs AS (SELECT item_id, CAST('0x' || substr(x, 1, 8) AS BIGINT) % 64 AS dim, sum((CASE WHEN CAST('0x' || substr(x, 9, 2) AS BIGINT) % 2 = 0 THEN 1 ELSE -1 END) * (1 + CAST('0x' || substr(x, 11, 2) AS BIGINT) / CAST(255 AS DOUBLE)) * n) AS w FROM qh GROUP BY 1, 2),
qv AS (SELECT item_id, list_transform(range(0, 64), lambda i: coalesce(m[i], 0.0)) AS v FROM (SELECT item_id, map(list(dim), list(w)) AS m FROM qs GROUP BY 1))"""
_COSV = "list_sum(list_transform(list_zip(v, e), lambda z: z[1] * z[2])) / (sqrt(list_sum(list_transform(v, lambda y: y * y))) * sqrt(list_sum(list_transform(e, lambda y: y * y))))"
_RERANK_TAIL = _RERANK[_RERANK.index("oc AS ("):].replace("FROM res JOIN cur", "FROM cand JOIN cur").replace("SELECT res.item_id, document_id", "SELECT cand.item_id, document_id")
_CAND = f"""{_CARDS}, {_RES.replace(_ASK, _ASKED)}, {_FULL_UNITS}, {_SPARSE},
ot AS (SELECT DISTINCT item_id, unnest({sql.tokens('q')}) AS token FROM nq WHERE item_id NOT IN (SELECT item_id FROM res)), oz AS (SELECT item_id, count(*) AS n FROM ot GROUP BY 1), ct AS (SELECT DISTINCT document_id, unnest({sql.tokens('card_text')}) AS token FROM card),
cw AS (SELECT item_id, document_id, round_even(count(*) / any_value(n), 4) AS score FROM ct JOIN ot USING (token) JOIN oz USING (item_id) GROUP BY 1, 2), vd AS (SELECT current_version_id AS version_id, min(document_id) AS document_id FROM cur WHERE current_version_id IS NOT NULL GROUP BY 1),
cd0 AS (SELECT item_id, unit_id, version_id, round_even({_COSV}, 4) AS c FROM qv, fu WHERE unit_type = 'document_card' AND item_id IN (SELECT item_id FROM ot)), cd AS (SELECT item_id, document_id, round_even(round_even(greatest(0.0, c), 4) + 0.15, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY c DESC, unit_id) AS k FROM cd0) JOIN vd USING (version_id) WHERE k <= 30),
ds AS (SELECT item_id, document_id, max(score) AS score FROM (SELECT * FROM cw UNION ALL SELECT * FROM cd) GROUP BY 1, 2), dt AS (SELECT item_id, document_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, document_id) AS k FROM ds) WHERE k <= 8),
cand AS (SELECT item_id, document_id, score FROM res UNION ALL SELECT * FROM dt), {_RERANK_TAIL}, rr AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, leg, display_code, document_id) AS INT) AS rk FROM rs),
cn AS (SELECT item_id, document_id, display_code, score, rk FROM rr WHERE rk <= CASE WHEN item_id IN (SELECT item_id FROM res) THEN 6 ELSE 8 END)"""


def _candidates(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Parsed questions, their vectors, and their ranked documents."""
    q, docs = asked_questions(s, d), current(s, d)
    vectors = durable(retrieval.question_vectors(q, "item_id", "normalized_text"))
    of = docs.select("document_id", F.col("current_version_id").alias("version_id"))
    some = retrieval.near_cards(vectors.join(q.where(F.size("codes") == 0), "item_id", "left_semi"), evidence_units(s, d), of, "item_id")
    return q, vectors, durable(retrieval.candidate_documents(q, docs, versions.built_aliases(docs), cards(s, d), some, topics=TOPICS))


@query(f"WITH RECURSIVE {_CAND} SELECT item_id, document_id, display_code, score, rk FROM cn")
def question_documents(s: SparkSession, d: str) -> DataFrame:
    return _candidates(s, d)[2]


_SCOPE = f"""{_CAND}, sv AS (SELECT item_id AS qid, version_id FROM (SELECT cn.item_id, current_version_id AS version_id, row_number() OVER (PARTITION BY cn.item_id ORDER BY rk) AS k, cn.item_id IN (SELECT item_id FROM vq) AS ex FROM cn JOIN cur USING (document_id) WHERE current_version_id IS NOT NULL) WHERE NOT ex OR k = 1),
lo AS (SELECT DISTINCT item_id AS qid, x AS wanted FROM (SELECT item_id, unnest(list_transform(regexp_extract_all(q, '{_RX['num']}', 1), lambda z: {_LOCN('z')}) || list_transform(regexp_extract_all(q, '{_RX['app']}', 1), lambda z: {_LOCN('z')})) AS x FROM nq) WHERE x IS NOT NULL)"""
_LSC = """CASE WHEN wanted = '' OR (coalesce(locator, '') = '' AND NOT contains(lower(coalesce(heading_path, '')), lower(wanted))) THEN 0.0 WHEN locator = wanted THEN 1.06 WHEN starts_with(coalesce(locator, ''), wanted || '.') THEN 0.96
WHEN coalesce(locator, '') <> '' AND starts_with(wanted, locator || '.') THEN 0.90 WHEN contains(lower(coalesce(heading_path, '')), lower(wanted)) THEN 0.82 ELSE 0.0 END"""
_H = "qid, source_kind, score, version_id, hit_id, order_index, locator, heading_path"
_ORD = "score DESC, coalesce(order_index, 0), source_kind, hit_id"
_LH = f"""{_SCOPE}, {_UNITS}, it AS (SELECT 'retrieval_unit' AS kind, version_id, unit_id AS hit_id, start_order_index AS order_index, locator_primary AS locator, heading_path FROM u UNION ALL SELECT 'document_node', version_id, id, order_index, locator_normalized, heading_path FROM nd),
l0 AS (SELECT qid, wanted, kind || CASE WHEN locator = wanted THEN '_locator' ELSE '_locator_context' END AS source_kind, CAST({_LSC} AS DOUBLE) AS score, version_id, hit_id, order_index, locator, heading_path FROM sv JOIN lo USING (qid) JOIN it USING (version_id)),
lh AS (SELECT {_H} FROM (SELECT *, row_number() OVER (PARTITION BY qid, version_id, wanted ORDER BY {_ORD}) AS k FROM l0 WHERE score > 0) WHERE k <= 30)"""


def _asked(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Parsed questions, their vectors, and the versions they are limited to."""
    q, vectors, found = _candidates(s, d)
    of = current(s, d).select("document_id", F.col("current_version_id").alias("version_id"))
    return q, vectors, durable(retrieval.scoped_versions(found, q, of, "item_id").withColumnRenamed("item_id", "qid"))


@query(f"WITH RECURSIVE {_LH} SELECT qid, source_kind, score, hit_id, order_index FROM lh")
def locator_match(s: SparkSession, d: str) -> DataFrame:
    q, _, scope = _asked(s, d)
    wanted = scope.select("qid", "version_id").join(q.select(F.col("item_id").alias("qid"), F.explode("locators").alias("wanted")), "qid")
    return evidence.locator_hits(wanted, retrieval.locator_items(evidence_units(s, d), evidence_nodes(s, d)), "qid").select("qid", "source_kind", "score", "hit_id", "order_index")


@query(f"WITH {_NODES}, a AS (SELECT DISTINCT version_id, order_index AS anchor_order FROM nd) SELECT a.version_id, anchor_order, nd.order_index, nd.id, CAST(CASE WHEN nd.order_index = anchor_order THEN 1.0 ELSE 0.8 END AS DOUBLE) AS score FROM a JOIN nd ON nd.version_id = a.version_id AND nd.order_index BETWEEN anchor_order - 2 AND anchor_order + 2")
def neighbor_expand(s: SparkSession, d: str) -> DataFrame:
    n = nodes(s, d, "version_id", "order_index")
    anchors = n.select("version_id", "order_index").distinct()
    return relational.neighbours(anchors, n.select("version_id", "order_index", "id")).select("version_id", "anchor_order", "order_index", "id", "score")


@query(f"WITH {_NODES} SELECT 'document_node' AS source_kind, CAST(1.0 AS DOUBLE) AS score, nd.version_id, id AS hit_id, order_index, locator_normalized AS locator, heading_path FROM nd WHERE id IN (SELECT source_node_id FROM document_references)")
def read_node(s: SparkSession, d: str) -> DataFrame:
    """The nodes that references come from, read by their ids."""
    return retrieval.read_nodes(table(s, d, "document_references").select(F.col("source_node_id").alias("id")), evidence_nodes(s, d))


@query(f"WITH {_NODES}, {_UNITS} SELECT nd.id, u.unit_id FROM nd JOIN u ON u.version_id = nd.version_id AND nd.order_index BETWEEN u.start_order_index AND u.end_order_index")
def enclosing_blocks(s: SparkSession, d: str) -> DataFrame:
    points = nodes(s, d, "version_id", "order_index")
    ranges = units(s, d, "version_id", "start_order_index", "end_order_index").where("start_order_index is not null and end_order_index >= start_order_index").select("version_id", "unit_id", F.col("start_order_index").alias("start_order"), F.col("end_order_index").alias("end_order"))
    return relational.enclosing(points, ranges).select("id", "unit_id")


_WORDS = f"""pl AS (SELECT 'retrieval_unit_lexical' AS source_kind, version_id, unit_id AS hit_id, start_order_index AS order_index, locator_primary AS locator, heading_path, text FROM u UNION ALL SELECT 'document_node', version_id, id, order_index, locator_normalized, heading_path, text FROM nd WHERE version_id NOT IN (SELECT version_id FROM u WHERE version_id IS NOT NULL) OR version_id IS NULL),
qd AS (SELECT item_id AS qid, list_distinct({sql.tokens('q')}) AS tk FROM nq), w0 AS (SELECT qid, source_kind, round_even(len(list_intersect(tk, {sql.tokens('text')})) / len(tk), 4) AS score, version_id, hit_id, order_index, locator, heading_path FROM sv JOIN qd USING (qid) JOIN pl USING (version_id) WHERE len(tk) > 0),
lx AS (SELECT {_H} FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, source_kind, hit_id) AS k FROM w0 WHERE score > 0) WHERE k <= 30)"""
_DENSE = f"""d0 AS (SELECT qid, 'retrieval_unit_dense' AS source_kind, round_even(greatest(0.0, {_COSV}), 4) AS score, version_id, unit_id AS hit_id, start_order_index AS order_index, locator_primary AS locator, heading_path FROM sv JOIN (SELECT item_id AS qid, v FROM qv) USING (qid) JOIN fu USING (version_id) WHERE unit_type = 'semantic_block'),
dn AS (SELECT {_H} FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, hit_id) AS k FROM d0) WHERE k <= 30)"""


@query(f"WITH RECURSIVE {_SCOPE}, {_DENSE} SELECT qid, hit_id, score FROM dn")
def semantic_search(s: SparkSession, d: str) -> DataFrame:
    _, vectors, scope = _asked(s, d)
    return retrieval.semantic_hits(scope, vectors.withColumnRenamed("item_id", "qid"), evidence_units(s, d), "qid", ["semantic_block"]).select("qid", "hit_id", "score")


_BON = " ".join(f"WHEN '{k}' THEN {v}" for k, v in evidence.KIND_BONUS.items())


def _merge_sql(source: str, out: str) -> str:
    return f"""{out} AS (WITH a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, source_kind, hit_id ORDER BY score DESC, coalesce(order_index, 0)) AS k1 FROM {source}) WHERE k1 = 1), b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY {_ORD}) AS k2 FROM a) WHERE k2 <= 36),
c AS (SELECT *, round_even(CAST(score + CASE source_kind {_BON} ELSE 0.0 END + CASE WHEN coalesce(locator, '') <> '' AND qid IN (SELECT qid FROM lo) THEN 0.05 ELSE 0.0 END AS DOUBLE), 4) AS lifted FROM b), e AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY lifted DESC, coalesce(order_index, 0), source_kind, hit_id) AS k3 FROM c) WHERE k3 <= 16)
SELECT {_H}, CAST(row_number() OVER (PARTITION BY qid ORDER BY {_ORD}) AS INT) AS rk FROM e)"""


def _all_hits(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Parsed questions as qid, and all their hits."""
    q, vectors, scope = _asked(s, d)
    q = q.withColumnRenamed("item_id", "qid")
    return q, durable(retrieval.question_hits(q, scope, evidence_units(s, d), evidence_nodes(s, d), vectors.withColumnRenamed("item_id", "qid"), "qid"))


_AH = f"{_LH}, {_WORDS}, {_DENSE}, ah AS (SELECT * FROM lh UNION ALL SELECT * FROM lx UNION ALL SELECT * FROM dn)"


@query(f"WITH RECURSIVE {_AH}, {_merge_sql('ah', 'mg')} SELECT qid, rk, source_kind, hit_id, score FROM mg")
def merge_hits(s: SparkSession, d: str) -> DataFrame:
    q, hits = _all_hits(s, d)
    return evidence.merged(hits, "qid", q.where(F.size("locators") > 0)).select("qid", "rk", "source_kind", "hit_id", "score")


_PACK = f"""{_AH}, {_merge_sql('ah', 'mg')}, sd AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rk) AS k FROM mg WHERE starts_with(source_kind, 'document_node') AND order_index IS NOT NULL) WHERE k <= 4),
cx AS (SELECT qid, 'retrieval_unit_context' AS source_kind, max(round_even(CAST(least(1.1, sd.score + 0.12) AS DOUBLE), 4)) AS score, sd.version_id, unit_id AS hit_id, start_order_index AS order_index, locator_primary AS locator, u.heading_path FROM sd JOIN u ON u.version_id = sd.version_id AND sd.order_index BETWEEN start_order_index AND end_order_index GROUP BY qid, sd.version_id, unit_id, start_order_index, locator_primary, u.heading_path),
nb AS (SELECT qid, 'document_node' AS source_kind, max(CASE WHEN nd.order_index = sd.order_index THEN 1.0 ELSE 0.8 END) AS score, sd.version_id, nd.id AS hit_id, nd.order_index AS order_index, nd.locator_normalized AS locator, nd.heading_path FROM sd JOIN nd ON nd.version_id = sd.version_id AND nd.order_index BETWEEN sd.order_index - 2 AND sd.order_index + 2 GROUP BY qid, sd.version_id, nd.id, nd.order_index, nd.locator_normalized, nd.heading_path),
a2 AS (SELECT {_H} FROM mg UNION ALL SELECT * FROM cx UNION ALL SELECT * FROM nb), {_merge_sql('a2', 'm2')}, pk AS (SELECT * FROM m2 WHERE rk <= 8)"""


def _pack(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Parsed questions and their evidence packs."""
    q, hits = _all_hits(s, d)
    u = evidence_units(s, d).where("start_order_index is not null and end_order_index >= start_order_index")
    ranges = u.select("version_id", F.col("unit_id").alias("hit_id"), F.col("start_order_index").alias("start_order"), F.col("end_order_index").alias("end_order"), F.col("start_order_index").alias("order_index"), F.col("locator_primary").alias("locator"), "heading_path")
    around = evidence_nodes(s, d).select("version_id", F.col("id").alias("hit_id"), "order_index", F.col("locator_normalized").alias("locator"), "heading_path")
    return q, durable(evidence.evidence_pack(hits, "qid", ranges, around, q.where(F.size("locators") > 0)))


@query(f"WITH RECURSIVE {_PACK} SELECT qid, rk, source_kind, hit_id, score, 'ev-' || lpad(CAST(rk AS VARCHAR), 4, '0') AS evidence_id FROM pk")
def evidence_pack(s: SparkSession, d: str) -> DataFrame:
    return _pack(s, d)[1].select("qid", "rk", "source_kind", "hit_id", "score", "evidence_id")


_QUAL = f"""{_PACK}, jq AS (SELECT pk.*, document_id, starts_with(source_kind, 'retrieval_unit') AS iu, coalesce(locator, '') <> '' AS hl, coalesce(heading_path, '') <> '' AS hh FROM pk LEFT JOIN vd USING (version_id)),
pr AS (SELECT qid, document_id, count(*) AS n, count(*) FILTER (WHERE iu) AS u, bool_or(hl) AS l, sum(CASE WHEN iu THEN 4 ELSE 1 END + CAST(hl AS INT) + CAST(hh AS INT)) AS q FROM jq GROUP BY 1, 2),
ql AS (SELECT qid, CAST(sum(n) AS BIGINT) AS n_items, CAST(sum(u) AS BIGINT) AS n_units, count(document_id) AS n_documents, max(n) AS dominant, bool_or(l) AS has_locator, CAST(sum(q) AS BIGINT) AS quality FROM pr GROUP BY 1)"""


def _quality(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = current(s, d).where("current_version_id is not null").groupBy(F.col("current_version_id").alias("version_id")).agg(F.min("document_id").alias("document_id"))
    q, pack = _pack(s, d)
    return q, evidence.evidence_quality(pack, "qid", docs)


@query(f"WITH RECURSIVE {_QUAL} SELECT * FROM ql")
def evidence_quality(s: SparkSession, d: str) -> DataFrame:
    return _quality(s, d)[1]


@query(f"""WITH RECURSIVE {_QUAL}, qx AS (SELECT item_id AS qid, item_id IN (SELECT item_id FROM vq) AS ed, item_id IN (SELECT qid FROM lo) AS el, len({sql.tokens('q')}) AS nt FROM nq), f AS (SELECT *, (n_documents = 1 AND (n_units >= 2 OR (n_units >= 1 AND (has_locator OR dominant >= 3 OR n_items >= 4)))) OR (n_documents <= 2 AND n_units >= 2 AND dominant >= 3 AND (has_locator OR ed OR n_items >= 4)) AS strong FROM ql JOIN qx USING (qid))
SELECT qid, CASE WHEN NOT ed AND NOT el AND nt <= 4 AND n_documents >= 2 AND dominant < 2 AND NOT has_locator THEN 'clarify' WHEN strong THEN 'direct' ELSE 'partial' END AS suggested_mode FROM f""")
def answer_mode(s: SparkSession, d: str) -> DataFrame:
    q, quality = _quality(s, d)
    told = quality.join(q.select("qid", (F.size("codes") > 0).alias("_d"), (F.size("locators") > 0).alias("_l"), F.size("tokens").alias("_n")), "qid")
    return evidence.suggested_mode(told, F.lit("no_answer"), F.col("_d"), F.col("_l"), F.col("_n")).select("qid", "suggested_mode")


# -- metrics ---------------------------------------------------------------------------------------------------------------

_WIDE = f"""{_CUR}, bt AS (SELECT version_id AS v, bool_or(length(trim(coalesce(text, ''), ' ')) > 0) AS tx, bool_or(coalesce(node_type <> 'paragraph', false)) AS tr, min(parse_confidence) AS pc FROM document_nodes WHERE version_id IS NOT NULL GROUP BY 1), ix AS (SELECT DISTINCT version_id AS v FROM retrieval_units), pf AS (SELECT DISTINCT version_id AS v FROM pdf_texts), oc AS (SELECT DISTINCT version_id AS v FROM ocr_pages), sc AS (SELECT DISTINCT document_id FROM document_cards WHERE document_id IS NOT NULL),
wd AS (SELECT lower(trim(status_normalized, ' ')) AS status, current_version_id IS NOT NULL AS hv, sc.document_id IS NOT NULL AS hs, pf.v IS NOT NULL OR oc.v IS NOT NULL AS hr, coalesce(tx, false) AS ht, oc.v IS NOT NULL AS ho, pc, CASE WHEN ix.v IS NOT NULL THEN 'indexed' WHEN tr THEN 'normalized' ELSE 'created' END AS ps FROM cur LEFT JOIN bt ON bt.v = current_version_id LEFT JOIN ix ON ix.v = current_version_id LEFT JOIN pf ON pf.v = current_version_id LEFT JOIN oc ON oc.v = current_version_id LEFT JOIN sc USING (document_id))"""
_JOBS = "jb AS (SELECT CASE event_id % 3 WHEN 0 THEN 'parse_list_page' WHEN 1 THEN 'process_document_card' ELSE 'other' END AS jt, event_type = 'purchase' AS done, CASE WHEN event_id % 7 = 0 THEN '' ELSE 'u' || (user_id % 500) END AS url FROM events), up AS (SELECT CASE event_type WHEN 'click' THEN 'refresh_completed' WHEN 'view' THEN 'skipped_duplicate' WHEN 'signup' THEN 'refresh_failed' ELSE 'other' END AS us FROM events)"
_COUNTED = {
    "documents_total": "count(*)", "documents_active": "count(*) FILTER (WHERE a)", "documents_inactive": "count(*) FILTER (WHERE x)", "documents_unknown": "count(*) FILTER (WHERE NOT a AND NOT x)", "documents_with_raw_artifacts": "count(*) FILTER (WHERE hr)", "documents_with_extracted_text": "count(*) FILTER (WHERE ht)", "documents_with_ocr": "count(*) FILTER (WHERE ho)",
    "documents_with_low_confidence_parse": "count(*) FILTER (WHERE pc < 0.7)", "documents_structured": "count(*) FILTER (WHERE ps IN ('normalized', 'indexed'))", "documents_indexed": "count(*) FILTER (WHERE ps = 'indexed')", "active_index_documents_total": "count(*) FILTER (WHERE ps = 'indexed')", "active_index_documents_with_correct_status": "count(*) FILTER (WHERE a AND ps = 'indexed')", "inactive_documents_in_active_index": "count(*) FILTER (WHERE x AND ps = 'indexed')",
    "active_documents_without_active_version": "count(*) FILTER (WHERE a AND NOT hv)", "active_versions_without_text_source": "count(*) FILTER (WHERE a AND hv AND NOT ht)", "list_pages_processed_successfully": "(SELECT count(DISTINCT url) FROM jb WHERE jt = 'parse_list_page' AND url <> '' AND done)", "list_pages_total": "(SELECT count(DISTINCT url) FROM jb WHERE jt = 'parse_list_page' AND url <> '')", "document_cards_discovered": "(SELECT count(DISTINCT url) FROM jb WHERE jt = 'process_document_card' AND url <> '')",
    "updates_detected": "(SELECT count(*) FROM up WHERE us <> 'other')", "updates_successful": "(SELECT count(*) FROM up WHERE us IN ('refresh_completed', 'skipped_duplicate'))", "updates_failed": "(SELECT count(*) FROM up WHERE us = 'refresh_failed')",
}
_SHARES = {"active_documents_reaching_card_rate": "a AND hs", "active_documents_with_raw_rate": "a AND hr", "active_documents_with_text_rate": "a AND ht", "active_documents_structured_rate": "a AND ps IN ('normalized', 'indexed')"}
_RATED = {k: f"CASE WHEN count(*) FILTER (WHERE a) <= 0 THEN 1.0 ELSE round_even(count(*) FILTER (WHERE {c}) / count(*) FILTER (WHERE a), 6) END" for k, c in _SHARES.items()}
_RATED["active_index_documents_with_correct_status_rate"] = "CASE WHEN count(*) FILTER (WHERE ps = 'indexed') <= 0 THEN 1.0 ELSE round_even(count(*) FILTER (WHERE a AND ps = 'indexed') / count(*) FILTER (WHERE ps = 'indexed'), 6) END"
_RATED["list_pages_success_rate"] = f"CASE WHEN {_COUNTED['list_pages_total']} <= 0 THEN 1.0 ELSE round_even({_COUNTED['list_pages_processed_successfully']} / {_COUNTED['list_pages_total']}, 6) END"
_PANEL = f"{_WIDE}, {_JOBS}, wx AS (SELECT *, coalesce(status = 'active', false) AS a, coalesce(status = 'inactive', false) AS x FROM wd), mt AS (" + " UNION ALL ".join(f"SELECT '{k}' AS metric, CAST({v} AS DOUBLE) AS value{'' if 'FROM jb' in v or 'FROM up' in v else ' FROM wx'}" for k, v in {**_COUNTED, **_RATED}.items()) + ")"


def _panel(s: SparkSession, d: str) -> DataFrame:
    has = lambda name, flag: table(s, d, name).where("version_id is not null").select(F.col("version_id").alias("current_version_id")).distinct().withColumn(flag, F.lit(True))
    built = table(s, d, "document_nodes").where("version_id is not null").groupBy(F.col("version_id").alias("current_version_id")).agg(F.bool_or(F.length(F.trim(F.coalesce("text", F.lit("")))) > 0).alias("has_text"), F.bool_or(F.coalesce(F.col("node_type") != "paragraph", F.lit(False))).alias("_tree"), F.min("parse_confidence").alias("parse_confidence"))
    sourced = table(s, d, "document_cards").where("document_id is not null").select("document_id").distinct().withColumn("has_source", F.lit(True))
    docs = current(s, d).join(built, "current_version_id", "left").join(has("retrieval_units", "_indexed"), "current_version_id", "left").join(has("pdf_texts", "_pdf"), "current_version_id", "left").join(has("ocr_pages", "has_ocr"), "current_version_id", "left").join(sourced, "document_id", "left")
    version = F.col("current_version_id").isNotNull()
    wide = docs.select(F.lower(F.trim("status_normalized")).alias("status"), version.alias("has_version"), version.alias("version_is_active"), "has_source", (F.coalesce("_pdf", F.lit(False)) | F.coalesce("has_ocr", F.lit(False))).alias("has_raw"), "has_text", "has_ocr", "parse_confidence", F.when(F.col("_indexed"), "indexed").when(F.col("_tree"), "normalized").otherwise("created").alias("processing_status"))
    e, no = table(s, d, "events"), F.col("event_id") % 3
    url = F.when(F.col("event_id") % 7 == 0, "").otherwise(F.concat(F.lit("u"), (F.col("user_id") % 500).cast("string")))
    payload = F.to_json(F.struct(F.when(no == 0, url).alias("list_page_url"), F.when(no == 1, url).alias("card_url")))
    jobs = e.select(F.when(no == 0, "parse_list_page").when(no == 1, "process_document_card").otherwise("other").alias("job_type"), F.when(F.col("event_type") == "purchase", "completed").otherwise("pending").alias("status"), payload.alias("payload"))
    updates = e.select(F.when(F.col("event_type") == "click", "refresh_completed").when(F.col("event_type") == "view", "skipped_duplicate").when(F.col("event_type") == "signup", "refresh_failed").otherwise("other").alias("status"))
    return metrics.ingestion_panel(wide, jobs, updates)


@query(f"WITH {_PANEL} SELECT metric, value FROM mt")
def ingestion_metrics(s: SparkSession, d: str) -> DataFrame:
    return metrics.unpivoted(_panel(s, d))


_TG = " ".join(f"WHEN '{k}' THEN {v}" for k, v in metrics.TARGETS.items())
_CMP = f"cp AS (SELECT metric, value AS actual, CAST(CASE metric {_TG} END AS DOUBLE) AS target, CASE WHEN starts_with(metric, 'inactive') THEN value <= CASE metric {_TG} END ELSE value >= CASE metric {_TG} END END AS passed FROM mt WHERE CASE metric {_TG} END IS NOT NULL)"


@query(f"WITH {_PANEL}, {_CMP} SELECT * FROM cp UNION ALL SELECT 'all', NULL, NULL, bool_and(passed) FROM cp")
def mvp_compare(s: SparkSession, d: str) -> DataFrame:
    return metrics.compared(metrics.unpivoted(_panel(s, d)))


_V = lambda k: f"(SELECT value FROM mt WHERE metric = '{k}')"


@query(f"""WITH {_PANEL}, {_CMP}, ck AS (SELECT 'metrics_target_comparison_passed' AS "check", bool_and(passed) AS passed FROM cp UNION ALL SELECT 'limited_sample_run_passed', {_V('list_pages_total')} > 0 AND {_V('documents_total')} > 0 AND {_V('documents_indexed')} > 0 AND {_V('documents_with_extracted_text')} > 0
UNION ALL SELECT 'inactive_documents_excluded_from_active_index', {_V('inactive_documents_in_active_index')} = 0 UNION ALL SELECT 'active_documents_have_active_version', {_V('active_documents_without_active_version')} = 0 UNION ALL SELECT 'active_versions_have_text_or_ocr', {_V('active_versions_without_text_source')} = 0)
SELECT * FROM ck UNION ALL SELECT 'report_generated', true UNION ALL SELECT 'ready', bool_and(passed) FROM ck""")
def readiness(s: SparkSession, d: str) -> DataFrame:
    return metrics.readiness(_panel(s, d))


# the evaluation of the asked questions: what their packs hold against the document and locator that they name
_MODE = f"mo AS (SELECT qid, CASE WHEN NOT ed AND NOT el AND nt <= 4 AND n_documents >= 2 AND dominant < 2 AND NOT has_locator THEN 'clarify' WHEN strong THEN 'direct' ELSE 'partial' END AS mode FROM f)"
_STRONG = f"qx AS (SELECT item_id AS qid, item_id IN (SELECT item_id FROM vq) AS ed, item_id IN (SELECT qid FROM lo) AS el, len({sql.tokens('q')}) AS nt FROM nq), f AS (SELECT *, (n_documents = 1 AND (n_units >= 2 OR (n_units >= 1 AND (has_locator OR dominant >= 3 OR n_items >= 4)))) OR (n_documents <= 2 AND n_units >= 2 AND dominant >= 3 AND (has_locator OR ed OR n_items >= 4)) AS strong FROM ql JOIN qx USING (qid))"
_SCOREF = lambda x: f"regexp_replace(lower({_SQ(x)}), '[.\\-/][0-9]{{4}}$', '')"
_EVAL = f"""{_QUAL}, {_STRONG}, {_MODE}, gd AS (SELECT document_id AS qid, 'named' AS scenario, display_code AS gold FROM cur WHERE display_code IS NOT NULL UNION ALL SELECT 'E' || item_id, scenario, NULL FROM eval_passages), pd AS (SELECT qid, rk, lower({_SQ('display_code')}) AS dk, nullif(lower({_SQ("coalesce(locator, '')")}), '') AS lk FROM jq JOIN (SELECT document_id, display_code FROM cur) USING (document_id)),
fd AS (SELECT qid, dk FROM (SELECT qid, dk, row_number() OVER (PARTITION BY qid ORDER BY min(rk), dk) AS k FROM pd WHERE dk <> '' GROUP BY qid, dk) WHERE k <= 3), fl AS (SELECT qid, lk FROM (SELECT qid, lk, row_number() OVER (PARTITION BY qid ORDER BY min(rk), lk) AS k FROM (SELECT qid, rk, nullif(lower({_SQ("coalesce(locator, '')")}), '') AS lk FROM pk) WHERE lk IS NOT NULL GROUP BY qid, lk) WHERE k <= 5),
ev AS (SELECT qid, scenario, CASE WHEN gold IS NULL THEN true ELSE EXISTS (SELECT 1 FROM fd WHERE fd.qid = gd.qid AND regexp_replace(dk, '[.\\-/][0-9]{{4}}$', '') = {_SCOREF('gold')}) END AS document_hit, CASE WHEN qid IN (SELECT qid FROM lo) THEN EXISTS (SELECT 1 FROM fl JOIN lo ON lo.qid = fl.qid AND lo.wanted = fl.lk WHERE fl.qid = gd.qid) END AS locator_hit,
coalesce(mode, 'no_answer') IN ('clarify', 'direct', 'partial') AS grounded, coalesce(mode, '') = 'partial' AS partial, coalesce(mode, 'no_answer') = CASE WHEN gold IS NULL THEN 'partial' ELSE 'direct' END AS mode_match, CASE WHEN gold IS NULL THEN false ELSE EXISTS (SELECT 1 FROM fd WHERE fd.qid = gd.qid AND regexp_replace(dk, '[.\\-/][0-9]{{4}}$', '') <> {_SCOREF('gold')}) END AS forbidden FROM gd LEFT JOIN mo USING (qid))"""
_AVG = ", ".join(f"coalesce(round_even(avg(CAST({c} AS INT)), 4), 0.0) AS {name}" for c, name in metrics.RATES.items() if c != "unsupported") + ", CAST(0 AS DOUBLE) AS unsupported_claim_rate"


def _evaluated(s: SparkSession, d: str) -> DataFrame:
    q, pack = _pack(s, d)
    docs = current(s, d)
    of = docs.where("current_version_id is not null").groupBy(F.col("current_version_id").alias("version_id")).agg(F.min("document_id").alias("document_id"))
    told = evidence.evidence_quality(pack, "qid", of).join(q.select("qid", (F.size("codes") > 0).alias("_d"), (F.size("locators") > 0).alias("_l"), F.size("tokens").alias("_n")), "qid")
    mode = evidence.suggested_mode(told, F.lit("no_answer"), F.col("_d"), F.col("_l"), F.col("_n")).select("qid", F.col("suggested_mode").alias("mode"))
    gold = docs.where("display_code is not null").select(F.col("document_id").alias("qid"), F.lit("named").alias("scenario"), F.col("display_code").alias("gold")).unionByName(table(s, d, "eval_passages").select(F.concat(F.lit("E"), F.col("item_id").cast("string")).alias("qid"), "scenario", F.lit(None).cast("string").alias("gold")))
    named = metrics.first_unique(pack.join(of, "version_id").join(docs.select("document_id", "display_code"), "document_id"), "qid", "display_code", "rk", 3)
    placed = metrics.first_unique(pack, "qid", "locator", "rk", 5)
    kin = named.join(gold.where("gold is not null").select("qid", scoring_family(F.col("gold")).alias("_f")), "qid").groupBy("qid").agg(F.bool_or(scoring_family(F.col("key")) == F.col("_f")).alias("_hit"), F.bool_or(scoring_family(F.col("key")) != F.col("_f")).alias("_other"))
    wanted = q.select("qid", F.explode("locators").alias("key"))
    at = wanted.join(placed, ["qid", "key"], "left").groupBy("qid").agg((F.count("place") > 0).alias("locator_hit"))
    j = gold.join(mode, "qid", "left").join(kin, "qid", "left").join(at, "qid", "left")
    m, open_ = F.coalesce("mode", F.lit("no_answer")), F.col("gold").isNull()
    return j.select("scenario", (open_ | F.coalesce("_hit", F.lit(False))).alias("document_hit"), "locator_hit", m.isin("clarify", "direct", "partial").alias("grounded"), F.lit(False).alias("unsupported"), (m == "partial").alias("partial"), (m == F.when(open_, "partial").otherwise("direct")).alias("mode_match"), (~open_ & F.coalesce("_other", F.lit(False))).alias("forbidden"))


@query(f"WITH RECURSIVE {_EVAL} SELECT scenario, count(*) AS n, {_AVG} FROM ev GROUP BY 1 UNION ALL SELECT 'all', count(*), {_AVG} FROM ev")
def eval_report(s: SparkSession, d: str) -> DataFrame:
    return metrics.evaluation_report(_evaluated(s, d))


@query("SELECT item_id, question FROM eval_passages WHERE scenario = 'edition' ORDER BY item_id LIMIT 20")
def eval_selection(s: SparkSession, d: str) -> DataFrame:
    return metrics.selected_questions(table(s, d, "eval_passages"), "item_id", "edition", 20).select("item_id", "question")


@query(f"""WITH {_CUR}, {_RES}, fd AS (SELECT item_id, display_code AS code, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, document_id) AS rk FROM res JOIN cur USING (document_id)), gd AS (SELECT DISTINCT item_id, entry_text AS code FROM eval_passages JOIN canonical_entries ON entry_id = item_id),
f3 AS (SELECT * FROM (SELECT item_id, code, row_number() OVER (PARTITION BY item_id ORDER BY pos, code) AS k FROM (SELECT item_id, code, min(rk) AS pos FROM fd GROUP BY 1, 2)) WHERE k <= 3)
SELECT g.item_id, EXISTS (SELECT 1 FROM f3 WHERE f3.item_id = g.item_id AND f3.code = g.code) AS hit, EXISTS (SELECT 1 FROM f3 WHERE f3.item_id = g.item_id AND regexp_replace(lower({_SQ('f3.code')}), '[.\\-/][0-9]{{4}}$', '') = regexp_replace(lower({_SQ('g.code')}), '[.\\-/][0-9]{{4}}$', '')) AS family_hit FROM gd g""")
def eval_scores(s: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc("document_id"))
    found = _resolved(s, d).join(current(s, d).select("document_id", F.col("display_code").alias("code")), "document_id").withColumn("rk", F.row_number().over(w))
    gold = table(s, d, "eval_passages").select("item_id").join(table(s, d, "canonical_entries").select(F.col("entry_id").alias("item_id"), F.col("entry_text").alias("code")), "item_id").distinct()
    return metrics.scored_results(found, gold, "item_id")


@query(f"""WITH u AS (SELECT DISTINCT unit_id, text, embedding IS NULL AS p FROM retrieval_units WHERE unit_id IS NOT NULL) SELECT *, pending * 64 * 4 AS bytes, round_even(tokens * 0.15 / 1e6, 4) AS cost, CASE WHEN pending <= 0 THEN 0.0 ELSE round_even(characters / pending, 4) END AS average_chars FROM
(SELECT count(*) AS total, count(*) FILTER (WHERE p) AS pending, CAST(coalesce(sum(CASE WHEN p THEN greatest(1, ceil(length(coalesce(text, '')) / 4.0)) END), 0) AS BIGINT) AS tokens, CAST(coalesce(sum(CASE WHEN p THEN length(coalesce(text, '')) END), 0) AS BIGINT) AS characters FROM u)""")
def embedding_preflight(s: SparkSession, d: str) -> DataFrame:
    # vectors aren't moved: only whether there is one
    rows = table(s, d, "retrieval_units").select("unit_id", "text", F.when(F.col("embedding").isNotNull(), F.lit(True)).alias("embedding"))
    return metrics.embedding_workload(relational.unique(rows, "unit_id", "text", "embedding"), "text", "embedding", 64)


_WK = "wk AS (SELECT user_id, CASE max(event_id) % 3 WHEN 0 THEN 'completed' WHEN 1 THEN 'running' ELSE 'queued' END AS status, count(*) AS processed, max(event_id) AS remaining FROM events GROUP BY 1)"


@query(f"WITH {_WK} SELECT CASE WHEN bool_or(status = 'failed') THEN 'failed' WHEN bool_or(status IN ('running','queued')) THEN 'running' WHEN bool_and(status = 'completed') THEN 'completed' ELSE 'unknown' END AS status, CAST(sum(processed) AS BIGINT) AS processed, min(remaining) AS remaining FROM wk")
def worker_rollup(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events").groupBy("user_id").agg(F.max("event_id").alias("remaining"), F.count(F.lit(1)).alias("processed"))
    return metrics.worker_rollup(e.withColumn("status", F.when(F.col("remaining") % 3 == 0, "completed").when(F.col("remaining") % 3 == 1, "running").otherwise("queued")))


@query("SELECT event_type, count(value) AS count, round_even(sum(value), 4) AS sum FROM events GROUP BY 1")
def histogram(s: SparkSession, d: str) -> DataFrame:
    return metrics.histogram(table(s, d, "events"), ["event_type"], "value")


@query(f"""WITH {_CUR} SELECT DISTINCT document_id, alias_raw FROM {_code_alias_sql('display_code')}""")
def code_alias_variants(s: SparkSession, d: str) -> DataFrame:
    return current(s, d).select("document_id", F.explode(code_aliases(F.col("display_code"))).alias("alias_raw")).distinct()
