"""Queries on derived tables, their rebuild and their listings, with their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docustrata.functions import text
from docustrata.operators import answers, metrics, pipeline, relational, retrieval, versions
from docustrata.plans import corpus_queries as corpus
from docustrata.plans import sql
from docustrata.sources import artifacts
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


_CUR, _NODES, _SQ = corpus._CUR, corpus._NODES, sql.squeeze
_BLOCKS = corpus._BLOCKS.replace(_NODES + ", ", "")


@query(f"""WITH RECURSIVE {corpus._CARDS}, {_BLOCKS}, bk AS (SELECT version_id, min(order_index) AS a, max(order_index) AS z, string_agg(rendered, chr(10) ORDER BY order_index, id) AS t FROM bl JOIN sq USING (version_id, i) WHERE version_id IN (SELECT current_version_id FROM cur) GROUP BY version_id, own),
du AS (SELECT version_id, 'semantic_block' AS unit_type, a, z, t FROM bk UNION ALL SELECT current_version_id, 'document_card', NULL, NULL, card_text FROM card JOIN cur USING (document_id) WHERE current_version_id IS NOT NULL)
SELECT version_id, unit_type, sha256(concat_ws('|', version_id, unit_type, concat_ws(',', a, z), {_SQ('t')})) AS chunk_hash FROM du""")
def derived_units(s: SparkSession, d: str) -> DataFrame:
    return pipeline.derived_units(corpus.current(s, d), table(s, d, "document_nodes"), table(s, d, "document_aliases")).select("version_id", "unit_type", "chunk_hash")


@query(f"""WITH {_CUR}, {_NODES}, kv AS (SELECT DISTINCT document_id, current_version_id AS version_id FROM document_registry WHERE current_version_id IS NOT NULL), sz AS (SELECT version_id, count(*) AS n, count(*) FILTER (WHERE len({sql.tokens('text')}) > 0) AS f FROM nd GROUP BY 1),
j AS (SELECT kv.version_id = current_version_id AS a, n, f FROM kv JOIN (SELECT document_id, current_version_id FROM cur) USING (document_id) LEFT JOIN sz USING (version_id))
SELECT (SELECT count(*) FROM cur) AS documents_processed, (SELECT count(current_version_id) FROM cur) AS indexed_documents, CAST(coalesce(sum(CASE WHEN a THEN n END), 0) AS BIGINT) AS indexed_node_count, CAST(coalesce(sum(CASE WHEN NOT a THEN f END), 0) AS BIGINT) AS cleared_node_count FROM j""")
def reindex_counts(s: SparkSession, d: str) -> DataFrame:
    known = table(s, d, "document_registry").select("document_id", F.col("current_version_id").alias("version_id"))
    return pipeline.reindexed(corpus.current(s, d), known, corpus.nodes(s, d, "version_id", "text"))


@query(f"""WITH {_CUR}, {_NODES} SELECT nd.id, nd.version_id, version_id IN (SELECT current_version_id FROM cur WHERE current_version_id IS NOT NULL) AS indexed, CASE WHEN version_id IN (SELECT current_version_id FROM cur WHERE current_version_id IS NOT NULL) THEN len(list_distinct({sql.tokens('text')})) END AS n_tokens FROM nd""")
def indexed_tokens(s: SparkSession, d: str) -> DataFrame:
    active = corpus.current(s, d).select(F.col("current_version_id").alias("version_id")).where("version_id is not null")
    t = pipeline.indexed_tokens(corpus.nodes(s, d, "version_id", "text"), active)
    return t.select("id", "version_id", F.when(F.col("version_id").isNotNull(), F.col("tokens").isNotNull()).alias("indexed"), F.size(F.when(F.col("tokens").isNotNull(), F.col("tokens"))).alias("n")).select("id", "version_id", "indexed", F.when(F.col("n") >= 0, F.col("n")).alias("n_tokens"))


_DONE = "dn AS (SELECT DISTINCT document_id FROM cur JOIN retrieval_units u ON u.version_id = current_version_id WHERE unit_type = 'document_card')"


@query(f"WITH {_CUR}, {_DONE} SELECT document_id, CAST(CAST('0x' || substr(md5(document_id), 1, 8) AS BIGINT) % 4 AS INT) AS shard FROM cur WHERE document_id NOT IN (SELECT document_id FROM dn)")
def rebuild_parts(s: SparkSession, d: str) -> DataFrame:
    """What each of four workers of a resumed rebuild still has to do: documents without a card unit."""
    docs = corpus.current(s, d)
    cards = table(s, d, "retrieval_units").where("unit_type = 'document_card'").select(F.col("version_id").alias("current_version_id")).distinct()
    done = docs.join(cards, "current_version_id", "left_semi")
    return metrics.union_all([pipeline.pending_part(docs, done, 4, i).select("document_id", F.lit(i).alias("shard")) for i in range(4)])


@query(f"WITH {_CUR}, {_DONE}, nu AS (SELECT DISTINCT unit_id, version_id, 'old' AS origin FROM retrieval_units WHERE unit_id IS NOT NULL) SELECT unit_id, version_id, origin FROM nu WHERE version_id IS NULL OR version_id NOT IN (SELECT current_version_id FROM cur WHERE current_version_id IS NOT NULL) UNION ALL SELECT 'new-' || document_id, current_version_id, 'new' FROM cur WHERE current_version_id IS NOT NULL")
def rebuilt_units(s: SparkSession, d: str) -> DataFrame:
    """The unit table after a rebuild that makes one unit for each current version."""
    docs = corpus.current(s, d).where("current_version_id is not null")
    old = relational.unique(table(s, d, "retrieval_units"), "unit_id", "version_id").withColumn("origin", F.lit("old"))
    new = docs.select(F.concat(F.lit("new-"), "document_id").alias("unit_id"), F.col("current_version_id").alias("version_id"), F.lit("new").alias("origin"))
    return pipeline.rebuilt_units(old, new, docs.select(F.col("current_version_id").alias("version_id")))


@query(f"WITH {_CUR}, {corpus._ALIAS.replace(_CUR + ', ', '')}, cu AS (SELECT document_id FROM cur WHERE CAST(right(document_id, 1) AS INT) % 2 = 0) SELECT DISTINCT document_id, alias_normalized FROM ab JOIN cu USING (document_id) UNION ALL SELECT DISTINCT document_id, alias_normalized FROM document_aliases WHERE document_id IS NOT NULL AND alias_normalized IS NOT NULL AND document_id NOT IN (SELECT document_id FROM cu)")
def rebuilt_aliases(s: SparkSession, d: str) -> DataFrame:
    """The alias table after a rebuild of the documents with an even number: theirs anew, all others as they were."""
    even = corpus.current(s, d).where(F.right("document_id", F.lit(1)).cast("int") % 2 == 0)
    old = table(s, d, "document_aliases").where("document_id is not null and alias_normalized is not null").select("document_id", "alias_normalized", "alias_raw", "alias_type", "confidence")
    return pipeline.rebuilt_aliases(even, old).select("document_id", "alias_normalized").distinct()


@query(f"""WITH pu AS (SELECT DISTINCT unit_id, text FROM retrieval_units WHERE unit_id IS NOT NULL AND embedding IS NULL), t AS (SELECT unit_id, unnest({sql.tokens('text')}) AS token FROM pu), h AS (SELECT unit_id, sha256(token) AS x, count(*) AS n FROM t GROUP BY unit_id, token),
w AS (SELECT unit_id, CAST('0x' || substr(x, 1, 8) AS BIGINT) % 64 AS dim, sum((CASE WHEN CAST('0x' || substr(x, 9, 2) AS BIGINT) % 2 = 0 THEN 1 ELSE -1 END) * (1 + CAST('0x' || substr(x, 11, 2) AS BIGINT) / CAST(255 AS DOUBLE)) * n) AS w FROM h GROUP BY 1, 2), l AS (SELECT unit_id, sqrt(sum(w * w)) AS l FROM w GROUP BY 1)
SELECT unit_id, count(*) FILTER (WHERE abs(w / l) > 1e-9) AS n_filled, round_even(sum(w / l * (dim + 1)), 4) AS weighted FROM w JOIN l USING (unit_id) WHERE l > 0 GROUP BY 1""")
def embedding_backfill(s: SparkSession, d: str) -> DataFrame:
    """Hashed vectors of the units that have none yet: how many numbers are filled, and their sum weighted by place."""
    pending = relational.unique(table(s, d, "retrieval_units").where("embedding is null"), "unit_id", "text")
    v = retrieval.question_vectors(pending, "unit_id", "text")
    weighted = F.aggregate(F.transform("vector", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return v.select("unit_id", F.size(F.filter("vector", lambda x: F.abs(x) > 1e-9)).cast("bigint").alias("n_filled"), F.bround(weighted, 4).alias("weighted"))


@query("SELECT unit_id, version_id, CAST(row_number() OVER (PARTITION BY version_id ORDER BY start_order_index NULLS FIRST, unit_id) AS INT) AS place FROM (SELECT DISTINCT unit_id, version_id, start_order_index FROM retrieval_units WHERE unit_id IS NOT NULL AND version_id IS NOT NULL)")
def unit_listing(s: SparkSession, d: str) -> DataFrame:
    """A version's units in order, those without a place first."""
    u = relational.unique(table(s, d, "retrieval_units").where("version_id is not null"), "unit_id", "version_id", "start_order_index")
    return u.withColumn("place", relational.place_in(["version_id"], [F.asc_nulls_first("start_order_index"), F.asc("unit_id")])).select("unit_id", "version_id", "place")


@query(f"WITH {_CUR}, {corpus._ALIAS.replace(_CUR + ', ', '')} SELECT document_id, alias_type, alias_normalized, CAST(row_number() OVER (PARTITION BY document_id ORDER BY alias_type, alias_normalized) AS INT) AS place FROM ab")
def alias_order(s: SparkSession, d: str) -> DataFrame:
    a = versions.built_aliases(corpus.current(s, d))
    return a.withColumn("place", relational.place_in(["document_id"], [F.asc("alias_type"), F.asc("alias_normalized")])).select("document_id", "alias_type", "alias_normalized", "place")


_CITE = "coalesce(nullif(concat_ws(' | ', nullif(trim(coalesce(display_code, ''), ' '), ''), 'п. ' || nullif(trim(locator, ' '), ''), nullif(trim(heading_path, ' '), '')), ''), '-')"
_LONG = f"{_SQ("coalesce(text, '')")}"


@query(f"""WITH RECURSIVE {corpus._PACK}, tx AS (SELECT unit_id AS hit_id, text FROM u UNION ALL SELECT id, text FROM nd), pj AS (SELECT pk.*, display_code, {_LONG} AS x FROM pk LEFT JOIN vd USING (version_id) LEFT JOIN (SELECT document_id, display_code FROM cur) USING (document_id) LEFT JOIN tx USING (hit_id))
SELECT qid, sha256(string_agg('ev-' || lpad(CAST(rk AS VARCHAR), 4, '0') || ' | citation=' || {_CITE} || ' | source=' || source_kind || ' | text=' || CASE WHEN length(x) <= 900 THEN x ELSE rtrim(substr(x, 1, 897), ' ') || '...' END, chr(10) ORDER BY rk)) AS bundle_hash FROM pj GROUP BY 1""")
def evidence_bundle(s: SparkSession, d: str) -> DataFrame:
    _, pack = corpus._pack(s, d)
    docs = corpus.current(s, d)
    of = docs.where("current_version_id is not null").groupBy(F.col("current_version_id").alias("version_id")).agg(F.min_by("display_code", "document_id").alias("code"))
    texts = corpus.units(s, d, "text").select(F.col("unit_id").alias("hit_id"), "text").unionByName(corpus.nodes(s, d, "text").select(F.col("id").alias("hit_id"), "text"))
    told = pack.join(of, "version_id", "left").join(texts, "hit_id", "left")
    return answers.evidence_bundle(told, "qid").select("qid", F.sha2("bundle", 256).alias("bundle_hash"))


@query(f"WITH {_CUR} SELECT document_id, CASE WHEN CAST(right(document_id, 1) AS INT) % 3 = 0 OR normalized_code IN (SELECT {sql.code('entry_text')} FROM canonical_entries WHERE list_name = 'designation' AND entry_id <= 100) THEN 'delete' ELSE 'keep' END AS action FROM cur")
def corpus_repair(s: SparkSession, d: str) -> DataFrame:
    """Documents of a third made to stubs; they and the first hundred listed codes go."""
    stub = F.right("document_id", F.lit(1)).cast("int") % 3 == 0
    docs = corpus.current(s, d).withColumns({"display_code": F.when(stub, "СП 7.0").otherwise(F.col("display_code")), "title": F.when(stub, "СП 7.0").otherwise(F.col("title"))})
    codes = table(s, d, "canonical_entries").where("list_name = 'designation' and entry_id <= 100").select(F.col("entry_text").alias("code"))
    return pipeline.repaired_corpus(docs, codes)


@query("""WITH c AS (SELECT DISTINCT card_id AS v, CAST(right(card_id, 1) AS INT) AS k FROM document_cards WHERE card_id IS NOT NULL), a AS (SELECT v, 'pdf' AS t, v || '/a.pdf' AS p, 10 + k AS s FROM c UNION ALL SELECT v, 'page', v || '/full.html', 5 FROM c WHERE k % 2 = 0 UNION ALL SELECT v, 'ocr', v || '/ocr.txt', 1 FROM c WHERE k % 3 = 0)
SELECT v AS version_id, t AS artifact_type, p AS relative_path FROM (SELECT *, row_number() OVER (PARTITION BY v ORDER BY t = 'ocr' DESC, contains(p, 'html') DESC, s DESC) AS r FROM a) WHERE r = 1""")
def artifact_choice(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "document_cards").where("card_id is not null").select(F.col("card_id").alias("version_id"), F.right("card_id", F.lit(1)).cast("int").alias("k")).distinct()
    one = lambda kind, name, size: F.struct(F.lit(kind).alias("artifact_type"), F.concat("version_id", F.lit("/" + name)).alias("relative_path"), size.cast("bigint").alias("file_size"))
    made = F.array_compact(F.array(one("pdf", "a.pdf", F.col("k") + 10), F.when(F.col("k") % 2 == 0, one("page", "full.html", F.lit(5))), F.when(F.col("k") % 3 == 0, one("ocr", "ocr.txt", F.lit(1)))))
    return artifacts.best_artifacts(c.select("version_id", F.explode(made).alias("a")).select("version_id", "a.*"))


@query("SELECT event_id, '{\"event_id\":' || event_id || CASE WHEN event_id % 2 = 0 THEN ',\"kind\":\"' || event_type || '\"' ELSE '' END || '}' AS line FROM events")
def log_lines(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "events").select("event_id", text.log_json(event_id=F.col("event_id"), kind=F.when(F.col("event_id") % 2 == 0, F.col("event_type"))).alias("line"))


@query("SELECT 'events{event_type=\"' || event_type || '\"} ' || count(value) AS line FROM events GROUP BY event_type")
def metrics_lines(s: SparkSession, d: str) -> DataFrame:
    h = metrics.histogram(table(s, d, "events"), ["event_type"], "value")
    return metrics.exposition(h, "events", ["event_type"], F.col("count"))


@query(f"""WITH {corpus._UNITS}, {_NODES}, p AS (SELECT DISTINCT unit_id, nd.id, string_split(u.heading_path, ' > ') AS a, string_split(nd.heading_path, ' > ') AS b FROM u JOIN nd ON nd.version_id = u.version_id AND nd.order_index = u.start_order_index WHERE u.heading_path IS NOT NULL AND nd.heading_path IS NOT NULL)
SELECT unit_id, id, array_to_string(a[1:len(list_filter(range(1, least(len(a), len(b)) + 1), lambda i: a[1:i] = b[1:i]))], ' > ') AS common FROM p""")
def common_heading(s: SparkSession, d: str) -> DataFrame:
    u = corpus.units(s, d, "version_id", "start_order_index", "heading_path").withColumnRenamed("start_order_index", "order_index").withColumnRenamed("heading_path", "_h")
    n = corpus.nodes(s, d, "version_id", "order_index", "heading_path")
    j = u.join(n, ["version_id", "order_index"]).where("_h is not null and heading_path is not null")
    return j.select("unit_id", "id", text.common_path(F.col("_h"), F.col("heading_path")).alias("common"))


_FILLER = ["что", "как", "для", "про", "это", "этой", "этому", "этим", "нему", "ней", "ним", "по", "а", "еще", "ещё"]


@query(f"WITH {_CUR}, {corpus._PARSE.replace(corpus._ASK, corpus._ASKED)}, cc AS (SELECT item_id, list(DISTINCT token) AS ct FROM (SELECT item_id, unnest({sql.tokens('v')}) AS token FROM vq) GROUP BY 1) SELECT item_id, len(list_filter({sql.tokens('q')}, lambda t: length(t) > 2 AND t NOT IN ({', '.join(repr(f) for f in _FILLER)}) AND NOT coalesce(list_contains(ct, t), false))) > 0 AS substantial FROM nq LEFT JOIN cc USING (item_id)")
def topic_substance(s: SparkSession, d: str) -> DataFrame:
    return corpus.asked_questions(s, d).select("item_id", retrieval.substantial(F.col("tokens"), F.col("codes"), _FILLER).alias("substantial"))


_STATUS = corpus._ST("coalesce(nullif(" + _SQ("card_status_raw") + ", ''), source_list_status_raw)")
_LASTC = f"cc AS (SELECT DISTINCT card_id, document_id, document_code, document_title, card_status_raw, source_list_status_raw, seen_at FROM document_cards WHERE document_id IS NOT NULL), lc AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY seen_at DESC NULLS LAST, card_id DESC) AS r FROM cc) WHERE r = 1), ac AS (SELECT card_id, document_id, document_code, document_title FROM lc WHERE {_STATUS} = 'active')"


@query(f"WITH {_CUR}, {_LASTC} SELECT document_id, coalesce(nullif({_SQ('document_code')}, ''), display_code) AS display_code, coalesce(nullif({_SQ('document_title')}, ''), title) AS title, CASE WHEN ac.document_id IS NOT NULL THEN 'active' ELSE status_normalized END AS status_normalized FROM cur FULL JOIN ac USING (document_id)")
def persisted_cards(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "document_cards").select("card_id", "document_id", "document_code", "document_title", "card_status_raw", "source_list_status_raw", "seen_at").distinct()
    return pipeline.persisted_cards(c, corpus.current(s, d))[0]


_NEED = "nw AS (SELECT document_id, 'new ' || display_code AS display_code FROM cur WHERE CAST(right(document_id, 1) AS INT) % 2 = 0), fa AS (SELECT document_id FROM cur WHERE CAST(right(document_id, 1) AS INT) % 5 = 0)"


def _refreshed(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Documents with an even number are rebuilt, of which those divisible by 5 fail."""
    docs = corpus.current(s, d).select("document_id", "display_code")
    no = F.right("document_id", F.lit(1)).cast("int")
    return pipeline.refreshed(docs, docs.where(no % 2 == 0).withColumn("display_code", F.concat(F.lit("new "), "display_code")), docs.where(no % 5 == 0).select("document_id"))


@query(f"WITH {_CUR}, {_NEED} SELECT document_id, display_code FROM nw WHERE document_id NOT IN (SELECT document_id FROM fa) UNION ALL SELECT document_id, display_code FROM cur WHERE document_id IN (SELECT document_id FROM fa) OR document_id NOT IN (SELECT document_id FROM nw)")
def refreshed_documents(s: SparkSession, d: str) -> DataFrame:
    return _refreshed(s, d)[0]


@query(f"WITH {_CUR}, {_NEED} SELECT document_id, 'refresh_failed' AS status FROM fa UNION ALL SELECT document_id, 'refresh_completed' FROM nw WHERE document_id NOT IN (SELECT document_id FROM fa)")
def refresh_events(s: SparkSession, d: str) -> DataFrame:
    return _refreshed(s, d)[1]
