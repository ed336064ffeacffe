"""The llm queries; each runs over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docustrata.llm import canonical, leaks, lookalikes, neighbours, pieces, scans, tokens
from docustrata.sources.tables import table

DIMS = 64


def p3_nearest(spark: SparkSession, folder: str) -> DataFrame:
    """The 5 most similar embeddings of every usable one: table_name, id, neighbour_id, rank, similarity."""
    named = [("document_nodes", "id"), ("retrieval_units", "unit_id")]
    return neighbours.nearest([(n, table(spark, folder, n).select(key, "embedding"), key, "embedding") for n, key in named], DIMS)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of which one is among the 5 nearest of the other."""
    return neighbours.neighbour_pairs(p3_nearest(spark, folder))


def p4_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """All pieces of all long texts."""
    nodes = pieces.split_texts(table(spark, folder, "document_nodes").select("id", "text"), "id", "text")
    units = pieces.split_texts(table(spark, folder, "retrieval_units").select("unit_id", "text"), "unit_id", "text")
    named = [df.withColumnRenamed(k, "item_id").select(F.lit(n).alias("table_name"), "item_id", "piece_no", "char_start", "char_end", "piece") for n, k, df in (("document_nodes", "id", nodes), ("retrieval_units", "unit_id", units))]
    return named[0].unionByName(named[1])


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Items that had to be cut: table_name, item_id."""
    return p4_pieces(spark, folder).where("piece_no = 2").select("table_name", "item_id")


def scanned(spark: SparkSession, folder: str) -> DataFrame:
    """All texts that may come from scanned pages."""
    named = [("ocr_pages", "page_id", "text"), ("pdf_texts", "text_id", "combined_text"), ("document_nodes", "id", "text")]
    parts = [table(spark, folder, n).select(F.lit(n).alias("table_name"), "version_id", F.col(k).alias("record_id"), F.col(t).alias("text")) for n, k, t in named]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Lines with traces of printed pages and misreading."""
    return scans.found_cases(scans.repaired(scanned(spark, folder)))


def p6_repaired(spark: SparkSession, folder: str) -> DataFrame:
    """Every text's continuous paragraphs."""
    return scans.repaired(scanned(spark, folder)).select("table_name", "record_id", "repaired").distinct()


def p7_mapped(spark: SparkSession, folder: str) -> DataFrame:
    """Every hand-typed value with the entry it means, its distance and all entries within distance."""
    return canonical.mapped_values(*(table(spark, folder, n) for n in ("document_aliases", "document_cards", "canonical_entries")))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Records and the entry their value means, -1 for none."""
    return p7_mapped(spark, folder).select("table_name", "record_id", "entry_id")


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's token ids."""
    return tokens.encode_corpus(table(spark, folder, "documents"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents and the evaluation items whose passages they hold."""
    return leaks.find_leaks(table(spark, folder, "documents"), table(spark, folder, "eval_passages"))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of documents that differ only to a machine."""
    return lookalikes.visual_pairs(table(spark, folder, "documents"))


def p10_links(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's class and with how many others it is a pair."""
    return lookalikes.visual_links(table(spark, folder, "documents"))


def p10_canonical(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's class and a digest of its one consistent form."""
    forms = lookalikes.canonical_texts(table(spark, folder, "documents"))
    return forms.select("doc_id", "class_id", F.sha2("canonical_text", 256).alias("form_hash"))


QUERIES = {"p3_found": p3_found, "p3_nearest": p3_nearest, "p4_found": p4_found, "p4_pieces": p4_pieces, "p6_found": p6_found, "p6_repaired": p6_repaired, "p7_found": p7_found, "p7_mapped": p7_mapped, "p8_ids": p8_ids, "p9_found": p9_found, "p10_found": p10_found, "p10_links": p10_links, "p10_canonical": p10_canonical}


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


#: The SQL's own statement of problem 10, which shares no table with the operator: pairs of letters that look alike, each with the one that stands for both.
_ALIKE = "AА BВ CС EЕ HН IІ JЈ KК MМ OО PР SЅ TТ XХ YУ aа cс eе iі jј oо pр sѕ xх yу hһ dԁ qԛ wԝ ΑА ΒВ ΕЕ ΗН ΙІ ΚК ΜМ ΟО ΡР ΤТ ΥУ ΧХ ΓГ ΠП ΦФ ΝN ΖZ οо ϲс ϳј ëё ËЁ ïї ÏЇ".split()
#: The same without regard to case: small letters, of which b looks like в as B looks like В.
_ALIKE_SMALL = "aа bв cс eе hн iі jј kк mм oо pр sѕ tт xх yу dԁ qԛ wԝ һн αа βв εе ηн ιі κк μм οо ρр τт υу χх γг πп φф νn ζz ϲс ϳј ëё ïї".split()
_UNSEEN = "[\\x{0}-\\x{8}\\x{e}-\\x{1f}\\x{7f}-\\x{84}\\x{86}-\\x{9f}\\x{ad}\\x{34f}\\x{61c}\\x{115f}\\x{1160}\\x{17b4}\\x{17b5}\\x{180b}-\\x{180f}\\x{200b}-\\x{200f}\\x{202a}-\\x{202e}\\x{2060}-\\x{206f}\\x{3164}\\x{fe00}-\\x{fe0f}\\x{feff}\\x{ffa0}\\x{fff9}-\\x{fffb}\\x{1d173}-\\x{1d17a}\\x{e0000}-\\x{e0fff}]"


def _mapped(column: str, pairs: list[str] = _ALIKE, compose: bool = True) -> str:
    """Without what isn't seen, spaces and width forms as ordinary ones, composed, look-alikes as one letter."""
    spaces = "".join(map(chr, (0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000)))
    wide, plain = "".join(map(chr, range(0xFF01, 0xFF5F))), "".join(map(chr, range(0x21, 0x7F)))
    seen = f"translate(regexp_replace({column}, {_quoted(_UNSEEN)}, '', 'g'), {_quoted(spaces + wide)}, {_quoted(' ' * len(spaces) + plain)})"
    seen = seen if pairs is _ALIKE else f"lower({seen})"
    composed = f"nfc_normalize({seen})" if compose else seen
    return f"translate({composed}, {_quoted(''.join(p[0] for p in pairs))}, {_quoted(''.join(p[1] for p in pairs))})"


def _long(name: str, key: str) -> str:
    edge = pieces.EDGE.replace(r"\s", r"\s\x0b")
    bare = "regexp_replace(text, " + _quoted("^" + edge + "|" + edge + r"\z") + ", '', 'g')"
    return f"SELECT DISTINCT '{name}' AS table_name, {key} AS item_id FROM {name} WHERE {key} IS NOT NULL AND length({bare}) > {pieces.LIMIT}"


def _pieces() -> str:
    """The pieces by a walk over each text: at each end the farthest boundary of the strongest kind, found by trying every position."""
    white = "[ \\t\\n\\v\\f\\r]"
    ends = ((r"\r?\n[ \t]{0,2}\r?\n", 6), (r"(?:\r?\n|\r|\x{2028})", 2), (r'[.!?…][»")\]]?' + white, 3), ("[;:,]" + white, 2), (white + "[—–-]" + white, 3))
    strong = ", ".join(f"CASE WHEN most - {size} >= least THEN list_max(list_transform(list_filter(range(least, most - {size} + 1), lambda i: regexp_matches(substr(t, pos + i + 1, {size}), {_quoted('^(?:' + end + ')')})), lambda i: i * 10 + length(regexp_extract(substr(t, pos + i + 1, {size}), {_quoted('^(?:' + end + ')')})))) END" for end, size in ends)
    blank = f"CASE WHEN most > short THEN list_max(list_transform(list_filter(range(short, most), lambda i: regexp_matches(substr(t, pos + i + 1, 1), {_quoted(white)})), lambda i: i * 10 + 1)) END"
    edge = pieces.EDGE.replace(r"\s", r"\s\x0b")
    bare = "regexp_replace(text, " + _quoted("^" + edge + "|" + edge + r"\z") + ", '', 'g')"
    texts = " UNION ALL ".join(f"SELECT '{n}' AS table_name, {k} AS item_id, max({bare}) AS t FROM {n} WHERE {k} IS NOT NULL AND length({bare}) > 1800 GROUP BY 2" for n, k in (("document_nodes", "id"), ("retrieval_units", "unit_id")))
    return f"""WITH RECURSIVE x AS ({texts}), c AS (SELECT table_name, item_id, t, length(t) AS n, CAST(0 AS BIGINT) AS start, CAST(0 AS BIGINT) AS pos, CAST(0 AS BIGINT) AS no FROM x
UNION ALL SELECT table_name, item_id, t, n, greatest(pos - 200, 0), pos + CASE WHEN n - pos <= most THEN n - pos ELSE coalesce(v // 10 + v % 10, most) END, no + 1 FROM (SELECT *, coalesce({strong}, {blank}) AS v FROM (SELECT *, CASE WHEN no = 0 THEN 1800 ELSE 1600 END AS most, CASE WHEN no = 0 THEN 720 ELSE 640 END AS least, CASE WHEN no = 0 THEN 200 ELSE 1 END AS short FROM c WHERE pos < n)))
SELECT table_name, item_id, CAST(no AS INT) AS piece_no, CAST(start AS INT) AS char_start, CAST(pos AS INT) AS char_end, substr(t, start + 1, pos - start) AS piece FROM c WHERE no > 0"""


def _runs(name: str, key: str, column: str) -> str:
    words = f"regexp_extract_all({_mapped(column, _ALIKE_SMALL)}, " + _quoted(r"[\p{L}\p{N}][\p{L}\p{N}\p{M}]*") + ")"
    return f"SELECT {key}, unnest(list_transform(range(1, greatest(len(w) - 10, 1)), lambda i: array_to_string(w[i:i + 11], ' '))) AS run FROM (SELECT {key}, {words} AS w FROM {name})"


_SEEN = _quoted(r"[^\s\x0b\x1c-\x1f\x{85}\x{2028}\x{2029}" + "".join(map(chr, (0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000))) + _UNSEEN[1:-1] + "]")

ORACLES: dict[str, str] = {
    "p4_found": f"{_long('document_nodes', 'id')} UNION ALL {_long('retrieval_units', 'unit_id')}",
    "p4_pieces": _pieces(),
    "p9_found": f"WITH d AS ({_runs('documents', 'doc_id', 'text')}), e AS ({_runs('eval_passages', 'item_id', 'passage')}) SELECT DISTINCT doc_id, item_id FROM d JOIN e USING (run) WHERE len(string_split(run, ' ')) = 12",
    "p10_found": f"WITH f AS (SELECT doc_id, text, {_mapped('text')} AS form FROM documents WHERE regexp_matches(text, {_SEEN})) SELECT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM f a JOIN f b ON a.form = b.form AND a.doc_id < b.doc_id AND a.text <> b.text",
    "p10_links": f"WITH f AS (SELECT doc_id, text, {_mapped('text')} AS form FROM documents WHERE regexp_matches(text, {_SEEN})), c AS (SELECT form, min(doc_id) AS class_id, count(*) AS n FROM f GROUP BY 1), t AS (SELECT text, count(*) AS m FROM f GROUP BY 1) SELECT doc_id, class_id, n - m AS n_links FROM f JOIN c USING (form) JOIN t USING (text) UNION ALL SELECT doc_id, NULL, 0 FROM documents WHERE NOT coalesce(regexp_matches(text, {_SEEN}), false)",
    "p10_canonical": f"WITH f AS (SELECT doc_id, {_mapped('text')} AS form, {_mapped('text', compose=False)} AS m FROM documents), c AS (SELECT form, min(doc_id) AS class_id FROM f WHERE form IS NOT NULL GROUP BY 1) SELECT f.doc_id, class_id, sha256(g.m) AS form_hash FROM f LEFT JOIN c USING (form) LEFT JOIN f g ON g.doc_id = c.class_id",
}
