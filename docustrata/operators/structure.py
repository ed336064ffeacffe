"""Structure of running text: lines, line classes, the node tree, heading paths and references."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docustrata.functions.text import let, node_locator, normalize_code, squeeze
from docustrata.session import spread

#: Fixed value: lines that name a page.
PAGE_LINE = r"(?i)^(?:\[\[ *PAGE[: ]+([0-9]+) *\]\]|\[ *PAGE +([0-9]+) *\]|--- *PAGE +([0-9]+) *---)$"
#: The rules of line classes, in order: type, pattern, group of the label, group of the title.
RULES = (
    ("section", r"^(?:РАЗДЕЛ|SECTION|ГЛАВА|CHAPTER) +([IVXLC0-9]+)(?:[.\-: ]+(.*))?$", 1, 2),
    ("subsection", r"^(?:ПОДРАЗДЕЛ|SUBSECTION) +([0-9]+(?:\.[0-9]+)*)(?:[.\-: ]+(.*))?$", 1, 2),
    ("appendix", r"^(?:ПРИЛОЖЕНИЕ|Приложение|приложение|APPENDIX|Appendix|appendix) +([A-Za-zА-Яа-яЁё0-9]+)?[.\-: ]*(.*)$", 1, 2),
    ("table", r"^(?:ТАБЛИЦА|Таблица|таблица|TABLE|Table|table) +([A-Za-zА-Яа-яЁё0-9.\-]+)?[.\-: ]*(.*)$", 1, 2),
    ("table", r"^.*\|.*$", 0, 0),
    ("note", r"^(?:ПРИМЕЧАНИЕ|Примечание|примечание|NOTE|Note|note)(?:[.\-: ]+(.*))?$", 0, 1),
    ("subsection", r"^([0-9]+\.[0-9]+) +(.+)$", 1, 2),
    ("subpoint", r"^([0-9]+(?:\.[0-9]+){2,}) +(.+)$", 1, 2),
    ("subpoint", r"^([A-Za-zА-Яа-яЁё])\) +(.+)$", 1, 2),
    ("subpoint", r"^- +(.+)$", 0, 1),
    ("point", r"^([0-9]+)\. +(.+)$", 1, 2),
)
#: Fixed value: references to documents in running text.
REFERENCE = "(?:СП|SP|ГОСТ|GOST|СНИП|СНиП|SNIP) *[A-Za-zА-Яа-яЁё]? *[0-9][0-9./-]*"


def _lines(c: Column) -> Column:
    """The non-blank lines of a text, squeezed, whatever its line breaks."""
    unified = F.regexp_replace(F.coalesce(c, F.lit("")), "\r\n|\r", "\n")
    return F.filter(F.transform(F.split(unified, "\n"), squeeze), lambda x: x != "")


def numbered_lines(texts: DataFrame, key: str, text: str) -> DataFrame:
    """Kept lines of each text: key, order_index from 1, line. Blank lines and page lines are dropped; no shuffle."""
    kept = F.filter(_lines(F.col(text)), lambda x: ~x.rlike(PAGE_LINE))
    rows = spread(texts.select(key, text)).select(F.col(key), F.posexplode(kept).alias("_i", "line"))
    return rows.select(key, (F.col("_i") + 1).alias("order_index"), "line")


def prepared_lines(texts: DataFrame, key: str, text: str) -> DataFrame:
    """Kept lines of each text: key, order_index from 1, line, char_start, char_end, page_number (of the last page line before it).

    Blank lines and page lines are dropped; offsets count kept lines with one line feed between. A text's lines stay in one row until
    they are numbered, so nothing is shuffled; running sums are taken over whole batches, in time that grows with the lines.
    """
    page = lambda x: F.coalesce(*[F.nullif(F.regexp_extract(x, PAGE_LINE, i), F.lit("")) for i in (1, 2, 3)]).cast("int")
    lines = F.transform(_lines(F.col(text)), lambda x: F.struct(x.alias("line"), F.length(x).alias("n"), F.when(x.rlike(PAGE_LINE), F.coalesce(page(x), F.lit(-1))).alias("page")))
    kind = texts.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, order_index int, line string, char_start int, char_end int, page_number int"
    return spread(texts.select(key, text)).select(key, lines.alias("_l")).mapInArrow(_placed(key), schema)


def _placed(key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            owner = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            flat = lists.flatten()
            if not len(flat):
                continue
            line, size = flat.field("line"), flat.field("n").to_numpy(zero_copy_only=False).astype(np.int64)
            mark = flat.field("page").to_pylist()
            is_page = np.array([m is not None for m in mark])
            number = np.array([m if m is not None else -1 for m in mark])
            # the last page line of the same text, at or before each line
            at = np.maximum.accumulate(np.where(is_page, np.arange(len(owner)), -1))
            known = (at >= 0) & (owner[np.maximum(at, 0)] == owner)
            page = np.where(known, number[np.maximum(at, 0)], -1)
            own, size, page = owner[~is_page], size[~is_page], page[~is_page]
            first = np.r_[True, own[1:] != own[:-1]] if len(own) else np.zeros(0, bool)
            begin = np.maximum.accumulate(np.where(first, np.arange(len(own)), 0))
            ends = np.cumsum(size + 1)
            start = ends - (size + 1)
            start = start - start[begin] if len(own) else start
            columns = [batch.column(0).take(pa.array(own)), pa.array((np.arange(len(own)) - begin + 1).astype(np.int32)), line.filter(pa.array(~is_page)), pa.array(start.astype(np.int32)), pa.array((start + size).astype(np.int32)), pa.array(page.astype(np.int32), mask=page < 0)]
            yield pa.RecordBatch.from_arrays(columns, [key, "order_index", "line", "char_start", "char_end", "page_number"])

    return run


def classified(lines: DataFrame) -> DataFrame:
    """Add node_type, label and title by the first rule that fits; a text's first line is its title.

    The number of the rule is found once, and only in lines that some rule fits; label and title are then read by that rule alone.
    """
    any_rule = "|".join(f"(?:{p})" for _, p, *_ in RULES)
    rule = F.when(F.col("order_index") == 1, F.lit(0)).when(~F.col("line").rlike(any_rule), F.lit(len(RULES) + 1))
    for i, (_, pattern, *_) in enumerate(RULES, 1):
        rule = rule.when(F.col("line").rlike(pattern), i)

    def read(x: Column, n: Column) -> Column:
        missing = F.lit(None).cast("string")
        got = lambda p, g: F.nullif(F.trim(F.regexp_extract(x, p, g)), F.lit(""))
        kind, label, title = F.when(n == 0, F.lit("title")), F.when(n == 0, missing), F.when(n == 0, x)
        for i, (name, pattern, lab, tit) in enumerate(RULES, 1):
            kind = kind.when(n == i, name)
            label = label.when(n == i, got(pattern, lab) if lab else missing)
            title = title.when(n == i, F.coalesce(got(pattern, tit), x) if tit else x)
        return F.struct(kind.otherwise("paragraph").alias("node_type"), label.alias("label"), title.alias("title"))

    told = lines.withColumn("_c", let(rule, lambda n: read(F.col("line"), n)))
    return told.select(*lines.columns, "_c.node_type", "_c.label", "_c.title")


def _opened(nodes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Add _s, _b, _p, _u: the last section, subsection, point and subpoint before a node, as structs of ``columns``; one window for all."""
    before = Window.partitionBy(key).orderBy("order_index").rowsBetween(Window.unboundedPreceding, -1)
    last = lambda kind: F.last(F.when(F.col("node_type") == kind, F.struct(*columns)), ignorenulls=True).over(before)
    return nodes.withColumns({"_s": last("section"), "_b": last("subsection"), "_p": last("point"), "_u": last("subpoint")})


def _chain() -> tuple[Column, ...]:
    """Order of the last section, subsection, point and subpoint (0 for none), and which of the latter three are still open."""
    s, b, p, u = (F.coalesce(F.col(f"{c}.order_index"), F.lit(0)) for c in ("_s", "_b", "_p", "_u"))
    return s, b, p, u, b > s, p > F.greatest(s, b), u > F.greatest(s, b, p)


def tree(nodes: DataFrame, key: str) -> DataFrame:
    """Add parent_order_index: by the last open section, subsection, point and subpoint before a node."""
    s, b, p, u, in_b, in_p, in_u = _chain()
    sec = F.when(s > 0, s).otherwise(1)
    kind = F.col("node_type")
    parent = (
        F.when(kind == "title", F.lit(None).cast("int"))
        .when(kind.isin("section", "appendix", "table", "note"), 1)
        .when(kind == "subsection", sec)
        .when(kind == "point", F.when(in_b, b).otherwise(sec))
        .when(kind == "subpoint", F.when(in_p, p).when(in_b, b).otherwise(sec))
        .otherwise(F.when(in_u, u).when(in_p, p).when(in_b, b).otherwise(sec))
    )
    return _opened(nodes, key, ["order_index"]).withColumn("parent_order_index", parent.cast("int")).drop("_s", "_b", "_p", "_u")


def heading_paths(nodes: DataFrame, key: str) -> DataFrame:
    """Add heading_path: the labels from the title down to the node's own heading, joined by ' > '.

    What is open at a node was open at its open ancestors too, so one window over the last section, subsection, point and subpoint with
    their labels gives the whole path; nothing is joined.
    """
    own = F.when(F.col("node_type") == "title", F.col("title")).when(F.col("node_type") != "paragraph", F.concat_ws(" ", "label", "title"))
    opened = _opened(nodes.withColumn("_own", own), key, ["order_index", "_own"])
    *_, in_b, in_p, in_u = _chain()
    kind = F.col("node_type")
    level = F.when(kind == "title", 0).when(kind.isin("section", "appendix", "table", "note"), 1).when(kind == "subsection", 2).when(kind == "point", 3).when(kind == "subpoint", 4).otherwise(5)
    title = F.first("_own").over(Window.partitionBy(key).orderBy("order_index").rowsBetween(Window.unboundedPreceding, 0))
    above = [F.when(level > 0, title), F.when(level > 1, F.col("_s._own")), F.when((level > 2) & in_b, F.col("_b._own")), F.when((level > 3) & in_p, F.col("_p._own")), F.when((level > 4) & in_u, F.col("_u._own"))]
    return opened.withColumn("heading_path", F.array_join(F.array_compact(F.array(*above, F.col("_own"))), " > ")).drop("_own", "_s", "_b", "_p", "_u")


def structured(texts: DataFrame, key: str, text: str) -> DataFrame:
    """The nodes of texts in one pass: key, order_index, node_type, label, title, line, char_start, char_end, page_number, locator, parent_order_index, heading_path.

    The tree and the paths take the same windows, so the lines are shuffled once.
    """
    nodes = heading_paths(tree(classified(prepared_lines(texts, key, text)), key), key)
    return nodes.withColumn("locator", node_locator(F.col("node_type"), F.col("label"), F.col("order_index"), F.lit(None).cast("string")))


def references(nodes: DataFrame, keys: list[str], title: str, text: str) -> DataFrame:
    """Document codes that nodes name: the keys, code, raw; each code once per node, the first spelling kept."""
    full = F.concat_ws(" ", F.col(title), F.col(text))
    found = F.transform(F.regexp_extract_all(full, F.lit(REFERENCE), F.lit(0)), lambda r: F.struct(normalize_code(F.regexp_replace(r, "[.,;:]+$", "")).alias("code"), F.regexp_replace(r, "[.,;:]+$", "").alias("raw")))
    rows = nodes.select(*keys, F.posexplode(found).alias("_i", "_r"))
    first = rows.groupBy(*keys, F.col("_r.code").alias("code")).agg(F.min(F.struct("_i", "_r.raw")).alias("_f"))
    return first.select(*keys, "code", F.col("_f.raw").alias("raw"))


def matched_references(references: DataFrame, documents: DataFrame) -> DataFrame:
    """References with the document of their code (documents: code, document_id, one row per code): confidence 1.0 if found, else 0.5."""
    joined = references.join(documents.select("code", F.col("document_id").alias("matched_document_id")), "code", "left")
    return joined.withColumn("match_confidence", F.when(F.col("matched_document_id").isNotNull(), F.lit(1.0)).otherwise(F.lit(0.5)))
