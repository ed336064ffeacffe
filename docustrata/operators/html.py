"""Pages to text and fields: removal of page matter, links, pagination, card tables, choice of a text source."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docustrata.functions.codes import year
from docustrata.functions.dates import dotted_date, first_date, written_date
from docustrata.functions.text import squeeze

#: Elements that hold no text, classes of page matter, and roots that hold a document.
DROPPED = {"script", "style", "noscript", "header", "footer", "nav"}
DROPPED_CLASSES = ("crumbs", "header", "footer", "menu")
ROOTS = ("contener_doc", "contener_cat_list")
_VOID = {"br", "img", "hr", "input", "meta", "link", "col", "area", "base", "source", "wbr"}


class _Reader(HTMLParser):
    """Text chunks inside and outside the preferred root, links, and rows of table cells; dropped elements lose all their text."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, bool, bool]] = []
        self.all: list[str] = []
        self.rooted: list[str] = []
        self.links: list[tuple[str, str]] = []
        self.rows: list[list[str]] = []
        self.images = 0
        self._href: str | None = None
        self._link_text: list[str] = []

    def handle_starttag(self, tag, attrs) -> None:
        a = dict(attrs)
        if tag == "img":
            self.images += 1
        if tag in _VOID:
            return
        cls = (a.get("class") or "").lower()
        drop = tag in DROPPED or any(c in cls for c in DROPPED_CLASSES)
        root = any(r in cls for r in ROOTS)
        self.stack.append((tag, drop, root))
        if tag == "a" and a.get("href"):
            self._href, self._link_text = a["href"], []
        if tag == "tr":
            self.rows.append([])
        if tag in ("td", "th") and self.rows:
            self.rows[-1].append("")

    def handle_endtag(self, tag) -> None:
        if not any(t == tag for t, *_ in self.stack):
            return
        while self.stack and self.stack.pop()[0] != tag:
            pass
        if tag == "a" and self._href is not None:
            self.links.append((self._href, " ".join(" ".join(self._link_text).split())))
            self._href = None

    def handle_data(self, data) -> None:
        chunk = " ".join(data.split())
        if not chunk:
            return
        if self._href is not None:
            self._link_text.append(chunk)
        if self.rows and self.rows[-1] and any(t in ("td", "th") for t, *_ in self.stack):
            self.rows[-1][-1] = f"{self.rows[-1][-1]} {chunk}".strip()
        if any(d for _, d, _ in self.stack):
            return
        self.all.append(chunk)
        if any(r for *_, r in self.stack):
            self.rooted.append(chunk)


def read_pages(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """key, text (chunks by line, of the preferred root where there is one), links (href resolved, label), rows (cells), n_images.

    Broken markup is read as far as it goes; null pages have empty text and lists.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links_type, rows_type = pa.list_(pa.struct([("href", pa.string()), ("label", pa.string())])), pa.list_(pa.list_(pa.string()))
        for batch in batches:
            out: list[tuple] = []
            for u, h in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                r = _Reader()
                r.feed(h or "")
                r.close()
                out.append(("\n".join(r.rooted or r.all), [{"href": urljoin(u or "", x), "label": y} for x, y in r.links], [row for row in r.rows if row], r.images))
            cols = list(zip(*out)) if out else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cols[0], pa.string()), pa.array(cols[1], links_type), pa.array(cols[2], rows_type), pa.array(cols[3], pa.int32())], [key, "text", "links", "rows", "n_images"])

    kind = pages.schema[key].dataType.simpleString()
    return pages.select(key, url, html).mapInArrow(run, f"`{key}` {kind}, text string, links array<struct<href:string,label:string>>, rows array<array<string>>, n_images int")


def page_text(html: Column) -> Column:
    """The text of simple markup inside codegen: dropped elements and all tags go, chunks are squeezed."""
    for tag in sorted(DROPPED):
        html = F.regexp_replace(html, f"(?is)<{tag}[^>]*>.*?</{tag}>", "\n")
    lines = F.filter(F.transform(F.split(F.regexp_replace(html, "<[^>]+>", "\n"), "\n"), squeeze), lambda x: x != "")
    return F.array_join(lines, "\n")


def page_kind(html: Column) -> Column:
    """list_grid, list_table, card or other, by the classes in the markup."""
    return F.when(F.contains(html, F.lit("table_doc")), "list_grid").when(F.contains(html, F.lit("doctab1")), "list_table").when(F.contains(html, F.lit("doctab2")), "card").otherwise("other")


def pagination(links: DataFrame, key: str = "page_id") -> DataFrame:
    """Links of a list to its own pages (key, url, links): key, page_no, url. The same host and name with _N; the last link of a number wins."""
    host, name = F.regexp_extract("url", "^[a-z]+://([^/]+)", 1), F.regexp_replace(F.regexp_extract("url", "/([^/?#]+?)(?:_[0-9]+)?\\.html", 1), "_[0-9]+$", "")
    rows = links.select(key, host.alias("_h"), name.alias("_n"), F.posexplode("links").alias("pos", "l"))
    at = F.regexp_extract("l.href", "/([^/?#]+)_([0-9]+)\\.html", 2)
    own = rows.where((F.regexp_extract("l.href", "^[a-z]+://([^/]+)", 1) == F.col("_h")) & (F.regexp_extract("l.href", "/([^/?#]+)_([0-9]+)\\.html", 1) == F.col("_n")) & (at != ""))
    return own.groupBy(key, at.cast("int").alias("page_no")).agg(F.max_by("l.href", "pos").alias("url"))


def card_fields(read: DataFrame, key: str = "page_id") -> DataFrame:
    """Label and value of the two-cell rows of a page: key, label, value; of equal labels the first."""
    rows = read.select(key, F.posexplode("rows").alias("pos", "r")).where(F.size("r") == 2)
    label = F.lower(F.regexp_replace(squeeze(F.get("r", F.lit(0))), ":+$", ""))
    return rows.groupBy(key, label.alias("label")).agg(F.min_by(squeeze(F.get("r", F.lit(1))), "pos").alias("value"))


def title_header(c: Column) -> list[Column]:
    """Code and title of '"code. title"'; the whole as the title where there is no such dot."""
    bare = F.trim(F.regexp_replace(squeeze(c), '^["«]+|["»]+$', ""))
    at = F.instr(bare, ". ")
    return [F.when(at > 0, F.substring(bare, F.lit(1), at - 1)).alias("code"), F.when(at > 0, F.trim(F.substring(bare, at + 2, F.length(bare)))).otherwise(bare).alias("title")]


def text_source(html_text: Column, pdf_text: Column, pdf_score: Column) -> Column:
    """Which text to take: long HTML, a PDF with a text layer, short HTML, any PDF, else recognition: struct source, confidence, needs_ocr."""
    h, p = (F.length(F.trim(F.coalesce(c, F.lit("")))) for c in (html_text, pdf_text))
    made = lambda s, c, n: F.struct(F.lit(s).alias("source"), c.cast("double").alias("confidence"), F.lit(n).alias("needs_ocr"))
    score = F.coalesce(pdf_score, F.lit(0.0))
    return F.when(h >= 200, made("html", F.lit(1.0), False)).when((p > 0) & (score >= 0.5), made("pdf", score, False)).when(h > 0, made("html", F.lit(0.8), False)).when(p > 0, made("pdf", score, False)).otherwise(made("none", F.lit(0.0), True))


def downloads(cards: DataFrame) -> DataFrame:
    """What to fetch of a card (card_id, html_url, print_url, pdf_url, image_urls): card_id, artifact, url. Full HTML before print, the PDF, and images only where there is neither."""
    page = F.coalesce(F.nullif("html_url", F.lit("")), F.nullif("print_url", F.lit("")))
    pdf = F.nullif("pdf_url", F.lit(""))
    images = F.when(page.isNull() & pdf.isNull(), F.coalesce("image_urls", F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>"))
    plan = F.concat(F.array(F.struct(F.lit("html").alias("artifact"), page.alias("url")), F.struct(F.lit("pdf").alias("artifact"), pdf.alias("url"))), F.transform(F.array_distinct(F.slice(images, 1, 25)), lambda u: F.struct(F.lit("page_image").alias("artifact"), u.alias("url"))))
    return cards.select("card_id", F.explode(F.filter(plan, lambda x: x["url"].isNotNull())).alias("p")).select("card_id", "p.artifact", "p.url")


# -- list pages and cards, two layouts each --------------------------------------------------------------------------------

#: Elements that end where the next of the same kind begins, and what holds them.
_SELF_ENDING = {"li": ("ul", "ol"), "td": ("tr", "table"), "th": ("tr", "table"), "tr": ("table",), "p": ("div", "td", "body")}
#: Labels of the fields of a card's table.
LABELS = {"code": "Обозначение", "title": "Название рус.", "status": "Статус", "actualized": "Дата актуализации", "effective": "Дата введения", "published": "Издан", "scope": "Область применения", "references": "Нормативные ссылки"}
#: What a card's text says of its first print, of its scope and of the date of its edition and of coming into force.
FIRST_PRINT, SCOPE_HEADING, EDITION_MARK, FORCE_MARK = "Первоначальный текст документа опубликован в издании", "Область применения", "ред. от", "введен"
CARD_REFERENCES = 25


class _Element:
    """An element of a page: its tag, attributes and parts (texts and elements)."""

    __slots__ = ("tag", "attrs", "parts")

    def __init__(self, tag: str, attrs: dict) -> None:
        self.tag, self.attrs, self.parts = tag, attrs, []

    def all(self, *tags: str) -> Iterator[_Element]:
        """The elements below, in the page's order."""
        todo = [x for x in reversed(self.parts) if isinstance(x, _Element)]
        while todo:
            e = todo.pop()
            if not tags or e.tag in tags:
                yield e
            todo.extend(x for x in reversed(e.parts) if isinstance(x, _Element))

    def own(self, tag: str) -> list[_Element]:
        return [x for x in self.parts if isinstance(x, _Element) and x.tag == tag]

    def has(self, *classes: str) -> bool:
        return any(c in (self.attrs.get("class") or "") for c in classes)

    def text(self) -> str:
        out, todo = [], [self]
        while todo:
            e = todo.pop()
            if isinstance(e, str):
                out.append(e)
            else:
                todo.extend(reversed(e.parts))
        return " ".join(" ".join(out).split())


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = _Element("", {})
        self.open = [self.root]

    def handle_starttag(self, tag, attrs) -> None:
        ends = _SELF_ENDING.get(tag)
        if ends:
            for i in range(len(self.open) - 1, 0, -1):
                if self.open[i].tag == tag:
                    del self.open[i:]
                    break
                if self.open[i].tag in ends:
                    break
        e = _Element(tag, dict(attrs))
        self.open[-1].parts.append(e)
        if tag not in _VOID:
            self.open.append(e)

    def handle_startendtag(self, tag, attrs) -> None:
        self.open[-1].parts.append(_Element(tag, dict(attrs)))

    def handle_endtag(self, tag) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return

    def handle_data(self, data) -> None:
        self.open[-1].parts.append(data)


def _page(markup: str | None) -> _Element:
    b = _Builder()
    b.feed(markup or "")
    b.close()
    return b.root


def _headed(header: str) -> tuple[str, str]:
    """Code and title of a heading 'code. title', in quotes or not; the whole as both where it has no such dot."""
    header = " ".join(header.split())
    if header.count('"') > 1 and header.split('"')[1]:
        header = header.split('"')[1]
    code, dot, title = header.strip('"').partition(". ")
    return (code.strip(), title.strip()) if dot else (code, code)


def _grid_rows(page: _Element, url: str) -> Iterator[tuple]:
    for grid in page.all("div"):
        if not grid.has("table_doc"):
            continue
        for row in grid.all("div"):
            cells = [c for c in row.own("div") if c.has("cell")]
            if not row.has("row") or row.has("header") or len(cells) < 3:
                continue
            link = next((a for a in cells[1].all("a") if a.attrs.get("href")), None)
            if link is not None and link.text():
                yield (urljoin(url, link.attrs["href"]), *_headed(link.text()), cells[2].text())


def _table_rows(page: _Element, url: str) -> Iterator[tuple]:
    for table in page.all("table"):
        if not table.has("doctab1"):
            continue
        for row in table.all("tr"):
            cells = row.own("td")
            if not row.has("m3") or len(cells) < 4:
                continue
            link = next((a for a in cells[0].all("a") if "/Index" in (a.attrs.get("href") or "")), None)
            if link is not None:
                yield urljoin(url, link.attrs["href"]), link.text(), cells[1].text(), cells[3].text()


def list_rows(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Rows of list pages of both layouts, the grid and the table: key, row_no from 1, card_url, document_code, title, status_raw.

    Rows without a link to a card, header rows and rows with too few cells are no entries; null and broken pages have those that can be read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for i, (u, h) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                page = _page(h)
                out += [(i, n, *row) for n, row in enumerate([*_grid_rows(page, u or ""), *_table_rows(page, u or "")], 1)]
            at, no, *texts = zip(*out) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int32())), pa.array(no, pa.int32()), *(pa.array(c, pa.string()) for c in texts)], [key, "row_no", "card_url", "document_code", "title", "status_raw"])

    kind = pages.schema[key].dataType.simpleString()
    return pages.select(key, url, html).mapInArrow(run, f"`{key}` {kind}, row_no int, card_url string, document_code string, title string, status_raw string")


def _table_card(page: _Element, url: str) -> tuple:
    told: dict[str, str] = {}
    references: list[str] = []
    for table in page.all("table"):
        for row in table.all("tr") if table.has("doctab2") else ():
            cells = row.own("td")
            label = next((b.text() for b in cells[0].all("b")), "").rstrip(":") if len(cells) > 1 else ""
            if not label:
                continue
            if label == LABELS["references"]:
                references += [links[-1].text() for item in cells[1].all("li") if (links := list(item.all("a"))) and links[-1].text()]
            link = next((a.text() for a in cells[1].all("a") if a.has("a1")), "") if label == LABELS["code"] else ""
            told[label] = link or cells[1].text()
    codes = [t for t in (h.text() for h in page.all("h2")) if t]
    titles = [t for t in (h.text() for h in page.all("h3")) if t]
    dated = next((t for t in titles if t.startswith(LABELS["actualized"])), None)
    code = told.get(LABELS["code"]) or next((t for t in codes if not t.startswith("Скачать ")), codes[0].removeprefix("Скачать ").strip() if codes else "")
    title = told.get(LABELS["title"]) or next((t for t in titles if not t.startswith(LABELS["actualized"])), "")
    named = lambda fits: next((urljoin(url, a.attrs["href"]) for a in page.all("a") if a.attrs.get("href") and fits((a.attrs.get("title") or "").lower())), None)
    images = list(dict.fromkeys(urljoin(url, i.attrs["src"]) for i in page.all("img") if i.has("img2") and i.attrs.get("src")))
    return "table_card", code, title, told.get(LABELS["status"]), told.get(LABELS["actualized"]) or dated, told.get(LABELS["effective"]), told.get(LABELS["published"]), told.get(LABELS["scope"]), references, named("pdf".__eq__), named("html".__eq__), named(lambda t: "печати" in t), images


def _text_card(page: _Element, url: str) -> tuple:
    head = " ".join(t.text() for t in page.all("title"))
    code, title = _headed(head)
    low = head.lower()
    after = lambda mark: head[low.index(mark) :] if mark in low else None
    bodies = list(page.all("body"))
    text = bodies[0].text() if bodies else ""
    headings = [t for t in (x.text() for x in page.all("span") if x.has("s4", "s5")) if t.startswith("1 ") and SCOPE_HEADING in t]
    scope = next((x.text() or None for x in page.all("span") if x.has("s2", "s3")), None) if headings else None
    links = [a for a in (bodies[0].all("a") if bodies else ()) if a.attrs.get("href") and "title" in a.attrs][:CARD_REFERENCES]
    references = list(dict.fromkeys(v for a in links if (v := " ".join((a.attrs["title"] or "").split()) or a.text())))
    return "text_card", code, title, None, after(EDITION_MARK), after(FORCE_MARK), text if FIRST_PRINT in text else None, scope, references, None, url, None, []


def card_data(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """What a card says, in either layout: key, source_type, document_code, document_title, card_status_raw, text_actualized_at, effective_from, published_at,
    scope_text, normative_references, pdf_url, html_url, print_url, image_urls, has_full_html, edition_label.

    '/Index' in the URL names the card with a table, '/mega_doc/' the one that is the text itself; of other pages nothing is known (source_type null).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for u, h in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                read = _table_card if "/Index" in (u or "") else _text_card if "/mega_doc/" in (u or "") else None
                out.append(read(_page(h), u) if read else (None,) * 8 + ([],) + (None,) * 3 + ([],))
            cols = list(zip(*out)) if out else [[]] * 13
            kinds = [pa.list_(pa.string()) if i in (8, 12) else pa.string() for i in range(13)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))], [key, *_CARD])

    kind = pages.schema[key].dataType.simpleString()
    schema = ", ".join([f"`{key}` {kind}", *(f"{c} {'array<string>' if c in ('normative_references', 'image_urls') else 'string'}" for c in _CARD)])
    read = pages.select(key, url, html).mapInArrow(run, schema)
    is_text = F.col("source_type") == "text_card"
    day = lambda c: F.when(is_text, first_date(F.col(c))).otherwise(F.coalesce(written_date(F.col(c)), dotted_date(F.col(c)), first_date(F.col(c))))
    printed = F.when(is_text, F.try_to_date(F.concat(year(F.col("_published")).cast("string"), F.lit("-01-01")), "yyyy-MM-dd")).otherwise(first_date(F.col("_published")))
    dated = read.select(key, "source_type", "document_code", "document_title", "card_status_raw", day("_actualized").alias("text_actualized_at"), day("_effective").alias("effective_from"), printed.alias("published_at"), "scope_text", "normative_references", "pdf_url", "html_url", "print_url", "image_urls", F.col("html_url").isNotNull().alias("has_full_html"))
    edition = F.concat(F.when(is_text, "ред. от ").otherwise("актуализация от "), F.col("text_actualized_at").cast("string"))
    return dated.withColumn("edition_label", edition)


_CARD = ["source_type", "document_code", "document_title", "card_status_raw", "_actualized", "_effective", "_published", "scope_text", "normative_references", "pdf_url", "html_url", "print_url", "image_urls"]


def card_jobs(rows: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """The jobs that list rows (page_id, row_no, card_url, status_raw) make: each card URL once, by its first row, without those seen before (card_url)."""
    first = rows.where(F.length(F.coalesce("card_url", F.lit(""))) > 0).groupBy("card_url").agg(F.min(F.struct("page_id", "row_no", "status_raw")).alias("f"))
    fresh = first if seen is None else first.join(seen.select("card_url").distinct(), "card_url", "left_anti")
    return fresh.select(F.lit("process_document_card").alias("job_type"), "card_url", F.col("f.status_raw").alias("list_status_raw"), F.col("f.page_id").alias("page_id"))
