"""String kernel: Column -> Column, all inside whole-stage codegen."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Everything Python's str.isspace accepts, for Java's regex dialect.
SPACE = r"[\s\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
#: The dash characters that count as a hyphen in document codes.
DASHES = "[‐‑‒–—―]+"


def _rep(c: Column, pattern: str, to: str) -> Column:
    return F.regexp_replace(c, pattern, to)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it; without it plans grow with each mention."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def squeeze(c: Column) -> Column:
    """Collapse runs of Unicode white space to one blank and strip both ends."""
    return F.trim(_rep(c, SPACE + "+", " "))


def is_blank(c: Column) -> Column:
    """True for null, empty and white-space-only values."""
    return F.coalesce(F.length(squeeze(c)) == 0, F.lit(True))


def strip_html(c: Column) -> Column:
    """Replace tags by blanks, then squeeze."""
    return squeeze(_rep(c, "<[^>]+>", " "))


def clean_code(c: Column) -> Column:
    """Remove layout noise from a document code."""
    c = squeeze(_rep(c, DASHES, "-"))
    c = _rep(_rep(c, r"\s*-\s*", "-"), r"\s*/\s*", "/")
    return F.trim(_rep(c, "[;:,]+$", ""))


def normalize_code(c: Column) -> Column:
    """The canonical form of a document code: cleaned and upper case."""
    return F.upper(clean_code(c))


def truncate_for_log(c: Column, limit: int = 160) -> Column:
    """At most ``limit`` characters; longer texts end in '...' where there is room for it."""
    if limit <= 0:
        raise ValueError("limit must be positive")
    cut = F.substring(c, 1, limit) if limit <= 3 else F.concat(F.substring(c, 1, limit - 3), F.lit("..."))
    return F.when(F.length(c) <= limit, c).otherwise(cut)


def truncate_tail(c: Column, limit: int) -> Column:
    """Like truncate_for_log, of the squeezed text, without blanks before the dots."""
    s = squeeze(c)
    return F.when(F.length(s) <= limit, s).otherwise(F.concat(F.rtrim(F.substring(s, 1, limit - 3)), F.lit("...")))


#: Fixed value: what a search token consists of.
TOKEN = "[0-9a-zа-яё]+"


def tokens(c: Column) -> Column:
    """Search tokens in order: runs of letters and digits in lower case, longer than one or a digit; none for null."""
    found = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(TOKEN), F.lit(0))
    return F.filter(found, lambda t: (F.length(t) > 1) | t.rlike("^[0-9]$"))


def distinct_tokens(c: Column) -> Column:
    """Each token once, by first occurrence."""
    return F.array_distinct(tokens(c))


def normalized_lines(c: Column) -> Column:
    """Non-blank lines, squeezed, whatever the line breaks."""
    unified = F.regexp_replace(F.coalesce(c, F.lit("")), "\r\n|\r", "\n")
    return F.filter(F.transform(F.split(unified, "\n"), squeeze), lambda x: x != "")


def content_hash(c: Column) -> Column:
    """Digest of a text that doesn't depend on white space or line breaks."""
    return F.sha2(F.array_join(normalized_lines(c), "\n"), 256)


def chunk_hash(version: Column, kind: Column, start: Column, end: Column, text: Column) -> Column:
    """Digest of a retrieval unit: version, type, order range and squeezed text."""
    return F.sha2(F.concat_ws("|", version, kind, F.concat_ws(",", start.cast("string"), end.cast("string")), squeeze(text)), 256)


def token_estimate(c: Column, chars_per_token: float = 4.0) -> Column:
    """Estimated model tokens: a quarter of the characters, one at least."""
    return F.greatest(F.lit(1), F.ceil(F.length(F.coalesce(c, F.lit(""))) / F.lit(chars_per_token))).cast("bigint")


def path_component(c: Column) -> Column:
    """A name that is safe in a path: runs of characters that file systems refuse become one underscore, blanks one each; 'unnamed' for nothing."""
    clean = _rep(F.replace(_rep(squeeze(c), r'[<>:"/\\|?*]+', "_"), F.lit(" "), F.lit("_")), "^[._]+|[._]+$", "")
    return F.when(clean == "", F.lit("unnamed")).otherwise(clean)


def storage_key(code: Column) -> Column:
    """Folder of a document: the start of its safe code and the start of that code's digest."""
    return let(path_component(code), lambda safe: F.concat_ws("-", F.coalesce(F.nullif(_rep(F.substring(safe, 1, 24), "[._-]+$", ""), F.lit("")), F.lit("doc")), F.substring(F.sha1(safe), 1, 12)))


def artifact_path(code: Column, version: Column, kind: Column, extension_: Column) -> Column:
    """Where an artifact lies in the store: the document's folder, the version's, and the type (32 characters) with its extension."""
    name = let(path_component(kind), lambda k: F.coalesce(F.nullif(_rep(F.substring(k, 1, 32), "[._-]+$", ""), F.lit("")), F.lit("artifact")))
    return F.concat_ws("/", storage_key(code), path_component(version), F.concat(name, F.lit("."), F.lower(_rep(extension_, "^[.]", ""))))


#: Extensions and media types of artifacts.
MIME = {"html": "text/html", "htm": "text/html", "pdf": "application/pdf", "txt": "text/plain", "json": "application/json", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "tif": "image/tiff", "tiff": "image/tiff"}


def extension(path: Column) -> Column:
    """Lower-case extension of the last path element, without query; null if there is none."""
    last = F.regexp_extract(_rep(path, "[?#].*$", ""), r"\.([A-Za-z0-9]+)$", 1)
    return F.nullif(F.lower(last), F.lit(""))


def mime_type(path: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in MIME.items() for x in pair])
    return F.coalesce(F.element_at(known, extension(path)), F.lit("application/octet-stream"))


#: Fixed value: the words that may stand before a locator.
LOCATOR_WORDS = r"^(п\.?|пункт|раздел|глава|таблица|приложение|section|chapter|table|appendix) +"


def locator(c: Column) -> Column:
    """Lookup form of a locator: without its word; digits only where nothing else is left, else lower case; null for nothing."""
    bare = F.trim(_rep(squeeze(c), "(?iu)" + LOCATOR_WORDS, ""))
    return let(bare, lambda x: let(_rep(x, "[ _-]+", ""), lambda y: F.when(x == "", F.lit(None)).when(y.rlike("^[0-9]+$"), y).otherwise(F.lower(x))))


def node_locator(kind: Column, label: Column, order: Column, parent: Column) -> Column:
    """type:label or type:order, below the parent's locator."""
    own = F.concat(kind, F.lit(":"), F.coalesce(F.nullif(squeeze(F.coalesce(label, F.lit(""))), F.lit("")), order.cast("string")))
    return F.concat_ws("/", F.nullif(parent, F.lit("")), own)


def heading_label(kind: Column, label: Column, title: Column, text: Column) -> Column:
    """What a node adds to a heading path; null for paragraphs."""
    lab, tit = F.nullif(squeeze(F.coalesce(label, F.lit(""))), F.lit("")), F.nullif(squeeze(F.coalesce(title, F.lit(""))), F.lit(""))
    return F.when(kind == "paragraph", F.lit(None)).when(kind == "title", F.nullif(squeeze(F.coalesce(text, F.lit(""))), F.lit(""))).otherwise(F.nullif(F.concat_ws(" ", lab, tit), F.lit("")))


def rendered_node(label: Column, loc: Column, text: Column) -> Column:
    """A node's text below its label and locator, unless that line says the same."""
    head = F.array_join(F.array_distinct(F.array_compact(F.array(F.nullif(squeeze(label), F.lit("")), F.nullif(squeeze(loc), F.lit(""))))), " ")
    body = F.trim(F.coalesce(text, F.lit("")))
    return F.when((head == "") | (head == body), body).otherwise(F.concat(head, F.lit("\n"), body))


def common_path(a: Column, b: Column, sep: str = " > ") -> Column:
    """Longest common prefix of two heading paths."""
    pairs = F.arrays_zip(F.split(a, sep).alias("l"), F.split(b, sep).alias("r"))
    same = F.aggregate(pairs, F.struct(F.lit(True).alias("on"), F.array().cast("array<string>").alias("parts")), lambda s, p: F.struct((s["on"] & p["l"].eqNullSafe(p["r"]) & p["l"].isNotNull()).alias("on"), F.when(s["on"] & p["l"].eqNullSafe(p["r"]) & p["l"].isNotNull(), F.array_append(s["parts"], p["l"])).otherwise(s["parts"]).alias("parts")))
    return F.array_join(same["parts"], sep)


def context_key(path: Column, sep: str = " > ") -> Column:
    """The first two elements of a heading path."""
    return F.array_join(F.slice(F.split(path, sep), 1, 2), sep)


def citation(code: Column, loc: Column, heading: Column) -> Column:
    """Code, locator and heading joined; '-' for nothing."""
    full = lambda c: F.nullif(F.trim(c), F.lit(""))
    parts = F.array_compact(F.array(full(code), F.concat(F.lit("п. "), full(loc)), full(heading)))
    return F.when(F.size(parts) == 0, F.lit("-")).otherwise(F.array_join(parts, " | "))


def evidence_ids(c: Column) -> Column:
    """Each evidence id named in a text, once, in order."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit("ev-[0-9]{4}"), F.lit(0)))


def answer_mode(c: Column, default: str = "no_answer") -> Column:
    """A whitelisted answer mode, else the default."""
    low = F.lower(F.trim(c))
    return F.when(low.isin("direct", "partial", "clarify", "no_answer"), low).otherwise(F.lit(default))


def chunks(c: Column, size: int = 120) -> Column:
    """A text in pieces of ``size`` characters for streaming; none for an empty one."""
    n = F.ceil(F.length(c) / F.lit(size)).cast("int")
    return F.when(F.length(c) > 0, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: F.substring(c, i * size + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def format_bytes(c: Column) -> Column:
    """A size in B, KB, MB or GB."""
    return (
        F.when(c < 1024, F.concat(c.cast("string"), F.lit(" B")))
        .when(c < 1024**2, F.format_string("%.1f KB", c / F.lit(1024.0)))
        .when(c < 1024**3, F.format_string("%.1f MB", c / F.lit(1024.0**2)))
        .otherwise(F.format_string("%.1f GB", c / F.lit(1024.0**3)))
    )


def log_json(**fields: Column) -> Column:
    """A structured log record; null fields are left out."""
    return F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()]))
