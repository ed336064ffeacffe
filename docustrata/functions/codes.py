"""Document codes: types, families, years, variants and aliases."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docustrata.functions.text import clean_code, let, normalize_code, squeeze

#: Spellings of each code prefix.
PREFIX_VARIANTS = {"SP": ["SP", "СП"], "СП": ["СП", "SP"], "SNIP": ["SNIP", "СНИП", "СНиП"], "СНИП": ["СНИП", "SNIP", "СНиП"], "GOST": ["GOST", "ГОСТ"], "ГОСТ": ["ГОСТ", "GOST"]}
#: Code prefixes and document types.
TYPES = {"СП": "sp", "SP": "sp", "СНИП": "snip", "SNIP": "snip", "ГОСТ": "gost", "GOST": "gost", "ФЗ": "federal_law", "ФЕДЕРАЛЬНЫЙ": "federal_law"}
#: Where a code stands in running text, and locators, in a form that Java and RE2 read alike.
CODE_IN_TEXT = "(?:СП|СНИП|ГОСТ|SP|SNIP|GOST|сп|снип|СНиП|СниП|гост|Гост|sp|snip|SNiP|gost)[ ]*[A-Za-zА-Яа-я0-9][A-Za-zА-Яа-я0-9./-]*"
LOCATOR_IN_TEXT = "(?:пункт|раздел|глава|табл\\.?|таблица|section|chapter|table|п\\.?)[ ]*[0-9]+(?:\\.[0-9]+)*"
APPENDIX_IN_TEXT = "(?:приложение|прил\\.?|appendix)[ ]*[A-Za-zА-Яа-я](?:[^A-Za-zА-Яа-яЁё0-9_]|$)"


def document_type(code: Column) -> Column:
    """Type by the code's prefix, 'unknown' for others."""
    first = F.split_part(normalize_code(code), F.lit(" "), F.lit(1))
    out = F.when(first.isin(*[k for k, v in TYPES.items() if v == "sp"]), "sp")
    for kind in ("snip", "gost", "federal_law"):
        out = out.when(first.isin(*[k for k, v in TYPES.items() if v == kind]), kind)
    return out.otherwise("unknown")


def family(code: Column) -> Column:
    """Prefix and first number; where digits don't follow the first word, the code without its year."""

    def of(norm: Column) -> Column:
        word, number = F.regexp_extract(norm, "^([A-ZА-ЯЁ]+)[ ]*([0-9]+)", 1), F.regexp_extract(norm, "^([A-ZА-ЯЁ]+)[ ]*([0-9]+)", 2)
        return F.when(number != "", F.concat(word, number)).otherwise(F.regexp_replace(norm, "[.\\-/][0-9]{4}$", ""))

    return let(normalize_code(F.coalesce(code, F.lit(""))), of)


def scoring_family(code: Column) -> Column:
    """The family used in evaluation: lower case, squeezed, without its year."""
    return F.regexp_replace(F.lower(squeeze(F.coalesce(code, F.lit("")))), "[.\\-/][0-9]{4}$", "")


def document_hint(code: Column) -> Column:
    """Prefix and first segment, lower case."""
    norm = normalize_code(code)
    rest = F.split_part(F.split_part(norm, F.lit(" "), F.lit(-1)), F.lit("."), F.lit(1))
    return F.lower(F.concat_ws(" ", F.split_part(norm, F.lit(" "), F.lit(1)), rest))


def year(c: Column) -> Column:
    """The first 19xx or 20xx anywhere in the text, null if there is none."""
    return F.nullif(F.regexp_extract(c, "(?:19|20)[0-9]{2}", 0), F.lit("")).cast("int")


def split_code(clean: Column) -> tuple[Column, Column]:
    """Prefix, and the rest after the first blank ('' if there is none)."""
    at = F.instr(clean, " ")
    return F.when(at > 0, F.substring(clean, F.lit(1), at - 1)).otherwise(clean), F.when(at > 0, F.substring(clean, at + 1, F.length(clean))).otherwise("")


def code_variants(code: Column) -> Column:
    """Forms under which a typed code may be stored: itself, written together, without year, first segment; each once, in order."""
    missing = F.lit(None).cast("string")

    def of(norm: Column, prefix: Column, rest: Column, yearless: Column, first: Column) -> Column:
        both = lambda tail: [F.concat(prefix, F.lit(" "), tail), F.concat(prefix, tail)]
        some = [norm, F.concat(prefix, rest), *[F.when((yearless != "") & (yearless != rest), x).otherwise(missing) for x in both(yearless)], *[F.when(first != "", x).otherwise(missing) for x in both(first)]]
        full = F.array_distinct(F.array_compact(F.array(*some)))
        return F.when(norm == "", F.array().cast("array<string>")).when(rest == "", F.array(norm)).otherwise(full)

    parts = lambda norm: let(F.struct(*[x.alias(n) for x, n in zip(split_code(norm), ("p", "r"))]), lambda s: let(F.struct(F.regexp_replace(s["r"], "[-./][0-9]{4}$", "").alias("y"), F.split_part(s["r"], F.lit("."), F.lit(1)).alias("f")), lambda t: of(norm, s["p"], s["r"], t["y"], t["f"])))
    return let(normalize_code(code), parts)


def shortened(rest: Column) -> Column:
    """Shorter tails of a code: without year, first segment, first two segments; distinct."""
    pieces = F.split(rest, "\\.")
    n = F.size(pieces)
    dash = F.when(rest.rlike("^.+-[0-9]{4}$"), F.regexp_replace(rest, "-[0-9]{4}$", ""))
    dot = F.when((n >= 3) & rest.rlike("\\.[0-9]{4}$"), F.regexp_replace(rest, "\\.[0-9]{4}$", ""))
    two = F.when(n >= 2, F.array_join(F.slice(pieces, 1, 2), "."))
    return F.array_distinct(F.array_compact(F.array(F.nullif(rest, F.lit("")), dash, dot, F.nullif(pieces[0], F.lit("")), two)))


def code_aliases(code: Column) -> Column:
    """All spellings of a code: prefix variants, with and without blank, with shorter tails; distinct."""
    known = F.create_map(*[x for k, v in PREFIX_VARIANTS.items() for x in (F.lit(k), F.array(*[F.lit(p) for p in v]))])

    def of(clean: Column, prefix: Column, rest: Column) -> Column:
        prefixes = F.coalesce(F.element_at(known, F.upper(prefix)), F.array(prefix))
        made = let(shortened(rest), lambda tails: F.flatten(F.transform(prefixes, lambda p: F.flatten(F.transform(tails, lambda r: F.array(F.concat(p, F.lit(" "), r), F.concat(p, r)))))))
        return F.when(F.coalesce(clean == "", F.lit(True)), F.array().cast("array<string>")).when(rest == "", F.array(clean)).otherwise(F.array_distinct(F.concat(F.array(clean), made)))

    return let(clean_code(code), lambda c: let(F.struct(*[x.alias(n) for x, n in zip(split_code(c), ("p", "r"))]), lambda s: of(c, s["p"], s["r"])))


def alias_form(c: Column) -> Column:
    """Lookup form of an alias: of a URL host, path and query; of others words without punctuation; lower case; null for nothing."""

    def of(s: Column) -> Column:
        url = F.regexp_extract(s, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)([^?#]*)", 1)
        path = F.regexp_replace(F.regexp_extract(s, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)([^?#]*)", 2), "/+$", "")
        query = F.regexp_extract(s, "^[^?#]*(\\?[^#]+)", 1)
        words = F.trim(F.regexp_replace(s, "[ ,;:()\\\\\\[\\]\"'`]+", " "))
        return F.nullif(F.lower(F.when(url != "", F.concat(url, path, query)).otherwise(words)), F.lit(""))

    return let(squeeze(c), of)


def compact_title(c: Column) -> Column:
    """A title's first sentence."""
    return F.nullif(F.substring_index(squeeze(c), ". ", 1), F.lit(""))


def is_placeholder(code: Column, title: Column) -> Column:
    """A document known by a stub code alone."""
    return F.coalesce(code.rlike("^(?:СП|SP) [0-9]+\\.0$") & (title == code), F.lit(False))


def is_legacy(code: Column, title: Column) -> Column:
    """An older kind of document: building rules of the former series, or a manual."""
    return F.coalesce(F.upper(code).startswith("СНИП"), F.lit(False)) | F.coalesce(F.upper(code).startswith("SNIP"), F.lit(False)) | F.coalesce(F.lower(title).contains("пособ"), F.lit(False))
