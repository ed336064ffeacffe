"""Snippets of DuckDB SQL for the independent counterparts of the queries."""

from __future__ import annotations

WS = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
DASH = r"[\x{2010}\x{2011}\x{2012}\x{2013}\x{2014}\x{2015}]+"


def squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, '{WS}+', ' ', 'g'), ' ')"


def blank(x: str) -> str:
    return f"coalesce(length({squeeze(x)}) = 0, true)"


def clean_code(x: str) -> str:
    dashed = squeeze(f"regexp_replace({x}, '{DASH}', '-', 'g')")
    tight = f"regexp_replace(regexp_replace({dashed}, ' *- *', '-', 'g'), ' */ *', '/', 'g')"
    return f"trim(regexp_replace({tight}, '[;:,]+$', ''), ' ')"


def code(x: str) -> str:
    return f"upper({clean_code(x)})"


def tokens(x: str) -> str:
    return f"list_filter(regexp_extract_all(lower(coalesce({x}, '')), '[0-9a-zа-яё]+'), lambda t: length(t) > 1 or regexp_full_match(t, '[0-9]'))"


def lines(x: str) -> str:
    broken = f"regexp_replace(coalesce({x}, ''), '\\r\\n|\\r', chr(10), 'g')"
    return f"list_filter(list_transform(string_split({broken}, chr(10)), lambda l: {squeeze('l')}), lambda l: l <> '')"


def family(x: str) -> str:
    c = code(f"coalesce({x}, '')")
    return f"CASE WHEN regexp_matches({c}, '^[A-ZА-ЯЁ]+ *[0-9]+') THEN regexp_extract({c}, '^([A-ZА-ЯЁ]+) *([0-9]+)', 1) || regexp_extract({c}, '^([A-ZА-ЯЁ]+) *([0-9]+)', 2) ELSE regexp_replace({c}, '[.\\-/][0-9]{{4}}$', '') END"


def once(name: str, key: str, columns: str) -> str:
    """The rows of a table with repeated rows counted once."""
    return f"(SELECT DISTINCT {key}, {columns} FROM {name} WHERE {key} IS NOT NULL)"
