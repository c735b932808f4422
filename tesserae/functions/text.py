"""Column functions for text rules: trims, lengths, phrases, ids, quotes and front matter."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

QUOTE = "\n\n【引用】"  # fixed value: where an asset's quotes begin


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def once(x: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once, however often ``f`` names it."""
    return F.element_at(F.transform(F.array(x), f), 1)


def ascii_trim(x: Column) -> Column:
    """Without blanks, tabs and line ends at either edge; U+3000 stays."""
    return F.btrim(x, F.lit(" \t\r\n"))


def compact(x: Column) -> Column:
    """ASCII trim, then no leading ideographic space: for matching only."""
    return F.regexp_replace(ascii_trim(F.coalesce(x, F.lit(""))), "^　+", "")


def unicode_trim(x: Column) -> Column:
    """Without white space of any script, and U+FEFF, at either edge."""
    return F.regexp_replace(x, "(?U)^[\\s﻿]+|[\\s﻿]+$", "")


def measure(x: Column) -> Column:
    """Length in code points without white space of any script."""
    return F.length(F.regexp_replace(F.coalesce(x, F.lit("")), "(?U)\\s+", ""))


def utf16_length(x: Column) -> Column:
    """Length in UTF-16 units."""
    return (F.octet_length(F.encode(x, "UTF-16BE")) / 2).cast("int")


def count_phrase(x: Column, phrase: Column) -> Column:
    """Non-overlapping occurrences of a phrase; none for an empty one."""
    gone = F.length(x) - F.length(F.replace(x, phrase, F.lit("")))
    return F.when(F.length(phrase) > 0, (gone / F.length(phrase)).cast("int")).otherwise(0)


def phrases_in(x: Column, phrases: Column) -> Column:
    """The different non-empty phrases that a text contains, in their order."""
    return F.filter(F.array_distinct(phrases), lambda p: (F.length(p) > 0) & F.contains(x, p))


def ngrams(x: Column, n: int) -> Column:
    """All runs of n characters; none for a shorter text."""
    at = F.sequence(F.lit(1), F.length(x) - n + 1)
    return F.when(F.length(x) >= n, F.transform(at, lambda i: F.substring(x, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def blocks(x: Column, n: int) -> Column:
    """Every n-th run of n characters: neighbours that do not overlap. One pass over the text."""
    return F.regexp_extract_all(x, F.lit(f"(?s).{{{n}}}"), F.lit(0))


def first_sentence(x: Column, ends: str = "。！？\n") -> Column:
    """The first part between sentence ends that is not blank, else the whole; trimmed."""
    first = unicode_trim(F.regexp_extract(x, f"(?U)^[{ends}\\s﻿]*([^{ends}]+)", 1))
    return F.when(first != "", first).otherwise(unicode_trim(x))


def trimmed_values(values: Column) -> Column:
    """Trimmed, not empty, each once, in order."""
    return F.array_distinct(F.filter(F.transform(values, unicode_trim), lambda v: F.length(v) > 0))


def numbered_id(prefix: Column, number: Column, infix: str) -> Column:
    """prefix, infix and a number of three digits or more."""
    return F.concat(prefix, F.lit(infix), F.when(number < 1000, F.lpad(number.cast("string"), 3, "0")).otherwise(number.cast("string")))


def preview(x: Column, n: int = 80) -> Column:
    return F.when(F.length(x) > n, F.concat(F.substring(x, 1, n), F.lit("…"))).otherwise(x)


def ymd(x: Column) -> Column:
    """The first year-month-day of a text, as text."""
    return F.nullif(F.regexp_extract(x, r"(\d{4}-\d{2}-\d{2})", 1), F.lit(""))


def own_part(x: Column) -> Column:
    """What stands before the quotes."""
    at = F.instr(x, QUOTE)
    return F.when(at > 0, F.substring(x, F.lit(1), at - 1)).otherwise(x)


def quote_part(x: Column) -> Column:
    """The quotes with their mark, or nothing."""
    at = F.instr(x, QUOTE)
    return F.when(at > 0, F.substring(x, at, F.length(x))).otherwise("")


def filled(x: Column, quotes: Column) -> Column:
    """The text with each different non-empty quote after its mark."""
    marked = F.transform(F.filter(F.array_distinct(quotes), lambda q: F.length(q) > 0), lambda q: F.concat(F.lit("【引用】\n"), q))
    return F.when(F.size(marked) > 0, F.concat(x, F.lit("\n\n"), F.array_join(marked, "\n\n"))).otherwise(x)


def markers_replaced(x: Column, quotes: Column) -> Column:
    """``[[QUOTE:id]]`` becomes the quote of that id in a map, or nothing."""
    parts = F.split(x, r"\[\[QUOTE:")

    def piece(p: Column) -> Column:
        end = F.instr(p, "]]")
        known = F.coalesce(F.try_element_at(quotes, F.substring(p, F.lit(1), end - 1)), F.lit(""))
        return F.when(end > 0, F.concat(known, F.substring(p, end + 2, F.length(p)))).otherwise(F.concat(F.lit("[[QUOTE:"), p))

    rest = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), piece)
    return F.concat(F.element_at(parts, 1), F.array_join(rest, ""))


def yaml_scalar(x: Column) -> Column:
    """A front-matter value: quoted where it is empty, has a special character or could be read as another type."""
    special = x.rlike(r"""[:#\[\]{}"'\n]""") | x.rlike(r"^\s|\s$") | F.lower(x).isin("null", "true", "false", "") | x.rlike(r"^-?\d+(\.\d+)?$")
    escaped = F.concat(F.lit('"'), F.replace(F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n")), F.lit('"'))
    return F.when(x.isNull(), "null").when(special, escaped).otherwise(x)


def json_content(x: Column) -> Column:
    """The JSON text in a model's answer: a fenced block, else the whole, else from the first to the last brace."""
    fenced = F.nullif(F.regexp_extract(x, r"(?s)```(?:json)?\s*(.*?)```", 1), F.lit(""))
    braced = F.nullif(F.regexp_extract(x, r"(?s)(\{.*\})", 1), F.lit(""))
    valid = lambda j: F.when(F.try_parse_json(j).isNotNull(), ascii_trim(j))
    return F.coalesce(valid(fenced), valid(x), valid(braced))
