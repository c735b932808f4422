"""Raw Markdown of found articles, and canonical Markdown in its order of keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tesserae.functions.text import ascii_trim, once, unicode_trim

# Keys in the order in which they are written.
RAW_KEYS = ["id", "title", "date", "source", "origin", "url", "article_id"]
RAW_LISTS = ["retrieval_keywords", "themes"]
CANONICAL_KEYS = ["speechId", "title", "date", "source", "origin", "url", "article_id", "canonical_note", "sha256", "raw_path"]

_LINE_END = "[\n\x0b\x0c\x1c-\x1e\x85  ]"


def quoted(x: Column) -> Column:
    """A value of these files: in quotes where it is empty, starts with a mark or holds one; null is ``null``."""
    marked = (x == "") | x.rlike("[:#{}\\[\\]&*!|>'\"%@`]|\\A[-?]")
    inner = F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.when(x.isNull(), "null").when(marked, F.concat(F.lit('"'), inner, F.lit('"'))).otherwise(x)


def _parts(content: Column) -> Column:
    """What stands before, between and after the first two ``---``."""
    return F.split(F.regexp_replace(F.coalesce(content, F.lit("")), "\r\n?", "\n"), "---", 3)


def _body(rest: Column) -> Column:
    """struct(heading or null, text) of what follows the front matter."""

    def cut(rest: Column) -> Column:
        headed = F.startswith(rest, F.lit("#"))
        heading = F.when(headed, ascii_trim(F.regexp_extract(rest, r"\A#([^\n]*)", 1)))
        text = F.when(headed, F.regexp_replace(rest, r"\A[^\n]*\n*", "")).otherwise(rest)
        return F.struct(heading.alias("heading"), F.rtrim(text, F.lit("\n")).alias("text"))

    return once(F.ltrim(rest, F.lit("\n")), cut)


def _fields(front: Column) -> Column:
    """Map of the keys and values between the marks."""
    lines = F.filter(F.split(front, _LINE_END), lambda s: F.contains(s, F.lit(":")) & ~s.rlike(r"(?U)^\s*-"))
    pair = lambda s: F.struct(
        unicode_trim(F.regexp_extract(s, r"(?s)^([^:]*):", 1)).alias("key"),
        F.btrim(unicode_trim(F.regexp_extract(s, r"(?s)^[^:]*:(.*)$", 1)), F.lit('"')).alias("value"),
    )
    kept = F.filter(F.transform(lines, pair), lambda x: ~x["key"].isin(*RAW_LISTS) & ~x["value"].isin("", "[]"))
    after = lambda own, x, i: F.exists(F.slice(own, i + 2, F.size(own)), lambda y: y["key"] == x["key"])
    last = once(kept, lambda own: F.filter(own, lambda x, i: ~after(own, x, i)))
    return F.map_from_entries(F.transform(last, lambda x: F.struct(x["key"], F.nullif(x["value"], F.lit("null")))))


def parsed_raw(content: Column) -> Column:
    """struct(fields, body, error) of a raw file; ``error`` is ``no_front_matter`` where two ``---`` are not there.

    Fields are the ``key: value`` lines, quotes around values taken off; the last of equal keys counts. Items, lists,
    empty values and ``[]`` are passed over, ``null`` gives null. The heading is the title where there is none.
    """

    def titled(fields: Column, heading: Column) -> Column:
        untitled = (F.coalesce(F.try_element_at(fields, F.lit("title")), F.lit("")) == "") & heading.isNotNull()
        without = F.map_filter(fields, lambda k, v: k != "title")
        return F.when(untitled, F.map_concat(without, F.create_map(F.lit("title"), heading))).otherwise(fields)

    def whole(parts: Column) -> Column:
        none = F.lit(None).cast("string")
        good = lambda own: once(_fields(F.element_at(parts, 2)), lambda m: F.struct(titled(m, own["heading"]).alias("fields"), own["text"].alias("body"), none.alias("error")))
        bad = F.struct(F.lit(None).cast("map<string, string>").alias("fields"), none.alias("body"), F.lit("no_front_matter").alias("error"))
        return F.when(F.size(parts) == 3, once(_body(F.element_at(parts, 3)), good)).otherwise(bad)

    return once(_parts(content), whole)


def _whole(head: list[Column], title: Column, text: Column) -> Column:
    heading = ascii_trim(F.coalesce(title, F.lit("")))
    return F.concat(
        F.concat_ws("\n", F.lit("---"), *head, F.lit("---")), F.lit("\n\n"), F.when(heading != "", F.concat(F.lit("# "), heading)).otherwise("#"),
        F.lit("\n\n"), F.rtrim(F.coalesce(text, F.lit("")), F.lit("\n")), F.lit("\n"),
    )


def rendered_raw(record: dict[str, Column], lists: dict[str, Column], text: Column) -> Column:
    """A raw file: the keys of the record in their order, null as ``null``, both lists (``[]`` if empty), heading, text."""
    head = [F.concat(F.lit(f"{k}: "), quoted(record[k])) for k in RAW_KEYS if k in record]
    for k in RAW_LISTS:
        items = F.coalesce(lists[k], F.array().cast("array<string>")) if k in lists else F.array().cast("array<string>")
        shown = F.when(F.size(items) > 0, F.array_join(F.transform(items, lambda x: F.concat(F.lit("  - "), quoted(x))), "\n"))
        head.append(F.concat(F.lit(f"{k}:\n"), F.coalesce(shown, F.lit("  []"))))
    return _whole(head, record.get("title", F.lit("")), text)


def rendered_canonical(record: dict[str, Column], text: Column) -> Column:
    """A canonical file: the keys of the record that are neither null nor empty, in their order, heading and text."""
    given = lambda k: F.when(F.coalesce(record[k], F.lit("")) != "", F.concat(F.lit(f"{k}: "), quoted(record[k])))
    return _whole([given(k) for k in CANONICAL_KEYS if k in record], record.get("title", F.lit("")), text)


def rewritten(content: Column, record: dict[str, Column], lists: dict[str, Column]) -> Column:
    """The file with its front matter and heading written anew and its text kept; null where it has no front matter."""
    text = lambda parts: _body(F.element_at(parts, 3))["text"]
    return once(_parts(content), lambda parts: F.when(F.size(parts) == 3, rendered_raw(record, lists, text(parts))))
