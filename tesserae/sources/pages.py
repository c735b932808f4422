"""Web pages and search results: fields from HTML and URLs."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tesserae.sources.elements import SILENT, Element, tree

# Elements whose content is no text.
SKIPPED = {"script", "style", "button", "video"}


class _Page(HTMLParser):
    """Title, headings, paragraphs without inner paragraphs, and list items with their links."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.skip, self.open, self.paragraphs, self.headings, self.links, self.all, self.title = 0, [], [], {}, [], [], []
        self.where: list[str] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in SKIPPED:
            self.skip += 1
        elif tag == "br":
            self.handle_data("\n")
        elif tag == "p":
            if self.open:
                self.open[-1] = None  # holds another paragraph
            self.open.append([])
        elif tag in ("h1", "h3", "title", "a"):
            self.where.append(tag)
            if tag == "a":
                self.links.append([dict(attrs).get("href") or "", ""])

    def handle_endtag(self, tag: str) -> None:
        if tag in SKIPPED:
            self.skip = max(0, self.skip - 1)
        elif tag == "p" and self.open:
            own = self.open.pop()
            if own is not None:
                self.paragraphs.append("".join(own))
        elif tag in self.where:
            self.where.remove(tag)

    def handle_data(self, data: str) -> None:
        if self.skip:
            return
        for tag in self.where:
            if tag == "a":
                self.links[-1][1] += data
            else:
                self.headings[tag] = self.headings.get(tag, "") + data
        if "title" not in self.where:
            self.all.append(data)
        if self.open and self.open[-1] is not None:
            self.open[-1].append(data)


def tidy(text: str) -> str:
    """NBSP to a blank, no blanks around line ends, ASCII trim; U+3000 stays."""
    return re.sub(r"[ \t]*\n[ \t]*", "\n", text.replace("\xa0", " ")).strip(" \t\r\n")


def parsed(html: str | None) -> dict:
    page = _Page()
    page.feed(html or "")
    page.close()
    title = tidy(page.headings.get("h1") or page.headings.get("title") or "")
    under = tidy(page.headings.get("h3") or "")
    parts = [x for x in map(tidy, page.paragraphs) if x] or [x for x in [tidy("".join(page.all))] if x]
    error = "missing_title" if not title else "empty_body" if not parts else None
    return {
        "title": title + under if under and under not in title else title,
        "body": "\n\n".join(parts), "error": error, "links": [{"href": h, "text": tidy(t)} for h, t in page.links],
    }


def page_fields(html: Column) -> Column:
    """struct(title, body, error, links) of each page; HTML has no built-in parser, so an Arrow batch function."""
    kind = "struct<title: string, body: string, error: string, links: array<struct<href: string, text: string>>>"
    return F.pandas_udf(lambda pages: pd.DataFrame([parsed(p) for p in pages], columns=["title", "body", "error", "links"]), kind).asNondeterministic()(html)


# Where article ids, origins and dates stand.
ARTICLE_ID = r"(?:article/)?(\d{5,})"
ORIGIN, ORIGIN_END = "来源：", r"(?:发布时间|\[\d{4}-|$)"
MARKED_DATE, ANY_DATE = r"发布时间：\s*(\d{4}-\d{2}-\d{2})", r"(\d{4}-\d{2}-\d{2})"
# Elements of an article that are no part of its body.
JUNK = SILENT | {"img", "video", "button", "input"}


def visible(element: Element | None) -> str:
    """Text as a reader sees it in one place: tidy, with runs of blanks as one."""
    return re.sub("[ \t]{2,}", " ", tidy(element.text())) if element else ""


def _found(pattern: str, text: str) -> str | None:
    match = re.search(pattern, text)
    return match[1].strip() or None if match else None


def _meta(text: str) -> tuple[str | None, str | None]:
    """Origin and date in the visible text of a block."""
    return _found(rf"{ORIGIN}\s*(.*?)\s*{ORIGIN_END}", text), _found(MARKED_DATE, text) or _found(ANY_DATE, text)


def body_paragraphs(element: Element) -> list[str]:
    """Texts of the paragraphs that hold no other paragraph; without any paragraph, that of the whole element."""
    inner = lambda e: (x for x in e.walk(JUNK) if isinstance(x, Element) and x.tag == "p")
    leaves = [p for p in inner(element) if next(inner(p), None) is None] or [element]
    return [x for x in (tidy(p.text(JUNK)) for p in leaves) if x]


def listed(html: str | None, base: str, hits: str, total: str, row: str, id_pattern: str) -> dict:
    """Total, hits and error of a page of search results; see ``search_results``."""
    page, out, last = tree(html), [], None
    shown = page.first(total)
    number = "".join(x.strip() for x in shown.walk() if isinstance(x, str)) if shown else ""
    place = page.first(hits)
    for item in place.select(row) if place else ():
        link = next((a for a in item.select("a") if "href" in a.attrs), None)
        if link:
            match = re.search(id_pattern, link.attrs["href"])
            if match:
                origin, date = _meta(visible(item))
                last = {"article_id": match[1], "title": visible(link), "url": f"{base}/article/{match[1]}", "date": date, "origin": origin, "snippet": ""}
                out.append(last)
        elif last and not last["snippet"]:
            last["snippet"] = visible(item.first("p"))
    return {"total": int(number) if number.isdecimal() else None, "hits": out, "error": None if place else "missing_list"}


def search_results(
    html: Column, base: str = "", hits: str = "#news_list", total: str = "#totalCount", row: str = "li", id_pattern: str = ARTICLE_ID
) -> Column:
    """struct(total, hits, error) of each page of search results.

    A row with a link whose address holds an id is a hit; a row without a link gives the hit before it a snippet, if
    that has none yet. Rows whose link has no id are passed over. ``total`` is null where it is absent or no number,
    ``error`` is ``missing_list`` where there is no list. Selectors are of the form ``tag#id.class``, nested by blanks.
    """
    hit = "struct<article_id: string, title: string, url: string, date: string, origin: string, snippet: string>"
    work = lambda pages: pd.DataFrame([listed(p, base, hits, total, row, id_pattern) for p in pages], columns=["total", "hits", "error"]).astype({"total": "Int64"})
    return F.pandas_udf(work, f"struct<total: long, hits: array<{hit}>, error: string>").asNondeterministic()(html)


def detailed(html: str | None, container: str, meta: str, body: str, closed: bool = False) -> dict:
    """Fields and error of an article's page; see ``detail_fields``."""
    out = dict.fromkeys(("title", "subtitle", "date", "origin", "body", "error"))
    place = tree(html, closed).first(container)
    if not place:
        return out | {"error": "missing_container"}
    title, under = visible(place.first("h1")), visible(place.first("h3"))
    found = [_meta(visible(x)) for x in place.select(meta)] if meta else []
    text = body and (place if body == container else place.first(body))
    parts = body_paragraphs(text) if text else []
    error = "missing_body" if not text else "missing_title" if not title else None if "".join(parts).strip() else "empty_body"
    both = f"{title} {under}".strip() if under and under not in title else title
    origin, date = (next((x[k] for x in found if x[k]), None) for k in (0, 1))
    return {"title": both, "subtitle": under or None, "date": date, "origin": origin, "body": "\n\n".join(parts), "error": error}


def detail_fields(
    html: Column, container: str = "div.d2txt", meta: str = "div.d2txt_1", body: str = "div.d2txt_con", closed: bool = False
) -> Column:
    """struct(title, subtitle, date, origin, body, error) of each article's page, all from within ``container``.

    The title is the h1 with the h3 behind it, unless it holds that already; origin and date are the first that a
    block of ``meta`` states. ``error`` names the first of missing_container, missing_body, missing_title, empty_body.
    ``closed``: a cut reference such as ``&amp`` is text; see ``tree``.
    """
    names = ["title", "subtitle", "date", "origin", "body", "error"]
    work = lambda pages: pd.DataFrame([detailed(p, container, meta, body, closed) for p in pages], columns=names)
    return F.pandas_udf(work, ", ".join(f"{n} string" for n in names)).asNondeterministic()(html)


def search_url(base: str, keyword: Column, page: Column, form: str = "") -> Column:
    """The address of a page of search results."""
    rest = [F.lit("&isFuzzy=1&searchArea=0&sortType=2&page="), page.cast("string")] + ([F.lit(f"&form={form}")] if form else [])
    return F.concat(F.lit(f"{base}/result?keywords="), F.url_encode(keyword), *rest)


def article_id(url: Column) -> Column:
    """The first number of five or more digits, after ``article/`` or not."""
    return F.nullif(F.regexp_extract(url, ARTICLE_ID, 1), F.lit(""))


def origin(text: Column) -> Column:
    """What stands between the origin mark and the date mark."""
    return F.nullif(F.trim(F.regexp_extract(text, rf"(?U){ORIGIN}\s*(.*?)\s*{ORIGIN_END}", 1)), F.lit(""))


def published(text: Column) -> Column:
    """The date after its mark, else the first date."""
    marked = F.nullif(F.regexp_extract(text, MARKED_DATE, 1), F.lit(""))
    return F.coalesce(marked, F.nullif(F.regexp_extract(text, ANY_DATE, 1), F.lit("")))
