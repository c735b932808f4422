"""Paragraph rules: what of a document is body, note or to be dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.functions.text import ascii_trim, compact, measure

# Pattern, action and reason of each paragraph rule, in the order in which they are tried.
RULES: list[tuple[str, str, str]] = [
    ("^(习近平|习近平主席)$", "drop", "author_byline"),
    ("^（?新华社[^）\n]{1,40}电）?$", "drop", "xinhua_dateline"),
    (r"^《\s*人民日报\s*》\s*（\s*\d{4}年\d{1,2}月\d{1,2}日[^）]*版\s*）$", "drop", "people_daily_edition"),
    (r"(新华社记者|本报记者|新华社发|记者).{0,80}[／/]?\s*摄\s*$", "drop", "photo_caption"),
    (r"(图为|这是\d|资料照片|资料图).{0,400}[／/]?\s*摄\s*$", "drop", "photo_caption"),
    ("^※", "note", "source_note"),
    (r"^（\d{4}年\d{1,2}月\d{1,2}日[^）]{0,40}）$", "note", "speech_date_line"),
    (r"^(（?\s*(责任编辑|责编|编辑)\s*[：:].+）?)$", "drop", "editor_line"),
    ("^■", "drop", "pull_quote"),
    ("^（完）$", "drop", "the_end"),
    ("(?=[\\s\\S]*全文如下)^新华社.{0,40}电", "drop", "xinhua_lead"),
]
SPEAKER = "^习近平[：:]"  # fixed value: the speaker before a title
BLANK_LINES = r"\n[ \t]*\n+"


def paragraphs(text: Column, between: str = BLANK_LINES) -> Column:
    """Paragraphs with their characters unchanged; blank ones left out."""
    lines = F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n?", "\n")
    return F.filter(F.split(lines, between), lambda p: F.length(ascii_trim(p)) > 0)


def is_title(paragraph: Column, title: Column) -> Column:
    """The paragraph repeats the title, with or without its speaker; a closing ``※`` or a heading mark does not matter."""
    bare = lambda p: ascii_trim(F.rtrim(p, F.lit("※")))
    text, want = compact(paragraph), ascii_trim(F.coalesce(title, F.lit("")))
    heading = F.when(F.startswith(text, F.lit("#")), ascii_trim(F.substring(text, F.lit(3), F.length(text)))).otherwise(text)
    short = ascii_trim(F.regexp_replace(want, SPEAKER, ""))
    same = lambda p: (p != "") & ((p == want) | ((short != "") & (p == short)))
    return (want != "") & (same(bare(text)) | same(bare(compact(heading))))


def classify(paragraph: Column, title: Column | None = None, rules: list[tuple[str, str, str]] = RULES) -> Column:
    """struct(action, reason): keep, drop or note, by the first rule that matches."""
    text = compact(paragraph)
    out = lambda action, reason: F.struct(F.lit(action).alias("action"), F.lit(reason).cast("string").alias("reason"))
    case = F.when(text == "", out("drop", "empty_paragraph"))
    if title is not None:
        case = case.when(is_title(paragraph, title), out("drop", "duplicate_title"))
    for pattern, action, reason in rules:
        case = case.when(text.rlike(pattern), out(action, reason))
    return case.otherwise(out("keep", None))


# Noise that cleaning should have taken out, and titles of news rather than of speeches.
INLINE_NOISE = r"（新华社[^）]{0,40}电）|/摄|新华社记者|《\s*人民日报\s*》|全文如下"
NEWS_TITLE = "强调|主持|在京召开|作出重要指示|李克强主持|看望慰问"


def review_flags(title: Column | None, body: Column, kept: Column, least: int = 200, noise: str = INLINE_NOISE, news: str = NEWS_TITLE) -> Column:
    """Why a person should look at a cleaned document: empty_body or short_body, inline_noise_left, news_like_title.

    White space of any script does not count. Null counts as empty.
    """
    size = measure(body)
    empty = (kept == 0) | (size == 0)
    flags = [F.when(empty, "empty_body").when(size < least, "short_body"), F.when(body.rlike(f"(?U){noise}"), "inline_noise_left")]
    if title is not None:
        flags.append(F.when(title.rlike(news), "news_like_title"))
    return F.array_compact(F.array(*flags))


def run_summary(results: DataFrame, error: str = "error", flags: str = "flags") -> DataFrame:
    """One row for a run: how many documents are ok, failed, and are to be reviewed (ok, with a flag)."""
    ok = F.col(error).isNull()
    return results.agg(F.count_if(ok).alias("ok"), F.count_if(~ok).alias("errors"), F.count_if(ok & (F.size(flags) > 0)).alias("review"))


def cleaned(docs: DataFrame, text: str, title: str | None = None, between: str = BLANK_LINES, rules=RULES, least: int = 200) -> DataFrame:
    """Adds body, note, sha256, removed (reason, text), paragraphs_in, paragraphs_kept, chars_in, chars_out and flags.

    No shuffle: the paragraphs of a document stay in its row. Null text is an empty document.
    """
    parts = F.transform(
        paragraphs(F.col(text), between),
        lambda p: F.struct(p.alias("text"), classify(p, F.col(title) if title else None, rules).alias("own")),
    )
    of = lambda action: F.filter("_parts", lambda p: p["own"]["action"] == action)
    texts = lambda a: F.transform(a, lambda p: p["text"])
    out = docs.withColumn("_parts", parts)
    out = out.withColumn("body", F.array_join(texts(of("keep")), "\n\n"))
    out = out.withColumns(
        {
            "note": F.array_join(F.transform(of("note"), lambda p: compact(p["text"])), "\n"),
            "sha256": F.sha2("body", 256),
            "removed": F.transform(
                F.filter("_parts", lambda p: p["own"]["action"] != "keep"),
                lambda p: F.struct(
                    F.concat(F.when(p["own"]["action"] == "note", "moved:").otherwise(""), p["own"]["reason"]).alias("reason"), p["text"].alias("text")
                ),
            ),
            "paragraphs_in": F.size("_parts"),
            "paragraphs_kept": F.size(of("keep")),
            "chars_in": F.length(F.coalesce(F.col(text), F.lit(""))),
            "chars_out": F.length("body"),
            "flags": review_flags(F.col(title) if title else None, F.col("body"), F.size(of("keep")), least),
        }
    )
    return out.drop("_parts")
