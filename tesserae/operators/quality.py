"""Predicates on titles, listings and bodies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tesserae.functions.text import count_phrase, measure, phrases_in

# The patterns that mark a title as a report rather than a speech, in their order.
TITLE_PATTERNS = [
    "贺信", "贺电", "致贺信", "致电祝贺", "学习贯彻", "各地", "《求是》杂志发表", "签署通令", "举行会谈", "同.*会谈", "会见",
    "考察时", "时强调", "发表重要讲话强调", "作出重要指示", "主持召开", "看望慰问", "回信", "评论员", "学习体会", "贯彻落实", "综述",
]
# A pattern that does not count where the first expression matches and the second does not.
TITLE_EXCEPTIONS = {"会见": ("会见.{0,80}时的(?:讲话|演讲)", None), "学习贯彻": ("上的讲话", "强调|考察时|主持召开|在京召开")}
# Fixed value: what the title of a speech or signed article holds.
SPEECH_TITLE = "讲话|主旨演讲|主旨发言|书面演讲|署名|重要文章|习近平："


def title_skip(title: Column, patterns: list[str] = TITLE_PATTERNS, exceptions: dict = TITLE_EXCEPTIONS) -> Column:
    """Why a title is skipped: ``empty_title`` or the first pattern that matches; null where it stays."""
    text = F.trim(F.coalesce(title, F.lit("")))

    def hit(p: str) -> Column:
        found = text.rlike(p)
        if p in exceptions:
            unless, but = exceptions[p]
            spared = text.rlike(unless)
            found = found & ~(spared & ~text.rlike(but) if but else spared)
        return F.when(found, F.lit(p))

    return F.coalesce(F.when(text == "", F.lit("empty_title")), *map(hit, patterns))


def body_too_short(body: Column, least: int = 200) -> Column:
    return measure(body) < least


def listing_skip(title: Column, snippet: Column, phrases: Column) -> Column:
    """A reason where neither title nor snippet holds a phrase."""
    blob = F.concat(F.coalesce(title, F.lit("")), F.lit("\n"), F.coalesce(snippet, F.lit("")))
    return F.when(F.size(phrases_in(blob, phrases)) == 0, F.lit("no_theme_signal_in_title_or_snippet"))


def relevance_skip(
    title: Column, body: Column, keyword: Column, phrases: Column, speech: str = SPEECH_TITLE, least_hits: int = 3, least_kinds: int = 2
) -> Column:
    """Why a document that only mentions the topic is skipped, with its counts; null where it stays.

    It stays if its title names the topic and its body does as well, or if it has the title of a speech and a body
    with enough different phrases or enough occurrences of the keyword.
    """
    title, body = F.coalesce(title, F.lit("")), F.coalesce(body, F.lit(""))
    phrases = F.array_distinct(F.filter(F.concat(F.array(keyword), phrases), lambda p: F.length(p) > 0))
    in_title, in_body = phrases_in(title, phrases), phrases_in(body, phrases)
    total = F.aggregate(phrases, F.lit(0), lambda n, p: n + count_phrase(body, p))
    hits, speech_like = count_phrase(body, keyword), title.rlike(speech)
    named = F.size(in_title) > 0
    keep = (named & ((F.size(in_body) > 0) | F.contains(title, keyword))) | (
        speech_like & (((F.size(in_body) >= least_kinds) & (total >= 3)) | ((F.length(keyword) > 0) & (hits >= least_hits)))
    )
    why = F.concat(
        F.lit("weak_topic_match:distinct="), F.size(in_body).cast("string"), F.lit(",hits="), total.cast("string"),
        F.lit(",keyword_hits="), hits.cast("string"),
        F.when(named, F.concat(F.lit(",title_theme="), F.try_element_at(in_title, F.lit(1)))).otherwise(""),
        F.when(speech_like, ",speech_like_title").otherwise(""),
    )
    return F.when(~speech_like & ~named, F.lit("not_speech_or_theme_title")).when(~keep, why)
