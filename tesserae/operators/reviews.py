"""What prompts, reviews and screens take from assets, materials and evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.functions.text import own_part, quote_part, unicode_trim
from tesserae.operators.fragments import contains_fragment, is_blank, strip_fragments

# What stands in for a reason, or a result, that a model did not give.
NO_REASON = "该候选与企业画像存在关联。引用原文由程序按 EvidenceRef 回填，不由模型生成。"


def quote_marker(chunk_id: Column) -> Column:
    return F.concat(F.lit("[[QUOTE:"), chunk_id, F.lit("]]"))


def evidence_key(document: Column, chunk: Column) -> Column:
    return F.concat(document, F.lit("::"), chunk)


def without_quotes(body: Column, quotes: Column) -> Column:
    """The body without its quotes, the longest taken out first, and without their marks."""
    longest = F.array_sort(F.filter(quotes, lambda q: F.length(q) > 0), lambda a, b: F.length(b) - F.length(a))
    bare = F.aggregate(longest, body, lambda text, q: F.replace(text, q, F.lit("\n")))
    return unicode_trim(F.regexp_replace(F.replace(bare, F.lit("【引用】"), F.lit("\n")), "\n{3,}", "\n\n"))


def body_paragraphs(body: Column) -> Column:
    """array<struct<text, quoted>>: what stands between empty lines, and whether it is a quote."""
    parts = F.filter(F.transform(F.split(body, "\n{2,}"), unicode_trim), lambda p: F.length(p) > 0)
    return F.transform(parts, lambda p: F.struct(p.alias("text"), F.startswith(p, F.lit("【引用】")).alias("quoted")))


def submitted_text(text: Column) -> Column:
    """An asset's text with its own words trimmed and its quotes as they were."""
    return F.concat(unicode_trim(own_part(text)), quote_part(text))


def normalized_assets(assets: Column) -> Column:
    """Assets as they are submitted: titles and own words trimmed, quotes byte for byte as they were."""
    return F.transform(assets, lambda a: a.withField("title", unicode_trim(a["title"])).withField("text", submitted_text(a["text"])))


def updated_text(text: Column, own: Column) -> Column:
    """An asset's text with other words of its own before the same quotes."""
    return F.concat(own, quote_part(text))


def same_ids(a: Column, b: Column) -> Column:
    """Whether two lists hold the same ids, each as often, in any order; null is an empty list."""
    none = F.array().cast("array<string>")
    return F.array_sort(F.coalesce(a, none)) == F.array_sort(F.coalesce(b, none))


# What is shown for a date that is not known, and of a text that only demonstrates.
NO_DATE, DEMO = "日期待考", "（演示占位文本）"


def provenances(refs: DataFrame, chunks: DataFrame, chunk_id: str, demo: str | None = None) -> DataFrame:
    """References with ``shown``: title, source and date of their chunk, or its id where the chunk is not known."""
    parts = F.concat_ws(" · ", "title", "source", F.coalesce("date", F.lit(NO_DATE)))
    shown = F.concat(parts, F.when(F.col(demo), DEMO).otherwise("")) if demo else parts
    known = chunks.select(F.col(chunk_id), shown.alias("_shown"))
    return refs.join(known, chunk_id, "left").withColumn("shown", F.coalesce("_shown", F.col(chunk_id).cast("string"))).drop("_shown")


def fixed(x: Column, digits: int = 4) -> Column:
    return F.format_string(f"%.{digits}f", x.cast("double"))


def label_of(code: Column, labels: dict[str, str]) -> Column:
    """The label of a code; the code itself where it has none."""
    known = F.create_map(*(F.lit(x) for pair in labels.items() for x in pair))
    return F.coalesce(F.try_element_at(known, code), code)


def labels_of(codes: Column, labels: dict[str, str]) -> Column:
    """Labels of an array of codes in order; codes without one are left out."""
    known = F.create_map(*(F.lit(x) for pair in labels.items() for x in pair))
    return F.filter(F.transform(codes, lambda c: F.try_element_at(known, c)), lambda x: x.isNotNull())


def prompt_profile(items: Column) -> Column:
    """Of each profile item what a prompt shows: id, value and origin."""
    return F.transform(items, lambda i: F.struct(i["id"].alias("id"), i["value"].alias("value"), i["origin"].alias("origin")))


def message_content(payload: Column) -> Column:
    """The text of a chat completion: its content, else the joined texts of its parts, else its reasoning; or null."""
    message = F.try_parse_json(payload)
    at = lambda field, kind: F.try_variant_get(message, f"$.choices[0].message.{field}", kind)
    some = lambda x: F.when(F.length(unicode_trim(x)) > 0, x)
    parts = at("content", "array<variant>")
    joined = F.array_join(F.transform(parts, lambda p: F.coalesce(F.try_variant_get(p, "$.text", "string"), F.lit(""))), "")
    return F.coalesce(F.when(parts.isNull(), some(at("content", "string"))), some(unicode_trim(joined)), some(at("reasoning_content", "string")))


def evidence_list(rows: DataFrame, demo: str) -> DataFrame:
    """Recommendations as evidence; what does not say otherwise counts as a demonstration."""
    return rows.withColumn(demo, F.coalesce(demo, F.lit(True)))


def selected_evidence(recommendations: DataFrame, selected: DataFrame, chunk_id: str) -> DataFrame:
    """Recommendations whose chunk is selected; their own order stays in their columns."""
    return recommendations.join(selected.select(chunk_id).distinct(), chunk_id, "left_semi")


def prompt_assets(assets: DataFrame, selected: Column, text: str = "text", chunks: str = "chunk_ids") -> DataFrame:
    """Confirmed assets for a prompt: their own words, and those of their chunks that are selected; assets without go."""
    own = assets.withColumns({text: own_part(F.col(text)), chunks: F.array_intersect(F.array_distinct(chunks), selected)})
    return own.where(F.size(chunks) > 0)


def safe_reason(reason: Column, quote: Column, least: int = 4) -> Column:
    """A reason without fragments of the quote; a fixed one where nothing is left."""
    own = strip_fragments(F.coalesce(reason, F.lit("")), F.array(quote), least)
    return F.when(is_blank(own), F.lit(NO_REASON)).otherwise(own)


def material_violations(
    body: Column, used_assets: Column, known_assets: Column, used_chunks: Column, quotes: Column, documents: Column, named: Column, least: int = 4
) -> Column:
    """What a material breaks, in this order; an empty array where it holds.

    ``quotes`` is a map from selected chunk to quote; ``documents`` are those of the used references, in order, and
    ``named`` those that the material names.
    """
    texts = F.map_values(quotes)
    bare = without_quotes(body, texts)
    lost = lambda c: F.coalesce(~F.contains(body, F.try_element_at(quotes, c)), F.lit(True))
    checks = [
        ("no_asset", F.size(used_assets) == 0),
        ("unknown_asset", F.size(F.array_except(used_assets, known_assets)) > 0),
        ("no_evidence", F.size(used_chunks) == 0),
        ("documents_not_derived", F.array_distinct(documents) != named),
        ("leaked_fragment", F.exists(texts, lambda q: contains_fragment(bare, q, least))),
        ("foreign_evidence", F.size(F.array_except(used_chunks, F.map_keys(quotes))) > 0),
        ("quote_missing", F.exists(F.array_intersect(used_chunks, F.map_keys(quotes)), lost)),
    ]
    return F.array_compact(F.array(*(F.when(bad, F.lit(name)) for name, bad in checks)))
