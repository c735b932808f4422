"""Rule-based profiles in five dimensions, the retrieval text, and items that match chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.functions.text import first_sentence, trimmed_values, unicode_trim

# Technical terms, in their order, and what the rules say.
TECH_TERMS = ["工业具身智能", "具身智能", "视觉语言模型", "机器人控制", "人工智能", "多模态大模型", "大模型", "AI Agent", "工业视觉", "智能制造", "生物计算", "AI for Science"]
# Words in a description (any of them) and the item that they give.
PRODUCT_RULES = [(["汽车"], "面向汽车制造相关应用场景"), (["柔性生产", "柔性制造"], "提升柔性生产能力")]
INDUSTRY_RULES = [(["汽车制造"], "汽车制造"), (["制造"], "制造业")]
VALUE_RULES = [(["柔性"], "以智能技术提升制造柔性与生产效率")]
NO_TECH, NO_INDUSTRY, NO_VALUE = "用户未提供足够的技术领域信息", "用户未明确行业方向", "将技术能力转化为可对外表达的产业与社会价值"
LABELS = ["企业定位：", "核心技术：", "核心产品：", "应用场景：", "产业定位：", "价值创造："]
DIMENSIONS = ["positioning", "technology", "products", "industry", "value"]

_ITEM = "array<struct<value: string, origin: string, confidence: string>>"


def _item(value: Column, origin: str, confidence: str) -> Column:
    return F.struct(value.alias("value"), F.lit(origin).alias("origin"), F.lit(confidence).alias("confidence"))


def _one(value: Column, origin: str, confidence: str, when: Column) -> Column:
    return F.when(when, F.array(_item(value, origin, confidence))).otherwise(F.array().cast(_ITEM))


def _ruled(text: Column, rules: list[tuple[list[str], str]], first_only: bool = False) -> Column:
    parts, before = [], F.lit(False)
    for words, value in rules:
        hit = F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(text, w))
        parts.append(_one(F.lit(value), "inferred", "medium", hit & ~before if first_only else hit))
        before = before | hit
    return F.concat(*parts)


def _or(items: Column, value: Column) -> Column:
    return F.when(F.size(items) > 0, items).otherwise(F.array(_item(value, "inferred", "low")))


def profiled(
    rows: DataFrame, description: str, name: Column | None = None, industry: Column | None = None, techs: Column | None = None,
    needs: Column | None = None, terms: list[str] = TECH_TERMS, products=PRODUCT_RULES, industries=INDUSTRY_RULES, values=VALUE_RULES,
    ends: str = "。！？\n",
) -> DataFrame:
    """Adds an array of (id, value, origin, confidence) for each dimension. What is given counts first, then what the
    description implies, then a fallback. All of it built-in functions, no shuffle."""
    none = F.lit(None).cast("string")
    name, industry, needs = (x if x is not None else none for x in (name, industry, needs))
    # columns of their own, so that each is computed once a row
    bound = rows.withColumns({"_text": unicode_trim(F.coalesce(F.col(description), F.lit(""))), "_given": trimmed_values(techs if techs is not None else F.array().cast("array<string>"))})
    bound = bound.withColumn("_sentence", first_sentence(F.col("_text"), ends))
    text, given, sentence = F.col("_text"), F.col("_given"), F.col("_sentence")
    has = lambda x: F.coalesce(x != "", F.lit(False))
    implied = F.filter(F.array(*map(F.lit, terms)), lambda t: F.contains(text, t) & ~F.array_contains(given, t))
    tech = F.concat(
        F.transform(given, lambda t: _item(t, "explicit", "high")), F.transform(implied, lambda t: _item(t, "inferred", "medium"))
    )
    stated = _one(industry, "explicit", "high", has(industry))
    found = {
        "positioning": ("pos", F.concat(_one(name, "explicit", "high", has(name)), F.array(_item(sentence, "inferred", "medium")))),
        "technology": ("tech", _or(tech, F.lit(NO_TECH))),
        "products": ("prod", _or(_ruled(text, products), sentence)),
        "industry": ("ind", _or(F.when(F.size(stated) > 0, stated).otherwise(_ruled(text, industries, True)), F.lit(NO_INDUSTRY))),
        "value": ("val", _or(F.concat(_one(needs, "explicit", "high", has(needs)), _ruled(text, values)), F.lit(NO_VALUE))),
    }

    def numbered(prefix: str, items: Column) -> Column:
        return F.transform(
            items,
            lambda x, i: F.struct(
                F.concat(F.lit(f"{prefix}_"), (i + 1).cast("string")).alias("id"), x["value"].alias("value"), x["origin"].alias("origin"), x["confidence"].alias("confidence")
            ),
        )

    return bound.withColumns({k: numbered(*v) for k, v in found.items()}).drop("_text", "_given", "_sentence")


def profile_items() -> Column:
    """All items of the five dimensions, in order."""
    return F.concat(*(F.col(d) for d in DIMENSIONS))


def retrieval_text(dimensions: list[str] = DIMENSIONS) -> Column:
    """Six labelled lines; products stand twice."""
    names = [dimensions[0], dimensions[1], dimensions[2], dimensions[2], dimensions[3], dimensions[4]]
    lines = [F.concat(F.lit(label), F.array_join(F.col(d)["value"], "；")) for label, d in zip(LABELS, names, strict=True)]
    return F.concat_ws("\n", *lines)


def matched_items(text: Column, keywords: Column, items: Column) -> Column:
    """Ids of the items whose value the text holds, or that hold or are held by a keyword."""
    def near(item: Column) -> Column:
        return F.contains(text, item["value"]) | F.exists(keywords, lambda k: F.contains(k, item["value"]) | F.contains(item["value"], k))

    return F.transform(F.filter(items, near), lambda x: x["id"])
