"""From a model's answers to checked assets and materials of many sessions: parsed, kept to the selected evidence,
stripped of what it quotes by itself, and filled with the quotes that count. Sessions that cannot be used give errors."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W
from pyspark.sql.types import StringType, StructType

from tesserae.functions import rules
from tesserae.functions.text import filled, json_content, markers_replaced, unicode_trim
from tesserae.operators.fragments import is_blank, strip_fragments
from tesserae.operators.index import called
from tesserae.operators.reviews import without_quotes

# The dimensions of assets, titles of materials, and what stands where a model gave nothing of its own.
DIMENSIONS = ["technologyInnovation", "industryValue", "socialValue", "developmentPositioning"]
TITLES = {"leadership_research": "企业调研汇报稿", "government_symposium": "政企座谈发言稿", "government_coordination": "政府部门对接介绍材料"}
NO_TEXT = "该表达基于已确认企业画像与已选讲话证据。引用原文由程序按 EvidenceRef 回填，不由模型生成。"
NO_BODY = "本材料基于已确认企业画像与已确认话语资产。引用原文由程序按 EvidenceRef 回填，不由模型生成。"
PENDING_TITLE = "（占位）"
PENDING_BODY = "场景化材料生成尚未接入。后续将基于已确认企业画像、已确认 EvidenceRef 和已确认话语资产生成，并由程序按 EvidenceRef 回填原文。"

ASSET = "struct<id: string, title: string, text: string, profileEvidenceIds: array<string>, evidenceChunkIds: array<string>, evidenceRefs: array<struct<chunkId: string>>>"
MATERIAL = "struct<title: string, body: string, usedAssetIds: array<string>, evidenceChunkIds: array<string>, usedEvidenceRefs: array<struct<chunkId: string>>>"
_REFS = rules.either_null_or(rules.each({"chunkId": {"missing": rules.present, "empty": rules.least(1)}}))
_TEXT = {"missing": rules.present, "empty": rules.least(1)}
ASSET_RULES = {"title": _TEXT, "text": _TEXT, "id": {"empty": rules.either_null_or(rules.least(1))}, "evidenceRefs": {"broken": _REFS}}
MATERIAL_RULES = {"title": _TEXT, "body": _TEXT, "usedEvidenceRefs": {"broken": _REFS}}

_EVIDENCE = "array<struct<pos: int, chunk_id: string, doc_id: string, quote: string>>"


def _list(x: Column) -> Column:
    return F.coalesce(x, F.array().cast("array<string>"))


def _named(ids: Column, refs: Column) -> Column:
    """Chunk ids that an answer names, as ids or in references, each once and in order."""
    return F.array_distinct(F.concat(_list(ids), _list(F.transform(refs, lambda r: r["chunkId"]))))


def with_selected(rows: DataFrame, selected: DataFrame, session: str) -> DataFrame:
    """Adds ``selected``, the evidence of each session (chunk_id, doc_id, quote) in the order of ``pos``, of a chunk the
    first. It is what one person has selected, so it is held in the session's row."""
    first = selected.groupBy(session, "chunk_id").agg(F.min(F.struct("pos", "chunk_id", "doc_id", "quote")).alias("_e"))
    own = first.groupBy(session).agg(F.array_sort(F.collect_list("_e")).cast(_EVIDENCE).alias("selected"))
    return rows.join(own, session, "left").withColumn("selected", F.coalesce("selected", F.array().cast(_EVIDENCE)))


def _of(selected: Column, ids: Column) -> Column:
    """The selected evidence of the ids, in their order."""
    at = lambda c: F.get(F.filter(selected, lambda e: e["chunk_id"] == c), 0)
    return F.filter(F.transform(ids, at), lambda e: e.isNotNull())


def _parsed(answer: Column, inner: str, kind: str) -> Column:
    """An answer's JSON as ``kind``, with or without ``inner`` around it; null where it is none."""
    text = json_content(answer)
    variant = F.try_parse_json(text)
    wrapped = F.startswith(F.schema_of_variant(F.try_variant_get(variant, f"$.{inner}", "variant")), F.lit("OBJECT"))
    own = F.when(F.coalesce(wrapped, F.lit(False)), F.from_json(text, f"struct<own: {kind}>".replace("own", inner))[inner]).otherwise(F.from_json(text, kind))
    return F.when(F.startswith(F.schema_of_variant(variant), F.lit("OBJECT")), own)


def assets_made(answers: DataFrame, selected: DataFrame, session: str, answer: str, profile_ids: str, most: int = 2, least: int = 4) -> tuple[DataFrame, DataFrame]:
    """Assets of each session's answer, and the sessions that have none: (assets, errors).

    Assets: session, dimension, pos, id, title, text, profile_ids, chunk_ids, doc_ids. An asset needs a chunk that the
    session has selected and a profile id of its array ``profile_ids``; of each dimension the first ``most`` such count.
    What any selected quote shares with title or text goes; an empty text becomes a fixed one, an empty title the
    asset's place. Quotes of its chunks follow the text. Errors: session and ``error``: ``no_selection``,
    ``no_json``, the first broken rule as ``<dimension>[<pos>].<rule>``, or ``no_assets``.
    """
    kind = ", ".join(f"{d}: array<{ASSET}>" for d in DIMENSIONS)
    own = with_selected(answers.select(session, profile_ids, answer), selected, session).withColumn("_raw", _parsed(F.col(answer), "assets", f"struct<{kind}>"))

    def placed(d: str) -> Column:
        own = F.coalesce(f"_raw.{d}", F.array().cast(f"array<{ASSET}>"))
        return F.transform(own, lambda x, i: F.struct(F.lit(d).alias("dimension"), i.alias("pos"), x.alias("a")))

    items = F.concat(*map(placed, DIMENSIONS))
    wrong = lambda x: F.get(rules.broken(x["a"], ASSET_RULES), 0)
    told = F.transform(F.filter("_items", lambda x: wrong(x).isNotNull()), lambda x: F.concat(x["dimension"], F.lit("["), x["pos"].cast("string"), F.lit("]."), wrong(x)))
    own = own.withColumn("_items", items)
    schema = F.when(F.size("selected") == 0, "no_selection").when(F.col("_raw").isNull(), "no_json").otherwise(F.get(told, 0))
    own = own.withColumn("error", schema)
    usable = F.transform(
        "_items",
        lambda x: F.struct(
            x["dimension"].alias("dimension"), x["pos"].alias("pos"), x["a"].alias("a"), _of(F.col("selected"), _named(x["a"]["evidenceChunkIds"], x["a"]["evidenceRefs"])).alias("e"),
            F.array_intersect(F.array_distinct(_list(x["a"]["profileEvidenceIds"])), _list(F.col(profile_ids))).alias("p"),
        ),
    )
    good = F.filter(usable, lambda x: (F.size(x["e"]) > 0) & (F.size(x["p"]) > 0))
    own = own.withColumn("_good", F.when(F.col("error").isNull(), good)).withColumn("error", F.coalesce("error", F.when(F.size("_good") == 0, "no_assets")))
    errors = own.where("error IS NOT NULL").select(session, "error")
    rows = own.where("error IS NULL").select(session, F.col("selected.quote").alias("_quotes"), F.explode("_good").alias("_x"))
    rows = rows.select(session, "_quotes", "_x.*")
    place = F.row_number().over(W.Window.partitionBy(session, "dimension").orderBy("pos"))
    rows = rows.withColumn("_r", place).where(F.col("_r") <= most)  # before any text is read
    name = F.concat(F.col("dimension"), F.lit("_"), (F.col("pos") + 1).cast("string"))
    trimmed = unicode_trim(F.coalesce("a.id", F.lit("")))
    rows = rows.withColumns({"_text": strip_fragments(F.col("a.text"), F.col("_quotes"), least), "_title": strip_fragments(F.col("a.title"), F.col("_quotes"), least)})
    text = F.when(is_blank(F.col("_text")), F.lit(NO_TEXT)).otherwise(F.col("_text"))
    return rows.select(
        session, "dimension", "pos", F.when(trimmed != "", trimmed).otherwise(name).alias("id"), F.when(F.col("_title") != "", F.col("_title")).otherwise(name).alias("title"),
        filled(text, F.col("e.quote")).alias("text"), F.col("p").alias("profile_ids"), F.col("e.chunk_id").alias("chunk_ids"), F.array_distinct("e.doc_id").alias("doc_ids"),
    ), errors


def materials_made(answers: DataFrame, assets: DataFrame, selected: DataFrame, session: str, answer: str, scenario: str, least: int = 4) -> tuple[DataFrame, DataFrame]:
    """The material of each session's answer, and the sessions that have none: (materials, errors).

    ``assets`` are the confirmed ones for the prompt (session, id, chunk_ids). Materials: session, scenario, title, body,
    asset_ids, chunk_ids, doc_ids. It counts the known assets that the answer uses and the selected chunks that it or
    those assets name. What a selected quote shares with title or body goes, markers become quotes, a body without a
    word of its own a fixed one, and quotes that are still missing follow. Errors: ``no_selection``,
    ``no_prompt_assets``, ``no_json``, the first broken rule, ``no_asset`` or ``no_evidence``.
    """
    own = with_selected(answers.select(session, scenario, answer), selected, session).withColumn("_m", _parsed(F.col(answer), "material", MATERIAL))
    known = assets.groupBy(session).agg(F.array_sort(F.collect_list(F.struct("id", F.array_distinct("chunk_ids").alias("chunk_ids")))).alias("_assets"))  # of one review
    own = own.join(known, session, "left").withColumn("_assets", F.filter("_assets", lambda a: F.size(_of(F.col("selected"), a["chunk_ids"])) > 0))
    ids = F.array_intersect(F.array_distinct(_list(F.col("_m.usedAssetIds"))), _list(F.col("_assets.id")))
    of_assets = F.flatten(F.transform(F.filter("_assets", lambda a: F.array_contains("asset_ids", a["id"])), lambda a: a["chunk_ids"]))
    own = own.withColumn("asset_ids", ids)
    own = own.withColumn("_e", _of(F.col("selected"), F.array_distinct(F.concat(_named(F.col("_m.evidenceChunkIds"), F.col("_m.usedEvidenceRefs")), _list(of_assets)))))
    error = (
        F.when(F.size("selected") == 0, "no_selection").when(F.coalesce(F.size("_assets"), F.lit(0)) <= 0, "no_prompt_assets").when(F.col("_m").isNull(), "no_json")
        .otherwise(F.coalesce(F.get(rules.broken(F.col("_m"), MATERIAL_RULES), 0), F.when(F.size("asset_ids") == 0, "no_asset").when(F.size("_e") == 0, "no_evidence")))
    )
    own = own.withColumn("error", error)
    good, quotes = own.where("error IS NULL"), F.col("selected.quote")
    good = good.withColumns({"_title": strip_fragments(F.col("_m.title"), quotes, least), "_body": strip_fragments(F.col("_m.body"), quotes, least)})
    by_chunk = F.map_from_entries(F.transform("selected", lambda e: F.struct(e["chunk_id"], F.concat(F.lit("【引用】\n"), e["quote"]))))
    good = good.withColumn("_body", markers_replaced(F.col("_body"), by_chunk))
    good = good.withColumn("_body", F.when(is_blank(without_quotes(F.col("_body"), quotes)), F.lit(NO_BODY)).otherwise(F.col("_body")))
    missing = F.filter(F.col("_e.quote"), lambda q: ~F.contains(F.col("_body"), q))
    titles = F.create_map(*(F.lit(x) for pair in TITLES.items() for x in pair))
    made = good.select(
        session, scenario, F.when(F.col("_title") != "", F.col("_title")).otherwise(F.coalesce(F.try_element_at(titles, F.col(scenario)), F.col(scenario))).alias("title"),
        unicode_trim(filled(F.col("_body"), missing)).alias("body"), "asset_ids", F.col("_e.chunk_id").alias("chunk_ids"), F.array_distinct("_e.doc_id").alias("doc_ids"),
    )
    return made, own.where("error IS NOT NULL").select(session, "error")


def safe_requirements(requests: DataFrame, selected: DataFrame, session: str, text: str, least: int = 4) -> DataFrame:
    """Requests whose additional requirements hold no fragment of the session's quotes; null stays null."""
    own = with_selected(requests, selected, session)
    safe = strip_fragments(F.coalesce(text, F.lit("")), F.col("selected.quote"), least)
    return own.withColumn("_safe", safe).withColumn(text, F.when(F.col(text).isNotNull(), F.col("_safe"))).drop("_safe", "selected")


def answered(prompts: DataFrame, prompt: str, client: Callable[[str], str], attempts: int = 5, pause: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """Adds ``answer`` and ``answer_error``: each prompt sent to a client that returns text, again where a failure may pass."""
    names = prompts.columns
    schema = StructType(list(prompts.schema.fields)).add("answer", StringType()).add("answer_error", StringType())

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def one(text: str | None) -> tuple[str | None, str | None]:
            said: list[str] = []
            _, error = called(lambda texts: [[float(len(said.append(client(texts[0])) or ""))]], [text or ""], attempts, pause, None, sleep)
            return (None, error) if error else (said[-1], None)

        for part in parts:
            told = [one(t) for t in part[prompt]]
            yield part.assign(answer=[a for a, _ in told], answer_error=[e for _, e in told])[[*names, "answer", "answer_error"]].astype(object)

    return prompts.mapInPandas(run, schema)


def pending_assets(sessions: DataFrame, selected: DataFrame, session: str) -> DataFrame:
    """What stands for assets that are not made yet: an empty array for each dimension, and how much is selected."""
    counts = selected.groupBy(session).agg(F.count("*").alias("selected_count"))
    own = sessions.select(session).join(counts, session, "left").withColumn("selected_count", F.coalesce("selected_count", F.lit(0)))
    return own.select(session, F.lit(True).alias("placeholder"), *(F.array().cast("array<string>").alias(d) for d in DIMENSIONS), "selected_count")


def pending_materials(requests: DataFrame, selected: DataFrame, session: str, scenario: str) -> DataFrame:
    """What stands for a material that is not made yet: its title so marked, a fixed body, and the selected references."""
    titles = F.create_map(*(F.lit(x) for pair in TITLES.items() for x in pair))
    own = with_selected(requests.select(session, scenario), selected, session)
    return own.select(
        session, F.lit(True).alias("placeholder"), scenario, F.concat(F.try_element_at(titles, F.col(scenario)), F.lit(PENDING_TITLE)).alias("title"), F.lit(PENDING_BODY).alias("body"),
        F.array().cast("array<string>").alias("asset_ids"), F.col("selected.chunk_id").alias("chunk_ids"), F.array_distinct("selected.doc_id").alias("doc_ids"),
    )
