"""Generated assets and materials: checked against selected evidence, stripped of leaks, and filled with quotes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from tesserae.functions.text import filled, json_content, markers_replaced, own_part
from tesserae.operators.fragments import is_blank, strip_fragments

DIMENSIONS = ["positioning", "technology", "industry", "value"]
GENERATED = "struct<id: string, title: string, text: string, profile_ids: array<string>, chunk_ids: array<string>>"


def parsed_assets(answers: DataFrame, answer: str, dimensions: list[str] = DIMENSIONS) -> DataFrame:
    """One row for each asset in a model's JSON answer: dimension, pos (its place before any filter) and its fields."""
    schema = ", ".join(f"{d}: array<{GENERATED}>" for d in dimensions)
    raw = F.from_json(json_content(F.col(answer)), f"struct<assets: struct<{schema}>, {schema}>")
    own = answers.withColumn("_raw", raw)
    by = [F.struct(F.lit(d).alias("dimension"), F.coalesce(F.col(f"_raw.assets.{d}"), F.col(f"_raw.{d}")).alias("assets")) for d in dimensions]
    rest = [c for c in answers.columns if c != answer]
    rows = own.select(*rest, F.inline(F.array(*by))).select(*rest, "dimension", F.posexplode("assets").alias("pos", "asset"))
    return rows.select(*rest, "dimension", "pos", "asset.*")


def materialized(assets: DataFrame, selected: DataFrame, chunk_id: str, text: str, profile_ids: Column, most: int = 2, least: int = 4) -> DataFrame:
    """Assets with a title, known profile ids and selected evidence: leaks stripped, quotes filled in, at most ``most``
    of each dimension. ``selected`` is one session's evidence, joined by id."""
    keys = ["dimension", "pos"]
    ids = F.array_distinct(F.coalesce("chunk_ids", F.array().cast("array<string>")))
    wanted = assets.select(*keys, F.posexplode(ids).alias("_at", "_chunk"))
    known = selected.select(F.col(chunk_id).alias("_chunk"), F.col(text).alias("_quote"))
    found = wanted.join(known, "_chunk").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_at", "_chunk", "_quote"))).alias("_e"))
    own = assets.join(found, keys)  # assets without selected evidence go
    own = own.withColumn("profile_ids", F.filter(F.array_distinct("profile_ids"), lambda p: F.array_contains(profile_ids, p)))
    own = own.where((F.size("profile_ids") > 0) & (F.trim(F.coalesce("title", F.lit(""))) != ""))
    quotes = F.col("_e._quote")
    own = own.withColumn("_own", strip_fragments(own_part(F.coalesce("text", F.lit(""))), quotes, least)).where(~is_blank(F.col("_own")))
    own = own.withColumns({"text": filled(F.col("_own"), quotes), "chunk_ids": F.col("_e._chunk"), "quotes": quotes}).drop("_e", "_own")
    place = F.row_number().over(W.Window.partitionBy("dimension").orderBy("pos"))
    named = F.coalesce("id", F.concat(F.col("dimension"), F.lit("_"), (F.col("pos") + 1).cast("string")))
    return own.withColumns({"id": named, "_r": place}).where(F.col("_r") <= most).drop("_r")


def material_bodies(rows: DataFrame, body: str, quotes_by_id: str, quotes: str, least: int = 4) -> DataFrame:
    """Bodies without leaks, their quote markers filled and any quote that is still missing added at the end."""
    safe = rows.withColumn("_safe", strip_fragments(F.col(body), F.col(quotes), least))
    safe = safe.withColumn("_whole", markers_replaced(F.col("_safe"), F.col(quotes_by_id)))
    missing = F.filter(quotes, lambda q: ~F.contains(F.col("_whole"), q))
    return safe.withColumn(body, filled(F.col("_whole"), missing)).drop("_safe", "_whole")


def used(asset_ids: Column, known_assets: Column, chunk_ids: Column, asset_chunks: Column, selected: Column) -> Column:
    """struct(assets, chunks): the known assets named, and the selected chunks named by the answer or by those assets."""
    chunks = F.array_intersect(F.array_distinct(F.concat(chunk_ids, asset_chunks)), selected)
    return F.struct(F.array_intersect(F.array_distinct(asset_ids), known_assets).alias("assets"), chunks.alias("chunks"))


def complete(assets: DataFrame, session: str) -> DataFrame:
    """Whether each session has an asset, and all of them a title and a text of their own."""
    good = (F.trim(F.coalesce("title", F.lit(""))) != "") & (F.trim(own_part(F.coalesce("text", F.lit("")))) != "")
    return assets.groupBy(session).agg((F.count("*") > 0).alias("some"), F.bool_and(good).alias("complete"))
