"""References to whole chunks: built, resolved, and checked by tables of violations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from tesserae.functions.text import utf16_length


def full_ref(doc_id: Column, chunk_id: Column, text: Column) -> Column:
    return F.struct(
        doc_id.alias("doc_id"), chunk_id.alias("chunk_id"), F.lit(0).alias("start_index"), utf16_length(text).alias("end_index")
    )


def violations(refs: DataFrame, chunks: DataFrame, doc_id: str, chunk_id: str, text: str) -> DataFrame:
    """Why a reference (ref_doc, ref_chunk, start_index, end_index) is not good; good ones give no row."""
    known = chunks.select(F.col(chunk_id).alias("ref_chunk"), F.col(doc_id).alias("_doc"), utf16_length(F.col(text)).alias("_size"))
    joined = refs.join(known, "ref_chunk", "left")
    why = (
        F.when(F.col("_size").isNull(), "unknown_chunk")
        .when(F.col("_doc") != F.col("ref_doc"), "wrong_document")
        .when((F.col("start_index") != 0) | (F.col("end_index") != F.col("_size")), "not_whole_chunk")
    )
    return joined.withColumn("violation", why).where("violation is not null").drop("_doc", "_size")


def resolved(refs: DataFrame, chunks: DataFrame, doc_id: str, chunk_id: str, text: str, order: str) -> DataFrame:
    """Quotes of the references; the first of equal ones counts. Raises at run time for one that is not good."""
    known = chunks.select(
        F.col(chunk_id).alias("ref_chunk"), F.col(doc_id).alias("_doc"), F.col(text).alias("quote"), utf16_length(F.col(text)).alias("_size")
    )
    first = W.Window.partitionBy("ref_doc", "ref_chunk").orderBy(order)
    once = refs.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r")
    good = F.col("_size").isNotNull() & (F.col("_doc") == F.col("ref_doc")) & (F.col("start_index") == 0) & (F.col("end_index") == F.col("_size"))
    out = once.join(known, "ref_chunk", "left")
    return out.withColumn("quote", F.when(F.coalesce(good, F.lit(False)), F.col("quote")).otherwise(F.raise_error("evidence reference is not a whole known chunk"))).drop("_doc", "_size")


def boundary_violations(items: DataFrame, text: str, quotes: str, refs: str, allowed: Column, least: int = 4) -> DataFrame:
    """Items that have no reference, one that is not allowed, a leaked fragment, or lack a quote."""
    from tesserae.functions.text import own_part, quote_part
    from tesserae.operators.fragments import contains_fragment

    own, tail = own_part(F.col(text)), quote_part(F.col(text))
    why = (
        F.when(F.size(refs) == 0, "no_reference")
        .when(F.size(F.array_except(refs, allowed)) > 0, "not_allowed")
        .when(F.exists(quotes, lambda q: contains_fragment(own, q, least)), "leaked_fragment")
        .when(F.exists(quotes, lambda q: ~F.contains(tail, q)), "quote_missing")
    )
    return items.withColumn("violation", why).where("violation is not null")
