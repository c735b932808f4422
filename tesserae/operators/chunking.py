"""Documents to chunks that are exact substrings: one mode keeps paragraphs apart, the other packs spans."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.functions.text import numbered_id, unicode_trim, utf16_length


def paragraph_pieces(text: Column, most: int = 800, between: str = "\n\n+", ends: str = "。！？!?") -> Column:
    """One piece for each paragraph; a longer one is packed by sentences, and a longer sentence is cut.

    Lengths are in UTF-16 units, of which a character beyond the basic plane has two; a cut leaves it whole.
    """
    stops, size = re.escape(ends), utf16_length

    def slices(sentence: Column) -> Column:
        plain = F.transform(F.sequence(F.lit(1), F.length(sentence), F.lit(most)), lambda i: F.substring(sentence, i, F.lit(most)))

        def step(done: Column, c: Column) -> Column:
            last = F.element_at(done, -1)
            grown = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.concat(last, c)))
            return F.when(size(last) + size(c) <= most, grown).otherwise(F.concat(done, F.array(c)))

        wide = F.aggregate(F.split(sentence, ""), F.array(F.lit("")), step)
        return F.when(size(sentence) == F.length(sentence), plain).otherwise(wide)

    def packed(paragraph: Column) -> Column:
        found = F.filter(F.regexp_extract_all(paragraph, F.lit(f"([^{stops}]+[{stops}]*)"), F.lit(1)), lambda s: F.length(unicode_trim(s)) > 0)
        found = F.when(F.size(found) > 0, found).otherwise(F.array(paragraph))
        none = F.array().cast("array<string>")

        def step(acc: Column, s: Column) -> Column:
            done, now = acc["done"], acc["now"]
            closed = F.when(now != "", F.concat(done, F.array(now))).otherwise(done)
            over = size(s) > most
            full = size(now) + size(s) > most
            return F.struct(
                F.when(over, F.concat(closed, slices(s))).when(full, closed).otherwise(done).alias("done"),
                F.when(over, F.lit("")).when(full, s).otherwise(F.concat(now, s)).alias("now"),
            )

        start = F.struct(none.alias("done"), F.lit("").alias("now"))
        return F.aggregate(found, start, step, lambda a: F.when(a["now"] != "", F.concat(a["done"], F.array(a["now"]))).otherwise(a["done"]))

    units = F.filter(F.split(text, between), lambda p: F.length(unicode_trim(p)) > 0)
    return F.flatten(F.transform(units, lambda p: F.when(size(p) <= most, F.array(p)).otherwise(packed(p))))


def paragraph_chunks(docs: DataFrame, id_col: str, text: str, most: int = 800, between: str = "\n\n+", ends: str = "。！？!?") -> DataFrame:
    """One row for each chunk: chunk_id, the document's id, chunk_index, chunk_text. No shuffle."""
    own = docs.select(F.col(id_col), F.posexplode(paragraph_pieces(F.col(text), most, between, ends)).alias("chunk_index", "chunk_text"))
    return own.withColumn("chunk_id", numbered_id(F.col(id_col).cast("string"), F.col("chunk_index"), "_chunk_"))


def embedding_text(title: Column, text: Column) -> Column:
    return F.concat(F.lit("标题："), title, F.lit("\n\n正文：\n"), text)


class Spans:
    """Packs spans of one text; the size of a span is its number of characters that are not white space, from sums."""

    def __init__(self, text: str, low: int, high: int, ends: str, between: str):
        self.text, self.low, self.high = text, low, high
        self.sums = np.concatenate([[0], np.cumsum([not c.isspace() for c in text], dtype=np.int64)]) if text else np.zeros(1, np.int64)
        self.stop = re.compile(f"[{re.escape(ends)}][ \t　]*")
        self.between = re.compile(between)

    def size(self, span: tuple[int, int]) -> int:
        return int(self.sums[span[1]] - self.sums[span[0]])

    def paragraphs(self) -> list[tuple[int, int]]:
        marks = [0, *(x for m in self.between.finditer(self.text) for x in m.span()), len(self.text)]
        return [(a, b) for a, b in zip(marks[::2], marks[1::2], strict=True) if self.text[a:b].strip(" \t\r\n")]

    def sentences(self, span: tuple[int, int]) -> list[tuple[int, int]]:
        cuts = [m.end() for m in self.stop.finditer(self.text, *span)]
        marks = [span[0], *cuts, *([span[1]] if not cuts or cuts[-1] < span[1] else [])]
        return list(zip(marks, marks[1:], strict=False))

    def pack(self, units: list[tuple[int, int]], low: int) -> list[tuple[int, int]]:
        out: list[tuple[int, int]] = []
        for unit in units:
            joined = (out[-1][0], unit[1]) if out else unit
            if out and (self.size(joined) <= self.high or max(self.size(out[-1]), self.size(unit)) < low):
                out[-1] = joined
            else:
                out.append(unit)
        if len(out) < 2:
            return out
        full: list[tuple[int, int]] = []
        for span in out:  # a short span joins the one before it; a short first one takes the next
            if full and (self.size(span) < low or (len(full) == 1 and self.size(full[0]) < low)):
                full[-1] = (full[-1][0], span[1])
            else:
                full.append(span)
        return full

    def chunks(self) -> list[tuple[int, int]]:
        units = [u for p in self.paragraphs() for u in ([p] if self.size(p) <= self.high else self.pack(self.sentences(p), 1))]
        return self.pack(units, self.low)


def span_chunks(
    docs: DataFrame, id_col: str, text: str, low: int = 300, high: int = 800, ends: str = "。！？；", between: str = r"\n[ \t]*\n+"
) -> DataFrame:
    """One row for each packed span: chunk_id, the document's id, chunk_index, char_start, char_end, char_count, chunk_text, flag.

    Whole sentences and paragraphs are joined up to ``high`` characters; what stays below ``low`` joins a
    neighbour. Sequential within a document, so an Arrow batch function; documents are independent.
    """

    def spans(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"start": a, "end": b} for a, b in Spans(t or "", low, high, ends, between).chunks()] for t in texts])

    own = F.pandas_udf(spans, "array<struct<start: int, end: int>>").asNondeterministic()
    out = docs.withColumn("_spans", own(F.col(text))).select(id_col, text, F.posexplode("_spans").alias("chunk_index", "_s"))
    out = out.withColumns({"char_start": F.col("_s.start"), "char_end": F.col("_s.end")})
    out = out.withColumn("chunk_text", F.substring(F.col(text), F.col("char_start") + 1, F.col("char_end") - F.col("char_start")))
    out = out.withColumn("char_count", F.length(F.regexp_replace("chunk_text", "(?U)\\s+", "")))
    flag = F.when(F.col("char_count") == 0, "empty").when(F.col("char_count") < 120, "short").when(F.col("char_count") > 1000, "long")
    out = out.withColumns({"flag": flag, "chunk_id": numbered_id(F.col(id_col).cast("string"), F.col("chunk_index"), "_c")})
    return out.drop("_s", text)
