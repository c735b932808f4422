"""Profile items that texts name: one pass over each text by an Aho-Corasick automaton of all values."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions.batches import small_batches
from tesserae.operators.fragments import sharing

#: Characters of all different values up to which they are one automaton in every worker; beyond, see ``named_items``.
MOST_CHARACTERS = 1_000_000
#: Keywords whose matches a worker remembers.
REMEMBERED = 100_000

_BUILT: dict[tuple[str, ...], _Values] = {}


class _Values:
    """Which of many values a text holds, and which values a keyword holds or lies in."""

    def __init__(self, values: tuple[str, ...]):
        import ahocorasick

        self.values, self.seen = values, {}
        self.always = [k for k, v in enumerate(values) if not v]
        self.automaton = ahocorasick.Automaton()
        for k, v in enumerate(values):
            if v:
                self.automaton.add_word(v, k)
        self.automaton.make_automaton()
        self.joined = "\x00".join(values)
        self.starts = list(accumulate((len(v) + 1 for v in values), initial=0))

    def within(self, text: str) -> set[int]:
        return {k for _, k in self.automaton.iter(text)} if len(self.automaton) else set()

    def near(self, keyword: str) -> set[int]:
        """Values that the keyword holds or that hold it; all of them for the empty keyword."""
        if keyword not in self.seen:
            if len(self.seen) >= REMEMBERED:
                self.seen.clear()
            own, at = self.within(keyword), self.joined.find(keyword)
            while keyword and at >= 0:
                k = bisect_right(self.starts, at) - 1
                if "\x00" not in keyword or keyword in self.values[k]:
                    own.add(k)
                    at = self.joined.find(keyword, self.starts[k + 1])  # the next value
                else:
                    at = self.joined.find(keyword, at + 1)
            self.seen[keyword] = own if keyword else set(range(len(self.values)))
        return self.seen[keyword]

    def of(self, text: str | None, keywords) -> list[int]:
        if text is None and keywords is None:
            return []
        own = self.within(text) | set(self.always) if text is not None else set()
        for keyword in keywords if keywords is not None else ():
            if keyword is not None:
                own |= self.near(keyword) | set(self.always)
        return sorted(own)


def _built(values: tuple[str, ...]) -> _Values:
    if values not in _BUILT:
        _BUILT.clear()
        _BUILT[values] = _Values(values)
    return _BUILT[values]


def _finder(spark: SparkSession, values: tuple[str, ...]) -> Callable[..., Column]:
    """A column function: text and keywords (or null) to the places of the values they match."""
    shared = spark.sparkContext.broadcast(values)

    def find(texts: pd.Series, keywords: pd.Series) -> pd.Series:
        run = _built(shared.value)
        return pd.Series([run.of(t, k) for t, k in zip(texts, keywords, strict=True)], dtype=object)

    return F.pandas_udf(find, "array<int>").asNondeterministic()  # evaluated once


def named_items(chunks: DataFrame, items: DataFrame, text: str = "text", value: str = "value", keywords: str | None = None) -> DataFrame:
    """Pairs of a chunk and an item that it names: the columns of chunks but ``text`` and ``keywords``, then those of items.

    A chunk names an item whose value stands in its text or, with ``keywords``, whose value holds one of its keywords
    or is held by one. The values go to every worker as one automaton, which reads each text once, whatever the number
    of values; texts are not shuffled, and a worker holds 2 MB of them at once. Where the different values have more than MOST_CHARACTERS characters, texts and
    values meet in an equi-join on blocks instead, and keywords, which are short, likewise in both directions.

    An empty value stands in every text that is not null, an empty keyword in every value; null texts, values and
    keywords match nothing. Repeated rows of either side give repeated pairs. Column names of the sides must differ.
    """
    small_batches(chunks.sparkSession)
    own = items.where(F.col(value).isNotNull())
    size, rows = own.select(value).distinct().agg(F.coalesce(F.sum(F.length(value)), F.lit(0)), F.count("*")).first()
    words = F.col(keywords) if keywords else F.lit(None).cast("array<string>")
    if size + rows > MOST_CHARACTERS:
        return _met(chunks, own, text, value, keywords)
    values = tuple(sorted(r[0] for r in own.select(value).distinct().collect()))
    found = chunks.withColumn("_at", F.explode(_finder(chunks.sparkSession, values)(F.col(text), words))).drop(text, *([keywords] if keywords else []))
    places = chunks.sparkSession.createDataFrame(list(enumerate(values)), "_at int, _value string")
    named = own.join(places, F.col(value) == F.col("_value")).drop("_value")
    return found.join(F.broadcast(named) if rows <= MOST_CHARACTERS // 10 else named, "_at").drop("_at")


def _met(chunks: DataFrame, items: DataFrame, text: str, value: str, keywords: str | None) -> DataFrame:
    """``named_items`` by equi-joins: each different text, keyword and value is matched once, by a digest as its key."""
    key = lambda kind, c: F.concat(F.lit(kind), F.sha2(c, 256))
    values = items.select(F.col(value).alias("_value")).distinct().withColumn("_id", key("v", F.col("_value")))
    some = values.where("_value <> ''")
    texts = chunks.select(F.col(text).alias("_text")).where("_text is not null").distinct().withColumn("_key", key("t", F.col("_text")))
    holding = lambda a, x, b, y: sharing(a, x, b, y, 32).where(F.contains(x, y)).select("_key", "_value")
    pairs, keys = holding(texts, "_text", some, "_value"), texts.select("_key")
    words = F.col(keywords) if keywords else F.array().cast("array<string>")
    if keywords:
        own = chunks.select(F.explode(keywords).alias("_word")).where("_word is not null").distinct().withColumn("_key", key("w", F.col("_word")))
        pairs = pairs.union(holding(own, "_word", some, "_value")).union(holding(values, "_value", own.where("_word <> ''"), "_word"))
        pairs = pairs.union(values.select(key("w", F.lit("")), "_value"))  # an empty keyword lies in all
        keys = keys.union(own.select("_key"))
    if values.where("_value = ''").take(1):
        pairs = pairs.union(keys.select("_key", F.lit("")))
    rest = [c for c in chunks.columns if c not in (text, keywords)]
    asked = F.array_compact(F.concat(F.array(key("t", F.col(text))), F.coalesce(F.transform(words, lambda w: key("w", w)), F.array().cast("array<string>"))))
    numbered = chunks.withColumn("_row", F.monotonically_increasing_id())
    rows = numbered.select(F.struct("_row", *rest).alias("_own"), F.explode(F.array_distinct(asked)).alias("_key"))
    found = rows.join(pairs.distinct(), "_key").groupBy("_own._row", "_value").agg(F.first("_own").alias("_own"))
    return found.join(items, F.col("_value") == F.col(value)).select(*(F.col(f"_own.{c}") for c in rest), *items.columns)


def evidence_ids(chunks: DataFrame, items: DataFrame, id_col: str, item_id: str, order: str, text: str = "text", value: str = "value", keywords: str | None = None) -> DataFrame:
    """For each chunk the ids of the items it names, in ``order``: (id_col, item_ids); empty where it names none.

    The array is as long as a profile has items.
    """
    own = named_items(chunks.select(id_col, text, *([keywords] if keywords else [])), items.select(item_id, value, order), text, value, keywords)
    ids = own.groupBy(id_col).agg(F.transform(F.array_sort(F.collect_set(F.struct(order, item_id))), lambda x: x[item_id]).alias("item_ids"))
    none = F.array().cast(ids.schema["item_ids"].dataType)
    return chunks.select(id_col).distinct().join(ids, id_col, "left").withColumn("item_ids", F.coalesce("item_ids", none))


def with_evidence(ranked: DataFrame, found: DataFrame, allowed: list[str] | Column, id_col: str, ids: str = "profile_ids") -> DataFrame:
    """Ranked candidates with the profile ids of their result that are allowed; where none is left, the ids of ``found``."""
    names = F.array(*map(F.lit, allowed)).cast("array<string>") if isinstance(allowed, list) else allowed
    own = F.filter(F.coalesce(ids, F.array().cast("array<string>")), lambda x: F.array_contains(names, x))
    return ranked.join(found, id_col, "left").withColumn(ids, F.when(F.size(own) > 0, own).otherwise(F.coalesce("item_ids", F.array().cast("array<string>")))).drop("item_ids")
