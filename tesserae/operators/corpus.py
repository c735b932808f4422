"""A corpus as tables: dropped ids, keywords, duplicates, checks, counts, quotas and upserts."""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from tesserae.functions.lineage import cut
from tesserae.functions.text import measure


def without(docs: DataFrame, dropped: DataFrame, id_col: str) -> DataFrame:
    """Documents whose id is not dropped."""
    return docs.join(dropped.select(id_col), id_col, "left_anti")


def dropped_ids(mapping: DataFrame, column: str) -> DataFrame:
    """(id, keep, reason) of a JSON map of dropped ids."""
    parsed = F.from_json(column, "struct<policy: string, dropped: map<string, struct<keep: string, reason: string>>>")
    return mapping.select(F.explode(parsed["dropped"]).alias("id", "own")).select("id", "own.*")


def with_keywords(docs: DataFrame, tags: DataFrame, id_col: str, own: str = "keywords", other: str = "tags") -> DataFrame:
    """Own keywords where there are any, else those of ``tags``, else none."""
    none = F.array().cast("array<string>")
    joined = docs.join(tags.select(id_col, F.col(other).alias("_tags")), id_col, "left")
    return joined.withColumn(own, F.when(F.size(own) > 0, F.col(own)).otherwise(F.coalesce("_tags", none))).drop("_tags")


def repeated_ids(rows: DataFrame, id_col: str) -> DataFrame:
    """Ids that are not unique, with their number; no rows where all are."""
    return rows.groupBy(id_col).agg(F.count("*").alias("n")).where("n > 1")


def duplicate_groups(rows: DataFrame, id_col: str, text: str) -> DataFrame:
    """Groups of equal text: text_sha, n and first_id. Rows combine before the shuffle, so a hot text is no hot task."""
    own = rows.groupBy(F.sha2(F.col(text), 256).alias("text_sha"))
    return own.agg(F.count("*").alias("n"), F.min(id_col).alias("first_id")).where("n > 1")


def duplicate_pairs(rows: DataFrame, group: str, text: str) -> DataFrame:
    """How often the same set of groups shares a text: members and n, the most frequent first."""
    own = rows.groupBy(F.sha2(F.col(text), 256).alias("_sha")).agg(F.count("*").alias("_n"), F.array_sort(F.collect_set(group)).alias("_g"))
    own = own.where("_n > 1").groupBy(F.array_join("_g", ",").alias("members")).agg(F.count("*").alias("n"))
    return own.orderBy(F.desc("n"), "members")


def repeats_within(chunks: DataFrame, id_col: str, text: str) -> DataFrame:
    """Documents that hold a chunk twice: the id and the number of such texts."""
    own = chunks.groupBy(id_col, F.sha2(F.col(text), 256).alias("_sha")).agg(F.count("*").alias("_n")).where("_n > 1")
    return own.groupBy(id_col).agg(F.count("*").alias("n_repeated"))


def preflight(docs: DataFrame, chunks: DataFrame, id_col: str, text: str, chunk: str, sha: str) -> DataFrame:
    """One row of checks: documents, distinct ids, good hashes, chunks, and chunks that are no substring.

    Chunks of a document meet its text as one array, so a text is shuffled once and not once for each of its chunks.
    """
    a = docs.agg(F.count("*").alias("documents"), F.countDistinct(id_col).alias("distinct_ids"), F.count_if(F.sha2(F.col(text), 256) == F.col(sha)).alias("verified"))
    pieces = chunks.groupBy(id_col).agg(F.count("*").alias("_n"), F.collect_list(chunk).alias("_c"))  # no longer than the text they are of
    lost = F.size(F.filter("_c", lambda c: ~F.contains(F.col(text), c)))
    joined = pieces.join(docs.select(id_col, text), id_col).select("_n", F.when(F.col(text).isNotNull(), lost).otherwise(0).alias("_lost"))
    b = joined.agg(F.coalesce(F.sum("_n"), F.lit(0).cast("long")).alias("chunks"), F.coalesce(F.sum("_lost"), F.lit(0)).cast("long").alias("not_substring"))
    return a.join(b, how="cross")  # one row with one row


def tag_counts(rows: DataFrame, tags: str, name: str = "tag") -> DataFrame:
    """For each tag: rows that hold it, and rows whose first tag it is."""
    own = rows.select(F.posexplode(F.array_distinct(tags)).alias("_pos", name))
    return own.groupBy(name).agg(F.count("*").alias("hits"), F.count_if(F.col("_pos") == 0).alias("primary_hits"))


def quota_status(counts: DataFrame, targets: DataFrame, key: str, n: str = "n") -> DataFrame:
    """Count against target of each key: short (how many are missing) and status."""
    own = targets.join(counts, key, "left").withColumn(n, F.coalesce(n, F.lit(0)))
    short = F.greatest(F.col("target") - F.col(n), F.lit(0))
    return own.withColumn("short", short).withColumn("status", F.when(short == 0, "OK").otherwise(F.concat(F.lit("不足 "), short.cast("string"))))


def store_stats(articles: DataFrame, failures: DataFrame, before: int = 0) -> DataFrame:
    """One row: saved articles, failures, failures since ``before``, and articles without a date or an origin."""
    none = lambda c: F.count_if(F.coalesce(F.col(c).cast("string"), F.lit("")) == "").alias(f"missing_{c}")
    new = F.greatest(F.lit(0).cast("long"), F.col("failures") - before).alias("new_failures")
    failed = failures.agg(F.count("*").alias("failures")).select("failures", new)
    return articles.agg(F.count("*").alias("saved"), none("date"), none("origin")).join(F.broadcast(failed), how="cross")  # one row with one row


def theme_status(articles: DataFrame, themes: DataFrame, tags: str = "themes") -> DataFrame:
    """Each theme (theme, target) with primary (articles that name it first), tagged (that name it), short and status."""
    counts = tag_counts(articles, tags, "theme").select("theme", F.col("hits").alias("tagged"), F.col("primary_hits").alias("n"))
    out = quota_status(counts, themes, "theme").withColumnRenamed("n", "primary")
    return out.withColumn("tagged", F.coalesce("tagged", F.lit(0)))


def keyword_cap(target: int, keywords: int, raised: bool = False) -> int:
    """How many documents a keyword of a theme may bring."""
    if raised:
        return max(target, 2)
    return target if keywords <= 0 else max(2, ceil(target / keywords) + 1)


def within_quota(hits: DataFrame, theme: str, keyword: str, order: str, theme_target: int, keyword_most: int) -> DataFrame:
    """Hits that a greedy pass in ``order`` takes: at most ``keyword_most`` of a theme's keyword, then the theme's target."""
    by_word = F.row_number().over(W.Window.partitionBy(theme, keyword).orderBy(order))
    some = hits.withColumn("_k", by_word).where(F.col("_k") <= keyword_most)
    by_theme = F.row_number().over(W.Window.partitionBy(theme).orderBy(order))
    return some.withColumn("_t", by_theme).where(F.col("_t") <= theme_target).drop("_k", "_t")


def matched_hits(hits: DataFrame, articles: DataFrame) -> DataFrame:
    """Each hit with the article of its url, else of its article id: two equi-joins."""
    by_url = articles.groupBy("url").agg(F.min("id").alias("_by_url"))
    by_id = articles.groupBy("article_id").agg(F.min("id").alias("_by_id"))
    return hits.join(by_url, "url", "left").join(by_id, "article_id", "left").withColumn("id", F.coalesce("_by_url", "_by_id")).drop("_by_url", "_by_id")


def merged_articles(articles: DataFrame, hits: DataFrame) -> DataFrame:
    """Known articles take the keywords and themes of their hits, in order, each once."""
    known = matched_hits(hits, articles).where("id is not null")
    new = known.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "keyword", "theme"))).alias("_h"))
    own = articles.join(new, "id", "left")
    with_ = lambda c, f: F.array_union(F.col(c), F.coalesce(F.col(f"_h.{f}"), F.array().cast("array<string>")))
    return own.withColumns({"keywords": with_("keywords", "keyword"), "themes": with_("themes", "theme")}).drop("_h")


def toggled(clicks: DataFrame, key: str, item: str) -> DataFrame:
    """Items that an odd number of toggles left selected."""
    return clicks.groupBy(key, item).agg(F.count("*").alias("n")).where("n % 2 = 1").select(key, item)


def duplicate_members(rows: DataFrame, id_col: str, text: str) -> DataFrame:
    """Every row of a group of equal text, a row each: text_sha, the id and the size of its group."""
    own = rows.select(id_col, F.sha2(F.col(text), 256).alias("text_sha"))
    sizes = own.groupBy("text_sha").agg(F.count("*").alias("n")).where("n > 1")
    return own.join(sizes, "text_sha")


def first_present(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """The first value of each key, in ``order``, that is not null."""
    return rows.groupBy(key).agg(F.min_by(value, F.when(F.col(value).isNotNull(), F.col(order))).alias(value))


def chunk_anomalies(chunks: DataFrame, key: str, text: str, least: int, most: int) -> DataFrame:
    """Chunks of each key that are empty, shorter or longer than the bounds (white space does not count), and their sum."""
    size = measure(F.col(text))
    kinds = {"empty": size == 0, "below_min": (size > 0) & (size < least), "over_max": size > most}
    own = chunks.groupBy(key).agg(*(F.count_if(x).alias(name) for name, x in kinds.items()))
    return own.withColumn("anomalies", sum((F.col(x) for x in kinds), F.lit(0)))


def next_number(articles: DataFrame, id_col: str = "id", prefix: str | None = None) -> int:
    """One more than the largest number at the end of an id, or of those that are ``prefix`` and a number."""
    pattern = r"(\d+)$" if prefix is None else rf"^\Q{prefix}\E(\d+)$"
    found = F.nullif(F.regexp_extract(id_col, pattern, 1), F.lit("")).cast("long")
    return (articles.agg(F.max(found)).first()[0] or 0) + 1


def first_of_keys(rows: DataFrame, order: str, keys: list[str]) -> DataFrame:
    """Rows that a pass in ``order`` keeps: those that share no key with a row kept before them.

    Null keys are shared by none. Columns: ``order`` and ``keys``. Of rows alike in them one counts; rows of equal
    ``order`` go by their keys. In each round the rows that come first under all their keys are kept, and all rows
    with one of their keys leave; a round is a combined minimum and two joins for each key. Keys that mostly name the
    same rows, as addresses and article ids do, need a few rounds; at worst, a chain of rows that each share one key
    with the next, half as many as the chain is long.
    """
    left = cut(rows.select(order, *keys).distinct())
    kept = left.limit(0)
    at = F.struct(order, *keys)
    while left.take(1):
        marked = left
        for k in keys:
            marked = marked.join(left.where(F.col(k).isNotNull()).groupBy(k).agg(F.min(at).alias(f"_low_{k}")), k, "left")
        first = cut(marked.where(" AND ".join(f"({k} IS NULL OR _low_{k} = struct({', '.join([order, *keys])}))" for k in keys)).select(*left.columns))
        kept = kept.union(first)
        left = left.join(first.select(F.struct(*left.columns).alias("_s")), F.struct(*(left[c] for c in left.columns)).eqNullSafe(F.col("_s")), "left_anti")
        for k in keys:
            left = left.join(first.where(F.col(k).isNotNull()).select(k), k, "left_anti")
        left = cut(left.select(order, *keys))
    return kept


def saved(articles: DataFrame, found: DataFrame, order: str, prefix: str = "speech_", ranges: int = 64) -> DataFrame:
    """The store after an upsert: the columns of articles, among them id, url, article_id and keywords.

    Found rows are taken in ``order``. One whose url, or else whose article id, is that of an article, be it of the
    store or saved before from an earlier row, adds its keywords to that article, each once and in order; the
    article keeps its own url and id. Any other row becomes an article with the next number. A null url or article id
    matches nothing, and rows with neither are left out. Numbers are given within ``ranges`` ranges of ``order``, so
    no task sorts all new rows; keywords of an article are combined before they meet.
    """
    known = lambda k, name: articles.where(F.col(k).isNotNull()).groupBy(k).agg(F.min("id").alias(name))
    own = found.select(order, "url", "article_id", "keywords").where("url IS NOT NULL OR article_id IS NOT NULL")
    at = own.join(known("url", "_store_url"), "url", "left").join(known("article_id", "_store_id"), "article_id", "left")
    new = first_of_keys(at.where("_store_url IS NULL AND _store_id IS NULL"), order, ["url", "article_id"])

    cuts = new.approxQuantile(order, [k / ranges for k in range(1, ranges)], 0.005) if ranges > 1 else []
    part = sum(((F.col(order) > F.lit(c)).cast("int") for c in sorted(set(cuts))), F.lit(0))
    placed = new.withColumn("_part", part).withColumn("_at", F.row_number().over(W.Window.partitionBy("_part").orderBy(order, "url", "article_id")))
    sizes = dict(new.groupBy(part.alias("_part")).agg(F.count("*")).collect())  # one for each range
    before = [(k, sum(n for j, n in sizes.items() if j < k)) for k in sizes]
    bases = articles.sparkSession.createDataFrame(before, "_part int, _base long")
    number = F.col("_base") + F.col("_at") - 1 + F.lit(next_number(articles, prefix=prefix))
    name = F.concat(F.lit(prefix), F.when(number < 1000, F.lpad(number.cast("string"), 3, "0")).otherwise(number.cast("string")))
    new = placed.join(F.broadcast(bases), "_part").select(order, "url", "article_id", name.alias("id"))

    for k, name in (("url", "_new_url"), ("article_id", "_new_id")):
        at = at.join(new.where(F.col(k).isNotNull()).select(k, F.col("id").alias(name), F.col(order).alias(f"{name}_at")), k, "left")
    earlier = [F.when(F.col(f"{c}_at") <= F.col(order), F.col(c)) for c in ("_new_url", "_new_id")]
    at = at.withColumn("id", F.coalesce("_store_url", earlier[0], "_store_id", earlier[1]))
    words = at.select("id", order, F.posexplode("keywords").alias("_pos", "_word")).where("_word IS NOT NULL")
    words = words.groupBy("id", "_word").agg(F.min(F.struct(order, "_pos")).alias("_first"))
    words = words.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_first", "_word"))), lambda x: x["_word"]).alias("_more"))
    all_ = articles.unionByName(new.drop(order), allowMissingColumns=True).join(words, "id", "left")
    none = F.array().cast("array<string>")
    return all_.withColumn("keywords", F.array_union(F.coalesce("keywords", none), F.coalesce("_more", none))).select(*articles.columns)
