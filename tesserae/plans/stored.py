"""Registered queries of the article store's joins, of confirmed and submitted assets, and the SQL of both chunk modes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserae.operators import assets, corpus, reviews
from tesserae.plans.catalog import _LINES, SQL, query, table
from tesserae.sources import pages

# --- chunks ----------------------------------------------------------------------------------------------------

#: White space as the chunk rules take it.
_WS = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def _size(x: str) -> str:
    return f"length(regexp_replace({x}, '{_WS}', '', 'g'))"


def _id(infix: str) -> str:
    return f"doc_id || '{infix}' || CASE WHEN k >= 1000 THEN CAST(k AS VARCHAR) ELSE lpad(CAST(k AS VARCHAR), 3, '0') END"


# A sentence is a list of its own and joins the last piece while both fit; the slices of a longer one end with ''.
_SENTENCES = rf"list_filter(regexp_extract_all(p, '[^.!?]+[.!?]*'), lambda s: regexp_matches(s, '[^\s]'))"
_SLICED = "list_transform({}, lambda s: CASE WHEN length(s) <= 800 THEN [s] ELSE list_append(list_transform(generate_series(1, length(s), 800), lambda i: substring(s, i, 800)), '') END)"
_FOLD = "list_reduce(x, lambda a, b: CASE WHEN len(b) > 1 OR length(a[-1]) + length(b[1]) > 800 THEN list_concat(a, b) ELSE list_append(a[:-2], a[-1] || b[1]) END)"

SQL["chunk_paragraphs"] = f"""WITH s AS (SELECT doc_id, i, p, CASE WHEN length(p) <= 800 OR len({_SENTENCES}) = 0 THEN [p] ELSE {_SENTENCES} END AS s FROM ({_LINES})),
x AS (SELECT doc_id, i, CASE WHEN length(p) <= 800 THEN [[p]] ELSE {_SLICED.format("s")} END AS x FROM s),
c AS (SELECT doc_id, i, list_filter({_FOLD}, lambda c: c <> '') AS c FROM x),
r AS (SELECT doc_id, i, j, c[j] AS chunk_text FROM (SELECT doc_id, i, c, unnest(generate_series(1, len(c))) AS j FROM c))
SELECT doc_id, {_id("_chunk_")} AS chunk_id, k AS chunk_index, chunk_text FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i, j) - 1 AS k FROM r)"""


def _packed(units: str, low: int) -> str:
    """Neighbours (s, e, n) that join while they fit in 800, or while both are below ``low``."""
    joined = "list_append(a[:-2], {'s': a[-1].s, 'e': b[1].e, 'n': a[-1].n + b[1].n})"
    return f"list_reduce({units}, lambda a, b: CASE WHEN a[-1].n + b[1].n <= 800 OR greatest(a[-1].n, b[1].n) < {low} THEN {joined} ELSE list_concat(a, b) END)"


_ABSORBED = "list_reduce(u, lambda a, b: CASE WHEN b[1].n < 300 OR len(a) = 1 AND a[1].n < 300 THEN list_append(a[:-2], {'s': a[-1].s, 'e': b[1].e, 'n': a[-1].n + b[1].n}) ELSE list_concat(a, b) END)"
_ALONE = "list_transform(u, lambda y: [y])"

SQL["chunk_spans"] = rf"""WITH t AS (SELECT doc_id, regexp_extract_all(text, '\n+|[^\n]+') AS t FROM documents WHERE text <> ''),
o AS (SELECT doc_id, i, p, sum(length(p)) OVER (PARTITION BY doc_id ORDER BY i) - length(p) AS s FROM (SELECT doc_id, i, t[i] AS p FROM (SELECT doc_id, t, unnest(generate_series(1, len(t))) AS i FROM t))),
p AS (SELECT doc_id, i, p, CAST(s AS BIGINT) AS s, {_size("p")} AS n FROM o WHERE trim(p, E' \t\r\n') <> ''),
w AS (SELECT doc_id, i, s, w[j] AS p, j FROM (SELECT doc_id, i, s, w, unnest(generate_series(1, len(w))) AS j FROM (SELECT doc_id, i, s, regexp_extract_all(p, '[^.!?]*[.!?][ \t　]*|[^.!?]+') AS w FROM p WHERE n > 800))),
v AS (SELECT doc_id, i, j, p, s + CAST(sum(length(p)) OVER (PARTITION BY doc_id, i ORDER BY j) AS BIGINT) AS e FROM w),
b AS (SELECT doc_id, i, list([{{'s': e - length(p), 'e': e, 'n': {_size("p")}}}] ORDER BY j) AS u FROM v GROUP BY 1, 2),
a AS (SELECT doc_id, i, {_packed("u", 1)} AS u FROM b UNION ALL SELECT doc_id, i, [{{'s': s, 'e': s + length(p), 'n': n}}] FROM p WHERE n <= 800),
d AS (SELECT doc_id, flatten(list(u ORDER BY i)) AS u FROM a GROUP BY 1),
f AS (SELECT doc_id, {_packed(_ALONE, 300)} AS u FROM d),
g AS (SELECT doc_id, {_ABSORBED.replace("u,", _ALONE + ",", 1)} AS u FROM f),
r AS (SELECT doc_id, k - 1 AS k, u[k].s AS s, u[k].e AS e FROM (SELECT doc_id, u, unnest(generate_series(1, len(u))) AS k FROM g)),
c AS (SELECT doc_id, k, s, e, substring(text, s + 1, e - s) AS chunk_text FROM r JOIN documents USING (doc_id))
SELECT doc_id, {_id("_c")} AS chunk_id, k AS chunk_index, s AS char_start, e AS char_end, n AS char_count, chunk_text,
 CASE WHEN n = 0 THEN 'empty' WHEN n < 120 THEN 'short' WHEN n > 1000 THEN 'long' END AS flag FROM (SELECT *, {_size("chunk_text")} AS n FROM c)"""


# --- the article store -----------------------------------------------------------------------------------------

_HOST = "regexp_extract(url, '//([^/?#]*)', 1)"
_WORD = "string_split(url, '/')[4]"


@query(f"""WITH h AS (SELECT {_HOST} AS host, {_WORD} AS word, min(page_id) AS pos FROM pages GROUP BY 1, 2)
SELECT host AS url, host || ',' || string_agg(word, ',' ORDER BY pos) AS keywords, string_agg(CASE WHEN word <> '' THEN 't' || word ELSE 't' END, ',' ORDER BY pos) AS themes FROM h GROUP BY 1""")
def merged_hits(spark, sf_dir):
    """Hosts as stored articles; every page is a hit that finds its host by url or, on odd pages, by article id alone."""
    own = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "//([^/?#]*)", 1).alias("host"), F.get(F.split("url", "/"), 3).alias("word"))
    stored = own.groupBy("host").agg(F.concat(F.lit("a"), F.min("page_id").cast("string")).alias("id"))
    none = F.array().cast("array<string>")
    stored = stored.select("id", F.col("host").alias("url"), F.md5("host").alias("article_id"), F.array("host").alias("keywords"), none.alias("themes"))
    odd = F.col("page_id") % 2 == 1
    hits = own.select(
        F.col("page_id").alias("pos"), F.when(odd, F.concat("host", F.lit("/other"))).otherwise(F.col("host")).alias("url"),
        F.when(odd, F.md5("host")).alias("article_id"), F.col("word").alias("keyword"), F.concat(F.lit("t"), "word").alias("theme"),
    )
    out = corpus.merged_articles(stored, hits)
    return out.select("url", F.array_join("keywords", ",").alias("keywords"), F.array_join("themes", ",").alias("themes"))


@query("""SELECT d.doc_id, CASE WHEN l.toxic = 1 THEN CAST(d.doc_id // 2 AS VARCHAR) END AS keep, CASE WHEN l.toxic = 1 THEN 'q' || coalesce(CAST(quality AS VARCHAR), '') END AS reason
FROM documents d LEFT JOIN labels l USING (doc_id)""")
def dropped_mapping(spark, sf_dir):
    """Toxic documents as JSON maps of dropped ids, one map for each of their rows, and what they say of every document."""
    labels = table(spark, sf_dir, "labels").where("toxic = 1")
    about = F.struct(F.floor(F.col("doc_id") / 2).cast("string").alias("keep"), F.concat(F.lit("q"), F.coalesce(F.col("quality").cast("string"), F.lit(""))).alias("reason"))
    whole = F.to_json(F.struct(F.lit("first").alias("policy"), F.create_map(F.col("doc_id").cast("string"), about).alias("dropped")))
    found = corpus.dropped_ids(labels.select(whole.alias("mapping")), "mapping").select(F.col("id").cast("long").alias("doc_id"), "keep", "reason")
    return table(spark, sf_dir, "documents").select("doc_id").join(found, "doc_id", "left")


@query("SELECT d.doc_id, CASE WHEN contains(d.text, 'tion') THEN d.lang || ',' || d.source ELSE coalesce('q' || l.quality || ',t' || l.toxic, '') END AS keywords FROM documents d LEFT JOIN labels l USING (doc_id)")
def metadata_keywords(spark, sf_dir):
    own = F.when(F.contains("text", F.lit("tion")), F.array("lang", "source")).otherwise(F.array().cast("array<string>"))
    tags = table(spark, sf_dir, "labels").select("doc_id", F.array(F.concat(F.lit("q"), "quality"), F.concat(F.lit("t"), "toxic")).alias("tags"))
    out = corpus.with_keywords(table(spark, sf_dir, "documents").select("doc_id", own.alias("keywords")), tags, "doc_id")
    return out.select("doc_id", F.array_join("keywords", ",").alias("keywords"))


@query("SELECT doc_id, 'http://x/result?keywords=' || replace(url_encode(regexp_extract(text, '^[^\\s]*')), '%2A', '*') || '&isFuzzy=1&searchArea=0&sortType=2&page=' || n_chars || '&form=f' AS url FROM documents")
def search_addresses(spark, sf_dir):
    word = F.regexp_extract("text", r"^[^\s]*", 0)
    return table(spark, sf_dir, "documents").select("doc_id", pages.search_url("http://x", word, F.col("n_chars"), "f").alias("url"))


# --- assets ----------------------------------------------------------------------------------------------------

_REST = "regexp_extract(text, '[.!?] (.*)$', 1, 's')"


@query(f"SELECT conv_id, count(*) > 0 AS some, bool_and(trim(role) <> '' AND trim({_REST}) <> '') AS complete FROM conversations GROUP BY 1")
def assets_complete(spark, sf_dir):
    """Turns as assets whose own words are what follows the first sentence."""
    own = F.concat(F.regexp_extract("text", "(?s)[.!?] (.*)$", 1), F.lit("\n\n【引用】\n"), "text")
    return assets.complete(table(spark, sf_dir, "conversations").select("conv_id", F.col("role").alias("title"), own.alias("text")), "conv_id")


@query("""SELECT doc_id, md5(text) AS digest, concat_ws(',', CASE WHEN lang IN ('en', 'fr') THEN lang END, CASE WHEN source = 'src1' THEN source END) AS chunks
FROM documents WHERE lang IN ('en', 'fr') OR source = 'src1'""")
def prompt_assets(spark, sf_dir):
    """Documents as confirmed assets, of which a prompt gets their own words and the chunks that are selected."""
    whole = F.concat("text", F.lit("\n\n【引用】\n"), "source", F.lit("\n\n【引用】\n"), "lang")
    docs = table(spark, sf_dir, "documents").select("doc_id", whole.alias("text"), F.array("lang", "source", "lang").alias("chunk_ids"))
    out = reviews.prompt_assets(docs, F.array(*map(F.lit, ["src1", "fr", "en"])))
    return out.select("doc_id", F.md5("text").alias("digest"), F.array_join("chunk_ids", ",").alias("chunks"))


_TRIM = r"regexp_replace(regexp_replace({}, '^\s+', ''), '\s+$', '')"


@query(f"""SELECT doc_id, count(*) AS n, md5(string_agg({_TRIM.format("p")} || '|' || {_TRIM.format("p")} || E'\\n\\n【引用】\\n' || p || ' ', E'\\n' ORDER BY i)) AS digest
FROM (SELECT doc_id, i, parts[i] AS p FROM (SELECT doc_id, parts, unnest(generate_series(1, len(parts))) AS i FROM (SELECT doc_id, string_split(text, E'\\n') AS parts FROM documents))) GROUP BY 1""")
def submitted_assets(spark, sf_dir):
    """Lines as edited assets: titles and own words are trimmed, quotes stay as they are."""
    item = lambda p: F.struct(F.concat(F.lit("\t"), p).alias("title"), F.concat(F.lit("\n "), p, F.lit("  \n\n【引用】\n"), p, F.lit(" ")).alias("text"))
    own = table(spark, sf_dir, "documents").select("doc_id", reviews.normalized_assets(F.transform(F.split("text", "\n"), item)).alias("a"))
    shown = F.array_join(F.transform("a", lambda x: F.concat(x["title"], F.lit("|"), x["text"])), "\n")
    return own.select("doc_id", F.size("a").cast("long").alias("n"), F.md5(shown).alias("digest"))


@query("""SELECT doc_id, CASE WHEN lang IN ('en', 'de') THEN lang ELSE '' END AS assets,
 concat_ws(',', CASE WHEN contains(text, 'the') THEN 'the' END, CASE WHEN contains(text, 'ment') THEN 'ment' END, CASE WHEN source IN ('src1', 'src2') THEN source END) AS chunks FROM documents""")
def used_evidence(spark, sf_dir):
    """What a material of each document uses: known assets, and selected chunks that it or those assets name."""
    docs, none = table(spark, sf_dir, "documents"), F.array().cast("array<string>")
    named = F.filter(F.array(*map(F.lit, ["the", "ment", "the"])), lambda w: F.contains("text", w))
    selected, known = (F.array(*map(F.lit, x)) for x in (["the", "src1", "ment", "src2"], ["de", "en"]))
    out = assets.used(F.array("lang", "source", "lang"), known, named, F.coalesce(F.array("source"), none), selected).alias("u")
    return docs.select("doc_id", out).select("doc_id", F.array_join("u.assets", ",").alias("assets"), F.array_join("u.chunks", ",").alias("chunks"))


@query("""SELECT l.doc_id, CASE WHEN contains(d.text, 'tion') THEN concat_ws(' · ', d.lang, d.source, coalesce(nullif(regexp_extract(d.text, '[0-9]{4}-[0-9]{2}-[0-9]{2}'), ''), '日期待考')) || CASE WHEN d.n_chars < 300 THEN '（演示占位文本）' ELSE '' END
 ELSE CAST(l.doc_id AS VARCHAR) END AS shown FROM labels l LEFT JOIN documents d USING (doc_id)""")
def provenance_shown(spark, sf_dir):
    """Labelled documents as references; those with a certain run of letters are known chunks, short ones demonstrate."""
    dated = F.nullif(F.regexp_extract("text", "[0-9]{4}-[0-9]{2}-[0-9]{2}", 0), F.lit(""))
    docs = table(spark, sf_dir, "documents").where(F.contains("text", F.lit("tion")))
    chunks = docs.select("doc_id", F.col("lang").alias("title"), "source", dated.alias("date"), (F.col("n_chars") < 300).alias("demo"))
    out = reviews.provenances(table(spark, sf_dir, "labels").select("doc_id"), chunks, "doc_id", "demo")
    return out.select("doc_id", "shown")
