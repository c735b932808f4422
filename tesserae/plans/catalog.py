"""Registered queries over the given tables, each with DuckDB SQL where SQL can express it.

The tables are in four European languages, so queries pass patterns, sentence ends and word lists that fit them;
the operators' defaults are those of the documents that they were made for.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions import text as T
from tesserae.operators import assets, chunking, cleaning, corpus, evidence, fragments, profiles, quality, retrieval
from tesserae.sources import markdown, pages
from tesserae.streaming import workflow

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

# Word lists and rules for the given tables.
PHRASES = ["the", "and the", "tion", "ment", "ción", "keit"]
KEYWORD, TITLE_WORDS = "tion", "Licensed|The|Der|La"
RULES = [
    ("^Licensed under", "note", "licence"),
    (r"\|.*\|", "drop", "table"),
    ("!!", "drop", "shouting"),
    (r"(###|%%%|&&&|\*\*\*|\$\$\$)", "drop", "marks"),
]
TITLE_RULES = ["^Licensed", "###", "!!", "^The"]
FRAGMENT = 32


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- retrieval -------------------------------------------------------------------------------------------------

_COS = "list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) / (sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) * sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])))"
_TOP = f"""top AS (SELECT vec_id, label, score, row_number() OVER (ORDER BY round(score, 9) DESC, vec_id) - 1 AS pos FROM (
  SELECT e.vec_id, e.label, {_COS} AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q)
  QUALIFY row_number() OVER (ORDER BY round(score, 9) DESC, vec_id) <= 20)"""
_CAP = "cap AS (SELECT vec_id, label, score, pos, row_number() OVER (PARTITION BY label ORDER BY pos) AS r FROM top QUALIFY r <= 2)"


def _top(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    one = rows.where("vec_id = 0").select(F.col("embedding").alias("q"))
    return retrieval.top_k(rows, "embedding", one, "q", "vec_id", 20).drop("embedding")


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("score", F.round("score", 6))


@query(f"WITH {_TOP} SELECT vec_id, label, round(score, 6) AS score, pos FROM top")
def vector_topk(spark, sf_dir):
    return _rounded(_top(spark, sf_dir))


@query(f"WITH {_TOP}, {_CAP} SELECT vec_id, label, round(score, 6) AS score, pos FROM cap")
def vector_group_cap(spark, sf_dir):
    return _rounded(retrieval.group_cap(_top(spark, sf_dir), "label", 2))


def _place(sql: str, last: str = "") -> str:
    return f"""WITH {_TOP}, {_CAP}, c AS (SELECT vec_id, label, score, row_number() OVER (ORDER BY pos) - 1 AS pos FROM cap), {sql}
SELECT vec_id, label, round(score, 6) AS score, relevance, rank FROM ranked {last}"""


_IDENTITY = "ranked AS (SELECT *, pos AS rank, CASE WHEN pos = 0 THEN 'strong' ELSE 'medium' END AS relevance FROM c)"
_REVERSE = "ranked AS (SELECT *, row_number() OVER (ORDER BY pos DESC) - 1 AS rank, CASE WHEN row_number() OVER (ORDER BY pos DESC) = 1 THEN 'strong' ELSE 'medium' END AS relevance FROM c)"
_PARTIAL = """ranked AS (SELECT *, row_number() OVER (ORDER BY pos % 3 <> 0, CASE WHEN pos % 3 = 0 THEN -pos ELSE pos END) - 1 AS rank,
  CASE WHEN pos % 3 <> 0 THEN 'weak' WHEN pos % 2 = 0 THEN 'strong' ELSE 'irrelevant' END AS relevance FROM c)"""


def _candidates(spark, sf_dir) -> DataFrame:
    from pyspark.sql import Window

    cap = retrieval.group_cap(_top(spark, sf_dir), "label", 2)
    return cap.withColumn("pos", F.row_number().over(Window.orderBy("pos")) - 1)  # of 20 rows at most


def _ranked(candidates: DataFrame, results: DataFrame) -> DataFrame:
    return _rounded(retrieval.apply_rerank(candidates, results, "vec_id").select("vec_id", "label", "score", "relevance", "rank"))


@query(_place(_IDENTITY))
def rerank_identity(spark, sf_dir):
    c = _candidates(spark, sf_dir)
    return _ranked(c, retrieval.identity_results(c, "vec_id"))


@query(_place(_REVERSE))
def rerank_reverse(spark, sf_dir):
    c = _candidates(spark, sf_dir)
    return _ranked(c, retrieval.reverse_results(c, "vec_id"))


def _partial(c: DataFrame) -> DataFrame:
    """Every third candidate in reverse, each of them twice, and ids that no candidate has."""
    own = c.where("pos % 3 = 0").withColumn("relevance", F.when(F.col("pos") % 2 == 0, "strong").otherwise("irrelevant"))
    first = own.select("vec_id", (-F.col("pos")).alias("result_pos"), "relevance")
    again = own.select("vec_id", (100 - F.col("pos")).alias("result_pos"), F.lit("weak").alias("relevance"))
    unknown = own.select((-F.col("vec_id") - 1).alias("vec_id"), (-100 - F.col("pos")).alias("result_pos"), F.lit("strong").alias("relevance"))
    return first.union(again).union(unknown)


@query(_place(_PARTIAL))
def rerank_partial(spark, sf_dir):
    c = _candidates(spark, sf_dir)
    return _ranked(c, _partial(c))


@query(_place(_PARTIAL, "WHERE relevance <> 'irrelevant' OR NOT EXISTS (SELECT 1 FROM ranked WHERE relevance <> 'irrelevant') ORDER BY rank LIMIT 5"))
def recommend_flagship(spark, sf_dir):
    c = _candidates(spark, sf_dir)
    ranked = retrieval.apply_rerank(c, _partial(c), "vec_id").select("vec_id", "label", "score", "relevance", "rank")
    return _rounded(retrieval.recommended(ranked, 5))


@query("""WITH c AS (SELECT doc_id, unicode(ch) % 64 AS dim, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, '')) AS ch FROM documents) WHERE ch <> '' GROUP BY 1, 2)
SELECT doc_id, dim, round(n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)), 6) AS value FROM c""")
def hash_embedding(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    own = docs.select("doc_id", F.posexplode(retrieval.hash_embedding(F.col("text"))).alias("dim", "v"))
    return own.where("v <> 0").select("doc_id", F.col("dim").cast("long").alias("dim"), F.round("v", 6).alias("value"))


@query("SELECT vec_id, CASE WHEN vec_id % 10 = 0 THEN 'missing' ELSE 'stale' END AS change FROM embeddings WHERE (vec_id % 10 = 0) <> (vec_id % 7 = 3)")
def index_freshness(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id")
    index = rows.where("vec_id % 10 <> 0 OR vec_id % 7 = 3")
    return retrieval.index_changes(index, rows.where("vec_id % 10 = 0 OR vec_id % 7 <> 3"), "vec_id")


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN upper(lang) ELSE lang END AS lang FROM documents")
def index_upsert(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return retrieval.upserted(docs, docs.where("doc_id % 3 = 0").withColumn("lang", F.upper("lang")), "doc_id")


# --- text and chunks -------------------------------------------------------------------------------------------

_PARTS = "SELECT doc_id, list_filter(string_split_regex(text, '\\n+'), lambda p: length(trim(p, ' \t\r\n')) > 0) AS parts FROM documents"


@query(f"SELECT doc_id, i - 1 AS idx, length(parts[i]) AS n_chars, md5(parts[i]) AS digest FROM (SELECT doc_id, parts, unnest(generate_series(1, len(parts))) AS i FROM ({_PARTS}))")
def paragraph_split(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    own = docs.select("doc_id", F.posexplode(cleaning.paragraphs(F.col("text"), "\n+")).alias("idx", "p"))
    return own.select("doc_id", "idx", F.length("p").alias("n_chars"), F.md5("p").alias("digest"))


def _chunks(spark, sf_dir) -> DataFrame:
    return chunking.paragraph_chunks(table(spark, sf_dir, "documents"), "doc_id", "text", 800, "\n+", ".!?")


@query()
def chunk_paragraphs(spark, sf_dir):
    return _chunks(spark, sf_dir).select("doc_id", "chunk_id", "chunk_index", "chunk_text")


@query()
def chunk_spans(spark, sf_dir):
    return chunking.span_chunks(table(spark, sf_dir, "documents"), "doc_id", "text", 300, 800, ".!?", r"\n+")


@query("SELECT chunk_id, doc_id, '标题：' || source || E'\\n\\n正文：\\n' || p AS embedding_text FROM (SELECT doc_id, source, doc_id || '_chunk_' || CASE WHEN i > 1000 THEN CAST(i - 1 AS VARCHAR) ELSE lpad(CAST(i - 1 AS VARCHAR), 3, '0') END AS chunk_id, parts[i] AS p FROM (SELECT d.doc_id, d.source, x.parts, unnest(generate_series(1, len(x.parts))) AS i FROM documents d JOIN (" + _PARTS + ") x USING (doc_id)))")
def chunk_embedding_text(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    own = docs.select("doc_id", "source", F.posexplode(cleaning.paragraphs(F.col("text"), "\n+")).alias("idx", "p"))
    return own.select(T.numbered_id(F.col("doc_id").cast("string"), F.col("idx"), "_chunk_").alias("chunk_id"), "doc_id", chunking.embedding_text(F.col("source"), F.col("p")).alias("embedding_text"))


_LINES = f"SELECT doc_id, i, parts[i] AS p FROM (SELECT doc_id, parts, unnest(generate_series(1, len(parts))) AS i FROM ({_PARTS}))"
_CLASS = f"""SELECT doc_id, i, p, CASE WHEN p = '' THEN 'empty_paragraph' WHEN regexp_matches(p, '^Licensed under') THEN 'licence' WHEN regexp_matches(p, '\\|.*\\|') THEN 'table'
  WHEN regexp_matches(p, '!!') THEN 'shouting' WHEN regexp_matches(p, '###|%%%|&&&|\\*\\*\\*|\\$\\$\\$') THEN 'marks' END AS reason
FROM (SELECT doc_id, i, p AS raw, p FROM ({_LINES}))"""


@query(f"SELECT doc_id, coalesce(reason, 'kept') AS reason, count(*) AS n FROM ({_CLASS}) GROUP BY 1, 2")
def clean_classify(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    own = docs.select("doc_id", F.explode(cleaning.paragraphs(F.col("text"), "\n+")).alias("p"))
    own = own.select("doc_id", F.coalesce(cleaning.classify(F.col("p"), None, RULES)["reason"], F.lit("kept")).alias("reason"))
    return own.groupBy("doc_id", "reason").agg(F.count("*").alias("n"))


_BODY = f"""SELECT doc_id, coalesce(string_agg(p, E'\\n\\n' ORDER BY i) FILTER (reason IS NULL), '') AS body, coalesce(string_agg(p, E'\\n' ORDER BY i) FILTER (reason = 'licence'), '') AS note,
  count(*) AS paragraphs_in, count(*) FILTER (reason IS NULL) AS paragraphs_kept FROM ({_CLASS}) GROUP BY 1"""


def _cleaned(spark, sf_dir) -> DataFrame:
    return cleaning.cleaned(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", None, "\n+", RULES)


@query(f"SELECT doc_id, sha256(body) AS sha256, length(body) AS chars_out, length(note) AS note_chars, paragraphs_in, paragraphs_kept FROM ({_BODY})")
def clean_body(spark, sf_dir):
    return _cleaned(spark, sf_dir).select("doc_id", "sha256", "chars_out", F.length("note").alias("note_chars"), "paragraphs_in", "paragraphs_kept")


@query(f"SELECT doc_id, CASE WHEN body = '' THEN 'empty_body' WHEN length(regexp_replace(body, '\\s', '', 'g')) < 200 THEN 'short_body' ELSE '' END AS flags FROM ({_BODY})")
def clean_flags(spark, sf_dir):
    return _cleaned(spark, sf_dir).select("doc_id", F.array_join("flags", ",").alias("flags"))


@query(f"SELECT reason, count(*) AS n FROM ({_CLASS}) WHERE reason IS NOT NULL GROUP BY 1")
def clean_summary(spark, sf_dir):
    own = _cleaned(spark, sf_dir).select(F.explode("removed").alias("r"))
    return own.groupBy(F.regexp_replace("r.reason", "^moved:", "").alias("reason")).agg(F.count("*").alias("n"))


@query("SELECT doc_id, length(regexp_replace(text, '\\s', '', 'g')) < 400 AS too_short FROM documents")
def body_too_short(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", quality.body_too_short(F.col("text"), 400).alias("too_short"))


def _count_sql(p: str) -> str:
    return f"CAST((length(text) - length(replace(text, '{p}', ''))) / {len(p)} AS INTEGER)"


@query("SELECT doc_id, " + ", ".join(f"{_count_sql(p)} AS n_{k}" for k, p in enumerate(PHRASES)) + " FROM documents")
def phrase_counts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", *(T.count_phrase(F.col("text"), F.lit(p)).alias(f"n_{k}") for k, p in enumerate(PHRASES)))


_TITLE = "string_split(text, E'\\n')[1]"
_REL_PHRASES = [KEYWORD, "ment", "ción", "keit"]
_HITS = "(" + " + ".join(f"CAST(contains(text, '{p}') AS INTEGER)" for p in _REL_PHRASES) + ")"
_TOTAL = "(" + " + ".join(_count_sql(p) for p in _REL_PHRASES) + ")"
_FIRST = "CASE " + " ".join(f"WHEN contains(title, '{p}') THEN '{p}'" for p in _REL_PHRASES) + " END"


@query(f"""SELECT doc_id, CASE WHEN NOT sp AND t IS NULL THEN 'not_speech_or_theme_title'
  WHEN (t IS NOT NULL AND (h > 0 OR contains(title, '{KEYWORD}'))) OR (sp AND ((h >= 2 AND total >= 3) OR kw >= 3)) THEN NULL
  ELSE 'weak_topic_match:distinct=' || h || ',hits=' || total || ',keyword_hits=' || kw || CASE WHEN t IS NOT NULL THEN ',title_theme=' || t ELSE '' END || CASE WHEN sp THEN ',speech_like_title' ELSE '' END END AS reason
FROM (SELECT *, regexp_matches(title, '{TITLE_WORDS}') AS sp, {_FIRST} AS t, {_HITS} AS h, {_TOTAL} AS total, {_count_sql(KEYWORD)} AS kw FROM (SELECT doc_id, text, {_TITLE} AS title FROM documents))""")
def relevance(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("title", F.element_at(F.split("text", "\n"), 1))
    phrases = F.array(*map(F.lit, _REL_PHRASES[1:]))
    return docs.select("doc_id", quality.relevance_skip(F.col("title"), F.col("text"), F.lit(KEYWORD), phrases, TITLE_WORDS).alias("reason"))


@query(f"SELECT doc_id, CASE WHEN trim(t) = '' THEN 'empty_title' WHEN regexp_matches(t, '^Licensed') THEN '^Licensed' WHEN contains(t, '###') THEN '###' WHEN contains(t, '!!') THEN '!!' WHEN starts_with(t, 'The') THEN '^The' END AS pattern FROM (SELECT doc_id, trim({_TITLE}) AS t FROM documents)")
def title_skip(spark, sf_dir):
    title = F.element_at(F.split("text", "\n"), 1)
    return table(spark, sf_dir, "documents").select("doc_id", quality.title_skip(title, TITLE_RULES, {}).alias("pattern"))


@query("SELECT doc_id, CASE WHEN NOT (contains(b, 'ment') OR contains(b, 'ción')) THEN 'no_theme_signal_in_title_or_snippet' END AS reason FROM (SELECT doc_id, string_split(text, E'\\n')[1] || E'\\n' || text AS b FROM documents)")
def listing_skip(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", quality.listing_skip(F.element_at(F.split("text", "\n"), 1), F.col("text"), F.array(F.lit("ment"), F.lit("ción"))).alias("reason"))


@query("SELECT doc_id, trim(coalesce(list_filter(string_split_regex(trim(text, E' \\n'), '[.!?\\n]'), lambda p: trim(p) <> '')[1], text), E' \\n\\t') AS sentence FROM documents")
def first_sentence(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.first_sentence(F.col("text"), ".!?\n").alias("sentence"))


@query("SELECT doc_id, CASE WHEN length(text) > 80 THEN substr(text, 1, 80) || '…' ELSE text END AS preview FROM documents")
def text_preview(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.preview(F.col("text")).alias("preview"))


# --- pages and markdown ----------------------------------------------------------------------------------------


@query()
def html_extract(spark, sf_dir):
    own = table(spark, sf_dir, "pages").select("page_id", pages.page_fields(F.col("html")).alias("f"))
    return own.select("page_id", "f.title", "f.body", "f.error", F.size("f.links").alias("n_links"))


@query("SELECT page_id, nullif(regexp_extract(url || '/article/' || (page_id + 12340), '(?:article/)?(\\d{5,})', 1), '') AS article_id FROM pages")
def page_article_id(spark, sf_dir):
    url = F.concat("url", F.lit("/article/"), (F.col("page_id") + 12340).cast("string"))
    return table(spark, sf_dir, "pages").select("page_id", pages.article_id(url).alias("article_id"))


@query("SELECT page_id, 'host ' || page_id AS origin, '2024-01-' || lpad(CAST(page_id % 28 + 1 AS VARCHAR), 2, '0') AS date FROM pages")
def page_origin_date(spark, sf_dir):
    day = F.lpad((F.col("page_id") % 28 + 1).cast("string"), 2, "0")
    meta = F.concat(F.lit("2020-12-31 来源：host "), F.col("page_id").cast("string"), F.lit("  发布时间：2024-01-"), day)
    return table(spark, sf_dir, "pages").select("page_id", pages.origin(meta).alias("origin"), pages.published(meta).alias("date"))


@query("SELECT doc_id, CAST(doc_id AS VARCHAR) AS id, source, lang, sha256(regexp_replace(regexp_replace(text, '^\\n+', ''), '\\n+$', '')) AS sha256, NULL AS error FROM documents WHERE NOT starts_with(ltrim(text, E'\\n'), '# ') AND regexp_replace(text, '^\\n+|\\n+$', '', 'g') <> ''")
def markdown_round_trip(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where(~F.col("text").rlike(r"^\n*# ") & (F.regexp_replace("text", r"^\n+|\n+$", "") != ""))
    content = markdown.rendered(F.lit("A: title"), F.col("text"), {"id": F.col("doc_id").cast("string"), "title": F.lit("A: title"), "source": F.col("source"), "lang": F.col("lang")}, {"themes": F.array("lang", "source")})
    own = markdown.parsed(docs.select("doc_id", content.alias("content")))
    return own.select("doc_id", F.col("fields")["id"].alias("id"), F.col("fields")["source"].alias("source"), F.col("fields")["lang"].alias("lang"), "sha256", "error")


# --- corpus ----------------------------------------------------------------------------------------------------


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def dedup_anti(spark, sf_dir):
    dropped = table(spark, sf_dir, "labels").where("toxic = 1")
    return corpus.without(table(spark, sf_dir, "documents").select("doc_id", "lang"), dropped, "doc_id")


@query("SELECT sha256(text) AS text_sha, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY text HAVING count(*) > 1")
def duplicate_groups(spark, sf_dir):
    return corpus.duplicate_groups(table(spark, sf_dir, "documents"), "doc_id", "text")


@query("SELECT members, count(*) AS n FROM (SELECT string_agg(DISTINCT source, ',' ORDER BY source) AS members FROM documents GROUP BY text HAVING count(*) > 1) GROUP BY 1")
def duplicate_pairs(spark, sf_dir):
    return corpus.duplicate_pairs(table(spark, sf_dir, "documents"), "source", "text")


@query(f"SELECT doc_id, count(*) AS n_repeated FROM (SELECT doc_id, p FROM ({_LINES}) GROUP BY 1, 2 HAVING count(*) > 1) GROUP BY 1")
def within_doc_dups(spark, sf_dir):
    own = table(spark, sf_dir, "documents").select("doc_id", F.explode(cleaning.paragraphs(F.col("text"), "\n+")).alias("p"))
    return corpus.repeats_within(own, "doc_id", "p")


@query("SELECT doc_id, sha256(text) AS sha256, n_chars = length(text) AS length_ok FROM documents")
def sha_verify(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"), (F.col("n_chars") == F.length("text")).alias("length_ok"))


@query(f"SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(DISTINCT doc_id) FROM documents) AS distinct_ids, (SELECT count(*) FROM documents) AS verified, (SELECT count(*) FROM ({_LINES})) AS chunks, 0 AS not_substring")
def preflight(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("sha", F.sha2("text", 256))
    own = docs.select("doc_id", F.explode(cleaning.paragraphs(F.col("text"), "\n+")).alias("p"))
    return corpus.preflight(docs, own, "doc_id", "text", "p", "sha")


@query("SELECT source AS id, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def repeated_ids(spark, sf_dir):
    return corpus.repeated_ids(table(spark, sf_dir, "documents").select(F.col("source").alias("id")), "id")


@query("SELECT tag, count(*) AS hits, count(*) FILTER (first) AS primary_hits FROM (SELECT lang AS tag, true AS first FROM documents UNION ALL SELECT source, false FROM documents) GROUP BY 1")
def theme_counts(spark, sf_dir):
    return corpus.tag_counts(table(spark, sf_dir, "documents").select(F.array("lang", "source").alias("tags")), "tags")


@query("SELECT r_name AS region, coalesce(n, 0) AS n, CAST(6 AS BIGINT) AS target, greatest(6 - coalesce(n, 0), 0) AS short, CASE WHEN coalesce(n, 0) >= 6 THEN 'OK' ELSE '不足 ' || (6 - coalesce(n, 0)) END AS status FROM region LEFT JOIN (SELECT n_regionkey, count(*) AS n FROM nation WHERE n_nationkey % 6 <> 1 GROUP BY 1) ON r_regionkey = n_regionkey")
def quota_status(spark, sf_dir):
    counts = table(spark, sf_dir, "nation").where("n_nationkey % 6 <> 1").groupBy("n_regionkey").agg(F.count("*").alias("n"))
    targets = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("region"), F.lit(6).cast("long").alias("target"))
    return corpus.quota_status(counts, targets, "n_regionkey").drop("n_regionkey")


@query("SELECT doc_id, lang, source FROM (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS k FROM documents) WHERE k <= 4 QUALIFY row_number() OVER (PARTITION BY lang ORDER BY doc_id) <= 50")
def quota_greedy(spark, sf_dir):
    return corpus.within_quota(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), "lang", "source", "doc_id", 50, corpus.keyword_cap(50, 17))


@query("SELECT user_id, event_type FROM events GROUP BY 1, 2 HAVING count(*) % 2 = 1")
def toggle_parity(spark, sf_dir):
    return corpus.toggled(table(spark, sf_dir, "events"), "user_id", "event_type")


# --- fragments and evidence ------------------------------------------------------------------------------------

_GRAMS = f"SELECT item_id, unnest(list_transform(generate_series(1, length(text) - {FRAGMENT - 1}), lambda i: substr(text, i, {FRAGMENT}))) AS g FROM benchmark WHERE length(text) >= {FRAGMENT}"
_DGRAMS = f"SELECT doc_id, unnest(list_transform(generate_series(1, length(text) - {FRAGMENT - 1}), lambda i: substr(text, i, {FRAGMENT}))) AS g FROM documents WHERE length(text) >= {FRAGMENT}"


def _shared(spark, sf_dir, rows: DataFrame, text: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("item"))
    return fragments.sharing(rows, text, items, "item", FRAGMENT)


@query(f"SELECT DISTINCT doc_id, item_id FROM ({_DGRAMS}) JOIN ({_GRAMS}) USING (g)")
def fragment_contains(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return _shared(spark, sf_dir, docs, "text").select("doc_id", "item_id")


@query()
def fragment_longest(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    own = _shared(spark, sf_dir, lines, "text")
    return own.select("doc_id", "line", "item_id", fragments.longest_fragment(F.col("text"), F.col("item")).alias("fragment"))


@query()
def fragment_strip(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    own = _shared(spark, sf_dir, lines, "text").groupBy("doc_id", "line", "text").agg(F.array_sort(F.collect_set("item")).alias("items"))
    safe = own.withColumn("stripped", fragments.strip_fragments(F.col("text"), F.col("items"), FRAGMENT))
    return safe.select("doc_id", "line", "stripped", fragments.has_artifacts(F.col("stripped")).alias("artifacts"))


@query("SELECT doc_id, item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text) AND b.text <> ''")
def theta_match(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    items = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("item"))
    return fragments.sharing(docs, "text", items, "item", 40).where(F.contains("text", "item")).select("doc_id", "item_id")


_REFS = f"SELECT doc_id, i, parts[i] AS p FROM (SELECT doc_id, parts, unnest(generate_series(1, len(parts))) AS i FROM ({_PARTS}))"


def _line_chunks(spark, sf_dir) -> DataFrame:
    own = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(cleaning.paragraphs(F.col("text"), "\n+")).alias("idx", "p"))
    return own.withColumn("chunk", T.numbered_id(F.col("doc_id").cast("string"), F.col("idx"), "_chunk_"))


def _refs(chunks: DataFrame) -> DataFrame:
    """A reference to every chunk; four of five are spoiled."""
    own = chunks.withColumn("case", (F.col("doc_id") + F.col("idx")) % 5)
    return own.select(
        F.when(F.col("case") == 1, F.col("doc_id") + 1).otherwise(F.col("doc_id")).alias("ref_doc"),
        F.when(F.col("case") == 2, F.concat("chunk", F.lit("x"))).otherwise(F.col("chunk")).alias("ref_chunk"),
        F.when(F.col("case") == 3, 1).otherwise(0).alias("start_index"),
        (T.utf16_length(F.col("p")) - F.when(F.col("case") == 4, 1).otherwise(0)).alias("end_index"),
        "case",
    )


_CHUNK = "doc_id || '_chunk_' || CASE WHEN i > 1000 THEN CAST(i - 1 AS VARCHAR) ELSE lpad(CAST(i - 1 AS VARCHAR), 3, '0') END"


@query(f"SELECT doc_id + CASE WHEN c = 1 THEN 1 ELSE 0 END AS ref_doc, {_CHUNK} || CASE WHEN c = 2 THEN 'x' ELSE '' END AS ref_chunk, CASE c WHEN 1 THEN 'wrong_document' WHEN 2 THEN 'unknown_chunk' ELSE 'not_whole_chunk' END AS violation FROM (SELECT *, (doc_id + i - 1) % 5 AS c FROM ({_REFS})) WHERE c <> 0")
def evidence_violations(spark, sf_dir):
    chunks = _line_chunks(spark, sf_dir)
    return evidence.violations(_refs(chunks), chunks, "doc_id", "chunk", "p").select("ref_doc", "ref_chunk", "violation")


@query(f"SELECT doc_id AS ref_doc, {_CHUNK} AS ref_chunk, md5(p) AS digest FROM ({_REFS}) WHERE (doc_id + i - 1) % 5 = 0")
def evidence_resolve(spark, sf_dir):
    chunks = _line_chunks(spark, sf_dir)
    refs = _refs(chunks).where("case = 0")
    return evidence.resolved(refs.union(refs), chunks, "doc_id", "chunk", "p", "start_index").select("ref_doc", "ref_chunk", F.md5("quote").alias("digest"))


@query("SELECT item_id, text || E'\\n\\n【引用】\\n' || substr(text, 1, 10) || CASE WHEN substr(text, 3, 10) <> substr(text, 1, 10) THEN E'\\n\\n【引用】\\n' || substr(text, 3, 10) ELSE '' END AS filled, text AS own FROM benchmark")
def quote_fill_split(spark, sf_dir):
    a, b = F.substring("text", 1, 10), F.substring("text", 3, 10)
    own = table(spark, sf_dir, "benchmark").select("item_id", T.filled(F.col("text"), F.array(a, b, a, F.lit(""))).alias("filled"))
    return own.select("item_id", "filled", T.own_part(F.col("filled")).alias("own"))


@query("SELECT item_id, 'a ' || substr(text, 1, 12) || ' b  c' AS body FROM benchmark")
def quote_markers(spark, sf_dir):
    quotes = F.create_map(F.lit("q1"), F.substring("text", 1, 12))
    body = T.markers_replaced(F.lit("a [[QUOTE:q1]] b [[QUOTE:zz]] c"), quotes)
    return table(spark, sf_dir, "benchmark").select("item_id", body.alias("body"))


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN props WHEN 1 THEN props ELSE NULL END AS json FROM events")
def json_content(spark, sf_dir):
    kind = F.col("event_id") % 3
    answer = F.when(kind == 0, F.concat(F.lit("text ```json\n"), "props", F.lit("\n``` more"))).when(kind == 1, F.concat(F.lit("so: "), "props", F.lit(" done"))).otherwise("none")
    return table(spark, sf_dir, "events").select("event_id", T.json_content(answer).alias("json"))


# --- profiles, assets and workflow -----------------------------------------------------------------------------

_TERMS = ["the", "tion", "ment", "ción"]
_PRODUCTS = [(["ing"], "P one"), (["ver", "ado"], "P two")]
_INDUSTRIES = [(["keit"], "I one"), (["th"], "I two")]
_VALUES = [(["ou"], "V one")]


def _profiles(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where(F.length("text") > 0)
    return profiles.profiled(docs, "text", name=F.col("source"), techs=F.array(F.lit(" tion "), F.lit("")), terms=_TERMS, products=_PRODUCTS, industries=_INDUSTRIES, values=_VALUES, ends=".!?\n")


_SENT = "trim(coalesce(list_filter(string_split_regex(trim(text, E' \\n'), '[.!?\\n]'), lambda p: trim(p) <> '')[1], text), E' \\n\\t')"
_PROFILE_SQL = f"""SELECT doc_id, '企业定位：' || source || '；' || s || E'\\n核心技术：tion' || CASE WHEN contains(text, 'the') THEN '；the' ELSE '' END || CASE WHEN contains(text, 'ment') THEN '；ment' ELSE '' END || CASE WHEN contains(text, 'ción') THEN '；ción' ELSE '' END
 || E'\\n核心产品：' || p || E'\\n应用场景：' || p || E'\\n产业定位：' || CASE WHEN contains(text, 'keit') THEN 'I one' WHEN contains(text, 'th') THEN 'I two' ELSE '{profiles.NO_INDUSTRY}' END
 || E'\\n价值创造：' || CASE WHEN contains(text, 'ou') THEN 'V one' ELSE '{profiles.NO_VALUE}' END AS retrieval_text
FROM (SELECT doc_id, source, text, s, CASE WHEN a AND b THEN 'P one；P two' WHEN a THEN 'P one' WHEN b THEN 'P two' ELSE s END AS p FROM (SELECT doc_id, source, text, {_SENT} AS s, contains(text, 'ing') AS a, contains(text, 'ver') OR contains(text, 'ado') AS b FROM documents WHERE length(text) > 0))"""


@query(_PROFILE_SQL)
def retrieval_text(spark, sf_dir):
    return _profiles(spark, sf_dir).select("doc_id", profiles.retrieval_text().alias("retrieval_text"))


@query("SELECT doc_id, 2 + 1 + CAST(contains(text, 'the') AS INTEGER) + CAST(contains(text, 'ment') AS INTEGER) + CAST(contains(text, 'ción') AS INTEGER) + greatest(CAST(contains(text, 'ing') AS INTEGER) + CAST(contains(text, 'ver') OR contains(text, 'ado') AS INTEGER), 1) + 2 AS n_items FROM documents WHERE length(text) > 0")
def profile_items(spark, sf_dir):
    return _profiles(spark, sf_dir).select("doc_id", F.size(profiles.profile_items()).alias("n_items"))


@query()
def assets_materialized(spark, sf_dir):
    chunks = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("c"), F.col("item_id").cast("string")).alias("chunk_id"), F.col("text").alias("quote"))
    made = table(spark, sf_dir, "benchmark").select(
        F.element_at(F.array(*map(F.lit, assets.DIMENSIONS)), (F.col("item_id") % 4 + 1).cast("int")).alias("dimension"),
        F.col("item_id").cast("int").alias("pos"), F.lit(None).cast("string").alias("id"), F.lit("title").alias("title"),
        F.concat(F.lit("own words about it. "), F.substring("text", 5, 40)).alias("text"),
        F.array(F.lit("pos_1"), F.lit("zz")).alias("profile_ids"),
        F.array(F.concat(F.lit("c"), F.col("item_id").cast("string")), F.lit("none")).alias("chunk_ids"),
    )
    out = assets.materialized(made, chunks, "chunk_id", "quote", F.array(F.lit("pos_1")), 2, 12)
    return out.select("dimension", "pos", "id", "title", "text", F.array_join("profile_ids", ",").alias("profile_ids"), F.array_join("chunk_ids", ",").alias("chunk_ids"))


_STAGE = "CASE event_type WHEN 'signup' THEN 'profile' WHEN 'view' THEN 'recommendations' WHEN 'click' THEN 'selection' WHEN 'purchase' THEN 'assets' ELSE 'material' END"
_LAST = f"SELECT user_id, {_STAGE} AS stage, max(epoch_us(ts)) AS t, max(ts) AS last_at FROM events GROUP BY 1, 2"
_VALID = f"""SELECT a.user_id, a.stage, a.t AS last_us, NOT EXISTS (SELECT 1 FROM l b WHERE b.user_id = a.user_id AND b.o < a.o AND (b.t, b.e) > (a.t, a.e)) AS valid FROM l a"""
_L = f"WITH l AS (SELECT user_id, stage, o, t, max(event_id) AS e FROM (SELECT user_id, {_STAGE} AS stage, list_position(['profile','recommendations','selection','assets','material'], {_STAGE}) AS o, epoch_us(ts) AS t, event_id, max(epoch_us(ts)) OVER (PARTITION BY user_id, {_STAGE}) AS m FROM events) WHERE t = m GROUP BY ALL)"


def _valid(spark, sf_dir) -> DataFrame:
    names = {"signup": "profile", "view": "recommendations", "click": "selection", "purchase": "assets"}
    stage = F.coalesce(F.create_map(*(F.lit(x) for kv in names.items() for x in kv))[F.col("event_type")], F.lit("material"))
    own = table(spark, sf_dir, "events").select("user_id", stage.alias("stage"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "event_id")
    return workflow.valid_artifacts(own, "user_id", "stage", "us", "event_id")


@query(f"{_L} {_VALID}")
def workflow_invalidation(spark, sf_dir):
    return _valid(spark, sf_dir).select("user_id", "stage", F.col("last_at").alias("last_us"), "valid")


@query(f"""{_L}, v AS ({_VALID}), g AS (SELECT user_id, list_sort(list(list_position(['profile','recommendations','selection','assets','material'], stage)) FILTER (valid)) AS ok FROM v GROUP BY 1)
SELECT user_id, ['profile','recommendations','selection','assets','material'][n] AS furthest FROM (SELECT user_id, nullif(len(list_filter(coalesce(ok, []), lambda x, i: x = i)), 0) AS n FROM g)""")
def workflow_stage(spark, sf_dir):
    return workflow.furthest_stage(_valid(spark, sf_dir), "user_id")
