"""Registered queries of retrieval for many queries, reviews, materials and the article store."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserae.functions import text as T
from tesserae.operators import cleaning, corpus, retrieval, reviews
from tesserae.plans.catalog import _COS, _LINES, _TOP, _top, query, table
from tesserae.streaming import workspace

_LABELS = {"view": "seen", "click": "opened", "purchase": "bought"}


@query(f"""SELECT query_id, vec_id, label, round(score, 6) AS score, pos FROM (SELECT q.vec_id AS query_id, e.vec_id, e.label, {_COS} AS score,
 row_number() OVER (PARTITION BY q.vec_id ORDER BY round({_COS}, 9) DESC, e.vec_id) - 1 AS pos FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0) WHERE pos < 10""")
def retrieval_many(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    asked = rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    hits = retrieval.top_k_each(rows.select("vec_id", "embedding"), "embedding", asked, "query_id", "q", "vec_id", 10)
    found = retrieval.chunks_of_hits(hits, rows.select("vec_id", "label"), "vec_id")
    return found.select("query_id", "vec_id", "label", F.round("score", 6).alias("score"), "pos")


@query("SELECT count(*) AS records, CAST(ceil(count(*) / 10) AS BIGINT) AS batches, CAST(max(len(embedding)) AS BIGINT) AS dimensions FROM embeddings")
def index_stats(spark, sf_dir):
    return retrieval.index_stats(table(spark, sf_dir, "embeddings"), "embedding")


@query(f"WITH {_TOP} SELECT vec_id, label, pos FROM top WHERE vec_id IN (SELECT vec_id FROM embeddings WHERE label % 2 = 0)")
def evidence_selected(spark, sf_dir):
    chosen = table(spark, sf_dir, "embeddings").where("label % 2 = 0")
    return reviews.selected_evidence(_top(spark, sf_dir).select("vec_id", "label", "pos"), chosen, "vec_id")


@query("SELECT d.doc_id, d.source, coalesce(l.toxic = 1, true) AS is_demo FROM documents d LEFT JOIN labels l USING (doc_id)")
def evidence_list(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select("doc_id", (F.col("toxic") == 1).alias("is_demo"))
    return reviews.evidence_list(table(spark, sf_dir, "documents").select("doc_id", "source").join(labels, "doc_id", "left"), "is_demo")


@query("SELECT source, bool_or(coalesce(toxic = 1, true)) AS any_demo FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def demo_sources(spark, sf_dir):
    return evidence_list(spark, sf_dir).groupBy("source").agg(F.bool_or("is_demo").alias("any_demo"))


@query("SELECT doc_id, doc_id || '::' || source AS evidence_key, '[[QUOTE:' || doc_id || ']]' AS marker FROM documents")
def evidence_keys(spark, sf_dir):
    docs, doc = table(spark, sf_dir, "documents"), F.col("doc_id").cast("string")
    return docs.select("doc_id", reviews.evidence_key(doc, F.col("source")).alias("evidence_key"), reviews.quote_marker(doc).alias("marker"))


_TWO = "string_split(text, E'\\n')[1] AS a, string_split(text, E'\\n')[2] AS b"


@query(f"""SELECT doc_id, md5(trim(regexp_replace(replace(CASE WHEN b <> '' THEN replace(one, b, E'\\n') ELSE one END, '【引用】', E'\\n'), '\\n{{3,}}', E'\\n\\n', 'g'), E' \\n\\t\\r')) AS digest
FROM (SELECT doc_id, CASE WHEN length(a) >= length(b) OR b IS NULL THEN b ELSE a END AS b, CASE WHEN l <> '' THEN replace(text, l, E'\\n') ELSE text END AS one
 FROM (SELECT doc_id, text, a, b, CASE WHEN length(a) >= length(b) OR b IS NULL THEN a ELSE b END AS l FROM (SELECT doc_id, text, {_TWO} FROM documents)))""")
def body_without_quotes(spark, sf_dir):
    docs, lines = table(spark, sf_dir, "documents"), F.split("text", "\n")
    quotes = F.array_compact(F.array(F.try_element_at(lines, F.lit(1)), F.try_element_at(lines, F.lit(2))))
    return docs.select("doc_id", F.md5(reviews.without_quotes(F.col("text"), quotes)).alias("digest"))


@query("""SELECT doc_id, i - 1 AS idx, starts_with(parts[i], 'The') OR starts_with(parts[i], '【引用】') AND true AS marked, starts_with(parts[i], '【引用】') AS quoted, md5(parts[i]) AS digest FROM (SELECT doc_id, parts, unnest(generate_series(1, len(parts))) AS i
FROM (SELECT doc_id, list_filter(list_transform(string_split_regex(CASE WHEN doc_id % 2 = 0 THEN '【引用】' ELSE '' END || replace(text, E'\\n', E'\\n\\n'), '\\n{2,}'), lambda p: trim(p, E' \\n\\t\\r')), lambda p: p <> '') AS parts FROM documents))""")
def body_paragraphs(spark, sf_dir):
    body = F.concat(F.when(F.col("doc_id") % 2 == 0, "【引用】").otherwise(""), F.replace("text", F.lit("\n"), F.lit("\n\n")))
    own = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(reviews.body_paragraphs(body)).alias("idx", "p"))
    marked = F.startswith("p.text", F.lit("The")) | F.col("p.quoted")
    return own.select("doc_id", "idx", marked.alias("marked"), "p.quoted", F.md5("p.text").alias("digest"))


@query("SELECT event_id, printf('%.4f', value) AS value_text FROM events")
def fixed_scores(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", reviews.fixed(F.col("value")).alias("value_text"))


_CASE = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _LABELS.items())


@query(f"SELECT event_id, {_CASE} ELSE event_type END AS label FROM events")
def event_labels(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", reviews.label_of(F.col("event_type"), _LABELS).alias("label"))


@query(f"SELECT user_id, coalesce(string_agg({_CASE} END, ',' ORDER BY event_type), '') AS labels FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY 1")
def label_lists(spark, sf_dir):
    kinds = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("kinds"))  # of a few kinds
    return kinds.select("user_id", F.array_join(reviews.labels_of(F.col("kinds"), _LABELS), ",").alias("labels"))


_KINDS = ["purchase", "signup", "click", "error"]


@query("SELECT user_id, string_agg(day, ',' ORDER BY k, day) AS flat FROM (SELECT DISTINCT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, list_position(['purchase','signup','click','error'], event_type) AS k FROM events WHERE event_type <> 'view') GROUP BY 1")
def assets_flattened(spark, sf_dir):
    days = F.date_format("ts", "yyyy-MM-dd")
    one = lambda k: F.array_sort(F.collect_set(F.when(F.col("event_type") == k, days))).alias(k)  # noqa: E731  of a few days
    own = table(spark, sf_dir, "events").where("event_type <> 'view'").groupBy("user_id").agg(*map(one, _KINDS))
    return own.select("user_id", F.array_join(F.flatten(F.array(*_KINDS)), ",").alias("flat"))


@query("SELECT doc_id, 'l:' || lang || ':user|s:' || source || ':model' AS shown FROM documents")
def profile_shown(spark, sf_dir):
    item = lambda i, c, origin: F.struct(F.lit(i).alias("id"), F.col(c).alias("value"), F.lit(origin).alias("origin"), F.lit(0.5).alias("confidence"))
    shown = reviews.prompt_profile(F.array(item("l", "lang", "user"), item("s", "source", "model")))
    text = F.array_join(F.transform(shown, lambda x: F.concat_ws(":", x["id"], x["value"], x["origin"])), "|")
    return table(spark, sf_dir, "documents").select("doc_id", text.alias("shown"))


@query("SELECT conv_id, turn, CASE WHEN turn % 3 = 1 THEN nullif(trim(text, E' \\n\\t\\r'), '') ELSE CASE WHEN trim(text, E' \\n\\t\\r') <> '' THEN text END END AS content FROM conversations")
def message_content(spark, sf_dir):
    kind = F.col("turn") % 3
    part = F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("text")), F.struct(F.lit("image").alias("type"), F.lit(None).cast("string").alias("text")))
    said = [
        F.to_json(F.struct(F.array(F.struct(F.struct(x).alias("message"))).alias("choices")))
        for x in (F.col("text").alias("content"), part.alias("content"), F.col("text").alias("reasoning_content"))
    ]
    payload = F.when(kind == 0, said[0]).when(kind == 1, said[1]).otherwise(said[2])
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", reviews.message_content(payload).alias("content"))


@query("SELECT conv_id, string_agg(role, ',' ORDER BY turn) AS roles FROM conversations GROUP BY 1")
def results_in_order(spark, sf_dir):
    own = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("r"))  # of one conversation
    return own.select("conv_id", F.array_join("r.role", ",").alias("roles"))


@query("SELECT conv_id, string_agg(role, ',' ORDER BY t) AS roles FROM (SELECT conv_id, role, min(turn) AS t FROM conversations GROUP BY 1, 2) GROUP BY 1")
def unique_refs(spark, sf_dir):
    own = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("r"))  # of one conversation
    return own.select("conv_id", F.array_join(F.array_distinct("r.role"), ",").alias("roles"))


@query("SELECT source, arg_min(lang, doc_id) FILTER (lang IS NOT NULL AND doc_id % 3 = 1) AS lang FROM documents GROUP BY 1")
def first_present(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", F.when(F.col("doc_id") % 3 == 1, F.col("lang")).alias("lang"))
    return corpus.first_present(docs, "source", "lang", "doc_id")


@query(f"SELECT doc_id, *, empty + below_min + over_max AS anomalies FROM (SELECT doc_id, count(*) FILTER (s = 0) AS empty, count(*) FILTER (s > 0 AND s < 40) AS below_min, count(*) FILTER (s > 400) AS over_max FROM (SELECT doc_id, length(regexp_replace(p, '\\s', '', 'g')) AS s FROM ({_LINES})) GROUP BY 1)".replace("SELECT doc_id, *,", "SELECT *,"))
def chunk_anomalies(spark, sf_dir):
    own = table(spark, sf_dir, "documents").select("doc_id", F.explode(cleaning.paragraphs(F.col("text"), "\n+")).alias("p"))
    return corpus.chunk_anomalies(own, "doc_id", "p", 40, 400)


@query("SELECT sha256(text) AS text_sha, doc_id, count(*) OVER (PARTITION BY text) AS n FROM documents QUALIFY count(*) OVER (PARTITION BY text) > 1")
def duplicate_members(spark, sf_dir):
    return corpus.duplicate_members(table(spark, sf_dir, "documents"), "doc_id", "text")


@query("""WITH s AS (SELECT page_id, url, 'speech_' || CASE WHEN page_id < 1000 THEN lpad(CAST(page_id AS VARCHAR), 3, '0') ELSE CAST(page_id AS VARCHAR) END AS id FROM pages WHERE page_id % 3 <> 0 QUALIFY row_number() OVER (PARTITION BY url ORDER BY page_id) = 1),
m AS (SELECT max(page_id) AS m FROM s), f AS (SELECT page_id, url FROM pages WHERE page_id % 2 = 0),
n AS (SELECT url, row_number() OVER (ORDER BY p) + m AS k FROM (SELECT url, min(page_id) AS p FROM f WHERE url NOT IN (SELECT url FROM s) GROUP BY 1), m)
SELECT id, url, CASE WHEN url IN (SELECT url FROM f) THEN 'old,new' ELSE 'old' END AS keywords FROM s
UNION ALL SELECT 'speech_' || CASE WHEN k < 1000 THEN lpad(CAST(k AS VARCHAR), 3, '0') ELSE CAST(k AS VARCHAR) END, url, 'new' FROM n""")
def article_upsert(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    store = pages.where("page_id % 3 <> 0").groupBy("url").agg(F.min("page_id").alias("n"))
    store = store.select(T.numbered_id(F.lit("speech"), F.col("n"), "_").alias("id"), "url", F.lit(None).cast("string").alias("article_id"), F.array(F.lit("old")).alias("keywords"))
    found = pages.where("page_id % 2 = 0").select("page_id", "url", F.lit(None).cast("string").alias("article_id"), F.array(F.lit("new")).alias("keywords"))
    return corpus.saved(store, found, "page_id").select("id", "url", F.array_join("keywords", ",").alias("keywords"))


@query("SELECT item_id, CASE WHEN item_id % 2 = 0 THEN '" + reviews.NO_REASON + "' ELSE 'Nr 7!' END AS reason FROM benchmark")
def safe_reasons(spark, sf_dir):
    said = F.when(F.col("item_id") % 2 == 0, F.concat(F.lit("「"), "text", F.lit("」。"))).otherwise("Nr 7!")
    return table(spark, sf_dir, "benchmark").select("item_id", reviews.safe_reason(said, F.col("text"), 12).alias("reason"))


@query("SELECT item_id, CASE item_id % 8 WHEN 0 THEN 'no_asset' WHEN 1 THEN 'unknown_asset' WHEN 2 THEN 'no_evidence,documents_not_derived' WHEN 3 THEN 'documents_not_derived' WHEN 4 THEN 'leaked_fragment' WHEN 5 THEN 'foreign_evidence' WHEN 6 THEN 'quote_missing' ELSE '' END AS violations FROM benchmark")
def material_violations(spark, sf_dir):
    case, ids = F.col("item_id") % 8, F.array(F.lit("c1"))
    none = F.array().cast("array<string>")
    body = F.concat(F.lit("Q7 Z9"), F.when(case == 4, F.concat(F.lit(" "), F.expr("substring(text, 3, 24)"))).otherwise(""), F.lit("\n\n【引用】\n"), F.when(case == 6, "").otherwise(F.col("text")))
    used = F.when(case == 2, none).when(case == 5, F.array(F.lit("c1"), F.lit("c9"))).otherwise(ids)
    broken = reviews.material_violations(
        body, F.when(case == 0, none).when(case == 1, F.array(F.lit("a9"))).otherwise(F.array(F.lit("a1"))), F.array(F.lit("a1"), F.lit("a2")), used,
        F.create_map(F.lit("c1"), F.col("text")), F.when(case == 2, none).otherwise(F.array(F.lit("d1"), F.lit("d1"))),
        F.when(case == 3, F.array(F.lit("d2"))).otherwise(F.array(F.lit("d1"))), 12,
    )
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(broken, ",").alias("violations"))


_ACTIONS = [
    "PROFILE_GENERATED", "CONFIRM_PROFILE", "RECOMMENDATIONS_LOADED", "TOGGLE_EVIDENCE", "ASSETS_LOADED", "UPDATE_ASSET", "CONFIRM_ASSETS", "MATERIAL_LOADED",
    "SET_VIEWING", "TOGGLE_EVIDENCE", "ASSETS_LOADED", "REMOVE_ASSET", "SET_SCENARIO", "UPDATE_PROFILE_ITEM", "FAIL", "REQUEST", "CLEAR_ERROR", "CONFIRM_ASSETS",
    "ASSETS_LOADED", "TOGGLE_EVIDENCE",
]


def workspace_actions(spark, sf_dir):
    """Every event as an action of its user's session; what it says follows from the event's columns."""
    events, k = table(spark, sf_dir, "events"), F.col("event_id")
    kind = F.element_at(F.array(*map(F.lit, _ACTIONS)), (F.pmod(k * 7 + F.length("event_type"), F.lit(len(_ACTIONS))) + 1).cast("int"))
    step = F.element_at(F.array(*map(F.lit, workspace.STEPS)), (k % 5 + 1).cast("int"))
    chunk = F.concat(F.lit("c"), (k % 2).cast("string"))
    arg = F.when(kind == "SET_VIEWING", step).when(kind == "TOGGLE_EVIDENCE", chunk).when(kind == "REMOVE_ASSET", "a1").otherwise(F.col("event_type"))
    ids = F.when(k % 3 == 0, F.array(F.lit("c1"), F.lit("c0"))).when(k % 3 == 1, F.array(chunk)).otherwise(F.array().cast("array<string>"))
    own = {"kind": kind, "arg": arg, "ids": ids, "items": F.array(F.lit("a1"), F.lit("a2")), "n": (k % 4).cast("int"), "incomplete": k % 5 == 0}
    return events.select("user_id", "event_id", *(v.alias(c) for c, v in own.items()))


@query()
def workspace_fold(spark, sf_dir):
    out = workspace.workspaces(workspace_actions(spark, sf_dir), "user_id", "event_id")
    return out.withColumns({"selected": F.array_join("selected", ","), "assets": F.array_join("assets", ",")})
