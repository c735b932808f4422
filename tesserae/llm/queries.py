"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tesserae.llm.packing import pack

    pieces = pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2048, 1)
    return pieces.select("doc_id", "start", "length", F.crc32("token_ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_claimed_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesserae.llm.sharding import place

    shards = [f"shard-{k:03d}" for k in range(64)]
    return place(_table(spark, sf_dir, "documents").select("doc_id"), ["doc_id"], shards)


def op3_output_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesserae.llm.common import fold
    from tesserae.llm.langid import identify, train

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False))
    model = train(docs, ~held_out & F.col("doc_id").isNotNull())
    return identify(docs.withColumn("held_out", held_out), model, keep=("doc_id", "held_out"))


def op4_line_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesserae.llm.common import fold
    from tesserae.llm.quality import score, train

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False))
    labels = _table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    model = train(docs.where(~held_out), labels)
    out = score(docs.withColumn("held_out", held_out), model, keep=("doc_id", "held_out"))
    return out.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op5_character_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesserae.llm.secrets import scan, train

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan(docs, train(docs))
    joined = lambda spans: F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *(count(kind).alias(f"n_{kind}") for kind in ("assign", "access", "hex")),
        F.sha2(joined(F.filter("spans", lambda s: s["kind"] != "network")), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        count("network").alias("n_network"),
    )


def op6_shifted_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesserae.llm.vector_search import search

    return search(_table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 20 == 0, 20)


def op7_raked_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesserae.llm.mixing import mix

    return mix(_table(spark, sf_dir, "documents"), share=0.5, power=0.7)


def op8_stable_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesserae.llm.vector_dedup import near_vectors

    return near_vectors(_table(spark, sf_dir, "embeddings"), 0.9)


def op9_prefix_free_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesserae.llm.repeats import remove_repeats

    return remove_repeats(_table(spark, sf_dir, "documents"), 100).drop("kept")


def op10_signature_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesserae.llm.ngram_join import near_sets

    return near_sets(_table(spark, sf_dir, "documents"), 5, (80, 100)).select("doc_id", "n_shingles", "component_id")


def op11_group_quadtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesserae.llm.divergence import audit

    return audit(_table(spark, sf_dir, "documents"), min_docs=10, top=10)


def op12_paired_variances(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesserae.llm.whitening import whiten

    out = whiten(_table(spark, sf_dir, "embeddings"), components=8)
    return out.withColumn("deviation", F.expr("try_cast(deviation AS long)"))  # null where it needs more than 64 bits


def op13_word_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tesserae.llm.lexicon import decode, encode

    path = public_tokenizers.path("word_bpe_49k.json")
    out = decode(encode(_table(spark, sf_dir, "documents"), path), path)
    return out.select("doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_curve_packing": op1_curve_packing,
    "op2_claimed_slots": op2_claimed_slots,
    "op3_output_codes": op3_output_codes,
    "op4_line_field": op4_line_field,
    "op5_character_network": op5_character_network,
    "op6_shifted_curves": op6_shifted_curves,
    "op7_raked_mix": op7_raked_mix,
    "op8_stable_hashing": op8_stable_hashing,
    "op9_prefix_free_parsing": op9_prefix_free_parsing,
    "op10_signature_trees": op10_signature_trees,
    "op11_group_quadtree": op11_group_quadtree,
    "op12_paired_variances": op12_paired_variances,
    "op13_word_transducer": op13_word_transducer,
    "pipeline": pipeline,
}
_REACH = """r AS (SELECT id AS node, id AS root FROM ids UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.node),
c AS (SELECT node, min(root) AS component_id FROM r GROUP BY 1)"""

_NEAR_VECTORS = f"""WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS m FROM embeddings),
ids AS (SELECT vec_id AS id FROM v),
l AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id <> y.vec_id AND list_dot_product(x.e, y.e) >= 0.9 * x.m * y.m AND x.m > 0 AND y.m > 0),
{_REACH}
SELECT vec_id, (SELECT count(*) FROM l WHERE a = vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN c ON node = vec_id"""

_NEAR_SETS = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
ids AS (SELECT doc_id AS id FROM w),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
{_REACH}
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, component_id FROM w LEFT JOIN n USING (doc_id) JOIN c ON c.node = w.doc_id"""

_NEAREST = """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL AND list_aggregate(list_transform(embedding, lambda x: CASE WHEN x <> 0 THEN 1 ELSE 0 END), 'sum') > 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, list_reduce(list_transform(list_zip(q.e, v.e), lambda x: x[1] * x[2]), lambda a, b: a + b) AS score FROM v q JOIN v ON q.vec_id % 20 = 0 AND v.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20"""

_DIVERGENCE = """WITH d AS (SELECT row_number() OVER () AS k, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
w AS (SELECT k, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
t AS (SELECT lang, term, count(*) AS n FROM w GROUP BY 1, 2 HAVING count(DISTINCT k) >= 10),
l AS (SELECT lang, count(*) AS v, sum(n) AS total FROM t GROUP BY 1),
c AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN t USING (lang, term) GROUP BY 1, 2, 3),
s AS (SELECT DISTINCT lang, source FROM d),
g AS (SELECT lang, source, coalesce(sum(n), 0) AS total FROM s LEFT JOIN c USING (lang, source) GROUP BY 1, 2),
m AS (SELECT lang, source, term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (g.total + 2 * l.v) AS p,
  1 + (1000000000::HUGEINT * (t.n + 2)) // (l.total + 2 * l.v) AS q FROM g JOIN l USING (lang) JOIN t USING (lang) LEFT JOIN c USING (lang, source, term)),
f AS (SELECT x.lang, x.source, y.source AS item, sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p)) AS value FROM m x JOIN m y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY 1, 2, 3),
o AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(f.value, 0) AS value FROM s x JOIN s y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN f ON f.lang = x.lang AND f.source = x.source AND f.item = y.source
UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q)) // (p + q) FROM m WHERE n > 0 AND p > q),
r AS (SELECT lang, source, part, item, value::BIGINT AS value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank FROM o)
SELECT * FROM r WHERE part = 'pair' OR rank <= 10"""

#: The other operators train a model, tokenize, or work on bytes, which SQL cannot express.
ORACLES: dict[str, str] = {"op6_shifted_curves": _NEAREST, "op8_stable_hashing": _NEAR_VECTORS, "op10_signature_trees": _NEAR_SETS, "op11_group_quadtree": _DIVERGENCE}
