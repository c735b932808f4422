"""Flags, summaries, labels, slices in UTF-16 units, leftovers of dropped ids, and a reranker's answers."""

import json

from pyspark.sql import functions as F

from tesserae.operators import chunking, cleaning, corpus, retrieval, reviews
from tesserae.sources import markdown
from tesserae.streaming import workspace


def test_review_flags(spark):
    cases = [
        ("题", "　 \n", 1, ["empty_body"]), ("强调一", "甲" * 10, 0, ["empty_body", "news_like_title"]), (None, None, 1, ["empty_body"]),
        ("题", "甲" * 199 + "　", 1, ["short_body"]), ("题", "甲" * 200, 1, []), ("在京召开", "甲" * 200 + "（新华社某地1月电）", 2, ["inline_noise_left", "news_like_title"]),
        ("题", "甲" * 200 + "《　人民日报 》", 1, ["inline_noise_left"]),
    ]
    rows = spark.createDataFrame([(k, *c[:3]) for k, c in enumerate(cases)], "k int, title string, body string, n int")
    got = rows.select("k", cleaning.review_flags(F.col("title"), F.col("body"), F.col("n")).alias("f")).collect()
    assert {r.k: r.f for r in got} == {k: c[3] for k, c in enumerate(cases)}


def test_stats(spark):
    articles = spark.createDataFrame([("2024-01-01", None, ["a", "b"]), (None, "", ["b"]), ("", "x", []), ("2024-02-02", "y", None)], "date string, origin string, themes array<string>")
    failures = spark.createDataFrame([("u",)] * 3, "url string")
    assert corpus.store_stats(articles, failures, 1).first().asDict() == {"saved": 4, "missing_date": 2, "missing_origin": 2, "failures": 3, "new_failures": 2}
    assert corpus.store_stats(articles, failures.limit(0), 1).first().new_failures == 0
    themes = spark.createDataFrame([("a", 1), ("b", 2), ("c", 1)], "theme string, target int")
    got = {r.theme: (r.primary, r.tagged, r.short, r.status) for r in corpus.theme_status(articles, themes).collect()}
    assert got == {"a": (1, 1, 0, "OK"), "b": (1, 2, 1, "不足 1"), "c": (0, 0, 1, "不足 1")}
    chunks = spark.createDataFrame([(1, "　 \xa0"), (1, "甲　乙"), (1, "甲乙丙丁")], "d int, t string")
    assert tuple(corpus.chunk_anomalies(chunks, "d", "t", 3, 3).first()) == (1, 1, 1, 1, 3)


def test_review_helpers(spark):
    one = spark.createDataFrame([([("a", "　T ", " own \n\n【引用】\n q ")], ["x", "y", "x"], ["y", "x", "x"], ["x", "y"])], "a array<struct<id: string, title: string, text: string>>, i array<string>, j array<string>, k array<string>")
    got = one.select(
        reviews.normalized_assets(F.col("a")).alias("n"), reviews.updated_text(F.col("a")[0]["text"], F.lit("new")).alias("u"), reviews.same_ids(F.col("i"), F.col("j")).alias("s"),
        reviews.same_ids(F.col("i"), F.col("k")).alias("d"), reviews.same_ids(F.lit(None).cast("array<string>"), F.array().cast("array<string>")).alias("e"),
    ).first()
    assert tuple(got.n[0]) == ("a", "T", "own\n\n【引用】\n q ") and got.u == "new\n\n【引用】\n q " and (got.s, got.d, got.e) == (True, False, True)
    chunks = spark.createDataFrame([("c1", "T", "S", "2024", False), ("c2", "U", "S", None, True)], "chunk string, title string, source string, date string, demo boolean")
    refs = spark.createDataFrame([("c1",), ("c2",), ("c9",)], "chunk string")
    assert {r.chunk: r.shown for r in reviews.provenances(refs, chunks, "chunk", "demo").collect()} == {"c1": "T · S · 2024", "c2": "U · S · 日期待考（演示占位文本）", "c9": "c9"}


def test_declared_stages(spark):
    kinds = ", ".join(f"{k}: {v}" for k, v in workspace.STATE.items())
    base = dict.fromkeys(workspace.STATE) | workspace.START | {"selected": []}
    steps = [{}, {"profile": True}, {"profile_confirmed": True}, {"recommendations": 2}, {"selected": ["c"]}, {"assets": []}, {"assets_confirmed": True}, {"material": True}]
    rows, now = [], base
    for k, step in enumerate(steps):
        now = now | step
        rows.append((k, now))
    rows.append((9, base | {"material": True}))
    got = dict(map(tuple, spark.createDataFrame(rows, f"k int, s struct<{kinds}>").select("k", workspace.workflow_stage(F.col("s"))).collect()))
    names = workspace.WORKFLOW_STAGES
    assert got == {0: None, **{k: names[k - 1] for k in range(1, 7)}, 7: names[7], 9: None}


def test_slices_in_utf16_units(spark):
    def sliced(text, most):
        units = lambda s: len(s.encode("utf-16-le")) // 2
        out = [""]
        for c in text:
            out = [*out[:-1], out[-1] + c] if units(out[-1] + c) <= most else [*out, c]
        return out

    for text in ("😀" * 7 + "ab" * 5, "a😀" * 9, "甲" * 17, "ab😀", "😀😀。甲乙。丙丁戊己庚", "a"):
        row = spark.createDataFrame([(text,)], "t string").select(chunking.paragraph_pieces(F.col("t"), 5).alias("p")).first()
        assert "".join(row.p) == text and all(len(p.encode("utf-16-le")) // 2 <= 5 for p in row.p)
        if "。" not in text:
            assert row.p == sliced(text, 5)


def test_leftovers_of_dropped_ids(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = spark.createDataFrame([("d1", "x"), ("a=b/c", "y"), ("d3", "z")], "doc string, t string")
    markdown.write_chunks(rows, path, "doc")
    gone = spark.createDataFrame([("a=b/c",), ("never",), (None,), ("d1",)], "doc string")
    assert markdown.write_chunks(rows.where("doc = 'd3'").withColumn("t", F.lit("new")), path, "doc", gone) == 2
    assert [tuple(r) for r in spark.read.json(path).select("doc", "t").collect()] == [("d3", "new")]


def test_a_client_reranks(spark):
    candidates = spark.createDataFrame([("s", f"c{k}", "T", None, ["k"], f"text {k}", 0.123456, k) for k in range(3)], "s string, chunk_id string, title string, date string, keywords array<string>, text string, score double, pos int")
    items = spark.createDataFrame([("s", "p1", "v", "explicit", 0)], "s string, id string, value string, origin string, pos int")
    prompt = retrieval.rerank_prompts(candidates, items, "s").first().prompt
    task, payload = prompt.split("\n", 1)
    payload = json.loads(payload)
    assert task == retrieval.RERANK_TASK and [c["chunkId"] for c in payload["candidates"]] == ["c0", "c1", "c2"] and payload["candidates"][0]["retrievalScore"] == 0.1235
    assert payload["profileItems"] == [{"id": "p1", "value": "v", "origin": "explicit"}]
    good = {"results": [{"chunkId": "c2", "relevance": "strong", "reason": "r", "profileEvidenceIds": ["p1"]}, {"chunkId": "c0", "relevance": "irrelevant", "reason": "n"}]}
    bad = {"results": [good["results"][0], {**good["results"][1], "relevance": "great"}]}
    answers = spark.createDataFrame([("s", "so: " + json.dumps(good)), ("t", "none"), ("u", json.dumps({"results": []})), ("v", json.dumps(bad))], "s string, answer string")
    results, errors = retrieval.rerank_results(answers, "s")
    assert dict(map(tuple, errors.collect())) == {"t": "no_json", "u": "no_results", "v": "[1].relevance_unknown"}
    ranked = retrieval.apply_rerank(candidates, results.drop("s"), "chunk_id").orderBy("rank").collect()
    assert [(r.chunk_id, r.relevance, r.profile_ids) for r in ranked] == [("c2", "strong", ["p1"]), ("c0", "irrelevant", []), ("c1", "weak", [])]
    assert ranked[2].reason == retrieval.FALLBACK


def test_preflight_counts_chunks_that_are_not_in_their_text(spark):
    docs = spark.createDataFrame([(1, "a b c", "x"), (2, None, "x"), (3, "é", "x")], "id long, text string, sha string")
    docs = docs.withColumn("sha", F.when(F.col("id") == 1, F.sha2("text", 256)).otherwise(F.col("sha")))
    rows = [(1, "a"), (1, "b c"), (1, "bc"), (1, "bc"), (1, None), (2, "a"), (3, "e"), (4, "gone"), (None, "a")]
    chunks = spark.createDataFrame(rows, "id long, chunk string")
    got = corpus.preflight(docs, chunks, "id", "text", "chunk", "sha").first()
    assert tuple(got) == (3, 3, 1, 7, 3)
    assert tuple(corpus.preflight(docs, chunks.limit(0), "id", "text", "chunk", "sha").first()) == (3, 3, 1, 0, 0)


def test_provenance_of_numeric_ids(spark):
    refs = spark.createDataFrame([(1,), (2,), (None,)], "id long")
    known = spark.createDataFrame([(1, "t", "s", None, True)], "id long, title string, source string, date string, demo boolean")
    got = {r.id: r.shown for r in reviews.provenances(refs, known, "id", "demo").collect()}
    assert got == {1: "t · s · 日期待考（演示占位文本）", 2: "2", None: None}
