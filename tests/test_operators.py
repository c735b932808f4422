"""Rules that the given tables do not reach, on invented texts."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tesserae.functions import text as T
from tesserae.operators import assets, chunking, cleaning, corpus, evidence, fragments, profiles, quality, retrieval
from tesserae.sources import markdown, pages
from tesserae.streaming import workflow


def one(spark, column, **values):
    kinds = {str: "string", int: "int", list: "array<string>", dict: "map<string,string>"}
    schema = ", ".join(f"{k} {kinds.get(type(v), 'string')}" for k, v in values.items()) or "x int"
    return spark.createDataFrame([tuple(values.values()) or (1,)], schema).select(column.alias("r")).first().r


def cases():
    return [
        (T.ascii_trim(F.lit(" \t　甲\r\n")), "　甲"),
        (T.compact(F.lit(" 　　甲 ")), "甲"),
        (T.unicode_trim(F.lit("﻿　 甲　")), "甲"),
        (T.measure(F.lit("甲 　\n乙")), 2),
        (T.utf16_length(F.lit("a😀")), 3),
        (T.count_phrase(F.lit("aaaa"), F.lit("aa")), 2),
        (T.count_phrase(F.lit("aaaa"), F.lit("")), 0),
        (T.ngrams(F.lit("abcd"), 3), ["abc", "bcd"]),
        (T.ngrams(F.lit("ab"), 3), []),
        (T.blocks(F.lit("abcdefg"), 3), ["abc", "def"]),
        (T.first_sentence(F.lit("。 。甲乙。丙")), "甲乙"),
        (T.first_sentence(F.lit("。。")), "。。"),
        (T.trimmed_values(F.array(F.lit(" a "), F.lit(""), F.lit("a"), F.lit("b"))), ["a", "b"]),
        (T.numbered_id(F.lit("d"), F.lit(1234), "_c"), "d_c1234"),
        (T.numbered_id(F.lit("d"), F.lit(7), "_c"), "d_c007"),
        (T.filled(F.lit("x"), F.array(F.lit("q"), F.lit("q"), F.lit(""))), "x\n\n【引用】\nq"),
        (T.quote_part(T.filled(F.lit("x"), F.array(F.lit("q")))), "\n\n【引用】\nq"),
        (T.yaml_scalar(F.lit("a: b")), '"a: b"'),
        (T.yaml_scalar(F.lit("true")), '"true"'),
        (T.yaml_scalar(F.lit("plain")), "plain"),
        (T.ymd(F.lit("on 2024-05-06 or 2023-01-01")), "2024-05-06"),
        (T.json_content(F.lit('so ```json\n{"a": 1}\n``` end')), '{"a": 1}'),
        (T.json_content(F.lit("none")), None),
        (quality.title_skip(F.lit(" ")), "empty_title"),
        (quality.title_skip(F.lit("在会见某人时的讲话")), None),
        (quality.title_skip(F.lit("会见某人")), "会见"),
        (quality.title_skip(F.lit("在学习贯彻研讨班上的讲话")), None),
        (quality.title_skip(F.lit("学习贯彻研讨班上的讲话 考察时")), "学习贯彻"),
        (quality.title_skip(F.lit("某人同某人会谈")), "同.*会谈"),
        (fragments.contains_fragment(F.lit("一二三四五"), F.lit("x二三四五y"), 4), True),
        (fragments.contains_fragment(F.lit("一二三四五"), F.lit("x二三四y"), 4), False),
        (fragments.contains_fragment(F.lit("一二三"), F.lit("二三"), 4), True),
        (fragments.contains_fragment(F.lit(""), F.lit("二三"), 1), False),
        (fragments.is_blank(F.lit(" ，。（） ")), True),
        (fragments.has_artifacts(F.lit("甲 乙")), True),
        (fragments.has_artifacts(F.lit("甲乙。")), False),
        (pages.article_id(F.lit("http://x/article/123456?a=98765")), "123456"),
        (pages.article_id(F.lit("http://x/1234")), None),
        (pages.search_url("http://x", F.lit("甲 b"), F.lit(2)), "http://x/result?keywords=%E7%94%B2+b&isFuzzy=1&searchArea=0&sortType=2&page=2"),
        (retrieval.cosine(F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(3.0), F.lit(4.0), F.lit(9.0))), 1.0),
        (retrieval.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0))), 0.0),
    ]


def test_columns(spark):
    own = cases()
    got = spark.range(1).select(*(c.alias(f"c{k}") for k, (c, _) in enumerate(own))).first()
    for k, (_, want) in enumerate(own):
        assert got[k] == want, own[k]


LINES = [
    ("", "empty_paragraph"), ("　　标题一※", "duplicate_title"), ("# 习近平：标题一", "duplicate_title"), ("习近平", "author_byline"),
    ("（新华社某地1月2日电）", "xinhua_dateline"), ("《 人民日报 》（ 2024年01月02日 03 版）", "people_daily_edition"),
    ("新华社记者 某某 摄", "photo_caption"), ("图为某地景色。某某摄", "photo_caption"), ("※ 注", "source_note"), ("（2024年1月2日）", "speech_date_line"),
    ("责任编辑：某某", "editor_line"), ("■ 摘", "pull_quote"), ("（完）", "the_end"), ("新华社某地电 全文如下", "xinhua_lead"), ("正文。", None),
]


def test_cleaning_rules(spark):
    df = spark.createDataFrame(LINES, "p string, want string").withColumn("title", F.lit("习近平：标题一"))
    got = df.select("p", "want", cleaning.classify(F.col("p"), F.col("title")).alias("c")).collect()
    assert [(r.p, r.c.reason) for r in got] == LINES


def test_cleaned_document(spark):
    text = "标题\n\n　　第一段。\r\n \r\n（2024年1月2日）\n\n（完）\n\n第二段。"
    r = cleaning.cleaned(spark.createDataFrame([(text, "标题"), (None, None)], "t string, title string"), "t", "title").collect()
    assert r[0].body == "　　第一段。\n\n第二段。" and r[0].note == "（2024年1月2日）" and r[0].flags == ["short_body"]
    assert [(x.reason, x.text) for x in r[0].removed] == [("duplicate_title", "标题"), ("moved:speech_date_line", "（2024年1月2日）"), ("the_end", "（完）")]
    assert (r[0].paragraphs_in, r[0].paragraphs_kept) == (5, 2)
    assert r[1].body == "" and r[1].flags == ["empty_body"]


def test_relevance(spark):
    phrases, kw = F.array(F.lit("产业"), F.lit("创新")), F.lit("科技")
    skip = lambda t, b: one(spark, quality.relevance_skip(F.lit(t), F.lit(b), kw, phrases))
    assert skip("某讲话", "科技科技科技") is None
    assert skip("某讲话", "产业创新科技") is None
    assert skip("某讲话", "产业") == "weak_topic_match:distinct=1,hits=1,keyword_hits=0,speech_like_title"
    assert skip("产业", "无") == "weak_topic_match:distinct=0,hits=0,keyword_hits=0,title_theme=产业"
    assert skip("科技", "无") is None
    assert skip("新闻", "科技" * 9) == "not_speech_or_theme_title"


def test_paragraph_chunks(spark):
    text = "短段。\n\n" + "一二三四。" * 5 + "\n\n" + "甲" * 23 + "\n\n \n\n末"
    got = [r.chunk_text for r in chunking.paragraph_chunks(spark.createDataFrame([("d", text)], "id string, t string"), "id", "t", 10).orderBy("chunk_index").collect()]
    assert got == ["短段。", "一二三四。" * 2, "一二三四。" * 2, "一二三四。", "甲" * 10, "甲" * 10, "甲" * 3, "末"]
    assert all(x in text for x in got)


def test_span_chunks(spark):
    text = "\n\n".join(["一" * 100, "二" * 250, "三" * 700, "四" * 50, ("五" * 99 + "。") * 17, "六" * 20])
    rows = chunking.span_chunks(spark.createDataFrame([("d", text), ("e", ""), ("f", None)], "id string, t string"), "id", "t").orderBy("chunk_index").collect()
    assert {r.id for r in rows} == {"d"} and [r.chunk_index for r in rows] == list(range(len(rows)))
    assert all(r.chunk_text == text[r.char_start : r.char_end] for r in rows)
    assert [r.char_count for r in rows] == [350, 750, 800, 920]  # a short last span joins the one before it
    assert chunking.Spans("短", 300, 800, "。", r"\n\n").chunks() == [(0, 1)]
    assert chunking.Spans("短\n\n" + "长" * 900, 300, 800, "。", r"\n\n").chunks() == [(0, 903)]


def test_strip():
    canon = "坚持创新驱动发展战略"
    got = fragments.stripped(f"我们要{canon}，并加强合作。", [canon])
    assert canon[:4] not in got and "加强合作" in got
    assert fragments.stripped("毫无关系的文字。", [canon]) == "毫无关系的文字。"
    assert fragments.stripped(canon, [canon]) == ""
    assert fragments.longest("xabcdyabcd", "zabcdabc") == "abcd" and fragments.longest("abxcd", "cdab") == "ab" and fragments.longest("", "a") == ""
    for piece in ("甲、", "以及乙"), ("甲，", "，乙"), ("完。", "。再"), ("在", "方面努力"), ("甲", "一、乙"):
        assert not fragments._joined(*piece).startswith(("，", "、"))
    assert fragments._joined("甲，", "，乙") == "甲，乙" and fragments.tidied(fragments._joined("完。", "。再")) == "完。再" and fragments._joined("甲", "一、乙") == "甲\n一、乙"


def test_rerank_and_recommendation(spark):
    c = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "id string, pos int")
    results = spark.createDataFrame([("zz", 0, "strong"), ("c", 1, "irrelevant"), ("c", 2, "strong"), ("a", 3, "medium")], "id string, result_pos int, relevance string")
    ranked = retrieval.apply_rerank(c, results, "id")
    assert [(r.id, r.relevance) for r in ranked.orderBy("rank").collect()] == [("c", "irrelevant"), ("a", "medium"), ("b", "weak")]
    assert [r.id for r in retrieval.recommended(ranked, 1).collect()] == ["a"]
    none = ranked.withColumn("relevance", F.lit("irrelevant"))
    assert [r.id for r in retrieval.recommended(none, 2).collect()] == ["c", "a"]


def test_cap_follows_top_k(spark):
    rows = spark.createDataFrame([(k, "x" if k < 3 else "y", [1.0, k / 10]) for k in range(6)], "id int, g string, v array<double>")
    q = spark.createDataFrame([([1.0, 0.0],)], "q array<double>")
    top = retrieval.top_k(rows, "v", q, "q", "id", 3)
    assert [r.id for r in retrieval.group_cap(top, "g", 2).orderBy("pos").collect()] == [0, 1]  # not filled up from below the top


def test_embedding_client(spark):
    df = spark.createDataFrame([(f"t{k}",) for k in range(23)], "t string")
    out = retrieval.embedded(df, "t", lambda texts: [[float(len(texts)), float(t[1:])] for t in texts], batch=10, dims=2).collect()
    assert all(r.vector[1] == float(r.t[1:]) and r.vector[0] <= 10 for r in out)
    with pytest.raises(Exception, match="another number"):
        retrieval.embedded(df, "t", lambda texts: [[1.0]], dims=1).collect()


def test_index_changes(spark):
    a, b = (spark.createDataFrame(x, "id int, sha string") for x in ([(1, "a"), (2, "b")], [(2, "c"), (3, "d")]))
    assert sorted(map(tuple, retrieval.index_changes(a, b, "id", "sha").collect())) == [(1, "stale"), (2, "changed"), (3, "missing")]
    assert sorted(map(tuple, retrieval.upserted(a, b, "id").collect())) == [(1, "a"), (2, "c"), (3, "d")]


def test_evidence(spark):
    chunks = spark.createDataFrame([("d", "c1", "甲😀"), ("d", "c2", "乙")], "doc string, chunk string, t string")
    refs = spark.createDataFrame([("d", "c1", 0, 3), ("d", "c1", 0, 3), ("d", "c2", 0, 2), ("e", "c2", 0, 1), ("d", "c9", 0, 1), ("d", "c2", 1, 1)], "ref_doc string, ref_chunk string, start_index int, end_index int")
    bad = evidence.violations(refs, chunks, "doc", "chunk", "t").collect()
    assert sorted(r.violation for r in bad) == ["not_whole_chunk", "not_whole_chunk", "unknown_chunk", "wrong_document"]
    good = evidence.resolved(refs.limit(2), chunks, "doc", "chunk", "t", "start_index").collect()
    assert [r.quote for r in good] == ["甲😀"]
    with pytest.raises(Exception, match="whole known chunk"):
        evidence.resolved(refs, chunks, "doc", "chunk", "t", "start_index").collect()


def test_profiles(spark):
    rows = spark.createDataFrame([("面向汽车制造的人工智能公司。提供柔性生产。", "名", None, ["大模型", " 大模型 "]), ("", None, "行业", None)], "d string, n string, i string, t array<string>")
    a, b = profiles.profiled(rows, "d", F.col("n"), F.col("i"), F.coalesce("t", F.array().cast("array<string>"))).collect()
    assert [(x.id, x.value, x.confidence) for x in a.positioning] == [("pos_1", "名", "high"), ("pos_2", "面向汽车制造的人工智能公司", "medium")]
    assert [x.value for x in a.technology] == ["大模型", "人工智能"] and [x.value for x in a.industry] == ["汽车制造"]
    assert len(a.products) == 2 and [x.origin for x in b.industry] == ["explicit"] and b.technology[0].confidence == "low"
    text = profiles.profiled(rows, "d").select(profiles.retrieval_text().alias("r")).first().r
    assert text.count("\n") == 5 and text.startswith("企业定位：")
    items = F.array(F.struct(F.lit("p1").alias("id"), F.lit("人工智能").alias("value")), F.struct(F.lit("p2").alias("id"), F.lit("汽车业").alias("value")))
    assert one(spark, profiles.matched_items(F.lit("发展人工智能"), F.array(F.lit("汽车")), items)) == ["p1", "p2"]


def test_assets(spark):
    answer = '```json\n{"assets": {"positioning": [{"title": "A", "text": "我方做法是引用原文内容一二三四", "profile_ids": ["pos_1", "x"], "chunk_ids": ["c1", "c9"]}, {"title": "B", "text": "t", "profile_ids": [], "chunk_ids": ["c1"]}]}}\n```'
    made = assets.parsed_assets(spark.createDataFrame([(answer,)], "a string"), "a")
    selected = spark.createDataFrame([("c1", "引用原文内容一二三四")], "c string, q string")
    out = assets.materialized(made, selected, "c", "q", F.array(F.lit("pos_1"))).collect()
    assert len(out) == 1 and out[0].profile_ids == ["pos_1"] and out[0].chunk_ids == ["c1"] and out[0].id == "positioning_1"
    own, tail = out[0].text.split("\n\n【引用】\n")
    assert tail == "引用原文内容一二三四" and "引用原文" not in own
    quotes = {"c1": "原文一二三四"}
    df = spark.createDataFrame([("正文 [[QUOTE:c1]] 结束", quotes, ["原文一二三四", "别的原文五六"])], "b string, m map<string,string>, q array<string>")
    body = assets.material_bodies(df, "b", "m", "q").first().b
    assert "原文一二三四" in body and body.endswith("【引用】\n别的原文五六")
    use = assets.used(F.array(F.lit("a1"), F.lit("zz")), F.array(F.lit("a1")), F.array(F.lit("c1")), F.array(F.lit("c2"), F.lit("c3")), F.array(F.lit("c2"), F.lit("c1")))
    r = one(spark, use)
    assert r.assets == ["a1"] and r.chunks == ["c1", "c2"]
    items = spark.createDataFrame([("own words" + T.QUOTE + "\n引文甲乙丙丁", ["引文甲乙丙丁"], ["c1"]), ("引文甲乙丙丁", ["引文甲乙丙丁"], ["c1"]), ("x", [], [])], "t string, q array<string>, r array<string>")
    assert [r.violation for r in evidence.boundary_violations(items, "t", "q", "r", F.array(F.lit("c1"))).collect()] == ["leaked_fragment", "no_reference"]
    done = assets.complete(spark.createDataFrame([("s", "t", "x"), ("s", "", "x")], "s string, title string, text string"), "s").first()
    assert done.some and not done.complete


def test_corpus(spark):
    mapping = spark.createDataFrame([('{"policy": "p", "dropped": {"d1": {"keep": "d2", "reason": "same"}}}',)], "j string")
    assert [tuple(r) for r in corpus.dropped_ids(mapping, "j").collect()] == [("d1", "d2", "same")]
    docs = spark.createDataFrame([("d1", []), ("d2", ["k"]), ("d3", [])], "id string, keywords array<string>")
    tags = spark.createDataFrame([("d1", ["t"])], "id string, tags array<string>")
    assert dict(map(tuple, corpus.with_keywords(docs, tags, "id").collect())) == {"d1": ["t"], "d2": ["k"], "d3": []}
    assert [corpus.keyword_cap(10, 4), corpus.keyword_cap(10, 0), corpus.keyword_cap(1, 9), corpus.keyword_cap(1, 9, True)] == [4, 10, 2, 2]
    articles = spark.createDataFrame([("s1", "u1", "11111", ["a"], ["t"]), ("s2", "u2", "22222", [], [])], "id string, url string, article_id string, keywords array<string>, themes array<string>")
    hits = spark.createDataFrame([("u1", "99999", "b", "t", 0), ("u9", "22222", "c", "w", 1), ("u9", "99999", "d", "w", 2), ("u1", "11111", "a", "t", 3)], "url string, article_id string, keyword string, theme string, pos int")
    merged = {r.id: (r.keywords, r.themes) for r in corpus.merged_articles(articles, hits).collect()}
    assert merged == {"s1": (["a", "b"], ["t"]), "s2": (["c"], ["w"])}


def test_markdown(spark, tmp_path):
    text = '﻿---\nid: "d: 1"\ntitle: T\nsource: S\nlong: first\n  second\nflag: null\ntags:\n  - a\n  - "b: c"\n# comment\n---\n\n# T\n\n　　正文。\n\n末。\n'
    (tmp_path / "a.md").write_text(text)
    (tmp_path / "b.md").write_text("---\ntitle: T\nsource: S\n---\n\ntext\n")
    (tmp_path / "README.md").write_text("no")
    got = {r.name: r for r in markdown.parsed(markdown.read_folder(spark, str(tmp_path))).collect()}
    assert set(got) == {"a.md", "b.md"} and got["b.md"].error == "missing_id" and got["a.md"].error is None
    assert got["a.md"].text == "　　正文。\n\n末。" and got["a.md"].fields["long"] == "first second" and got["a.md"].fields["id"] == "d: 1" and got["a.md"].fields["flag"] is None
    assert one(spark, markdown.list_values(F.lit(text), "tags")) == ["a", "b: c"]
    markdown.write_chunks(spark.createDataFrame([("d1", "x"), ("d2", "y")], "doc string, t string"), str(tmp_path / "out"), "doc")
    assert spark.read.json(str(tmp_path / "out")).count() == 2


def test_pages(spark):
    html = "<html><title>W</title><h1>甲</h1><h3>副题</h3><script>x</script><div><p>一&nbsp;二<br> 三</p><p>外<p>内</p></p></div><a href='/1'>链</a>"
    r = one(spark, pages.page_fields(F.lit(html)))
    assert r.title == "甲副题" and r.body.split("\n\n")[0] == "一 二\n三" and "x" not in r.body and r.links[0].href == "/1" and r.error is None
    assert one(spark, pages.page_fields(F.lit("<p>b</p>"))).error == "missing_title"
    assert one(spark, pages.page_fields(F.lit("<h1>t</h1>")))["title"] == "t"


EVENTS = [(1, "profile", 1), (1, "recommendations", 2), (1, "selection", 3), (1, "assets", 4), (1, "material", 5), (1, "selection", 6), (2, "profile", 1), (2, "assets", 2), (2, "other", 3)]


def test_workflow(spark):
    df = spark.createDataFrame([(*e, e[2]) for e in EVENTS], "s int, stage string, at int, n int")
    valid = workflow.valid_artifacts(df, "s", "stage", "at", "n")
    got = {(r.s, r.stage): r.valid for r in valid.collect()}
    assert got == {(1, "profile"): True, (1, "recommendations"): True, (1, "selection"): True, (1, "assets"): False, (1, "material"): False, (2, "profile"): True, (2, "assets"): True}
    assert dict(map(tuple, workflow.furthest_stage(valid, "s").collect())) == {1: "selection", 2: "profile"}


def test_workflow_stream(spark, tmp_path):
    for k, part in enumerate((EVENTS[:5], EVENTS[5:])):
        pd.DataFrame(part, columns=["s", "stage", "n"]).astype({"s": "int32", "n": "int32"}).to_parquet(tmp_path / f"{k}.parquet")
    stream = spark.readStream.schema("s int, stage string, n int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path))
    batches: list[tuple] = []
    q = workflow.streamed(stream, "s", "stage", "n").writeStream.outputMode("update").foreachBatch(lambda df, k: batches.extend((k, *r) for r in df.collect())).option("checkpointLocation", str(tmp_path / "state")).start()
    q.processAllAvailable()
    q.stop()
    last = {(s, stage): v for _, s, stage, v in sorted(batches, key=lambda b: b[0])}
    assert last[1, "material"] is False and last[1, "selection"] is True and last[2, "assets"] is True


def test_sharing_finds_whole_short_texts(spark):
    from tesserae.operators import fragments

    texts = spark.createDataFrame([(1, "one small passage lies in here"), (2, "nothing of it"), (3, None)], "doc_id long, text string")
    items = spark.createDataFrame([(k, v) for k, v in enumerate(["passage", "x", "g", "", None, "a small passage lies in there", "passages"])], "item_id long, item string")
    got = fragments.sharing(texts, "text", items, "item", 20)
    assert sorted((r.doc_id, r.item_id) for r in got.collect()) == [(1, 0), (1, 2), (1, 5), (2, 2)]


def test_gaps_are_repaired():
    """Invented sentences whose fragment is taken out: joiners, headings, places and sentences that lose their core."""
    from tesserae.operators import fragments

    canon = "大家要认真学习绿色能源知识，推动海洋运输发展，形成海岛经济。"
    cut = lambda text: fragments.stripped(text, [canon])
    assert cut("本报告介绍公司概况、设备清单、海洋运输和后续安排。") == "本报告介绍公司概况、设备清单和后续安排。"
    assert cut("船队依靠绿色能源远航") == "船队依靠远航"
    assert cut("二、海岛经济与展望") == "二、展望"
    assert cut("三、绿色能源\n我们修船。") == "我们修船。"
    assert cut("我们在海洋运输方面造船。") == "我们造船。"
    assert cut("公司将绿色能源与海岛经济融合。我们修船。") == "我们修船。"
    assert cut("码头已经完工海岛经济四、人员安排") == "码头已经完工\n四、人员安排"
    assert cut("公司将与学校合作。现在的市场很大。") == "公司将与学校合作。现在的市场很大。"


def test_fragments_of_four_and_whole_short_items(spark):
    from tesserae.operators import fragments

    texts = spark.createDataFrame([(1, "xx abc yy"), (2, "one wxyz two 😀"), (3, ""), (4, None)], "doc_id int, text string")
    items = spark.createDataFrame([(1, "abc"), (2, "12wxyz34"), (3, ""), (4, None), (5, "😀")], "item_id int, item string")
    for most in (fragments.MOST_BROADCAST, 0):
        fragments.MOST_BROADCAST, before = most, fragments.MOST_BROADCAST
        try:
            got = fragments.sharing(texts, "text", items, "item", 4).select("doc_id", "item_id").collect()
        finally:
            fragments.MOST_BROADCAST = before
        assert sorted(map(tuple, got)) == [(1, 1), (2, 2), (2, 5)]


def test_strict_chunks_blank_queries_and_many_queries(spark):
    from pyspark.errors import PySparkException

    from tesserae.operators import retrieval

    hits, chunks = spark.createDataFrame([(1,), (2,)], "c int"), spark.createDataFrame([(1, "a")], "c int, t string")
    assert [r.t for r in retrieval.chunks_of_hits(hits.where("c = 1"), chunks, "c").collect()] == ["a"]
    with pytest.raises(PySparkException):
        retrieval.chunks_of_hits(hits, chunks, "c").collect()
    with pytest.raises(PySparkException):
        retrieval.asked_text(spark.createDataFrame([(" ",)], "t string"), "t").collect()
    with pytest.raises(ValueError):
        retrieval.top_k(chunks, "t", hits, "c", "c")


def test_saved_numbers_and_merges(spark):
    from tesserae.operators import corpus

    kinds = "id string, url string, article_id string, keywords array<string>"
    store = spark.createDataFrame([("speech_007", "u1", "a1", ["x"]), ("speech_002", "u2", None, [])], kinds)
    found = spark.createDataFrame(
        [(1, "u9", None, ["n"]), (2, "u1", None, ["y", "x"]), (3, "u8", "a1", ["z"]), (4, "u9", None, ["m"]), (5, "u5", None, ["k"])],
        "pos int, url string, article_id string, keywords array<string>",
    )
    got = {r.id: (r.url, r.keywords) for r in corpus.saved(store, found, "pos", ranges=2).collect()}
    assert got == {"speech_007": ("u1", ["x", "y", "z"]), "speech_002": ("u2", []), "speech_008": ("u9", ["n", "m"]), "speech_009": ("u5", ["k"])}
