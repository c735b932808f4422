"""Ingestion and its errors, raw files, the store's state and rules, on small invented inputs."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tesserae.functions import rules
from tesserae.operators import ingestion
from tesserae.operators.chunking import paragraph_pieces
from tesserae.sources import markdown, raw, state

sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
DOCS = "id string, title string, source string, text string, sha256 string, keywords array<string>, chunk_text string"


def docs(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], DOCS)


GOOD = [
    ("d1", "t1", "s", "　第一段。\n\n第二段。", None, ["k"]), ("d2", "t2", "s", "one\n\ntwo\n\none", sha("one\n\ntwo\n\none"), []), ("d3", "t3", "s", "x" * 1700, "", None),
]


@pytest.fixture
def whole(spark):
    return paragraph_pieces(F.col("text"))


def test_ingest(spark, tmp_path, whole):
    tags, gone = spark.createDataFrame([("d2", ["tag"]), ("d1", ["other"])], "id string, tags array<string>"), spark.createDataFrame([("d3",), ("d9",)], "id string")
    path = str(tmp_path)
    assert ingestion.ingest(docs(spark, GOOD), path, whole, tags=tags, dropped=gone) == {"documents": 2, "verified": 1, "chunks": 5}
    index = ingestion.ChunkIndex(spark, f"{path}/chunks")
    rows = index.read().orderBy("chunk_id").collect()
    assert [(r.chunk_id, r.chunk_index, r.chunk_text, r.keywords) for r in rows] == [
        ("d1_chunk_000", 0, "　第一段。", ["k"]), ("d1_chunk_001", 1, "第二段。", ["k"]),
        ("d2_chunk_000", 0, "one", ["tag"]), ("d2_chunk_001", 1, "two", ["tag"]), ("d2_chunk_002", 2, "one", ["tag"]),
    ]
    long = GOOD[2][:4] + (None, ["k"])
    upper = F.transform(whole, F.upper)
    for rows, pieces, said in [
        ([*GOOD, GOOD[0]], whole, "repeated document id: d1"), ([("", *GOOD[0][1:])], whole, "missing id"), ([(None, *GOOD[0][1:])], whole, "missing id"),
        ([("d4", None, "s", "x", None, [])], whole, "missing title: d4"), ([("d4", "t", "", "x", None, [])], whole, "missing source: d4"),
        ([("d4", "t", "s", "", None, [])], whole, "empty text: d4"), ([("d4", "t", "s", None, None, [])], whole, "empty text: d4"),
        ([("d4", "t", "s", "x", sha("y"), [])], whole, "sha256 differs: d4"), ([("d4", "t", "s", " \n\n\n ", None, [])], whole, "no chunk: d4"),
        ([long], F.transform(whole, lambda p: F.concat(p, F.lit("y"))), "no substring: d3"), ([*GOOD], upper, "no substring: d"),
        ([], whole, "no rows"),
        ([("a", "t", "s", "x\n\n" * 1001, None, []), ("a_chunk_000", "t", "s", "x", None, [])], F.when(F.col("id") == "a", F.array(F.lit("x"))).otherwise(whole), None),
    ]:
        if said:
            before = index.version(), ingestion.ChunkIndex(spark, f"{path}/documents").version()
            with pytest.raises(ingestion.IngestionError, match=said):
                ingestion.ingest(docs(spark, rows), path, pieces)
            assert (index.version(), ingestion.ChunkIndex(spark, f"{path}/documents").version()) == before
        else:
            assert ingestion.ingest(docs(spark, rows), path, pieces)["chunks"] == 2


def test_repeated_chunk_ids(spark):
    rows = [("a", "t", "s", "x", None, []), ("b", "t", "s", "y", None, [])]
    with pytest.raises(ValueError, match="repeated chunk: c"):
        ingestion.assert_unique(spark.createDataFrame([("c",), ("c",), ("d",), ("d",), ("a",)], "id string"), "id", "chunk")
    ingestion.assert_unique(docs(spark, rows), "id", "document")


def test_folders(spark, tmp_path, whole):
    with pytest.raises(ingestion.IngestionError, match="no folder"):
        ingestion.documents_of_folder(spark, str(tmp_path / "none"))
    (tmp_path / "README.md").write_text("---\nid: x\n---\ntext")
    with pytest.raises(ingestion.IngestionError, match="no Markdown"):
        ingestion.documents_of_folder(spark, str(tmp_path))
    head = "id: a\ntitle: \"T\"\nsource: S\nnote: long\n  goes on\n\nretrieval_keywords:\n  - 甲\n  - 乙\nempty:\n# comment\nsha256: "
    (tmp_path / "a.md").write_text(f"---\n{head}{sha('　正文')}\n---\n# T\n\n　正文\n")
    (tmp_path / "b.md").write_text("---\r\nspeechId: b\r\ntitle: B\r\nsource: S\r\nkeywords:\r\n  - k\r\n---\r\nbody\r\n")
    rows = {r.id: r for r in ingestion.documents_of_folder(spark, str(tmp_path)).collect()}
    assert {k: (r.title, r.source, r.text, r.keywords) for k, r in rows.items()} == {"a": ("T", "S", "　正文", ["甲", "乙"]), "b": ("B", "S", "body", ["k"])}
    assert ingestion.ingest(ingestion.documents_of_folder(spark, str(tmp_path)), str(tmp_path / "out"), whole) == {"documents": 2, "verified": 1, "chunks": 2}
    for text, said in [("no front matter", "no front matter"), ("---\nstray\nid: c\n---\nx", "no front matter line: stray")]:
        (tmp_path / "c.md").write_text(text)
        with pytest.raises(Exception, match=said):
            ingestion.documents_of_folder(spark, str(tmp_path)).collect()


def test_stray_lines(spark):
    cases = [
        ("a: b\n c\n- d", "- d"), ("a: null\nmore", "more"), ("a: ~\n more", " more"), ("a: true\nx", "x"), ("a:\n - i\n - j", None), ("a:\n- i", "- i"), ("a:\n\n - i", " - i"),
        ("a: b\n\nmore\n# c\nand", None), ("first", "first"), ("a: b\n - c", " - c"), ("a:\n - i\nmore", "more"), ("a: b", None), ("a_1 : b\n x: y", None), ("", None),
    ]
    rows = spark.createDataFrame([(k, f"---\n{t}\n---\nbody") for k, (t, _) in enumerate(cases)], "k int, c string")
    got = dict(map(tuple, rows.select("k", markdown.stray_line(F.col("c"))).collect()))
    assert got == {k: want for k, (_, want) in enumerate(cases)}


def test_preflight(spark, whole):
    rows = [*GOOD, GOOD[0], ("d5", "t", "s", "", sha(""), [])]
    gone = spark.createDataFrame([("d2",), ("d2",), ("d8",)], "id string")
    got = ingestion.preflight_report(docs(spark, rows), whole, "id", "text", "sha256", gone).first().asDict()
    assert got == {
        "documents": 5, "verified": 2, "unique_ids": False, "runtime_documents": 4, "chunks": 10, "runtime_chunks": 7, "substrings": 10, "unique_chunk_ids": False, "dropped": 2,
    }
    none = ingestion.preflight_report(docs(spark, []), whole, "id", "text", "sha256", gone).first()
    assert (none.documents, none.chunks, none.unique_ids, none.unique_chunk_ids) == (0, 0, True, True)


# ---- raw and canonical files ---------------------------------------------------------------------------------------


def read_raw(text: str):
    parts = text.replace("\r\n", "\n").replace("\r", "\n").split("---", 2)
    if len(parts) < 3:
        return None, None, "no_front_matter"
    out, rest = {}, parts[2].lstrip("\n")
    for line in parts[1].splitlines():
        key, colon, value = (x.strip() for x in line.partition(":"))
        value = value.strip('"')
        if colon and not line.lstrip().startswith("-") and key not in raw.RAW_LISTS and value not in ("", "[]"):
            out[key] = None if value == "null" else value
    if rest.startswith("#"):
        heading, _, rest = rest.partition("\n")
        if not out.get("title"):
            out["title"] = heading[1:].strip(" \t\r\n")
        rest = rest.lstrip("\n")
    return out, rest.rstrip("\n"), None


def test_raw_files(spark):
    rng = random.Random(4)
    lines = ["title: A", "title: null", "title:", ' id : "x y" ', "url: http://x:80", "retrieval_keywords:", "  - a: b", "themes: []", "k: []", "no colon", ": v", "id: second", "", "　m　: 　n　", 'q: ""z""', "a---b: c", "\tt: 1\r"]
    bodies = ["# H\n\ntext\n", "\n\n#\n", "##  Two \t\n\n\nx\n\n", "text --- more\n", "", "\n　　甲\n\n乙\n\n", "#only"]
    cases = ["---\n" + "\n".join(rng.sample(lines, rng.randint(0, 8))) + "\n---\n" + rng.choice(bodies) for _ in range(150)] + ["", "---", "x --- y", None]
    rows = spark.createDataFrame([(k, c) for k, c in enumerate(cases)], "k int, c string")
    for r in rows.select("k", raw.parsed_raw(F.col("c")).alias("f")).collect():
        assert (r.f.fields, r.f.body, r.f.error) == read_raw(cases[r.k] or ""), cases[r.k]


def test_rendered_files(spark):
    rows = spark.createDataFrame([("a: b", None, "", "-x", 'q"\\', ["k", "#t"], [], "　text\n\n")], "t string, d string, s string, u string, n string, k array<string>, e array<string>, x string")
    record = {"title": F.col("t"), "date": F.col("d"), "source": F.col("s"), "url": F.col("u"), "id": F.lit("speech_001")}
    got = rows.select(
        raw.rendered_raw(record, {"retrieval_keywords": F.col("k"), "themes": F.col("e")}, F.col("x")).alias("r"),
        raw.rendered_canonical({"raw_path": F.lit("p/q"), "title": F.col("t"), "date": F.col("d"), "source": F.col("s"), "speechId": F.lit("i"), "sha256": F.lit("0f"), "canonical_note": F.col("n")}, F.col("x")).alias("c"),
    ).first()
    front = '---\nid: speech_001\ntitle: "a: b"\ndate: null\nsource: ""\nurl: "-x"\nretrieval_keywords:\n  - k\n  - "#t"\nthemes:\n  []\n---\n'
    assert got.r == front + "\n# a: b\n\n　text\n"
    assert got.c == '---\nspeechId: i\ntitle: "a: b"\ncanonical_note: "q\\"\\\\"\nsha256: 0f\nraw_path: p/q\n---\n\n# a: b\n\n　text\n'
    new = record | {"title": F.lit("new")}
    out = rows.crossJoin(spark.createDataFrame([(0, got.r), (1, "no marks"), (2, got.r.replace("# a: b\n\n", ""))], "no int, c string")).orderBy("no")
    texts = [r.r for r in out.select("no", raw.rewritten(F.col("c"), new, {"themes": F.array(F.lit("z"))}).alias("r")).collect()]
    want = front.replace('"a: b"', "new").replace('  - k\n  - "#t"', "  []").replace("themes:\n  []", "themes:\n  - z") + "\n# new\n\n　text\n"
    assert texts == [want, None, want]


# ---- state and rules -----------------------------------------------------------------------------------------------


def test_state(spark, tmp_path):
    texts = [
        '{"articles": [{"url": "u1", "n": 3}, {"url": "u2", "n": "x"}, {"n": 1}, 7, {"url": null}], "next_seq": 9}', '[{"url": "u3", "more": [1]}]',
        '{"next_seq": null}', "[1, {]", '"text"', '{"articles": {"url": "u"}}', "", None, "[]", '{"articles": null}', "17",
    ]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string")
    got = sorted(map(tuple, state.records(rows, "text", "articles", "url string, n long", ("url",)).collect()))
    assert got == [
        (0, 0, "u1", 3, None, None), (0, 1, None, None, "bad_n", '{"n":"x","url":"u2"}'), (0, 2, None, None, "missing_url", '{"n":1}'),
        (0, 3, None, None, "not_an_object", "7"), (0, 4, None, None, "missing_url", '{"url":null}'), (1, 0, "u3", None, None, None),
        (3, 0, None, None, "not_json", "[1, {]"), (4, 0, None, None, "no_list", '"text"'), (5, 0, None, None, "no_list", '{"articles":{"url":"u"}}'),
        (10, 0, None, None, "no_list", "17"),
    ]
    numbers = dict(map(tuple, rows.select("k", state.scalar(F.col("text"), "next_seq", "long", 1)).collect()))
    assert numbers == {k: 9 if k == 0 else 1 for k in range(len(texts))}

    path = str(tmp_path / "log")
    some = spark.createDataFrame([("u", None, "http_403"), (None, "k", "empty")], "url string, keyword string, reason string")
    state.record_failures(some, path, F.lit("2024-01-02 03:04:05").cast("timestamp"))
    state.record_failures(some.limit(1), path)
    (tmp_path / "log" / "extra.json").write_text("not a record\n")
    log = state.failure_log(spark, path).collect()
    assert len(log) == 4 and [r.quarantine for r in log if r.quarantine] == ["not a record"]
    assert ("u", None, "http_403", "2024-01-02T03:04:05Z") in [tuple(r)[:4] for r in log]


def test_rules(spark):
    own = {
        "id": {"missing": rules.present, "shape": rules.matching("^a[0-9]+$")},
        "text": {"missing": rules.present, "empty": rules.least(1), "long": rules.most(5)},
        "ids": {"none": rules.items(1)}, "kind": {"unknown": rules.either_null_or(rules.one_of("x", "y"))},
        "refs": {"broken": rules.each({"c": {"missing": rules.present}})},
    }
    kind = "array<struct<id: string, text: string, ids: array<string>, kind: string, refs: array<struct<c: string>>>>"
    good = ("a1", "t", ["p"], None, [("c",)])
    cases = [
        (good, []), ((None, "t", ["p"], "x", []), ["id_missing"]), (("b", "", [], "z", [("c",), (None,)]), ["id_shape", "text_empty", "ids_none", "kind_unknown", "refs_broken"]),
        (("a1", "toolong", None, "y", None), ["text_long", "ids_none", "refs_broken"]), (("a1", None, ["p", None], "y", []), ["text_missing", "ids_none"]),
        (None, ["id_missing", "text_missing", "ids_none", "refs_broken"]), (good, []),
    ]
    row = spark.createDataFrame([([c for c, _ in cases],), ([],), (None,)], f"own {kind}")
    got = row.select(rules.valid(F.col("own"), own).alias("v"), rules.with_reasons(F.col("own"), own).alias("w")).collect()
    assert [tuple(x)[:2] for x in got[0].v] == [("a1", "t")] * 2
    assert [(x.pos, x.reasons) for x in got[0].w] == [(k, want) for k, (_, want) in enumerate(cases) if want]
    assert (got[1].v, got[1].w, got[2].v, got[2].w) == ([], [], None, None)
