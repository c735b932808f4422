"""Assets and materials of several sessions from a model's answers, case by case."""

import json

from pyspark.sql import functions as F

from tesserae.operators import evidence, materials, reviews
from tesserae.operators.index import Retryable

QUOTES = {"c1": "推动制造业高端化智能化绿色化发展", "c2": "坚持把发展经济的着力点放在实体经济上", "c3": "未被选中的原文内容"}
SELECTED = [("s", 0, "c2", "d1", QUOTES["c2"]), ("s", 1, "c1", "d1", QUOTES["c1"]), ("s", 2, "c1", "d1", QUOTES["c1"])]
KINDS = "session string, pos int, chunk_id string, doc_id string, quote string"


def selected(spark, sessions):
    return spark.createDataFrame([(s, *r[1:]) for s in sessions for r in SELECTED], KINDS)


def asset(**more):
    return {"title": "标题", "text": "我们自主研发控制系统。", "profileEvidenceIds": ["p1"], "evidenceChunkIds": ["c1"], **more}


def test_assets(spark):
    tech = "technologyInnovation"
    good = {
        tech: [
            asset(evidenceChunkIds=["c3"]), asset(profileEvidenceIds=["zz"]),
            asset(id=" a1 ", evidenceChunkIds=["c1", "c9"], evidenceRefs=[{"chunkId": "c2", "x": 1}, {"chunkId": "c1"}], profileEvidenceIds=["p1", "zz", "p1"]),
            asset(title=QUOTES["c2"], text=QUOTES["c1"]), asset(id="third"),
        ],
        "socialValue": [asset(text=f"自有表达，{QUOTES['c2']}，继续推进。")],
    }
    answers = {
        "wrapped": "```json\n" + json.dumps({"assets": good}, ensure_ascii=False) + "\n```", "plain": json.dumps(good), "none": "sorry", "list": "[1]",
        "broken": json.dumps({tech: [asset(), asset(title="")], "socialValue": [asset(text=None)]}), "refs": json.dumps({tech: [asset(evidenceRefs=[{"chunkId": ""}])]}),
        "unused": json.dumps({tech: [asset(evidenceChunkIds=[])]}), "empty": "{}", "alone": json.dumps(good),
    }
    rows = spark.createDataFrame([(k, a, ["p1", "p2"]) for k, a in answers.items()], "session string, answer string, allowed array<string>")
    made, errors = materials.assets_made(rows, selected(spark, [k for k in answers if k != "alone"]), "session", "answer", "allowed")
    assert dict(map(tuple, errors.collect())) == {
        "none": "no_json", "list": "no_json", "broken": "technologyInnovation[1].title_empty", "refs": "technologyInnovation[0].evidenceRefs_broken", "unused": "no_assets",
        "empty": "no_assets", "alone": "no_selection",
    }
    got = {k: sorted((r for r in made.collect() if r.session == k), key=lambda r: (r.dimension, r.pos)) for k in ("wrapped", "plain")}
    assert [tuple(r)[1:] for r in got["wrapped"]] == [tuple(r)[1:] for r in got["plain"]]
    social, first, second = sorted(got["plain"], key=lambda r: (r.dimension != "socialValue", r.pos))
    assert (first.id, first.pos, first.chunk_ids, first.profile_ids, first.doc_ids) == ("a1", 2, ["c1", "c2"], ["p1"], ["d1"])
    assert first.text == f"我们自主研发控制系统。\n\n【引用】\n{QUOTES['c1']}\n\n【引用】\n{QUOTES['c2']}"
    assert (second.id, second.title) == ("technologyInnovation_4", "technologyInnovation_4") and second.text.startswith(materials.NO_TEXT + "\n\n【引用】\n")
    assert QUOTES["c2"] not in social.text and social.text.endswith(QUOTES["c1"])
    own = made.withColumn("quotes", F.transform("chunk_ids", lambda c: F.create_map(*(F.lit(x) for p in QUOTES.items() for x in p))[c]))
    assert evidence.boundary_violations(own, "text", "quotes", "chunk_ids", F.array(F.lit("c1"), F.lit("c2"))).count() == 0


def test_materials(spark):
    base = {"title": "企业汇报", "body": "我们推进柔性生产。[[QUOTE:c1]][[QUOTE:c3]]", "usedAssetIds": ["a1", "unknown", "a1"], "evidenceChunkIds": ["c1", "other"]}
    answers = {
        "good": base, "wrapped": {"material": base}, "leak": {**base, "title": QUOTES["c1"], "body": QUOTES["c1"] + "。" + QUOTES["c2"]},
        "refs": {**base, "evidenceChunkIds": None, "usedEvidenceRefs": [{"chunkId": "c2"}], "body": "own"}, "strange": {**base, "usedAssetIds": ["x"]},
        "noev": {**base, "usedAssetIds": ["a1"], "evidenceChunkIds": ["c3"]}, "bad": {**base, "body": ""}, "gone": base, "bare": base,
    }
    rows = spark.createDataFrame([(k, json.dumps(a, ensure_ascii=False), "leadership_research") for k, a in answers.items()] + [("text", "no", "x")], "session string, answer string, scenario string")
    assets = [(k, "a1", ["c1", "c1"]) for k in answers if k not in ("gone", "noev")] + [("noev", "a1", ["c3"]), ("noev", "a2", ["c2"]), ("text", "a1", ["c1"])]
    assets = spark.createDataFrame(assets, "session string, id string, chunk_ids array<string>")
    chosen = selected(spark, [k for k in [*answers, "text"] if k != "bare"])
    made, errors = materials.materials_made(rows, assets, chosen, "session", "answer", "scenario")
    assert dict(map(tuple, errors.collect())) == {
        "strange": "no_asset", "noev": "no_asset", "bad": "body_empty", "gone": "no_prompt_assets", "bare": "no_selection", "text": "no_json",
    }
    got = {r.session: r for r in made.collect()}
    assert tuple(got["good"])[1:] == tuple(got["wrapped"])[1:]
    good = got["good"]
    assert (good.title, good.asset_ids, good.chunk_ids, good.doc_ids) == ("企业汇报", ["a1"], ["c1"], ["d1"])
    assert good.body == f"我们推进柔性生产。【引用】\n{QUOTES['c1']}"
    assert got["leak"].title == "企业调研汇报稿" and got["leak"].body == f"{materials.NO_BODY}\n\n【引用】\n{QUOTES['c1']}"
    assert got["refs"].chunk_ids == ["c2", "c1"] and got["refs"].body == f"own\n\n【引用】\n{QUOTES['c2']}\n\n【引用】\n{QUOTES['c1']}"
    quotes = F.create_map(*(F.lit(x) for k in ("c1", "c2") for x in (k, QUOTES[k])))
    ids = lambda *x: F.array(*map(F.lit, x))
    broken = reviews.material_violations(F.col("body"), F.col("asset_ids"), ids("a1"), F.col("chunk_ids"), quotes, F.col("doc_ids"), F.col("doc_ids"))
    assert made.where(F.size(broken) > 0).count() == 0


def test_requirements_and_what_is_pending(spark):
    rows = spark.createDataFrame([("s", f"请突出{QUOTES['c1']}这一点", "government_symposium"), ("t", None, "leadership_research"), ("u", "plain", "x")], "session string, more string, scenario string")
    safe = {r.session: r.more for r in materials.safe_requirements(rows, selected(spark, "s"), "session", "more").collect()}
    assert QUOTES["c1"][:8] not in safe["s"] and "请突出" in safe["s"] and safe["t"] is None and safe["u"] == "plain"
    pending = {r.session: r for r in materials.pending_materials(rows, selected(spark, "s"), "session", "scenario").collect()}
    assert (pending["s"].title, pending["s"].chunk_ids, pending["s"].doc_ids, pending["s"].asset_ids) == ("政企座谈发言稿（占位）", ["c2", "c1"], ["d1"], [])
    assert {r.session: r.selected_count for r in materials.pending_assets(rows, selected(spark, "s"), "session").collect()} == {"s": 3, "t": 0, "u": 0}


def test_answers_of_a_client(spark):
    def client(prompt):
        if prompt == "never":
            raise ValueError("refused")
        if prompt == "busy":
            raise Retryable("later")
        return prompt.upper()

    rows = spark.createDataFrame([(1, "a"), (2, "never"), (3, None), (4, "busy")], "k int, prompt string")
    got = {r.k: (r.answer, r.answer_error) for r in materials.answered(rows, "prompt", client, attempts=2, pause=0.0).collect()}
    assert got == {1: ("A", None), 2: (None, "ValueError: refused"), 3: ("", None), 4: (None, "Retryable: later")}
