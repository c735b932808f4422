"""The workspace with its content: by hand, against the fold of flags, and as a stream."""

from pyspark.sql import functions as F

from tesserae.plans import ingest
from tesserae.plans.reviews import workspace_actions
from tesserae.streaming import sessions, workspace

TABLES = "/root/testdata/sf0.001"


def item(i, value="t", text="own", dimension="d"):
    return {"dimension": dimension, "id": i, "value": value, "text": text, "origin": "inferred", "confidence": "low"}


def run(*actions):
    s = dict(sessions.START)
    for kind, brought in actions:
        s = sessions.after(s, {"kind": kind, **dict.fromkeys(sessions.ACTION), **brought})
    return s


BEGUN = [
    ("SET_DESCRIPTION", {"value": "about"}), ("PROFILE_GENERATED", {"items": [item("p1"), item("p2"), item("p1", dimension="e")]}),
    ("CONFIRM_PROFILE", {"items": [item("p1", "mine")]}), ("RECOMMENDATIONS_LOADED", {"ids": ["c1", "c2"]}),
    ("TOGGLE_EVIDENCE", {"value": "c2"}), ("TOGGLE_EVIDENCE", {"value": "c1"}),
]
MADE = [*BEGUN, ("ASSETS_LOADED", {"ids": ["c1", "c2"], "items": [item("a1"), item("a2")]})]


def test_profile_edits_and_what_they_undo():
    s = run(*BEGUN[:2], ("UPDATE_PROFILE_ITEM", {"dimension": "d", "id": "p1", "value": "new"}), ("ADD_PROFILE_ITEM", {"dimension": "e", "id": "u9"}), ("REMOVE_PROFILE_ITEM", {"dimension": "d", "id": "p2"}))
    assert [(x["dimension"], x["id"], x["value"], x["origin"]) for x in s["profile"]] == [("d", "p1", "new", "explicit"), ("e", "p1", "t", "inferred"), ("e", "u9", "", "explicit")]
    assert s["notice"] is None and s["viewing"] == "profile"
    s = run(*MADE, ("UPDATE_PROFILE_ITEM", {"dimension": "d", "id": "p1", "value": "x"}))
    assert (s["notice"], s["recommendations"], s["selected"], s["assets"], s["profile_confirmed"]) == ("profile_changed", [], [], None, False)
    assert s["profile"] == [{**item("p1", "x"), "origin": "explicit", "confidence": "high"}]  # the one that was confirmed
    assert run(("UPDATE_PROFILE_ITEM", {"id": "p1"}), ("UPDATE_ASSET", {"id": "a"}), ("NO_SUCH_KIND", {})) == sessions.START


def test_confirmations_store_what_they_bring():
    assert run(*BEGUN[:3])["profile"] == [item("p1", "mine")]
    assert run(*BEGUN[:2], ("CONFIRM_PROFILE", {"items": []}))["error"] == "empty_profile"
    s = run(*MADE, ("UPDATE_ASSET", {"dimension": "d", "id": "a1", "text": "better"}), ("REMOVE_ASSET", {"dimension": "d", "id": "a2"}))
    assert s["assets"] == [item("a1", text="better")] and not s["assets_confirmed"]
    final = [item("a1", "title", "text\n\n【引用】\nquote")]
    s = run(*MADE, ("CONFIRM_ASSETS", {"items": final}), ("SET_SCENARIO", {"value": "visit"}), ("MATERIAL_LOADED", {"text": "body"}))
    assert (s["assets"], s["assets_confirmed"], s["viewing"], s["scenario"], s["material"], sessions.furthest(s)) == (final, True, "material", "visit", "body", "material")
    for items, error in [([], "no_assets"), ([item("a1", " ")], "incomplete_assets"), ([item("a1", "t", " 【引用】q")], "incomplete_assets"), ([item("a", "t", None)], "incomplete_assets")]:
        t = run(*MADE, ("CONFIRM_ASSETS", {"items": items}))
        assert (t["error"], t["assets_confirmed"], len(t["assets"])) == (error, False, 2)


def test_stale_answers_and_views():
    s = run(*BEGUN, ("REQUEST", {"value": "assets"}), ("TOGGLE_EVIDENCE", {"value": "c1"}), ("ASSETS_LOADED", {"ids": ["c2", "c1"], "items": [item("a")]}))
    assert (s["assets"], s["notice"], s["pending"]) == (None, "late_assets", None)
    s = run(*MADE, ("TOGGLE_EVIDENCE", {"value": "c1"}))
    assert (s["viewing"], s["notice"], s["assets"]) == ("speeches", "selection_changed", None)
    assert run(*MADE, ("SET_VIEWING", {"value": "material"}))["viewing"] == "assets"
    assert run(*MADE, ("SET_VIEWING", {"value": "input"}))["viewing"] == "input"
    s = run(*MADE, ("CONFIRM_ASSETS", {"items": [item("a1")]}), ("MATERIAL_LOADED", {"text": "m"}), ("SET_REQUIREMENTS", {"value": "short"}))
    assert (s["material"], s["requirements"]) == (None, "short")


def test_content_agrees_with_flags(spark):
    """Two folds that share no rule: columns on flags and ids, and this one on content."""
    for tables in (TABLES, TABLES.replace("0.001", "0.01")):
        flags = {r.user_id: r for r in workspace.workspaces(workspace_actions(spark, tables), "user_id", "event_id").collect()}
        content = sessions.folded(ingest.session_actions(spark, tables), "user_id", "event_id").collect()
        assert {r.user_id for r in content} == set(flags) and len(content) == len(flags)
        for r in content:
            f = flags[r.user_id]
            same = ["selected", "viewing", "pending", "notice", "error", "furthest", "profile_confirmed", "assets_confirmed"]
            assert [r[c] for c in same] == [f[c] for c in same]
            assert (r.profile is not None, len(r.recommendations), r.material is not None) == (f.profile, f.recommendations, f.material)
            assert (r.assets is None) == (f.assets is None)


def test_stream_equals_batch(spark, tmp_path):
    own = ingest.session_actions(spark, TABLES)
    for k, part in enumerate(("event_id < 300", "event_id >= 300 AND event_id < 700", "event_id >= 700")):
        own.where(part).coalesce(1).write.parquet(str(tmp_path / "in" / f"{k}"))
    now: dict = {}
    stream = spark.readStream.schema(own.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    q = sessions.streamed(stream, "user_id", "event_id").writeStream.outputMode("update")
    q = q.foreachBatch(lambda df, k: now.update({r.user_id: r for r in df.collect()})).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = {r.user_id: r for r in sessions.folded(own, "user_id", "event_id").collect()}
    assert now == want and len({str(r.assets) for r in want.values()}) > 3


def test_sessions_that_span_batches(spark):
    own = ingest.session_actions(spark, TABLES)
    want = {r.user_id: r for r in sessions.folded(own, "user_id", "event_id").collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = sessions.folded(own, "user_id", "event_id").collect()
        assert sessions.folded(own.limit(0), "user_id", "event_id").count() == 0
        none = sessions.folded(own.limit(5).withColumn("user_id", F.lit(None).cast("long")), "user_id", "event_id").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {r.user_id: r for r in got} == want and len(got) == len(want)
    assert len(none) == 1 and none[0].user_id is None


def test_selected_refs(spark):
    spaces = spark.createDataFrame([(1, ["c1", "c2"], ["c2", "c9"]), (2, ["c1"], [])], "s int, recommendations array<string>, selected array<string>")
    refs = spark.createDataFrame([(1, "c1"), (1, "c2"), (2, "c1")], "s int, chunk string")
    assert [tuple(r) for r in sessions.selected_refs(spaces, refs, "s", "chunk").collect()] == [(1, "c2")]
