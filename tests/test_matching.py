"""Items named by texts, reranking with evidence, and longest common runs, against brute force."""

import os
import random
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tesserae.operators import fragments, matching, retrieval
from tesserae.operators.runs import Runs

TABLES, ROOT = "/root/testdata/sf0.001", str(Path(__file__).resolve().parent.parent)


@pytest.mark.parametrize("most", [1_000_000, 0])  # as one automaton, and by joins
@pytest.mark.parametrize("with_words", [True, False])
def test_named_items(spark, monkeypatch, most, with_words):
    monkeypatch.setattr(matching, "MOST_CHARACTERS", most)
    rng = random.Random(1)
    word = lambda n: "".join(rng.choice("ab甲😀") for _ in range(rng.randint(1, n)))
    chunks = [(k, word(30), [word(3) for _ in range(rng.randint(0, 2))], "x") for k in range(40)]
    chunks += [(50, "", [], "x"), (51, None, None, "x"), (52, None, ["ab", None], "x"), (53, "ab", [""], "x"), chunks[3], (54, "甲" * 200, ["zz"], "x")]
    items = [(f"i{k}", word(5)) for k in range(25)] + [("i3", "ab"), ("e", ""), ("n", None), ("long", "甲" * 40)]
    items += [items[4]]
    text, own = (spark.createDataFrame(r, s) for r, s in ((chunks, "id int, text string, words array<string>, _v string"), (items, "item string, value string")))
    got = matching.named_items(text.repartition(3), own, keywords="words" if with_words else None)
    assert got.columns == ["id", *([] if with_words else ["words"]), "_v", "item", "value"]

    def named(t, ws, v):
        ws = [w for w in (ws or []) if w is not None] if with_words else []
        return v is not None and ((t is not None and v in t) or any(v in w or w in v for w in ws))

    want = sorted((i, k) for i, t, ws, _ in chunks for k, v in items if named(t, ws, v))
    assert sorted((r.id, r.item) for r in got.collect()) == want
    assert matching.named_items(text, own.limit(0)).count() == 0 and matching.named_items(text.limit(0), own).count() == 0


def test_evidence_of_recommendations(spark):
    candidates = spark.createDataFrame([(k, f"c{k}", f"t{k} alpha" + " beta" * (k % 2)) for k in range(4)], "pos int, id string, text string")
    results = spark.createDataFrame(
        [("c2", 0, "strong", "why", ["p1", "p9"]), ("c1", 1, "medium", "so", ["p9"]), ("c2", 2, "weak", "again", ["p2"]), ("zz", 3, "weak", "?", [])],
        "id string, result_pos int, relevance string, reason string, profile_ids array<string>",
    )
    items = spark.createDataFrame([("p2", 1, "beta"), ("p1", 0, "alpha"), ("p3", 2, "gamma")], "pid string, at int, value string")
    ranked = retrieval.apply_rerank(candidates, results, "id")
    found = matching.evidence_ids(candidates, items, "id", "pid", "at")
    got = matching.with_evidence(ranked, found, ["p1", "p2", "p3"], "id").orderBy("rank").collect()
    assert [(r.id, r.relevance, r.reason, r.profile_ids) for r in got] == [
        ("c2", "strong", "why", ["p1"]), ("c1", "medium", "so", ["p1", "p2"]),
        ("c0", "weak", retrieval.FALLBACK, ["p1"]), ("c3", "weak", retrieval.FALLBACK, ["p1", "p2"]),
    ]
    none = matching.evidence_ids(spark.createDataFrame([("c", "")], "id string, text string"), items, "id", "pid", "at").first()
    assert none.item_ids == []


def shared_run(text: str, canon: str) -> str:
    size, end, row = 0, 0, [0] * (len(canon) + 1)
    for i, x in enumerate(text, 1):
        row = [0, *(row[j] + 1 if x == y else 0 for j, y in enumerate(canon))]
        if max(row) > size:
            size, end = max(row), i
    return text[end - size : end]


def test_longest_runs():
    rng = random.Random(0)
    for _ in range(400):
        a, b = ("".join(rng.choice("ab😀"[: rng.randint(1, 3)]) for _ in range(rng.randint(0, 40))) for _ in "ab")
        for block in (4, 8, 1000):
            runs = Runs(b, block)
            assert runs.longest(a) == shared_run(a, b) == runs.longest(a)


TWO_LONG = """
import random, resource
from tesserae.operators import fragments
text = lambda seed: "".join(random.Random(seed).choices("abcdefghij klmno", k=1_000_000))
a, b, shared = text(1), text(2), "z".join(text(3)[:200])
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
assert shared in fragments.longest(a[:500_000] + shared + a[500_000:], b[:900_000] + shared + b[900_000:])
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before)
"""


def test_longest_run_of_two_megabytes():
    out = subprocess.run([sys.executable, "-c", TWO_LONG], capture_output=True, text=True, check=True, env={**os.environ, "PYTHONPATH": ROOT})
    assert int(out.stdout) < 200_000  # kB beside the texts


def test_longest_fragments_of_the_tables(spark):
    from tesserae.plans.catalog import QUERIES

    lines = {(r.doc_id, k): x for r in spark.read.parquet(f"{TABLES}/documents.parquet").collect() for k, x in enumerate(r.text.split("\n"))}
    item = {r.item_id: r.text for r in spark.read.parquet(f"{TABLES}/benchmark.parquet").collect()}
    rows = QUERIES["fragment_longest"](spark, TABLES).collect()
    runs = {i: {x[k : k + 32] for k in range(len(x) - 31)} if len(x) >= 32 else {x} - {""} for i, x in item.items()}
    want = {(*at, i) for at, t in lines.items() for i, own in runs.items() if any(x in t for x in own)}
    assert {(r.doc_id, r.line, r.item_id) for r in rows} == want and rows
    for r in rows:
        assert r.fragment == shared_run(lines[r.doc_id, r.line], item[r.item_id])


def test_given_values_are_few(spark):
    plan = matching.named_items(
        spark.createDataFrame([(1, "a")], "id int, text string"), spark.createDataFrame([("i", "a")], "item string, value string")
    )._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "ArrowEvalPython" in plan


def test_columns_named_twice(spark):
    chunks = spark.createDataFrame([(1, "a b", 5)], "id int, body string, n int")
    got = matching.named_items(chunks, spark.createDataFrame([("i", "b")], "item string, v string"), "body", "v").select("id", "n", "item", F.col("v"))
    assert [tuple(r) for r in got.collect()] == [(1, 5, "i", "b")]


def test_named_items_reads_few_texts_at_once(spark):
    """A worker gets texts by their size, not 10,000 of any length."""
    import pandas as pd

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.unset(name)
    try:
        texts = spark.range(200, numPartitions=1).select("id", F.repeat(F.lit("ab "), 20_000).alias("text"))
        got = matching.named_items(texts, spark.createDataFrame([("i", "b a")], "item string, value string"))
        assert got.count() == 200
        rows = F.pandas_udf(lambda t: pd.Series([len(t)] * len(t)), "int").asNondeterministic()
        assert texts.select(rows("text").alias("n")).agg(F.max("n")).first()[0] < 100  # 60 KB each
    finally:
        spark.conf.unset(name)
        if before is not None:
            spark.conf.set(name, before)
