"""The chunk index through changes, failed clients and killed writes."""

import math
import os
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.operators import index, retrieval


def table(spark, rows):
    return spark.createDataFrame(rows, "id string, text string, doc int").repartition(3)


def content(own):
    return {r.id: (r.vector, r.doc) for r in own.read().collect()}


def test_refresh_embeds_what_changed(spark, tmp_path):
    own, log = index.ChunkIndex(spark, str(tmp_path / "x")), str(tmp_path / "log")
    os.mkdir(log)

    def counted(texts, log=log):
        with open(os.path.join(log, f"{os.getpid()}-{threading.get_ident()}"), "a") as f:
            f.writelines(t + "\n" for t in texts)
        return [[float(len(t)), 1.0] for t in texts]

    def sent():
        out = sorted(x for name in os.listdir(log) for x in open(os.path.join(log, name)).read().splitlines())
        for name in os.listdir(log):
            os.remove(os.path.join(log, name))
        return out

    assert own.read() is None and own.ids("id").count() == 0
    rows = [(f"c{k}", "t" * (k + 1), k) for k in range(25)] + [("e", "", 7), ("n", None, 8)]
    assert own.refresh(table(spark, rows), "id", "text", counted, ("doc",)) == {"missing": 27, "changed": 0, "stale": 0}
    assert sent() == sorted("t" * (k + 1) for k in range(25))
    want = {f"c{k}": ([k + 1.0, 1.0], k) for k in range(25)} | {"e": (None, 7), "n": (None, 8)}
    assert content(own) == want
    before = own.version()
    assert own.refresh(table(spark, rows), "id", "text", counted, ("doc",)) == {"missing": 0, "changed": 0, "stale": 0}
    assert own.version() == before and sent() == []
    rows[3] = ("c3", "another", 3)
    rows = rows[:-3] + [("new", "abc", 9)]
    assert own.refresh(table(spark, rows), "id", "text", counted, ("doc",)) == {"missing": 1, "changed": 1, "stale": 3}
    assert sent() == ["abc", "another"]
    assert content(own) == {k: v for k, v in want.items() if k not in ("c24", "e", "n")} | {"c3": ([7.0, 1.0], 3), "new": ([3.0, 1.0], 9)}
    assert sorted(r.id for r in own.ids("id").collect()) == sorted(content(own))
    assert own.tidy() == [before] and len(content(own)) == 25


def test_what_leaves_the_index_as_it_was(spark, tmp_path):
    own = index.ChunkIndex(spark, str(tmp_path / "x"))
    client = lambda texts: [[float(len(t)), 1.0] for t in texts]
    rows = [(f"c{k}", f"text {k}", k) for k in range(12)]
    own.refresh(table(spark, rows), "id", "text", client)
    before, kept = own.version(), own.read().count()

    def broken(texts):
        raise RuntimeError("bad key")

    changed = [*rows[1:], ("c0", "changed", 0)]
    for bad, how, said in [
        (changed, broken, "bad key"), ([], client, "0 chunks"), ([*rows, rows[0]], client, "12 different"), ([*rows, (None, "x", 1)], client, "12 with an id"),
        (changed, lambda texts: [[1.0]], "dimensions"), (changed, lambda texts: [], "0 vectors"),
    ]:
        with pytest.raises(ValueError, match=said):
            own.refresh(table(spark, bad), "id", "text", how, dims=2)
        assert own.version() == before and own.read().count() == kept
    with pytest.raises(Exception, match="killed"):  # within the write itself
        own.replace(table(spark, changed).withColumn("x", F.raise_error(F.lit("killed"))))
    assert own.version() == before and own.read().count() == kept
    assert len(own.tidy()) <= 1 and own.read().count() == kept
    with pytest.raises(ValueError, match="no rows"):
        own.replace(own.read().limit(0))
    with pytest.raises(ValueError, match="12 rows in place of 13"):
        own.replace(own.read(), 13)


def test_a_client_that_fails_twice(spark, tmp_path):
    place = str(tmp_path)

    def shaky(texts, place=place):  # every first text fails twice, in one task as in another
        mark = os.path.join(place, texts[0])
        n = len(os.listdir(mark)) if os.path.isdir(mark) else 0
        os.makedirs(os.path.join(mark, str(n)))
        if n < 2:
            raise index.Retryable("busy") if n else OSError("network down")
        return [[float(len(texts))] for _ in texts]

    rows = spark.createDataFrame([(f"t{k:02d}",) for k in range(23)], "text string").coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        out = index.embedded_or_not(rows, "text", shaky, pause=0.0).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [(r.text, r.vector, r.embed_error) for r in out] == [(f"t{k:02d}", [10.0 if k < 20 else 3.0], None) for k in range(23)]
    assert sorted(os.listdir(place)) == ["t00", "t10", "t20"] and all(len(os.listdir(os.path.join(place, t))) == 3 for t in os.listdir(place))


def test_a_call_ends():
    waits, calls = [], []

    def never(texts):
        calls.append(texts)
        raise index.Retryable("busy")

    assert index.called(never, ["a", "b"], 5, 1.0, None, waits.append) == ([None, None], "Retryable: busy")
    assert waits == [1.0, 2.0, 4.0, 8.0] and len(calls) == 5
    waits.clear()

    def refused(texts):
        raise ValueError("no such model")

    assert index.called(refused, ["a"], 5, 1.0, None, waits.append)[1] == "ValueError: no such model" and not waits


def test_top_k_each_in_passes(spark):
    """More queries than one pass takes, against the cosine of every pair; copies, zeros, nulls, NaN and two lengths."""
    rng = np.random.default_rng(3)
    vectors = [rng.standard_normal(8 if k % 5 else 6).tolist() for k in range(60)]
    vectors += [vectors[1]] * 15 + [[0.0] * 8, None, [], [1.0, None] + [0.0] * 6, [float("nan")] * 8, [1e200] * 8, [1e-200] * 8]
    rows = spark.createDataFrame([(k * 7 % 83, str(k), v) for k, v in enumerate(vectors)], "id long, name string, v array<double>").repartition(3)
    asked = rows.where("id % 4 = 0").select(F.col("id").alias("query"), F.col("v").alias("q"))
    got = retrieval.top_k_each(rows, "v", asked, "query", "q", "id", 5, most=4)
    assert got.columns == ["query", "id", "name", "score", "pos"]
    pairs = asked.crossJoin(rows).select("query", "id", "name", retrieval.cosine(F.col("v"), F.col("q")).alias("score")).collect()
    key = lambda s: float("-inf") if math.isnan(s) else -round(s, 9)
    want = set()
    for q in {r.query for r in pairs}:
        best = sorted((r for r in pairs if r.query == q), key=lambda r: (key(r.score), r.id))[:5]
        want |= {(q, r.id, r.name, repr(r.score), k) for k, r in enumerate(best)}
    out = {(r.query, r.id, r.name, repr(r.score), r.pos) for r in got.collect()}
    assert sorted(out - want) == sorted(want - out)
    assert retrieval.top_k_each(rows, "v", asked.where("false"), "query", "q", "id").count() == 0
