"""Operators on vectors, components and the pipeline against brute-force versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.llm import vector_dedup, vector_search
from tesserae.llm.common import components

SCHEMA = "vec_id long, embedding array<float>, label int, uid string, rank int, score string"


def rows(seed: int = 0) -> list[tuple]:
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(120, 16))
    near = [base[k % 6] + rng.normal(size=16) * 0.12 for k in range(60)]
    vectors = [*base, *near, base[0], base[0], base[1] * 3]
    out = [(k * 5 % 1009, [float(x) for x in v]) for k, v in enumerate(vectors)]
    out += [(1500, None), (1520, [0.0] * 16), (1540, [float("nan")] * 16), (1560, [None] * 16), (1580, [float("inf")] + [1.0] * 15)]
    out += [(out[5][0], out[5][1]), (None, out[7][1]), (1600, [1.0, 2.0])]
    return [(i, v, 0, "u", 1, "s") for i, v in out]


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


def usable(v) -> bool:
    return v is not None and None not in v and np.isfinite(v).all() and any(v)


def test_search(spark, vectors):
    got = vector_search.search(vectors, lambda i: i % 20 == 0, 5, block=32).collect()
    data = [(r.vec_id, np.float32(r.embedding).astype(float)) for r in vectors.collect() if usable(r.embedding)]
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    asked = [(k, i, v) for k, (i, v) in enumerate(data) if i is not None and i % 20 == 0]
    assert set(by) == {i for _, i, v in asked if sum(len(w) == len(v) for _, w in data) > 1}
    for k, i, v in asked:
        others = [(-float(v @ w), j is None, j or 0, j) for m, (j, w) in enumerate(data) if m != k and len(w) == len(v)]
        want = sorted(others)[:5]
        mine = sorted(by.get(i, []))
        if sum(j == i for j, _ in data) == 1:
            assert [x[1] for x in mine] == [w[3] for w in want] and np.allclose([x[2] for x in mine], [-w[0] for w in want])
    assert vector_search.search(vectors.limit(0), lambda i: i % 20 == 0).count() == 0
    assert vector_search.search(vectors.where("vec_id = 0"), lambda i: i % 20 == 0).count() == 0


@pytest.mark.parametrize("scale", [1e-7, 1e7, 1e-160])
def test_search_at_any_scale(spark, scale):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 16)) * scale
    x[40:50] = x[7]  # equal scores go by id
    table = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    got = {}
    for r in vector_search.search(table, lambda i: i % 20 == 0, 12, block=8).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = r.vec_id
    score = lambda a, b: sum((float(p * q) for p, q in zip(a, b, strict=True)), 0.0)
    want = {q: sorted((k for k in range(60) if k != q), key=lambda k, q=q: (-score(x[q], x[k]), k))[:12] for q in (0, 20, 40)}
    assert {q: [r[k] for k in sorted(r)] for q, r in got.items()} == want


@pytest.mark.parametrize("block", [1024, 16])
def test_near_vectors(vectors, monkeypatch, block):
    monkeypatch.setattr(vector_dedup, "BLOCK", block)
    own = vectors.collect()
    good = [k for k, r in enumerate(own) if usable(r.embedding)]
    unit = {k: np.float64(np.float32(own[k].embedding)) for k in good}
    unit = {k: v / np.linalg.norm(v) for k, v in unit.items()}
    link = {k: [j for j in good if j != k and len(unit[j]) == len(unit[k]) and unit[j] @ unit[k] >= 0.9] for k in good}
    root = list(range(len(own)))
    for _ in own:
        for k in good:
            root[k] = min([root[k], *(root[j] for j in link[k])])
    names = {}
    for k, r in enumerate(own):
        if r.vec_id is not None:
            names[root[k]] = min(names.get(root[k], 1 << 60), r.vec_id)
    want = sorted((r.vec_id if r.vec_id is not None else -1, len(link.get(k, [])), names.get(root[k], -1)) for k, r in enumerate(own))
    got = vector_dedup.near_vectors(vectors, tables=40).collect()
    assert sorted((r.vec_id if r.vec_id is not None else -1, r.n_links, r.component_id if r.component_id is not None else -1) for r in got) == want
    assert all(r.kept == (r.vec_id == r.component_id) for r in got if r.vec_id is not None)
    assert vector_dedup.near_vectors(vectors.limit(0)).count() == 0


def test_near_vectors_at_a_million_rows(spark, monkeypatch):
    monkeypatch.setattr(vector_dedup, "projections_for", lambda rows: 22)  # as for a million rows; the tables are the default
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(2, 400, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= (x * y).sum(axis=1, keepdims=True) * x
    y = 0.901 * x + np.sqrt(1 - 0.901**2) * y / np.linalg.norm(y, axis=1, keepdims=True)
    both = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(np.concatenate([x, y]))], "vec_id long, embedding array<double>")
    got = vector_dedup.near_vectors(both).where("n_links > 0").count()
    assert got >= 2 * 0.97 * 400


def test_components(spark):
    rng = np.random.default_rng(1)
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(int(a), int(b)) for a, b in rng.integers(200, 260, (50, 2))]
    edges += [(5, 5), (1000, 999), (999, 1000)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    low = {x: x for e in edges for x in e}
    for _ in range(100):
        for a, b in edges:
            low[a] = low[b] = min(low[a], low[b])
    assert got == {k: v for k, v in low.items() if any(k in e and e[0] != e[1] for e in edges)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pipeline(spark, docs, none):
    import corpus_pipeline as c

    assert [n for n, _ in c.STAGES] == ["language", "near_duplicates", "secret_scan", "mixture", "sequences"]
    now = docs
    for k, (name, stage) in enumerate(c.STAGES):
        out = c.written(stage(spark, now, ""), name)
        if k < len(c.STAGES) - 1:
            assert out.columns == c.COLUMNS and 0 < out.count() <= now.count()
        if name == "near_duplicates":
            from tesserae.llm.ngram_join import near_sets

            again = near_sets(out)
            assert again.where("n_shingles > 0").groupBy("component_id").count().where("count > 1").count() == 0
            assert near_sets(now).where("n_shingles > 0").select("component_id").distinct().count() == again.where("n_shingles > 0").count()
        if name == "secret_scan":
            assert out.count() == now.count()
        now = out
    assert now.where(F.col("length") < 1).count() == 0
    empty = none.select(*c.COLUMNS)
    for _, stage in c.STAGES[:-1]:
        empty = stage(spark, empty, "").select(*c.COLUMNS)
    assert c.sequences(spark, empty, "").count() == 0
