"""The article store against one article after another."""

import random

from tesserae.operators import corpus

FOUND, KEPT = "pos int, url string, article_id string, keywords array<string>", "id string, url string, article_id string, keywords array<string>"


def one_by_one(store: list, found: list) -> list:
    store = [[i, u, a, list(k or [])] for i, u, a, k in store]
    numbers = [int(i[7:]) for i, *_ in store if i.startswith("speech_") and i[7:].isdigit()]
    for _, url, article_id, words in sorted(found, key=lambda r: r[0]):
        if url is None and article_id is None:
            continue
        own = [x for x in sorted(store[: len(store)], key=lambda x: x[0]) if url is not None and x[1] == url]
        own = own or [x for x in sorted(store, key=lambda x: x[0]) if article_id is not None and x[2] == article_id]
        if not own:
            numbers.append(max(numbers, default=0) + 1)
            own = [[f"speech_{numbers[-1]:03d}", url, article_id, []]]
            store += own
        own[0][3] += [w for w in dict.fromkeys(words or []) if w is not None and w not in own[0][3]]
    return sorted(map(tuple, ((i, u, a, tuple(k)) for i, u, a, k in store)))


def test_articles_found_by_two_keys(spark):
    store = [("speech_001", "u1", "a1", ["x"])]
    found = [(1, "u9", "a9", ["x"]), (2, "u9", "a9", ["y"]), (3, "u8", "a9", ["z"]), (4, "u8", "a7", ["v"]), (5, "u1", "a9", ["w"])]
    got = corpus.saved(spark.createDataFrame(store, KEPT), spark.createDataFrame(found, FOUND), "pos").collect()
    assert {r.id: (r.url, r.article_id, r.keywords) for r in got} == {
        "speech_001": ("u1", "a1", ["x", "w"]), "speech_002": ("u9", "a9", ["x", "y", "z"]), "speech_003": ("u8", "a7", ["v"]),
    }


def test_articles_one_by_one(spark):
    for seed in range(4):
        rng = random.Random(seed)
        key = lambda c, n: rng.choice([None, *(f"{c}{k}" for k in range(n))])
        words = lambda: rng.choice([None, [], ["a"], ["b", "a"], ["c", None, "b", "c"]])
        store = [(f"speech_{k:03d}", f"u{k}", f"a{k}", ["a"]) for k in range(3)] + [("other_99", None, "a5", None)]
        found = [(k, key("u", 12), key("a", 14), words()) for k in rng.sample(range(100), 40)]
        got = corpus.saved(spark.createDataFrame(store, KEPT), spark.createDataFrame(found, FOUND).repartition(3), "pos", ranges=3).collect()
        assert sorted((r.id, r.url, r.article_id, tuple(r.keywords)) for r in got) == one_by_one(store, found)


def test_a_chain_and_nothing(spark):
    chain = [(k, f"u{(k + 1) // 2}", f"a{k // 2}", [str(k)]) for k in range(9)]
    none = spark.createDataFrame([], KEPT)
    got = corpus.saved(none, spark.createDataFrame(chain, FOUND), "pos").collect()
    assert sorted((r.id, r.url, r.article_id, tuple(r.keywords)) for r in got) == one_by_one([], chain)
    assert corpus.saved(none, spark.createDataFrame([], FOUND), "pos").count() == 0


def test_pages_one_by_one(spark):
    from tesserae.plans import ingest

    import re

    rows = sorted(map(tuple, spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "url").collect()))
    own = [(k, re.search("//([^/?#]*)", u)[1].lower(), (re.search(r"/(\d+)", u) or [None, None])[1], u.split("/")) for k, u in rows]
    store = [(f"speech_{k}", u, a, w[:1]) for k, u, a, w in own if k % 10 == 0]
    got = ingest.article_identities(spark, "/root/testdata/sf0.001").collect()
    assert sorted((r.id, r.url, r.article_id, r.keywords) for r in got) == [(i, u, a, " ".join(w)) for i, u, a, w in one_by_one(store, [r for r in own if r[0] % 10])]
