"""Operator 6: nearest neighbours by windows along shifted Hilbert orderings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from tesserae.llm.common import discard, width, written
from tesserae.llm.hilbert import hilbert_key
from tesserae.llm.vectors import numbered, stacked

DIMS, BITS = 6, 10


def _keys(longest: float, curves: int, seed: int):
    """Keys of every vector on every curve. A further coordinate makes all lengths equal, so that a large inner
    product is a small distance; each curve has its own directions and its own shift."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            dims = batch["v"].map(len).to_numpy()
            for d in np.unique(dims):
                own = np.flatnonzero(dims == d)
                x = stacked(batch["v"].iloc[own]) / longest
                x = np.hstack([x, np.sqrt(np.maximum(1 - (x * x).sum(axis=1, keepdims=True), 0))])
                rng = np.random.default_rng([seed, int(d)])
                for c in range(curves):
                    axes = np.linalg.qr(rng.standard_normal((d + 1, min(DIMS, d + 1))))[0]
                    y = x @ axes * np.sqrt(d + 1) / 8 + 0.5 + rng.random(axes.shape[1]) / 4 - 0.125
                    cells = np.clip(y * (1 << BITS), 0, (1 << BITS) - 1)
                    key = hilbert_key(cells, BITS)
                    yield pd.DataFrame({"uid": batch["uid"].iloc[own], "curve": c, "dims": int(d), "key": key})

    return run


def _running(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Row numbers of each ordering within a sorted partition."""
    part, last, n = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        line = list(zip(batch["curve"], batch["dims"], strict=True))
        at = np.zeros(len(line), np.int64)
        for k, own in enumerate(line):
            n = n + 1 if own == last else 0
            at[k], last = n, own
        yield pd.DataFrame({"uid": batch["uid"], "curve": batch["curve"], "dims": batch["dims"], "part": part, "at": at})


def _best(q: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int, least: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query the rows with the k largest inner products, ties to the smaller id, none below ``least``.

    A matrix product finds the rows that come near; their scores are then summed in the order of the components, as
    they are at the end, so equal vectors have equal scores wherever they stand. What counts as near follows from the
    rounding of a product of these lengths, so vectors of any scale are told apart.
    """
    s = q @ x.T
    slack = 8 * q.shape[1] * np.finfo(float).eps * np.linalg.norm(q, axis=1) * np.linalg.norm(x, axis=1).max()
    for r in range(len(q)):
        own = np.flatnonzero(s[r] >= least[r] - slack[r])
        if len(own) > k:
            last = np.partition(s[r][own], len(own) - k)[len(own) - k]
            own = own[s[r][own] >= last - 2 * slack[r]]
        exact = np.cumsum(x[own] * q[r], axis=1)[:, -1]
        own, exact = own[exact >= least[r]], exact[exact >= least[r]]
        if len(own) > k:
            first = np.lexsort((ids[own], -exact))[:k]
            own, exact = own[first], exact[first]
        if len(own):
            yield r, own, exact


FOUND = "query_uid long, uid long, vec_id long, score double"


def _windows(k: int):
    def work(rows: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows) and len(asks):
            x, ids = stacked(rows["v"]), rows["vec_id"].fillna(0).to_numpy().astype(np.int64)
            uids, names = rows["uid"].to_numpy(), rows["vec_id"].to_numpy()
            for lo in range(0, len(asks), 256):
                part = asks.iloc[lo : lo + 256]
                # one more than k: a query is among its own rows
                for r, own, s in _best(stacked(part["v"]), x, ids, k + 1, np.full(len(part), -np.inf)):
                    me = part["uid"].iloc[r]
                    out.append(pd.DataFrame({"query_uid": me, "uid": uids[own], "vec_id": names[own], "score": s}))
        out = [x[x["uid"] != x["query_uid"]] for x in out]
        empty = pd.DataFrame({"query_uid": [], "uid": [], "vec_id": [], "score": []})
        return (pd.concat(out) if out else empty).astype({"query_uid": "int64", "uid": "int64", "vec_id": "Int64", "score": "float64"})

    return work


def _summary(g: pd.DataFrame) -> pd.DataFrame:
    """A block of rows as one row: its matrix, its ids, its centre and its radius."""
    x = stacked(g["v"])
    centre = x.mean(axis=0)
    return pd.DataFrame(
        {
            "dims": [int(g["dims"].iloc[0])],
            "block": [int(g["block"].iloc[0])],
            "x": [x.tobytes()],
            "uids": [g["uid"].to_numpy(np.int64).tobytes()],
            "ids": [list(g["vec_id"])],
            "centre": [centre.tobytes()],
            "radius": [float(np.sqrt(((x - centre) ** 2).sum(axis=1).max()))],
        }
    )


def _asked(g: pd.DataFrame) -> pd.DataFrame:
    """A chunk of queries as one row."""
    return pd.DataFrame(
        {
            "dims": [int(g["dims"].iloc[0])],
            "chunk": [int(g["chunk"].iloc[0])],
            "q": [stacked(g["v"]).tobytes()],
            "q_uids": [g["uid"].to_numpy(np.int64).tobytes()],
            "least": [g["least"].to_numpy(np.float64).tobytes()],
        }
    )


def _reach(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The blocks whose centre and radius allow a row that a query of the chunk still wants."""
    for batch in batches:
        rows = []
        for r in batch.itertuples():
            q = np.frombuffer(r.q).reshape(-1, r.dims)
            c = np.stack([np.frombuffer(x) for x in r.centres])
            most = q @ c.T + np.linalg.norm(q, axis=1)[:, None] * np.array(r.radii) * (1 + 1e-9) + 1e-12
            rows += [(r.dims, r.chunk, r.blocks[j]) for j in np.flatnonzero((most >= np.frombuffer(r.least)[:, None]).any(axis=0))]
        yield pd.DataFrame(rows, columns=["dims", "chunk", "block"])


def _finish(k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                q, x = np.frombuffer(r.q).reshape(-1, r.dims), np.frombuffer(r.x).reshape(-1, r.dims)
                mine, uids, least = np.frombuffer(r.q_uids, np.int64), np.frombuffer(r.uids, np.int64), np.frombuffer(r.least)
                names = pd.array(r.ids, "Int64")
                ids = names.fillna(0).to_numpy().astype(np.int64)
                out = [
                    pd.DataFrame({"query_uid": mine[i], "uid": uids[own], "vec_id": names[own], "score": s})
                    for i, own, s in _best(q, x, ids, k + 1, least - np.abs(least) * 1e-12)
                ]
                if out:
                    out = pd.concat(out)
                    yield out[out["uid"] != out["query_uid"]]

    return run


def search(
    vectors: DataFrame, is_query, k: int = 20, curves: int = 4, block: int = 1024, seed: int = 17,
    id_col: str = "vec_id", vec_col: str = "embedding", exact: bool = True,
) -> DataFrame:
    """The ``k`` rows of the largest inner product with each row for which ``is_query`` (a condition on vec_id) holds.

    Vectors are projected, shifted and ordered along several Hilbert curves by a range shuffle. A query reads the
    block that it lies in and both neighbouring blocks on every curve; these windows merge into its first k rows
    and so into a least score. With ``exact`` a check follows on the first curve: blocks whose centre and radius
    leave room for a better row are read as well, so results are exact. Where data have structure, few blocks are
    left; where they have none (unrelated directions), nearly all are, and the cost is queries times rows. Without
    it the windows alone answer, in time that grows with rows and queries: measure their recall on the data at hand.
    Scores are sums of products in the order of the components, in doubles.

    Returns query_id, rank, vec_id, score, nearest first, ties to the smaller id. Null, zero or non-finite vectors
    take no part; vectors of another length are no candidates; repeated ids are rows of their own; a null id is a
    candidate and never a query. An empty table gives no rows.
    """
    spark, parts = vectors.sparkSession, width(vectors.sparkSession)
    rows = numbered(vectors, id_col, vec_col).where("v is not null")
    rows = rows.withColumn("dims", F.size("v")).withColumn("asks", F.coalesce(is_query(F.col("vec_id")), F.lit(False)))
    longest = rows.agg(F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))).first()[0] or 1.0
    keys = written(rows.select("uid", "v").mapInPandas(_keys(longest, curves, seed), "uid long, curve int, dims int, key long"), "keys")
    line = keys.repartitionByRange(parts, "curve", "dims", "key", "uid").sortWithinPartitions("curve", "dims", "key", "uid")
    line = written(line.mapInPandas(_running, "uid long, curve int, dims int, part int, at long"), "line")
    sizes = line.groupBy("curve", "dims", "part").agg(F.count("*").alias("n")).collect()  # partitions and curves at most
    base, before = [], {}
    for c, d, part, n in sorted(map(tuple, sizes)):
        base.append((c, d, part, before.get((c, d), 0)))
        before[c, d] = before.get((c, d), 0) + n
    bases = spark.createDataFrame(base, "curve int, dims int, part int, base long")
    placed = line.join(F.broadcast(bases), ["curve", "dims", "part"]).withColumn("pos", F.col("base") + F.col("at"))
    placed = placed.select("uid", "curve", "dims", "pos", F.floor(F.col("pos") / block).cast("long").alias("block"))
    whole = written(placed.join(rows.select("uid", "vec_id", "v", "asks"), "uid"), "placed")

    spot = ["curve", "dims", "block"]
    near = F.explode(F.array(*(F.col("block") + d for d in (-1, 0, 1))))
    asks = whole.where("asks").select("curve", "dims", near.alias("block"), "uid", "v")
    windows = whole.select(*spot, "uid", "vec_id", "v").groupBy(*spot).cogroup(asks.groupBy(*spot)).applyInPandas(_windows(k), FOUND)
    first = written(_ranked(windows, k).drop("rank"), "windows")

    found, tables = first.select("query_uid", "uid", "vec_id", "score"), [keys, line, whole, first]
    if exact:
        more, read = _rest(whole, first, k, block, parts)
        found, tables = found.union(more), [*tables, *read]
    best = written(_ranked(found, k).select("query_uid", "uid", "vec_id"), "best")
    asked = rows.where("asks").select(F.col("uid").alias("query_uid"), F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    pairs = best.join(rows.select("uid", "v"), "uid").join(asked, "query_uid")
    product = F.aggregate(F.zip_with("q", "v", lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x)
    scored = written(pairs.select("query_uid", "query_id", "uid", "vec_id", product.alias("score")), "found")
    out = _ranked(scored, k, "query_id").select("query_id", "rank", "vec_id", "score")
    discard(*tables, best)
    return out


def _rest(whole: DataFrame, first: DataFrame, k: int, block: int, parts: int) -> tuple[DataFrame, list[DataFrame]]:
    """What blocks of the first curve add to ``first``, and the tables that it reads."""
    flat = whole.where("curve = 0")
    blocks = written(
        flat.groupBy("dims", "block").applyInPandas(
            _summary, "dims int, block long, x binary, uids binary, ids array<long>, centre binary, radius double"
        ),
        "blocks",
    )
    least = first.groupBy("query_uid").agg(F.count("*").alias("n"), F.min("score").alias("low"))
    asked = flat.where("asks").select("dims", "pos", "uid", "v").join(least, F.col("uid") == F.col("query_uid"), "left")
    asked = asked.withColumn("least", F.when(F.col("n") >= k, F.col("low")).otherwise(F.lit(float("-inf"))))
    asked = asked.withColumn("chunk", F.floor(F.col("pos") / (16 * block)).cast("long"))
    asked = asked.withColumn("chunk", F.col("chunk") * 64 + F.pmod(F.hash("uid"), F.lit(4)))  # queries may lie close together
    chunks = written(
        asked.groupBy("dims", "chunk").applyInPandas(_asked, "dims int, chunk long, q binary, q_uids binary, least binary"), "chunks"
    )
    page = F.floor(F.col("block") / 256).cast("long")
    pages = blocks.groupBy("dims", page.alias("page")).agg(
        F.collect_list("block").alias("blocks"), F.collect_list("centre").alias("centres"), F.collect_list("radius").alias("radii")
    )  # 256 at most
    counts = blocks.groupBy("dims").agg(F.max(page).alias("last"))
    spread = chunks.join(F.broadcast(counts), "dims").withColumn("page", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))))
    reach = spread.join(pages, ["dims", "page"]).mapInPandas(_reach, "dims int, chunk long, block long")
    pairs = reach.repartition(parts, "dims", "block").join(chunks, ["dims", "chunk"]).join(blocks, ["dims", "block"])
    more = pairs.select("dims", "q", "q_uids", "least", "x", "uids", "ids").mapInPandas(_finish(k), FOUND)
    return more, [blocks, chunks]


def _ranked(found: DataFrame, k: int, *keep: str) -> DataFrame:
    """Each query's best k rows; a row found more than once counts once."""
    once = found.groupBy("query_uid", "uid", *keep).agg(F.max("score").alias("score"), F.first("vec_id").alias("vec_id"))
    order = W.Window.partitionBy("query_uid").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "uid")
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
