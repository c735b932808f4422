"""Operator 7: mix sources, languages and topics to target token weights by iterative proportional fitting."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import held, small_batches, small_table, written

SIZE = 128
GRAIN = 1 << 24  # steps a unit when vectors are added up
OTHER, MISSING = "(other)", "(none)"
MARGINS = ("source", "lang", "topic")


class _Slots(dict):
    """The hashed place of each word; emptied when it is full."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 60_000:
            self.clear()
        self[word] = slot = zlib.crc32(word.encode("utf-8", "replace")) % SIZE
        return slot


def _vectors(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hellinger vectors of hashed words, and numbers of words, of whole texts."""
    out, n, slots = np.zeros((len(texts), SIZE)), np.zeros(len(texts), np.int64), held("slots", _Slots)
    for k, text in enumerate(texts):
        words = text.split()
        n[k] = len(words)
        if words:
            out[k] = np.bincount(np.fromiter(map(slots.__getitem__, words), np.int64, len(words)), minlength=SIZE)
    return np.sqrt(out / np.maximum(n, 1)[:, None]), n


def _scores(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Similarity of rows to centres; a row has the same ones in whatever batch it comes."""
    return np.einsum("ij,kj->ik", x, c)


def _starts(x: np.ndarray, topics: int) -> np.ndarray:
    """Far-apart rows, the same for the same rows."""
    if not len(x):
        return np.zeros((1, SIZE))
    picks = [0]
    for _ in range(1, min(topics, len(x))):
        picks.append(int(np.argmin((x @ x[picks].T).max(axis=1))))
    return x[picks]


def _stacked(vectors: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(vectors), np.float32).reshape(-1, SIZE).astype(float)


def _sums(c: np.ndarray):
    """Of each task: by centre and component the sum over its rows, in whole steps of 1 / ``GRAIN``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, total = np.zeros(len(c), np.int64), np.zeros((len(c), SIZE), np.int64)
        for batch in batches:
            x = _stacked(batch["vector"])
            own = _scores(x, c).argmax(axis=1)
            steps = np.rint(x * GRAIN).astype(np.int64)
            for k in np.unique(own):
                n[k] += (own == k).sum()
                total[k] += steps[own == k].sum(axis=0)
        used = np.flatnonzero(n)
        yield pd.DataFrame({"topic": np.repeat(used, SIZE), "place": np.tile(np.arange(SIZE), len(used)), "total": total[used].ravel()})

    return run


def topic_centres(vectors: DataFrame, topics: int = 8, max_rows: int = 2000, rounds: int = 25) -> np.ndarray:
    """Spherical k-means over all rows of ``vectors`` (``doc_id``, ``vector``, ``tokens``) that have a word.

    Only the starts come from a sample: far-apart rows of ``max_rows`` at most, those of the smallest hashes of id and
    vector, where equal rows count once; tasks leave out larger hashes, so that no more is sent with more tasks. In each
    round tasks assign their rows and add them up, and the driver receives a whole number for each topic and
    component, so that the result does not depend on partitions. Ends when no centre moves.
    """
    rows = vectors.where("tokens > 0").select("doc_id", "vector")
    draw = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "vector")
    lowest = -(1 << 63) + min(1.0, 4 * max_rows / max(rows.count(), 1)) * float(1 << 64)
    some = rows.select("vector", draw.alias("draw")).where(F.col("draw") <= lowest).dropDuplicates(["draw"])
    first = some.orderBy("draw").limit(max_rows).toPandas()
    x = _stacked(first["vector"])
    c = _starts(x[np.lexsort(x.T)] if len(x) else x, topics)
    for _ in range(rounds if len(x) else 0):
        parts = rows.select("vector").mapInPandas(_sums(c), "topic long, place long, total long")
        got = parts.groupBy("topic", "place").agg(F.sum("total").alias("total")).toPandas()
        now = c.copy()
        now[got["topic"].to_numpy(), got["place"].to_numpy()] = got["total"].to_numpy(float)
        now /= np.maximum(np.linalg.norm(now, axis=1, keepdims=True), 1e-12)
        if np.abs(now - c).max() < 1e-9:
            break
        c = now
    return c


def _sketch(text):
    """Of a text its vector, as bytes of 32-bit numbers, and its number of words."""

    @F.pandas_udf("struct<vector: binary, tokens: long>")
    def sketch(texts: pd.Series) -> pd.DataFrame:
        x, n = _vectors([t or "" for t in texts])
        return pd.DataFrame({"vector": [v.tobytes() for v in x.astype(np.float32)], "tokens": n})

    return sketch.asNondeterministic()(text)  # evaluated once


def _topics(centres: np.ndarray):
    @F.pandas_udf("string")
    def topics(vectors: pd.Series) -> pd.Series:
        return pd.Series(_scores(_stacked(vectors), centres).argmax(axis=1).astype(str))

    return topics.asNondeterministic()  # evaluated once, not again for the join


def rake(tokens: np.ndarray, targets: list[np.ndarray], share: float, rounds: int = 500) -> np.ndarray:
    """Probabilities of the cells of a table of token counts.

    Every margin in turn is scaled so that the expected tokens of its values are ``share`` of all tokens times
    its target; probabilities stop at 1. Where the targets can be met they are; a value with too few tokens is
    taken whole.
    """
    total = tokens.sum() * share
    p = np.full(tokens.shape, float(share))
    for _ in range(rounds):
        before = p.copy()
        for axis, target in enumerate(targets):
            rest = tuple(a for a in range(tokens.ndim) if a != axis)
            now = (p * tokens).sum(axis=rest)
            scale = np.where(now > 0, target * total / np.maximum(now, 1e-12), 1.0)
            shape = [1] * tokens.ndim
            shape[axis] = -1
            p = np.minimum(p * scale.reshape(shape), 1.0)
        if np.abs(p - before).max() < 1e-9:
            break
    return p


def flattened(shares: np.ndarray, power: float) -> np.ndarray:
    """Shares to a power, made to sum to 1: below 1 lifts small values."""
    out = np.where(shares > 0, shares, 0) ** power * (shares > 0)
    return out / max(out.sum(), 1e-12)


def mix(
    docs: DataFrame, share: float = 0.5, power: float = 0.7, targets: dict[str, dict[str, float]] | None = None,
    topics: int = 8, most: dict[str, int] | None = None, seed: int = 29, keep: tuple[str, ...] = ("doc_id",),
) -> DataFrame:
    """Sample documents so that their tokens meet target shares of source, language and topic.

    ``targets`` gives shares by margin and value; a margin that it leaves out aims at its own shares to the
    ``power``. Each row gets its topic from its whole text, its number of words (tokens), the probability of its
    cell, and ``kept``, which follows from a hash of the id. Adds source_group, lang_group, topic, tokens,
    probability and kept to the columns ``keep`` and takes the place of columns of these names, in either case;
    rows that are not kept stay in the result.

    The driver sees the cells only: the ``most`` largest values of a margin (256 sources and 64 languages unless
    given) have cells of their own, and the rest share one. Nulls are a value of their own. Empty and null texts
    have no tokens. Repeated ids share one decision. An empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    most = {"source": 256, "lang": 64} | (most or {})
    added = {"source_group", "lang_group", "topic", "tokens", "probability", "kept"}
    kept = {f"_{k}": c for k, c in enumerate(keep) if c.lower() not in added}  # no name clashes on the way
    names = [*kept, "doc_id", "source", "lang"]
    own = _sketch(F.col("text").cast("string")).alias("_own")
    rows = docs.select(*(F.col(c).alias(k) for k, c in kept.items()), "doc_id", "source", "lang", own)
    sketched = written(rows.select(*names, "_own.vector", "_own.tokens"), "sketched")
    topic = _topics(topic_centres(sketched, topics))(F.col("vector")).alias("topic")
    labelled = sketched.select(*names, topic, "tokens")
    for name in ("source", "lang"):
        value = F.coalesce(F.col(name).cast("string"), F.lit(MISSING))
        wanted = list((targets or {}).get(name, {}))
        top = labelled.groupBy(value.alias("v")).agg(F.sum("tokens").alias("n")).orderBy(F.desc("n"), "v").limit(most[name])
        values = sorted({r[0] for r in top.collect()} | set(wanted))  # the bound above, and the given targets
        labelled = labelled.withColumn(f"{name}_group", F.when(value.isin(values), value).otherwise(F.lit(OTHER)))
    groups = ["source_group", "lang_group", "topic"]
    cells = labelled.groupBy(*groups).agg(F.sum("tokens").alias("tokens")).toPandas()  # a bounded number of cells
    axes = [sorted(cells[g].unique()) for g in groups]
    table = np.zeros([max(len(a), 1) for a in axes])
    for s, lang, t, n in cells.itertuples(index=False):
        table[axes[0].index(s), axes[1].index(lang), axes[2].index(t)] = n
    aims = []
    for axis, name in enumerate(MARGINS):
        given = (targets or {}).get(name)
        own = table.sum(axis=tuple(a for a in range(3) if a != axis)) / max(table.sum(), 1)
        aim = np.array([given.get(v, 0.0) for v in axes[axis]]) if given else flattened(own, power)
        aims.append(aim / max(aim.sum(), 1e-12))
    p = rake(table, aims, share)
    chances = [
        (s, lang, t, float(p[i, j, k]))
        for i, s in enumerate(axes[0]) for j, lang in enumerate(axes[1]) for k, t in enumerate(axes[2])
    ]
    chance = small_table(docs.sparkSession, chances, "source_group string, lang_group string, topic string, probability double")
    draw = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
    out = labelled.join(F.broadcast(chance), groups).withColumn("kept", draw < F.col("probability"))
    return out.select(*(F.col(k).alias(c) for k, c in kept.items()), *groups, "tokens", "probability", "kept")
