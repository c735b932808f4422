"""Operator 8: near-duplicate vectors by p-stable hashing of Euclidean space."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import components, discard, width, written
from tesserae.llm.vectors import numbered, stacked

STEP = 2.4  # width of a quantised projection; near pairs at cosine 0.9 are 0.45 apart, unrelated ones about 1.41
BLOCK = 1024
MISS = 0.01  # most pairs at the least cosine that share no bucket, at every number of rows
LEAST_TABLES = 28
FEW = 8  # vectors of a group that is compared together with others


def projections_for(rows: int) -> int:
    """Projections a table: unrelated vectors then share about one bucket a row, however many rows there are."""
    return max(6, int(np.ceil(np.log(max(rows, 2)) / 0.635)))


def tables_for(k: int, least: float) -> int:
    """Tables of ``k`` projections that leave at most ``MISS`` of the pairs at cosine ``least`` without a common bucket."""
    ratio = STEP / max(math.sqrt(max(2 - 2 * least, 0.0)), 1e-6)
    inside = math.erf(ratio / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * ratio) * (1 - math.exp(-(ratio**2) / 2))
    share = inside**k  # of one table, by the collision probability of p-stable hashing
    return LEAST_TABLES if share >= 1 - MISS else max(LEAST_TABLES, math.ceil(math.log(MISS) / math.log1p(-share)))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class _Tables:
    """Bucket ids of unit vectors of one length: ``tables`` sums of ``k`` quantised random projections each.

    Vectors and planes are rounded to whole multiples of powers of two, so that every product sums exactly: a bucket
    id does not depend on which rows are hashed together, and a later task may hash a vector again.
    """

    def __init__(self, dims: int, tables: int, k: int, seed: int):
        rng = np.random.default_rng([seed, dims])
        self.k, self.tables = k, tables
        self.planes = np.rint(rng.standard_normal((dims, tables * k)) * 2.0**16) / 2.0**16
        self.shift = rng.random(tables * k)
        self.mix = rng.integers(1, 1 << 62, tables * k, dtype=np.int64) | 1
        self.salt = np.arange(tables, dtype=np.int64) * np.int64(0x9E3779B97F4A7C1) + dims

    def of(self, x: np.ndarray, low: int, high: int) -> np.ndarray:
        """Ids of the tables from ``low`` to before ``high``, a row for each vector."""
        out, cols = np.zeros((len(x), high - low), np.int64), slice(low * self.k, high * self.k)
        part = max(1, (1 << 21) // max((high - low) * self.k, 1))  # rows projected at once
        for lo in range(0, len(x), part):
            own = np.rint(x[lo : lo + part] * 2.0**22) / 2.0**22
            cells = np.floor(own @ self.planes[:, cols] / STEP + self.shift[cols]).astype(np.int64) * self.mix[cols]
            h = cells.reshape(len(own), high - low, self.k).sum(axis=2) + self.salt[low:high]
            out[lo : lo + part] = (h ^ (h >> np.int64(29))) * np.int64(-4658895280553007687)
        return out


def _family(tables: int, k: int, seed: int):
    """The tables of each length of vector, made once a task."""
    made: dict[int, _Tables] = {}

    def get(dims: int) -> _Tables:
        if dims not in made:
            made[dims] = _Tables(dims, tables, k, seed)
        return made[dims]

    return get


def _sketches(x: np.ndarray) -> list[bytes]:
    """Unit vectors in one byte a component: the step, the length of what rounding took away, and the whole steps."""
    step = np.abs(x).max(axis=1, keepdims=True) / 127
    whole = np.rint(x / step).astype(np.int8)
    lost = np.linalg.norm(x - whole * step, axis=1)
    head = np.stack([step[:, 0], lost], axis=1)
    return [h.tobytes() + w.tobytes() for h, w in zip(head, whole, strict=True)]


def _opened(sketches) -> tuple[np.ndarray, np.ndarray]:
    """The rounded vectors of sketches of one length, and what each may add to an inner product with another one."""
    raw = np.frombuffer(b"".join(sketches), np.uint8).reshape(len(sketches), -1)
    head = np.ascontiguousarray(raw[:, :16]).view(np.float64)
    return raw[:, 16:].view(np.int8) * head[:, :1], head[:, 1]


def _hashes(tables: int, k: int, seed: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        family = _family(tables, k, seed)
        for batch in batches:
            signs, sketches = np.zeros((len(batch), tables), np.int64), np.empty(len(batch), object)
            dims = batch["v"].map(len).to_numpy()
            for d in np.unique(dims):
                own = np.flatnonzero(dims == d)
                x = _unit(stacked(batch["v"].iloc[own]))
                signs[own] = family(int(d)).of(x, 0, tables)
                sketches[own] = _sketches(x)
            yield pd.DataFrame({"uid": batch["uid"], "buckets": list(signs), "sketch": sketches})

    return run


def _by_group(batches: Iterator[pd.DataFrame], column: str, few, work, none: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """Apply ``work`` to every bucket's block or pair of blocks, rows of which follow one another.

    Groups of up to ``FEW`` vectors, which are nearly all, go to ``few`` together, as rows, starts and sizes, with one
    length of ``column``.
    """

    def cut(g: pd.DataFrame, last: bool) -> tuple[pd.DataFrame, pd.DataFrame]:
        marks = g[["bucket", "i", "j"]].to_numpy()
        edges = np.r_[0, np.flatnonzero((marks[1:] != marks[:-1]).any(axis=1)) + 1, len(g)]
        stop = len(edges) - 1 if last else len(edges) - 2
        start, size = edges[:stop], np.diff(edges[: stop + 1])
        found = [work(g.iloc[edges[k] : edges[k + 1]]) for k in np.flatnonzero(size > FEW)]
        small = (size <= FEW) & (size > 1)
        length = g[column].map(len).to_numpy()
        for d in np.unique(length[start[small]]) if small.any() else ():
            part = small & (length[start] == d)
            rows = np.concatenate([np.arange(a, a + n) for a, n in zip(start[part], size[part], strict=True)])
            found.append(few(g.iloc[rows], np.cumsum(size[part]) - size[part], size[part]))
        found = [y for y in found if len(y)]
        return (pd.concat(found, ignore_index=True) if found else none), g.iloc[edges[stop] :]

    wait: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        marks = batch[["bucket", "i", "j"]].to_numpy()
        same = bool(wait) and (wait[-1][["bucket", "i", "j"]].to_numpy()[-1] == marks).all()
        wait.append(batch)
        if not same:  # else the group goes on
            done, rest = cut(pd.concat(wait, ignore_index=True), False)
            wait = [rest]
            yield done
    if wait:
        yield cut(pd.concat(wait, ignore_index=True), True)[0]


def _possible(least: float):
    """Rows of a group that have a partner there whose cosine may be ``least``, by bounds from their sketches."""
    columns = ["uid", "t", "bucket", "i", "j", "side"]
    none = pd.DataFrame({c: np.zeros(0, np.int64) for c in columns})

    def few(g: pd.DataFrame, start: np.ndarray, size: np.ndarray) -> pd.DataFrame:
        x, lost = _opened(g["sketch"].tolist())
        norm, keep = np.linalg.norm(x, axis=1), np.zeros(len(g), bool)
        i, j, side = (g[c].to_numpy() for c in ("i", "j", "side"))
        for gap in range(1, FEW):
            for first in range(FEW - gap):
                a = start[size > first + gap] + first
                b = a + gap
                most = np.einsum("ij,ij->i", x[a], x[b]) + norm[a] * lost[b] + lost[a] * norm[b] + lost[a] * lost[b]
                a = a[(most + 1e-9 >= least) & ((i[a] == j[a]) | (side[a] != side[b]))]
                keep[a] = keep[a + gap] = True
        return g.loc[keep, columns]

    def work(g: pd.DataFrame) -> pd.DataFrame:
        x, lost = _opened(g["sketch"].tolist())
        norm = np.linalg.norm(x, axis=1)
        near = x @ x.T + np.outer(norm, lost) + np.outer(lost, norm) + np.outer(lost, lost) + 1e-9 >= least
        np.fill_diagonal(near, False)
        if g["i"].iloc[0] != g["j"].iloc[0]:  # pairs within a block are another group's
            side = g["side"].to_numpy()
            near &= side[:, None] != side[None, :]
        return g.loc[near.any(axis=1), columns]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return _by_group(batches, "sketch", few, work, none)

    return run


def _matches(least: float, tables: int, k: int, seed: int):
    """Within one bucket's block or pair of blocks: links counted at their first common table, and a star of links.

    Only vectors with a link there are hashed again, for the tables before the group's, and only until each of their
    links has met in one of them.
    """
    none = pd.DataFrame({c: np.zeros(0, np.int64) for c in ("uid", "links", "root")})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        family = _family(tables, k, seed)

        def spans(last: int):
            low, many = 0, 4
            while low < last:
                yield low, min(low + many, last)
                low, many = low + many, 2 * many

        def few(g: pd.DataFrame, start: np.ndarray, size: np.ndarray) -> pd.DataFrame:
            x, m, uid = _unit(stacked(g["v"])), g["m"].to_numpy(), g["uid"].to_numpy()
            i, j, side, t = (g[c].to_numpy() for c in ("i", "j", "side", "t"))
            out = []
            for gap in range(1, FEW):
                for first in range(FEW - gap):
                    a = start[size > first + gap] + first
                    a = a[(np.einsum("ij,ij->i", x[a], x[a + gap]) >= least) & ((i[a] == j[a]) | (side[a] != side[a + gap]))]
                    for low, high in spans(int(t[a].max()) if len(a) else 0):
                        back = np.flatnonzero(t[a] > low)
                        one, two = (family(x.shape[1]).of(x[y], low, high) for y in (a[back], a[back] + gap))
                        met = (one == two) & (np.arange(low, high) < t[a[back]][:, None])
                        a = np.delete(a, back[met.any(axis=1)])
                        if not len(a):
                            break
                    b, root = a + gap, np.minimum(uid[a], uid[a + gap])
                    out += [(uid[a], m[b], root), (uid[b], m[a], root)]
            return pd.DataFrame(dict(zip(none.columns, (np.concatenate(y) for y in zip(*out, strict=True)), strict=True)))

        def work(g: pd.DataFrame) -> pd.DataFrame:
            table, left, right = int(g["t"].min()), int(g["i"].iloc[0]), int(g["j"].iloc[0])
            x = _unit(stacked(g["v"]))
            near = x @ x.T >= least
            np.fill_diagonal(near, False)
            if left != right:
                side = g["side"].to_numpy()
                near &= side[:, None] != side[None, :]
            if not near.any():
                return none
            uid, m = g["uid"].to_numpy(), g["m"].to_numpy()
            root = uid.copy()
            while True:
                lower = np.minimum(root, np.where(near, root[None, :], np.iinfo(np.int64).max).min(axis=1))
                if (lower == root).all():
                    break
                root = lower
            for low, high in spans(table):
                own = np.flatnonzero(near.any(axis=1))
                if not len(own):
                    break
                signs = family(x.shape[1]).of(x[own], low, high)
                for n in range(high - low):
                    near[np.ix_(own, own)] &= signs[:, n][:, None] != signs[:, n][None, :]
            return pd.DataFrame({"uid": uid, "links": near @ m, "root": root})

        return _by_group(batches, "v", few, work, none)

    return run


def near_vectors(
    vectors: DataFrame, least: float = 0.9, tables: int | None = None, seed: int = 11, id_col: str = "vec_id", vec_col: str = "embedding"
) -> DataFrame:
    """Link vectors with a cosine of ``least`` or more that share a bucket; count links and name components.

    Returns vec_id, n_links, component_id, kept for every row. Equal vectors are one representative from the
    start. Representatives fall into ``tables`` buckets of quantised random projections; a bucket is compared
    with itself in blocks of bounded size, so a large bucket becomes many tasks: first by sketches of one byte a
    component, whose bounds lose no pair, then exactly, for which only rows with a possible partner carry their
    vector. A pair counts in the first table in which it meets, so links are summed without listing pairs; a task
    finds that table by hashing linked vectors again, so no row carries its buckets, and shuffled bytes grow with
    the tables a row, not with their square. Unless given, the number of tables
    follows from the projections a table, so that at every number of rows a pair at cosine ``least`` is missed
    with a probability of ``MISS`` at most, and a nearer pair more rarely.

    Vectors that are null, zero, or hold null or non-finite components: n_links 0, alone. Vectors of different
    length never link. Repeated ids are vectors of their own; a null id never becomes a component's name unless
    all of its ids are null.
    """
    spark = vectors.sparkSession
    rows = numbered(vectors, id_col, vec_col).withColumn("k1", F.xxhash64("v")).withColumn("k2", F.hash("v"))
    live = rows.where("v is not null")
    reps = live.groupBy("k1", "k2").agg(F.min("uid").alias("rep"), F.count("*").alias("m"), F.min("vec_id").alias("low"))
    reps = written(reps, "reps")
    whole = live.select("uid", "v").join(reps.select(F.col("rep").alias("uid"), "m"), "uid")
    k = projections_for(reps.count())
    family = (tables_for(k, least) if tables is None else tables, k, seed)
    signs = whole.select("uid", "v").mapInPandas(_hashes(*family), "uid long, buckets array<long>, sketch binary")
    signs = written(signs, "signs")
    spread = signs.select("uid", F.posexplode("buckets").alias("t", "bucket"))
    shared = spread.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    meet = spread.join(shared, "bucket").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    meet = meet.withColumn("own", F.pmod(F.hash("uid"), "blocks"))
    meet = meet.select("uid", "t", "bucket", "own", F.explode(F.expr("sequence(0, blocks - 1)")).alias("other"))
    meet = meet.select(
        "uid", "t", "bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.col("own").alias("side")
    )

    def grouped(rows: DataFrame) -> DataFrame:
        return rows.repartition(width(spark), "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")

    rough = grouped(meet.join(signs.select("uid", "sketch"), "uid"))
    close = written(rough.mapInPandas(_possible(least), meet.schema), "close")
    pairs = grouped(close.join(whole, "uid"))
    found = written(pairs.mapInPandas(_matches(least, *family), "uid long, links long, root long"), "links")
    discard(close)
    links = found.groupBy("uid").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("uid").alias("a"), F.col("root").alias("b")))
    named = reps.join(links, F.col("rep") == F.col("uid"), "left").drop("uid")
    named = named.join(roots, F.col("rep") == F.col("node"), "left").drop("node").withColumn("root", F.coalesce("root", "rep"))
    names = named.groupBy("root").agg(F.min("low").alias("component_id"))
    named = named.join(names, "root").select("k1", "k2", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n"), "component_id")
    out = rows.join(named, (rows.k1 == named.k1) & (rows.k2 == named.k2) & rows.v.isNotNull(), "left")
    discard(signs)
    return out.select(
        "vec_id",
        F.coalesce("n", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
