"""Operator 12: whiten vectors by a covariance that is recovered exactly from variances of single and paired dimensions."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import held, small_batches, written
from tesserae.llm.vectors import stacked

#: Vectors are turned into whole numbers: floor(SCALE * entry) + SHIFT.
SCALE, SHIFT = 1024, 100_000
#: Whole numbers stay within this, so that 64 bits hold them.
LARGEST = 1 << 61
#: Bits of a sum that are added apart from the rest, so that no sum of any table overflows 38 digits.
LOW_BITS = 60
#: A component counts as empty below this share of the largest eigenvalue.
EMPTY = 1e-12


def complete(column: str):
    """True where a vector is neither null nor empty and holds no entry that is null or not finite."""
    x = F.col(column)
    whole = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(whole & (F.size(x) > 0), F.lit(False))


def whole_numbers(vectors: np.ndarray) -> np.ndarray:
    """Entries as 64-bit whole numbers; what is beyond LARGEST, at some 2e15, becomes LARGEST."""
    with np.errstate(over="ignore"):
        scaled = np.floor(vectors * SCALE)
    return np.clip(scaled, -float(LARGEST), float(LARGEST)).astype(np.int64) + SHIFT


def exact_sums(values: np.ndarray) -> list[int]:
    """Column sums without loss: in 64 bits where they fit, else with Python's whole numbers."""
    peak = max(int(values.max(initial=0)), -int(values.min(initial=0)))
    return [int(x) for x in (values if peak * len(values) < LARGEST else values.astype(object)).sum(axis=0)]


def square_sums(z: np.ndarray) -> list[int]:
    """Sums of squares of every dimension and then of every sum of two dimensions (i < j, row by row)."""
    peak = max(int(z.max(initial=0)), -int(z.min(initial=0)))
    if 4 * peak * peak * len(z) >= LARGEST:
        z = z.astype(object)
    out = [int(x) for x in (z * z).sum(axis=0)]
    for i in range(z.shape[1] - 1):
        both = z[:, i + 1 :] + z[:, i : i + 1]
        out += [int(x) for x in (both * both).sum(axis=0)]
    return out


def _summed(rows: DataFrame, sums) -> dict[int, int]:
    """Exact totals over all rows of what ``sums`` makes of a matrix: a row for each total and task, then one for each total."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held("whitening")
        total: list[int] = []
        for batch in filter(len, batches):
            own = sums(whole_numbers(stacked(batch["v"])))
            total = [a + b for a, b in zip(total, own, strict=True)] if total else own
        mask = (1 << LOW_BITS) - 1
        if total:
            yield pd.DataFrame({"k": range(len(total)), "hi": [str(x >> LOW_BITS) for x in total], "lo": [x & mask for x in total]})

    parts = rows.select("v").mapInPandas(partial, "k int, hi string, lo long")
    wide = parts.groupBy("k").agg(*(F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("hi", "lo")))
    return {r.k: (int(r.hi) << LOW_BITS) + int(r.lo) for r in wide.collect()}


class Whitening:
    """What is fitted: n rows, sums of every dimension, eigenvalues and components of the covariance."""

    def __init__(self, n: int, sums: list[int], squares: list[int]):
        """``squares`` are those of ``square_sums``, of the rows less ``centre``, over all rows."""
        d = len(sums)
        self.n, self.sums = n, sums
        self.centre = [s // n for s in sums]
        rest = [s - n * m for s, m in zip(sums, self.centre, strict=True)]  # sums that the whole-number centre leaves
        own = [n * q - r * r for q, r in zip(squares, rest, strict=False)]  # n * n * variance
        cov = np.zeros((d, d))
        at = d
        for i in range(d):
            cov[i, i] = Fraction(own[i], n * n)
            for j in range(i + 1, d):
                both = n * squares[at] - (rest[i] + rest[j]) ** 2
                cov[i, j] = cov[j, i] = Fraction(both - own[i] - own[j], 2 * n * n)
                at += 1
        self.covariance, self.rest = cov, rest
        values, vectors = np.linalg.eigh(cov)
        self.values = values[::-1]
        vectors = vectors[:, ::-1]
        self.components = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), range(d)] < 0, -1, 1)  # largest entry is positive

    def apply(self, x: np.ndarray, k: int) -> tuple[list[int], np.ndarray]:
        """For each row of whole numbers: the exact deviation and k whitened values, NaN for empty components."""
        z = x - np.array(self.centre, np.int64)
        peak = (max(int(z.max(initial=0)), -int(z.min(initial=0))) + 1) * self.n
        kind = np.int64 if peak < LARGEST else object
        y = self.n * z.astype(kind) - np.array(self.rest, kind)
        squared = (y if peak * peak * y.shape[1] < LARGEST else y.astype(object)) ** 2
        deviation = [int(v) for v in squared.sum(axis=1)]
        centred = (y / self.n).astype(np.float64)
        values = self.values[:k]
        with np.errstate(invalid="ignore", divide="ignore"):
            scale = np.where(values > EMPTY * max(self.values[0], 0), 1 / np.sqrt(values), np.nan)
        return deviation, centred @ self.components[:, :k] * scale


def fit(rows: DataFrame, n: int | None = None) -> Whitening | None:
    """The fitted whitening of a table with a column ``v`` of complete vectors of one length; None without rows.

    ``n`` is their number, where it is known.

    Two passes: sums, then squares of centred values for every dimension and pair sum. A covariance is half of what
    the variance of a sum exceeds those of its parts, in whole numbers until the last division. For d dimensions the
    driver and each task hold d * (d + 1) / 2 numbers, whatever the number of rows.
    """
    n = rows.count() if n is None else n
    if not n:
        return None
    sums = _summed(rows, exact_sums)
    sums = [sums[k] for k in range(len(sums))]
    centre = np.array([s // n for s in sums], np.int64)
    squares = _summed(rows, lambda x: square_sums(x - centre))
    return Whitening(n, sums, [squares[k] for k in range(len(squares))])


def _whitened(model: Whitening, k: int):
    def whitened(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held("whitening")
        for batch in filter(len, batches):
            deviation, values = model.apply(whole_numbers(stacked(batch["v"])), k)
            yield pd.DataFrame({"vec_id": batch["vec_id"], "deviation": [str(x) for x in deviation], "w": values.tolist()})

    return whitened


def _moments(k: int):
    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(k + k * k)
        for batch in filter(len, batches):
            w = np.nan_to_num(stacked(batch["w"]))
            total += np.concatenate([w.sum(axis=0), (w.T @ w).ravel()])
        yield pd.DataFrame({"k": range(len(total)), "x": total})

    return moments


def whiten(vectors: DataFrame, components: int = 8, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Whiten every complete vector: a row for each vector and component, up to ``components``.

    Returns vec_id, component (from 1, by falling eigenvalue), n, deviation (decimal: sum over dimensions of
    (n * x - S) squared, exact; null beyond 38 digits), whitened, explained (share of the eigenvalue in all
    variance) and identity_error (largest entry in which the covariance of the returned whitened values, read
    from all of them, differs from the identity).

    Vectors that are null or empty, or hold null or non-finite entries, give no rows and count nowhere; zero
    vectors count. Of vectors of several lengths the most frequent length counts, the shorter one on a tie, and
    the others are left out. Repeated ids and rows count each. Null ids stay null. Components without variance
    have null ``whitened`` and do not enter identity_error; with one row, or all rows equal, that is all of them,
    and ``explained`` is null. Equal eigenvalues come in the order of the solver. Entries beyond 2e15 are cut to
    it. An empty table gives no rows. Other columns are not read.
    """
    small_batches(vectors.sparkSession)
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v")).where(complete("v"))
    lengths = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    rows = rows.where(F.size("v") == (lengths[0].d if lengths else 0))
    model = fit(rows, lengths[0]["count"]) if lengths else None
    names = "vec_id, component, n, deviation, whitened, explained, identity_error"
    types = dict(zip(names.split(", "), [rows.schema["vec_id"].dataType.simpleString(), "int", "long", "decimal(38,0)", "double", "double", "double"], strict=True))
    if model is None:
        return spark.createDataFrame([], ", ".join(f"{k} {v}" for k, v in types.items()))
    k = min(components, lengths[0].d)
    schema = f"vec_id {types['vec_id']}, deviation string, w array<double>"
    own = written(rows.mapInPandas(_whitened(model, k), schema), "whitened")
    total = {r.k: r.x for r in own.select("w").mapInPandas(_moments(k), "k int, x double").groupBy("k").agg(F.sum("x").alias("x")).collect()}
    mean = np.array([total[i] for i in range(k)]) / model.n
    second = np.array([total[k + i] for i in range(k * k)]).reshape(k, k) / model.n
    full = model.values[:k] > EMPTY * max(model.values[0], 0)
    error = np.abs(second - np.outer(mean, mean) - np.eye(k))[np.ix_(full, full)].max() if full.any() else None
    spread = float(np.trace(model.covariance))
    explained = F.array(*(F.lit(float(x) / spread if spread else None).cast("double") for x in model.values[:k]))
    long = own.select("vec_id", "deviation", F.posexplode(F.arrays_zip("w", explained.alias("e"))).alias("at", "_own"))
    return long.select(
        "vec_id",
        (F.col("at") + 1).cast("int").alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        F.expr("try_cast(deviation AS decimal(38,0))").alias("deviation"),
        F.when(~F.isnan("_own.w"), F.col("_own.w")).alias("whitened"),
        F.col("_own.e").alias("explained"),
        F.lit(None if error is None else float(error)).cast("double").alias("identity_error"),
    )
