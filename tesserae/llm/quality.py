"""Operator 4: document quality from a linear-chain conditional random field over lines."""

from __future__ import annotations

import math
import operator
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import hash_sample, small_batches

#: Measures of a line; each falls into one of BINS bins, and so do those of the lines before and after it.
MEASURES = ["words", "word_length", "distinct", "same_as_next", "upper", "digits", "marks", "odd_words", "pipes", "starts_upper", "stop", "accents"]
BINS = 8
SLOTS = 3 * len(MEASURES) + 2
PART, CELLS = 1 << 15, 1 << 17  # lines that are measured, and padded places of chains that are followed, at once


def _measure(line: str) -> tuple[float, ...]:
    """Measures of one line, each from 0 to 1."""
    words = line.split()
    n = len(words)
    if not n:
        return (0.0,) * len(MEASURES)
    joined = "".join(words)
    size = len(joined)
    whole = list(filter(str.isalpha, [w.strip(".,;:'\"()-?") for w in words]))
    digits = sum(map(joined.count, "0123456789")) / size
    return (
        min(math.log1p(n) / 7, 1.0),
        min(size / n / 16, 1.0),
        len(set(words)) / n,
        sum(map(operator.eq, words, words[1:])) / max(n - 1, 1),
        sum(map(str.isupper, words)) / n,
        digits,
        max(1 - sum(map(len, whole)) / size - digits, 0.0),
        1 - len(whole) / n,
        min(joined.count("|") / n, 1.0),
        sum(map(str.istitle, words)) / n,
        min(joined.count(".") / n, 1.0),
        min(len(joined.encode("utf-8", "replace")) / size - 1, 1.0),
    )


def line_table(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Slot numbers (lines x SLOTS) and lengths of the lines of a whole text. Every text has a line at least."""
    lines = text.split("\n")
    bins = np.full((len(lines) + 2, len(MEASURES)), BINS, np.int16)  # the rows at both ends: no neighbour there
    for lo in range(0, len(lines), PART):
        part = lines[lo : lo + PART]
        seen = {x: _measure(x) for x in dict.fromkeys(part)}
        own = np.array([seen[x] for x in part])
        bins[lo + 1 : lo + 1 + len(part)] = np.minimum((own * BINS).astype(np.int16), BINS - 1)
    again = np.fromiter((x == y for x, y in zip(lines, lines[1:], strict=False)), bool, len(lines) - 1)
    around = [bins[1:-1], bins[:-2], bins[2:], np.r_[again, False][:, None], np.r_[False, again][:, None]]
    slots = np.hstack(around).astype(np.int16)
    slots += (np.arange(SLOTS) * (BINS + 1)).astype(np.int16)
    return slots, np.array([len(x) + 1 for x in lines], float)


def _alike(lengths: list[int], most: int = 256) -> Iterator[list[int]]:
    """Numbers of chains of like length, ``most`` at a time and no more than CELLS places when padded."""
    part: list[int] = []
    for k in sorted(range(len(lengths)), key=lengths.__getitem__):
        if part and (len(part) == most or (len(part) + 1) * lengths[k] > CELLS):
            yield part
            part = []
        part.append(k)
    if part:
        yield part


@dataclass
class LineField:
    """Slot weights (good against bad), transition scores, and the map from marginals to a document's score."""

    weights: np.ndarray
    turn: np.ndarray
    slope: np.ndarray
    level: float

    def unary(self, table: np.ndarray) -> np.ndarray:
        """Good against bad for each line by itself."""
        return np.concatenate([self.weights[table[lo : lo + PART]].sum(axis=1) for lo in range(0, len(table), PART)])

    def marginals(self, tables: list[np.ndarray]) -> list[np.ndarray]:
        """P(line is good) by forward-backward."""
        return self.chained([self.unary(x) for x in tables])

    def chained(self, unary: list[np.ndarray]) -> list[np.ndarray]:
        out: list[np.ndarray] = [np.zeros(0)] * len(unary)
        for part in _alike(list(map(len, unary))):
            good, _, _ = _chain([unary[k] for k in part], self.turn)
            for k, p in zip(part, good, strict=True):
                out[k] = p.copy()
        return out

    def scores(self, unary: list[np.ndarray], sizes: list[np.ndarray]) -> np.ndarray:
        """The document's score: length-weighted marginals, through a fitted logistic curve."""
        return 1 / (1 + np.exp(-np.clip(aggregate(self.chained(unary), sizes) @ self.slope + self.level, -30, 30)))


def aggregate(marginals: list[np.ndarray], sizes: list[np.ndarray]) -> np.ndarray:
    """Length-weighted mean of the marginals, its log-odds, and the share of text in lines that are likely bad."""
    mean = np.array([p @ s / s.sum() for p, s in zip(marginals, sizes, strict=True)])
    bad = np.array([(s * (p < 0.5)).sum() / s.sum() for p, s in zip(marginals, sizes, strict=True)])
    odds = np.log(np.clip(mean, 1e-4, 1 - 1e-4) / np.clip(1 - mean, 1e-4, 1 - 1e-4))
    return np.stack([mean, odds / 4, bad], axis=1)


def _chain(unary: list[np.ndarray], turn: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Forward-backward over padded chains of two states (0 bad, 1 good): marginals, expected turns, log Z."""
    docs, longest = len(unary), max(map(len, unary))
    n = np.array(list(map(len, unary)))
    u = np.zeros((longest, docs, 2))
    for k, x in enumerate(unary):
        u[: len(x), k, 1] = x
    live = np.arange(longest)[:, None] < n
    ahead, back = np.zeros_like(u), np.zeros_like(u)
    ahead[0] = u[0]
    for t in range(1, longest):
        step = np.logaddexp(ahead[t - 1, :, :1] + turn[0], ahead[t - 1, :, 1:] + turn[1]) + u[t]
        ahead[t] = np.where(live[t][:, None], step, ahead[t - 1])
    for t in range(longest - 2, -1, -1):
        step = back[t + 1] + u[t + 1]
        step = np.logaddexp(turn[:, 0] + step[:, :1], turn[:, 1] + step[:, 1:])
        back[t] = np.where(live[t + 1][:, None], step, 0.0)
    z = np.logaddexp(ahead[-1, :, 0], ahead[-1, :, 1])
    p = np.exp(np.minimum(ahead[:, :, 1] + back[:, :, 1] - z, 0.0))
    pairs = np.zeros((2, 2))
    if longest > 1:
        for a in range(2):
            for b in range(2):
                joint = ahead[:-1, :, a] + turn[a, b] + u[1:, :, b] + back[1:, :, b] - z
                pairs[a, b] = np.exp(np.minimum(joint, 0.0))[live[1:]].sum()
    return [p[: n[k], k] for k in range(docs)], pairs, z


def _fit_field(tables: list[np.ndarray], labels: list[np.ndarray], heavy: list[np.ndarray], steps: int, seed: tuple) -> tuple:
    """Gradient ascent on the conditional likelihood of line labels; ``heavy`` weighs each line's unary part."""
    weights, turn = seed
    size = SLOTS * (BINS + 1)
    m, v = np.zeros(size + 4), np.zeros(size + 4)
    flat, y = np.concatenate(tables), np.concatenate(labels)
    h = np.concatenate(heavy)
    want = np.zeros((2, 2))
    for x in labels:
        np.add.at(want, (x[:-1], x[1:]), 1.0)
    together = list(_alike(list(map(len, tables))))
    starts = np.concatenate([[0], np.cumsum([len(x) for x in tables])])
    total = len(y)
    for t in range(1, steps + 1):
        unary, p, pairs = weights[flat].sum(axis=1), np.zeros(total), np.zeros((2, 2))
        for part in together:
            good, own, _ = _chain([unary[starts[k] : starts[k + 1]] for k in part], turn)
            pairs += own
            for k, x in zip(part, good, strict=True):
                p[starts[k] : starts[k + 1]] = x
        err = (y - p) * h
        grad = np.bincount(flat.ravel(), np.repeat(err, SLOTS), size) - 0.5 * weights
        g = np.concatenate([grad, (want - pairs).ravel() - 5 * turn.ravel()]) / total
        m += 0.1 * (g - m)
        v += 0.02 * (g * g - v)
        step = 0.1 * m / (1 - 0.9**t) / (np.sqrt(v / (1 - 0.98**t)) + 1e-8) * 0.97**t
        weights, turn = weights + step[:size], turn + step[size:].reshape(2, 2)
    return weights, turn


def fit(texts: list[str], labels: np.ndarray, rounds: int = 3) -> LineField:
    """Fit the field from document labels.

    Lines start with their document's label. After each round a line of a bad document that looks good takes
    that label, but the worst line of a bad document stays bad. At the end a logistic curve maps the aggregate
    of the marginals to the share of good documents.
    """
    tables, sizes = map(list, zip(*map(line_table, texts), strict=True))
    share = max(labels.mean(), 1e-3), max(1 - labels.mean(), 1e-3)
    heavy = [np.full(len(t), 0.5 / share[0] if y else 0.5 / share[1]) for t, y in zip(tables, labels, strict=True)]
    lines = [np.full(len(t), int(y)) for t, y in zip(tables, labels, strict=True)]
    weights, turn = np.zeros(SLOTS * (BINS + 1)), np.zeros((2, 2))
    for k in range(rounds):
        weights, turn = _fit_field(tables, lines, heavy, 40 if k == 0 else 20, (weights, turn))
        good = LineField(weights, turn, np.zeros(3), 0.0).marginals(tables)
        for d in np.flatnonzero(labels == 0):
            lines[d] = (good[d] > 0.6).astype(int)
            lines[d][np.argmin(good[d])] = 0
    field = LineField(weights, turn, np.array([0.0, 4.0, 0.0]), 0.0)
    x, y = aggregate(field.marginals(tables), sizes), labels.astype(float)
    slope, level = np.zeros(3), float(np.log(share[0] / share[1]))
    for _ in range(60):  # Newton's method with a small ridge
        p = 1 / (1 + np.exp(-np.clip(x @ slope + level, -30, 30)))
        xx = np.hstack([x, np.ones((len(x), 1))])
        ridge = np.diag([0.1, 0.1, 0.1, 1e-6])
        g = xx.T @ (y - p) - ridge @ np.append(slope, level)
        h = (xx * (p * (1 - p))[:, None]).T @ xx + ridge + 1e-9 * np.eye(4)
        move = np.clip(np.linalg.solve(h, g), -2, 2)
        slope, level = slope + move[:3], level + move[3]
    field.slope, field.level = slope, float(level)
    return field


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 3000, max_chars: int = 20_000) -> LineField | None:
    """Fit on ``max_rows`` labelled documents at most, chosen by hash, half of them bad where possible.

    The sample leaves out texts over ``max_chars``, which bounds what the driver receives to the product of
    both, however often an id repeats. Documents come in through ``doc_id``; rows of ``labels`` without a match, nulls and repeats do nothing.
    None where there is no label of one of the two kinds.
    """
    known = labels.where("doc_id is not null and label in (0, 1)").groupBy("doc_id").agg(F.max("label").alias("label"))
    light = docs.select("doc_id").join(known, "doc_id")
    sizes = dict(light.groupBy("label").count().collect())
    share = F.create_map(*(F.lit(x) for y in (0, 1) for x in (y, min(1.0, max_rows / 2 / max(sizes.get(y, 0), 1)))))
    chosen = light.where(hash_sample("doc_id", share[F.col("label").cast("int")])).distinct()  # about max_rows rows
    rows = docs.select("doc_id", "text").where(F.length("text") <= max_chars).join(F.broadcast(chosen), "doc_id")
    got = rows.orderBy(F.xxhash64("doc_id", "text"), "label").limit(max_rows).select("text", "label").toPandas()
    y = got["label"].to_numpy()
    if len(set(y)) < 2:
        return None
    return _with_prior(fit(list(got["text"]), y), y.mean(), sizes)


def _with_prior(field: LineField, sampled: float, sizes: dict[int, int]) -> LineField:
    """Move the level from the sample's share of good documents to that of all labelled ones."""
    share = min(max(sizes.get(1, 0) / sum(sizes.values()), 1e-3), 1 - 1e-3)
    field.level += float(np.log(share / (1 - share)) - np.log(sampled / (1 - sampled)))
    return field


def scorer(field: LineField | None):
    """A column function of a text: its score from 0 to 1.

    Null and empty texts are one empty line and are scored as such. Long texts are measured a part at a time; what
    stays of a line is 16 bytes, and a chain takes about 100 bytes a line while it is followed. Without a field every score is 0.5.
    """

    @F.pandas_udf("double")
    def own(texts: pd.Series) -> pd.Series:
        out, unary, sizes, lines = np.full(len(texts), 0.5), [], [], 0
        for k, text in enumerate(texts if field else ()):
            table, size = line_table(text or "")
            unary.append(field.unary(table))
            sizes.append(size)
            lines += len(size)
            if len(unary) == 1024 or lines > 1 << 18 or k == len(texts) - 1:
                out[k + 1 - len(unary) : k + 1] = field.scores(unary, sizes)
                unary, sizes, lines = [], [], 0
        return pd.Series(out)

    return own.asNondeterministic()  # evaluated once, not again for a filter


def score(docs: DataFrame, field: LineField | None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Add ``score`` (0 to 1, higher: better) to the columns ``keep`` of every row, from its whole text."""
    small_batches(docs.sparkSession)
    return docs.select(*keep, scorer(field)(F.col("text").cast("string")).alias("score"))
