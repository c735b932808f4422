"""Operator 3: language identification by error-correcting output codes over hashed byte n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import hash_sample, held, small_batches

SIZE = 1 << 13
UNKNOWN = "und"


def features(text: str) -> np.ndarray:
    """Hellinger weights of the hashed 1- to 4-grams of a text's lower-cased UTF-8 bytes (whole text, in blocks)."""
    raw = np.frombuffer(f" {text.lower()} ".encode("utf-8", "replace"), np.uint8)
    counts = np.zeros(SIZE)
    for lo in range(0, len(raw), 1 << 20):
        b = raw[lo : lo + (1 << 20) + 3].astype(np.uint32)
        gram = np.zeros(len(b), np.uint32)
        for n in range(1, 5):
            if len(b) < n:
                break
            gram = gram[: len(b) - n + 1] * np.uint32(257) + b[n - 1 :]
            # a gram belongs to the block in which it starts
            own = gram[: 1 << 20] * np.uint32(2654435761) + np.uint32(n * 40503)
            counts += np.bincount((own ^ own >> np.uint32(15)) * np.uint32(2246822519) >> np.uint32(19), minlength=SIZE)
    return np.sqrt(counts / max(counts.sum(), 1)).astype(np.float32)


def codewords(languages: int, seed: int = 7) -> np.ndarray:
    """A codeword of +1 and -1 for each language.

    Up to five languages: every two-way split once. More: random words, the draw with the largest least distance.
    """
    if languages < 2:
        return np.ones((languages, 1))
    if languages <= 5:
        splits = range(1, 1 << (languages - 1))
        return np.array([[1.0 if l == languages - 1 or not s >> l & 1 else -1.0 for s in splits] for l in range(languages)])
    bits, rng, best, code = 4 * int(np.ceil(np.log2(languages))) + 7, np.random.default_rng(seed), -1, None
    for _ in range(200):
        draw = rng.choice([-1.0, 1.0], (languages, bits))
        apart = ((bits - draw @ draw.T) / 2 + bits * np.eye(languages)).min()
        if apart > best and (abs(draw.sum(axis=0)) < languages).all():
            best, code = apart, draw
    return code if code is not None else draw


@dataclass
class LanguageCodes:
    """Fitted bit classifiers, codewords, the weight of each bit and the softness of the decoder."""

    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    bit_weight: np.ndarray
    heat: float

    def losses(self, x: np.ndarray) -> np.ndarray:
        """Weighted logistic loss of every codeword for every row of features."""
        return self.decoded(x @ self.weights + self.bias)

    def decoded(self, margins: np.ndarray) -> np.ndarray:
        return np.stack([np.logaddexp(0, -margins * word) @ self.bit_weight for word in self.code], axis=1)

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the nearest codeword, its share of the softened decoding, and its lead over the second."""
        if len(self.languages) == 1:
            return np.zeros(len(x), int), np.ones(len(x)), np.ones(len(x))
        z = -self.losses(x) * self.heat
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        two = np.sort(p, axis=1)[:, -2:]
        return p.argmax(axis=1), two[:, 1], two[:, 1] - two[:, 0]


class Rows:
    """Features of many texts, kept as the places and values that are not zero."""

    def __init__(self, at: list[np.ndarray], value: list[np.ndarray]):
        self.at, self.value = at, value

    def __len__(self) -> int:
        return len(self.at)

    def parts(self, rows: np.ndarray, most: int = 128) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """A few rows at a time: their numbers and their dense features."""
        for lo in range(0, len(rows), most):
            own = rows[lo : lo + most]
            x = np.zeros((len(own), SIZE), np.float32)
            for k, row in enumerate(own):
                x[k, self.at[row]] = self.value[row]
            yield own, x


def _fit(x: Rows, y: np.ndarray, languages: list[str], steps: int = 60) -> LanguageCodes:
    """Fit one logistic classifier for each bit by Adam; a fifth of the rows weigh the bits and set the heat."""
    code = codewords(len(languages))
    tune, rest = np.arange(len(x) // 5), np.arange(len(x) // 5, len(x))  # the rows come in random order
    if len(x) < 100:
        tune = rest = np.arange(len(x))
    target = ((code[y] + 1) / 2).astype(np.float32)
    share = np.bincount(y[rest], minlength=len(languages)).astype(float)
    weight = (1 / np.maximum(share, 1))[y]
    weight = (weight / weight[rest].mean() / len(rest))[:, None].astype(np.float32)
    w, b = np.zeros((SIZE, code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    state = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(b), np.zeros_like(b)]
    for t in range(1, steps + 1):
        grads = [1e-6 * w, np.zeros_like(b)]
        for own, part in x.parts(rest):
            err = (1 / (1 + np.exp(-np.clip(part @ w + b, -30, 30))) - target[own]) * weight[own]
            grads[0] += part.T @ err
            grads[1] += err.sum(axis=0)
        for k, (p, g) in enumerate(zip((w, b), grads, strict=True)):
            m, v = state[2 * k], state[2 * k + 1]
            m += 0.1 * (g - m)
            v += 0.05 * (g * g - v)
            p -= 1.5 * m / (1 - 0.9**t) / (np.sqrt(v / (1 - 0.95**t)) + 1e-8) * (0.98**t)
    margins = np.concatenate([part @ w + b for _, part in x.parts(tune)])
    miss = np.clip(1 - ((margins > 0) == (target[tune] > 0.5)).mean(axis=0), 0.002, 0.45)
    bit_weight = np.log((1 - miss) / miss)
    model = LanguageCodes(languages, code, w, b, bit_weight / bit_weight.sum(), 1.0)
    loss = model.decoded(margins)
    heats = [0.5, 1, 2, 4, 8, 16]
    likely = [(-h * loss)[np.arange(len(loss)), y[tune]] - np.logaddexp.reduce(-h * loss, axis=1) for h in heats]
    model.heat = heats[int(np.argmax([p.mean() for p in likely]))]
    return model


def _sparse(languages: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held("language")
        for batch in batches:
            rows = [features(t or "") for t in batch["text"]]
            yield pd.DataFrame(
                {
                    "draw": batch["draw"],
                    "y": [languages.index(x) for x in batch["lang"]],
                    "at": [np.flatnonzero(x).astype("<u2").tobytes() for x in rows],
                    "value": [x[x > 0].astype("<f2").tobytes() for x in rows],
                }
            )

    return run


def train(docs: DataFrame, usable: Column | bool = True, max_rows: int = 4000, most_languages: int = 256) -> LanguageCodes | None:
    """Fit on ``max_rows`` labelled rows at most, as many for each language, chosen by hash of id and text.

    Rows count as labelled where ``lang`` is not null and ``usable`` holds. The ``most_languages`` languages with
    most rows are learned. Executors turn whole texts into sparse features, of 32 KB a row at most; the driver
    receives those of the sample, which Spark cuts to ``max_rows`` first, however often an id or a row repeats.
    None where nothing is labelled.
    """
    small_batches(docs.sparkSession)
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.lit(usable))
    sizes = dict(labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_languages).collect())
    if not sizes:
        return None
    each = max(1, max_rows // len(sizes))
    share = F.create_map(*(F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, each / n))))
    draw = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text")
    chosen = labelled.withColumn("draw", draw).where(hash_sample("draw", share[F.col("lang")])).select("lang", "text", "draw")
    languages = sorted(sizes)
    got = chosen.mapInPandas(_sparse(languages), "draw long, y int, at binary, value binary")
    got = got.orderBy(F.xxhash64("draw", F.lit(1)), "y").limit(max_rows).drop("draw").toPandas()
    order = np.random.default_rng(3).permutation(len(got))
    x = Rows(*([np.frombuffer(got[c].iloc[k], kind) for k in order] for c, kind in (("at", "<u2"), ("value", "<f2"))))
    return _fit(x, got["y"].to_numpy()[order], languages)


def labeller(model: LanguageCodes | None, least_lead: float = 0.2):
    """A column function of a text: struct of lang_pred, score (0 to 1) and ambiguous.

    Bit classifiers give margins, the loss-weighted decoder picks the nearest codeword; ``ambiguous`` marks a
    lead below ``least_lead``. Null text, empty text or no letters: ``und``, score 0. No model: ``und``.
    """

    @F.pandas_udf("struct<lang_pred: string, score: double, ambiguous: boolean>")
    def label(texts: pd.Series) -> pd.DataFrame:
        held("language")
        has = np.array([isinstance(t, str) and any(map(str.isalpha, t)) for t in texts], bool)
        best, score, lead = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts)), np.zeros(len(texts))
        own = np.flatnonzero(has) if model else np.array([], int)
        for lo in range(0, len(own), 64):
            part = own[lo : lo + 64]
            k, p, gap = model.predict(np.stack([features(texts.iloc[j]) for j in part]))
            best[part], score[part], lead[part] = np.array(model.languages, object)[k], p, gap
        return pd.DataFrame({"lang_pred": best, "score": score, "ambiguous": has & (lead < least_lead)})

    return label.asNondeterministic()  # evaluated once, not again for a filter


def identify(docs: DataFrame, model: LanguageCodes | None, least_lead: float = 0.2, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Add lang_pred, score and ambiguous (see ``labeller``) to the columns ``keep`` of every row."""
    small_batches(docs.sparkSession)
    own = labeller(model, least_lead)(F.col("text").cast("string")).alias("_own")
    return docs.select(*keep, own).select(*keep, "_own.lang_pred", "_own.score", "_own.ambiguous")
