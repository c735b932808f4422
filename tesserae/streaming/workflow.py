"""The review workflow as events: what is still valid, which stage a session reached, and the same for streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STAGES = ["profile", "recommendations", "selection", "assets", "material"]
# What a later version of each stage makes out of date.
DOWNSTREAM = {"profile": STAGES[1:], "recommendations": STAGES[2:], "selection": STAGES[3:], "assets": STAGES[4:], "material": []}


def valid_artifacts(events: DataFrame, session: str, stage: str, at: str, n: str) -> DataFrame:
    """The last event of each stage in a session, and whether something upstream came after it.

    ``at`` and ``n`` order events. Only maxima are kept, so rows combine before the shuffle.
    """
    last = events.where(F.col(stage).isin(STAGES)).groupBy(session, stage).agg(F.max(F.struct(at, n)).alias("_last"))
    wide = last.groupBy(session).agg(*(F.max(F.when(F.col(stage) == s, F.col("_last"))).alias(s) for s in STAGES))
    rows = []
    for k, s in enumerate(STAGES):
        above = [F.col(u) for u in STAGES[:k] if s in DOWNSTREAM[u]]
        stale = F.lit(False)
        for u in above:
            stale = stale | F.coalesce(u > F.col(s), F.lit(False))
        rows.append(F.struct(F.lit(s).alias("stage"), F.col(s)[at].alias("last_at"), (~stale).alias("valid")))
    return wide.select(session, F.inline(F.filter(F.array(*rows), lambda r: r["last_at"].isNotNull())))


def furthest_stage(valid: DataFrame, session: str) -> DataFrame:
    """The last stage of a session that is valid, with all before it valid as well; null if the first is not."""
    places = F.create_map(*(x for k, s in enumerate(STAGES) for x in (F.lit(s), F.lit(k))))
    good = F.array_sort(F.collect_set(F.when(F.col("valid"), places[F.col("stage")])))
    run = F.aggregate(good, F.lit(0), lambda n, k: F.when(k == n, n + 1).otherwise(n))
    own = valid.groupBy(session).agg(run.alias("_n"))
    return own.select(session, F.when(F.col("_n") > 0, F.element_at(F.array(*map(F.lit, STAGES)), F.col("_n"))).alias("furthest"))


STATE = "profile long, recommendations long, selection long, assets long, material long"


def streamed(events: DataFrame, session: str, stage: str, n: str) -> DataFrame:
    """The same fold for a stream: each batch gives (session, stage, valid) of the sessions that it touches.

    The state of a session is five numbers, the latest event of each stage.
    """

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last = list(state.get) if state.exists else [-1] * len(STAGES)
        for batch in batches:
            for s, k in zip(batch[stage], batch[n], strict=True):
                if s in STAGES:
                    at = STAGES.index(s)
                    last[at] = max(last[at], int(k))
        state.update(tuple(last))
        rows = [(key[0], s, all(last[STAGES.index(u)] <= last[k] for u in STAGES[:k] if s in DOWNSTREAM[u])) for k, s in enumerate(STAGES) if last[k] >= 0]
        yield pd.DataFrame(rows, columns=[session, "stage", "valid"])

    kind = events.schema[session].dataType.simpleString()
    return events.groupBy(session).applyInPandasWithState(fold, f"{session} {kind}, stage string, valid boolean", STATE, "update", "NoTimeout")
