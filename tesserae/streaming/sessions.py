"""The review workspace with its content: profile items, assets and material, and what was done to them, by session."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.streaming.workspace import PROFILE_EDITS, STEPS

ITEM = "struct<dimension: string, id: string, value: string, text: string, origin: string, confidence: string>"
#: What an action may bring besides its kind. ``value`` is what the action says: a chunk, a step, a message, a title.
ACTION = {"dimension": "string", "id": "string", "value": "string", "text": "string", "ids": "array<string>", "items": f"array<{ITEM}>"}
CONTENT = {
    "description": "string", "profile": f"array<{ITEM}>", "profile_confirmed": "boolean", "recommendations": "array<string>", "selected": "array<string>",
    "assets": f"array<{ITEM}>", "assets_confirmed": "boolean", "scenario": "string", "requirements": "string", "material": "string", "viewing": "string",
    "pending": "string", "notice": "string", "error": "string", "furthest": "string",
}
START = {
    "description": "", "profile": None, "profile_confirmed": False, "recommendations": [], "selected": [], "assets": None, "assets_confirmed": False,
    "scenario": None, "requirements": "", "material": None, "viewing": "input", "pending": None, "notice": None, "error": None,
}
QUOTES = "【引用】"  # fixed value: an asset's own words end here

#: What goes when something above it changes.
NO_MATERIAL = {"material": None}
NO_ASSETS = {"assets": None, "assets_confirmed": False, **NO_MATERIAL}
NO_RECOMMENDATIONS = {"recommendations": [], "selected": [], **NO_ASSETS}


def furthest(s: dict) -> str:
    reached = [True, s["profile"] is not None, bool(s["recommendations"]), s["assets"] is not None, s["assets"] is not None and s["assets_confirmed"]]
    return STEPS[max(k for k, there in enumerate(reached) if there)]


def _edited(items: list[dict], a: dict, **change) -> list[dict]:
    same = lambda x: (x["dimension"], x["id"]) == (a["dimension"], a["id"])
    return [{**x, **change} if same(x) else x for x in items]


def _without(items: list[dict], a: dict) -> list[dict]:
    return [x for x in items if (x["dimension"], x["id"]) != (a["dimension"], a["id"])]


def _profile_edit(s: dict, a: dict) -> dict:
    if s["profile"] is None:
        return {}
    certain = {"origin": "explicit", "confidence": "high"}
    items = {
        "UPDATE_PROFILE_ITEM": lambda: _edited(s["profile"], a, value=a["value"], **certain),
        "ADD_PROFILE_ITEM": lambda: [*s["profile"], {"dimension": a["dimension"], "id": a["id"], "value": "", "text": None, **certain}],
        "REMOVE_PROFILE_ITEM": lambda: _without(s["profile"], a),
    }[a["kind"]]()
    below = s["profile_confirmed"] or s["recommendations"] or s["selected"] or s["assets"] is not None
    notice = "profile_changed" if below else s["notice"]
    return {"profile": items, "profile_confirmed": False, **NO_RECOMMENDATIONS, "viewing": "profile", "notice": notice, "error": None}


def _toggle(s: dict, a: dict) -> dict:
    chosen = [c for c in s["selected"] if c != a["value"]] if a["value"] in s["selected"] else [*s["selected"], a["value"]]
    had = s["assets"] is not None or s["material"] is not None
    back = s["viewing"] in STEPS[3:] and (had or not chosen)
    notice = "selection_changed" if had else s["notice"]
    return {"selected": chosen, **NO_ASSETS, "error": None, "notice": notice, "viewing": "speeches" if back else s["viewing"]}


def _assets(s: dict, a: dict) -> dict:
    if sorted(s["selected"]) != sorted(a["ids"]):
        return {"pending": None, "notice": "late_assets", "error": None}
    return {"pending": None, "assets": a["items"], "assets_confirmed": False, **NO_MATERIAL, "viewing": "assets", "notice": None, "error": None}


def _asset_edit(s: dict, a: dict) -> dict:
    if s["assets"] is None:
        return {}
    patch = {k: a[k] for k in ("value", "text") if a[k] is not None}
    items = _edited(s["assets"], a, **patch) if a["kind"] == "UPDATE_ASSET" else _without(s["assets"], a)
    return {"assets": items, "assets_confirmed": False, **NO_MATERIAL, "error": None}


def _confirm_assets(s: dict, a: dict) -> dict:
    own = lambda x: (x["text"] or "").split(QUOTES)[0].strip()
    if not a["items"]:
        return {"error": "no_assets"}
    if any(not (x["value"] or "").strip() or not own(x) for x in a["items"]):
        return {"error": "incomplete_assets"}
    return {"assets": a["items"], "assets_confirmed": True, "viewing": "material", "notice": None, "error": None}


def _confirm_profile(s: dict, a: dict) -> dict:
    return {"profile": a["items"], "profile_confirmed": True, "notice": None, "error": None} if a["items"] else {"error": "empty_profile"}


def _view(s: dict, a: dict) -> dict:
    near = a["value"] in STEPS and STEPS.index(a["value"]) <= STEPS.index(furthest(s))
    return {"viewing": a["value"], "error": None} if near else {}


#: For each kind of action what it changes, from the state before it; kinds that are not here change nothing.
CHANGES: dict[str, Callable[[dict, dict], dict]] = {
    "SET_DESCRIPTION": lambda s, a: {"description": a["value"] or "", "error": None},
    "REQUEST": lambda s, a: {"pending": a["value"], "error": None},
    "FAIL": lambda s, a: {"pending": None, "error": a["value"]},
    "CLEAR_ERROR": lambda s, a: {"error": None},
    "CLEAR_NOTICE": lambda s, a: {"notice": None},
    "PROFILE_GENERATED": lambda s, a: {
        "pending": None, "profile": a["items"], "profile_confirmed": False, **NO_RECOMMENDATIONS, "viewing": "profile", "notice": None, "error": None,
    },
    **dict.fromkeys(PROFILE_EDITS, _profile_edit),
    "CONFIRM_PROFILE": _confirm_profile,
    "RECOMMENDATIONS_LOADED": lambda s, a: {
        "pending": None, "recommendations": a["ids"], "selected": [], **NO_ASSETS, "viewing": "speeches", "notice": None, "error": None,
    },
    "TOGGLE_EVIDENCE": _toggle,
    "ASSETS_LOADED": _assets,
    "UPDATE_ASSET": _asset_edit,
    "REMOVE_ASSET": _asset_edit,
    "CONFIRM_ASSETS": _confirm_assets,
    "SET_SCENARIO": lambda s, a: {"scenario": a["value"], **NO_MATERIAL, "error": None},
    "SET_REQUIREMENTS": lambda s, a: {"requirements": a["value"] or "", **NO_MATERIAL, "error": None},
    "MATERIAL_LOADED": lambda s, a: {"pending": None, "material": a["text"] or "", "error": None},
    "SET_VIEWING": _view,
}


def after(state: dict, action: dict) -> dict:
    """The state after one action; a list that an action lacks is empty."""
    a = {**action, "ids": list(action["ids"]) if action["ids"] is not None else [], "items": [dict(x) for x in action["items"]] if action["items"] is not None else []}
    change = CHANGES.get(a["kind"])
    return {**state, **change(state, a)} if change else state


def _actions(frame: pd.DataFrame) -> Iterator[dict]:
    names = ["kind", *ACTION]
    for row in frame[names].astype(object).where(frame[names].notna(), None).itertuples(index=False, name=None):
        yield dict(zip(names, row, strict=True))


def _row(s: dict) -> list:
    return [furthest(s) if k == "furthest" else s[k] for k in CONTENT]


def _schema(actions: DataFrame, session: str) -> str:
    return f"{session} {actions.schema[session].dataType.simpleString()}, " + ", ".join(f"{k} {v}" for k, v in CONTENT.items())


def folded(actions: DataFrame, session: str, order: str) -> DataFrame:
    """The workspace of each session after all its actions in ``order``: session, the fields of CONTENT.

    ``actions`` has kind and the columns of ACTION. Sessions are sorted by Spark and read through one at a time, so
    a task holds one state and one Arrow batch however long a session is. Actions of equal order go by kind and
    value; a null session is one of its own; unknown kinds change nothing. An empty table gives no rows.
    """
    names = [session, *CONTENT]

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, key, begun = dict(START), None, False
        for batch in batches:
            done = []
            keys = batch[session].astype(object).where(batch[session].notna(), None)
            for own, a in zip(keys, _actions(batch), strict=True):
                if begun and own != key:
                    done.append([key, *_row(now)])
                    now = dict(START)
                now, key, begun = after(now, a), own, True
            if done:
                yield pd.DataFrame(done, columns=names).astype(object)
        if begun:
            yield pd.DataFrame([[key, *_row(now)]], columns=names).astype(object)

    rows = actions.select(session, order, "kind", *ACTION).repartition(session).sortWithinPartitions(session, order, "kind", "value")
    return rows.mapInPandas(fold, _schema(actions, session))


def streamed(actions: DataFrame, session: str, order: str) -> DataFrame:
    """The same for a stream: each batch gives the workspaces of the sessions that it touches, as they now stand.

    The state is the workspace as JSON, whose size is that of one review. Actions are taken in ``order`` within a
    batch, so later batches must hold later actions of a session.
    """
    names = [session, *CONTENT]

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        now = json.loads(state.get[0]) if state.exists else dict(START)
        for a in _actions(pd.concat(list(batches)).sort_values([order, "kind", "value"], kind="stable")):
            now = after(now, a)
        state.update((json.dumps(now),))
        yield pd.DataFrame([[key[0], *_row(now)]], columns=names).astype(object)

    own = actions.select(session, order, "kind", *ACTION)
    return own.groupBy(session).applyInPandasWithState(fold, _schema(actions, session), "state string", "update", "NoTimeout")


def selected_refs(workspaces: DataFrame, recommendations: DataFrame, session: str, chunk_id: str) -> DataFrame:
    """The recommendations that each session has selected, in an equi-join of its recommended and selected chunks."""
    chosen = workspaces.select(session, F.explode(F.array_intersect("recommendations", "selected")).alias(chunk_id))
    return recommendations.join(chosen, [session, chunk_id], "left_semi")
