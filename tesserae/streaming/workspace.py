"""The review workspace as a fold over a session's actions: what is there, what is shown, and what was refused."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The steps in order, and the kinds of actions that change the profile, an asset or the task.
STEPS = ["input", "profile", "speeches", "assets", "material"]
PROFILE_EDITS = ["UPDATE_PROFILE_ITEM", "ADD_PROFILE_ITEM", "REMOVE_PROFILE_ITEM"]
ASSET_EDITS, TASK_EDITS = ["UPDATE_ASSET", "REMOVE_ASSET"], ["SET_SCENARIO", "SET_REQUIREMENTS"]

STATE = {
    "profile": "boolean", "profile_confirmed": "boolean", "recommendations": "int", "selected": "array<string>", "assets": "array<string>",
    "assets_confirmed": "boolean", "material": "boolean", "viewing": "string", "pending": "string", "notice": "string", "error": "string",
}
START = {"profile": False, "profile_confirmed": False, "recommendations": 0, "assets_confirmed": False, "material": False, "viewing": "input"}


def furthest(state: Column) -> Column:
    """The last step that a workspace has reached."""
    there = F.when(state["assets"].isNotNull(), F.when(state["assets_confirmed"], "material").otherwise("assets"))
    return F.coalesce(there, F.when(state["recommendations"] > 0, "speeches").when(state["profile"], "profile").otherwise("input"))


# What a workflow declares of its progress, in order.
WORKFLOW_STAGES = [
    "PROFILE_DRAFT", "PROFILE_CONFIRMED", "RECOMMENDATIONS_READY", "SPEECHES_SELECTED", "ASSETS_DRAFT", "ASSETS_CONFIRMED", "SCENARIO_DEFINED", "MATERIAL_READY",
]


def workflow_stage(state: Column, scenario: Column | None = None) -> Column:
    """The last declared stage that a workspace has reached with all before it; null before there is a profile."""
    chosen = scenario if scenario is not None else F.when(state["material"], "one")
    reached = [
        state["profile"], state["profile_confirmed"], state["recommendations"] > 0, F.size(state["selected"]) > 0, state["assets"].isNotNull(), state["assets_confirmed"],
        chosen.isNotNull(), state["material"],
    ]
    out, so_far = F.lit(None).cast("string"), F.lit(True)
    for name, there in zip(WORKFLOW_STAGES, reached, strict=True):
        so_far = so_far & F.coalesce(there, F.lit(False))
        out = F.when(so_far, F.lit(name)).otherwise(out)
    return out


def can_view(state: Column, step: Column) -> Column:
    order = F.array(*map(F.lit, STEPS))
    return F.array_position(order, step) <= F.array_position(order, furthest(state))


def done(state: Column, step: str) -> Column:
    """Whether a step is finished."""
    kinds = {
        "input": state["profile"], "profile": state["profile_confirmed"], "speeches": F.size(state["selected"]) > 0,
        "assets": state["assets_confirmed"], "material": state["material"],
    }
    return kinds[step]


def _after(s: Column, a: Column) -> Column:
    """The state after one action: for each field, the first rule that holds; a field without one stays."""
    kind, arg, n = a["kind"], a["arg"], F.coalesce(a["n"], F.lit(0))
    is_ = lambda *kinds: kind.isin(*kinds)
    edit, made, listed = is_(*PROFILE_EDITS) & s["profile"], is_("PROFILE_GENERATED"), is_("RECOMMENDATIONS_LOADED")
    toggle, touched, task = is_("TOGGLE_EVIDENCE"), is_(*ASSET_EDITS) & s["assets"].isNotNull(), is_(*TASK_EDITS)
    # an answer counts only for the selection that it was asked for, in whatever order
    asked = F.array_sort(s["selected"]) == F.array_sort(F.coalesce(a["ids"], F.array().cast("array<string>")))
    loaded, late = is_("ASSETS_LOADED") & asked, is_("ASSETS_LOADED") & ~asked
    good_profile, empty_profile = is_("CONFIRM_PROFILE") & (n > 0), is_("CONFIRM_PROFILE") & (n == 0)
    gaps = F.coalesce(a["incomplete"], F.lit(False))
    no_assets, gap_assets = is_("CONFIRM_ASSETS") & (n == 0), is_("CONFIRM_ASSETS") & (n > 0) & gaps
    good_assets, written = is_("CONFIRM_ASSETS") & (n > 0) & ~gaps, is_("MATERIAL_LOADED")
    shown = is_("SET_VIEWING") & can_view(s, arg)
    no = F.lit(None).cast("string")
    empty = F.array().cast("array<string>")
    chosen = F.when(F.array_contains(s["selected"], arg), F.array_remove(s["selected"], arg)).otherwise(F.array_append(s["selected"], arg))
    had = s["assets"].isNotNull() | s["material"]
    below = s["profile_confirmed"] | (s["recommendations"] > 0) | (F.size(s["selected"]) > 0) | s["assets"].isNotNull()
    back = toggle & s["viewing"].isin("assets", "material") & (had | (F.size(chosen) == 0))
    restart = made | edit
    rules = {
        "profile": [(made | good_profile, F.lit(True))],
        "profile_confirmed": [(restart, F.lit(False)), (good_profile, F.lit(True))],
        "recommendations": [(restart, F.lit(0)), (listed, n)],
        "selected": [(restart | listed, empty), (toggle, chosen)],
        "assets": [(restart | listed | toggle, F.lit(None).cast("array<string>")), (loaded, a["items"]), (touched & is_("REMOVE_ASSET"), F.array_remove(s["assets"], arg)), (good_assets & a["items"].isNotNull(), a["items"])],
        "assets_confirmed": [(restart | listed | toggle | loaded | touched, F.lit(False)), (good_assets, F.lit(True))],
        "material": [(restart | listed | toggle | loaded | touched | task, F.lit(False)), (written, F.lit(True))],
        "viewing": [(restart, F.lit("profile")), (listed | back, F.lit("speeches")), (loaded, F.lit("assets")), (good_assets, F.lit("material")), (shown, arg)],
        "pending": [(is_("REQUEST"), arg), (is_("FAIL", "ASSETS_LOADED") | made | listed | written, no)],
        "notice": [
            (is_("CLEAR_NOTICE") | made | good_profile | listed | loaded | good_assets, no), (edit & below, F.lit("profile_changed")),
            (toggle & had, F.lit("selection_changed")), (late, F.lit("late_assets")),
        ],
        "error": [
            (is_("FAIL"), arg), (empty_profile, F.lit("empty_profile")), (no_assets, F.lit("no_assets")), (gap_assets, F.lit("incomplete_assets")),
            (is_("SET_DESCRIPTION", "REQUEST", "CLEAR_ERROR", "ASSETS_LOADED") | restart | good_profile | listed | toggle | touched | good_assets | task | written | shown, no),
        ],
    }

    def field(name: str) -> Column:
        out = F.when(rules[name][0][0], rules[name][0][1])
        for holds, value in rules[name][1:]:
            out = out.when(holds, value)
        return out.otherwise(s[name]).cast(STATE[name]).alias(name)

    return F.struct(*map(field, STATE))


def workspaces(actions: DataFrame, session: str, order: str) -> DataFrame:
    """The workspace of each session after its actions in ``order``: session and the fields of ``STATE``.

    ``actions`` has kind, arg (a chunk, an asset, a step, a message or a request), ids (the chunks that an answer was
    asked for), items (asset ids of an answer), n (how many items it confirms or brings) and incomplete. What is a
    refused confirmation, or an answer to an older selection, leaves a message and changes nothing else; a confirmation
    that holds stores the assets it brings. ``sessions`` keeps the content as well. A session is
    one person's review, so its actions are held in one row. An empty table gives no rows.
    """
    fields = ["kind", "arg", "ids", "items", "n", "incomplete"]
    own = actions.groupBy(session).agg(F.array_sort(F.collect_list(F.struct(order, *fields))).alias("_a"))
    first = {**{k: F.lit(v) for k, v in START.items()}, "selected": F.array()}
    start = F.struct(*(first.get(k, F.lit(None)).cast(kind).alias(k) for k, kind in STATE.items()))
    return own.select(session, F.aggregate("_a", start, _after).alias("state")).select(session, "state.*", furthest(F.col("state")).alias("furthest"))
