"""Every registered query of the library proper against its DuckDB SQL on the smallest tables."""

from collections import Counter
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from tesserae.plans.catalog import QUERIES, SQL

TABLES = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(TABLES).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for p in Path(TABLES).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def rows(values) -> Counter:
    return Counter(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in values)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, con, name):
    df = QUERIES[name](spark, TABLES)
    cols = sorted(df.columns)
    want = con.execute(SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert rows([r[c] for c in cols] for r in df.collect()) == rows([r[k] for k in at] for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql(spark, name):
    df = QUERIES[name](spark, TABLES)
    assert df.count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 5
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_plans_prune_and_keep_few(spark):
    plan = QUERIES["dedup_anti"](spark, TABLES)._jdf.queryExecution().executedPlan().toString()
    assert "text" not in plan  # only the columns that are used are read
    plan = QUERIES["vector_topk"](spark, TABLES)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan
    plan = QUERIES["retrieval_many"](spark, TABLES)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2  # before the shuffle and after
    plan = QUERIES["vector_group_cap"](spark, TABLES)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_workspace_fold(spark):
    """Against the actions of each user one by one, on a small events table."""
    from tesserae.plans.reviews import workspace_actions
    from tesserae.streaming import workspace

    order, many = workspace.STEPS, TABLES.replace("0.001", "0.01")  # more actions a user

    def last(s):
        if s["assets"] is not None:
            return "material" if s["assets_confirmed"] else "assets"
        return "speeches" if s["recommendations"] else "profile" if s["profile"] else "input"

    def drop(s, level):
        if level == 0:
            s.update(profile_confirmed=False, recommendations=0)
        if level <= 1:
            s.update(selected=[])
        s.update(assets=None, assets_confirmed=False, material=False)

    def step(s, a):
        kind, had = a.kind, s["assets"] is not None or s["material"]
        if kind == "PROFILE_GENERATED":
            drop(s, 0)
            s.update(profile=True, pending=None, viewing="profile", notice=None, error=None)
        elif kind == "UPDATE_PROFILE_ITEM" and s["profile"]:
            if s["profile_confirmed"] or s["recommendations"] or s["selected"] or s["assets"] is not None:
                s["notice"] = "profile_changed"
            drop(s, 0)
            s.update(viewing="profile", error=None)
        elif kind == "CONFIRM_PROFILE":
            s.update(profile=True, profile_confirmed=True, notice=None, error=None) if a.n else s.update(error="empty_profile")
        elif kind == "RECOMMENDATIONS_LOADED":
            drop(s, 1)
            s.update(pending=None, recommendations=a.n, viewing="speeches", notice=None, error=None)
        elif kind == "TOGGLE_EVIDENCE":
            now = [c for c in s["selected"] if c != a.arg] if a.arg in s["selected"] else [*s["selected"], a.arg]
            if s["viewing"] in ("assets", "material") and (not now or had):
                s["viewing"] = "speeches"
            drop(s, 2)
            s.update(selected=now, error=None, notice="selection_changed" if had else s["notice"])
        elif kind == "ASSETS_LOADED":
            s.update(pending=None, error=None)
            if sorted(s["selected"]) == sorted(a.ids):
                s.update(assets=list(a["items"]), assets_confirmed=False, material=False, viewing="assets", notice=None)
            else:
                s["notice"] = "late_assets"
        elif kind in ("UPDATE_ASSET", "REMOVE_ASSET") and s["assets"] is not None:
            s.update(assets=[x for x in s["assets"] if kind == "UPDATE_ASSET" or x != a.arg], assets_confirmed=False, material=False, error=None)
        elif kind == "CONFIRM_ASSETS":
            if a.n and not a.incomplete:
                s.update(assets=list(a["items"]), assets_confirmed=True, viewing="material", notice=None, error=None)
            else:
                s["error"] = "incomplete_assets" if a.n else "no_assets"
        elif kind == "SET_SCENARIO":
            s.update(material=False, error=None)
        elif kind == "MATERIAL_LOADED":
            s.update(pending=None, material=True, error=None)
        elif kind == "SET_VIEWING" and order.index(a.arg) <= order.index(last(s)):
            s.update(viewing=a.arg, error=None)
        elif kind == "REQUEST":
            s.update(pending=a.arg, error=None)
        elif kind == "FAIL":
            s.update(pending=None, error=a.arg)
        elif kind == "CLEAR_ERROR":
            s["error"] = None

    users: dict = {}
    for a in sorted(workspace_actions(spark, many).collect(), key=lambda a: a.event_id):
        s = users.setdefault(a.user_id, {**dict.fromkeys(workspace.STATE), **workspace.START, "selected": []})
        step(s, a)
    got = QUERIES["workspace_fold"](spark, many).collect()
    assert len(got) == len(users)
    for r in got:
        want = users[r.user_id]
        want = {**want, "selected": ",".join(want["selected"]), "assets": None if want["assets"] is None else ",".join(want["assets"]), "furthest": last(want)}
        assert {k: r[k] for k in want} == want
    kinds = Counter(x for r in got for x in (r.notice, r.error, r.furthest))
    assert {"late_assets", "selection_changed", "assets"} <= set(kinds)
