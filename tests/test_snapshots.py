"""Changes and versions against a brute-force walk over loads, and every edge case that the docstrings name."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from conftest import rows
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from larkspur.functions.tokens import phase_set, phase_text, token, whole
from larkspur.operators import snapshots as S

START = datetime(2025, 1, 1)
LOADS = [(i, START + timedelta(days=30 * i), START + timedelta(days=30 * i + 1)) for i in range(1, 5)]
ROW = "id long, nct_id string, company_ticker string, status string, fetched_at timestamp_ntz, load_id string, entity string, seq string"
LOG = "load_id int, company_ticker string, feed string, outcome string"


def at(load: int, hours: int = 1) -> datetime:
    return START + timedelta(days=30 * load, hours=hours)


def frames(spark, data, failed=()):
    """Rows (id, item, entity, status, time) with extra columns whose names clash with the operator's own."""
    loads = spark.createDataFrame(LOADS, "load_id int, started_at timestamp_ntz, finished_at timestamp_ntz")
    log = spark.createDataFrame([(k, e, "registry", "failed") for k, e in failed], LOG)
    t = spark.createDataFrame([(*d, "x", "y", "z") for d in data], ROW)
    return t, loads, log


def build(spark, data, failed=(), by_key=False):
    t, loads, log = frames(spark, data, failed)
    return S.states(t, loads, log, "registry", F.col("nct_id"), [token(F.col("status")).alias("status")], by_key=by_key), loads


def brute(data, failed):
    """State per load and key by walking the loads in order."""
    state, before = {}, {}
    for k in range(1, 5):
        now = {}
        for i, item, e, status, t in data:
            inside = t is not None and t >= at(k, 0) and (k == 4 or t < at(k + 1, 0))
            if inside and e is not None and item is not None:
                value = None if status is None else "_".join("".join(c if c.isalnum() else " " for c in status.upper()).split())
                now[(e, item)] = max(now.get((e, item), (datetime.min, -1, "")), (t, i, value), key=lambda x: (x[0], x[1]))
        bad = {e for f, e in failed if f == k}
        now = {x: v for x, v in now.items() if x[0] not in bad} | {x: v for x, v in before.items() if x[0] in bad}
        state[k] = before = now
    return {k: {x: v[2] for x, v in s.items()} for k, s in state.items()}


def expected_changes(state):
    out = []
    for k in range(2, 5):
        a, b = state[k - 1], state[k]
        for x in a.keys() | b.keys():
            kind = "added" if x not in a else "removed" if x not in b else "changed" if a[x] != b[x] else None
            if kind:
                out.append((k, *x, kind))
    return sorted(out, key=repr)


def expected_versions(state):
    out, open_ = [], {}
    for k in range(1, 6):
        now = state.get(k, {})
        for x in list(open_):
            if x not in now or now[x] != open_[x][1]:
                out.append((*x, open_[x][0], k - 1, open_[x][1]))
                del open_[x]
        for x, v in now.items():
            open_.setdefault(x, (k, v))
    return sorted(out, key=repr)


record = st.tuples(
    st.sampled_from(["N1", "N2", None]), st.sampled_from(["A", "B", None]), st.sampled_from(["Recruiting", "RECRUITING", "done", None, ""]),
    st.one_of(st.none(), st.builds(at, st.integers(0, 5), st.integers(0, 3))),
)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(record, max_size=25), st.sets(st.tuples(st.integers(1, 4), st.sampled_from(["A", "B"])), max_size=4))
def test_changes_and_versions_equal_a_walk_over_loads(spark, records, failed):
    data = [(i, *r) for i, r in enumerate(records)]
    state = brute(data, failed)
    got, loads = build(spark, data, failed)
    assert rows(S.changes(got, loads, ["status"])) == expected_changes(state)
    got, loads = build(spark, data, failed, by_key=True)
    assert rows(S.versions(got, loads, ["status"])) == expected_versions(state)


def test_failed_first_load_has_no_state_and_runs_of_failures_carry_on(spark):
    data = [(1, "N1", "A", "x", at(1)), (2, "N1", "A", "y", at(2)), (3, "N1", "A", "z", at(4))]
    got, loads = build(spark, data, [(1, "A"), (3, "A"), (4, "A")])
    assert rows(S.versions(got, loads, ["status"])) == [("A", "N1", 2, 4, "Y")]


def test_repeated_rows_and_equal_times(spark):
    data = [(1, "N1", "A", "x", at(1)), (5, "N1", "A", "y", at(1)), (5, "N1", "A", "y", at(1)), (3, "N1", "A", "z", at(1))]
    got, _ = build(spark, data)
    assert rows(got) == [("A", "N1", 1, "Y")]


def test_empty_tables(spark):
    got, loads = build(spark, [])
    assert rows(S.changes(got, loads, ["status"])) == [] and rows(S.versions(got, loads, ["status"])) == []
    t, loads, log = frames(spark, [(1, "N1", "A", "x", at(1))])
    none = loads.where("load_id < 0")
    assert rows(S.states(t, none, log, "registry", F.col("nct_id"), [F.col("status")])) == []


def test_large_calendars_take_the_way_by_day(spark, monkeypatch):
    data = [(i, f"N{i % 3}", "A", "xyz"[i % 3], at(i % 6, i % 5)) for i in range(40)]
    small, loads = build(spark, data, [(2, "A")])
    want = rows(small), rows(S.changes(small, loads, ["status"])), rows(S.versions(small, loads, ["status"]))
    monkeypatch.setattr(S, "CALENDAR_BROADCAST_ROWS", 1)
    large, loads = build(spark, data, [(2, "A")])
    assert (rows(large), rows(S.changes(large, loads, ["status"])), rows(S.versions(large, loads, ["status"]))) == want


def test_null_differs_from_every_value_in_the_row_hash(spark):
    df = spark.createDataFrame([(None, "a"), ("a", None), (None, None), ("", "a")], "x string, y string")
    assert len({r[0] for r in df.select(S.row_hash(F.col("x"), F.col("y"))).collect()}) == 4


def test_versions_are_planned_with_one_shuffle_of_the_rows(spark):
    got, loads = build(spark, [(1, "N1", "A", "x", at(1))], by_key=True)
    plan = S.versions(got, loads, ["status"])._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan and "CartesianProduct" not in plan


@pytest.mark.parametrize(
    ("text", "want"),
    [("Active, not recruiting", "ACTIVE_NOT_RECRUITING"), (" RECRUITING ", "RECRUITING"), ("\tTERMINATED", "TERMINATED"), ("ENROLLING-BY-INVITATION", "ENROLLING_BY_INVITATION"), ("", ""), (None, None)],
)
def test_token(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(token(F.col("t"))).first()[0] == want


@pytest.mark.parametrize(
    ("text", "want", "shown"),
    [
        ("Phase 2/Phase 1", ["PHASE1", "PHASE2"], "PHASE1, PHASE2"), ("PHASE2,PHASE3", ["PHASE2", "PHASE3"], "PHASE2, PHASE3"), ("n/a", ["NA"], "N/A"),
        ("Early Phase 1", ["EARLYPHASE1"], "EARLY_PHASE1"), ("", [], ""), (None, None, None), ("PHASE1, PHASE1", ["PHASE1"], "PHASE1"),
    ],
)
def test_phases(spark, text, want, shown):
    r = spark.createDataFrame([(text,)], "t string").select(phase_set(F.col("t")), phase_text(F.col("t"))).first()
    assert r[0] == want and r[1] == shown


def test_whole_cuts_toward_zero(spark):
    df = spark.createDataFrame([(99.9,), (-99.9,), (float("nan"),), (1e300,), (None,)], "v double")
    assert [r[0] for r in df.select(whole(F.col("v"))).collect()] == [99, -99, None, None, None]


def _loads_on_disk(spark, folder, loads):
    spark.createDataFrame([(k,) for k in loads], "load_id int").createOrReplaceTempView("made")
    spark.sql("select load_id, make_timestamp_ntz(2025, 1, load_id, 5, 0, 0) as started_at from made").write.parquet(f"{folder}/loads.parquet")
    kept = [(k, t, i) for k, t, i in ((1, "A", 1), (1, "A", 2), (1, "B", 3), (1, None, 4), (2, "B", 5), (3, "B", 6), (3, "B", 7)) if k in loads]
    spark.createDataFrame([(k, t, str(i), i) for k, t, i in kept], "k int, company_ticker string, nct_id string, id long").createOrReplaceTempView("made")
    spark.sql("select company_ticker, nct_id, id, make_timestamp_ntz(2025, 1, k, 6, 0, 0) as fetched_at from made").write.parquet(f"{folder}/trials.parquet")
    log = [(1, "A", "ok"), (1, "B", "ok"), (2, "A", "failed"), (2, "B", "ok"), (3, "A", "failed"), (3, "B", "ok"), (4, "A", "failed"), (4, "B", "ok")]
    spark.createDataFrame([(k, t, "registry", o) for k, t, o in log if k in loads], "load_id int, company_ticker string, feed string, outcome string").write.parquet(f"{folder}/fetch_log.parquet")


def test_replay_keeps_the_last_good_snapshot(spark, tmp_path):
    from larkspur.queries import extract

    _loads_on_disk(spark, tmp_path, [1, 2, 3, 4])
    got = {(r["load_id"], r["company_ticker"]): (r["n"], r["last_id"]) for r in extract.snapshot_replay(spark, str(tmp_path)).collect()}
    # A failed three times and keeps its rows; B's last good fetch has none.
    assert got == {(k, "A"): (2, 2) for k in (1, 2, 3, 4)} | {(1, "B"): (1, 3), (2, "B"): (1, 5), (3, "B"): (2, 7)}


def test_replacement_with_fewer_than_two_loads(spark, tmp_path):
    from larkspur.queries import extract

    _loads_on_disk(spark, tmp_path / "one", [1])
    got = {r["company_ticker"]: r["n"] for r in extract.snapshot_replace(spark, str(tmp_path / "one")).collect()}
    assert got == {"A": 2, "B": 1}
    _loads_on_disk(spark, tmp_path / "none", [])
    assert extract.snapshot_replace(spark, str(tmp_path / "none")).count() == 0
    assert extract.snapshot_replay(spark, str(tmp_path / "none")).count() == 0
