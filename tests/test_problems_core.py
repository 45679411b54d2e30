"""Core data problems on small fixtures: edge cases, skew, brute force."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from panelforge.functions.dates import is_filled, nearest_quarter, parse_date, parse_yyyymmdd, q_end, q_index, q_label, q_yyyyq
from panelforge.operators import asof, components, history, intervals, late_panes, regular_grid

D = dt.date


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize(
    "text,day",
    [("2018-03-05", D(2018, 3, 5)), (" 2018-03-05 ", D(2018, 3, 5)), ("20180305", D(2018, 3, 5)), ("2018/03/05", D(2018, 3, 5)), ("05-Mar-2018", D(2018, 3, 5)), ("2018-03-05T00:00:00", D(2018, 3, 5)), ("March 5, 2018", D(2018, 3, 5)), ("03/05/2018", D(2018, 3, 5)),
     ("2018-02-30", None), ("31-Apr-2019", None), ("20189999", None), ("0", None), ("", None), ("N/A", None), ("0000-00-00", None), (None, None), ("05-Xyz-2018", None)],
)
def test_parse_date(spark, text, day):
    assert spark.createDataFrame([(text,)], "s string").select(parse_date("s")).first()[0] == day


def test_parse_yyyymmdd(spark):
    got = spark.createDataFrame([(20180315,), (0,), (None,), (20189999,), (20180230,), (16000101,)], "n int").select(parse_yyyymmdd("n")).collect()
    assert [r[0] for r in got] == [D(2018, 3, 15), None, None, None, None, None]


def test_quarters(spark):
    days = [D(2010, 1, 1) + dt.timedelta(n) for n in range(800)]
    df = spark.createDataFrame([(d,) for d in days], "d date").select("d", nearest_quarter("d").alias("q"), q_end(q_index("d")).alias("e"), q_label(q_index("d")).alias("l"), q_yyyyq(q_index("d")).alias("y"))

    def end(q):
        y, k = divmod(q + 1, 4)
        return D(y, 3 * k + 1, 1) - dt.timedelta(1)

    for r in df.collect():
        own = r.d.year * 4 + (r.d.month - 1) // 3
        assert r.q == min((own - 1, own), key=lambda q: (abs((end(q) - r.d).days), q))
        assert r.e == end(own) and r.l == f"{r.d.year}Q{own % 4 + 1}" and r.y == r.d.year * 10 + own % 4 + 1


def test_is_filled(spark):
    df = spark.createDataFrame([("x", True), (None, False), (" ", False), ("N/A", False), ("-", False), ("0", False), ("unknown", False), ("0000-00-00", False)], "s string, ok boolean")
    assert df.where(is_filled("s") != F.col("ok")).count() == 0


SPAN = "k string, s date, e date, run_end int"


def test_sweep_edge_cases(spark):
    data = [("a", D(2020, 1, 1), D(2020, 1, 10), 1), ("a", D(2020, 1, 5), D(2020, 1, 7), 2), ("a", D(2020, 1, 11), D(2020, 1, 12), 3), ("a", D(2020, 2, 1), D(2020, 2, 1), 4), ("a", D(2020, 2, 1), D(2020, 2, 1), 4), ("a", D(2020, 3, 5), D(2020, 3, 1), 5), ("a", None, D(2020, 5, 1), 6), (None, D(2020, 1, 1), D(2020, 1, 2), 7)]
    df = spark.createDataFrame(data, SPAN)
    assert rows(intervals.merge_periods(df, ["k"], "s", "e")) == sorted([("a", D(2020, 1, 1), D(2020, 1, 12), 2), ("a", D(2020, 2, 1), D(2020, 2, 1), 2), (None, D(2020, 1, 1), D(2020, 1, 2), 1)], key=repr)
    assert rows(intervals.gaps(df, ["k"], "s", "e")) == [("a", D(2020, 1, 13), D(2020, 1, 31))]
    assert rows(intervals.gaps(df.limit(0), ["k"], "s", "e")) == []


def test_sweep_brute_force(spark):
    rng = random.Random(3)
    data = [(k, D(2020, 1, 1) + dt.timedelta(a), D(2020, 1, 1) + dt.timedelta(a + rng.randrange(9)), 0) for k in "abc" for a in (rng.randrange(200) for _ in range(25))]
    got = rows(intervals.gaps(spark.createDataFrame(data, SPAN), ["k"], "s", "e"))
    want = []
    for k in "abc":
        cov = {s + dt.timedelta(i) for q, s, e, _ in data if q == k for i in range((e - s).days + 1)}
        day, run = min(cov), []
        while day <= max(cov) + dt.timedelta(1):
            if day not in cov and day <= max(cov):
                run.append(day)
            elif run:
                want.append((k, run[0], run[-1]))
                run = []
            day += dt.timedelta(1)
    assert got == sorted(want, key=repr)


EV = "feed int, stage string, f date, p date"


def panes(df):
    return late_panes.slice_events(df, ["feed"], "f", "p")


def test_panes_incremental_equals_whole(spark):
    rng = random.Random(1)
    data = [(rng.randrange(2), "x", D(2015, 1, 1) + dt.timedelta(a := rng.randrange(700)), D(2015, 1, 1) + dt.timedelta(a + rng.randrange(1500))) for _ in range(400)] + [(1, "x", None, D(2016, 1, 1)), (1, "x", D(2016, 1, 1), None)]
    whole = late_panes.recompose(panes(spark.createDataFrame(data, EV)))
    first, late = spark.createDataFrame(data[:300], EV), spark.createDataFrame(data[300:], EV)
    merged = late_panes.merge_panes(panes(first), panes(late))
    assert rows(late_panes.recompose(merged)) == rows(whole)
    touched = late_panes.affected_windows(panes(late))
    again = late_panes.recompose(merged, touched)
    assert rows(again) == rows(whole.join(touched, ["stream", "window_q"], "left_semi").select(*again.columns))
    assert 0 < again.count() < whole.count() + 1


def test_pane_limits(spark):
    q_last = D(2015, 3, 31)
    data = [(1, "x", D(2015, 2, 1), q_last + dt.timedelta(n)) for n in (548, 549, 1096, 1097)]
    got = rows(late_panes.recompose(panes(spark.createDataFrame(data, EV))).select("arrival_month", "stage", "delta", "total"))
    assert got == sorted([(None, "first", 1, 1), (201609, "correction", 1, 2), (201803, "correction", 1, 3)], key=repr)
    assert late_panes.recompose(panes(spark.createDataFrame([], EV))).count() == 0


def test_regular_grid_cases(spark):
    data = [("a", q, float(q), None) for q in (1, 2, 3, 5, 8)] + [("b", q, 2.0 * q, None) for q in range(1, 9)] + [("c", q, 3.0 * q, None) for q in range(1, 9)] + [("d", q, 1.0 + q, None) for q in range(1, 9)] + [("one", 4, None, None), (None, 1, 1.0, None), (None, 3, 1.0, None)]
    cells = spark.createDataFrame(data, "k string, q int, v double, status string")
    got = {(r.k, r.q): (r.value, r.status) for r in regular_grid.regular_grid(cells, ["k"]).collect()}
    assert got["a", 3] == (3.0, "observed") and got["one", 4] == (None, "observed")
    assert got["a", 4][1] == "filled" and abs(got["a", 4][0] - 4.0) < 0.8 and abs(got["a", 6][0] - 6.0) < 1.0
    assert got[None, 2] == (None, "unsupported")
    assert sum(k == "a" for k, _ in got) == 8
    assert regular_grid.regular_grid(cells.limit(0), ["k"]).count() == 0


def test_regular_grid_held_out(spark):
    """Held-out cells of a rank-two table come back to a few percent; observed cells exactly."""
    rng = random.Random(5)
    import math

    table = {(f"s{i}", q): (5 + i % 7) * (1 + 0.02 * q) + (1 + i % 3) * math.sin(q / 3) for i in range(60) for q in range(40)}
    held = {k for k in table if 0 < k[1] < 39 and rng.random() < 0.1}
    cells = spark.createDataFrame([(s, q, v) for (s, q), v in table.items() if (s, q) not in held], "s string, q int, v double")
    got = {(r.s, r.q): r for r in regular_grid.regular_grid(cells, ["s"], iterations=8).collect()}
    assert all(got[k].value == v and got[k].status == "observed" for k, v in table.items() if k not in held)
    errors = sorted(abs(got[k].value / table[k] - 1) for k in held)
    assert errors[len(errors) // 2] < 0.02 and errors[int(0.95 * len(errors))] < 0.08


def test_cells_take_latest_non_null(spark):
    df = spark.createDataFrame([("a", 1, 5.0, 1), ("a", 1, None, 2), ("a", 1, 4.0, 0), ("a", None, 1.0, 1)], "s string, quarter int, v double, r int")
    assert rows(regular_grid.cells_of(df, ["s"], "quarter", "v", ["r"])) == [("a", 1, 5.0)]


ASOF_V = "entity string, filed date, e date, obs_id bigint, val double"
ASOF_E = "event_id bigint, entity string, day date, val string"


def asof_join(spark, events, versions):
    st = asof.current_states(spark.createDataFrame(versions, ASOF_V), "entity", "filed", F.struct("e", "filed", (-F.col("obs_id")).alias("i")), ["obs_id"])
    ev = spark.createDataFrame(events, ASOF_E).drop("val")
    return {r.event_id: r.obs_id for r in asof.asof_attributes(ev, "entity", "day", st, "entity", "filed", ["obs_id"], ["event_id", "day"]).collect()}


def test_asof_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(asof, "EVENTS_PER_BUCKET", 20)  # so that a hot entity is split
    rng = random.Random(2)
    day = lambda n: D(2020, 1, 1) + dt.timedelta(n)
    versions = [(rng.choice("abc"), day(rng.randrange(100)) if rng.random() > 0.05 else None, day(rng.randrange(60)), i, 1.0) for i in range(200)]
    events = [(i, rng.choice("aaaaabcd"), day(rng.randrange(-5, 120)), "x") for i in range(150)] + [(900, None, day(5), "x"), (901, "a", None, "x")]
    got = asof_join(spark, events, versions)
    assert len(got) == len(events)
    for i, k, at, _ in events:
        known = [v for v in versions if k and at and v[0] == k and v[1] and v[1] <= at]
        assert got[i] == (max(known, key=lambda v: (v[2], v[1], -v[3]))[3] if known else None)


def test_asof_empty(spark):
    assert asof_join(spark, [(1, "a", D(2020, 1, 1), "x")], []) == {1: None}
    assert asof_join(spark, [], [("a", D(2020, 1, 1), D(2020, 1, 1), 1, 1.0)]) == {}


SNAP = "at date, id bigint, v double, n int, loaded timestamp, key string"


def snap_history(spark, data):
    h = history.history(spark.createDataFrame(data, SNAP), "id", "at", "loaded", ["v", "n"])
    return rows(h.select("id", "valid_from", "valid_to", "v", "n"))


def test_history_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(history, "ROWS_PER_LEAF", 2)  # a deep tree
    rng = random.Random(4)
    data = []
    state = {i: 1.0 for i in range(120)}
    for q in range(12):
        at = D(2010 + q // 4, 3 * (q % 4) + 1, 1)
        for i in range(120):
            if rng.random() < 0.1:
                state[i] = float(rng.randrange(3))
            for k in range(rng.choice([0, 1, 1, 1, 2])):
                v = state[i] if k == 0 else float(rng.randrange(3))
                data.append((at, i, v if rng.random() > 0.05 else None, q // 6, dt.datetime(2020, 1, 1, k), "x"))
    got = snap_history(spark, data)
    want = []
    for i in range(120):
        last, prev = {}, None
        for at, j, v, n, load, _ in data:
            if j == i and (at not in last or load > last[at][0]):
                last[at] = (load, v, n)
        starts = []
        for at in sorted(last):
            s = last[at][1:]
            if prev is None or s != prev[0]:
                starts.append((at, s))
            prev = (s,)
        want += [(i, a, starts[k + 1][0] if k + 1 < len(starts) else None, *s) for k, (a, s) in enumerate(starts)]
    assert got == sorted(want, key=repr)


def test_history_cases(spark):
    t = dt.datetime(2020, 1, 1)
    a, b, c = D(2020, 3, 31), D(2020, 6, 30), D(2020, 9, 30)
    data = [(a, 1, 1.0, 1, t, "x"), (b, 1, 2.0, 1, t, "x"), (c, 1, 1.0, 1, t, "x"), (a, 2, 1.0, 1, t, "x"), (a, 2, 1.0, 1, t, "x"), (c, 2, 1.0, 1, t, "x"), (a, None, 1.0, 1, t, "x"), (None, 3, 1.0, 1, t, "x")]
    assert snap_history(spark, data) == sorted([(1, a, b, 1.0, 1), (1, b, c, 2.0, 1), (1, c, None, 1.0, 1), (2, a, None, 1.0, 1)], key=repr)
    assert snap_history(spark, []) == []


def test_components(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1040)] + [(5, 5), (None, 3)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint"), "a", "b").collect()}
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for x, y in edges:
        if x is not None and y is not None:
            i, j = sorted((find(x), find(y)))
            parent[j] = i
    assert got == {x: find(x) for x in parent}
    assert components.components(spark.createDataFrame([], "a bigint, b bigint"), "a", "b").count() == 0
