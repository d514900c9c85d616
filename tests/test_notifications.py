"""Notification groups: the processor against a look-by-look simulation, routing and quiet ticks."""

import random
from types import SimpleNamespace

import pytest

from pulsegrid import vocabulary as V
from pulsegrid.plans import rules as R
from pulsegrid.streaming.processors import Notifier


def told(rows, route):
    """Every look of a group in turn, second by second, told by the members known at that second."""
    _, wait, interval, repeat, resolved, _, _ = next(r for r in V.ROUTES if r[0] == route)
    known, out = dict(rows), []
    now, since, look, sent, sent_at = set(), None, None, None, None
    for t in range(min(known), max(known)):
        if t in known:
            now = set(known[t])
            if now and look is None:
                since, look = t, t + wait
        if look != t:
            continue
        look += interval
        reason = None
        if sent is None:
            reason = "first" if now else None
        elif not now:
            reason = "resolved" if resolved else None
        elif now - sent or (resolved and now != sent):
            reason = "changed"
        elif t - sent_at >= repeat:
            reason = "repeat"
        if reason:
            out.append((t, since, len(now), reason))
            sent, sent_at = now, t
        if not now:
            since = look = sent = sent_at = None
    return out


def walked(rows, route):
    processor = Notifier()
    key, doc, out = (route, "a", "n", ""), processor.fresh(), []
    for t, members in rows:
        out += processor.step(key, doc, SimpleNamespace(t=t, members=members))
    assert all(r[:4] == key for r in out)
    return [r[4:] for r in out]


@pytest.mark.parametrize("route", ["mail", "agent"])
@pytest.mark.parametrize("seed", range(12))
def test_looks_of_a_group(route, seed):
    rng = random.Random(seed)
    t, rows = 1000, []
    for _ in range(80):
        rows.append((t, sorted(rng.sample("pqr", rng.choice([0, 0, 1, 1, 1, 2, 3])))))
        t += rng.choice([1, 9, 10, 15, 30, 31, 60, 300, 1800, 3000, 16000])
    assert walked(rows, route) == told(rows, route) != []


def test_timing_of_both_routes():
    steady = [(0, ["x"]), (5 * 3600, ["x"])]
    assert [r[0] for r in walked(steady, "mail")] == [30, 30 + 4 * 3600]
    assert [r[0] for r in walked(steady, "agent")] == [10 + 1800 * k for k in range(10)]
    grown = [(0, ["x"]), (40, ["x", "y"]), (1000, ["y"]), (2000, []), (9000, [])]
    assert walked(grown, "mail") == [(30, 0, 1, "first"), (330, 0, 2, "changed"), (1230, 0, 1, "changed"), (2130, 0, 0, "resolved")]
    assert walked(grown, "agent") == [(10, 0, 1, "first"), (70, 0, 2, "changed"), (1870, 0, 1, "repeat")]
    # gone before the first look: nobody is told
    assert walked([(0, ["x"]), (5, []), (9000, [])], "mail") == []


def test_routes_and_quiet_ticks(spark):
    firing = spark.createDataFrame(
        [("A", "warning", "n1", "j1", 0, "s1"), ("A", "warning", "n1", "j2", 0, "s2"), ("A", "warning", "n1", "j1", 60, "s1"), ("A", "warning", "n1", "j1", 60, "s1"), ("I", "info", None, None, 60, "s3")],
        "alertname string, severity string, node string, job string, t long, series string",
    )
    states = R.group_states(R.routed(firing), 60, spark.sql("select 150L"))
    got = sorted((*[r[c] for c in R.GROUP], r["t"], r["members"]) for r in states.collect())
    assert got == sorted(
        [("mail", "A", "n1", "", 0, ["s1", "s2"]), ("mail", "A", "n1", "", 60, ["s1"]), ("mail", "A", "n1", "", 120, [])]
        + [("agent", "A", "n1", "j1", 0, ["s1"]), ("agent", "A", "n1", "j1", 60, ["s1"]), ("agent", "A", "n1", "j1", 120, [])]
        + [("agent", "A", "n1", "j2", 0, ["s2"]), ("agent", "A", "n1", "j2", 60, []), ("agent", "A", "n1", "j2", 120, [])]
        + [("agent", "I", "", "", 60, ["s3"]), ("agent", "I", "", "", 120, [])]
    )
