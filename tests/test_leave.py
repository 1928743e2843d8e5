"""Leave decisions against a plain search over days; what requests meet doesn't grow with the members of a group."""

import datetime
import random

from pyspark.sql import functions as F

from tallyloom.operators import windows
from tallyloom.plans import leave

TODAY = datetime.date(2020, 1, 1)
MEMBERS = "member int, org int, grp string"


def on(n):
    return TODAY + datetime.timedelta(days=n)


def expected(request, members, notices, blackouts, others):
    _, m, kind, s, e = request
    org, grp = members[m]
    days, notice = (e - s).days + 1, notices.get(kind)
    shut = [(a, b) for o, a, b in blackouts if o is None or o == org]
    if days < 1:
        return "dates", None, None
    if notice is not None and (s - TODAY).days < notice:
        return "notice", None, None
    if any(s <= b and a <= e for a, b in shut):
        return "blackout", None, None
    away = [(x, a, b) for x, a, b in others if x != m and members[x][1] == grp]
    if met := [x for x, a, b in away if s <= b and a <= e]:
        first = max(TODAY, s, TODAY + datetime.timedelta(days=notice or 0))
        taken = [*shut, *((a, b) for _, a, b in away)]
        for d in range(leave.LOOK_AHEAD):
            a, b = first + datetime.timedelta(days=d), first + datetime.timedelta(days=d + days - 1)
            if not any(a <= y and x <= b for x, y in taken):
                return "peer away", min(met), a
        return "peer away", min(met), None
    return "no balance", None, None


def test_decisions_are_a_plain_search_over_days(spark):
    rng = random.Random(7)
    members = {m: (m % 3, f"g{m % 4}") for m in range(24)}
    others = [(rng.randrange(24), on(s := rng.randrange(-40, 260)), on(s + rng.choice((0, 1, 3, 8, 40)))) for _ in range(260)]
    requests = [(i, rng.randrange(24), rng.randrange(3), on(s := rng.randrange(-30, 120)), on(s + rng.randrange(-1, 12))) for i in range(300)]
    blackouts = [(None, on(60), on(63)), (1, on(100), on(140))]
    rules = {0: 0, 1: 9}
    kinds = "request int, member int, kind int, s date, e date"
    got = leave.validated(
        spark.createDataFrame(requests, kinds), spark.createDataFrame([(m, *x) for m, x in members.items()], MEMBERS), spark.createDataFrame([*rules.items()], "kind int, notice int"),
        spark.createDataFrame(blackouts, "org int, s date, e date"), spark.createDataFrame(others, "member int, s date, e date"), spark.createDataFrame([], "member int, kind int, year int, left int"), str(TODAY),
    )
    assert {r.request: (r.decision, r.peer, r.suggested) for r in got.collect()} == {r[0]: expected(r, members, rules, blackouts, others) for r in requests}


def test_what_a_request_meets_is_bounded_by_days(spark):
    # 400 members are away on the same ten days: two rows a day and one run, not a row a member.
    away = spark.range(400).select(F.lit("g").alias("grp"), F.col("id").alias("member"), F.lit(on(0)).alias("s"), F.lit(on(9)).alias("e"))
    days = leave.least_two(away)
    assert {(r.least, r.next) for r in days.collect()} == {(0, 1)} and days.count() == 10
    assert [tuple(r) for r in leave.busy_runs(days).collect()] == [("g", None, on(0), on(9))]


def test_sums_before_run_over_ranges(spark):
    rng = random.Random(3)
    rows = {k: rng.randrange(9) for k in rng.sample(range(-300, 300), 80)}
    got = windows.sums_before(spark.createDataFrame([*rows.items()], "k long, n int"), "k", "n", width=16).collect()
    assert {r.k: r.before for r in got} == {k: sum(n for x, n in rows.items() if x < k) for k in rows}
