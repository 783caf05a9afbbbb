"""Quota and plans where ids, rows and times repeat, and where tenants are busy."""

import datetime as dt
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from kbspark.operators import metering as mt
from kbspark.operators.analytics import carried, running

DAY = dt.datetime(2024, 3, 1)


def test_carried_equals_one_pass(spark):
    r = random.Random(2)
    rows = [(r.choice(["a", "a", "a", "b", None]), k, r.choice([None, None, f"x{k}"]), r.choice([None, k])) for k in range(400)]
    got = carried(spark.createDataFrame(rows, "g string, k long, x string, y long"), ["g"], F.floor(F.col("k") / 17), [F.col("k")], ["x", "y"])
    last, want = {}, []
    for g, k, x, y in rows:
        last[g, "x"], last[g, "y"] = x or last.get((g, "x")), last.get((g, "y")) if y is None else y
        want.append((g, k, last[g, "x"], last[g, "y"]))
    assert sorted(map(str, map(tuple, got.select("g", "k", "x", "y").collect()))) == sorted(map(str, want))
    assert carried(spark.createDataFrame([], "g string, k long, x string"), ["g"], F.col("k"), [F.col("k")], ["x"]).count() == 0


def test_quota_of_repeated_ids_and_rows(spark):
    rows = [("a", 1, DAY, "free", "x"), ("a", 1, DAY + dt.timedelta(hours=1), "free", "y"), ("a", 2, DAY, "free", "z")] + [("a", 9, DAY + dt.timedelta(hours=2), "free", "same")] * 3
    rows += [(None, 4, DAY, "free", "lost"), ("a", 5, None, "free", "lost"), ("b", 6, DAY, None, "paid")]
    df = mt.calendar_periods(spark.createDataFrame(rows, "domain string, message_id long, ts timestamp, plan string, rest string"))
    got = mt.quota_outcome(df, 3).collect()
    assert Counter((r.domain, r.message_id, r.rest, r.rn, r.accepted, r.notice) for r in got) == Counter(
        [("a", 1, "x", 1, True, False), ("a", 2, "z", 2, True, False), ("a", 1, "y", 3, True, False), ("a", 9, "same", 4, False, True)]
        + [("a", 9, "same", None, False, False)] * 2 + [("b", 6, "paid", 1, True, False)]
    )
    assert mt.quota_outcome(df.limit(0), 3).count() == 0


def test_as_of_plan_of_repeated_ids(spark):
    history = spark.createDataFrame(
        [("a", 1, DAY, "pro"), ("a", 2, DAY, "max"), ("a", 3, DAY + dt.timedelta(days=40), None), ("b", 4, DAY + dt.timedelta(days=1), "pro"), (None, 5, DAY, "lost")],
        "domain string, seq long, ts timestamp, plan string",
    )
    hours = [-1, 0, 1, 24 * 39, 24 * 40, 24 * 80]
    rows = [("a", 1, DAY + dt.timedelta(hours=h), "kept", "old") for h in hours] + [("a", 1, DAY, "kept", "old"), ("b", 1, DAY, "kept", "old"), (None, 1, DAY, "kept", "old"), ("a", 2, None, "kept", "old")]
    got = mt.as_of_plan(spark.createDataFrame(rows, "domain string, message_id long, ts timestamp, kind string, plan string"), history)
    assert got.columns == ["domain", "message_id", "ts", "kind", "plan"]
    want = [(h, p) for h, p in zip(hours, ["free", "max", "max", "max", "free", "free"])]
    expected = Counter([("a", 1, DAY + dt.timedelta(hours=h), "kept", p) for h, p in want] + [("a", 1, DAY, "kept", "max"), ("b", 1, DAY, "kept", "free"), (None, 1, DAY, "kept", "free"), ("a", 2, None, "kept", "free")])
    assert Counter(map(tuple, got.collect())) == expected


def test_plans_of_a_busy_tenant_by_stretches(spark, monkeypatch):
    r = random.Random(6)
    kinds = ["checkout", "updated", "deleted", "payment_failed"]
    rows = [
        (k, DAY + dt.timedelta(minutes=k), r.choice(kinds), r.choice(["a"] * 9 + ["b", "unknown"]), r.choice(["c1", "c2", None]), r.choice(["payment", "subscription"]), r.choice(["active", "past"]), r.random() < 0.2)
        for k in range(300)
    ]
    rows = [(k, t, kind, None if kind == "payment_failed" else d, c, m, s, a) for k, t, kind, d, c, m, s, a in rows]
    events = spark.createDataFrame(rows, "seq long, ts timestamp, type string, domain string, customer string, mode string, status string, addon boolean")
    tenants = spark.createDataFrame([("a",), ("b",)], "domain string")
    key = lambda df: sorted(map(str, df.collect()))
    whole = key(mt.plan_history(events, tenants))
    monkeypatch.setattr(mt, "BUCKET", 7)
    assert key(mt.plan_history(events, tenants)) == whole


@pytest.mark.parametrize("hot", [None, 5, 0])
def test_a_group_with_all_rows_in_one_bucket_is_spread(spark, hot):
    r = random.Random(hot)
    rows = [(r.choice(["a"] * 8 + ["b", None]), r.choice([None, 1, 1, 1, 1, 2]), k, r.randrange(5)) for k in range(500)]
    df = spark.createDataFrame(rows, "g string, bucket long, k long, v long")
    rank = lambda b, k: (b is not None, b or 0, k)
    for descending in (False, True):
        k = F.col("k").desc() if descending else F.col("k")
        b = F.col("bucket").desc() if descending else F.col("bucket")
        got = running(df, ["g"], F.col("bucket"), [b, k], {"n": F.lit(1), "s": F.col("v")}, {"n": "total"}, descending, hot).select("g", "bucket", "k", "v", "n", "s", "total").collect()
        want = []
        for g in ("a", "b", None):
            mine, s = sorted((x for x in rows if x[0] == g), key=lambda x: rank(x[1], x[2]), reverse=descending), 0
            for n, x in enumerate(mine, 1):
                s += x[3]
                want.append((*x, n, s, len(mine)))
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert running(df.limit(0), ["g"], F.col("bucket"), [F.col("k")], {"n": F.lit(1)}, hot_bucket=hot).count() == 0
