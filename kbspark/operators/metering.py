"""Metering and billing state: periods, quota outcomes, warnings, plans over time, projections."""

from __future__ import annotations

import datetime as dt

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kbspark.operators.analytics import carried

LIMIT = 100
#: Numbers of events that one task takes of a tenant.
BUCKET = 10_000
THRESHOLDS = (50, 75, 90)


def next_reset(day: Column) -> Column:
    """The same day of the next month; days that it lacks run over into the month after (31 January: 3 March,
    or 2 March in a leap year)."""
    return F.date_add(F.add_months(F.trunc(day, "MM"), 1), F.dayofmonth(day) - 1)


def fold_periods(days: list[dt.date], start: dt.date | None = None, reset: dt.date | None = None) -> list[tuple[dt.date, dt.date, dt.date]]:
    """(day, first day of its period, reset day) for sorted days: a period starts with the first message at or
    after the reset of the one before, and is reset from that message's date. ``start`` and ``reset`` are those of the
    period in hand before the first day, if there is one; earlier days count into it."""
    out = []
    for d in days:
        if reset is None or d >= reset:
            y, m = (d.year, d.month + 1) if d.month < 12 else (d.year + 1, 1)
            start, reset = d, dt.date(y, m, 1) + dt.timedelta(days=d.day - 1)
        out.append((d, start, reset))
    return out


def billing_periods(messages: DataFrame) -> DataFrame:
    """``messages`` (``domain, ts``) with ``period_start`` and ``reset_on``. Only distinct (domain, day) rows go
    through the fold; messages meet them again by an equi-join."""
    dated = messages.withColumn("day", F.to_date("ts"))

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        rows = fold_periods(sorted(group["day"]))
        return pd.DataFrame(rows, columns=["day", "period_start", "reset_on"]).assign(domain=group["domain"].iloc[0])

    days = dated.select("domain", "day").distinct()
    periods = days.groupBy("domain").applyInPandas(fold, "day date, period_start date, reset_on date, domain string")
    return dated.join(periods, ["domain", "day"]).drop("day")


def calendar_periods(messages: DataFrame) -> DataFrame:
    """Periods that are calendar months, for tenants billed by the month."""
    return messages.withColumns({"period_start": F.trunc("ts", "MM"), "reset_on": F.add_months(F.trunc("ts", "MM"), 1)})


def quota_outcome(messages: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``messages`` (``domain, period_start, ts, message_id, plan``) with ``rn`` (place in the period, null beyond
    ``limit + 1``), ``accepted`` and ``notice`` (the first blocked one, which tells the owner). Blocked messages
    don't count, so a free tenant's first ``limit`` messages of a period are accepted.

    Only the first ``limit + 1`` messages of a period are ranked, a bound that Spark applies in part before the
    exchange: where the last of them stands is one row a period, which tells the others that they come later. A busy
    tenant's later messages meet no window, and those up to that place are few.

    Repeated rows and ids: a message each. Ties in time: by id. Messages without domain or period belong to no quota and
    are left out. Null plan: not free. Empty table: empty result. Other columns are carried.
    """
    order, at = Window.partitionBy("domain", "period_start").orderBy("ts", "message_id"), F.struct("ts", "message_id")
    mine = messages.filter("domain IS NOT NULL AND period_start IS NOT NULL")
    first = mine.select("domain", "period_start", "ts", "message_id").withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= limit + 1)
    edges = first.groupBy("domain", "period_start").agg(F.max(at).alias("_edge"))
    known = mine.join(edges, ["domain", "period_start"]).withColumn("_early", F.coalesce(at <= F.col("_edge"), F.lit(True))).drop("_edge")
    early = known.filter("_early").withColumn("rn", F.row_number().over(order)).withColumn("rn", F.when(F.col("rn") <= limit + 1, F.col("rn")))
    ranked = early.unionByName(known.filter("NOT _early").withColumn("rn", F.lit(None).cast("int"))).drop("_early")
    free = F.coalesce(F.col("plan") == "free", F.lit(False))
    fits = F.coalesce(F.col("rn") <= limit, F.lit(False))
    return ranked.withColumns({"accepted": ~free | fits, "notice": free & F.coalesce(F.col("rn") == limit + 1, F.lit(False))})


def blocked_counts(messages: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``(domain, period_start, accepted, blocked)`` without ranking: counts are enough."""
    free = messages.groupBy("domain", "period_start").agg(F.count("*").alias("n"), F.max("plan").alias("plan"))
    accepted = F.when(F.col("plan") == "free", F.least("n", F.lit(limit))).otherwise(F.col("n"))
    return free.select("domain", "period_start", accepted.alias("accepted"), (F.col("n") - accepted).alias("blocked"))


def quota_warnings(outcome: DataFrame, thresholds: DataFrame | None = None, limit: int = LIMIT) -> DataFrame:
    """``(domain, period_start, message_id, threshold)``: the highest threshold that an accepted message of a free
    tenant newly reaches. ``thresholds`` has ``domain, thresholds array<int>``; 50, 75 and 90 where it has none, or null or
    an empty list.

    Only the messages at a threshold's place are ranked on: ``rn`` equals it, so nothing fires twice.
    """
    usual = F.array(*[F.lit(t) for t in THRESHOLDS])
    counted = outcome.filter("accepted AND plan = 'free'").filter(F.col("rn") <= limit)
    if thresholds is not None:
        counted = counted.join(thresholds.select("domain", "thresholds"), "domain", "left")
        usual = F.when(F.size("thresholds") > 0, F.col("thresholds")).otherwise(usual)
    hit = F.filter(usual, lambda t: F.ceil(F.lit(limit) * t / 100) == F.col("rn"))
    return counted.select("domain", "period_start", "message_id", F.array_max(hit).alias("threshold")).filter("threshold IS NOT NULL")


def plan_history(events: DataFrame, tenants: DataFrame, ignore_addon_updates: bool = False) -> DataFrame:
    """``(domain, seq, ts, plan, plan_status, customer, addon)``: a tenant's state after each payment event.

    ``events`` has ``seq, ts, type, domain, customer, mode, status, addon``; ``type`` is checkout, updated,
    deleted or payment_failed. Events without a known domain are skipped; failed payments find their domain by
    the customer that a checkout named before. Each event sets some fields, to null too, and keeps others; the
    last value set at or before an event holds, in order of arrival. A tenant's events are taken by stretches of
    ``BUCKET`` numbers, so a busy one is spread. ``seq`` is unique; repeated rows of one event give a row each. Events without
    ``seq`` come first. Failed payments without customer: skipped. Empty tables: no rows.
    """
    known = tenants.select("domain").distinct()
    direct = events.filter("type <> 'payment_failed' AND domain IS NOT NULL").join(known, "domain", "left_semi")
    failed = events.filter("type = 'payment_failed'")
    named = direct.filter("type = 'checkout' AND customer IS NOT NULL").select("customer", "seq", F.col("domain").alias("owner"))
    both = named.select("customer", "seq", "owner").unionByName(failed.select("customer", "seq", F.lit(None).cast("string").alias("owner")))
    asked = F.col("owner").isNull()
    by_customer = carried(both.withColumn("asked", asked), ["customer"], F.floor(F.col("seq") / BUCKET), [F.col("seq")], ["owner"])
    owners = by_customer.filter("asked AND customer IS NOT NULL").select("seq", F.col("owner").alias("found"))
    resolved = failed.join(owners, "seq").filter("found IS NOT NULL").withColumn("domain", F.col("found")).drop("found")
    all_events = direct.unionByName(resolved.select(*direct.columns))
    t, mode, addon = F.col("type"), F.col("mode"), F.coalesce(F.col("addon"), F.lit(False))
    main = ~addon if ignore_addon_updates else F.lit(True)
    to = lambda v: F.struct(F.lit(v).cast("string").alias("v"))
    of = lambda c: F.struct(F.col(c).cast("string").alias("v"))
    checkout = (t == "checkout") & ~addon
    sets = {
        "plan": F.when(checkout & (mode == "payment"), to("lifetime")).when(checkout & (mode == "subscription"), to("infinity"))
        .when((t == "updated") & main & (F.col("status") == "active"), to("infinity")).when((t == "deleted") & ~addon, to("free")),
        "plan_status": F.when(checkout & (mode == "payment"), to("active")).when(checkout & (mode == "subscription"), of("status"))
        .when((t == "updated") & main, of("status")).when((t == "deleted") & ~addon, to("canceled")).when(t == "payment_failed", to("past_due")),
        "customer": F.when(t == "checkout", of("customer")),
        "addon": F.when((t == "checkout") & addon, to("on")).when((t == "deleted") & addon, to("off")),
    }
    marked = all_events.select("domain", "seq", "ts", *[v.alias(k) for k, v in sets.items()])
    state = carried(marked, ["domain"], F.floor(F.col("seq") / BUCKET), [F.col("seq")], list(sets))
    return state.select("domain", "seq", "ts", *[F.col(k)["v"].alias(k) for k in sets])


def as_of_plan(messages: DataFrame, history: DataFrame, default: str = "free") -> DataFrame:
    """``messages`` (``domain, message_id, ts``) with the plan valid at their time: an as-of join as one pass over the
    union of both by days, so no range join is needed and a busy tenant is spread over its days. A change counts for
    messages of the same time; of changes at one time the last by ``seq``.

    Messages travel with all their columns, so repeated rows and ids stay what they are. No change before, null domain or
    null time: ``default``. Columns of ``messages`` named ``plan``: replaced.
    """
    row = F.struct(*[c for c in messages.columns if c != "plan"])
    nothing = F.lit(None)
    changes = history.filter("domain IS NOT NULL AND ts IS NOT NULL").select("domain", "ts", F.lit(0).alias("kind"), F.col("seq").cast("long").alias("tie"), F.struct("plan").alias("p"), nothing.alias("row"))
    asks = messages.select("domain", "ts", F.lit(1).alias("kind"), nothing.cast("long").alias("tie"), nothing.cast(changes.schema["p"].dataType).alias("p"), row.alias("row"))
    both = changes.withColumn("row", nothing.cast(asks.schema["row"].dataType)).unionByName(asks)
    found = carried(both, ["domain"], F.to_date("ts"), [F.col("ts"), F.col("kind"), F.col("tie")], ["p"])
    plan = F.when(F.col("domain").isNotNull() & F.col("ts").isNotNull(), F.col("p.plan"))
    return found.filter("kind = 1").select("row.*", F.coalesce(plan, F.lit(default)).alias("plan"))


def usage_projection(usage: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``usage`` (``domain, used, days_elapsed, days_in_period``) with the projected total at a constant rate and
    a light: gray in the first 3 days, else green, yellow (within 10 % of the limit) or red."""
    projected = F.col("used") / F.col("days_elapsed") * F.col("days_in_period")
    light = (
        F.when(F.col("days_elapsed") < 3, "gray").when(projected < limit * 0.9, "green").when(projected <= limit * 1.1, "yellow").otherwise("red")
    )
    return usage.withColumns({"projected": F.when(F.col("days_elapsed") > 0, projected), "light": light})
