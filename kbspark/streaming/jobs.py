"""Streaming jobs: paragraph dedup, quota meter, handoffs, live counts, crawl progress, logs by days."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, BooleanType, LongType, StringType, StructField, StructType

from kbspark.functions.text import CrawlSettings, is_heading, strip_block_marker
from kbspark.operators.analytics import running
from kbspark.operators.conversations import fold_handoff
from kbspark.operators.metering import LIMIT, THRESHOLDS, fold_periods
from kbspark.operators.paragraphs import BOILERPLATE_MAX, MAX_HEADINGS, split_pages
from kbspark.sources.shared import drop_folder, exists, subfolders

SEEN = "domain string, para_hash string, n long, batch long"
SUMS = "domain string, para_hash string, n long, before long"


def first_copies(pages: DataFrame, counts: DataFrame, settings: CrawlSettings) -> tuple[DataFrame, DataFrame]:
    """The paragraphs of ``pages`` that stay where earlier pages have kept ``counts`` (domain, para_hash, n; rows are added
    up) of each: (short ones with ``para_hash``, long ones, which stay in any case)."""
    bare = strip_block_marker(F.col("para"))
    marked = split_pages(pages, settings).withColumns({"heading": is_heading(bare), "para_hash": F.sha2(bare, 256), "short": F.length(bare) <= BOILERPLATE_MAX})
    order = Window.partitionBy("domain", "para_hash").orderBy(F.col("page_seq").asc_nulls_last(), "idx")
    first = marked.filter("short").withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= MAX_HEADINGS)
    mine = first.select("domain", "para_hash").distinct()
    before = counts.join(mine, ["domain", "para_hash"], "left_semi").groupBy("domain", "para_hash").agg(F.sum("n").alias("cnt"))
    joined = first.join(before, ["domain", "para_hash"], "left").withColumn("cnt", F.coalesce("cnt", F.lit(0)))
    return joined.filter(F.col("cnt") + F.col("rn") <= F.when(F.col("heading"), MAX_HEADINGS).otherwise(1)), marked.filter("NOT short")


class IncrementalDedup:
    """Paragraph dedup batch by batch, equal to the dedup of all pages at once in batch order.

    The state is a table of how many copies of each short paragraph each batch kept, one folder a batch, and sums of all
    batches before every ``every``-th one. A batch reads the last sums and the batches since, those counts of its own
    paragraphs only, keeps its n-th copy where their sum plus n stays within the limit, and adds a folder. A batch that is
    run again doesn't see its own counts, nor sums that hold them, and replaces its folder, so it gives the same rows.
    """

    def __init__(self, spark: SparkSession, state_path: str, sink: Callable[[DataFrame, int], None], settings: CrawlSettings = CrawlSettings(), every: int = 16):
        self.spark, self.path, self.sink, self.settings, self.every = spark, state_path.rstrip("/"), sink, settings, every
        nothing = spark.createDataFrame([], "domain string, para_hash string, n long")
        nothing.write.mode("ignore").parquet(f"{self.path}/batches/batch=-1")
        nothing.write.mode("ignore").parquet(f"{self.path}/sums/before=0")

    def counts(self, before: int) -> DataFrame:
        """Copies kept by the batches before ``before``, in rows to be added up."""
        sums = self.spark.read.schema(SUMS).parquet(f"{self.path}/sums")
        made = [int(re.search(r"before=(\d+)/", f)[1]) for f in sums.inputFiles()]
        start = max((n for n in made if n <= before), default=0)
        since = self.spark.read.schema(SEEN).parquet(f"{self.path}/batches").filter((F.col("batch") >= start) & (F.col("batch") < before))
        return sums.filter(F.col("before") == start).drop("before").unionByName(since.drop("batch"))

    def __call__(self, pages: DataFrame, batch_id: int) -> None:
        kept, long = first_copies(pages, self.counts(batch_id), self.settings)
        cols = ["domain", "page_seq", "url", "idx", "para"]
        self.sink(kept.select(*cols).unionByName(long.select(*cols)), batch_id)
        kept.groupBy("domain", "para_hash").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{self.path}/batches/batch={batch_id}")
        if (batch_id + 1) % self.every == 0:
            self.compact(self.path, batch_id + 1)

    def compact(self, to: str, before: int) -> None:
        """Write the sums of the batches before ``before`` into the state folder ``to``."""
        sums = self.counts(before).groupBy("domain", "para_hash").agg(F.sum("n").alias("n"))
        sums.write.mode("overwrite").parquet(f"{to.rstrip('/')}/sums/before={before}")


METERED = ["domain", "message_id", "rn", "accepted", "notice", "threshold", "period_start"]
METER_STATE = "domain string, start date, reset date, count long, told long, noticed boolean"
IN_HAND = "day date, period_start date, reset_on date, domain string, held_count long, held_told long, held_noticed boolean"


class QuotaMeter:
    """Counts a tenant's messages (``domain, message_id, ts, plan``) in its billing period, batch by batch.

    The sink gets a row for each message: ``rn`` (the period's count after it), ``accepted``, ``notice`` (the first blocked
    one), ``threshold`` (the highest that it newly reaches) and ``period_start``. Messages of a batch are taken in order of
    time; one older than the period in hand counts into it, as it does where messages are handled as they arrive. Blocked
    messages don't count. Messages without a domain or a time belong to no period and are left out. ``thresholds`` has
    ``domain, thresholds array<int>``; the usual ones where it has none or an empty list.

    The state is a row for each tenant, a folder a batch: its period, count, the count at the last free message that
    was accepted, and whether the owner has been told of a block. A batch reads the folder of the batch before it and
    writes its own, so one that is run again gives the same rows; older folders are deleted. A tenant's messages are
    added up by the hour, so a busy one is spread over many tasks; only distinct days and the messages within the limit
    go through one. With ``idle_days``, tenants whose period ended so long before the newest message are forgotten; a
    message of theirs starts a period, as it would in any case if it isn't older than that.
    """

    def __init__(
        self, spark: SparkSession, state_path: str, sink: Callable[[DataFrame, int], None], limit: int = LIMIT, thresholds: DataFrame | None = None, idle_days: int | None = None
    ):
        self.spark, self.path, self.sink, self.limit, self.thresholds, self.idle_days = spark, state_path.rstrip("/"), sink, limit, thresholds, idle_days
        spark.createDataFrame([], METER_STATE).write.mode("ignore").parquet(f"{self.path}/batch=-1")

    def __call__(self, messages: DataFrame, batch_id: int) -> None:
        held = self.spark.read.schema(METER_STATE).parquet(f"{self.path}/batch={batch_id - 1}")
        work = f"{self.path}/work={batch_id % 2}"
        self.outcomes(messages, held, batch_id).write.mode("overwrite").parquet(work)
        rows = self.spark.read.parquet(work)
        self.sink(rows.select(*METERED), batch_id)
        told = F.max(F.when(F.col("accepted") & F.col("free"), F.col("rn")))
        periods = rows.groupBy("domain", "period_start", "reset_on", "held_told", "held_noticed").agg(F.max("rn").alias("count"), told.alias("told"), F.bool_or("notice").alias("notice"))
        state = F.struct(
            F.col("period_start").alias("start"), F.col("reset_on").alias("reset"), "count",
            F.greatest("held_told", "told").alias("told"), (F.col("held_noticed") | F.col("notice")).alias("noticed"),
        )
        fresh = periods.groupBy("domain").agg(F.max_by(state, "period_start").alias("s")).select("domain", "s.*")
        whole = fresh.unionByName(held.join(fresh.select("domain"), "domain", "left_anti"))
        newest = rows.agg(F.max("ts")).first()[0]
        if self.idle_days is not None and newest is not None:
            whole = whole.filter(F.col("reset") >= F.lit(newest.date() - dt.timedelta(days=self.idle_days)))
        whole.write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")
        for name in subfolders(self.spark, self.path):  # a rerun of this batch needs the one before
            if name.startswith("batch=") and int(name.split("=")[1]) < batch_id - 1:
                drop_folder(self.spark, f"{self.path}/{name}")

    def in_hand(self, dated: DataFrame, held: DataFrame) -> DataFrame:
        """For each day of a tenant its period, and what the state holds of it."""

        def fold(group: pd.DataFrame) -> pd.DataFrame:
            first = group.iloc[0]
            start, reset = (None, None) if pd.isna(first["start"]) else (first["start"], first["reset"])
            out = pd.DataFrame(fold_periods(sorted(group["day"]), start, reset), columns=["day", "period_start", "reset_on"])
            same = out["period_start"] == start if start is not None else pd.Series(False, index=out.index)
            count, told = (0, 0) if start is None else (int(first["count"]), int(first["told"]))
            return out.assign(domain=first["domain"], held_count=same * count, held_told=same * told, held_noticed=same & bool(start is not None and first["noticed"]))

        return dated.select("domain", "day").distinct().join(held, "domain", "left").groupBy("domain").applyInPandas(fold, IN_HAND)

    def outcomes(self, messages: DataFrame, held: DataFrame, batch_id: int) -> DataFrame:
        def staged(rows: DataFrame, name: str) -> DataFrame:
            path = f"{self.path}/{name}={batch_id % 2}"
            rows.write.mode("overwrite").parquet(path)
            return self.spark.read.schema(rows.schema).parquet(path)

        dated = messages.filter("domain IS NOT NULL AND ts IS NOT NULL").select("domain", "message_id", "ts", "plan", F.to_date("ts").alias("day"))
        rows = dated.join(self.in_hand(dated, held), ["domain", "day"]).withColumn("free", F.coalesce(F.col("plan") == "free", F.lit(False)))
        in_order = (["domain", "period_start"], F.date_trunc("hour", "ts"), [F.col("ts"), F.col("message_id")])
        # The first messages up to the limit count whatever their plan; beyond it only paid ones do, and how many of both
        # kinds were among the first is one row a period.
        rows = running(rows, *in_order, {"n": F.lit(1), "p": (~F.col("free")).cast("int")})
        rows = staged(rows, "counted")
        fits = F.col("n") <= F.lit(self.limit) - F.col("held_count")
        early = rows.filter(fits).groupBy("domain", "period_start").agg(F.max("n").alias("early"), F.max("p").alias("early_paid"))
        rows = rows.join(early, ["domain", "period_start"], "left").fillna(0, ["early", "early_paid"])
        late_paid = F.col("p") - F.col("early_paid")
        rows = rows.withColumns({"paid": late_paid, "blocked": F.when(~F.col("free") | fits, 0).otherwise(F.col("n") - F.col("early") - late_paid)})
        counted = F.when(fits, F.col("held_count") + F.col("n")).otherwise(F.greatest("held_count", F.lit(self.limit)) + F.col("paid"))
        accepted = ~F.col("free") | fits
        notice = ~accepted & (F.col("blocked") == 1) & ~F.col("held_noticed")
        rows = staged(rows.withColumns({"rn": counted.cast("long"), "accepted": accepted, "notice": notice}).drop("n", "p", "early", "early_paid", "paid", "blocked", "day"), "judged")
        # A tenant has at most as many accepted free messages in a period as the limit.
        before = F.lag("rn").over(Window.partitionBy("domain", "period_start").orderBy("rn"))
        free = rows.filter("free AND accepted").withColumn("before", F.coalesce(before, F.col("held_told")))
        usual = F.array(*[F.lit(t) for t in THRESHOLDS])
        if self.thresholds is not None:
            free = free.join(self.thresholds.select("domain", "thresholds"), "domain", "left")
            usual = F.when(F.size("thresholds") > 0, F.col("thresholds")).otherwise(usual)
        place = lambda t: F.ceil(F.lit(self.limit) * t / 100)
        hit = F.array_max(F.filter(usual, lambda t: (place(t) > F.col("before")) & (place(t) <= F.col("rn"))))
        hits = free.select("domain", "period_start", "rn", F.lit(True).alias("hit"), hit.cast("int").alias("threshold")).filter("threshold IS NOT NULL")
        keyed = rows.withColumn("hit", F.col("free") & F.col("accepted"))
        return keyed.join(hits, ["domain", "period_start", "rn", "hit"], "left").drop("hit")


HANDOFFS = StructType([
    StructField("domain", StringType()), StructField("session_token", StringType()), StructField("seq", LongType()),
    StructField("pending", ArrayType(StringType())), StructField("handoff_pending", BooleanType()), StructField("notice", BooleanType()),
])


class Handoffs(StatefulProcessor):
    """Open questions of a session; one row out for each turn with a signal. With ``idle_ms``, a session without turns for
    so long in event time is forgotten; its next turn starts anew."""

    def __init__(self, idle_ms: int | None = None):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("handoff", "pending array<string>, flag boolean")
        self.until = handle.getValueState("until", "at long") if self.idle_ms else None

    def handleInputRows(self, key, rows, timer_values) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values("seq", kind="stable").astype(object)
        batch = batch.where(batch.notna(), None)
        pending, flag = self.state.get() if self.state.exists() else ([], False)
        pending, out = list(pending or []), []
        for seq, request, cancel in zip(batch["seq"], batch["handoff"], batch["cancel"]):
            pending, flag, raised = fold_handoff(pending, flag, [(request, cancel)])
            out.append((key[0], key[1], int(seq), pending, flag, raised[0]))
        self.state.update((pending, flag))
        if self.until:
            at = int(max(pd.Timestamp(x).timestamp() for x in batch["ts"]) * 1000) + self.idle_ms
            old = self.until.get()[0] if self.until.exists() else None
            if old is None or at > old:
                if old is not None:
                    self.handle.deleteTimer(old)
                self.handle.registerTimer(at)
                self.until.update((at,))
        yield pd.DataFrame(out, columns=[f.name for f in HANDOFFS])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        if self.until:
            self.until.clear()
        yield pd.DataFrame([], columns=[f.name for f in HANDOFFS])

    def close(self) -> None:
        pass


def handoff_stream(turns: DataFrame, idle_minutes: int | None = None, late: str = "10 minutes") -> DataFrame:
    """Stream of handoff states for a stream of turns (``domain, session_token, seq, handoff, cancel``, and ``ts`` with
    ``idle_minutes``, after which a session's state goes; turns ``late`` behind the newest are dropped then)."""
    told = turns.filter("handoff IS NOT NULL OR cancel IS NOT NULL")
    if idle_minutes is None:
        return told.groupBy("domain", "session_token").transformWithStateInPandas(Handoffs(), HANDOFFS, "Append", "None")
    timed = told.withWatermark("ts", late).groupBy("domain", "session_token")
    return timed.transformWithStateInPandas(Handoffs(idle_minutes * 60_000), HANDOFFS, "Append", "EventTime")


def live_counts(rows: DataFrame) -> DataFrame:
    """Running count and latest time a domain, for update-mode sinks."""
    return rows.groupBy("domain").agg(F.count("*").alias("n"), F.max("ts").alias("latest"))


def crawl_progress(pages: DataFrame) -> DataFrame:
    """How far each crawl is: pages visited, their characters and the page fetched last, for update-mode sinks."""
    return pages.groupBy("domain").agg(
        F.count("*").alias("pages"), F.sum(F.coalesce(F.length("text"), F.lit(0))).alias("chars"), F.max_by("url", "page_seq").alias("url")
    )


def retained_logs(logs: DataFrame, now: dt.datetime, days: int = 30) -> DataFrame:
    """What compaction keeps of a log."""
    return logs.filter(F.col("created_at") >= F.lit(now) - F.expr(f"INTERVAL {int(days)} DAYS"))


class LogStore:
    """Logs by day: ``append`` for ``foreachBatch`` writes a batch into the folders of its days, a batch that is run again
    replaces its own files, and ``expire`` drops whole days without reading them.

    Rows without a time are kept under no day and never expire. ``rows`` gives what is not older than ``days`` to the moment.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, days: int = 30):
        self.spark, self.path, self.schema, self.days = spark, path.rstrip("/"), schema, days

    def append(self, logs: DataFrame, batch_id: int) -> None:
        placed = logs.withColumns({"day": F.to_date("created_at"), "batch": F.lit(batch_id)})
        placed.write.mode("overwrite").partitionBy("day", "batch").option("partitionOverwriteMode", "dynamic").parquet(self.path)

    def expire(self, now: dt.datetime) -> list[str]:
        """The days dropped: those of which no moment is within the last ``days`` days."""
        first = (now - dt.timedelta(days=self.days)).date().isoformat()
        old = [d for d in subfolders(self.spark, self.path) if d.startswith("day=") and d[4:] < first and not d.endswith("__")]
        for d in old:
            drop_folder(self.spark, f"{self.path}/{d}")
        return [d[4:] for d in old]

    def rows(self, now: dt.datetime) -> DataFrame:
        if not exists(self.spark, self.path):
            return self.spark.createDataFrame([], self.schema)
        stored = self.spark.read.schema(f"{self.schema}, day date, batch int").parquet(self.path)
        first = F.lit((now - dt.timedelta(days=self.days)).date())
        recent = stored.filter((F.col("day") >= first) | F.col("day").isNull())
        return recent.filter(F.col("created_at").isNull() | (F.col("created_at") >= F.lit(now) - F.expr(f"INTERVAL {int(self.days)} DAYS"))).drop("day", "batch")


def run_to_end(stream: DataFrame, checkpoint: str, mode: str, sink: Callable[[DataFrame, int], None]) -> None:
    """Run a stream over all that is there now, each micro-batch into ``sink``."""
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start()
    query.awaitTermination()
