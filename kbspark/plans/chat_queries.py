"""Queries over conversations, metering and billing state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kbspark.operators import conversations as cv
from kbspark.operators import metering as mt
from kbspark.plans import views
from kbspark.plans.views import MESSAGES, METERED, PAYMENTS, SIGNALLED, TENANTS
from kbspark.sources.tables import table

QUERIES: dict = {}
ORACLES: dict = {}
LIMIT = 30


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def stamp(c: str, name: str | None = None):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(name or c)


_SIG = {n: rf"\[{n}:\s*([^\]]+)\]\s*$" for n in ("HANDOFF_REQUESTED", "HANDOFF_CANCEL", "OPTIONS")}


def _take(name: str, source: str, text: str, out: str) -> str:
    return f"""SELECT * REPLACE (CASE WHEN regexp_matches(r, '{_SIG[name]}') THEN regexp_replace(regexp_replace(r, '{_SIG[name]}', ''), '\\s+$', '') ELSE r END AS r),
      nullif(trim(regexp_extract(r, '{_SIG[name]}', 1)), '') AS {out} FROM {source}"""


@query(f"""WITH {MESSAGES}, {SIGNALLED}, s0 AS (SELECT session_token, seq, reply AS r FROM signalled), s1 AS ({_take('HANDOFF_REQUESTED', 's0', 'r', 'handoff')}),
s2 AS ({_take('HANDOFF_CANCEL', 's1', 'r', 'cancel')}), s3 AS ({_take('OPTIONS', 's2', 'r', 'raw')})
SELECT session_token, seq, r AS text, handoff, cancel, coalesce(array_to_string(list_filter(list_transform(string_split(raw, '|'), lambda x: trim(x)), lambda x: x <> '')[1:4], ';'), '') AS options FROM s3""")
def m_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.signalled(spark, sf_dir).withColumn("s", cv.parse_signals(F.col("reply")))
    return rows.select("session_token", "seq", "s.text", "s.handoff", "s.cancel", F.coalesce(F.array_join(cv.parse_options(F.col("s.options_raw")), ";"), F.lit("")).alias("options"))


_W = "list_distinct(list_filter(string_split_regex(regexp_replace(lower({}), '[^a-z0-9\\s]', '', 'g'), '\\s+'), lambda w: w <> ''))"


@query(f"""WITH {MESSAGES}, p AS (SELECT session_token, seq, {_W.format('content')} AS a, {_W.format('lag(content) OVER (PARTITION BY session_token ORDER BY seq)')} AS b FROM messages)
SELECT session_token, seq, round(CASE WHEN len(list_distinct(a || b)) = 0 THEN 1.0 ELSE len(list_intersect(a, b)) / len(list_distinct(a || b)) END, 6) AS similarity FROM p WHERE b IS NOT NULL""")
def m_question_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = views.messages(spark, sf_dir).withColumn("before", F.lag("content").over(Window.partitionBy("session_token").orderBy("seq"))).filter("before IS NOT NULL AND content IS NOT NULL")
    return m.select("session_token", "seq", F.round(cv.question_similarity(F.col("content"), F.col("before")), 6).alias("similarity"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = views.signalled(spark, sf_dir).withColumn("s", cv.parse_signals(F.col("reply")))
    return s.select("domain", "session_token", "seq", "s.handoff", "s.cancel")


def _near(a: str, b: str) -> str:
    x, y = _W.format(a), _W.format(b)
    return f"CASE WHEN len(list_distinct({x} || {y})) = 0 THEN true ELSE len(list_intersect({x}, {y})) / len(list_distinct({x} || {y})) >= 0.6 END"


#: One row for each turn with a signal, and one before the first: the turn's questions follow from those before it.
FOLD = f"""{MESSAGES}, {SIGNALLED}, s0 AS (SELECT domain, session_token, seq, reply AS r FROM signalled), s1 AS ({_take('HANDOFF_REQUESTED', 's0', 'r', 'handoff')}), s2 AS ({_take('HANDOFF_CANCEL', 's1', 'r', 'cancel')}),
told AS (SELECT *, row_number() OVER (PARTITION BY domain, session_token ORDER BY seq) AS k FROM s2 WHERE handoff IS NOT NULL OR cancel IS NOT NULL),
fold AS (SELECT domain, session_token, CAST(NULL AS BIGINT) AS seq, CAST(0 AS BIGINT) AS k, CAST([] AS VARCHAR[]) AS open, false AS flag, false AS notice FROM told WHERE k = 1
  UNION ALL SELECT domain, session_token, seq, k, CASE WHEN handoff IS NULL OR len(list_filter(left_open, lambda q: {_near('handoff', 'q')})) > 0 THEN left_open ELSE list_append(left_open, handoff) END,
    handoff IS NOT NULL OR (flag AND NOT (cancel IS NOT NULL AND len(left_open) = 0)), handoff IS NOT NULL AND NOT flag
  FROM (SELECT t.domain, t.session_token, t.seq, t.k, t.handoff, t.cancel, f.flag, CASE WHEN list_contains(f.open, t.cancel) THEN f.open[1:list_position(f.open, t.cancel) - 1] || f.open[list_position(f.open, t.cancel) + 1:] ELSE f.open END AS left_open
    FROM fold f JOIN told t ON t.domain = f.domain AND t.session_token = f.session_token AND t.k = f.k + 1))"""


@query(f"""WITH RECURSIVE {FOLD} SELECT domain, session_token, array_to_string(arg_max(open, k), ';') AS pending, arg_max(flag, k) AS handoff_pending, count(*) FILTER (notice) AS notices FROM fold GROUP BY 1, 2""")
def m_handoff_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cv.handoff_state(turns(spark, sf_dir)).withColumn("pending", F.array_join("pending", ";"))


@query(f"""WITH {MESSAGES}, c AS (SELECT domain, session_token, min(conv_id) AS conv_id FROM messages GROUP BY 1, 2),
r AS (SELECT *, CASE WHEN conv_id % 2 = 0 THEN 'done' END AS reply, CASE conv_id % 4 WHEN 0 THEN ['q1'] WHEN 2 THEN ['q1', 'q2'] END AS answered FROM c)
SELECT domain, session_token, array_to_string(list_filter(['q1', 'q2'], lambda q: answered IS NULL OR NOT list_contains(answered, q)), ',') AS pending,
  reply IS NULL OR conv_id % 4 = 0 AS handoff_pending, reply AS new_content FROM r""")
def m_owner_reply(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = views.messages(spark, sf_dir).groupBy("domain", "session_token").agg(F.min("conv_id").alias("n"))
    open_ = c.select("domain", "session_token", F.array(F.lit("q1"), F.lit("q2")).alias("pending"), F.lit(True).alias("handoff_pending"))
    answered = F.when(F.col("n") % 4 == 0, F.array(F.lit("q1"))).otherwise(F.array(F.lit("q1"), F.lit("q2")))
    replies = c.filter("n % 2 = 0").select("domain", "session_token", F.lit("done").alias("reply"), answered.alias("answered"))
    rows = cv.apply_owner_reply(open_, replies)
    return rows.select("domain", "session_token", F.array_join("pending", ",").alias("pending"), "handoff_pending", F.col("new_message.content").alias("new_content"))


@query(f"""WITH {MESSAGES} SELECT session_token, seq, CASE WHEN conv_id % 4 = 0 OR length(coalesce(content, '')) > 500 OR route IS DISTINCT FROM 'simple' THEN 'large' ELSE 'small' END AS model,
  coalesce(length(content) > 0, false) OR conv_id % 2 = 0 AS had_context FROM messages""")
def m_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = views.messages(spark, sf_dir)
    own = F.when(F.col("conv_id") % 2 == 0, "reply")
    return m.select("session_token", "seq", cv.select_model(F.col("conv_id") % 4 == 0, F.col("content"), F.col("route")).alias("model"), cv.had_context(F.col("content"), own).alias("had_context"))


@query(f"""WITH {MESSAGES}, c AS (SELECT *, row_number() OVER (PARTITION BY domain, session_token ORDER BY ts DESC, seq DESC) AS rn, count(*) OVER (PARTITION BY domain, session_token) AS n
  FROM messages WHERE ts < TIMESTAMP '2024-01-01' + to_hours(conv_id) + INTERVAL 5 MINUTE)
SELECT session_token, seq, n > 2 AS has_more, row_number() OVER (PARTITION BY session_token ORDER BY rn DESC) AS position FROM c WHERE rn <= 2""")
def m_history_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = views.messages(spark, sf_dir)
    cursors = m.groupBy("domain", "session_token").agg((F.min("ts") - F.make_dt_interval(mins=F.min("seq").cast("int")) + F.expr("INTERVAL 5 MINUTES")).alias("before"))
    return cv.history_page(m, cursors, size=2).select("session_token", "seq", "has_more", F.col("position").cast("long").alias("position"))


@query(f"""WITH {MESSAGES} SELECT domain, count(*) FILTER (role = 'assistant') AS unseen FROM messages GROUP BY 1""")
def m_unseen_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = views.messages(spark, sf_dir).withColumn("role", F.when(F.col("role") == "assistant", "owner_reply").otherwise(F.col("role")))
    unseen, marked = cv.unseen_replies(m)
    return marked.groupBy("domain").agg(F.count_if("seen_by_visitor").alias("unseen")).join(unseen.groupBy("domain").agg(F.count("*").alias("n")), "domain", "left").select("domain", "unseen")


@query(f"""WITH {MESSAGES}, l AS (SELECT *, row_number() OVER (PARTITION BY domain, session_token ORDER BY seq DESC) AS rn FROM messages)
SELECT session_token, string_agg(role || ': ' || coalesce(content, ''), chr(10) ORDER BY seq) AS transcript FROM l WHERE rn <= 10 GROUP BY domain, session_token""")
def m_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cv.transcripts(views.messages(spark, sf_dir)).select("session_token", "transcript")


@query(f"WITH {MESSAGES} SELECT session_token, seq, regexp_replace(lower(trim(content, ' ' || chr(9) || chr(10) || chr(13))), '[^a-z0-9 ,]', '', 'g') AS topic FROM messages")
def m_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.messages(spark, sf_dir).select("session_token", "seq", cv.clean_topic(F.col("content")).alias("topic"))


@query(f"""WITH RECURSIVE {FOLD}, state AS (SELECT domain, session_token, arg_max(open, k) AS open FROM fold GROUP BY 1, 2),
asked AS (SELECT * FROM messages WHERE role = 'user' QUALIFY row_number() OVER (PARTITION BY domain, session_token ORDER BY seq DESC) = 1),
past AS (SELECT domain, session_token, least(count(*), 10) AS n FROM messages GROUP BY 1, 2)
SELECT a.session_token, 'You answer for ' || upper(a.domain) || '. Wait: 24 hours.' || chr(10) || 'Now (America/New_York): ' || strftime(a.ts AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York', '%A, %B %-d, %Y at %-I:%M %p') || chr(10) || 'Handoff status: '
  || CASE WHEN len(open) > 0 THEN 'ACTIVE' || chr(10) || array_to_string(list_transform(open, lambda q, i: i || '. ' || q), chr(10)) ELSE 'NONE' END AS system, CAST(p.n + 3 AS INTEGER) AS n_messages, a.content AS last
FROM asked a JOIN past p USING (domain, session_token) LEFT JOIN state s USING (domain, session_token)""")
def m_chat_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = views.messages(spark, sf_dir)
    last = Window.partitionBy("domain", "session_token").orderBy(F.col("seq").desc())
    asked = m.filter("role = 'user'").withColumn("rn", F.row_number().over(last)).filter("rn = 1")
    state = cv.handoff_state(turns(spark, sf_dir)).select("domain", "session_token", "pending")
    asked = asked.join(state, ["domain", "session_token"], "left")
    rows = asked.select("domain", "session_token", F.col("content").alias("text"), F.lit("").alias("context"), F.coalesce("pending", F.array().cast("array<string>")).alias("pending"), F.lit(None).cast("string").alias("last_topic"), F.col("ts").alias("at"))
    owners = m.select("domain").distinct().select("domain", F.upper("domain").alias("name"), F.lit(None).cast("string").alias("timezone"), F.lit(False).alias("church_mode"))
    made = cv.chat_requests(rows, m, owners, "You answer for [BUSINESS_NAME]. Wait: [AVG_WAIT_TIME].")
    return made.select("session_token", "system", F.size("messages").alias("n_messages"), F.element_at("messages", -1)["content"].alias("last"))


@query(f"""WITH {TENANTS}, ev AS (SELECT *, CASE k % 3 WHEN 0 THEN 'handoff' WHEN 1 THEN 'quota_warning' ELSE 'quota_exceeded' END AS kind, repeat('x', CAST(k % 150 AS INTEGER)) AS text FROM tenants),
e AS (SELECT *, unnest(CASE WHEN kind = 'handoff' THEN ['sms', 'email'] ELSE coalesce(quota_alert_channels, ['email']) END) AS channel FROM ev)
SELECT domain, kind, channel, CASE channel WHEN 'sms' THEN owner_phone ELSE owner_email END AS recipient,
  CASE kind WHEN 'handoff' THEN 'Business: ' || name || chr(10) || 'Reason: asked' || chr(10) || 'Last message: "' || CASE WHEN length(text) > 100 THEN left(text, 100) || '…' ELSE text END || '"' || chr(10) || 'Session: session-ab'
    WHEN 'quota_warning' THEN name || ' has used 75% of its plan.' || chr(10) || '75 of 100 messages' ELSE name || ' has reached its limit of 100 messages.' END AS body
FROM e WHERE CASE channel WHEN 'sms' THEN owner_phone ELSE owner_email END IS NOT NULL""")
def m_notification_outbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    owners = views.tenants(spark, sf_dir)
    k = F.col("k")
    events = owners.select(
        "domain", F.when(k % 3 == 0, "handoff").when(k % 3 == 1, "quota_warning").otherwise("quota_exceeded").alias("kind"), F.lit("session-abcdef").alias("session_token"),
        F.repeat(F.lit("x"), (k % 150).cast("int")).alias("text"), F.lit("asked").alias("reason"), F.lit(75).alias("threshold"), F.lit(75).alias("used"), F.lit(100).alias("limit"),
    )
    return cv.notification_outbox(events, owners).select("domain", "kind", "channel", "recipient", "body")


_RAW = """CASE event_id % 5 WHEN 0 THEN '{"route": "simple", "reason": "hours"}' WHEN 1 THEN 'Sure: {"route": "complex"} ok' WHEN 2 THEN 'no json' WHEN 3 THEN '{"route": "other"}' ELSE '{"route": simple' || '}' END"""


@query("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'simple' ELSE 'complex' END AS route,
  CASE event_id % 5 WHEN 0 THEN 'hours' WHEN 1 THEN '' WHEN 2 THEN 'parse_failed' WHEN 3 THEN 'invalid_route' ELSE 'classifier_error' END AS reason FROM events""")
def m_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", F.expr(_RAW).alias("raw"))
    return e.withColumn("c", cv.parse_classifier(F.col("raw"))).select("event_id", "c.route", "c.reason")


_RESET = "CAST(date_trunc('month', {0}) + INTERVAL 1 MONTH + to_days(CAST(day({0}) - 1 AS INTEGER)) AS DATE)"


@query(f"""WITH RECURSIVE {METERED}, days AS (SELECT DISTINCT domain, CAST(ts AS DATE) AS day FROM metered),
starts AS (SELECT domain, min(day) AS day FROM days GROUP BY 1
  UNION ALL SELECT s.domain, min(d.day) FROM starts s JOIN days d ON d.domain = s.domain AND d.day >= {_RESET.format('s.day')} GROUP BY s.domain, s.day)
SELECT m.domain, strftime(s.day, '%Y-%m-%d') AS period_start, strftime({_RESET.format('s.day')}, '%Y-%m-%d') AS reset_on, count(*) AS messages
FROM metered m JOIN starts s ON m.domain = s.domain AND CAST(m.ts AS DATE) >= s.day AND CAST(m.ts AS DATE) < {_RESET.format('s.day')} GROUP BY m.domain, s.day""")
def q_billing_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mt.billing_periods(views.metered(spark, sf_dir))
    return rows.groupBy("domain", F.col("period_start").cast("string").alias("period_start"), F.col("reset_on").cast("string").alias("reset_on")).agg(F.count("*").alias("messages"))


@query("""SELECT DISTINCT strftime(o_orderdate, '%Y-%m-%d') AS day, strftime(date_trunc('month', o_orderdate) + INTERVAL 1 MONTH + to_days(CAST(day(o_orderdate) - 1 AS INTEGER)), '%Y-%m-%d') AS reset_on FROM orders""")
def q_next_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.to_date("o_orderdate")
    return table(spark, sf_dir, "orders").select(day.cast("string").alias("day"), mt.next_reset(day).cast("string").alias("reset_on")).distinct()


QUOTA = f"""{METERED}, ranked AS (SELECT *, date_trunc('month', ts) AS period, row_number() OVER (PARTITION BY domain, date_trunc('month', ts) ORDER BY ts, message_id) AS rn FROM metered),
outcome AS (SELECT *, plan <> 'free' OR rn <= {LIMIT} AS accepted, plan = 'free' AND rn = {LIMIT} + 1 AS notice FROM ranked)"""


def outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mt.quota_outcome(mt.calendar_periods(views.metered(spark, sf_dir)), LIMIT)


@query(f"WITH {QUOTA} SELECT message_id, CASE WHEN rn <= {LIMIT} + 1 THEN rn END AS rn, accepted, notice FROM outcome")
def q_quota_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outcome(spark, sf_dir).select("message_id", F.col("rn").cast("long").alias("rn"), "accepted", "notice")


@query(f"WITH {QUOTA} SELECT domain, count(*) FILTER (accepted) AS accepted, count(*) FILTER (NOT accepted) AS blocked FROM outcome GROUP BY domain, period")
def q_blocked_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mt.blocked_counts(mt.calendar_periods(views.metered(spark, sf_dir)), LIMIT).select("domain", "accepted", "blocked")


@query(f"""WITH {QUOTA}, w AS (SELECT message_id, unnest(CASE WHEN CAST(domain AS INTEGER) % 2 = 0 THEN [10, 95, 100] ELSE [50, 75, 90] END) AS threshold, rn FROM outcome WHERE accepted AND plan = 'free')
SELECT message_id, CAST(max(threshold) AS INTEGER) AS threshold FROM w WHERE rn = ceil({LIMIT} * threshold / 100) GROUP BY 1""")
def q_quota_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = views.metered(spark, sf_dir).select("domain").distinct().filter(F.col("domain").cast("int") % 2 == 0).withColumn("thresholds", F.array(F.lit(10), F.lit(95), F.lit(100)))
    return mt.quota_warnings(outcome(spark, sf_dir), own, LIMIT).select("message_id", "threshold")


_LAST = "last_value(CASE WHEN {set} THEN coalesce({value}, '~') END IGNORE NULLS) OVER (PARTITION BY domain ORDER BY seq)"


def _state(cases: list[tuple[str, str]], name: str) -> str:
    value = "CASE " + " ".join(f"WHEN {c} THEN coalesce({v}, '~')" for c, v in cases) + " END"
    return f"nullif(last_value({value} IGNORE NULLS) OVER (PARTITION BY domain ORDER BY seq), '~') AS {name}"


_CHECK = "type = 'checkout' AND NOT addon"
HISTORY = f"""{TENANTS}, {PAYMENTS}, direct AS (SELECT * FROM payments WHERE type <> 'payment_failed' AND domain IN (SELECT domain FROM tenants)),
owned AS (SELECT f.seq, arg_max(n.domain, n.seq) AS domain FROM payments f JOIN direct n ON f.customer = n.customer AND n.type = 'checkout' AND n.seq < f.seq WHERE f.type = 'payment_failed' GROUP BY 1),
evs AS (SELECT * FROM direct UNION ALL BY NAME SELECT f.* REPLACE (o.domain AS domain) FROM payments f JOIN owned o USING (seq)),
history AS (SELECT domain, seq, ts,
  {_state([(f"{_CHECK} AND mode = 'payment'", "'lifetime'"), (f"{_CHECK} AND mode = 'subscription'", "'infinity'"), ("type = 'updated' AND status = 'active'", "'infinity'"), ("type = 'deleted' AND NOT addon", "'free'")], 'plan')},
  {_state([(f"{_CHECK} AND mode = 'payment'", "'active'"), (f"{_CHECK} AND mode = 'subscription'", "status"), ("type = 'updated'", "status"), ("type = 'deleted' AND NOT addon", "'canceled'"), ("type = 'payment_failed'", "'past_due'")], 'plan_status')},
  {_state([("type = 'checkout'", "customer")], 'customer')}, {_state([("type = 'checkout' AND addon", "'on'"), ("type = 'deleted' AND addon", "'off'")], 'addon')} FROM evs)"""


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mt.plan_history(views.payment_events(spark, sf_dir), views.tenants(spark, sf_dir))


@query(f"WITH {HISTORY} SELECT domain, seq, plan, plan_status, customer, addon FROM history")
def q_plan_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history(spark, sf_dir).select("domain", "seq", "plan", "plan_status", "customer", "addon")


@query(f"""WITH {HISTORY}, h AS (SELECT domain, ts, arg_max(plan, seq) AS plan FROM (SELECT domain, ts, seq, coalesce(plan, '~') AS plan FROM history) GROUP BY 1, 2),
asks AS (SELECT 'c' || o_custkey AS domain, o_orderkey AS message_id, o_orderdate + INTERVAL 3 DAY AS ts FROM orders)
SELECT a.message_id, coalesce(nullif(h.plan, '~'), 'free') AS plan FROM asks a ASOF LEFT JOIN h ON a.domain = h.domain AND a.ts >= h.ts""")
def q_as_of_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    asks = o.select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("domain"), F.col("o_orderkey").alias("message_id"), (F.col("o_orderdate").cast("timestamp") + F.expr("INTERVAL 3 DAYS")).alias("ts"))
    return mt.as_of_plan(asks, history(spark, sf_dir)).select("message_id", "plan")


@query(f"""WITH {METERED}, u AS (SELECT domain, count(*) AS used, CAST(CAST(domain AS INTEGER) % 28 + 1 AS INTEGER) AS days_elapsed FROM metered GROUP BY 1)
SELECT domain, round(used / days_elapsed * 30, 6) AS projected, CASE WHEN days_elapsed < 3 THEN 'gray' WHEN used / days_elapsed * 30 < 90 THEN 'green' WHEN used / days_elapsed * 30 <= 110.00000000000001 THEN 'yellow' ELSE 'red' END AS light FROM u""")
def d_usage_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = views.metered(spark, sf_dir).groupBy("domain").agg(F.count("*").alias("used"))
    usage = used.withColumns({"days_elapsed": (F.col("domain").cast("int") % 28 + 1), "days_in_period": F.lit(30)})
    return mt.usage_projection(usage).select("domain", F.round("projected", 6).alias("projected"), "light")


@query(f"""WITH {MESSAGES} SELECT DISTINCT domain, session_token FROM messages WHERE conv_id % 2 = 0 AND TIMESTAMP '2024-01-01' + to_hours(conv_id) <= TIMESTAMP '2024-01-02'""")
def d_handoff_followups(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kbspark.operators.scans import handoff_followups

    m = views.messages(spark, sf_dir)
    start = F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_dt_interval(hours=F.min("conv_id").cast("int"))
    c = m.groupBy("domain", "session_token").agg((F.min("conv_id") % 2 == 0).alias("handoff_pending"), start.alias("last_notified_at"))
    return handoff_followups(c, F.lit("2024-01-03 00:00:00").cast("timestamp")).select("domain", "session_token")
