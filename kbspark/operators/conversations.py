"""Conversation operators: reply signals, questions handed to the team, routing, history, outgoing messages."""

from __future__ import annotations

import re
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kbspark.functions.text import WS, trim

PAGE, HISTORY, SAME_QUESTION, LONG_MESSAGE = 20, 10, 0.6, 500


def _signal(name: str) -> str:
    return rf"\[{name}:{WS}*([^\]]+)\]{WS}*$"


def parse_signals(reply: Column) -> Column:
    """``struct<text, handoff, cancel, options_raw>``: signals at the end of a reply, taken off in the order
    request, cancel, options. One that is not at the end when its turn comes stays in the text."""
    text, found = reply, []
    for name in ("HANDOFF_REQUESTED", "HANDOFF_CANCEL", "OPTIONS"):
        found.append(F.nullif(trim(F.regexp_extract(text, _signal(name), 1)), F.lit("")))
        text = F.when(text.rlike(_signal(name)), F.regexp_replace(F.regexp_replace(text, _signal(name), ""), f"{WS}+$", "")).otherwise(text)
    return F.struct(text.alias("text"), found[0].alias("handoff"), found[1].alias("cancel"), found[2].alias("options_raw"))


def parse_options(raw: Column) -> Column:
    """Up to four non-empty choices of ``a | b | c``."""
    return F.slice(F.filter(F.transform(F.split(raw, r"\|"), trim), lambda x: x != ""), 1, 4)


def _question_words(q: Column) -> Column:
    words = F.split(F.regexp_replace(F.lower(q), r"[^a-z0-9\s]", ""), r"\s+")
    return F.array_distinct(F.filter(words, lambda w: w != ""))


def question_similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of the words of two questions; 1 where neither has any."""
    x, y = _question_words(a), _question_words(b)
    union = F.size(F.array_union(x, y))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(x, y)) / union)


def similar_questions(a: str, b: str) -> bool:
    words = lambda q: set(re.sub(r"[^a-z0-9\s]", "", q.lower()).split())
    x, y = words(a), words(b)
    return (len(x & y) / len(x | y) if x | y else 1.0) >= SAME_QUESTION


def fold_handoff(pending: list[str], flag: bool, turns: Iterable[tuple[str | None, str | None]]) -> tuple[list[str], bool, list[bool]]:
    """Open questions and flag after some turns of (request, cancel), and for each turn whether the flag
    rises. A cancel takes out the first equal question; a request adds its question unless a similar one is
    open. The rise is against the flag that was stored before the turn."""
    pending, raised = list(pending), []
    for request, cancel in turns:
        before = flag
        if cancel and cancel in pending:
            pending.remove(cancel)
        if cancel and not pending:
            flag = False
        if request:
            if not any(similar_questions(request, q) for q in pending):
                pending.append(request)
            flag = True
        raised.append(bool(request) and not before)
    return pending, flag, raised


HANDOFF_STATE = "domain string, session_token string, pending array<string>, handoff_pending boolean, notices long"


def handoff_state(turns: DataFrame) -> DataFrame:
    """The open questions of each session after all its turns (``domain, session_token, seq, handoff, cancel``).
    Only turns with a signal enter the fold."""
    told = turns.filter("handoff IS NOT NULL OR cancel IS NOT NULL").select("domain", "session_token", "seq", "handoff", "cancel")

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        g = group.sort_values("seq", kind="stable").astype(object).where(lambda x: x.notna(), None)
        pending, flag, raised = fold_handoff([], False, zip(g["handoff"], g["cancel"]))
        return pd.DataFrame([[g["domain"].iloc[0], g["session_token"].iloc[0], pending, flag, sum(raised)]], columns=[f.split(" ")[0] for f in HANDOFF_STATE.split(", ")])

    return told.groupBy("domain", "session_token").applyInPandas(fold, HANDOFF_STATE)


def apply_owner_reply(conversations: DataFrame, replies: DataFrame) -> DataFrame:
    """``conversations`` (``domain, session_token, pending array<string>, handoff_pending``) after owner replies
    (``domain, session_token, reply, answered array<string>``): answered questions go, the flag falls with the
    last one, and ``new_message`` holds the reply as an unseen message."""
    joined = conversations.join(replies, ["domain", "session_token"], "left")
    left = F.when(F.col("answered").isNull(), F.col("pending")).otherwise(F.filter("pending", lambda q: ~F.array_contains(F.col("answered"), q)))
    message = F.when(F.col("reply").isNotNull(), F.struct(F.lit("owner_reply").alias("role"), F.col("reply").alias("content"), F.lit(False).alias("seen_by_visitor")))
    return joined.withColumns({"pending": left, "new_message": message, "handoff_pending": F.col("handoff_pending") & (F.col("reply").isNull() | (F.size(left) > 0))}).drop("reply", "answered")


def select_model(church_mode: Column, message: Column, route: Column) -> Column:
    """``large`` for church mode, long messages and anything not classified as simple; else ``small``."""
    large = F.coalesce(church_mode, F.lit(False)) | (F.length(F.coalesce(message, F.lit(""))) > LONG_MESSAGE) | ~F.coalesce(route == "simple", F.lit(False))
    return F.when(large, "large").otherwise("small")


def had_context(context: Column, owner_context: Column) -> Column:
    filled = lambda c: F.coalesce(F.length(c) > 0, F.lit(False))
    return filled(context) | filled(owner_context)


def history_page(messages: DataFrame, before: DataFrame | None = None, size: int = PAGE) -> DataFrame:
    """The last ``size`` messages of each session, oldest first (``position``), with ``has_more``. ``before``
    (``domain, session_token, before``) holds cursors: only earlier messages count."""
    own = messages
    if before is not None:
        own = own.join(before, ["domain", "session_token"]).filter(F.col("ts") < F.col("before")).drop("before")
    per = Window.partitionBy("domain", "session_token")
    # One row more than the page tells whether there is another; no count over all messages is needed.
    back = own.withColumn("rn", F.row_number().over(per.orderBy(F.col("ts").desc(), F.col("seq").desc()))).filter(F.col("rn") <= size + 1)
    marked = back.withColumn("has_more", F.max("rn").over(per) > size).filter(F.col("rn") <= size)
    return marked.withColumn("position", F.row_number().over(per.orderBy(F.col("rn").desc()))).drop("rn")


def unseen_replies(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(owner replies that the visitor has not seen, all messages with those marked as seen)."""
    unseen = (F.col("role") == "owner_reply") & ~F.coalesce(F.col("seen_by_visitor"), F.lit(False))
    return messages.filter(unseen), messages.withColumn("seen_by_visitor", F.when(unseen, F.lit(True)).otherwise(F.col("seen_by_visitor")))


def last_messages(messages: DataFrame, n: int = HISTORY) -> DataFrame:
    """Each session's last ``n`` messages as an ordered array ``last`` of structs (seq, role, content, selected)."""
    back = Window.partitionBy("domain", "session_token").orderBy(F.col("seq").desc())
    cut = messages.withColumn("rn", F.row_number().over(back)).filter(F.col("rn") <= n)
    selected = F.col("selected") if "selected" in messages.columns else F.lit(None).cast("string")
    return cut.groupBy("domain", "session_token").agg(F.array_sort(F.collect_list(F.struct("seq", "role", "content", selected.alias("selected")))).alias("last"))


def transcripts(messages: DataFrame) -> DataFrame:
    """``(domain, session_token, transcript)``: the last ten messages as ``role: content`` lines."""
    line = lambda m: F.concat(F.when(m["role"] == "owner_reply", "team").otherwise(m["role"]), F.lit(": "), F.coalesce(m["content"], m["selected"], F.lit("")))
    return last_messages(messages).select("domain", "session_token", F.array_join(F.transform("last", line), "\n").alias("transcript"))


def clean_topic(s: Column) -> Column:
    return F.regexp_replace(F.lower(trim(s)), r"[^a-z0-9 ,]", "")


def chat_requests(turns: DataFrame, messages: DataFrame, tenants: DataFrame, template: str) -> DataFrame:
    """The request for each turn (``domain, session_token, text, context, pending array<string>, last_topic, at``):
    ``system`` from the template with the tenant's variables, local time and open questions, and ``messages``:
    context, acknowledgement, last ten messages, the visitor's text. No model is called."""
    joined = turns.join(tenants, "domain").join(last_messages(messages), ["domain", "session_token"], "left")
    filled = F.lit(template)
    values = {
        "[BUSINESS_NAME]": F.col("name"), "[CHURCH_MODE_ENABLED]": F.coalesce(F.col("church_mode"), F.lit(False)).cast("string"),
        "[AVG_WAIT_TIME]": F.coalesce(F.col("avg_wait_time"), F.lit("24 hours")) if "avg_wait_time" in tenants.columns else F.lit("24 hours"),
        "[PREVIOUS_TOPIC]": F.coalesce(F.col("last_topic"), F.lit("")),
    }
    for name, value in values.items():
        filled = F.replace(filled, F.lit(name), value)
    zone = F.coalesce(F.col("timezone"), F.lit("America/New_York"))
    now = F.concat(F.lit("\nNow ("), zone, F.lit("): "), F.date_format(F.from_utc_timestamp("at", zone), "EEEE, MMMM d, yyyy 'at' h:mm a"))
    questions = F.array_join(F.transform("pending", lambda q, i: F.concat((i + 1).cast("string"), F.lit(". "), q)), "\n")
    status = F.when(F.size("pending") > 0, F.concat(F.lit("\nHandoff status: ACTIVE\n"), questions)).otherwise("\nHandoff status: NONE")
    message = lambda role, content: F.struct(role.alias("role"), content.alias("content"))
    known = F.coalesce(F.length("context") > 0, F.lit(False))
    opening = F.array(
        message(F.lit("user"), F.when(known, F.concat(F.lit("Website content:\n\n"), F.col("context"))).otherwise("No website content matched.")),
        message(F.lit("assistant"), F.when(known, "Understood. I will use only that content.").otherwise("Understood. I will not guess.")),
    )
    past = F.transform(
        F.coalesce("last", F.array().cast("array<struct<seq:bigint,role:string,content:string,selected:string>>")),
        lambda m: message(
            F.when(m["role"] == "owner_reply", "assistant").otherwise(m["role"]),
            F.when(m["role"] == "owner_reply", F.concat(F.lit("[A team member replied]: "), m["content"])).otherwise(m["content"]),
        ),
    )
    visitor = F.array(message(F.lit("user"), F.col("text")))
    return joined.select("domain", "session_token", F.concat(filled, now, status).alias("system"), F.concat(opening, past, visitor).alias("messages"))


def notification_outbox(events: DataFrame, tenants: DataFrame, link: str = "") -> DataFrame:
    """One row a channel for each event (``domain, kind, session_token, text, reason, threshold, used, limit``):
    handoffs go to every contact that is set, quota notices to the tenant's channels (e-mail by default).

    Tenants have one row each. Events of no known domain: left out. Contact not set: no row for its channel. Null
    channels: e-mail; an empty list: none. Null text: empty preview; longer ones: 100 characters. Repeated events: a message each.
    Empty tables: empty result.
    """
    joined = events.join(tenants, "domain")
    both = F.array(F.lit("sms"), F.lit("email"))
    channels = F.when(F.col("kind") == "handoff", both).otherwise(F.coalesce("quota_alert_channels", F.array(F.lit("email"))))
    each = joined.withColumn("channel", F.explode(channels)).withColumn("recipient", F.when(F.col("channel") == "sms", F.col("owner_phone")).when(F.col("channel") == "email", F.col("owner_email")))
    preview = F.when(F.length("text") > 100, F.concat(F.substring("text", 1, 100), F.lit("…"))).otherwise(F.coalesce("text", F.lit("")))
    body = (
        F.when(F.col("kind") == "handoff", F.concat_ws("\n", F.concat(F.lit("Business: "), F.col("name")), F.concat(F.lit("Reason: "), F.col("reason")), F.concat(F.lit('Last message: "'), preview, F.lit('"')), F.concat(F.lit("Session: "), F.substring("session_token", 1, 10))))
        .when(F.col("kind") == "quota_warning", F.concat_ws("\n", F.concat(F.col("name"), F.lit(" has used "), F.col("threshold").cast("string"), F.lit("% of its plan.")), F.concat(F.col("used").cast("string"), F.lit(" of "), F.col("limit").cast("string"), F.lit(" messages"))))
        .otherwise(F.concat(F.col("name"), F.lit(" has reached its limit of "), F.col("limit").cast("string"), F.lit(" messages.")))
    )
    return each.filter("recipient IS NOT NULL").select("domain", "kind", "session_token", "channel", "recipient", F.concat_ws("\n", body, F.nullif(F.lit(link), F.lit(""))).alias("body"))


def parse_classifier(raw: Column) -> Column:
    """``struct<route, reason>`` from a model's answer; anything unreadable is complex, with the cause as reason."""
    part = F.regexp_extract(raw, r"(\{[^}]+\})", 1)
    parsed = F.from_json(part, "route string, reason string, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    bad = lambda why: F.struct(F.lit("complex").alias("route"), F.lit(why).alias("reason"))
    return (
        F.when(raw.isNull(), bad("classifier_error"))
        .when(part == "", bad("parse_failed"))
        .when(parsed["_bad"].isNotNull(), bad("classifier_error"))
        .when(~F.coalesce(parsed["route"].isin("simple", "complex"), F.lit(False)), bad("invalid_route"))
        .otherwise(F.struct(parsed["route"].alias("route"), F.coalesce(parsed["reason"], F.lit("")).alias("reason")))
    )
