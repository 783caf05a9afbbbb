"""Workload over all tenants: visitors' questions through quota, retrieval and routing, up to the model call."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kbspark.operators.conversations import had_context, select_model
from kbspark.operators.metering import LIMIT, quota_outcome
from kbspark.operators.retrieval import FLOOR, OFFSET, THRESHOLD, retrieve


def answered_turns(turns: DataFrame, metered: DataFrame, chunks: DataFrame, tenants: DataFrame, limit: int = LIMIT, default: float = THRESHOLD, offset: float = OFFSET, floor: float = FLOOR) -> DataFrame:
    """``(query_id, domain, accepted, had_context, model)`` for each turn (``query_id, domain, vector, route, text``).

    ``metered`` has the same turns as messages. Blocked turns go no further: they have no context and no model,
    and cost no retrieval.
    """
    outcome = quota_outcome(metered, limit).select(F.col("message_id").alias("query_id"), "accepted")
    known = turns.join(outcome, "query_id")
    asked = known.filter("accepted")
    found = retrieve(asked.select("query_id", "domain", "vector"), chunks, tenants, default=default, offset=offset, floor=floor)
    church = F.lit(False)
    routed = asked.join(found.drop("domain"), "query_id").select(
        "query_id", had_context(F.col("context"), F.col("owner_context")).alias("had_context"), select_model(church, F.col("text"), F.col("route")).alias("model")
    )
    return known.join(routed, "query_id", "left").select("query_id", "domain", "accepted", "had_context", "model")
