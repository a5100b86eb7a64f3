"""Views over the append-only audit log of processed messages and quote events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulmark.functions.requests import classify_reason
from haulmark.functions.times import age_label
from haulmark.operators.ordering import top_k
from haulmark.sources.quoting_inputs import OUTCOMES

# States a quote can take.
QUOTE_STATES = ["SENT", "ACCEPTED", "REJECTED"]


def latest_extraction(log: DataFrame) -> DataFrame:
    """Last stored extraction of each thread; an aggregate, so a busy thread is combined early."""
    order = F.struct("criado_em", "id_email")
    return (
        log.filter("extracao_json IS NOT NULL")
        .groupBy("thread_id")
        .agg(F.max_by("extracao_json", order).alias("extracao_json"), F.max(order)["id_email"].alias("id_email"))
    )


def latest_n(log: DataFrame, n: int = 50) -> DataFrame:
    return top_k(log, [F.desc("criado_em"), F.desc("id_email")], n)


def by_label(log: DataFrame, label: str) -> DataFrame:
    return log.filter(F.col("label") == label).orderBy(F.desc("criado_em"), F.desc("id_email"))


def thread_ids(log: DataFrame, thread, label: str | None = None) -> DataFrame:
    rows = log.filter(F.col("thread_id") == thread)
    return (rows if label is None else rows.filter(F.col("label") == label)).select("id_email")


def outcome_counts(log: DataFrame, day: str | None = None, outcomes=OUTCOMES) -> DataFrame:
    """Messages per outcome, zero where there are none, optionally of one UTC day.

    The day is a range on the raw column, so it reaches the scan.
    """
    if day is not None:
        start = F.to_timestamp(F.lit(day))
        log = log.filter((F.col("criado_em") >= start) & (F.col("criado_em") < start + F.expr("INTERVAL 1 DAY")))
    counted = log.groupBy("desfecho").agg(F.count("*").alias("n"))
    names = log.sparkSession.createDataFrame([(o,) for o in outcomes], "desfecho string")
    return names.join(counted, "desfecho", "left").select("desfecho", F.coalesce("n", F.lit(0)).alias("n"))


def review_queue_summary(log: DataFrame, now: str, label: str = "IA/Revisar") -> DataFrame:
    """Messages that wait for a person, by motive, with the oldest and its age."""
    queue = log.filter(F.col("label") == label).withColumn("motive", classify_reason("erro"))
    out = queue.groupBy("motive").agg(F.count("*").alias("n"), F.min("criado_em").alias("oldest"))
    return out.withColumn("waiting", age_label("oldest", F.to_timestamp(F.lit(now))))


def requeue(log: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Tombstones that give messages back to the queue: all errors, or the listed ids."""
    rows = log.filter("desfecho = 'erro'") if ids is None else log.join(ids.select("id_email").distinct(), "id_email", "left_semi")
    return rows.select("id_email", F.lit("requeue").alias("event"))


def without_requeued(log: DataFrame, tombstones: DataFrame) -> DataFrame:
    return log.join(tombstones.select("id_email").distinct(), "id_email", "left_anti")


def quote_state(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Current state of each quote from its valid events, and the rejected events.

    Acceptance needs a positive price, a cost may not be negative, and a change needs a
    quote that was sent. Events: quote_id, event_type, price, cost, at, event_id.
    """
    c = F.col
    sent = events.filter("event_type = 'SENT'").select("quote_id").distinct().withColumn("_sent", F.lit(True))
    judged = events.join(sent, "quote_id", "left").withColumn(
        "problem",
        F.when(~c("event_type").isin(*QUOTE_STATES), "unknown event")
        .when(c("_sent").isNull(), "quote not found")
        .when((c("event_type") == "ACCEPTED") & ~F.coalesce(c("price") > 0, F.lit(False)), "price must be positive")
        .when(F.coalesce(c("cost") < 0, F.lit(False)), "cost must not be negative"),
    )
    fields = F.struct("event_type", "price", "cost", "at")
    state = (
        judged.filter("problem IS NULL")
        .groupBy("quote_id")
        .agg(F.max_by(fields, F.struct("at", "event_id")).alias("s"), F.count("*").alias("events"))
        .select(
            "quote_id",
            c("s.event_type").alias("status"),
            F.when(c("s.event_type") == "ACCEPTED", c("s.price")).alias("contracted_price"),
            F.when(c("s.event_type") != "SENT", c("s.cost")).alias("actual_cost"),
            F.when(c("s.event_type") == "ACCEPTED", c("s.at")).alias("accepted_at"),
            F.when(c("s.event_type") == "REJECTED", c("s.at")).alias("rejected_at"),
            "events",
        )
    )
    return state, judged.filter("problem IS NOT NULL").drop("_sent")
