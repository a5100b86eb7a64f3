"""Durations and calendar parts. Timestamps are compared in UTC microseconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from haulmark.functions.base import col_of


def seconds_between(start, end) -> Column:
    return (F.unix_micros(col_of(end)) - F.unix_micros(col_of(start))) / 1e6


def days_between(start, end) -> Column:
    return seconds_between(start, end) / 86400


def hours_between(start, end) -> Column:
    return seconds_between(start, end) / 3600


def durations(df):
    """Lead, slack against the promise, promised days, dispatch slack and the three stages."""
    return df.withColumns(
        {
            "lead_days": days_between("purchase_ts", "delivered_ts"),
            "days_vs_promise": days_between("promised_ts", "delivered_ts"),
            "promised_days": days_between("purchase_ts", "promised_ts"),
            "dispatch_slack_days": days_between("purchase_ts", "shipping_limit_ts"),
            "approval_days": days_between("purchase_ts", "approved_ts"),
            "dispatch_days": days_between("approved_ts", "carrier_ts"),
            "transport_days": days_between("carrier_ts", "delivered_ts"),
        }
    )


def calendar_parts(df, ts: str = "purchase_ts"):
    """Month, weekday with Monday as 0, hour, and the year-month label."""
    return df.withColumns(
        {
            "month": F.month(ts),
            "weekday": F.weekday(ts),
            "hour": F.hour(ts),
            "year_month": year_month(ts),
        }
    )


def year_month(ts) -> Column:
    return F.date_format(col_of(ts), "yyyy-MM")


def age_label(ts, now) -> Column:
    """Waiting time: hours below two days, else days; unreadable input is said so."""
    hours = hours_between(ts, now)
    return (
        F.when(hours.isNull(), "data ilegivel")
        .when(hours < 48, F.concat(F.bround(hours, 0).cast("long").cast("string"), F.lit(" h")))
        .otherwise(F.concat(F.bround(hours / 24, 0).cast("long").cast("string"), F.lit(" dias")))
    )


def coerce_timestamps(df, cols):
    """Text to timestamp; unreadable text becomes null."""
    return df.withColumns({c: F.try_to_timestamp(F.col(c).cast("string")) for c in cols})
