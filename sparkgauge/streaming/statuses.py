"""Status events of requests joined as streams: outer joins in event time, whose state goes with the watermark."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def reports(events: DataFrame, of: Column, key: str, late: str, name: str) -> DataFrame:
    """(<name>_key, <name>_t, <name>, <name>_us): one report of each status of a request, the first to come, within the watermark.

    All events move the watermark, not those of one status: the condition holds `t`, so that it stays behind the watermark.
    """
    x = events.withWatermark("t", late).where(F.when(of & F.col(key).isNotNull(), F.col("t")).isNotNull()).dropDuplicatesWithinWatermark([key, "status"])
    return x.select(F.col(key).alias(f"{name}_key"), F.col("t").alias(f"{name}_t"), F.col("status").alias(f"{name}_status"), F.unix_micros("t").alias(f"{name}_us"))


def within(first: str, then: str, most: str) -> Column:
    """Rows of one request, `then` at most `most` after `first`."""
    span = F.expr(f"INTERVAL {most}")
    return (F.col(f"{first}_key") == F.col(f"{then}_key")) & (F.col(f"{then}_t") >= F.col(f"{first}_t")) & (F.col(f"{then}_t") <= F.col(f"{first}_t") + span)


def live_status_times(events: DataFrame, statuses: Sequence[str], key: str = "request_id", late: str = "10 seconds", most: str = "1 hour") -> DataFrame:
    """(key, a column of microseconds for each status, status) of each request with the first of the statuses, from a stream of (key, status, t).

    The rows are those of `lifecycle.status_times`: null for a status that was not reported, and the status
    reported last, of two at one time the later in `statuses`. A row that misses a status comes out once the
    watermark, `late` behind the latest event, has passed the first status by `most`; events older than the
    watermark are not seen, nor are others than the first report of a status, and one more than `most` after the first
    status counts as missing. Nulls in key, status or t are left out.
    """
    first, *later = statuses
    x = reports(events, F.col("status") == first, key, late, "s0")
    for k, status in enumerate(later, 1):
        x = x.join(reports(events, F.col("status") == status, key, late, f"s{k}"), within("s0", f"s{k}", most), "left_outer").drop(f"s{k}_key", f"s{k}_t")
    told = F.array(*(F.when(F.col(f"s{k}_us").isNotNull(), F.struct(F.col(f"s{k}_us").alias("us"), F.lit(k).alias("k"))) for k in range(len(statuses))))
    last = F.get(F.array(*map(F.lit, statuses)), F.array_max(told)["k"])
    return x.select(F.col("s0_key").alias(key), *(F.col(f"s{k}_us").alias(s) for k, s in enumerate(statuses)), last.alias("status"))


def live_orphans(events: DataFrame, statuses: Sequence[str], key: str = "request_id", late: str = "10 seconds", most: str = "1 hour") -> DataFrame:
    """(key, status, t_us): reports of the later statuses with no first status up to `most` before them; what `live_status_times` leaves out."""
    first, *later = statuses
    x = reports(events, F.col("status").isin(*later), key, late, "e")
    x = x.join(reports(events, F.col("status") == first, key, late, "s0"), within("s0", "e", most), "left_outer")
    return x.where(F.col("s0_us").isNull()).select(F.col("e_key").alias(key), F.col("e_status").alias("status"), F.col("e_us").alias("t_us"))
