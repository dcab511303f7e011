"""Retry delays and outages, computed over a table of attempts.

An attempt row has the source's key (`entity_type`), an order (`seq`), a time (`ts`) and an `outcome`. A
source may own most of the attempts; numbering and counting cut such a source into stretches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import schemas as S
from ..functions import backoff_ms, jitter_ms, outage_breached
from .ordered import DEFAULT, PART, Layout, number_rows, scan


def _runs(attempts: DataFrame, layout: Layout) -> DataFrame:
    """`run` counts the answers before a row: failures between two answers share it."""
    return scan(attempts, layout, count_before={"run": F.col("outcome") != "transient"})


def outage_windows(attempts: DataFrame, layout: Layout = DEFAULT, limit_ms: int = S.MAX_OUTAGE_MS, as_of: int | None = None) -> DataFrame:
    """An outage starts at the first transient failure after an answer and ends at the next answer. One that has not ended
    counts up to its last failure, or up to the instant `as_of` (milliseconds)."""
    failed = F.col("outcome") == "transient"
    source = layout.by("entity_type")
    runs = _runs(attempts, source).groupBy("entity_type", "run").agg(
        F.count_if(failed).alias("n_failures"),
        F.min(F.when(failed, F.col("ts"))).alias("started"),
        F.max(F.when(failed, F.col("ts"))).alias("last_failure"),
        F.max(F.when(~failed, F.col("ts"))).alias("ended"))
    return runs.filter(F.col("n_failures") > 0).select(
        "entity_type", "started", "last_failure", "ended", "n_failures",
        outage_breached(F.col("started"), F.coalesce(F.col("ended"), F.col("last_failure") if as_of is None else F.lit(as_of)), limit_ms).alias("breached"))


def retry_schedule(attempts: DataFrame, layout: Layout = DEFAULT, *, doubling: bool = True,
                   base_ms: int = S.INITIAL_BACKOFF_MS, cap_ms: int = S.MAX_BACKOFF_MS) -> DataFrame:
    """The delay before the retry of each transient failure. With `doubling=False` it never grows, as in
    the system this replaces."""
    failed = F.col("outcome") == "transient"
    source = layout.by("entity_type")
    numbered = number_rows(_runs(attempts, source), "attempt", "run", source, where=failed)
    delay = backoff_ms(F.col("attempt") - 1, base_ms, cap_ms, doubling)
    return numbered.filter(failed).select(
        "record_id", "entity_type", "seq", "attempt", delay.alias("delay_ms"),
        jitter_ms(delay, F.col("seq")).alias("jittered_ms"))
