"""Counters over decided rows. One aggregate pass gives all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import schemas as S

_CDC = ("invalid", "forwarded", "command", "gap_dropped", *S.DECIDED_BUFFERED)
_FILL = ("filled", "forced", "fill_ignored", "fill_error", "fill_invalid")


def _of(*decisions: str) -> Column:
    return F.count_if(F.col("decision").isin(*decisions))


def counter_columns() -> dict[str, Column]:
    """Counter name -> aggregate over `decision`; also usable in `DataFrame.observe` on a stream."""
    return {
        S.RECEIVED: F.count_if(F.col("decision").isin(*_CDC)),
        S.FORWARDED: _of("forwarded"),
        S.BUFFER_DROPPED: _of("dropped"),
        S.BUFFER_FLUSHED: _of("flushed"),
        S.BUFFERED: _of(*S.DECIDED_BUFFERED),
        S.FILLED: _of("filled", "forced"),
        S.GAP_DETECTED: _of("command", "gap_dropped"),
        S.GAP_DROPPED: _of("gap_dropped"),
        S.COMMAND_PUBLISHED: _of("command"),
        S.COMMAND_TIMEOUT: _of("gap_failed"),
        S.FILL_RECEIVED: _of(*_FILL),
    }


def arrival_counters() -> dict[str, Column]:
    """The same counters over streamed decision rows, where a held-back row appears once as `buffered` on
    arrival and once more when its gap ends."""
    return {
        **counter_columns(),
        S.RECEIVED: F.count_if(F.col("decision").isin("invalid", "forwarded", "command", "gap_dropped", "buffered")),
        S.BUFFERED: _of("buffered"),
    }


def gap_counters(decided: DataFrame) -> DataFrame:
    """All counters in one row. Rows decided with limits tell of a failed gap in the row of its command."""
    of = counter_columns()
    if "failed" in decided.columns:
        of[S.COMMAND_TIMEOUT] = F.count("failed")
    return decided.agg(*[c.alias(_column(n)) for n, c in of.items()], _of("invalid").alias("invalid_events"), _of("fill_invalid").alias("invalid_fills"))


def _column(name: str) -> str:
    return name.replace("cdc.", "").replace(".", "_").replace("-", "_")


def counter_report(decided: DataFrame) -> DataFrame:
    """Counter name and value, sorted by name, missing counters as 0, with the derived entries."""
    one = gap_counters(decided)
    value = {n: F.coalesce(F.col(_column(n)).cast("double"), F.lit(0.0)) for n in counter_columns()}
    value[S.NOT_NORMAL] = value[S.RECEIVED] - value[S.FORWARDED]
    value[S.DETECTED_OR_BUFFERED] = value[S.GAP_DETECTED] + value[S.BUFFERED]
    value[S.BALANCED] = F.when(value[S.NOT_NORMAL] == value[S.DETECTED_OR_BUFFERED], 1.0).otherwise(0.0)
    entries = F.array(*[F.struct(F.lit(n).alias("name"), v.alias("value")) for n, v in value.items()])
    return one.select(F.explode(entries).alias("e")).select("e.name", "e.value").orderBy("name")


def conservation(decided: DataFrame) -> DataFrame:
    """received - forwarded = detected + buffered; only invalid rows may break it, so they stand beside."""
    one = gap_counters(decided)
    left = F.col(_column(S.RECEIVED)) - F.col(_column(S.FORWARDED))
    right = F.col(_column(S.GAP_DETECTED)) + F.col(_column(S.BUFFERED))
    return one.select(left.alias("not_normal"), right.alias("detected_or_buffered"), "invalid_events",
                      (left == right).alias("balanced"), (left - F.col("invalid_events") == right).alias("balanced_valid"))
