from __future__ import annotations

from pyspark.sql import Column, functions as F

from .. import schemas as S

# Numbers below this are taken as epoch seconds, others as epoch milliseconds.
SECONDS_LIMIT = 100_000_000_000


def is_gap_type(type_: Column) -> Column:
    """True for the gap marker, in either case; null for a null type."""
    return F.lower(type_) == "g"


def wire_kind(type_: Column) -> Column:
    """G for a gap marker, N for any other type."""
    return F.when(is_gap_type(type_), "G").when(type_.isNotNull(), "N")


def epoch_ms(ts: Column) -> Column:
    """Whole milliseconds since 1970 of a zone-less timestamp. The difference of two zone-less timestamps
    does not pass through the session's time zone, so clock changes there have no effect."""
    since = ts - F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.floor(since.cast("interval second").cast("decimal(20,6)") * 1000).cast("bigint")


def seconds_or_millis(x: Column) -> Column:
    """Bring an epoch number in seconds or milliseconds to milliseconds."""
    return F.when(F.abs(x) < SECONDS_LIMIT, x * 1000).otherwise(x)


#: Milliseconds per unit of an epoch number.
UNITS = {"ms": 1, "s": 1000}


def to_millis(x: Column, unit: str = "ms") -> Column:
    """An epoch number of the given unit in milliseconds. The unit "guess" takes small numbers as seconds, which is wrong for
    milliseconds before March 1973."""
    if unit == "guess":
        return seconds_or_millis(x)
    return x * UNITS[unit] if UNITS[unit] != 1 else x


def parse_long(x: Column) -> Column:
    """Text to number, null where it is not one."""
    return x.try_cast("bigint")


def parse_long_strict(x: Column) -> Column:
    """Text to number; a row that holds no number ends the query, whatever the session's ANSI mode."""
    parsed = x.try_cast("bigint")
    return F.when(x.isNotNull() & parsed.isNull(),
                  F.raise_error(F.concat(F.lit("not a number: "), x)).cast("bigint")).otherwise(parsed)


def lookup_path(entity_type: Column, record_id: Column, base: str = "") -> Column:
    """`{base}/{entityType}/{recordId}`"""
    return F.concat_ws("/", F.lit(base), entity_type, record_id.cast("string"))


def backoff_ms(n: Column, base: int = S.INITIAL_BACKOFF_MS, cap: int = S.MAX_BACKOFF_MS,
               doubling: bool = True) -> Column:
    """Delay before retry number `n` (0 for the first): doubled each time up to `cap`, or constant."""
    if not doubling:
        return F.lit(base).cast("bigint")
    # The exponent is held where the cap is certainly reached, so that it cannot overflow.
    steps = F.least(n.cast("int"), F.lit(max(cap // max(base, 1), 1).bit_length()))
    return F.least(F.lit(cap).cast("bigint"), F.lit(base).cast("bigint") * F.pow(F.lit(2), steps).cast("bigint"))


def jitter_ms(delay: Column, seed: Column, share: float = S.JITTER) -> Column:
    """`delay` moved by up to ±`share` of it, never below 0. The seed fixes the shift, so a retried task
    gives the same schedule."""
    reach = F.floor(delay * F.lit(share)).cast("bigint")
    spread = F.pmod(seed.cast("bigint"), F.lit(1_000_003)) * 7919
    return F.greatest(F.lit(0).cast("bigint"), delay + F.pmod(spread, 2 * reach + 1) - reach)


def outage_breached(start_ms: Column, now_ms: Column, limit_ms: int = S.MAX_OUTAGE_MS) -> Column:
    return (now_ms - start_ms) > F.lit(limit_ms)


def values_differ(a: Column, b: Column) -> Column:
    """Null-safe inequality."""
    return ~a.eqNullSafe(b)
