"""Column functions. All are native expressions; none calls Python per row."""

from .scalars import (
    backoff_ms, epoch_ms, is_gap_type, jitter_ms, lookup_path, outage_breached, parse_long,
    parse_long_strict, seconds_or_millis, to_millis, values_differ, wire_kind,
)

__all__ = [
    "backoff_ms", "epoch_ms", "is_gap_type", "jitter_ms", "lookup_path", "outage_breached",
    "parse_long", "parse_long_strict", "seconds_or_millis", "to_millis", "values_differ", "wire_kind",
]
