"""Record schemas and the names that are fixed by the data format.

The two free-form field maps (``changedFields`` and ``allFields``) are declared as strings:
``from_json`` then keeps their JSON text as it is, which is what state, sinks and hashing need.
"""

from pyspark.sql import types as T

# --- fixed values: field names and types of the wire records --------------------------------

GAP_INFO = T.StructType([
    T.StructField("fromReplayId", T.LongType()),
    T.StructField("toReplayId", T.LongType()),
    T.StructField("reason", T.StringType()),
])

CDC_EVENT = T.StructType([
    T.StructField("eventId", T.StringType()),
    T.StructField("entity", T.StringType()),
    T.StructField("recordId", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("timestamp", T.LongType()),
    T.StructField("replayId", T.LongType()),
    T.StructField("changedFields", T.StringType()),
    T.StructField("gap", GAP_INFO),
])

FILL_COMMAND = T.StructType([
    T.StructField("recordId", T.StringType()),
    T.StructField("entityType", T.StringType()),
    T.StructField("eventId", T.StringType()),
])

# The older producer leaves out the last three fields; they then decode as null.
FILL_EVENT = T.StructType([
    T.StructField("recordId", T.StringType()),
    T.StructField("entityType", T.StringType()),
    T.StructField("eventId", T.StringType()),
    T.StructField("cutoffLastModifiedEpochMs", T.LongType()),
    T.StructField("allFields", T.StringType()),
    T.StructField("isSuccess", T.BooleanType()),
    T.StructField("errMessage", T.StringType()),
    T.StructField("force", T.BooleanType()),
])

# --- fixed values: counter names --------------------------------------------------------------

RECEIVED = "cdc.events.received"
FORWARDED = "cdc.events.forwarded"
FILLED = "cdc.gap-events.filled"
GAP_DETECTED = "cdc.gap-event.detected"
GAP_DROPPED = "cdc.gap-event.dropped"
BUFFERED = "cdc.events.buffered"
BUFFER_DROPPED = "cdc.buffered-events.dropped"
BUFFER_FLUSHED = "cdc.buffered-events.flushed"
COMMAND_PUBLISHED = "cdc.fill-commands.published"
COMMAND_TIMEOUT = "cdc.fill-commands.timeout"
FILL_RECEIVED = "cdc.fill-event.received"

NOT_NORMAL = "NOT_NORMAL"
DETECTED_OR_BUFFERED = "GAP_DETECTED_OR_BUFFERED"
BALANCED = "NOT_NORMAL=GAP_DETECTED_OR_BUFFERED"

# --- fixed values: topic names ----------------------------------------------------------------

TOPICS = {
    "cdc_in": "CDC-INPUT",
    "cdc_out": "CDC-OUTPUT",
    "fill_command": "CDC-FILL-COMMAND",
    "fill_event": "CDC-FILL-EVENT",
    "error": "ERROR",
}

# --- fixed values: limits and retry settings --------------------------------------------------

INITIAL_BACKOFF_MS = 1_000
MAX_BACKOFF_MS = 60_000
MAX_OUTAGE_MS = 600_000
JITTER = 0.20

# --- what can become of a row -------------------------------------------------------------------

EMITTED = ("forwarded", "filled", "forced", "flushed")
DECIDED_BUFFERED = ("flushed", "dropped", "pending", "dead_letter")
ERRORS = ("fill_error", "gap_failed", "dead_letter")
