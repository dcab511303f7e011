"""JSON wire records <-> typed columns, with every unusable row kept in a quarantine.

A wire row is (key string, value string, rec_ts bigint, rec_offset bigint), and rec_partition int where the source has partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from .. import schemas as S
from ..functions import wire_kind
from ..operators.ordered import PART, Layout, scan

BAD = "_corrupt_record"

# Why a change event cannot be used, most basic reason first.
INVALID = ("null_key", "null_value", "null_record_id")
REASONS = (*INVALID, "bad_json", "null_type", "key_mismatch")


def decode(wire: DataFrame, schema: T.StructType, *, fail_fast: bool = False) -> DataFrame:
    """Parse `value` into the struct column `v`. A null stays null. Text that is no such record ends the
    query with `fail_fast`; otherwise it is kept in `v._corrupt_record`.

    The explode of a one-element array keeps later filters above the parse. Pushed below, they would parse
    the text once more for each field they look at.
    """
    if fail_fast:
        parsed = F.from_json("value", schema, {"mode": "FAILFAST"})
    else:
        open_schema = T.StructType([*schema.fields, T.StructField(BAD, T.StringType())])
        parsed = F.from_json("value", open_schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD})
    return wire.select("*", F.explode(F.array(parsed)).alias("v"))


def encode(*fields: Column) -> Column:
    """One JSON text with all fields, nulls written out. Wrap field maps in `field_map`."""
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def field_map(json_text: Column) -> Column:
    """JSON text of a field map as a value that `encode` embeds: names sorted, no blanks. Null if it is no JSON."""
    return F.try_parse_json(json_text)


def cdc_problem() -> Column:
    """Reason why a decoded change event is unusable, null if it is fine."""
    v = F.col("v")
    return (F.when(F.col("key").isNull(), "null_key")
            .when(F.col("value").isNull(), "null_value")
            .when(v[BAD].isNotNull(), "bad_json")
            .when(v["recordId"].isNull(), "null_record_id")
            .when(v["type"].isNull(), "null_type")
            .when(F.col("key") != v["recordId"], "key_mismatch"))


def fill_problem() -> Column:
    v = F.col("v")
    return (F.when(F.col("key").isNull(), "null_key")
            .when(F.col("value").isNull(), "null_value")
            .when(v[BAD].isNotNull(), "bad_json")
            .when(F.col("key") != v["recordId"], "key_mismatch"))


def _partition(wire: DataFrame) -> Column:
    """The partition of a wire row; a source without partitions is one."""
    given = F.coalesce("rec_partition", F.lit(0)) if "rec_partition" in wire.columns else F.lit(0)
    return given.cast("int").alias("rec_partition")


def parse_cdc(wire: DataFrame) -> DataFrame:
    """Decoded change events with `problem`; the text of the row is kept for the quarantine."""
    return decode(wire, S.CDC_EVENT).select(
        "key", "rec_ts", "rec_offset", _partition(wire), "value",
        F.col("v.eventId").alias("event_id"), F.col("v.entity").alias("entity"),
        F.col("v.recordId").alias("record_id"), F.col("v.type").alias("type"),
        F.col("v.timestamp").alias("ts"), F.col("v.replayId").alias("replay_id"),
        F.col("v.changedFields").alias("payload"), F.col("v.gap").alias("gap"),
        cdc_problem().alias("problem"))


def parse_fills(wire: DataFrame) -> DataFrame:
    return decode(wire, S.FILL_EVENT).select(
        "key", "rec_ts", "rec_offset", _partition(wire), "value",
        F.col("v.recordId").alias("record_id"), F.col("v.entityType").alias("entity"),
        F.col("v.eventId").alias("event_id"),
        F.col("v.cutoffLastModifiedEpochMs").alias("cutoff"), F.col("v.allFields").alias("payload"),
        F.col("v.isSuccess").alias("is_success"), F.col("v.errMessage").alias("err"), F.col("v.force").alias("force"),
        fill_problem().alias("problem"))


def is_usable(mode: str = "strict") -> Column:
    """Can the gap rules take a row? In compat a key that differs from the record id passes: change events
    go by record id, fills by key."""
    fine = F.col("problem").isNull()
    return fine | (F.col("problem") == "key_mismatch") if mode == "compat" else fine


def usable(parsed: DataFrame, mode: str = "strict") -> DataFrame:
    return parsed.filter(F.coalesce(is_usable(mode), F.lit(False)))


def quarantine(parsed: DataFrame, mode: str = "strict") -> DataFrame:
    """Rows that are not usable, with the reason and the text as received."""
    return parsed.filter(~F.coalesce(is_usable(mode), F.lit(False))).select(
        "key", "rec_ts", "rec_offset", "problem", "value")


def tag(cdc: DataFrame, fills: DataFrame, mode: str = "strict") -> DataFrame:
    """Both inputs as one table of tagged rows, with all that was received. `seq` is unique within a record: offsets of the
    two sources, and of partitions, may coincide. In compat a fill goes by its key; `own_id` is the record id that it names itself. The order of arrival is
    that of `arrival_order`."""
    changes = usable(cdc, mode).select(
        "record_id", "key", "rec_ts", F.lit(0).alias("source_rank"), "rec_offset", "rec_partition",
        wire_kind(F.col("type")).alias("kind"), "type", "event_id", "entity", "ts", "replay_id", "gap", "payload")
    record = F.col("key") if mode == "compat" else F.col("record_id")
    filled = usable(fills, mode).select(
        record.alias("record_id"), "key", "rec_ts", F.lit(1).alias("source_rank"), "rec_offset", "rec_partition",
        F.lit("F").alias("kind"), "event_id", "entity", "payload", F.col("record_id").alias("own_id"), "cutoff", "is_success", "force", "err")
    return (changes.unionByName(filled, allowMissingColumns=True)
            .withColumn("seq", F.col("rec_partition") * F.lit(OFFSETS * 2) + F.col("rec_offset") * 2 + F.col("source_rank")))


#: Offsets of one partition lie below this, partitions below 2^15.
OFFSETS = 1 << 47

WIRE_ORDER = ("arrived", "source_rank", "rec_offset", "rec_partition")
WIRE_LAYOUT = Layout(order=WIRE_ORDER)


def arrival_order(tagged: DataFrame) -> DataFrame:
    """Add `arrived`: the latest record time of the record's source so far, by offset. By it the two sources are merged, and within a
    source rows keep the order of their offsets whatever their times; equal offsets in several partitions count by partition. Order rows by
    WIRE_ORDER."""
    source = Layout(keys=("record_id", "source_rank"), order=("rec_offset", "rec_partition"))
    seen = scan(tagged.withColumn("rec_partition", _partition(tagged)), source, max_before={"_latest": F.col("rec_ts")})
    return seen.withColumn("arrived", F.greatest("rec_ts", "_latest")).drop("_latest", PART)


def invalid(cdc: DataFrame, fills: DataFrame, mode: str = "strict") -> DataFrame:
    """Rows that the gap rules can't take, as decided rows: counted as received, and nothing else."""
    rest = lambda parsed, decision: parsed.filter(~F.coalesce(is_usable(mode), F.lit(False))).select(
        "record_id", "key", "rec_ts", "rec_offset", F.lit(decision).alias("decision"))
    return rest(cdc, "invalid").unionByName(rest(fills, "fill_invalid"))
