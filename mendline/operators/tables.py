"""Tables kept from the stream: current state, images, versions, missing numbers, re-issued commands."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import values_differ
from .ordered import DEFAULT, PART, Layout, scan


def current_state(rows: DataFrame, key: str = "record_id", order: str = "seq") -> DataFrame:
    """Last row per key; `order` is unique within it. Only numbers are aggregated, by hash and before the shuffle; the join
    with them may be split where a key is hot."""
    last = rows.groupBy(key).agg(F.max(order).alias(order))
    return rows.join(last, [key, order]).select(*rows.columns)


def images(changes: DataFrame, key: str = "record_id", order: Sequence[str] = ("out_seq", "out_pos")) -> DataFrame:
    """Replay field maps into one image per record: a full row (`type` F) replaces, others override.

    `changes` has `type` and `fields` (map). First the last value of each (record, field) together with the
    place of the last full row, by a mergeable aggregate; only then one small row list per record.
    """
    at = F.struct(*order)
    nothing = F.lit(None).cast("string")
    full = F.struct(nothing.alias("field"), nothing.alias("value"), F.lit(True).alias("full"))
    entries = F.transform(F.map_entries("fields"), lambda e: F.struct(
        e["key"].alias("field"), e["value"].cast("string").alias("value"), F.lit(False).alias("full")))
    entries = F.coalesce(entries, F.array().cast("array<struct<field:string,value:string,full:boolean>>"))
    long = changes.select(key, at.alias("at"), F.explode(
        F.when(F.col("type") == "F", F.array_append(entries, full)).otherwise(entries)).alias("e"))
    last = (long.groupBy(key, F.col("e.field").alias("field"), F.col("e.full").alias("full"))
            .agg(F.max(F.struct("at", F.col("e.value").alias("value"))).alias("m")))
    per_record = last.groupBy(key).agg(
        F.max(F.when(F.col("full"), F.col("m.at"))).alias("full_at"),
        F.collect_list(F.when(~F.col("full"), F.struct("field", "m.value", "m.at"))).alias("parts"))
    kept = F.filter("parts", lambda p: F.col("full_at").isNull() | (p["at"] >= F.col("full_at")))
    pairs = F.array_sort(F.transform(kept, lambda p: F.struct(p["field"].alias("key"), p["value"].alias("value"))))
    return per_record.select(key, F.map_from_entries(pairs).alias("image"))


def distinct_records(rows: DataFrame, key: str = "record_id", order: str = "seq") -> DataFrame:
    """Each record once, in the order of first appearance."""
    return rows.groupBy(key).agg(F.min(order).alias("first_seq")).orderBy("first_seq")


def record_count(rows: DataFrame, key: str = "record_id") -> DataFrame:
    return rows.agg(F.count_distinct(key).alias("n_records"))


def change_capture(versions: DataFrame, fields: Sequence[str], layout: Layout = DEFAULT) -> DataFrame:
    """Per version the map of fields that differ from the version before it; versions without a difference,
    and the first one, give no row."""
    now = F.struct(*fields)
    seen = scan(versions, layout, before={"_old": now})
    entries: list[Column] = [
        F.when(values_differ(F.col(f), F.col("_old")[f]),
               F.struct(F.lit(f).alias("key"), F.col(f).cast("string").alias("value"))) for f in fields]
    changed = F.filter(F.array(*entries), lambda e: e.isNotNull())
    return (seen.filter(F.col("_old").isNotNull())
            .withColumn("changed", F.map_from_entries(changed))
            .filter(F.size("changed") > 0).drop("_old", PART))


def replay_gaps(rows: DataFrame, number: str, layout: Layout = DEFAULT, by: Sequence[str] = ()) -> DataFrame:
    """Ranges of missing numbers. Without `by` the whole stream is one sequence.

    Repeated deliveries are merged first, so that numbers are unique.
    """
    ids = rows.select(*by, number).distinct()
    seen = scan(ids, layout.by(*by).ordered(number), before={"_prev": F.col(number)})
    return (seen.filter(F.col(number) - F.col("_prev") > 1)
            .select(*by, (F.col("_prev") + 1).alias("from_id"), (F.col(number) - 1).alias("to_id"),
                    (F.col(number) - F.col("_prev") - 1).alias("n_missing")))


def replay_failed_gaps(decided: DataFrame) -> DataFrame:
    """A new command, naming the gap's own event, for each record whose last gap was ended by a failed fill and was not made
    good by a later one. A failed fill without a gap asks for nothing."""
    opened = F.when(F.col("decision") == "command", F.struct("seq", F.col("entity").alias("entity_type"), "event_id"))
    gap_failed = F.when((F.col("decision") == "fill_error") & F.col("in_gap"), F.col("seq"))
    mended = F.when(F.col("decision").isin("filled", "forced"), F.col("seq"))
    gaps = decided.groupBy("record_id", "epoch").agg(
        F.max(gap_failed).alias("failed_seq"), F.max(opened).alias("g"), F.max(mended).alias("mended_seq"))
    last = gaps.groupBy("record_id").agg(
        F.max(F.when(F.col("failed_seq").isNotNull(), F.struct("failed_seq", "g"))).alias("f"), F.max("mended_seq").alias("mended_seq"))
    return last.filter(F.col("f").isNotNull() & (F.coalesce("mended_seq", F.lit(-1)) < F.col("f.failed_seq"))).select(
        "record_id", "f.g.entity_type", "f.g.event_id", "f.failed_seq")


def upper_payload(rows: DataFrame, column: str = "payload") -> DataFrame:
    return rows.withColumn(column, F.upper(column))
