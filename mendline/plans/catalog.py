"""Every query by name. Each takes (spark, folder of the tables) and reads whole tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import schemas as S
from ..functions import (backoff_ms, epoch_ms, is_gap_type, jitter_ms, lookup_path, outage_breached,
                         parse_long, parse_long_strict, seconds_or_millis, values_differ)
from ..operators import counters, deadletters, gaps, limits, lookup, quiet, retries, tables
from ..operators.ordered import DEFAULT, Layout
from ..sources import codecs, tables as src
from ..sources.io import fresh_dir, stored
from . import streams

Query = Callable[[SparkSession, str], DataFrame]

# A layout under which the benchmark's records count as hot, so that the split path is checked as well.
SPLIT = Layout(hot_rows=20)

GAP_COLUMNS = ("record_id", "seq", "decision")


def decided(spark, sf_dir, mode="compat", failing=False, layout: Layout = DEFAULT) -> DataFrame:
    return gaps.decide(src.cdc_input(spark, sf_dir, failing), mode, layout)


# --- sources, sinks, codecs ---------------------------------------------------------------------

def cdc_source_parse(spark, d):
    p = codecs.parse_cdc(src.cdc_wire(spark, d, faulty=False))
    return p.select("key", "rec_ts", "rec_offset", "event_id", "entity", "record_id", "type", "ts",
                    "replay_id", "payload", F.col("gap.fromReplayId").alias("gap_from"),
                    F.col("gap.toReplayId").alias("gap_to"), F.col("gap.reason").alias("gap_reason"))


def json_decode_quarantine(spark, d):
    p = codecs.parse_cdc(src.cdc_wire(spark, d))
    return p.select("rec_offset", "event_id", "record_id", "type",
                    F.coalesce("problem", F.lit("ok")).alias("problem"))


def json_encode(spark, d):
    return src.cdc_wire(spark, d, faulty=False).select("rec_offset", "key", "value")


def _flat_gap():
    return [F.col("gap.fromReplayId").alias("gap_from"), F.col("gap.toReplayId").alias("gap_to"), F.col("gap.reason").alias("gap_reason")]


def _parsed(spark, d, faulty=False, forced=False):
    return codecs.parse_cdc(src.cdc_wire(spark, d, faulty)), codecs.parse_fills(src.fill_wire(spark, d, faulty, forced))


def tagged_union_input(spark, d):
    t = codecs.arrival_order(codecs.tag(*_parsed(spark, d)))
    return t.select("record_id", "key", "rec_ts", "arrived", "source_rank", "rec_offset", "seq", "kind", "type", "event_id", "entity",
                    "ts", "replay_id", *_flat_gap(), "payload", "cutoff", gaps.fill_succeeded().alias("ok"), "err")


def wire_decided(spark, d, mode="compat", faulty=True, forced=False) -> DataFrame:
    """Decisions over the wire, in order of arrival, with the rows that can't be used as `invalid`."""
    cdc, fills = _parsed(spark, d, faulty, forced)
    rows = stored(codecs.arrival_order(stored(codecs.tag(cdc, fills, mode))))  # parsed once
    return (gaps.decide(rows, mode, codecs.WIRE_LAYOUT)
            .unionByName(codecs.invalid(cdc, fills, mode), allowMissingColumns=True))


def wire_decisions(spark, d, mode="compat", forced=False):
    return wire_decided(spark, d, mode, forced=forced).select(
        "record_id", F.coalesce("source_rank", F.when(F.col("decision") == "invalid", 0).otherwise(1)).alias("source_rank"),
        "rec_offset", "decision")


def fill_events_out(spark, d):
    fills = fill_lookup_left(spark, d)
    return fills.select(
        F.col("record_id").cast("string").alias("key"),
        codecs.encode(F.col("record_id").cast("string").alias("recordId"), F.col("entity_type").alias("entityType"),
                      F.col("event_id").alias("eventId"), F.col("cutoff").alias("cutoffLastModifiedEpochMs"),
                      codecs.field_map(F.col("all_fields")).alias("allFields"),
                      F.col("is_success").alias("isSuccess"), F.col("err").alias("errMessage")).alias("value"))


# --- filters, projections -----------------------------------------------------------------------

def _problems(spark, d):
    return codecs.parse_cdc(src.cdc_wire(spark, d)).withColumn("problem", F.coalesce("problem", F.lit("ok")))


def valid_records(spark, d):
    """The validity test looks at presence alone: key, value and record id."""
    return _problems(spark, d).filter(~F.col("problem").isin(*codecs.INVALID, "bad_json")).select(
        "rec_offset", "key", "record_id", "type")


def gap_events(spark, d):
    return _problems(spark, d).filter(is_gap_type(F.col("type"))).select("rec_offset", "record_id", "event_id")


def key_mismatch(spark, d):
    return _problems(spark, d).filter(F.col("problem") == "key_mismatch").select("rec_offset", "key", "record_id")


def in_gap_flag(spark, d):
    return gaps.in_gap(src.cdc_input(spark, d)).select("record_id", "seq", "kind", "in_gap")


def gap_decisions(spark, d, mode="compat", failing=False, layout=DEFAULT):
    return decided(spark, d, mode, failing, layout).select(*GAP_COLUMNS)


def gap_decisions_filtered(spark, d, mode="compat"):
    """Records without gap markers and fills go past the windows."""
    return quiet.decide(src.cdc_input(spark, d, failing=mode == "strict"), mode).select(*GAP_COLUMNS)


def forwarded_events(spark, d):
    return decided(spark, d).filter(F.col("decision") == "forwarded").select(
        "record_id", "seq", "type", "event_id", "entity", "ts", "rec_ts", "replay_id", *_flat_gap(), "payload")


def fill_commands(spark, d):
    return gaps.fill_commands(decided(spark, d))


def synthetic_fill_rows(spark, d, mode="compat"):
    return gaps.synthetic_fills(decided(spark, d, mode, failing=True), mode)


def flushed_vs_dropped(spark, d):
    return decided(spark, d).filter(F.col("decision").isin("flushed", "dropped")).select(
        "record_id", "seq", "ts", "close_seq", "close_cutoff", "decision")


def demux_outputs(spark, d):
    """Which output each row goes to."""
    dec = decided(spark, d, "strict", failing=True)
    output = (F.when(F.col("decision").isin(*S.EMITTED), S.TOPICS["cdc_out"])
              .when(F.col("decision") == "command", S.TOPICS["fill_command"])
              .when(F.col("decision").isin(*S.ERRORS), S.TOPICS["error"]))
    return dec.select("record_id", "seq", output.alias("output")).filter(F.col("output").isNotNull())


def map_values_upper(spark, d):
    docs = src.table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("payload"))
    return tables.upper_payload(docs)


def dedupe_monotonic(spark, d, layout=DEFAULT):
    """Time of a row here: its own, or for a fill the time its image was last changed."""
    rows = src.cdc_input(spark, d).select("record_id", "seq", F.coalesce("cutoff", "ts").alias("ts"))
    return gaps.newer_only(rows, layout)


# --- outputs of the engine ------------------------------------------------------------------------

def cdc_output(spark, d, mode="compat", layout=DEFAULT):
    out = gaps.cdc_output(decided(spark, d, mode, failing=True, layout=layout), mode, layout)
    return out.select("*", *_flat_gap()).drop("gap")


def cdc_output_filtered(spark, d, mode="compat"):
    out = quiet.cdc_output(src.cdc_input(spark, d, failing=True), mode)
    return out.select("*", *_flat_gap()).drop("gap")


def replay_order(spark, d, mode="compat", layout=DEFAULT):
    r = gaps.replayed(decided(spark, d, mode, layout=layout), mode, layout)
    return r.filter(F.col("pos").isNotNull()).select("record_id", "close_seq", "pos", "seq")


def error_sink(spark, d):
    return gaps.error_output(decided(spark, d, "strict", failing=True))


# --- joins ------------------------------------------------------------------------------------------

def fill_lookup_left(spark, d):
    return lookup.fill_lookup(fill_commands(spark, d), src.snapshot(spark, d))


def fill_lookup_inner(spark, d):
    return lookup.fill_lookup_hits(fill_commands(spark, d), src.snapshot(spark, d))


def fill_lookup_misses(spark, d):
    return lookup.fill_lookup_misses(fill_commands(spark, d), src.snapshot(spark, d))


def fill_lookup_as_of(spark, d):
    """Commands are asked half a day after their gap, of the images as they were then."""
    dec = decided(spark, d).filter(F.col("decision") == "command")
    asked = dec.select("record_id", F.col("entity").alias("entity_type"), "event_id", "seq", F.col("ts").alias("gap_at"),
                       (F.col("ts") + 12 * 3_600_000).alias("asked_at"))
    return lookup.fill_lookup_as_of(asked, src.snapshot(spark, d))


def fill_commands_fanout(spark, d):
    """Both workers answer the same commands, the older one from images of the day before and now and then first; one
    fill per command remains, a good one if there is any."""
    commands = stored(fill_commands(spark, d))
    images = src.snapshot(spark, d)
    new = lookup.fill_lookup(commands, images).select(
        "record_id", "event_id", "cutoff", "is_success", (F.col("seq") * 2).alias("rec_ts"))
    older = lookup.fill_lookup_hits(commands, images.filter("version = 1"))
    old = older.select("record_id", "event_id", "cutoff", F.lit(True).alias("is_success"),
                       (F.col("seq") * 2 + F.when(F.col("seq") % 3 == 0, -1).otherwise(1)).alias("rec_ts"))
    return gaps.dedupe_fills(new.unionByName(old), mode="strict").drop("rec_ts")


def gap_fill_episodes(spark, d, layout=DEFAULT):
    return gaps.episodes(decided(spark, d, layout=layout), layout)


def ignored_fills(spark, d):
    return decided(spark, d).filter(F.col("decision") == "fill_ignored").select("record_id", "seq", "cutoff")


def pending_buffer(spark, d):
    return gaps.pending(decided(spark, d)).select("record_id", "seq", "ts", "payload")


# --- aggregates ---------------------------------------------------------------------------------------

def gap_counters(spark, d):
    return counters.gap_counters(wire_decided(spark, d))


def gap_counter_report(spark, d):
    return counters.counter_report(wire_decided(spark, d))


def gap_conservation(spark, d):
    return counters.conservation(wire_decided(spark, d))


def buffer_per_episode(spark, d):
    return gaps.buffers(decided(spark, d)).drop("epoch")


def current_state(spark, d):
    e = src.table(spark, d, "events").select(
        F.col("user_id").alias("record_id"), F.col("event_id").alias("seq"), "event_type", "value", "props")
    return tables.current_state(e)


def materialized_image(spark, d):
    e = src.table(spark, d, "events")
    rows = src.tag_events(e, extra={"fields": src.change_fields(
        F.col("event_type"), F.col("value").cast("string"), F.get_json_object("props", "$.k"))})
    img = tables.images(gaps.cdc_output(gaps.decide(rows), keep=["fields"]))
    return img.select("record_id", F.col("image")["event_type"].alias("event_type"),
                      F.col("image")["k"].cast("bigint").alias("k"),
                      F.col("image")["value"].cast("double").alias("value"))


def distinct_records(spark, d):
    return tables.distinct_records(src.cdc_input(spark, d))


def record_count(spark, d):
    return tables.record_count(src.cdc_input(spark, d))


# --- versions and sequences -------------------------------------------------------------------------

def replay_gaps(spark, d, layout=DEFAULT):
    # Times as ids: whole seconds in which nothing happened.
    e = src.table(spark, d, "events").select(F.floor(epoch_ms(F.col("ts")) / 1000).cast("bigint").alias("second"))
    return tables.replay_gaps(e, "second", layout)


def change_capture(spark, d, layout=DEFAULT):
    v = src.table(spark, d, "events").select(
        F.col("user_id").alias("record_id"), F.col("event_id").alias("seq"), epoch_ms(F.col("ts")).alias("modified"),
        "event_type", "value", F.get_json_object("props", "$.k").cast("bigint").alias("k"))
    c = tables.change_capture(v, ["event_type", "k", "value"], layout)
    return c.select("record_id", "seq", "modified",
                    F.concat_ws(",", F.map_keys("changed")).alias("changed_fields"),
                    F.col("changed")["event_type"].alias("new_event_type"),
                    F.col("changed")["k"].cast("bigint").alias("new_k"),
                    F.col("changed")["value"].cast("double").alias("new_value"))


# --- fill attempts --------------------------------------------------------------------------------------

def attempts(spark, d):
    dec = decided(spark, d).filter(F.col("decision") == "command")
    k = F.get_json_object("payload", "$.k").cast("bigint")
    a = src.fill_attempts(dec.select("record_id", F.col("entity").alias("entity_type"), "seq", "ts", "payload"), k)
    return a.withColumn("outcome", lookup.outcome_class(F.col("status"))).drop("payload")


def fill_outcome_class(spark, d):
    return attempts(spark, d).select("record_id", "seq", "status", "outcome")


def retry_schedule(spark, d, doubling=True, layout=DEFAULT):
    return retries.retry_schedule(stored(attempts(spark, d)), layout, doubling=doubling)


def outage_windows(spark, d, layout=DEFAULT):
    return retries.outage_windows(stored(attempts(spark, d)), layout)


# --- scalar functions, duplicates, failed gaps -------------------------------------------------------------

def scalar_functions(spark, d):
    e = src.table(spark, d, "events")
    ms, k = epoch_ms(F.col("ts")), F.get_json_object("props", "$.k")
    number = parse_long_strict(k)
    delay = backoff_ms(F.pmod("event_id", F.lit(10)))
    return e.select(
        "event_id",
        is_gap_type(src.wire_type(F.col("event_type"))).alias("is_g"),
        number.alias("k_strict"),
        parse_long(F.col("event_type")).alias("not_a_number"),
        F.variant_get(F.parse_json("props"), "$.k", "bigint").alias("k_from_map"),
        F.from_json("props", "map<string,string>")["k"].alias("k_text"),
        lookup_path(F.lit(src.ENTITY), F.col("user_id"), "/base").alias("path"),
        F.upper("event_type").alias("upper_type"),
        delay.alias("delay_ms"),
        jitter_ms(delay, F.col("event_id")).alias("jittered_ms"),
        seconds_or_millis(F.floor(ms / 1000).cast("bigint")).alias("from_seconds"),
        seconds_or_millis(ms).alias("from_millis"),
        outage_breached(ms - number * 60_000, ms, 50 * 60_000).alias("breached"),
        values_differ(F.nullif(F.col("event_type"), F.lit("view")), F.lit("click")).alias("differs"),
        F.coalesce(F.nullif(F.col("value"), F.lit(0.01)), F.lit(0.0)).alias("value_or_zero"))


def duplicate_fills(spark, d):
    """Every fill delivered twice: the second finds no gap."""
    rows = src.cdc_input(spark, d)
    copies = F.when(F.col("kind") == "F", F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    twice = rows.withColumn("_copy", F.explode(copies)).withColumn("seq", F.col("seq") * 2 + F.col("_copy")).drop("_copy")
    return gaps.decide(twice).select(*GAP_COLUMNS)


def replay_failed_gaps(spark, d):
    return tables.replay_failed_gaps(decided(spark, d, "strict", failing=True))


# --- timeout and buffer limit -------------------------------------------------------------------------------

TIMEOUT_MS = 48 * 3_600_000
MAX_BUFFER = 2


def limited(spark, d, timeout_ms=None, max_buffer=None, layout=DEFAULT):
    rows = src.cdc_input(spark, d).withColumn("arrived", F.col("ts"))
    return limits.decide_limited(rows, timeout_ms, max_buffer, layout=layout)


def gap_timeout(spark, d, layout=DEFAULT):
    return limited(spark, d, TIMEOUT_MS, layout=layout).select(*GAP_COLUMNS)


def gap_overflow(spark, d, layout=DEFAULT):
    return limited(spark, d, max_buffer=MAX_BUFFER, layout=layout).select(*GAP_COLUMNS)


def gap_limits(spark, d, layout=DEFAULT):
    return limited(spark, d, TIMEOUT_MS, MAX_BUFFER, layout).select(*GAP_COLUMNS)


def limited_output(spark, d):
    """The repaired stream where gaps may fail."""
    out = gaps.cdc_output(limited(spark, d, TIMEOUT_MS, MAX_BUFFER))
    return out.select("record_id", "out_seq", "out_pos", "seq", "type", "event_id", "ts", "rec_ts", "payload")


def limited_errors(spark, d):
    return gaps.error_output(limited(spark, d, TIMEOUT_MS, MAX_BUFFER))


def limited_counters(spark, d):
    return counters.gap_counters(limited(spark, d, TIMEOUT_MS, MAX_BUFFER))


def failed_gaps(spark, d):
    return limits.failed_gaps(limited(spark, d, TIMEOUT_MS, MAX_BUFFER))


def late_fill(spark, d):
    return limits.late_fills(limited(spark, d, TIMEOUT_MS, MAX_BUFFER))


def reissued_commands(spark, d):
    return limits.reissue(limited(spark, d, TIMEOUT_MS, MAX_BUFFER))


def dead_letters_replayed(spark, d):
    """Dead letters of failed gaps behind the fills that they are asked for. The first run has the images of the day before alone,
    the second all; batches and runs are repeated, and every dead letter is settled once."""
    dec = stored(limited(spark, d, TIMEOUT_MS, MAX_BUFFER))
    letters = stored(deadletters.dead_letters(dec))
    ledger = deadletters.Ledger(spark, fresh_dir(spark, "dead-letters"), "record_id bigint, seq bigint, open_seq bigint, type string, "
                                "event_id string, entity string, ts bigint, payload string")
    for batch, part in ((0, letters.filter("seq % 2 = 0")), (1, letters.filter("seq % 2 = 1")), (1, letters.filter("seq % 2 = 1"))):
        ledger.keep(part, batch)
    images = src.snapshot(spark, d)
    for run, known in ((1, images.filter("version = 1")), (2, images), (2, images)):
        asked = stored(ledger.commands(run))
        fills = lookup.fill_lookup(asked, lookup.asked_images(asked, known))
        ledger.replay(fills.withColumnRenamed("all_fields", "payload"), run)
    return ledger.settled().select("record_id", "seq", "open_seq", "decision", "pos", "event_id", "ts", "payload", "run")


QUERIES: dict[str, Query] = {
    "cdc_source_parse": cdc_source_parse,
    "tagged_union_input": tagged_union_input,
    "json_decode_quarantine": json_decode_quarantine,
    "json_encode": json_encode,
    "fill_events_out": fill_events_out,
    "valid_records": valid_records,
    "gap_events": gap_events,
    "key_mismatch": key_mismatch,
    "in_gap_flag": in_gap_flag,
    "gap_decisions": gap_decisions,
    "wire_decisions": wire_decisions,
    "wire_decisions_strict": partial(wire_decisions, mode="strict"),
    "gap_decisions_split": partial(gap_decisions, layout=SPLIT),
    "gap_decisions_failing": partial(gap_decisions, failing=True),
    "gap_decisions_strict": partial(gap_decisions, mode="strict", failing=True),
    "gap_decisions_filtered": gap_decisions_filtered,
    "gap_decisions_filtered_strict": partial(gap_decisions_filtered, mode="strict"),
    "forwarded_events": forwarded_events,
    "fill_commands": fill_commands,
    "synthetic_fill_rows": synthetic_fill_rows,
    "synthetic_fill_rows_strict": partial(synthetic_fill_rows, mode="strict"),
    "flushed_vs_dropped": flushed_vs_dropped,
    "demux_outputs": demux_outputs,
    "map_values_upper": map_values_upper,
    "dedupe_monotonic": dedupe_monotonic,
    "cdc_output": cdc_output,
    "cdc_output_split": partial(cdc_output, layout=SPLIT),
    "cdc_output_strict": partial(cdc_output, mode="strict"),
    "cdc_output_filtered": cdc_output_filtered,
    "cdc_output_filtered_strict": partial(cdc_output_filtered, mode="strict"),
    "replay_order": replay_order,
    "replay_order_strict": partial(replay_order, mode="strict"),
    "error_sink": error_sink,
    "fill_lookup_left": fill_lookup_left,
    "fill_lookup_inner": fill_lookup_inner,
    "fill_lookup_misses": fill_lookup_misses,
    "fill_lookup_as_of": fill_lookup_as_of,
    "fill_commands_fanout": fill_commands_fanout,
    "gap_fill_episodes": gap_fill_episodes,
    "ignored_fills": ignored_fills,
    "pending_buffer": pending_buffer,
    "gap_counters": gap_counters,
    "gap_counter_report": gap_counter_report,
    "gap_conservation": gap_conservation,
    "buffer_per_episode": buffer_per_episode,
    "current_state": current_state,
    "materialized_image": materialized_image,
    "distinct_records": distinct_records,
    "record_count": record_count,
    "replay_gaps": replay_gaps,
    "change_capture": change_capture,
    "fill_outcome_class": fill_outcome_class,
    "retry_schedule": retry_schedule,
    "retry_schedule_constant": partial(retry_schedule, doubling=False),
    "outage_windows": outage_windows,
    "scalar_functions": scalar_functions,
    "duplicate_fills": duplicate_fills,
    "replay_failed_gaps": replay_failed_gaps,
    "gap_timeout": gap_timeout,
    "gap_overflow": gap_overflow,
    "gap_limits": gap_limits,
    "gap_limits_split": partial(gap_limits, layout=SPLIT),
    "limited_output": limited_output,
    "limited_errors": limited_errors,
    "limited_counters": limited_counters,
    "failed_gaps": failed_gaps,
    "late_fill": late_fill,
    "reissued_commands": reissued_commands,
    "dead_letters_replayed": dead_letters_replayed,
    "gap_stream_equals_batch": streams.gap_stream,
    "gap_stream_limits": partial(streams.gap_stream, timeout_ms=TIMEOUT_MS, max_buffer=MAX_BUFFER),
    "gap_timeout_stream": partial(streams.gap_timeout_stream, timeout_ms=TIMEOUT_MS),
    "handover_stream": streams.handover_stream,
    "handover_stream_strict": partial(streams.handover_stream, mode="strict"),
    "gap_stream_matched": streams.gap_stream_matched,
    "wire_decisions_forced": partial(wire_decisions, mode="strict", forced=True),
    "stream_pending": streams.stream_pending,
    "stream_outputs": streams.stream_outputs,
    "stream_outputs_strict": partial(streams.stream_outputs, mode="strict", faulty=True),
    "stream_outputs_faulty": partial(streams.stream_outputs, faulty=True),
    "stream_newer_only": streams.stream_newer_only,
    "stream_first_fills": streams.stream_first_fills,
    "current_state_stream": streams.current_state_stream,
    "materialized_image_stream": streams.materialized_image_stream,
    "replay_gaps_stream": streams.replay_gaps_stream,
    "outage_alarm_stream": streams.outage_alarm_stream,
    "fill_command_source": streams.fill_command_source,
    "second_worker": partial(streams.fill_command_source, older=True),
    "fill_loop": streams.fill_loop,
}
