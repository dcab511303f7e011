"""Queries that run Structured Streaming to the end of the data and return what the streams wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import schemas as S
from ..functions import epoch_ms
from ..operators import gaps
from ..operators.ordered import DEFAULT, scan
from ..sources import codecs, io, tables as src
from ..streaming import engine, kept, processor

#: Files of a micro-batch at most.
FILES = 64

#: Files of a delivery, where a query cuts its own.
FILES_OF_DELIVERY = 4

#: How long answers are remembered: a week.
ANSWERS_KEPT_MS = 7 * 86_400_000


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream: its files as they are, a bounded number per micro-batch. The pattern stands for that one
    name; as a pattern it may be a single file as well as a folder."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", FILES).parquet(f"{sf_dir}/[e]vents.parquet")


def _decisions(spark, d, folder, columns=engine.DECISION, **options) -> DataFrame:
    rows = src.tag_events(_events(spark, d)).withColumn("arrived", F.col("ts"))
    return engine.run_to_end(engine.gap_stream(rows, columns=columns, **options), f"{folder}/out", f"{folder}/checkpoint")


def gap_stream(spark, d, **options) -> DataFrame:
    return engine.final_decisions(_decisions(spark, d, io.fresh_dir(spark, "gap-stream"), **options))


def gap_timeout_stream(spark, d, timeout_ms: int) -> DataFrame:
    """Gaps fail by event time, those of quiet records too: once the record times of all records are beyond a deadline."""
    rows = src.tag_events(_events(spark, d)).withColumn("arrived", F.col("ts"))
    folder = io.fresh_dir(spark, "gap-quiet")
    stream = engine.gap_stream(rows, timeout_ms=timeout_ms, timers="event", columns=engine.DECISION)
    return engine.final_decisions(engine.run_to_end(stream, f"{folder}/out", f"{folder}/checkpoint"))


def handover_stream(spark, d, mode="compat") -> DataFrame:
    """The first half of the events as a table, the rest as a stream that goes on from there."""
    folder = io.fresh_dir(spark, "gap-handover")
    half = src.table(spark, d, "events").agg((F.max("event_id") / 2).cast("bigint")).first()[0]
    tagged = lambda events: src.tag_events(events, mode == "strict").withColumn("arrived", F.col("ts"))
    decided = io.stored(gaps.decide(tagged(src.table(spark, d, "events").filter(F.col("event_id") <= half)), mode), "decided")
    stream = engine.gap_stream(tagged(_events(spark, d).filter(F.col("event_id") > half)), mode, initial=engine.handover(decided),
                               columns=engine.DECISION)
    written = engine.run_to_end(stream, f"{folder}/out", f"{folder}/checkpoint")
    waiting = F.when(F.col("decision") == "pending", "buffered").otherwise(F.col("decision"))
    return engine.final_decisions(decided.select("record_id", "seq", waiting.alias("decision"))
                                  .unionByName(written.select("record_id", "seq", "decision")))


def gap_stream_matched(spark, d) -> DataFrame:
    """All fills are delivered first and all changes behind them; fills name the command they answer, so the result is that of the
    merged order nevertheless. A fill's command is the last before it."""
    folder = io.fresh_dir(spark, "gap-matched")
    rows = src.cdc_input(spark, d, failing=True)
    command = F.when(F.col("decision") == "command", F.col("event_id"))
    asked = scan(gaps.decide(rows, "strict"), DEFAULT, before={"_asked": command})
    is_fill, place = F.col("kind") == "F", {"source_rank": (F.col("kind") == "F").cast("int"), "rec_offset": F.col("seq"), "rec_ts": F.col("seq")}
    answers = F.col("in_gap") & is_fill
    named = engine.complete(asked.withColumn("event_id", F.when(answers, F.col("_asked")).otherwise(F.col("event_id")))
                            .withColumns(place).withColumn("arrived", F.col("seq")))
    named = named.select("record_id", *processor.state_schema().fieldNames())
    for part in (is_fill, ~is_fill):
        io.stored(named.filter(part), "matched").write.mode("append").parquet(f"{folder}/in")
        stream = engine.gap_stream(spark.readStream.schema(named.schema).option("maxFilesPerTrigger", FILES).parquet(f"{folder}/in"),
                                   "strict", match=True, wait_ms=0, columns=engine.DECISION)
        written = engine.run_to_end(stream, f"{folder}/out", f"{folder}/checkpoint")
    return engine.final_decisions(written)


def stream_pending(spark, d) -> DataFrame:
    """Rows still held back, as the state store has them."""
    folder = io.fresh_dir(spark, "gap-state")
    _decisions(spark, d, folder)
    return engine.held_rows(spark, f"{folder}/checkpoint").select("record_id", "seq", "ts", "payload")


def stream_newer_only(spark, d) -> DataFrame:
    """Changes that go out when a change must be newer than all sent before it for its record."""
    out = _decisions(spark, d, io.fresh_dir(spark, "gap-newer"), columns=("seq", "decision", "ts"), mode="strict", newer_only=True)
    return out.filter(F.col("decision").isin(*S.EMITTED)).select("record_id", "seq", "decision", "ts")


def _wire(spark, d, folder: str, faulty: bool) -> tuple[DataFrame, DataFrame]:
    src.cdc_wire(spark, d, faulty).write.parquet(f"{folder}/cdc")
    src.fill_wire(spark, d, faulty).write.parquet(f"{folder}/fills")
    return tuple(io.read_wire(spark, "parquet", f"{folder}/{name}", stream=True, max_per_trigger=FILES) for name in ("cdc", "fills"))


def stream_outputs(spark, d, mode="compat", faulty=False) -> DataFrame:
    """JSON in, JSON out, all outputs of the gap handler through one sink."""
    folder = io.fresh_dir(spark, "gap-wire")
    out = engine.outputs(*_wire(spark, d, folder, faulty), mode)
    return engine.run_to_end(out, f"{folder}/out", f"{folder}/checkpoint", partition_by="topic").select(
        "topic", "key", "value", "rec_ts", "rec_offset")


def stream_first_fills(spark, d) -> DataFrame:
    """Fills, each sent twice: one answer per command remains."""
    folder = io.fresh_dir(spark, "gap-fills")
    fills = src.fill_wire(spark, d)
    fills.unionByName(fills.withColumn("rec_offset", F.col("rec_offset") + 1_000_000_000)).write.parquet(f"{folder}/in")
    parsed = codecs.usable(codecs.parse_fills(io.read_wire(spark, "parquet", f"{folder}/in", stream=True)))
    first = kept.first_fills(parsed.select("record_id", "event_id", "cutoff", "rec_offset"), ANSWERS_KEPT_MS)
    return engine.run_to_end(first.drop("rec_offset"), f"{folder}/out", f"{folder}/checkpoint", idle=False)


def _in_deliveries(spark, rows: DataFrame, folder: str, deliveries: int) -> DataFrame:
    """Rows as files in no order, as a stream that takes them in so many micro-batches."""
    rows.repartition(deliveries * FILES_OF_DELIVERY).write.parquet(folder)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", FILES_OF_DELIVERY).parquet(folder)


def current_state_stream(spark, d, deliveries: int = 5) -> DataFrame:
    """The newest row per key, merged micro-batch by micro-batch into a table of buckets; rows come in no order. A second run over the
    same checkpoint finds nothing new."""
    folder = io.fresh_dir(spark, "state-kept")
    rows = src.table(spark, d, "events").select(
        F.col("user_id").alias("record_id"), F.col("event_id").alias("seq"), "event_type", "value", "props")
    stream = _in_deliveries(spark, rows, f"{folder}/in", deliveries)
    table = kept.UpsertTable(spark, f"{folder}/table", rows.schema)
    for _ in range(2):
        table.follow(stream, f"{folder}/checkpoint")
    table.vacuum()
    return table.read()


def materialized_image_stream(spark, d) -> DataFrame:
    """Images kept behind the gap handler's stream: what it sends out goes on as changes to a second stage of state."""
    folder = io.fresh_dir(spark, "image-kept")
    fields = src.change_fields(F.col("event_type"), F.col("value").cast("string"), F.get_json_object("props", "$.k"))
    events = _events(spark, d)
    rows = src.tag_events(events, extra={"fields": fields}).withColumn("arrived", F.col("ts"))
    rows = rows.withColumn("payload", F.to_json("fields", {"ignoreNullFields": "false"})).drop("fields")
    changes = kept.emitted_changes(engine.gap_stream(rows))
    image = kept.newest_images(engine.run_to_end(kept.images(changes), f"{folder}/out", f"{folder}/checkpoint"))
    return image.select("record_id", F.col("image")["event_type"].alias("event_type"), F.col("image")["k"].cast("bigint").alias("k"),
                        F.col("image")["value"].cast("double").alias("value"))


def replay_gaps_stream(spark, d, deliveries: int = 3) -> DataFrame:
    """Whole seconds in which nothing happened, from events that arrive in no order."""
    folder = io.fresh_dir(spark, "numbers-kept")
    rows = src.table(spark, d, "events").select(F.floor(epoch_ms(F.col("ts")) / 1000).cast("bigint").alias("second"))
    stream = _in_deliveries(spark, rows, f"{folder}/in", deliveries)
    return kept.missing(engine.run_to_end(kept.seen_runs(stream, "second"), f"{folder}/out", f"{folder}/checkpoint"))


def outage_alarm_stream(spark, d) -> DataFrame:
    """Alarms of outages beyond the limit, that of one which still lasts included: by then the times of all attempts are beyond it."""
    from .catalog import attempts

    folder = io.fresh_dir(spark, "outage-kept")
    asked = io.stored(attempts(spark, d).select("entity_type", "seq", "ts", "outcome"), "attempts")
    half = asked.agg((F.max("seq") / 2).cast("bigint")).first()[0]
    for part in (F.col("seq") <= half, F.col("seq") > half):
        asked.filter(part).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(asked.schema).option("maxFilesPerTrigger", FILES).parquet(f"{folder}/in")
        written = engine.run_to_end(kept.outages(stream), f"{folder}/out", f"{folder}/checkpoint")
    return written.filter("kind = 'breach'").select("entity_type", "started", F.col("at").alias("breached_at"))


def repair_loop(spark: SparkSession, folder: str, images, mode: str = "compat", max_per_trigger: int = FILES) -> DataFrame:
    """Gap handler and fill worker in turns over `folder`, until a round brings no new command.

    The two are separate queries joined by storage: commands out, fills in. Each run goes on from its checkpoint, so a
    command is answered once. Returns all wire rows written.
    """
    none = spark.createDataFrame([], io.WIRE)
    io.write_batch_once(none, "parquet", f"{folder}/fills", 0)
    answered = -1
    while True:
        handled = engine.outputs(io.read_wire(spark, "parquet", f"{folder}/cdc", stream=True, max_per_trigger=max_per_trigger),
                                 io.read_wire(spark, "parquet", f"{folder}/fills/*", stream=True, max_per_trigger=max_per_trigger), mode)
        out = engine.run_to_end(handled, f"{folder}/out", f"{folder}/handler", partition_by="topic")
        commands = out.filter(F.col("topic") == S.TOPICS["fill_command"]).count()
        if commands == max(answered, 0):
            return out
        answered = commands
        asked = (spark.readStream.schema(out.schema).parquet(f"{folder}/out")
                 .filter(F.col("topic") == S.TOPICS["fill_command"]))
        engine.fill_worker(asked, images, f"{folder}/fills", f"{folder}/worker").awaitTermination()


def _images(spark, d):
    return lambda: src.snapshot(spark, d).withColumn("record_id", F.col("record_id").cast("string"))


def fill_loop(spark, d) -> DataFrame:
    """All changes and gaps come first, then the answers of the worker from the current images."""
    folder = io.fresh_dir(spark, "gap-loop")
    src.cdc_wire(spark, d, faulty=False).write.parquet(f"{folder}/cdc")
    return repair_loop(spark, folder, _images(spark, d)).select("topic", "key", "value", "rec_offset")


def fill_command_source(spark, d, older=False) -> DataFrame:
    """The fill worker, or the older one, on the command topic: wire rows in, fill events out. A second run finds nothing new."""
    from .catalog import fill_commands

    folder = io.fresh_dir(spark, "gap-commands")
    record = F.col("record_id").cast("string")
    fill_commands(spark, d).select(
        record.alias("key"), codecs.encode(record.alias("recordId"), F.col("entity_type").alias("entityType"),
                                           F.col("event_id").alias("eventId")).alias("value"),
        F.col("seq").alias("rec_ts"), F.col("seq").alias("rec_offset")).write.parquet(f"{folder}/commands")
    for _ in range(2):
        asked = io.read_wire(spark, "parquet", f"{folder}/commands", stream=True, max_per_trigger=FILES)
        engine.fill_worker(asked, _images(spark, d), f"{folder}/fills", f"{folder}/checkpoint", older=older).awaitTermination()
    return io.read_wire(spark, "parquet", f"{folder}/fills/*").select("key", "value", "rec_offset")
