"""Streaming queries: the gap handler, the fill worker, and both in a loop through storage."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from .. import schemas as S
from ..functions import to_millis
from ..operators import counters, lookup
from ..sources import codecs, io
from . import processor

#: What a row counts as for as long as it waits.
WAITING = {"buffered": "pending", "gap_held": "gap_dropped", "fill_waiting": "fill_ignored"}

#: Rows from JSON that the processor has written: all or nothing, texts of any length.
UNPACK = {"mode": "FAILFAST", "maxStringLen": str(2**31 - 1)}

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def prepare(spark: SparkSession) -> None:
    """State on RocksDB, with changelogs instead of full snapshots per batch; processor code travels with
    the query, so executors need no copy of this package."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    cloudpickle.register_pickle_by_value(processor)


def complete(rows: DataFrame) -> DataFrame:
    """Tagged rows with all columns that the processor carries; the gap information as JSON text. A table without sources
    counts as one source, whose offsets are `seq` and whose record time is `arrived`."""
    have = set(rows.columns)
    given = {"source_rank": F.lit(0), "rec_offset": F.col("seq"), "rec_ts": F.col("arrived") if "arrived" in have else F.lit(None)}
    out = rows.withColumns({c: x for c, x in given.items() if c not in have})
    if dict(rows.dtypes).get("gap", "string") != "string":
        out = out.withColumn("gap", F.to_json("gap"))
    wanted = {f.name: f.dataType for f in processor.state_schema()}
    return out.withColumns({c: F.col(c).cast(t) if c in out.columns else F.lit(None).cast(t) for c, t in wanted.items()})


#: The columns that `final_decisions` reads beside the record.
DECISION = ("seq", "decision")


def gap_stream(rows: DataFrame, mode: str = "compat", *, initial: DataFrame | None = None, disorder: str = "0 seconds",
               columns: Sequence[str] | None = None, **options) -> DataFrame:
    """Decision rows for a stream of tagged rows. Options: timeout_ms, max_buffer, timers, newer_only, match, wait_ms, ts_unit, cutoff_unit.

    With timers="event" a quiet record's gap fails once the watermark of `rec_ts` is beyond its deadline; `disorder` is how
    far record times may run backwards over all records: rows later than that are dropped by Spark. Such a stream ends with `availableNow`.
    `initial` is the state that a table run has left (`handover`). With `columns`, decision rows have these and `record_id` alone, and the others
    are not written out and parsed again; with `only`, rows with other decisions stay out. The rules, and what lies in state, are the same."""
    prepare(rows.sparkSession)
    key_type = rows.schema["record_id"].dataType
    timers = options.get("timers") if options.get("timeout_ms") is not None else None
    rows, carried = complete(rows), processor.state_schema().fieldNames()
    # The processor sets `arrived`.
    packed = [F.col("record_id"), F.to_json(F.struct(*[c for c in carried if c != "arrived"])).alias("row")]
    if timers == "event":
        rows = rows.withColumn("_event_time", F.timestamp_millis("rec_ts")).withWatermark("_event_time", disorder)
        packed.append(F.col("_event_time"))
    if initial is not None:
        state = [f.name for t in (processor.PROGRESS, processor.GAP) for f in t]
        initial = initial.select("record_id", "part", F.when(F.col("part") == processor.HELD_PART, F.to_json(F.struct(*carried)))
                                 .otherwise(F.to_json(F.struct(*state))).alias("row")).groupBy("record_id")
    out = rows.select(*packed).groupBy("record_id").transformWithState(
        statefulProcessor=processor.PackedGapProcessor(mode, columns=columns, **options),
        outputStructType=T.StructType([T.StructField("record_id", key_type), T.StructField("rows", T.StringType())]),
        outputMode="Append",
        timeMode="EventTime" if timers == "event" else "ProcessingTime" if timers else "None",
        initialState=initial)
    return _decision_rows(out, key_type, columns)


def _decision_rows(packed: DataFrame, key_type: T.DataType, columns: Sequence[str] | None = None) -> DataFrame:
    """What `PackedGapProcessor` puts out as rows. Text that can't be read back ends the query."""
    rows = packed.select("record_id", F.explode(F.from_json("rows", processor.packed_schema(columns), UNPACK)).alias("d"))
    if columns is not None:
        return rows.select("record_id", "d.*")
    within = set(processor.state_schema().fieldNames())
    return rows.select("record_id", *[F.col("d.row" if c in within else "d")[c].alias(c)
                                      for c in processor.output_schema(key_type).fieldNames()[1:]])


def handover(decided: DataFrame) -> DataFrame:
    """The state in which a table run (`gaps.decide`, all rows up to some point of each source) leaves its records: progress, open gaps and the
    rows they hold back. A stream over what comes after goes on from it. Rows stay rows: a large buffer is no array."""
    emitted = F.col("decision").isin(*S.EMITTED)
    out = emitted | F.col("decision").isin(*processor.ROUTED)
    kept = complete(decided)
    latest = lambda rank: F.max(F.when(F.col("source_rank") == rank, F.col("rec_ts")))
    command = F.when(F.col("decision") == "command", F.struct(
        "seq", F.col("arrived").alias("opened_at"), F.col("event_id").alias("open_event"), "entity",
        F.col("source_rank").alias("open_rank"), F.col("rec_offset").alias("open_offset")))
    whole = kept.groupBy("record_id").agg(
        latest(0).alias("latest_0"), latest(1).alias("latest_1"), F.count_if(out).alias("emitted"),
        F.max(F.when(emitted, F.col("ts"))).alias("newest"),
        F.max(F.when(F.col("source_rank") == 0, F.col("arrived"))).alias("passed"),
        F.max(command).alias("gap"), F.max(F.when(F.col("kind") == "F", F.col("seq"))).alias("filled"),
        F.count_if(F.col("decision") == "pending").alias("n_buffered"))
    whole = io.stored(whole, "handover")
    open_gap = F.col("gap").isNotNull() & (F.coalesce("filled", F.lit(-1)) < F.col("gap.seq"))
    gap = {"opened_at": "gap.opened_at", "open_seq": "gap.seq", "open_event": "gap.open_event", "entity": "gap.entity", "n_buffered": "n_buffered",
           "handed": "n_buffered", "open_rank": "gap.open_rank", "open_offset": "gap.open_offset"}
    # One row for a record's progress and its open gap: a row costs calls to the state store.
    record = whole.select("record_id", F.lit(processor.PROGRESS_PART).alias("part"),
                          *processor.PROGRESS.fieldNames(), *[F.when(open_gap, F.col(x)).alias(c) for c, x in gap.items()])
    held = kept.filter(F.col("decision") == "pending").select("record_id", F.lit(processor.HELD_PART).alias("part"), *processor.state_schema().fieldNames())
    rows = record.unionByName(held, allowMissingColumns=True)
    wanted = {f.name: f.dataType for t in (processor.PROGRESS, processor.GAP, processor.state_schema()) for f in t}
    return rows.select("record_id", "part", *[F.col(c).cast(t) if c in rows.columns else F.lit(None).cast(t).alias(c) for c, t in wanted.items()])


def final_decisions(decisions: DataFrame) -> DataFrame:
    """From the decision rows written so far: one per input row, with `pending` for rows still held back. A gap marker that waits stands
    within an open gap, and a fill that waits has found none."""
    rows = decisions.filter(~F.col("decision").isin("gap_failed", "repeated"))
    last = F.max(F.struct((~F.col("decision").isin(*WAITING)).alias("ended"), "decision"))
    names = F.create_map(*[F.lit(x) for pair in WAITING.items() for x in pair])
    return rows.groupBy("record_id", "seq").agg(last.alias("_l")).select(
        "record_id", "seq",
        F.when(F.col("_l.ended"), F.col("_l.decision")).otherwise(names[F.col("_l.decision")]).alias("decision"))


def run_to_end(stream: DataFrame, folder: str, checkpoint: str, *, partition_by: str | None = None, idle: bool = True) -> DataFrame:
    """Run over all data there is now, then return what has been written to `folder` in total.

    The Parquet file sink writes each micro-batch exactly once, also when a batch is repeated. Not for streams
    with timers of the clock: these wait for it and so never come to an end. With `idle=False` there are no micro-batches without
    data, so that a stream whose state expires by the clock ends too.
    """
    spark, name = stream.sparkSession, "spark.sql.streaming.noDataMicroBatches.enabled"
    writer = (stream.writeStream.format("parquet").outputMode("append").option("path", folder)
              .option("checkpointLocation", checkpoint).trigger(availableNow=True))
    if partition_by:
        writer = writer.partitionBy(partition_by)
    before = spark.conf.get(name)
    spark.conf.set(name, str(idle and before == "true").lower())  # read when a query starts
    try:
        query = writer.start()
    finally:
        spark.conf.set(name, before)
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(folder)


def first_fills(fills: DataFrame, within: str, time: str = "rec_ts") -> DataFrame:
    """A stream of fills without later copies of the same answer, for as long as `within`; `time` is in milliseconds."""
    return (fills.withColumn("_at", F.timestamp_millis(time)).withWatermark("_at", within)
            .dropDuplicatesWithinWatermark(["record_id", "event_id"]).drop("_at"))


def held_rows(spark: SparkSession, checkpoint: str) -> DataFrame:
    """Rows now held back, read from the state store of a stopped or running query."""
    state = (spark.read.format("statestore").option("path", checkpoint)
             .option("stateVarName", "held").load())
    row = F.from_json("line", processor.state_schema(), UNPACK)
    lines = state.select(F.col("key.record_id").alias("record_id"), F.explode(F.split("list_element.rows", "\n")).alias("line"))
    return lines.select("record_id", F.explode(F.array(row)).alias("v")).select("record_id", "v.*")


# --- one sink for all outputs ---------------------------------------------------------------------

#: Decisions that have a topic.
ROUTED = (*S.EMITTED, "command", *S.ERRORS)


def route(decisions: DataFrame, mode: str = "compat", cutoff_unit: str = "ms") -> DataFrame:
    """Decision rows as wire rows with the topic they belong to. The Kafka sink reads the `topic` column;
    for files, partition by it. One query and one write serve all outputs. Events go out as they came, with key and time of the
    row that released them; `rec_offset` numbers a record's rows in order of emission."""
    strict = mode == "strict"
    made = F.col("decision").isin("filled", "forced")
    record = F.col("record_id").cast("string")
    named = F.when(made, F.coalesce("own_id", record)).otherwise(record)
    emitted = F.col("decision").isin(*S.EMITTED)
    topic = (F.when(emitted, S.TOPICS["cdc_out"])
             .when(F.col("decision") == "command", S.TOPICS["fill_command"])
             .when(F.col("decision").isin(*S.ERRORS), S.TOPICS["error"]))
    nothing = F.lit(None)
    event = codecs.encode(
        F.when(~made | F.lit(strict), F.col("event_id")).alias("eventId"),
        F.when(made & ~F.lit(strict), named).otherwise(F.col("entity")).alias("entity"),
        named.alias("recordId"),
        F.when(made, "F").otherwise(F.coalesce("type", "kind")).alias("type"),
        F.when(made, to_millis(F.col("cutoff"), cutoff_unit) if strict else nothing)
         .otherwise(F.col("ts")).cast("bigint").alias("timestamp"),
        F.when(made, F.lit(0).cast("bigint")).otherwise(F.col("replay_id")).alias("replayId"),
        codecs.field_map(F.col("payload")).alias("changedFields"),
        F.when(~made, codecs.field_map(F.col("gap"))).alias("gap"))
    command = codecs.encode(record.alias("recordId"), F.col("entity").alias("entityType"),
                            F.col("event_id").alias("eventId"))
    error = codecs.encode(record.alias("recordId"), F.col("entity").alias("entityType"),
                          F.col("event_id").alias("eventId"), F.col("decision").alias("reason"),
                          F.col("err").alias("errMessage"), codecs.field_map(F.col("payload")).alias("fields"))
    value = F.when(emitted, event).when(F.col("decision") == "command", command).otherwise(error)
    return (decisions.select(topic.alias("topic"), F.coalesce("out_key", record).alias("key"), value.alias("value"),
                             F.col("out_ts").alias("rec_ts"), F.col("emitted").alias("rec_offset"))
            .filter(F.col("topic").isNotNull()))


def route_quarantine(parsed: DataFrame, mode: str = "strict") -> DataFrame:
    """Unusable input as error rows; stateless, so it may be merged with `route` in one query."""
    q = codecs.quarantine(parsed, mode)
    return q.select(F.lit(S.TOPICS["error"]).alias("topic"), "key",
                    codecs.encode(F.col("key").alias("recordId"), F.col("problem").alias("reason"),
                                  F.col("value").alias("text")).alias("value"),
                    "rec_ts", "rec_offset")


def outputs(cdc_wire: DataFrame, fill_wire: DataFrame, mode: str = "compat", **options) -> DataFrame:
    """The whole gap handler, from wire rows in to wire rows out. Rows that can't be used go to the error topic."""
    cdc, fills = codecs.parse_cdc(cdc_wire), codecs.parse_fills(fill_wire)
    decisions = gap_stream(codecs.tag(cdc, fills, mode), mode, only=ROUTED, **options)
    routed = route(decisions, mode, options.get("cutoff_unit", "ms"))
    return routed.unionByName(route_quarantine(cdc, mode)).unionByName(route_quarantine(fills, mode))


def fill_worker(commands_wire: DataFrame, read_images: Callable[[], DataFrame], folder: str, checkpoint: str,
                base: str = "", older: bool = False) -> StreamingQuery:
    """Answer commands as they come. The images are read anew for every micro-batch, so that a fill's
    fields and cutoff come from the same, newest snapshot. Progress is committed only after the write.
    The `older` worker leaves unanswerable commands alone, and the success flag and message out."""
    def answer(batch: DataFrame, batch_id: int) -> None:
        commands = codecs.decode(batch, S.FILL_COMMAND).select(
            F.col("v.recordId").alias("record_id"), F.col("v.entityType").alias("entity_type"),
            F.col("v.eventId").alias("event_id"), F.col("rec_offset").alias("seq"), "rec_ts")
        answers = lookup.fill_lookup(commands, read_images(), base, keep=["rec_ts"])
        flags = [] if older else [F.col("is_success").alias("isSuccess"), F.col("err").alias("errMessage")]
        fills = (answers.filter("is_success") if older else answers).select(
            F.col("record_id").alias("key"),
            codecs.encode(F.col("record_id").alias("recordId"), F.col("entity_type").alias("entityType"),
                          F.col("event_id").alias("eventId"), F.col("cutoff").alias("cutoffLastModifiedEpochMs"),
                          codecs.field_map(F.col("all_fields")).alias("allFields"), *flags).alias("value"),
            "rec_ts", F.col("seq").alias("rec_offset"))
        io.write_batch_once(fills, "parquet", folder, batch_id)

    return (commands_wire.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def observed(decisions: DataFrame, name: str = "gap_counters") -> DataFrame:
    """Attach the counters to a running stream; each micro-batch reports its share (see `LiveCounters`)."""
    return decisions.observe(name, *[c.alias(n) for n, c in counters.arrival_counters().items()])


class LiveCounters(StreamingQueryListener):
    """Running totals of the observed counters. Register with `spark.streams.addListener`."""

    def __init__(self, name: str = "gap_counters"):
        self.name, self.totals = name, {}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        row = event.progress.observedMetrics.get(self.name)
        if row is not None:
            for counter, n in row.asDict().items():
                self.totals[counter] = self.totals.get(counter, 0) + n

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
