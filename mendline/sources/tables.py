"""How the benchmark tables play the roles of the streams and of the current-state table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import epoch_ms
from . import codecs

ENTITY = "User"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _k() -> Column:
    return F.get_json_object("props", "$.k").cast("bigint")


def wire_type(event_type: Column) -> Column:
    """Type on the wire: gap, a type of its own for purchases, else normal; null for fills."""
    return (F.when(event_type == "error", "G").when(event_type == "purchase", "X")
            .when(event_type != "signup", "N"))


def gap_info(event_id: Column) -> Column:
    return F.struct(event_id.alias("fromReplayId"), (event_id + 1).alias("toReplayId"), F.lit("missed").alias("reason"))


def received(event_id: Column, ms: Column) -> Column:
    """Record time on the wire: in a tenth of the rows days before that of earlier rows."""
    return F.when(event_id % 10 == 3, ms - 5 * 86_400_000).otherwise(ms)


def tag_events(events: DataFrame, failing: bool = False, extra: dict[str, Column] | None = None) -> DataFrame:
    """`events` as tagged rows: errors are gaps, signups are fills, the rest are changes.

    The cutoff of a fill lies k hours before it. With `failing`, fills of low value report a failure.
    """
    is_fill = F.col("event_type") == "signup"
    ms = epoch_ms(F.col("ts"))
    ok = F.col("value") >= 5.0
    cutoff, payload, err = ms - _k() * 3_600_000, F.col("props"), F.lit(None).cast("string")
    if failing:
        failed = is_fill & ~ok
        cutoff = F.when(failed, F.lit(-1).cast("bigint")).otherwise(cutoff)
        payload = F.when(failed, "{}").otherwise(payload)
        err = F.when(failed, "no image")
    is_gap = F.col("event_type") == "error"
    return events.select(
        F.col("user_id").alias("record_id"),
        F.col("event_id").alias("seq"),
        ms.alias("rec_ts"),
        wire_type(F.col("event_type")).alias("type"),
        F.when(~is_fill, F.col("event_id")).alias("replay_id"),
        F.when(is_gap, gap_info(F.col("event_id"))).alias("gap"),
        F.when(F.col("event_type") == "error", "G").when(is_fill, "F").otherwise("N").alias("kind"),
        F.col("event_id").cast("string").alias("event_id"),
        F.lit(ENTITY).alias("entity"),
        ms.alias("ts"),
        payload.alias("payload"),
        F.when(is_fill, cutoff).alias("cutoff"),
        F.when(is_fill, ok if failing else F.lit(True)).alias("is_success"),
        F.when(is_fill, err).alias("err"),
        *[c.alias(n) for n, c in (extra or {}).items()],
    )


def cdc_input(spark: SparkSession, sf_dir: str, failing: bool = False) -> DataFrame:
    return tag_events(table(spark, sf_dir, "events"), failing)


def cdc_wire(spark: SparkSession, sf_dir: str, faulty: bool = True) -> DataFrame:
    """Changes and gaps as JSON. With `faulty`, rows with certain k are damaged in one way each."""
    k = _k()
    bad = lambda n: (k == n) if faulty else F.lit(False)
    rec = F.col("user_id").cast("string")
    is_gap = F.col("event_type") == "error"
    text = codecs.encode(
        F.col("event_id").cast("string").alias("eventId"),
        F.lit(ENTITY).alias("entity"),
        F.when(~bad(17), rec).alias("recordId"),
        F.when(~bad(27), wire_type(F.col("event_type"))).alias("type"),
        epoch_ms(F.col("ts")).alias("timestamp"),
        F.col("event_id").alias("replayId"),
        codecs.field_map(F.col("props")).alias("changedFields"),
        F.when(is_gap, gap_info(F.col("event_id"))).alias("gap"))
    value = (F.when(bad(7), F.substring(text, 1, 40)).when(bad(47), F.lit(None)).otherwise(text))
    key = F.when(bad(37), F.concat(rec, F.lit("x"))).when(bad(57), F.lit(None)).otherwise(rec)
    return (table(spark, sf_dir, "events").filter(F.col("event_type") != "signup")
            .select(key.alias("key"), value.alias("value"), received(F.col("event_id"), epoch_ms(F.col("ts"))).alias("rec_ts"),
                    F.col("event_id").alias("rec_offset")))


def fill_wire(spark: SparkSession, sf_dir: str, faulty: bool = False, forced: bool = False) -> DataFrame:
    """Fills as JSON; those with k below 50 come from the older producer, without success flag and message. Their
    offsets overlap with those of the changes. With `faulty`, some are cut off; with `forced`, half of the others are."""
    rec = F.col("user_id").cast("string")
    ms = epoch_ms(F.col("ts"))
    first = [rec.alias("recordId"), F.lit(ENTITY).alias("entityType"),
             F.col("event_id").cast("string").alias("eventId"),
             (ms - _k() * 3_600_000).alias("cutoffLastModifiedEpochMs"),
             codecs.field_map(F.col("props")).alias("allFields")]
    newer = codecs.encode(*first, (F.col("value") >= 5.0).alias("isSuccess"),
                          F.when(F.col("value") >= 5.0, "").otherwise("no image").alias("errMessage"),
                          *([(_k() % 2 == 0).alias("force")] if forced else []))
    return (table(spark, sf_dir, "events").filter(F.col("event_type") == "signup")
            .withColumn("value_json", F.when(_k() < 50, codecs.encode(*first)).otherwise(newer))
            .select(rec.alias("key"), F.when((_k() == 7) & F.lit(faulty), F.substring("value_json", 1, 40)).otherwise(F.col("value_json")).alias("value"),
                    received(F.col("event_id"), ms).alias("rec_ts"), (F.col("event_id") - 1).alias("rec_offset")))


def snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of all customers by (entity_type, record_id). One market segment is of another entity type; in one the
    modification time is no number; images of customers in debt are cut off; half the customers have an older version too. `taken`
    is when the source had a version."""
    key, hours = F.col("c_custkey"), F.pmod(F.col("c_custkey") * 7919, F.lit(720))
    text = F.when(F.col("c_mktsegment") == "FURNITURE", F.lit("\"n/a\"")).otherwise(F.col("modified").cast("string"))
    whole = F.concat(F.lit('{"name":"'), F.concat_ws("-", "c_name", "version"), F.lit('","lastModifiedEpochMs":'), text, F.lit("}"))
    versions = F.when(key % 2 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return (table(spark, sf_dir, "customer").withColumn("version", F.explode(versions))
            .withColumn("modified", F.lit(1_704_067_200_000) + hours * 3_600_000 - F.col("version") * 86_400_000)
            .select(F.when(F.col("c_mktsegment") == "MACHINERY", "Company").otherwise(ENTITY).alias("entity_type"),
                    key.alias("record_id"),
                    F.when((F.col("c_acctbal") < 0) & (F.col("version") == 0), F.substring(whole, 1, 12)).otherwise(whole).alias("image"), "version",
                    F.col("modified").alias("taken")))


def change_fields(event_type: Column, value: Column, k: Column) -> Column:
    """The field map an event carries: all fields for a fill (signup), else the ones its type changes."""
    return (F.when(event_type == "signup", F.create_map(F.lit("event_type"), event_type, F.lit("k"), k,
                                                        F.lit("value"), value))
            .when(event_type == "view", F.create_map(F.lit("value"), value))
            .when(event_type == "click", F.create_map(F.lit("k"), k))
            .when(event_type == "purchase", F.create_map(F.lit("k"), k, F.lit("value"), value)))


def fill_attempts(commands: DataFrame, k: Column) -> DataFrame:
    """Outcome of asking the source system, one row per command."""
    return commands.withColumn("status", F.when(k < 10, "404").when(k < 30, "503")
                               .when(k < 40, "timeout").otherwise("200"))
