"""Dead letters back into the stream.

When a gap fails, the rows that waited for it go out as dead letters. Here they are kept in a ledger, and once the record's gap has been
asked for again and a new image has come, they are merged behind that fill: the fill first, then those dead letters
that are newer than its cutoff, in order. Each dead letter is settled exactly once, however often runs or batches are repeated:

* `Ledger.keep` writes the dead letters of a (micro-)batch to a folder of its own by batch id; a repeated batch replaces it;
* `Ledger.replay` settles what has neither been settled by an earlier run nor lacks a fill, and writes the outcome to a folder
  of its own by run id. That folder is output and ledger in one, so there is no moment at which one says so and the other doesn't.

A run that failed or is repeated starts from what runs with other ids have settled. Hot records are joined and numbered by the splitting operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import to_millis
from ..sources import io
from .gaps import fill_succeeded
from .ordered import DEFAULT, Layout, number_rows

_KEY = ["record_id", "seq"]
#: A dead letter as the ledger keeps it; `open_seq` is the gap whose failure made it one.
LETTER = ("record_id", "seq", "open_seq", "type", "event_id", "entity", "ts", "payload")
#: What a run puts out, in order of (record_id, pos): the fill at 0, rows that go out behind it, and rows that don't without a place.
OUTCOME = ("record_id", "seq", "open_seq", "decision", "pos", "type", "event_id", "entity", "ts", "payload", "cutoff")


def dead_letters(decided: DataFrame) -> DataFrame:
    """The dead letters among the rows of `limits.decide_limited`, or of `gaps.decide` in strict: there the failed fill names the gap."""
    cause = F.coalesce("fail_seq", "close_seq") if "fail_seq" in decided.columns else F.col("close_seq")
    kind = F.coalesce("type", "kind") if "type" in decided.columns else F.col("kind")
    return decided.filter(F.col("decision") == "dead_letter").select(
        *_KEY, cause.alias("open_seq"), kind.alias("type"), "event_id", "entity", "ts", "payload")


def dead_letters_of_stream(decisions: DataFrame) -> DataFrame:
    """The dead letters among decision rows of a stream, which name the row that caused them as `out_seq`."""
    return decisions.filter(F.col("decision") == "dead_letter").select(
        *_KEY, F.col("out_seq").alias("open_seq"), F.coalesce("type", "kind").alias("type"), "event_id", "entity", "ts", "payload")


class Ledger:
    """Dead letters and what has become of them, as two families of Parquet folders under `folder`."""

    def __init__(self, spark: SparkSession, folder: str, schema: str):
        """`schema` is that of a dead letter: names and types of LETTER."""
        self.spark, self.folder = spark, folder
        self.letters = spark.createDataFrame([], schema).select(*LETTER)
        io.write_batch_once(self.letters, "parquet", f"{folder}/letters", -1)
        none = self._settle(self.letters.withColumns({c: F.lit(None).cast(t) for c, t in (
            ("cutoff", "bigint"), ("fill_payload", "string"), ("fill_event", "string"))}), "ms", "ms", DEFAULT)
        self.outcome = none.schema
        io.write_batch_once(none, "parquet", f"{folder}/settled", -1)

    def keep(self, rows: DataFrame, batch_id: int) -> None:
        """Enter the dead letters of a batch, once per batch id."""
        io.write_batch_once(rows.select(*LETTER), "parquet", f"{self.folder}/letters", batch_id)

    def _folders(self, family: str, but: int | None = None) -> list[str]:
        """The batches' folders; one that is about to be replaced must not be read meanwhile."""
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{family}/batch-*")
        found = hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).globStatus(hadoop)
        return [str(f.getPath()) for f in found if but is None or not str(f.getPath()).endswith(f"/batch-{but:010d}")]

    def kept(self) -> DataFrame:
        """Every dead letter once; a row may have been delivered under two batch ids."""
        return self.spark.read.schema(self.letters.schema).parquet(*self._folders("letters")).dropDuplicates(_KEY)

    def settled(self, but: int | None = None) -> DataFrame:
        """What all runs, or all but one, have put out; with the `run`."""
        run = F.regexp_extract(F.input_file_name(), r"/batch-(-?\d+)/", 1).cast("bigint")
        return self.spark.read.schema(self.outcome).parquet(*self._folders("settled", but)).withColumn("run", run)

    def open(self, but: int | None = None) -> DataFrame:
        """Dead letters not settled yet, or by no other run than one."""
        return self.kept().join(self.settled(but).filter("seq IS NOT NULL").select(*_KEY), _KEY, "left_anti")

    def commands(self, but: int | None = None) -> DataFrame:
        """A command for each record with open dead letters, named after the first of them."""
        first = F.min(F.struct("seq", "entity", "event_id")).alias("f")
        return self.open(but).groupBy("record_id").agg(first).select("record_id", F.col("f.entity").alias("entity_type"), "f.event_id", "f.seq")

    def replay(self, fills: DataFrame, run_id: int, *, ts_unit: str = "ms", cutoff_unit: str = "ms", layout: Layout = DEFAULT) -> DataFrame:
        """Settle the open dead letters of records that have a good fill: record_id, event_id, cutoff, is_success, payload; of several the
        one with the latest cutoff. Returns what this run put out."""
        best = F.max_by(F.struct("cutoff", "payload", "event_id"), F.struct("cutoff", "event_id")).alias("_f")
        good = fills.filter(fill_succeeded()).groupBy("record_id").agg(best).select(
            "record_id", F.col("_f.cutoff").alias("cutoff"), F.col("_f.payload").alias("fill_payload"), F.col("_f.event_id").alias("fill_event"))
        out = self._settle(io.stored(self.open(run_id).join(good, "record_id"), "answered"), ts_unit, cutoff_unit, layout)
        io.write_batch_once(out, "parquet", f"{self.folder}/settled", run_id)
        return self.spark.read.schema(out.schema).parquet(f"{self.folder}/settled/batch-{run_id:010d}")

    def _settle(self, met: DataFrame, ts_unit: str, cutoff_unit: str, layout: Layout) -> DataFrame:
        newer = F.coalesce(to_millis(F.col("ts"), ts_unit) > to_millis(F.col("cutoff"), cutoff_unit), F.lit(False))
        rows = met.withColumn("decision", F.when(newer, "flushed").otherwise("dropped")).withColumn("_run", F.lit(0))
        placed = number_rows(rows, "pos", "_run", layout, where=F.col("decision") == "flushed")
        # One fill a record, by its first dead letter.
        first = rows.groupBy("record_id").agg(F.min(F.struct("seq", "open_seq", "entity", "cutoff", "fill_payload", "fill_event")).alias("f"))
        fill = first.select("record_id", F.lit(None).cast("bigint").alias("seq"), "f.open_seq", F.lit("filled").alias("decision"), F.lit(0).cast("bigint").alias("pos"),
                            F.lit("F").alias("type"), F.col("f.fill_event").alias("event_id"), "f.entity",
                            to_millis(F.col("f.cutoff"), cutoff_unit).alias("ts"), F.col("f.fill_payload").alias("payload"), "f.cutoff")
        return placed.select(*OUTCOME).unionByName(fill.select(*OUTCOME))


def keep_stream(ledger: Ledger, decisions: DataFrame, checkpoint: str):
    """Enter the dead letters of a stream of decision rows as they come, by micro-batch. Returns the running query."""
    def keep(batch: DataFrame, batch_id: int) -> None:
        ledger.keep(dead_letters_of_stream(batch), batch_id)

    return (decisions.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
