"""Tables that streams keep up to date: current state, images, missing numbers, outages, answers seen."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .. import schemas as S
from ..operators.ordered import DEFAULT, PART, Layout, scan
from . import engine, states

#: Numbers of a block of `seen_runs`.
BLOCK = 1 << 16


def _stateful(rows: DataFrame, keys: Sequence[str], state, out: T.StructType, time_mode: str = "None") -> DataFrame:
    engine.prepare(rows.sparkSession)
    cloudpickle.register_pickle_by_value(states)
    return rows.groupBy(*keys).transformWithState(statefulProcessor=state, outputStructType=out, outputMode="Append", timeMode=time_mode)


def _schema(rows: DataFrame, columns: Sequence[str], more: str = "") -> T.StructType:
    kept = [T.StructField(c, rows.schema[c].dataType) for c in columns]
    return T.StructType([*kept, *(T.StructType.fromDDL(more).fields if more else [])])


# --- images -----------------------------------------------------------------------------------------

def images(changes: DataFrame, key: str = "record_id") -> DataFrame:
    """The image of each record after each micro-batch that wrote to it: (key, version, image). `changes` has `at`, `is_full` and
    `fields`; see `states.ImageProcessor`. They may come in any order."""
    return _stateful(changes, [key], states.ImageProcessor([key]), _schema(changes, [key], "version bigint, image map<string,string>"))


def emitted_changes(decisions: DataFrame) -> DataFrame:
    """What the gap handler sends out, as changes for `images`: their place is the number of emission, and a fill is a full row."""
    return decisions.filter(F.col("decision").isin(*S.EMITTED)).select(
        "record_id", F.col("emitted").alias("at"), F.col("decision").isin("filled", "forced").alias("is_full"),
        F.from_json("payload", "map<string,string>").alias("fields"))


def newest_images(written: DataFrame, key: str = "record_id") -> DataFrame:
    return written.groupBy(key).agg(F.max_by("image", "version").alias("image"))


# --- missing numbers --------------------------------------------------------------------------------

def seen_runs(rows: DataFrame, number: str, by: Sequence[str] = (), block: int = BLOCK) -> DataFrame:
    """Changes to the runs of numbers seen, as a stream: (by, block, from_id, to_id, change). Nulls are left out."""
    keys = [*by, "block"]
    numbered = rows.filter(F.col(number).isNotNull()).select(
        *by, F.floor(F.col(number) / F.lit(block)).cast("bigint").alias("block"), F.col(number).cast("bigint").alias(number))
    return _stateful(numbered, keys, states.RunProcessor(keys, number), _schema(numbered, keys, "from_id bigint, to_id bigint, change int"))


def missing(written: DataFrame, by: Sequence[str] = (), layout: Layout = DEFAULT) -> DataFrame:
    """Ranges of missing numbers by what `seen_runs` has written so far. Only runs are ordered, not numbers; blocks meet here."""
    runs = (written.groupBy(*by, "from_id", "to_id").agg(F.sum("change").alias("n")).filter("n > 0").drop("n"))
    seen = scan(runs, layout.by(*by).ordered("from_id"), before={"_prev": F.col("to_id")})
    return (seen.filter(F.col("from_id") - F.col("_prev") > 1)
            .select(*by, (F.col("_prev") + 1).alias("from_id"), (F.col("from_id") - 1).alias("to_id"),
                    (F.col("from_id") - F.col("_prev") - 1).alias("n_missing")))


# --- outages ----------------------------------------------------------------------------------------

def outages(attempts: DataFrame, limit_ms: int = S.MAX_OUTAGE_MS, disorder: str = "0 seconds") -> DataFrame:
    """Rows `breach` and `ended` (see `states.OutageProcessor`) for a stream of attempts: `entity_type`, `seq`, `ts` (milliseconds),
    `outcome`. A source's attempts come in order of `seq`, but for `disorder` in their times; bound a micro-batch at its source,
    since those of one entity type are handled by one task. It ends with `availableNow`."""
    keys = ["entity_type"]
    timed = (attempts.select(*keys, "seq", "ts", "outcome", F.timestamp_millis("ts").alias("_event_time"))
             .withWatermark("_event_time", disorder))
    return _stateful(timed, keys, states.OutageProcessor(keys, limit_ms),
                     _schema(timed, keys, "kind string, started bigint, last_failure bigint, n_failures bigint, at bigint"), "EventTime")


# --- duplicate answers ------------------------------------------------------------------------------

def first_fills(fills: DataFrame, keep_ms: int, order: str = "rec_offset") -> DataFrame:
    """A stream of fills without later copies of the same answer. Each answer is remembered for `keep_ms` of the clock, so the state
    is bounded by the answers of that time, whatever the record times are. Run it with `run_to_end(..., idle=False)`."""
    return _stateful(fills, ["record_id", "event_id"], states.FirstProcessor(fills.columns, order, keep_ms), fills.schema, "ProcessingTime")


# --- current state ----------------------------------------------------------------------------------

class UpsertTable:
    """A table with one row per key, the one of the largest `order`, kept by merging micro-batches into it.

    Rows lie in a fixed number of buckets by the hash of their key, as Parquet. A batch writes new versions of those buckets alone that it
    touches, into a folder of its own, and then a manifest that says which batch holds each bucket's newest version. Readers go by the
    newest whole manifest, so they see a batch whole or not at all. A batch that is repeated finds its manifest and does nothing; one that
    was broken off is written anew. One writer at a time, with batch ids that grow. A manifest has one row per bucket.

    Of rows with equal key and order the largest one stays. A null key is a key like any other; a null order is the smallest.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: str | T.StructType, key: str = "record_id", order: str = "seq", buckets: int = 64):
        self.spark, self.folder, self.key, self.order, self.buckets = spark, folder.rstrip("/"), key, order, buckets
        self.schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema

    def _path(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _names(self, name: str) -> list[str]:
        files, path = self._path(name)
        return sorted(s.getPath().getName() for s in files.listStatus(path)) if files.exists(path) else []

    def _whole(self, manifest: str) -> bool:
        files, path = self._path(f"manifests/{manifest}/_SUCCESS")
        return files.exists(path)

    def manifests(self) -> list[int]:
        """Ids of the batches that are in the table."""
        return [int(m) for m in self._names("manifests") if self._whole(m)]

    def versions(self, batch_id: int | None = None) -> dict[int, int]:
        """Which batch holds the newest version of each bucket that has any rows."""
        known = [m for m in self.manifests() if batch_id is None or m <= batch_id]
        if not known:
            return {}
        rows = self.spark.read.parquet(f"{self.folder}/manifests/{known[-1]:010d}").collect()
        return {r.bucket: r.batch for r in rows}

    def _buckets(self, versions: dict[int, int]) -> DataFrame:
        paths = [f"{self.folder}/data/{batch:010d}/bucket={bucket}" for bucket, batch in sorted(versions.items())]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self) -> DataFrame:
        """The table as it is now."""
        return self._buckets(self.versions())

    def _last(self, rows: DataFrame) -> DataFrame:
        names = [self.order, *(c for c in self.schema.names if c != self.order)]
        last = rows.groupBy(F.col(self.key).alias("_key")).agg(F.max(F.struct(*names)).alias("_row"))
        return last.select(*[F.col("_row")[c].alias(c) for c in self.schema.names])

    def merge(self, batch: DataFrame, batch_id: int) -> None:
        """Take a micro-batch in; to be called from `foreachBatch`."""
        known = self.manifests()
        if batch_id in known:
            return
        if known and batch_id < known[-1]:
            raise ValueError(f"batch {batch_id} comes after {known[-1]}")
        bucket = F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int").alias("bucket")
        batch = batch.persist()
        try:
            touched = [r.bucket for r in batch.select(bucket).distinct().collect()]  # at most `buckets`
            versions = self.versions()
            old = self._buckets({b: v for b, v in versions.items() if b in set(touched)})
            new = self._last(old.unionByName(batch.select(*self.schema.names)))
            (new.select("*", bucket).repartition("bucket").write.mode("overwrite").partitionBy("bucket")
             .parquet(f"{self.folder}/data/{batch_id:010d}"))
        finally:
            batch.unpersist()
        versions |= dict.fromkeys(touched, batch_id)
        (self.spark.createDataFrame(sorted(versions.items()), "bucket int, batch bigint").coalesce(1)
         .write.mode("overwrite").parquet(f"{self.folder}/manifests/{batch_id:010d}"))

    def follow(self, stream: DataFrame, checkpoint: str) -> None:
        """Merge all that a stream has now."""
        (stream.select(*self.schema.names).writeStream.foreachBatch(self.merge).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start().awaitTermination())

    def vacuum(self, keep: int = 1) -> int:
        """Delete bucket versions that none of the last `keep` manifests names, and the older manifests; returns how many folders. Readers of
        older manifests must be done."""
        known = self.manifests()
        used = {(v, b) for m in known[-max(keep, 1):] for b, v in self.versions(m).items()}
        gone = [f"manifests/{m:010d}" for m in known[:-max(keep, 1)]]
        for batch in self._names("data"):
            if known and int(batch) <= known[-1]:
                gone += [f"data/{batch}/{name}" for name in self._names(f"data/{batch}")
                         if name.startswith("bucket=") and (int(batch), int(name[7:])) not in used]
        for name in gone:
            files, path = self._path(name)
            files.delete(path, True)
        return len(gone)
