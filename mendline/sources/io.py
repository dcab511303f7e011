"""Batch and streaming sources and sinks: Kafka, JSON lines, Parquet."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

WIRE = T.StructType([
    T.StructField("key", T.StringType()),
    T.StructField("value", T.StringType()),
    T.StructField("rec_ts", T.LongType()),
    T.StructField("rec_offset", T.LongType()),
])

PARTITIONED_WIRE = T.StructType([*WIRE.fields, T.StructField("rec_partition", T.IntegerType())])


#: Folders given out, by session.
_made: dict[str, list[str]] = {}


def _session(spark: SparkSession) -> str:
    return spark._jsparkSession.sessionUUID()


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder: `spark.checkpoint.dir`. Where that is unset, as in tests, a folder of the warehouse; on a cluster
    that must not be a folder of one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    if not is_shared(warehouse, spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{warehouse}/mendline-shared"


def is_shared(folder: str, master: str) -> bool:
    """Can all executors see a folder? One of the local file system only if they run on one machine."""
    scheme = folder.split(":", 1)[0] if ":" in folder else "file"
    return scheme != "file" or master.startswith("local[") or master == "local"


def fresh_dir(spark: SparkSession, label: str) -> str:
    """A new folder name in the shared folder; `release` deletes all that were given out."""
    folder = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _made.setdefault(_session(spark), []).append(folder)
    return folder


def stored(df: DataFrame, label: str = "stored") -> DataFrame:
    """Write an intermediate result to the shared folder as Parquet, once, for plans that read it several times.
    It cuts the lineage, keeps column pruning and filters, and survives the loss of executors."""
    path = fresh_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Delete the session's folders of intermediate results once their consumers have run; returns how many."""
    done, made = 0, _made.pop(_session(spark), [])
    while made:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(made.pop())
        done += path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return done


def _from_kafka(df: DataFrame) -> DataFrame:
    return df.select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"),
                     F.unix_millis("timestamp").alias("rec_ts"), F.col("offset").alias("rec_offset"),
                     F.col("partition").alias("rec_partition"))


def read_wire(spark: SparkSession, fmt: str, path_or_topic: str, *, stream: bool = False,
              max_per_trigger: int | None = None, partitioned: bool = False, **options: str) -> DataFrame:
    """Wire rows of a topic or folder; with `partitioned`, files name the partition of a row as topics do.

    As a work queue: reading starts at the earliest record, and progress is recorded in the query's
    checkpoint only after a batch has been written, so nothing is acknowledged before its result is out.
    `max_per_trigger` limits a micro-batch (records for Kafka, files otherwise): the rate limit.
    """
    reader = spark.readStream if stream else spark.read
    if fmt == "kafka":
        reader = reader.format("kafka").option("subscribe", path_or_topic).option("startingOffsets", "earliest")
        if stream and max_per_trigger:
            reader = reader.option("maxOffsetsPerTrigger", max_per_trigger)
        return _from_kafka(reader.options(**options).load())
    reader = reader.format(fmt).schema(PARTITIONED_WIRE if partitioned else WIRE)
    if stream and max_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_per_trigger)
    return reader.options(**options).load(path_or_topic)


def write_batch(df: DataFrame, fmt: str, path_or_topic: str, **options: str) -> None:
    """Append one (micro-)batch to a topic or folder. For Kafka, df needs `key` and `value`."""
    writer = df.write.format(fmt).options(**options)
    if fmt == "kafka":
        writer.option("topic", path_or_topic).save()
    else:
        writer.mode("append").save(path_or_topic)


def write_batch_once(df: DataFrame, fmt: str, folder: str, batch_id: int) -> None:
    """Write a micro-batch to a sub-folder of its own, replacing what a failed attempt at the same batch left.
    Read the whole with `folder/*`."""
    df.write.format(fmt).mode("overwrite").save(f"{folder}/batch-{batch_id:010d}")
