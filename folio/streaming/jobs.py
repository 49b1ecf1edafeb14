"""Streams: job states, solver chunks and the page cache, each as a query over files that arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import library, runtime

EVENTS = "job string, file int, status string, message string, seq long, ts timestamp"
CHUNKS = "request string, seq long, type string, text string"


def events(spark: SparkSession, path: str, schema: str = EVENTS, glob: str = "*.parquet") -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", glob).option("recursiveFileLookup", "true").parquet(path)


def status_stream(stream: DataFrame) -> DataFrame:
    """The last state of each file, in update mode: the state is a row for each file of each job."""
    return runtime.latest_status(stream)


def write_status(stream: DataFrame, path: str, checkpoint: str, once: bool = False):
    """Keeps a Parquet table with the last event of each file: every batch is folded to its last events and appended with
    its number; current() reads the last of each."""

    def fold(batch: DataFrame, number: int) -> None:
        last = batch.groupBy("job", "file").agg(F.max_by(F.struct("status", "message"), "seq").alias("s"), F.max("seq").alias("seq"))
        last.select("job", "file", "s.status", "s.message", "seq").write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()


def current(spark: SparkSession, path: str) -> DataFrame:
    """The state that write_status() left; a batch that was written again replaces itself."""
    rows = spark.read.parquet(path).drop("batch").withColumn("k", F.struct("job", "file")).drop("job", "file")
    return library.last_write_wins(rows, "k", "seq").select("k.job", "k.file", "status", "message", "seq")


def answers(chunks: DataFrame) -> DataFrame:
    """request, text, finished, failed: chunks put together in order."""
    ordered = F.array_sort(F.collect_list(F.when(F.col("type") == "chunk", F.struct("seq", "text"))))
    return chunks.groupBy("request").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "").alias("text"), F.max(F.col("type") == "done").alias("finished"), F.max(F.col("type") == "error").alias("failed"))


def write_done(chunks: DataFrame, path: str, checkpoint: str, once: bool = False):
    """Appends a history row (request, text, seq) for each finished request; a batch that is written again replaces itself."""

    def append(batch: DataFrame, number: int) -> None:
        batch.filter("type = 'done'").select("request", "text", "seq").write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = chunks.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def late_counts(stream: DataFrame, delay: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Events a window and status; events later than `delay` are left out, and closed windows leave the state."""
    return stream.withWatermark("ts", delay).groupBy(F.window("ts", width), "status").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "status", "n")


def run_once(df: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Appends what a streaming query gives for all that is there now to a Parquet table, and reads that."""
    df.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path).awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(path)
