"""Incremental loads: files are taken up once, exactly, by a file stream that ends when it has caught up.

Versions of one key in different batches meet in a join with what was taken up
before, and windowed counts are given out once, when the watermark has passed them, after which their
state goes; rows that come later than that are kept in a table beside them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from citeloom.sources.documents import extractions


def extraction_stream(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """paper_id and parsed extraction of each file as it appears; sidecars and files that can't be read are left out."""
    files = spark.readStream.schema("value string").option("wholetext", True).option("maxFilesPerTrigger", files_per_batch).text(folder)
    return extractions(files.select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)\.json$", 1).alias("file"), "value"))


def table_stream(spark: SparkSession, like: DataFrame, path: str, files_per_batch: int = 1000) -> DataFrame:
    """The rows of the Parquet files at a path or pattern as they appear; like: a table of their columns."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def take_up(stream: DataFrame, checkpoint: str, put: Callable[[DataFrame, int], None], mode: str = "append") -> StreamingQuery:
    """Hands each batch to ``put`` until no file is left; a batch repeated after a failure has the same number."""
    running = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(put).start()
    running.awaitTermination()
    return running


def into_parquet(path: str, key: str | None = None) -> Callable[[DataFrame, int], None]:
    """A ``put`` that writes each batch to a folder of its number, so that a repeated batch replaces itself; rows of one key are one."""

    def put(batch: DataFrame, number: int) -> None:
        (batch.dropDuplicates([key]) if key else batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return put


def _version(order: str, columns: list[str]) -> Column:
    """What decides which of two rows of one key is newer: the order, then a hash of the row, so that equal times are settled, too."""
    return F.struct(F.col(order).alias("at"), F.xxhash64(*[F.col(f"`{c}`") for c in columns]).alias("tie"))


def newest_versions(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Of a table's rows with one key the newest; null orders count as oldest."""
    whole = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
    return rows.groupBy(key).agg(F.max_by(whole, _version(order, rows.columns)).alias("_row")).select("_row.*")


def take_up_versions(stream: DataFrame, key: str, order: str, checkpoint: str, path: str) -> StreamingQuery:
    """Keeps the rows that are newer than any row of their key in this or an earlier batch, batch by batch, below ``path``; may be stopped and started again at any batch.

    Null orders count as oldest.  What earlier batches took up is the state: the
    newest of a batch is held against the newest marks (order, hash) of its keys
    there, which moves two numbers for each row taken up and no row.  A batch
    that is repeated reads the batches before it only, and replaces itself.
    """
    spark, columns = stream.sparkSession, stream.columns
    mark = _version(order, columns)
    schema = StructType([*stream.schema.fields, StructField("batch", LongType())])

    def put(batch: DataFrame, number: int) -> None:
        newest = newest_versions(batch, key, order)
        if number and _exists(spark, path):
            taken = spark.read.schema(schema).parquet(path).filter(F.col("batch") < number)
            seen = taken.groupBy(F.col(f"`{key}`").alias("_key")).agg(F.max(mark).alias("_seen"))
            newest = newest.join(seen, F.col(f"`{key}`").eqNullSafe(F.col("_key")), "left").filter(F.col("_seen").isNull() | (mark > F.col("_seen"))).select(*[F.col(f"`{c}`") for c in columns])
        newest.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return take_up(stream, checkpoint, put)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def current(spark: SparkSession, path: str, like: DataFrame, key: str, order: str) -> DataFrame:
    """The newest version of each key among all batches taken up."""
    return newest_versions(spark.read.schema(like.schema).parquet(path).select(like.columns), key, order)


def event_counts(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events by window and type; of a stream each window once, when the watermark has passed its end."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def split_late(stream: DataFrame, checkpoint: str, path: str, window: str = "1 hour", late: str = "10 minutes") -> StreamingQuery:
    """Parts a stream's batches into rows in time and rows whose window the watermark had passed when they came.

    The watermark of a batch is the greatest time of all earlier batches less
    ``late``, as for the counts; each batch leaves its greatest time, one row,
    below ``path``/marks, its rows in time below ``path``/rows and the late ones
    below ``path``/late, all in folders of its number, so a repeated batch
    replaces itself.
    """
    spark = stream.sparkSession

    def put(batch: DataFrame, number: int) -> None:
        passed = F.lit(None).cast("timestamp")
        if number:
            earlier = spark.read.parquet(f"{path}/marks").filter(F.col("batch") < number).agg(F.max("newest")).first()[0]
            passed = F.lit(earlier).cast("timestamp") - F.expr(f"interval {late}")
        # A null time is in no window.
        marked = batch.filter("ts is not null").withColumn("_late", F.coalesce(F.window("ts", window)["end"] <= passed, F.lit(False)))
        marked.persist()
        try:
            marked.filter("not _late").drop("_late").write.mode("overwrite").parquet(f"{path}/rows/batch={number}")
            marked.filter("_late").drop("_late").write.mode("overwrite").parquet(f"{path}/late/batch={number}")
            marked.agg(F.max("ts").alias("newest")).coalesce(1).write.mode("overwrite").parquet(f"{path}/marks/batch={number}")
        finally:
            marked.unpersist()

    return take_up(stream, checkpoint, put)


def settled_counts(events: DataFrame, checkpoint: str, path: str, window: str = "1 hour", late: str = "10 minutes") -> StreamingQuery:
    """Takes up a stream of events: late rows aside, then counts in append mode, each settled window once, below ``path``/counts.

    May be run again whenever there is more; the query returned is the one that
    counts, and shows how many rows its state holds.
    """
    spark, like = events.sparkSession, events.schema
    split_late(events, f"{checkpoint}/split", path, window, late)
    # All batches parted by now are one batch here, so that the watermark never gets ahead of that by which they were parted.
    kept = spark.readStream.schema(like).option("recursiveFileLookup", "true").parquet(f"{path}/rows")
    return take_up(event_counts(kept, window, late), f"{checkpoint}/counts", into_parquet(f"{path}/counts"))


def late_rows(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """The rows that came too late, of all batches."""
    return spark.read.schema(like.schema).parquet(f"{path}/late").select(like.columns)
