"""The same tables kept up to date as files arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.entities import store_rows
from ..sources.files import exists, is_file, write_days


def read_stream(spark: SparkSession, path: str, schema, files_a_trigger: int = 100) -> DataFrame:
    """A stream of the Parquet files that appear in a folder; a path of one file streams that file."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_trigger)
    folder, _, name = path.rstrip("/").rpartition("/")
    if is_file(spark, path):
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(path)


def unique_events(events: DataFrame, key: str = "event_id", time: str = "ts", late: str = "3 days") -> DataFrame:
    """Each key once, as long as its repeats come within ``late``; the state holds no older keys."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def daily_counts(events: DataFrame, time: str = "ts", kind: str = "event_type", value: str = "value", late: str = "3 days") -> DataFrame:
    """(day, kind, n, total) by tumbling day; rows later than ``late`` are left out."""
    exact = F.sum(F.col(value).cast("decimal(18,4)")).cast("double")
    days = events.withWatermark(time, late).groupBy(F.window(time, "1 day"), kind).agg(F.count(F.lit(1)).alias("n"), exact.alias("total"))
    return days.select(F.to_date("window.start").alias("day"), kind, "n", "total")


def keep_store(opinions: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keeps the person store: each day that gets opinions is rebuilt from its rows so far, so a batch that runs twice changes nothing."""

    def upsert(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        fresh = batch.withColumn("date", F.coalesce(F.to_date("datetime"), F.lit("1970-01-01").cast("date")))
        days = [r[0] for r in fresh.select("date").distinct().collect()]  # the days of one batch
        if not days:
            return
        jvm = spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(f"{path}/raw")
        fresh.write.mode("append").partitionBy("date").parquet(root.toString())
        every = spark.read.parquet(root.toString()).where(F.col("date").isin(days))
        write_days(store_rows(every), f"{path}/store")

    return opinions.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_to_table(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there and returns its result, which is written below ``folder``. A complete result replaces
    the one before; nothing passes through the driver."""
    out, checkpoint = f"{folder}/out", f"{folder}/checkpoint"
    writer = stream.writeStream.option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", out).start()
    else:
        query = writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(out)).start()
    query.awaitTermination()
    spark = stream.sparkSession
    return spark.read.schema(stream.schema).parquet(out) if exists(spark, out) else spark.createDataFrame([], stream.schema)
