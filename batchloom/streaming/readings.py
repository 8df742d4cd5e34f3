"""Release readings as a stream: counts per day and instrument, and limit checks as rows arrive."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from batchloom.functions.domain import finite
from batchloom.operators.explore import limit_status
from batchloom.session import shared_dir, ship


def reading_stream(spark: SparkSession, sf_dir: str, files_per_trigger: int | None = None) -> DataFrame:
    """The readings of ``dissolution`` as a stream of files."""
    ship(spark)
    path = f"{sf_dir}/dissolution.parquet"
    schema = spark.read.parquet(path).schema
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(jvm_path).isDirectory()
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path) if folder else reader.option("pathGlobFilter", "dissolution.parquet").parquet(sf_dir)


def daily_counts(readings: DataFrame, late: str = "400 days") -> DataFrame:
    """Per day of loading and instrument: rows, readings and readings outside -1 to 130 percent.

    Readings later than ``late`` behind the newest are dropped from open days;
    the default is beyond what late loads reach, state is one row per day and
    instrument.
    """
    y = finite(F.col("percent_released"))
    at = F.col("loaded_at").cast("timestamp")
    rows = readings.select(at.alias("at"), F.coalesce("instrument", F.lit("")).alias("instrument"), y.alias("y"))
    return rows.withWatermark("at", late).groupBy(F.window("at", "1 day").alias("w"), "instrument").agg(
        F.count("*").alias("n_rows"), F.count("y").alias("n_readings"), F.count(F.when(~F.col("y").between(-1, 130), 1)).alias("n_outside")
    ).select(F.col("w.start").alias("day"), "instrument", "n_rows", "n_readings", "n_outside")


def checked(readings: DataFrame, low: float = -1.0, high: float = 130.0) -> DataFrame:
    """Every arriving reading with its limit status; stateless, so it can be appended anywhere."""
    y = finite(F.col("percent_released"))
    return readings.withColumn("status", limit_status(y, F.lit(low), F.lit(high)))


def run_to_table(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Run ``stream`` over what there is and return the table it leaves in the shared folder."""
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/batchloom-stream-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{base}/out")

    query = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")
