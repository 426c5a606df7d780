"""Incremental audits: files that are new in a folder are validated once, with the results of a batch audit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geolith.operators.validate import validate


def audit_stream(spark: SparkSession, folder: str, schema: str, state: str, geometry: str = "geometry") -> None:
    """Validate the Parquet files that came into a folder since the last call and add their counts to the state.

    state: a folder all executors share; ``counts`` holds one set of rows for each micro-batch, written under the
    batch's id, so a batch that is run again after a failure replaces its own rows; ``checkpoint`` is the stream's.
    """

    def add(batch: DataFrame, batch_id: int) -> None:
        issues = validate(batch, geometry).select("_file", F.transform("issues", lambda i: i["issue_type"]).alias("kinds"))
        rows = issues.select("_file", F.explode(F.concat(F.array(F.lit("features")), F.when(F.size("kinds") > 0, F.array(F.lit("invalid"))).otherwise(F.array().cast("array<string>")), "kinds")).alias("measure"))
        rows.groupBy(F.col("_file").alias("file"), "measure").agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{state}/counts/batch={batch_id}")

    stream = spark.readStream.schema(schema).parquet(folder).select("*", F.col("_metadata.file_path").alias("_file"))
    stream.writeStream.foreachBatch(add).option("checkpointLocation", f"{state}/checkpoint").trigger(availableNow=True).start().awaitTermination()


def audit_counts(spark: SparkSession, state: str) -> DataFrame:
    """Counts over everything audited so far: measure (features, invalid, and each issue type), n."""
    return spark.read.parquet(f"{state}/counts").groupBy("measure").agg(F.sum("n").alias("n"))


def batch_counts(features: DataFrame, geometry: str = "geometry") -> DataFrame:
    """The same counts of one table."""
    kinds = validate(features, geometry).select(F.transform("issues", lambda i: i["issue_type"]).alias("kinds"))
    rows = kinds.select(F.explode(F.concat(F.array(F.lit("features")), F.when(F.size("kinds") > 0, F.array(F.lit("invalid"))).otherwise(F.array().cast("array<string>")), "kinds")).alias("measure"))
    return rows.groupBy("measure").agg(F.count(F.lit(1)).alias("n"))
