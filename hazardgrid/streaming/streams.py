"""Continuous ingest and incremental results over landed feed files.

Event time is cast to ``timestamp``, which watermarks need, and back without a zone in the results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hazardgrid.operators.common import as_list, first_rows
from hazardgrid.session import work_path


def open_feed(spark: SparkSession, folder: str, glob: str, schema, files_per_batch: int = 100) -> DataFrame:
    """File stream of a feed's landed Parquet files."""
    return (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", glob)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(folder)
    )


def event_time(t: str | Column) -> Column:
    t = F.col(t) if isinstance(t, str) else t
    return t.cast("timestamp")


def append_feed(rows: DataFrame, path: str, checkpoint: str):
    """Append-only ingest into a Parquet log; the checkpoint makes each file count once."""
    return (
        rows.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def drain_append(rows: DataFrame, label: str) -> DataFrame:
    """Run an append stream to the end of its input and read its sink."""
    spark = rows.sparkSession
    path = work_path(spark, label)
    append_feed(rows, f"{path}/rows", f"{path}/checkpoint").awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{path}/rows")


def _manifest(spark: SparkSession, path: str) -> dict[int, str]:
    """Folders that hold the result after the last finished batch, by the batch they stand for."""
    rows = spark.read.schema("batch_id long, part_id long, place string").parquet(f"{path}/manifest")
    last = rows.agg(F.max("batch_id")).first()[0]
    return {r.part_id: r.place for r in rows.filter(F.col("batch_id") == last).distinct().collect()} if last is not None else {}


def drain_updates(results: DataFrame, keys, label: str, compact_every: int = 20, path: str | None = None) -> DataFrame:
    """Run an update stream to the end and return the last result per key.

    Each batch writes only the keys it changed, in its own folder, so a retried batch replaces its
    own output. Every ``compact_every`` batches what is there is reduced to one row per key in a folder
    that stands for them, so a read sees at most that many batches and one reduced table. A batch is
    finished once its manifest is written, which names all folders that count; a stream that is started again
    on the same ``path`` goes on from its checkpoint and manifest.
    """
    spark = results.sparkSession
    path = path or work_path(spark, label)

    # The first, empty manifest makes the folder.
    spark.createDataFrame([], "batch_id long, part_id long, place string").write.mode("append").parquet(f"{path}/manifest")

    def held(batches) -> DataFrame:
        parts = [spark.read.schema(results.schema).parquet(at).withColumn("batch_id", F.lit(k)) for k, at in batches]
        rows = parts[0]
        for part in parts[1:]:
            rows = rows.unionByName(part)
        return first_rows(rows, as_list(keys), [F.col("batch_id").desc()]).drop("batch_id")

    def write(batch: DataFrame, batch_id: int) -> None:
        """Folders are named by what they hold, so a batch that is run again names the same ones."""
        seen = {k: at for k, at in _manifest(spark, path).items() if k < batch_id}
        batch.write.mode("overwrite").parquet(f"{path}/rows/{batch_id}")
        seen[batch_id] = f"{path}/rows/{batch_id}"
        if len(seen) > compact_every:
            at = f"{path}/upto/{batch_id}"
            held(sorted(seen.items())).write.mode("overwrite").parquet(at)
            seen = {batch_id: at}
        rows = [(batch_id, k, at) for k, at in seen.items()]
        rows = spark.createDataFrame(rows, "batch_id long, part_id long, place string")
        rows.coalesce(1).write.mode("append").parquet(f"{path}/manifest")

    query = (
        results.writeStream.foreachBatch(write)
        .option("checkpointLocation", f"{path}/checkpoint")
        .outputMode("update")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    seen = _manifest(spark, path)
    return held(sorted(seen.items())) if seen else spark.createDataFrame([], results.schema)


def current_state(versions: DataFrame, keys=("kind", "obj_id")) -> DataFrame:
    """Running current version per object; a late version with an older time does not win."""
    payload = [c for c in versions.columns if c not in keys]
    best = F.max_by(F.struct(*payload), F.struct("valid_t", "seq"))
    return versions.groupBy(*as_list(keys)).agg(best.alias("_b")).select(*keys, "_b.*")


def without_duplicates(observations: DataFrame, t: str = "t", key: str = "obs_id", delay: str = "1 hour"):
    """Each observation id once, with state bounded by the watermark."""
    return observations.withWatermark(t, delay).dropDuplicatesWithinWatermark([key])


def running_loglik(scores: DataFrame) -> DataFrame:
    """Running log-likelihood per event and member; order does not matter without resampling."""
    return scores.groupBy("fire_id", "member_id").agg(
        F.sum("loglik").alias("loglik"), F.count("*").alias("n_scores")
    )


def issued_counts(observations: DataFrame, t: str = "t", every: str = "1 hour", delay: str = "10 minutes"):
    """Closed windows of observations per event: final once the watermark has passed.

    A row later than the watermark still reaches the log (the append stream takes all rows) but can
    no longer change a window that has been issued.
    """
    return (
        observations.withWatermark(t, delay)
        .groupBy(F.window(t, every).alias("w"), "fire_id")
        .agg(F.count("*").alias("n"))
        .select("fire_id", F.col("w.start").cast("timestamp_ntz").alias("start_t"), "n")
    )


def cadence_counts(observations: DataFrame, t: str = "t", every: str = "5 minutes") -> DataFrame:
    """Detections per event and feed interval, updated as they come."""
    return (
        observations.withWatermark(t, "1 hour")
        .groupBy(F.window(t, every).alias("w"), "fire_id")
        .agg(F.count("*").alias("n"))
        .select("fire_id", F.col("w.start").cast("timestamp_ntz").alias("start_t"), "n")
    )
