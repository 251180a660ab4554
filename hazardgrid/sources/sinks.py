"""Snapshots of feeds, the picture document and result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def by_folder(rows: DataFrame, *folder: str) -> DataFrame:
    """Rows dealt by the folders they will be written to, as many tasks a folder as its bytes need.

    Adaptive execution splits folders beyond ``spark.sql.adaptive.advisoryPartitionSizeInBytes`` and joins small
    ones, so the number of files follows the size, also where one event holds a third of all rows.
    """
    return rows.hint("rebalance", *folder)


def write_snapshot(rows: DataFrame, path: str, event: str = "event_id", source: str = "source") -> None:
    """Feed rows stored per event and source; only the partitions that are written are replaced."""
    (
        by_folder(rows.withColumn("loaded_at", F.current_timestamp()), event, source)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(event, source)
        .parquet(path)
    )


def read_snapshot(spark: SparkSession, path: str, ttl_s: float | None = None) -> DataFrame:
    """Stored feed rows, without those older than ``ttl_s`` seconds."""
    rows = spark.read.parquet(path)
    if ttl_s is None:
        return rows
    age = F.unix_timestamp(F.current_timestamp()) - F.unix_timestamp("loaded_at")
    return rows.filter(age < F.lit(float(ttl_s)))


def picture_features(layers: dict[str, DataFrame]) -> DataFrame:
    """Layer rows ``(fire_id, id, ...)`` as one feature per row: ``(fire_id, layer, id, feature)``.

    A layer may hold any number of features, so the picture is a table of features, written as one
    folder per event and layer, and never one document built in one task.
    """
    out = None
    for name, df in layers.items():
        props = [c for c in df.columns if c != "fire_id"]
        part = df.select(
            "fire_id", F.lit(name).alias("layer"), F.col("id").cast("string").alias("id"),
            F.to_json(F.struct(*props)).alias("feature"),
        )
        out = part if out is None else out.unionByName(part)
    return out


def picture_heads(events: DataFrame, forecasts: DataFrame) -> DataFrame:
    """One small JSON head per event and issue: meta and forecast products per arm and horizon.

    The arrays hold one entry per arm and horizon, a number fixed by the run's settings.
    """
    fc = forecasts.groupBy("fire_id").agg(
        F.sort_array(F.collect_list(F.struct("arm", "horizon_min", "max_prob", "region90_area_km2"))).alias("forecast")
    )
    joined = events.join(fc, "fire_id", "left")
    meta = F.struct(*[c for c in events.columns if c != "fire_id"])
    return joined.select("fire_id", F.to_json(F.struct(meta.alias("meta"), "forecast")).alias("document"))


def write_picture(features: DataFrame, heads: DataFrame, path: str) -> None:
    """Features as JSON lines per event and layer, heads per event."""
    by_folder(features, "fire_id", "layer").write.mode("overwrite").partitionBy("fire_id", "layer").json(f"{path}/features")
    heads.repartition("fire_id").write.mode("overwrite").partitionBy("fire_id").json(f"{path}/heads")


def write_results(rows: DataFrame, path: str, fmt: str = "parquet") -> None:
    rows.write.mode("overwrite").format(fmt).save(path)


def events_with_picture(spark: SparkSession, path: str) -> DataFrame:
    """Events that have a stored picture, sorted."""
    heads = spark.read.schema("document string, fire_id int").json(f"{path}/heads")
    return heads.select("fire_id").distinct().orderBy("fire_id")
