"""Roads, buildings, places, labels and the event registry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazardgrid import constants as K
from hazardgrid.functions import geo, lookup


def road_rows(rows: DataFrame) -> DataFrame:
    """Roads with the first of several names, '' when unnamed."""
    name = F.coalesce(F.get("names", F.lit(0)), F.lit(""))
    name = F.when(F.lower(name) == "nan", F.lit("")).otherwise(name)
    return rows.withColumn("name", name).withColumn("highway", F.coalesce("highway", F.lit("road")))


def building_rows(rows: DataFrame) -> DataFrame:
    """Buildings with a geometry as small boxes."""
    kept = rows.filter(F.col("lon").isNotNull() & F.col("lat").isNotNull())
    return (
        kept.withColumn("box", geo.bbox_around("lon", "lat", 0.00015))
        .withColumn("type", F.coalesce("building", F.lit("yes")))
        .withColumn("population_est", F.lit(K.STRUCTURE_OCCUPANCY))
    )


def zone_rows(rows: DataFrame) -> DataFrame:
    """Places as zones: population from the tag when it is a usable number, else by kind of place."""
    tagged = F.nullif(F.expr("try_cast(population AS int)"), F.lit(0))
    return rows.filter(F.col("lon").isNotNull()).withColumn(
        "population", F.coalesce(tagged, lookup.place_population(F.coalesce("place", F.lit(""))))
    )


def fallback_zones(events: DataFrame, zones: DataFrame, bearings, dist_m: float) -> DataFrame:
    """Sectors round each event that has no zone, at fixed bearings and one distance."""
    bare = events.join(zones.select("fire_id").distinct(), "fire_id", "left_anti")
    spots = F.array(*[F.lit(float(b)) for b in bearings])
    out = bare.select("fire_id", "lon", "lat", F.posexplode(spots).alias("k", "bearing"))
    p = geo.destination_point("lon", "lat", "bearing", dist_m)
    return out.withColumn("_p", p).select(
        "fire_id", F.format_string("zone_%d", "k").alias("zone_id"),
        F.format_string("Sector %d", F.col("k") + 1).alias("name"), F.col("_p.lon").alias("lon"),
        F.col("_p.lat").alias("lat"), F.lit(1000).alias("population"),
    )


def label_boxes(images: DataFrame, text: str = "annotations") -> DataFrame:
    """Boxes ``cx, cy, w, h`` of label lines with exactly five fields."""
    lines = images.withColumn("_l", F.explode(F.split(F.trim(F.coalesce(text, F.lit(""))), "\\R")))
    parts = F.split(F.trim("_l"), "\\s+")
    rows = lines.withColumn("_p", parts).filter(F.size("_p") == 5).drop("_l", text)
    names = {n: F.get("_p", F.lit(k + 1)).cast("double") for k, n in enumerate(("cx", "cy", "w", "h"))}
    return rows.withColumns(names).drop("_p")


def label_split(images: DataFrame, boxes: DataFrame, key: str, n_pos: int, n_neg: int) -> DataFrame:
    """The first ``n_pos`` images with boxes and ``n_neg`` without, by key."""
    counted = images.select(key).join(
        boxes.groupBy(key).agg(F.count("*").alias("n_boxes")), key, "left"
    ).withColumn("n_boxes", F.coalesce("n_boxes", F.lit(0)))
    pos = counted.filter("n_boxes > 0").orderBy(key).limit(n_pos)
    neg = counted.filter("n_boxes = 0").orderBy(key).limit(n_neg)
    return pos.unionByName(neg)


def event_registry(spark: SparkSession) -> DataFrame:
    """The registered retrospective events, one row each."""
    df = spark.createDataFrame(
        K.RETRO_EVENTS,
        "key string, name string, center_lon double, center_lat double, start_utc string, cell_m double, "
        "half_extent_m double",
    )
    return (
        df.withColumn("start_utc", F.col("start_utc").cast("timestamp_ntz"))
        .withColumn("window_min", F.lit(360))
        .withColumn("assim_min", F.lit(180))
        .withColumn("horizons", F.array(*[F.lit(h) for h in (210, 240, 300, 360)]))
        .withColumn("n_frames", F.lit(16))
        .withColumn("members", F.lit(40))
        .withColumn("threshold", F.lit(0.5))
        .withColumn("truth_disk_m", F.lit(K.TRUTH_DISK_M))
    )


def registry_for(sites: DataFrame) -> DataFrame:
    """Event parameters for a table of events: grid size and window follow from each site's frame."""
    n = F.floor(F.col("half_extent_m") * 2 / F.col("cell_m")).cast("int")
    return sites.withColumns({"nx": n, "ny": n, "window_min": F.lit(360), "assim_min": F.lit(180)})
