"""Detection, perimeter, camera and weather feeds after they have landed as files.

Parsing functions take a text column, so the same code serves files, streams and tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from hazardgrid import constants as K
from hazardgrid.functions import geo, lookup
from hazardgrid.operators.common import as_list, first_rows, salted_join

ACTIVE_FIRE_SCHEMA = (
    "latitude string, longitude string, acq_date string, acq_time string, frp string"
)
FEATURES_SCHEMA = (
    "struct<features:array<struct<geometry:struct<type:string,coordinates:string>,properties:"
    "struct<poly_IncidentName:string,attr_IncidentName:string,poly_GISAcres:double,"
    "poly_DateCurrent:bigint,poly_CreateDate:bigint>>>>"
)
CAMERA_SCHEMA = (
    "struct<id:string,name:string,lat:double,lon:double,elev_m:double,pan_deg:double,tilt_deg:double,"
    "fov_deg:double,network:string>"
)
SERIES = "struct<values:array<struct<value:double>>>"
WEATHER_SCHEMA = (
    f"struct<windSpeed:{SERIES},windDirection:{SERIES},relativeHumidity:{SERIES},temperature:{SERIES}>"
)


def active_fire_rows(lines: DataFrame, line: str = "line") -> DataFrame:
    """CSV lines of an active-fire product to typed rows; rows without a valid time or place go.

    Acquisition time is a number without leading zeros, in UTC; a missing power counts as 0.
    """
    row = F.from_csv(F.col(line), ACTIVE_FIRE_SCHEMA)
    out = lines.withColumn("_r", row)
    stamp = F.concat(F.col("_r.acq_date"), F.lit(" "), F.lpad(F.trim("_r.acq_time"), 4, "0"))
    return (
        out.withColumn("t", F.try_to_timestamp(stamp, F.lit("yyyy-MM-dd HHmm")).cast("timestamp_ntz"))
        .withColumn("lon", F.expr("try_cast(_r.longitude AS double)"))
        .withColumn("lat", F.expr("try_cast(_r.latitude AS double)"))
        .withColumn("frp", F.coalesce(F.expr("try_cast(_r.frp AS double)"), F.lit(0.0)))
        .filter(F.col("t").isNotNull() & F.col("lon").isNotNull() & F.col("lat").isNotNull())
        .drop("_r", line)
    )


def read_active_fire_csv(spark: SparkSession, path: str, product: str) -> DataFrame:
    """Landed CSV files (with header) of one product."""
    raw = spark.read.option("header", True).schema(
        "latitude string, longitude string, bright_ti4 string, acq_date string, acq_time string, frp string"
    ).option("enforceSchema", False).csv(path)
    text = F.concat_ws(",", *[F.coalesce(c, F.lit("")) for c in ("latitude", "longitude", "acq_date", "acq_time", "frp")])
    return active_fire_rows(raw.select(F.lit(product).alias("product"), text.alias("line")))


def between_times(rows: DataFrame, t0: str, t1: str, t: str = "t") -> DataFrame:
    return rows.filter(F.col(t).between(F.lit(t0).cast("timestamp_ntz"), F.lit(t1).cast("timestamp_ntz")))


def with_product(rows: DataFrame) -> DataFrame:
    """Observation kind and native resolution of each row's product; unknown products give NULL."""
    return rows.withColumn("kind", lookup.fire_product_kind(F.col("product"))).withColumn(
        "resolution_m", lookup.fire_product_resolution(F.col("product"))
    )


def passes(rows: DataFrame) -> DataFrame:
    """One observation per event, product and instant; its points stay rows keyed by the same columns."""
    return rows.groupBy("fire_id", "product", "t").agg(
        F.count("*").alias("n_pixels"),
        F.avg(F.coalesce("frp", F.lit(0.0))).alias("mean_frp"),
        F.avg("lon").alias("lon"),
        F.avg("lat").alias("lat"),
    )


def fire_pixels(pixels: DataFrame, frame="frame_id", power="power", mask="mask") -> DataFrame:
    """Pixels with finite positive power; a frame that has none gives its fire-mask pixels instead."""
    frame = as_list(frame)
    p = F.col(power)
    lit = p.isNotNull() & ~F.isnan(p) & (p > 0) & (p < float("inf"))
    masked = F.coalesce(F.col(mask).isin(*K.GEO_FIRE_MASK_CODES), F.lit(False))
    candidates = pixels.withColumn("_lit", lit).filter(F.col("_lit") | masked)
    powered = candidates.filter("_lit").select(*frame).distinct()
    fallback = candidates.filter(~F.col("_lit")).join(powered, frame, "left_anti")
    return candidates.filter("_lit").unionByName(fallback).drop("_lit")


def navigate_pixels(pixels: DataFrame, box: dict | None = None) -> DataFrame:
    """Scan angles ``x, y`` to ``lon, lat``, kept when they hit the earth inside the box."""
    p = geo.fixed_grid_to_lonlat(
        "x", "y", K.GEO_HEIGHT_M, K.GEO_SEMI_MAJOR_M, K.GEO_SEMI_MINOR_M, K.GEO_LON0_DEG
    )
    out = pixels.withColumn("_p", p).withColumn("lon", F.col("_p.lon")).withColumn("lat", F.col("_p.lat"))
    out = out.drop("_p").filter(F.col("lon").isNotNull() & F.col("lat").isNotNull())
    if box:
        out = out.filter(
            F.col("lon").between(box["minlon"], box["maxlon"]) & F.col("lat").between(box["minlat"], box["maxlat"])
        )
    return out


def nearest_frames(frames: DataFrame, windows: DataFrame, max_steps: int = 6) -> DataFrame:
    """For each event ``max_steps`` even sample times over its window, each with its nearest frame.

    ``frames(fire_id, frame_id, t)`` and ``windows(fire_id, t0, t1)``. Each frame is compared with
    the few sample times of its event and the best is kept before the shuffle.
    """
    ks = F.explode(F.sequence(F.lit(0), F.lit(max_steps - 1)))
    both = salted_join(frames, windows, "fire_id", ["frame_id"]).withColumn("k", ks)
    span = F.timestamp_diff("SECOND", "t0", "t1")
    ahead = F.timestamp_diff("SECOND", "t0", "t")
    want = span * F.col("k") / max(1, max_steps - 1)
    gap = F.abs(ahead - want)
    return both.groupBy("fire_id", "k").agg(
        F.min_by(F.struct("frame_id", "t"), F.struct(gap, "t", "frame_id")).alias("_f")
    ).select("fire_id", "k", F.col("_f.frame_id").alias("frame_id"), F.col("_f.t").alias("t"))


def frames_to_observations(pixels: DataFrame) -> DataFrame:
    """One observation per event and instant from its pixels."""
    return pixels.groupBy("fire_id", "t").agg(F.count("*").alias("n_pixels")).withColumn(
        "reported_uncertainty_m", F.lit(K.GEO_RESOLUTION_M)
    )


def perimeter_features(docs: DataFrame, now: Column, doc: str = "doc") -> DataFrame:
    """Feature rows of perimeter FeatureCollections with their time, error and vertex ring.

    The time is the first usable of two epoch-millisecond fields, else ``now``.
    """
    from hazardgrid.schema import geojson_points

    feats = docs.withColumn("_f", F.explode(F.from_json(doc, FEATURES_SCHEMA)["features"])).drop(doc)
    zero = F.lit(0).cast("long")
    ms = F.coalesce(
        F.nullif(F.col("_f.properties.poly_DateCurrent"), zero), F.nullif(F.col("_f.properties.poly_CreateDate"), zero)
    )
    ring = geojson_points(F.col("_f.geometry"))
    return (
        feats.withColumn("ring", ring)
        .filter(F.col("ring").isNotNull())
        .withColumn("t", F.coalesce(F.timestamp_millis(ms).cast("timestamp_ntz"), now))
        .withColumn("poly_name", F.col("_f.properties.poly_IncidentName"))
        .withColumn("attr_name", F.col("_f.properties.attr_IncidentName"))
        .withColumn("acres", F.col("_f.properties.poly_GISAcres"))
        .withColumn("sigma_m", F.lit(K.PERIMETER_SIGMA_M))
        .withColumn("box", geo.ring_bbox("ring"))
        .drop("_f")
    )


def find_incident(features: DataFrame, name: str, order: str) -> DataFrame:
    """First feature whose polygon name contains ``name`` in any case, else by attribute name."""
    like = f"%{name.upper()}%"
    hit = (
        F.when(F.upper("poly_name").like(like), 1).when(F.upper("attr_name").like(like), 2)
    )
    found = features.withColumn("_hit", hit).filter("_hit IS NOT NULL").orderBy("_hit", order).limit(1)
    c = geo.ring_centroid("ring")
    label = F.coalesce(F.nullif(F.col("poly_name"), F.lit("")), F.nullif(F.col("attr_name"), F.lit("")), F.lit(name))
    return found.select(label.alias("name"), c["lon"].alias("lon"), c["lat"].alias("lat"), "box.*", "acres")


def intersecting(features: DataFrame, box: dict, name: str | None = None) -> DataFrame:
    """Features whose envelope meets the box, optionally filtered by polygon name."""
    b = F.col("box")
    cond = (b["minlon"] <= box["maxlon"]) & (b["maxlon"] >= box["minlon"])
    cond = cond & (b["minlat"] <= box["maxlat"]) & (b["maxlat"] >= box["minlat"])
    if name:
        cond = cond & F.upper("poly_name").like(f"%{name.upper()}%")
    return features.filter(cond)


def largest_perimeter(features: DataFrame, key: str, tie: str) -> DataFrame:
    """Per event the feature with the greatest planar area in degrees."""
    sized = features.withColumn("area_deg2", geo.ring_area("ring", "lon", "lat"))
    best = F.max_by(F.struct(tie, "area_deg2"), F.struct("area_deg2", tie))
    return sized.groupBy(key).agg(best.alias("_b")).select(key, "_b.*")


def camera_rows(records: DataFrame, box: dict, record: str = "record") -> DataFrame:
    """Camera records inside the box, with the defaults of absent fields."""
    out = records.withColumn("_r", F.from_json(record, CAMERA_SCHEMA)).drop(record)
    inside = F.col("_r.lon").between(box["minlon"], box["maxlon"]) & F.col("_r.lat").between(box["minlat"], box["maxlat"])
    kept = [c for c in out.columns if c != "_r"]

    def d(name, value):
        return F.coalesce(F.col(f"_r.{name}"), F.lit(value)).alias(name)

    return out.filter(inside).select(
        *kept, "_r.id", d("name", "camera"), "_r.lat", "_r.lon", d("elev_m", 0.0), d("pan_deg", 0.0),
        d("tilt_deg", 0.0), d("fov_deg", 60.0), d("network", "ALERTCalifornia"),
    )


def read_cameras(spark: SparkSession, path: str, box: dict) -> DataFrame:
    """Camera list files: a JSON array per file, or one record per line."""
    text = spark.read.text(path, wholetext=True)
    records = text.select(F.explode(F.from_json("value", f"array<{CAMERA_SCHEMA}>")).alias("_r"))
    return camera_rows(records.select(F.to_json("_r").alias("record")), box)


def weather_rows(docs: DataFrame, doc: str = "doc") -> DataFrame:
    """First value of each weather series with its default; speed from km/h to m/s."""
    out = docs.withColumn("_w", F.from_json(doc, WEATHER_SCHEMA)).drop(doc)

    def first(name, default):
        return F.coalesce(F.get(F.col(f"_w.{name}.values"), F.lit(0))["value"], F.lit(default))

    out = out.withColumn("speed_ms", first("windSpeed", 12.0) / 3.6)
    out = out.withColumn("dir_from_deg", first("windDirection", 0.0))
    uv = geo.wind_to_uv("speed_ms", "dir_from_deg")
    return (
        out.withColumn("rh_pct", first("relativeHumidity", 20.0))
        .withColumn("temp_c", first("temperature", 25.0))
        .withColumn("wind_u", uv["u"])
        .withColumn("wind_v", uv["v"])
        .drop("_w")
    )


def nearest_weather(places: DataFrame, grid: DataFrame, bucket_deg: float = 0.05) -> DataFrame:
    """Nearest weather grid point of each place, by squared degrees; longitudes may run 0-360.

    The bucketed search carries the point it finds, the lowest (lat, lon) winning a tie.
    """
    from hazardgrid.operators.nearest import nearest_distance

    wrapped = F.when(F.col("lon") > 180, F.col("lon") - 360).otherwise(F.col("lon"))
    g = grid.withColumn("lon", wrapped).groupBy("lon", "lat").agg(F.min(F.struct("wind_u", "wind_v")).alias("_g"))
    at = places.select(F.lit(0).alias("k"), F.col("lon").alias("x"), F.col("lat").alias("y"))
    points = g.select(F.lit(0).alias("k"), F.col("lon").alias("x"), F.col("lat").alias("y"))
    found = nearest_distance(at, points, "k", size=bucket_deg, unique_points=True, with_point=True)
    found = found.select(F.col("x").alias("lon"), F.col("y").alias("lat"), F.col("px").alias("glon"), F.col("py").alias("glat"))
    wind = g.select(F.col("lon").alias("glon"), F.col("lat").alias("glat"), "_g.*")
    out = places.join(found, ["lon", "lat"]).join(wind, ["glon", "glat"])
    return out.select(*places.columns, "wind_u", "wind_v", "glon", "glat")


def source_cascade(candidates: DataFrame, keys="fire_id", priority: str = "priority") -> DataFrame:
    """The first available source per key; the label column says which one it was."""
    return first_rows(candidates, keys, [F.col(priority)])


def source_status(spark: SparkSession, readers: dict) -> tuple[dict[str, DataFrame], DataFrame]:
    """Readers that fail give no rows; the second result lists each source, its rows and its error, if any.

    Every source is read to its end once, all columns, and counted in that pass; nothing is written. So a
    file that breaks halfway counts as a failure of its source as much as a missing one does. The frames
    are read again where they are used. A failed source has no count.
    """
    frames, rows = {}, []
    for name, read in readers.items():
        try:
            frame, seen = read(), Observation()
            frame.observe(seen, F.count(F.lit(1)).alias("n")).write.format("noop").mode("overwrite").save()
            frames[name] = frame
            rows.append((name, True, None, seen.get.get("n", 0)))
        except Exception as e:
            rows.append((name, False, str(e).split("\n")[0][:200], None))
    return frames, spark.createDataFrame(rows, "source string, available boolean, error string, n_rows long")
