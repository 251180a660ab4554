"""Row types per object kind, strict and soft reads of the stored payload, and value checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hazardgrid import constants as K

POINT = "struct<lon:double,lat:double>"
GEOMETRY = f"struct<type:string,points:array<{POINT}>>"
GEOJSON = "struct<type:string,coordinates:string>"
PROVENANCE = (
    "struct<source:string,product:string,retrieved_at:timestamp_ntz,native_resolution_m:double,"
    "reported_uncertainty_m:double,detail:map<string,string>>"
)

# Kind name to the fields of its payload; geometries are GeoJSON objects kept as text parts.
KINDS: dict[str, str] = {
    "Fire": f"id string, t timestamp_ntz, name string, discovered_at timestamp_ntz, status string, "
    f"centroid {GEOJSON}, ignition_estimate {GEOJSON}",
    "FirePerimeter": f"id string, t timestamp_ntz, fire_id string, geometry {GEOJSON}, source string, "
    "confidence double, prob_field_ref string",
    "Observation": f"id string, t timestamp_ntz, fire_id string, kind string, geometry {GEOJSON}, "
    f"value map<string,string>, provenance {PROVENANCE}, reported_uncertainty_m double",
    "Forecast": f"id string, t timestamp_ntz, fire_id string, issued_at timestamp_ntz, "
    f"horizon_min int, prob_field struct<center_lat:double,center_lon:double,cell_m:double,"
    f"shape:array<int>,max_prob:double,burning_area_m2:double>, expected_perimeter {GEOJSON}, "
    f"region_90 {GEOJSON}, assimilation boolean, calibration_ref string",
    "Camera": "id string, t timestamp_ntz, name string, lat double, lon double, elev_m double, "
    "pan_deg double, tilt_deg double, fov_deg double, image_width int, image_height int, "
    "network string, pan_uncertainty_deg double, tilt_uncertainty_deg double, "
    "pose_uncertainty_m double, last_frame string",
    "WeatherCell": "id string, t timestamp_ntz, bbox array<double>, wind_u double, wind_v double, "
    "rh double, temp_c double, source string",
    "TerrainCell": "id string, t timestamp_ntz, bbox array<double>, elev_m double, slope_deg double, "
    "aspect_deg double",
    "FuelCell": "id string, t timestamp_ntz, bbox array<double>, fuel_model int, canopy_pct double, "
    "moisture_est double",
    "Structure": f"id string, t timestamp_ntz, footprint {GEOJSON}, type string, population_est double",
    "PopulationZone": f"id string, t timestamp_ntz, name string, geometry {GEOJSON}, population int, "
    "evac_status string",
    "RoadSegment": f"id string, t timestamp_ntz, geometry {GEOJSON}, name string, "
    "graph_edge array<string>, highway string, capacity int",
    "Resource": f"id string, t timestamp_ntz, kind string, location {GEOJSON}, status string, label string",
    "Recommendation": f"id string, t timestamp_ntz, kind string, target string, target_name string, "
    f"lead_time_min double, lead_time_low_min double, lead_time_high_min double, confidence double, "
    f"urgency double, geometry {GEOJSON}, evidence array<string>, rationale string, "
    "issued_at timestamp_ntz, acknowledged_by string",
}

REQUIRED: dict[str, list[str]] = {
    "Fire": ["id", "name", "discovered_at"],
    "FirePerimeter": ["id", "fire_id", "geometry"],
    "Observation": ["id", "fire_id", "kind", "provenance", "provenance.source", "provenance.product"],
    "Forecast": ["id", "fire_id", "issued_at", "horizon_min"],
    "Camera": ["id", "name", "lat", "lon", "elev_m"],
    "WeatherCell": ["id", "bbox", "wind_u", "wind_v"],
    "TerrainCell": ["id", "bbox", "elev_m", "slope_deg", "aspect_deg"],
    "FuelCell": ["id", "bbox", "fuel_model"],
    "Structure": ["id", "footprint"],
    "PopulationZone": ["id", "name", "geometry"],
    "RoadSegment": ["id", "geometry"],
    "Resource": ["id", "kind", "location"],
    "Recommendation": ["id", "kind", "target"],
}

# Allowed values of the enumerated fields; a NULL takes the kind's default.
ALLOWED: dict[str, dict[str, list[str]]] = {
    "Fire": {"status": K.FIRE_STATUS},
    "FirePerimeter": {"source": K.PERIMETER_SOURCES},
    "Observation": {"kind": K.OBSERVATION_KINDS},
    "Resource": {"kind": K.RESOURCE_KINDS},
    "Recommendation": {"kind": K.RECOMMENDATION_KINDS},
}

# Field defaults of each kind, as SQL text.
FIELD_DEFAULTS: dict[str, dict[str, str]] = {
    "Fire": {"status": "'active'"},
    "FirePerimeter": {"source": "'observed'", "confidence": "1.0D"},
    "Forecast": {"assimilation": "true"},
    "Camera": {
        "pan_deg": "0.0D",
        "tilt_deg": "0.0D",
        "fov_deg": "60.0D",
        "image_width": "1920",
        "image_height": "1080",
        "network": "'unknown'",
        "pan_uncertainty_deg": "3.0D",
        "tilt_uncertainty_deg": "3.0D",
        "pose_uncertainty_m": "25.0D",
    },
    "WeatherCell": {"source": "'HRRR'"},
    "FuelCell": {"canopy_pct": "0.0D", "moisture_est": "0.08D"},
    "Structure": {"type": "'residential'", "population_est": "2.5D"},
    "PopulationZone": {"population": "0", "evac_status": "'normal'"},
    "RoadSegment": {"name": "''", "highway": "'road'", "capacity": "600"},
    "Resource": {"status": "'available'", "label": "''"},
    "Recommendation": {"target_name": "''", "confidence": "0.0D", "urgency": "0.0D", "rationale": "''"},
}


def _problem(kind: str, obj: str) -> Column:
    """First reason to reject a parsed payload, or NULL."""
    checks = [F.when(F.col(f"{obj}._corrupt").isNotNull(), F.lit("not parseable"))]
    for field in REQUIRED[kind]:
        checks.append(F.when(F.col(f"{obj}.{field}").isNull(), F.lit(f"missing {field}")))
    for field, allowed in ALLOWED.get(kind, {}).items():
        value = F.col(f"{obj}.{field}")
        bad = value.isNotNull() & ~value.isin(*allowed)
        checks.append(F.when(bad, F.lit(f"unknown {field}")))
    return F.coalesce(*checks)


def rehydrate(log: DataFrame, kind: str, data: str = "data") -> tuple[DataFrame, DataFrame]:
    """Typed rows of one kind, and the rejected rows with the reason.

    The payload is parsed once; a row is rejected when it does not parse, lacks a required field
    (an observation without provenance, say) or holds an unlisted value.
    """
    fields = KINDS[kind] + ", _corrupt string"
    parsed = log.filter(F.col("kind") == kind).withColumn(
        "_obj",
        F.from_json(data, fields, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}),
    )
    judged = parsed.withColumn("problem", _problem(kind, "_obj"))
    names = [f.name for f in T.StructType.fromDDL(KINDS[kind])]
    defaults = FIELD_DEFAULTS.get(kind, {})
    typed = [
        F.coalesce(F.col(f"_obj.{n}"), F.expr(defaults[n])).alias(n) if n in defaults else F.col(f"_obj.{n}")
        for n in names
    ]
    meta = [c for c in ("seq", "valid_t", "tx_t") if c in log.columns]
    good = judged.filter(F.col("problem").isNull()).select(*meta, *typed)
    bad = judged.filter(F.col("problem").isNotNull()).select(*log.columns, "problem")
    return good, bad


def geojson_points(geometry: Column) -> Column:
    """Vertices of a GeoJSON geometry whose coordinates are raw text; empty or NULL gives NULL.

    Exterior rings only: the holes of a polygon are dropped, a multi-polygon gives all its parts.
    """
    kind, raw = geometry["type"], geometry["coordinates"]
    pair = lambda p: F.struct(p[0].alias("lon"), p[1].alias("lat"))
    point = F.array(pair(F.from_json(raw, "array<double>")))
    line = F.transform(F.from_json(raw, "array<array<double>>"), pair)
    polygon = F.transform(F.get(F.from_json(raw, "array<array<array<double>>>"), F.lit(0)), pair)
    many = F.flatten(
        F.transform(
            F.from_json(raw, "array<array<array<array<double>>>>"),
            lambda poly: F.transform(F.get(poly, F.lit(0)), pair),
        )
    )
    out = (
        F.when(kind == "Point", point)
        .when(kind.isin("LineString", "MultiPoint"), line)
        .when(kind == "Polygon", polygon)
        .when(kind == "MultiPolygon", many)
    )
    return F.when(F.size(out) > 0, out)


def points_geojson(kind: Column, points: Column) -> Column:
    """Vertices back to GeoJSON text for points, lines and single-ring polygons; empty gives NULL."""
    pairs = F.transform(points, lambda p: F.array(p["lon"], p["lat"]))
    body = (
        F.when(kind == "Point", F.to_json(F.get(pairs, F.lit(0))))
        .when(kind.isin("LineString", "MultiPoint"), F.to_json(pairs))
        .when(kind == "Polygon", F.concat(F.lit("["), F.to_json(pairs), F.lit("]")))
    )
    text = F.concat(F.lit('{"type":"'), kind, F.lit('","coordinates":'), body, F.lit("}"))
    return F.when(F.size(points) > 0, text)
