"""Feature tables laid out for box filters: plain box columns, rows of near places and sizes in the same files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EDGES = ["minlon", "minlat", "maxlon", "maxlat"]


def _spread_bits(v: Column) -> Column:
    """The 16 low bits of a number moved to the even places of 32."""
    for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask).cast("long"))
    return v


def curve_place(lon: Column, lat: Column) -> Column:
    """Place on the Z-shaped space-filling curve over the whole globe, 16 bits an axis."""

    def step(v, lo, width):
        return F.least(F.greatest(F.floor((v - lo) / width * 65536.0), F.lit(0)), F.lit(65535)).cast("long")

    x, y = step(lon, -180.0, 360.0), step(lat, -90.0, 180.0)
    return _spread_bits(x).bitwiseOR(F.shiftleft(_spread_bits(y), 1))


def land_boxes(features: DataFrame, path: str, box: str = "box", files: int | None = None, row_group_bytes: int | None = None) -> None:
    """Write features with the struct ``box`` as plain columns, clustered by size class and place.

    Files are ranges of (size class, curve place of the centre, row hash): small boxes never share a row group
    with wide ones, which would stretch its bounds, and the hash splits a place that holds many rows. ``files``
    defaults to the shuffle partitions. Features without a box are kept; no filter finds them.
    """
    b = F.col(box)
    flat = features.withColumns({c: b[c].cast("double") for c in EDGES}).drop(box)
    wide = F.greatest(F.col("maxlon") - F.col("minlon"), F.col("maxlat") - F.col("minlat"))
    size = F.when(wide > 0, F.floor(F.log2(wide))).cast("int")
    place = curve_place((F.col("minlon") + F.col("maxlon")) / 2, (F.col("minlat") + F.col("maxlat")) / 2)
    flat = flat.withColumns({"size_class": F.coalesce(size, F.lit(-64)), "curve": place})
    order = [F.col("size_class"), F.col("curve"), F.xxhash64(*EDGES, *[c for c, t in features.dtypes if c != box and "map" not in t])]
    dealt = flat.repartitionByRange(files, *order) if files else flat.repartitionByRange(*order)
    out = dealt.sortWithinPartitions("size_class", "curve").write.mode("overwrite")
    if row_group_bytes:
        out = out.option("parquet.block.size", row_group_bytes)
    out.parquet(path)


def meets_box(box: dict) -> Column:
    """Four plain comparisons that reach the scan, where row groups out of bounds are skipped."""
    return (
        (F.col("minlon") <= float(box["maxlon"])) & (F.col("maxlon") >= float(box["minlon"]))
        & (F.col("minlat") <= float(box["maxlat"])) & (F.col("maxlat") >= float(box["minlat"]))
    )


def read_boxes(spark: SparkSession, path: str, box: dict, name: str | None = None, name_column: str = "poly_name") -> DataFrame:
    """Landed features whose envelope meets the box, touching included, optionally filtered by name."""
    rows = spark.read.parquet(path).filter(meets_box(box))
    return rows.filter(F.upper(name_column).contains(name.upper())) if name else rows
