"""Elevation and fuel rasters as pixel or cell tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazardgrid.functions import geo, lookup
from hazardgrid.functions.draws import hash_uniform
from hazardgrid.operators.common import as_list, attach_group_stats
from hazardgrid.operators.spatial import gradient


def terrarium_elevation(r: Column, g: Column, b: Column) -> Column:
    return r * 256.0 + g + b / 256.0 - 32768.0


def sample_tiles(points: DataFrame, pixels: DataFrame, zoom: int, tile_px: int = 256) -> DataFrame:
    """Elevation of the tile pixel under each point; a missing tile gives 0.

    ``pixels(tile_x, tile_y, px, py, r, g, b)``.
    """
    a = geo.deg_to_tile("lon", "lat", zoom)
    at = points.withColumn("_a", a)
    at = at.withColumns({"tile_x": F.floor("_a.x"), "tile_y": F.floor("_a.y")})
    for c, t, f in (("px", "tile_x", "_a.x"), ("py", "tile_y", "_a.y")):
        k = F.floor((F.col(f) - F.col(t)) * tile_px).cast("int")
        at = at.withColumn(c, F.least(k, F.lit(tile_px - 1)))
    keys = ["tile_x", "tile_y", "px", "py"]
    values = pixels.select(*keys, terrarium_elevation(F.col("r"), F.col("g"), F.col("b")).alias("_e"))
    return (
        at.join(values, keys, "left")
        .withColumn("elev_m", F.coalesce("_e", F.lit(0.0)))
        .drop("_a", "_e", *keys)
    )


def tile_span(points: DataFrame, zoom: int, keys="fire_id", limit: int = 64) -> DataFrame:
    """Number of tiles each event's points cover, and whether that is within the limit."""
    a = geo.deg_to_tile("lon", "lat", zoom)
    t = points.select(*as_list(keys), F.floor(a["x"]).alias("x"), F.floor(a["y"]).alias("y"))
    span = (F.max("x") - F.min("x") + 1) * (F.max("y") - F.min("y") + 1)
    return t.groupBy(*as_list(keys)).agg(span.alias("n_tiles")).withColumn("ok", F.col("n_tiles") <= limit)


def map_fuel_codes(pixels: DataFrame, raster="raster_id", code: str = "code") -> DataFrame:
    """Codes to the 13 fuel models; a raster whose greatest code is at most 20 already uses them."""
    c = F.col(code)
    top = attach_group_stats(pixels, raster, _top=F.coalesce(F.max(F.when(~F.isnan(c.cast("double")), c)), F.lit(0)))
    plain = F.when(c.between(1, 13), c.cast("int")).otherwise(F.lit(0))
    mapped = lookup.fuel40_to_fuel13(F.coalesce(c, F.lit(0)))
    return top.withColumn("fuel", F.when(F.col("_top") <= 20, plain).otherwise(mapped)).drop("_top")


def landcover_fuel(cells: DataFrame, cell_m: float, code: str = "code") -> DataFrame:
    """Land cover to fuel model; shrub on slopes above 0.5 becomes chaparral."""
    g = gradient(cells, "elevation", cell_m)
    fuel = lookup.landcover_to_fuel(F.least(F.greatest(F.coalesce(F.col(code), F.lit(0)), F.lit(0)), F.lit(100)))
    steep = F.hypot("gx", "gy") > 0.5
    return g.withColumn("_f", fuel).withColumn(
        "fuel", F.when((F.col("_f") == 5) & steep, F.lit(4)).otherwise(F.col("_f"))
    ).drop("_f", "gx", "gy")


def usable_fuel(cells: DataFrame, raster="raster_id", share: float = 0.05) -> DataFrame:
    """Burnable share per raster and whether it is enough to use the raster."""
    burnable = F.avg(F.when(F.col("fuel") > 0, 1.0).otherwise(0.0))
    return cells.groupBy(*as_list(raster)).agg(burnable.alias("burnable")).withColumn(
        "usable", F.col("burnable") > share
    )


def exact_percentiles(df: DataFrame, keys, value: str, shares: dict[str, float], bins: int = 1024) -> DataFrame:
    """Percentiles per key with linear interpolation, exact for groups of any size.

    A histogram over the value range finds the bins that hold the wanted ranks; only rows of those
    bins are then ranked, after equal values have been counted.
    """
    from pyspark.sql import Window

    keys = as_list(keys)
    v = F.col(value)
    ranged = attach_group_stats(
        df.filter(v.isNotNull()).select(*keys, v), keys, _lo=F.min(v), _hi=F.max(v), _n=F.count("*")
    )
    width = F.when(F.col("_hi") > F.col("_lo"), (F.col("_hi") - F.col("_lo")) / bins).otherwise(F.lit(1.0))
    binned = ranged.withColumn("_bin", F.least(F.floor((v - F.col("_lo")) / width), F.lit(bins - 1)))
    hist = binned.groupBy(*keys, "_bin").agg(F.count("*").alias("_c"), F.max("_n").alias("_n"))
    upto = F.sum("_c").over(Window.partitionBy(*keys).orderBy("_bin"))
    hist = hist.withColumn("_to", upto).withColumn("_from", F.col("_to") - F.col("_c"))
    wanted = F.lit(False)
    for q in shares.values():
        pos = (F.col("_n") - 1) * F.lit(float(q))
        for k in (F.floor(pos), F.ceil(pos)):
            wanted = wanted | ((F.col("_from") <= k) & (k < F.col("_to")))
    held = binned.join(hist.filter(wanted).select(*keys, "_bin", "_from"), [*keys, "_bin"])
    runs = held.groupBy(*keys, "_bin", v.alias("_v")).agg(
        F.count("*").alias("_c"), F.max("_from").alias("_from"), F.max("_n").alias("_n")
    )
    inside = F.sum("_c").over(Window.partitionBy(*keys, "_bin").orderBy("_v"))
    runs = runs.withColumn("_to", F.col("_from") + inside).withColumn("_from", F.col("_to") - F.col("_c"))
    aggs = []
    for name, q in shares.items():
        pos = (F.col("_n") - 1) * F.lit(float(q))
        lo, hi = F.floor(pos), F.ceil(pos)
        for tag, k in (("a", lo), ("b", hi)):
            aggs.append(F.max(F.when((F.col("_from") <= k) & (k < F.col("_to")), F.col("_v"))).alias(f"{name}_{tag}"))
        aggs.append(F.max(pos - lo).alias(f"{name}_w"))
    out = runs.groupBy(*keys).agg(*aggs)
    mixed = [
        (F.col(f"{n}_a") + (F.col(f"{n}_b") - F.col(f"{n}_a")) * F.col(f"{n}_w")).alias(n) for n in shares
    ]
    return out.select(*keys, *mixed)


def heuristic_fuel(cells: DataFrame, cell_m: float, seed: int = 3) -> DataFrame:
    """Fuel from elevation percentiles and slope, in rule order; half of the lowest cells do not burn."""
    p = exact_percentiles(cells, "fire_id", "elevation", {"p3": 0.03, "p30": 0.30, "p75": 0.75})
    g = gradient(cells, "elevation", cell_m).join(p, "fire_id")
    e = F.col("elevation")
    base = F.when(e < F.col("p30"), 1).when(e < F.col("p75"), 5).otherwise(10)
    steep = F.when(F.hypot("gx", "gy") > 0.6, 4).otherwise(base)
    coin = hash_uniform(seed, "fire_id", "i", "j") < 0.5
    fuel = F.when((e < F.col("p3")) & coin, 0).otherwise(steep)
    return g.withColumn("fuel", fuel).drop("gx", "gy", "p3", "p30", "p75")


def landscape_bank(cells: DataFrame, site="fire_id", min_std: float = 1.0, min_burnable: float = 0.05):
    """Sites with enough relief and burnable cover."""
    burnable = F.avg(F.when(F.col("fuel") > 0, 1.0).otherwise(0.0))
    stats = cells.groupBy(*as_list(site)).agg(
        F.stddev_pop("elevation").alias("elev_std"), burnable.alias("burnable"), F.count("*").alias("n_cells")
    )
    return stats.filter((F.col("elev_std") >= min_std) & (F.col("burnable") >= min_burnable))
