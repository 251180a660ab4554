"""Surface rate of spread (Rothermel 1972 as collected in Andrews 2018) as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hazardgrid import constants as K
from hazardgrid.functions.draws import clip
from hazardgrid.functions.lookup import fuel_parameters


def length_to_breadth(midflame_ms: Column) -> Column:
    """Ellipse length over breadth (Anderson 1983), held to 1..8."""
    mph = F.greatest(F.lit(0.0), midflame_ms) * K.MPH_PER_MS
    lb = F.exp(mph * 0.2566) * 0.936 + F.exp(mph * -0.1548) * 0.461 - 0.397
    return clip(lb, 1.0, 8.0)


def eccentricity(lb: Column) -> Column:
    return F.sqrt(clip(F.lit(1.0) - F.lit(1.0) / (lb * lb), 0.0, 0.999))


def fuel_terms(fuel: Column) -> dict[str, Column]:
    """What depends on the fuel alone: one row per fuel is enough for any number of cells."""
    fp = fuel_parameters(fuel)
    load, depth, sav = fp["load"], fp["depth"], fp["sav"]
    bulk = load / depth
    packing = bulk / K.PARTICLE_DENSITY
    ratio = packing / (F.pow(sav, F.lit(-0.8189)) * 3.348)
    sav15 = F.pow(sav, F.lit(1.5))
    a = F.pow(sav, F.lit(-0.7913)) * 133.0
    reaction = sav15 / (sav15 * 0.0594 + 495.0) * F.pow(ratio, a) * F.exp(a * (F.lit(1.0) - ratio))
    damp_mineral = min(1.0, 0.174 * K.EFFECTIVE_MINERAL**-0.19)
    net_load = load / (1.0 + K.TOTAL_MINERAL)
    flux = F.exp((F.sqrt(sav) * 0.681 + 0.792) * (packing + 0.1)) / (sav * 0.2595 + 192.0)
    e = F.exp(sav * -3.59e-4) * 0.715
    return {
        "burnable": fp["burnable"],
        "mx": fp["mx"],
        "dry_intensity": reaction * net_load * K.HEAT_CONTENT * damp_mineral,
        "flux": flux,
        "sink": bulk * F.exp(F.lit(-138.0) / sav),
        "wind_c": F.exp(F.pow(sav, F.lit(0.55)) * -0.133) * 7.47 * F.pow(ratio, -e),
        "wind_b": F.pow(sav, F.lit(0.54)) * 0.02526,
        "slope_c": F.when(packing > 0, F.pow(packing, F.lit(-0.3)) * 5.275),
    }


def fuel_table(spark: SparkSession) -> DataFrame:
    """``fuel_terms`` of the fuels 0 to 13, as ``fuel, terms``."""
    fuel = F.col("id").cast("int")
    terms = F.struct(*[c.alias(n) for n, c in fuel_terms(fuel).items()])
    return spark.range(14).select(fuel.alias("fuel"), terms.alias("terms"))


def bed_terms(terms: dict[str, Column], moisture: Column) -> dict[str, Column]:
    """The fuel's terms with the base rate (m/s) and intensity at a moisture."""
    rm = F.least(moisture / terms["mx"], F.lit(1.0))
    damp = clip(F.lit(1.0) - rm * 2.59 + rm * rm * 5.11 - rm * rm * rm * 3.52, 0.0, 1.0)
    intensity = terms["dry_intensity"] * damp
    sink = terms["sink"] * (moisture * 1116.0 + 250.0)
    base = F.when(terms["burnable"] & (sink > 0), intensity * terms["flux"] / sink * K.MS_PER_FTMIN)
    return {
        **terms,
        "base_ms": F.coalesce(base, F.lit(0.0)),
        "intensity": F.when(terms["burnable"], intensity).otherwise(F.lit(0.0)),
    }


def wind_factor(bed: dict[str, Column], wind_ms: Column, midflame=K.MIDFLAME_FACTOR) -> Column:
    u = F.greatest(F.lit(0.0), wind_ms) * midflame * K.FTMIN_PER_MS
    phi = bed["wind_c"] * F.pow(u, bed["wind_b"])
    return F.when(bed["burnable"] & (u > 0), phi).otherwise(F.lit(0.0))


def slope_factor(bed: dict[str, Column], slope: Column) -> Column:
    s = F.greatest(F.lit(0.0), slope)
    return F.coalesce(F.when(bed["burnable"], bed["slope_c"] * s * s), F.lit(0.0))


def rothermel(fuel: Column, moisture: Column, wind_ms: Column, slope: Column) -> Column:
    """Head and base rate, ellipse shape and intensity of one row; unknown fuel does not burn."""
    known = F.when(fuel.between(0, 13), fuel).otherwise(F.lit(0))
    bed = bed_terms(fuel_terms(known), F.greatest(F.lit(0.005), moisture))
    head = bed["base_ms"] * (F.lit(1.0) + wind_factor(bed, wind_ms) + slope_factor(bed, slope))
    lb = length_to_breadth(wind_ms * K.MIDFLAME_FACTOR)
    return F.struct(
        F.when(bed["burnable"], head).otherwise(F.lit(0.0)).alias("ros_head_ms"),
        bed["base_ms"].alias("ros_base_ms"),
        F.when(bed["burnable"], lb).otherwise(F.lit(1.0)).alias("length_to_breadth"),
        bed["intensity"].alias("reaction_intensity"),
    )
