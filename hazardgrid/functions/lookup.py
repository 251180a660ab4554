"""Small fixed lookups as expressions, so that they need no join."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hazardgrid import constants as K


def _map(pairs) -> Column:
    flat = []
    for key, value in pairs:
        flat += [F.lit(key), F.lit(value)]
    return F.create_map(*flat)


def sigma_for_kind(kind) -> Column:
    return F.coalesce(F.try_element_at(_map(K.SIGMA_M.items()), kind), F.lit(K.SIGMA_OTHER_M))


def fire_product_kind(product) -> Column:
    return F.try_element_at(_map((n, k) for n, k, _ in K.FIRE_PRODUCTS), product)


def fire_product_resolution(product) -> Column:
    return F.try_element_at(_map((n, r) for n, _, r in K.FIRE_PRODUCTS), product)


def place_population(place) -> Column:
    return F.coalesce(
        F.try_element_at(_map(K.PLACE_POPULATION.items()), F.lower(place)),
        F.lit(K.PLACE_POPULATION_OTHER),
    )


def observation_label(kind) -> Column:
    return F.coalesce(F.try_element_at(_map(K.OBSERVATION_LABELS.items()), kind), kind)


def landcover_to_fuel(code) -> Column:
    return F.coalesce(F.try_element_at(_map(K.LANDCOVER_FUEL.items()), code), F.lit(0))


def fuel40_to_fuel13(code) -> Column:
    expr = None
    for lo, hi, fuel in K.FUEL40_RANGES:
        cond = code.between(lo, hi)
        expr = F.when(cond, F.lit(fuel)) if expr is None else expr.when(cond, F.lit(fuel))
    return expr.otherwise(F.lit(0))


def fuel_parameters(fuel) -> Column:
    """Load, depth, surface/volume, extinction moisture and burnable flag of a fuel code.

    Codes outside 0-13 are clipped to that range.
    """
    rows = F.array(
        *[
            F.struct(
                F.lit(load).alias("load"),
                F.lit(depth).alias("depth"),
                F.lit(sav).alias("sav"),
                F.lit(mx).alias("mx"),
                F.lit(bool(burn and load > 0)).alias("burnable"),
            )
            for _, load, depth, sav, mx, burn in K.FUEL_MODELS
        ]
    )
    return F.element_at(rows, F.greatest(F.lit(0), F.least(fuel.cast("int"), F.lit(13))) + 1)
