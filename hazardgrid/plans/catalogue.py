"""Loads every query module; the flagship is the decision slice."""

from hazardgrid.plans import (  # noqa: F401
    assimilate_queries,
    calibrate_queries,
    camera_queries,
    decide_queries,
    ensemble_queries,
    flagship,
    geo_queries,
    log_queries,
    source_queries,
    spread_queries,
    stream_queries,
    track_queries,
)

FLAGSHIP = "flagship_evacuation_slice"
