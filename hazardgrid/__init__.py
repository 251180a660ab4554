"""hazardgrid: Spark operators for evolving spatial hazards, keyed by fire."""

__version__ = "0.1.0"
