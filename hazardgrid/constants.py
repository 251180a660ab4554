"""Fixed values.

Everything in this file is a published constant, a lookup table or a default that results depend
on. Values are stated in their natural order and hold no logic.
"""

EARTH_RADIUS_M = 6_371_008.8
M_PER_DEG = 111_320.0

# Observation products: error in metres when the report gives none, by kind; any other kind is 750.
SIGMA_M = {
    "goes": 2000.0,
    "viirs": 375.0,
    "modis": 1000.0,
    "camera_front": 500.0,
    "official_perimeter": 120.0,
}
SIGMA_OTHER_M = 750.0

# Active-fire products: name, observation kind, native resolution in metres.
FIRE_PRODUCTS = [
    ("VIIRS_SNPP_NRT", "viirs", 375.0),
    ("VIIRS_NOAA20_NRT", "viirs", 375.0),
    ("MODIS_NRT", "modis", 1000.0),
]
GEO_FIRE_MASK_CODES = [10, 11, 12, 13, 14, 15, 30, 31, 32, 33, 34, 35]
GEO_RESOLUTION_M = 2000.0
PERIMETER_SIGMA_M = 120.0

# Fixed-grid geometry of the geostationary imager (GRS80, sweep x).
GEO_HEIGHT_M = 35_786_023.0
GEO_SEMI_MAJOR_M = 6_378_137.0
GEO_SEMI_MINOR_M = 6_356_752.31414
GEO_LON0_DEG = -137.0

# Enumerations.
FIRE_STATUS = ["active", "contained", "controlled", "out", "unknown"]
OBSERVATION_KINDS = ["goes", "viirs", "modis", "camera_front", "official_perimeter"]
PERIMETER_SOURCES = ["official", "forecast", "observed"]
RECOMMENDATION_KINDS = ["evacuate", "close_road", "stage"]
RESOURCE_KINDS = ["crew", "engine", "air"]
SATELLITE_KINDS = ["goes", "viirs", "modis"]
OBSERVATION_LABELS = {
    "goes": "GOES hotspot",
    "viirs": "VIIRS hotspot",
    "modis": "MODIS hotspot",
    "camera_front": "Camera-derived front",
    "official_perimeter": "Official perimeter",
}

# Anderson (1982) fuel models: number, 1-h dead load lb/ft2, depth ft, surface/volume 1/ft,
# moisture of extinction, burnable.
FUEL_MODELS = [
    (0, 0.0, 0.1, 1500.0, 0.10, False),
    (1, 0.034, 1.0, 3500.0, 0.12, True),
    (2, 0.092, 1.0, 3000.0, 0.15, True),
    (3, 0.138, 2.5, 1500.0, 0.25, True),
    (4, 0.230, 6.0, 2000.0, 0.20, True),
    (5, 0.046, 2.0, 2000.0, 0.20, True),
    (6, 0.069, 2.5, 1750.0, 0.25, True),
    (7, 0.052, 2.5, 1750.0, 0.40, True),
    (8, 0.069, 0.2, 2000.0, 0.30, True),
    (9, 0.134, 0.2, 2500.0, 0.25, True),
    (10, 0.138, 1.0, 2000.0, 0.25, True),
    (11, 0.069, 1.0, 1500.0, 0.15, True),
    (12, 0.184, 2.3, 1500.0, 0.20, True),
    (13, 0.322, 3.0, 1500.0, 0.25, True),
]

# Rothermel (1972) / Albini (1976) constants and unit factors.
TOTAL_MINERAL = 0.0555
EFFECTIVE_MINERAL = 0.010
PARTICLE_DENSITY = 32.0
HEAT_CONTENT = 8000.0
MIDFLAME_FACTOR = 0.4
FTMIN_PER_MS = 196.850394
MS_PER_FTMIN = 1.0 / 196.850394
MPH_PER_MS = 2.2369363

# 40-class fuel codes to the 13 classes, as inclusive ranges; unlisted codes are 0.
FUEL40_RANGES = [
    (91, 99, 0),
    (101, 102, 1),
    (103, 104, 2),
    (105, 109, 3),
    (121, 124, 2),
    (141, 144, 5),
    (145, 149, 4),
    (161, 165, 10),
    (181, 182, 8),
    (183, 189, 9),
    (201, 201, 11),
    (202, 202, 12),
    (203, 204, 13),
]
# Land-cover class to fuel model; unlisted classes are 0.
LANDCOVER_FUEL = {10: 10, 20: 5, 30: 1, 40: 1, 50: 0, 60: 0, 70: 0, 80: 0, 90: 2, 95: 0, 100: 0}

# Residents by place tag when a place carries no usable population; any other tag is 1200.
PLACE_POPULATION = {
    "hamlet": 150,
    "village": 1200,
    "neighbourhood": 2500,
    "suburb": 6000,
    "town": 12000,
    "city": 60000,
}
PLACE_POPULATION_OTHER = 1200
STRUCTURE_OCCUPANCY = 2.6

# Forecast products.
HORIZONS_MIN = [15, 30, 60, 180]
PROB_BANDS = [0.1, 0.3, 0.5, 0.7, 0.9]
COVERAGE_LEVELS = [0.5, 0.8, 0.9]
NEVER_MIN = 1e9

# Ensemble prior.
ENSEMBLE_PRIOR = {
    "n_members": 60,
    "wind_mult_sd": 0.20,
    "wind_dir_sd_deg": 15.0,
    "moisture_mult_sd": 0.25,
    "ros_mult_sd": 0.20,
    "ignition_sd_m": 300.0,
    "spread_cap_ms": 3.0,
    "tail_frac": 0.0,
    "tail_wind_mult": 1.8,
    "tail_wind_mult_sd": 0.5,
    "tail_spread_cap_ms": 12.0,
    "tail_dir_factor": 1.4,
    "seed": 12,
}

# Reweighting filter.
LIKELIHOOD_FLOOR = 1e-12
NO_OVERLAP_SIGMAS = 5.0
OVER_PREDICTION_WEIGHT = 0.4
ESS_FRACTION = 0.5
JITTER = {
    "wind_mult": (0.05, 0.3, 2.5),
    "wind_dir_offset_deg": (3.0, None, None),
    "moisture_mult": (0.05, 0.3, 2.5),
    "ros_mult": (0.05, 0.3, 2.5),
}

# Tracking.
CLUSTER_EPS_KM = 4.0
KM_PER_DEG_LON = 111.32
KM_PER_DEG_LAT = 110.57
PIXEL_KM = 2.0
TRUTH_DISK_M = 1400.0

# Decisions.
EVAC_CLEAR_MIN = 60.0
EVAC_MIN_CONFIDENCE = 0.05
EGRESS_MIN_CONFIDENCE = 0.1
THREAT_PROBABILITY = 0.25
THREAT_DISK_M = 4000.0
STAGING_DISK_M = 300.0
LIVES_UPLIFT = (0.00015, 0.00045)
COVERAGE_TARGET = 0.90
COVERAGE_RAW_LEVEL = 0.10

# Published times of the first mandatory order per fire: key, community, order time UTC.
EVAC_TIMELINE = [
    ("park", "Cohasset", "2024-07-25 02:00:00"),
    ("palisades", "Pacific Palisades", "2025-01-07 18:50:00"),
    ("eaton", "Altadena", "2025-01-08 03:00:00"),
    ("davis", "Washoe City", "2024-09-08 01:00:00"),
    ("gray", "Medical Lake", "2023-08-18 20:00:00"),
]
# Retrospective events: key, name, centre lon, centre lat, start UTC, cell m, half extent m. All
# share window 360, assimilation cutoff 180, horizons 210/240/300/360, 16 frames, 40 members,
# threshold 0.5.
RETRO_EVENTS = [
    ("park", "Park Fire (2024)", -121.68, 39.87, "2024-07-24 22:00:00", 300.0, 26000.0),
    ("palisades", "Palisades Fire (2025)", -118.55, 34.08, "2025-01-07 18:30:00", 250.0, 16000.0),
    ("eaton", "Eaton Fire (2025)", -118.13, 34.19, "2025-01-08 02:30:00", 250.0, 14000.0),
    ("davis", "Davis Fire (2024)", -119.8325, 39.3053, "2024-09-07 21:30:00", 250.0, 16000.0),
    ("gray", "Gray Fire (2023)", -117.731, 47.540, "2023-08-18 19:27:00", 250.0, 15000.0),
]

COMPASS_8 = ["N", "NE", "E", "SE", "S", "SW", "W", "NW"]
COMPASS_16 = [
    "N", "NNE", "NE", "ENE", "E", "ESE", "SE", "SSE",
    "S", "SSW", "SW", "WSW", "W", "WNW", "NW", "NNW",
]
COMPASS_16_WORDS = [
    "north", "north-north-east", "north-east", "east-north-east",
    "east", "east-south-east", "south-east", "south-south-east",
    "south", "south-south-west", "south-west", "west-south-west",
    "west", "west-north-west", "north-west", "north-north-west",
]
