"""Scalar constants of the risk, routing, intake and segment-year rules.

Fixed values: they define the results, so they are stated plainly and in one place.
"""

# Risk score weights.
TERRAIN_WEIGHT = 0.35
HISTORICAL_WEIGHT = 0.35
WEATHER_WEIGHT = 0.20
INCIDENT_WEIGHT = 0.10

# Component scales.
SLOPE_ZERO_DEG = 2.0
SLOPE_FULL_DEG = 25.0
HISTORY_COUNT_FULL = 5
HISTORY_PROXIMITY_M = 500.0
HISTORY_COUNT_SHARE = 0.7

RISK_LEVELS = {"critical": 0.75, "high": 0.5, "moderate": 0.25, "low": 0.0}
HAZARD_LEVELS = {"very_high": 0.75, "high": 0.5, "moderate": 0.25, "low": 0.0}
RISK_LEVEL_ORDER = ["low", "moderate", "high", "critical"]

# Static terrain risk.
TERRAIN_BASE_RISK = {"plain": 0.05, "hill": 0.15, "mountain": 0.25}
LANDSLIDE_SUSCEPTIBILITY_WEIGHT = 0.4
FLOOD_SUSCEPTIBILITY_WEIGHT = 0.2
TERRAIN_PLAIN_BELOW_M = 300.0
TERRAIN_HILL_BELOW_M = 1500.0

# Routing and decisions.
RISK_COST_WEIGHT = 2.0
HARD_UNSAFE_SCORE = 0.65
ROUTE_MAX_SHARE = 0.7
HYSTERESIS_SCORE = 0.05

# Severity to factor.
INCIDENT_SEVERITY_FACTOR = {"minor": 0.2, "major": 0.5, "blocking": 1.0}
WEATHER_SEVERITY_FACTOR = {"minor": 0.3, "major": 0.6, "blocking": 0.9}
HAZARD_TYPES = ["heavy_rain", "landslide", "road_blockage"]
CLOSURE_TYPES = ["landslide", "road_blockage"]
CLOSURE_SEVERITY = "blocking"

# Daily rainfall (mm) to weather factor, piecewise linear anchors.
RAIN_ANCHORS = [(0.0, 0.0), (2.5, 0.10), (15.6, 0.30), (64.5, 0.60), (204.4, 1.0)]
HIGH_RAIN_FACTOR = 0.30
RAIN_MATCH_MAX_DEG = 0.2
RAIN_GRID_DEG = 0.25
RAIN_MISSING_MM = -999.0
RAINY_DAY_MM = 1.0
MONSOON_MONTHS = (6, 9)
RAIN_EPOCH = "1900-12-31"

# Hazard-zonation classes.
HAZARD_CLASS_SCORE = {
    "very low": 0.10,
    "low": 0.25,
    "moderate": 0.45,
    "medium": 0.45,
    "high": 0.70,
    "very high": 0.90,
    "severe": 0.90,
}
ZONE_SAMPLE_FRACTIONS = [0.0, 0.25, 0.5, 0.75, 1.0]

# Spatial thresholds.
LANDSLIDE_MATCH_M = 500.0
REPORT_SNAP_M = 300.0
NAMED_PLACE_SNAP_KM = 10.0
COORD_DECIMALS = 6
EARTH_RADIUS_KM = 6371.0
KM_PER_DEG = 111.32

# Field reports.
DUPLICATE_WINDOW_S = 3600
INCIDENT_TO_HAZARD = {
    "landslide": "landslide",
    "road_blockage": "road_blockage",
    "flooding": "road_blockage",
    "accident": "road_blockage",
    "fallen_tree": "road_blockage",
    "damaged_road": "road_blockage",
    "other": "road_blockage",
}

# Road classes and their default speeds (km/h).
ROAD_CLASS_SPEED = {
    "trunk": 50.0,
    "trunk_link": 30.0,
    "primary": 40.0,
    "primary_link": 25.0,
    "secondary": 35.0,
    "secondary_link": 25.0,
    "tertiary": 30.0,
    "tertiary_link": 20.0,
    "unclassified": 25.0,
}
FALLBACK_SPEED = 25.0
FALLBACK_ELEVATION_M = 300.0

# Terrain sampling and its plausibility limits.
SAMPLE_INTERVAL_M = 90.0
MIN_SLOPE_SAMPLES = 2
TILE_SAMPLES = 3601
TILE_VOID = -32768
TILE_BLOCK_INTERVALS = 60
PLAUSIBLE_ELEVATION_M = (-20.0, 6000.0)
SUSPICIOUS_SLOPE_DEG = 25.0

DEFAULT_SPEED_KMPH = 60.0

# Segment-year study.
NO_HISTORY_DISTANCE_M = 5000.0
ML_VALID_AFTER_YEAR = 2025
ML_EXPERIMENT_ID = "segment_year_v2_17feature"
RF_TREES = 300
RF_DEPTH = 5
RF_MIN_LEAF = 5
LR_MAX_ITER = 2000
MODEL_SEED = 42
ML_TIERS = {"Elevated": 0.66, "Moderate": 0.33}

# Text dictionaries (fixed word lists).
DISTRICTS = [
    "Lower Dibang Valley", "Upper Dibang Valley", "Dibang Valley",
    "East Kameng", "West Kameng", "Pakke-Kessang", "Pakke Kessang",
    "East Siang", "West Siang", "Lower Siang", "Upper Siang", "Siang",
    "Lower Subansiri", "Upper Subansiri", "Kurung Kumey", "Kra Daadi", "Kamle",
    "Lepa Rada", "Shi Yomi",
    "Anjaw", "Changlang", "Longding", "Tirap", "Namsai", "Lohit",
    "Papum Pare", "Tawang",
]
MOVEMENT_TYPES = [
    "rock wedge failure", "rock cum debris slide", "rock cum debris flow",
    "rock cum debris", "debris avalanche", "debris slide", "debris flow",
    "soil slide", "earth slide", "rock slide", "rock fall", "earth flow",
    "subsidence", "sinking", "debris",
]
HEADER_MARKERS = ["sl.no", "movement type", "slide_no"]
NEGATIVE_KEYWORDS = [
    "stable", "dormant", "no fresh", "inactive", "repaired", "stabilized",
    "stabilised", "no movement", "checked", "surveyed", "monitored", "cleared",
]
MONTHS = [
    "January", "February", "March", "April", "May", "June", "July",
    "August", "September", "October", "November", "December",
]

# Named reference places: name, type, lat, lng, elevation (m).
NAMED_PLACES = [
    ("Guwahati", "city", 26.1805978, 91.7539430, 55.0),
    ("Tezpur", "town", 26.6229928, 92.7976082, 80.0),
    ("Bhalukpong", "town", 27.0137235, 92.6358068, 216.0),
    ("Bomdila", "city", 27.2644450, 92.4206519, 2399.0),
    ("Dirang", "town", 27.3600800, 92.2412100, 1621.0),
    ("Sela Pass", "mountain_pass", 27.5035642, 92.1044346, 4189.0),
    ("Tawang", "city", 27.5879186, 91.8637330, 2853.0),
]
