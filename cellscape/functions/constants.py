"""Fixed values of the data model, needed for equal results."""

GRID = 120
CODES = (1, 2, 3)
UNIT_NAMES = {1: "smooth_highlands", 2: "rough_highlands", 3: "shadowed_floor"}
PALETTE = {
    0: (150, 150, 150, 255),
    1: (70, 110, 200, 255),
    2: (190, 215, 60, 255),
    3: (170, 50, 60, 255),
}
UNKNOWN = 255
SURE, MOSTLY, UNSURE = 1, 2, 3
CONFIDENCE_WEIGHT = {SURE: 1.0, MOSTLY: 0.5, UNSURE: 0.2}
APPROVED_WEIGHT = 0.5
MIN_COVERAGE = 0.9
MISSING_MAGNITUDE = 1e30

# Window widths in metres.
ROUGH_M = 135
REL_M = 4000
LOCAL_M = 150
CURV_M = 60
SKY_M = 10000
SKY_LOCAL_M = 300

BASE_FEATURES = ("slope", "rough", "svf", "rel_local", "curv", "svf_local")
FEATURE_VERSION = 6

TILE_SIZE = 1024
PRODUCT_LAYER = {
    "GLDOMOS": "nac",
    "GLDELEV": "sfs",
    "GLDMASK": "image_count",
    "GLDSBCT": "solar_bins",
    "GLDBRES": "best_resolution",
    "GLDSIGM": "uncertainty",
    "GLDISGM": "uncertainty",
}
REQUIRED_MEMBERS = ("nac", "sfs", "image_count", "readme")
ARCHIVE_NAME = r"^A3CLR22_(\d+)_([A-Za-z0-9_]+)\.zip$"

PER_STRATUM = 2000
MAX_TRAIN_ROWS = 120000
PER_CELL = 120
PAGE_SIZE = 24
MIN_PATCH = 4

REPORT_NAME = r"^evaluation-(\d{8}T\d{6}\.\d{6}Z-[0-9a-f]{8})\.json$"
