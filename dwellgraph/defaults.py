"""Default parameters. Every operator takes these as keyword arguments."""

# Thresholds of the published cleaning procedure.
STAY_GAP_S = 1850          # same-cell records closer than this belong to one stay
DRIFT_GAP_S = 1200         # stays further apart than this are never compared for drift
DRIFT_FAR_KM = 4.0         # distance beyond which a neighbour is suspicious
DRIFT_SPEED_MS = 60.0      # speed beyond which a jump is impossible
DRIFT_POINT_RATIO = 3.0    # distance ratio marking an isolated point
DRIFT_CLUSTER_RATIO = 3.0  # distance ratio marking an isolated cluster
DRIFT_SHARE = 0.34         # a dropped cluster holds less than this share of its segment,
DRIFT_CLUSTER_S = 10       # lasts less than this many seconds
DRIFT_CELLS = 3            # and visits fewer cells than this
PINGPONG_GAP_S = 300
MERGE_GAP_S = 10800
RESIDENCE_KM = 0.5
RESIDENCE_MIN_S = 3600
REGION_GAP_S = 3600
POI_RADIUS_M = 100
MIN_RAW_RECORDS = 200      # users need more rows than this at each gate
MIN_RUNS = 1
MIN_CLEAN_STAYS = 100
MIN_MERGED_STAYS = 1

# Walk and embedding settings, and the two threshold lists.
DIMENSIONS = 128
WALK_LENGTH = 80
NUM_WALKS = 10
WINDOW_SIZE = 10
EPOCHS = 1
WORKERS = 8
RETURN_P = 1.0
INOUT_Q = 1.0
EDGE_THRESHOLDS = (2.67, 4.15, 10.66)
MEETING_THRESHOLDS = (7.0, 10.0, 24.0)

# A key with more rows than this is evaluated in several slices instead of one task.
HOT_ROWS = 5_000_000
# Largest table, in rows, that is ever broadcast by an explicit hint.
BROADCAST_ROWS = 1_000_000
# And in bytes, about.
BROADCAST_BYTES = 64 << 20
