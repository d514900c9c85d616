"""Names, limits and lists that inputs and results share with the data this engine reads.

They are data contracts (metric names, label values, states, default settings); change them only together
with the producers of the data.
"""

from __future__ import annotations

INF = float("inf")

# Detection settings.
SCORE_STEP = 15
TRAIN_STEP = 30
TRAIN_HOURS = 72
MIN_SAMPLES = 240
RETRAIN_HOURS = 6
MIN_RETRAIN_GAP_MINUTES = 60
TRAIN_RETRY_SECONDS = 120
SEASONAL_MIN_SPAN_HOURS = 36
IF_PERCENTILE = 0.995
Z_HIGH = 3.5
Z_LOW = 2.5
VOTE_K = 3
VOTE_N = 4
EWMA_LAMBDA = 0.4
FPR_TOLERANCE = 0.005
PSI_WINDOW = 240
PSI_THRESHOLD = 0.25
MAX_STALENESS_SECONDS = 120
FORECAST_HOURS = 6
FORECAST_STEP = 60
FORECAST_MIN_POINTS = 30
WARMUP_CYCLES = 20
REGIME_MINUTES = 30
REGIME_WINDOW = 120
TREES = 200
TREE_SAMPLE = 256
AUGMENT_COPIES = 4
AUGMENT_RATIO = 0.5
TRAIN_SCORES_CAP = 5000
MODEL_SCHEMA_VERSION = 5

# Calibration grid and limits.
GRID_LAMBDA = (0.2, 0.3, 0.4)
GRID_VOTE = ((3, 4), (4, 6), (5, 8))
GRID_Z_HIGH = (3.5, 4.0, 4.5, 5.0)
GRACE_CYCLES = 8
MISSING_DELAY = 9999

# Replay settings (cycles of 15 s).
REPLAY_WARM = 120
REPLAY_LENGTH = 40
REPLAY_SPACING = 200
REPLAY_RAMP = 8
REPLAY_INTENSITIES = (0.25, 0.5, 1.0)
REPLAY_MIN_ROWS = 2000

# Host features: name, lo, hi, min_effect, direction, critical.
HOST_FEATURES = (
    ("cpu_host", 0.0, 100.5, 5.0, "up", 80.0),
    ("ram_host", 0.0, 100.0, 5.0, "up", 85.0),
    ("disk_host", 0.0, 100.0, 5.0, "up", 85.0),
    ("net_rx_kb", 0.0, 1e7, 50.0, "both", INF),
)
# Features of the application hosted by a node.
HOSTED_APP_FEATURES = (
    ("cpu_server", 0.0, 6400.0, 5.0, "up", INF),
    ("ram_server_mb", 0.0, 1e6, 30.0, "both", INF),
    ("ram_postgres_mb", 0.0, 1e6, 20.0, "both", INF),
    ("app_containers", 0.0, 1000.0, 0.5, "both", INF),
)
# Features of one component of a platform application, then of the application as a whole.
COMPONENT_FEATURES = (("cpu_{c}", 0.0, 6400.0, 5.0, "up", INF), ("ram_{c}_mb", 0.0, 1e6, 20.0, "both", INF))
APP_BASE_FEATURE = ("ram_base_mb", 0.0, 1e6, 20.0, "both", INF)
APP_COUNT_FEATURE = ("app_containers", 0.0, 1000.0, 0.5, "both", INF)
APP_WEB_FEATURES = (("web_ok", 0.0, 1.0, 0.5, "down", INF), ("web_ms", 0.0, 60000.0, 200.0, "up", INF))
# Features read as 0 when their series are empty; the others are missing then.
ZERO_FILLED = ("cpu_server", "ram_server_mb", "ram_postgres_mb", "app_containers")

# Network devices that carry no traffic of their own.
VIRTUAL_DEVICES = "lo|veth.*|docker.*|br-.*|cni.*|flannel.*"

NODE_NAME = r"^[a-z0-9][a-z0-9-]{0,62}$"
K8S_NAME = r"^[a-z0-9]([-a-z0-9]{0,61}[a-z0-9])?$"
APP_PREFIX = "appli-"
CATALOGUE_NAME = r"^[a-z][a-z0-9-]{1,30}[a-z0-9]$"
CATALOGUE_COMPONENT = r"^[a-z][a-z0-9-]{0,30}[a-z0-9]$"
CATALOGUE_BASE = r"^[a-z_][a-z0-9_]{0,62}$"
CATALOGUE_URL = r"^https?://[a-z0-9.-]+(:[0-9]{1,5})?/[A-Za-z0-9/._~-]*$"
RESERVED_NAMES = ("default", "kube-system", "kube-public", "kube-node-lease", "argocd", "plateforme")
SYSTEM_NAMESPACES = ("kube-system", "kube-public", "kube-node-lease", "argocd")

# Decision journal columns, in order, and the length every field is cut to.
JOURNAL_FIELDS = (
    "horodatage", "id", "type", "mode", "alerte", "noeud", "action", "decision", "detail", "code", "duree_s",
    "verification",
)
JOURNAL_FIELD_LENGTH = 500
DETECTION_FIELDS = (
    "epoch", "iforest_score", "iforest_smoothed", "iforest_active", "zscore_max", "zscore_smoothed",
    "zscore_active", "anomaly_active", "top_feature", "top_z",
)
EVENT_FIELDS = ("start_epoch", "end_epoch", "duration_s", "top_feature", "top_z", "detectors")

# Decision limits.
COOLDOWN_SECONDS = 30 * 60
MAX_ACTIONS_PER_HOUR = 3
MAX_ATTEMPTS = 2
FAILURE_BREAKER = 3
VERIFY_DELAY = 300
DAY = 86400

# Notification routes: name, wait, interval and repeat in seconds, whether resolved alerts are told, grouping labels,
# severities left out.
ROUTES = (
    ("mail", 30, 300, 4 * 3600, True, ("alertname", "node"), ("info",)),
    ("agent", 10, 60, 1800, False, ("alertname", "node", "job"), ()),
)

# Return codes of an executed action.
OUTCOMES = {0: "succes", 3: "rien_a_faire", 4: "refusee"}
OUTCOME_FAILED = "echec"

COLLECTOR_JOBS = ("cadvisor", "cadvisor-k3s")
SERVER_FEATURES = ("cpu_server", "ram_server_mb")
HOST_LOAD_FEATURES = ("cpu_host", "ram_host")
APPLICATION_ALERTS = ("AnomalieApplication", "ApplicationHorsLigne")

# Inventory: ports that may listen on an empty server, and platform ports left out of service discovery.
EMPTY_SERVER_PORTS = (22, 53)
WEB_PORTS = {80: "http", 443: "https", 3000: "http", 8080: "http", 8200: "http", 9000: "http"}

# Sets kept by the backup rotation.
KEEP_DAILY = 7
KEEP_WEEKLY = 4
KEEP_HISTORY = 3
