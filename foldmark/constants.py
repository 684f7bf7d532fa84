"""Fixed values.

These must equal the values of the behaviour this engine reproduces, otherwise
results differ.  They are data, not logic, and are kept here together.
"""

# Names tried, in this order, when the target is not obvious.
TARGET_NAMES = ["target", "label", "y", "class", "outcome", "prediction"]
# Fixed value: pattern that finds a target named in a task text.
TARGET_PATTERN = r"target(?:\s+column)?[:\s]+['\"`]?([A-Za-z0-9_]+)"
# Names accepted for an id besides those that contain "id".
ID_NAMES = ["index", "key", "row"]

# Problem-type limits.
CLASS_LIMIT = 20            # classes always allowed
CLASS_SHARE = 0.05          # or this share of the rows
CLASS_CEILING = 50          # numeric targets never have more classes than this

# Text patterns that name a metric, first match wins.
METRIC_PATTERNS = [
    (r"\brmsle\b|root mean squared log", "rmsle"),
    (r"\brmse\b|root mean squared error", "rmse"),
    (r"\bmae\b|mean absolute error", "mae"),
    (r"\br2\b|r-squared|coefficient of determination", "r2"),
    (r"\bauc\b|roc[ _-]?auc|area under", "auc"),
    (r"log[ _-]?loss|cross[ _-]?entropy|deviance", "logloss"),
    (r"macro[ _-]?f1|f1[ _-]?macro", "f1_macro"),
    (r"\bf1\b|f1[ _-]?score", "f1"),
    (r"\baccuracy\b|\bacc\b", "accuracy"),
]
# Metric used when the text names none.
DEFAULT_METRIC = {"binary": "auc", "multiclass": "mlogloss", "regression": "rmse"}

# Evaluation defaults.
CV_FOLDS = 5
SEED = 42
MIN_IMPROVEMENT_SIGMAS = 0.1
SIGMA_FLOOR = 1e-9
LOGLOSS_CLIP = 1e-7

# Profile and scan limits.
TOP_VALUES = 5
TARGET_CLASSES_SHOWN = 30
TARGET_VALUES_SHOWN = 10
LEAK_CORRELATION = 0.98
LEAK_THRESHOLD = 0.999
LEAK_MIN_LEVELS = 5
RELATION_TOP = 25
INTERACTION_COLUMNS = 6
INTERACTION_PAIRS = 8
INTERACTION_CLASS_LIMIT = 20
SAMPLE_THRESHOLD = 200_000
SAMPLE_SIZE = 100_000
DIGEST_MISSING_TOP = 15
DIGEST_CARDINALITY_TOP = 10
DIGEST_ALERTS_TOP = 30
CORRELATION_TOP = 15
IMPORTANCE_TOP = 15

# Encoder smoothing, null token and prediction padding.
TE_SMOOTHING = 20.0
TE_SMOOTHING_SUM = 10.0
NULL_TOKEN = "__nan__"
SKEW_LIMIT = 1.0
TOP_VARIANCE = 5
CLIP_PAD = 0.02

# Boosted-tree settings of the frozen model.
MODEL_ROUNDS = 2000         # at most
MODEL_PATIENCE = 150        # rounds without a lower held-out loss
MODEL_DEPTH = 6
MODEL_RATE = 0.03
MODEL_SUBSAMPLE = 0.85
MODEL_SEED = 42
HOLDOUT_SHARE = 0.9

# Journal event classes, journal time format, tail length.
NOISY_EVENTS = ["TOOL_CALL", "TOOL_RESULT", "TOKEN_USAGE"]
STRATEGIC_EVENTS = [
    "BASELINE", "PROPOSE", "RESULT", "ACCEPT", "EVAL_ERROR", "AGENT_ERROR",
    "REACT_TIMEOUT",
]
JOURNAL_TIME_FORMAT = "yyyy-MM-dd HH:mm:ss"
STRATEGIC_TAIL = 32
JOURNAL_TAIL = 5

# Price per one million tokens (model, input, output).
RATE_CARD = [
    ("yandexgpt", 1200.0, 1200.0),
    ("yandexgpt-5-pro", 1200.0, 1200.0),
    ("yandexgpt-5.1", 800.0, 800.0),
    ("yandexgpt-lite", 200.0, 200.0),
    ("qwen3-235b-a22b-fp8", 500.0, 500.0),
    ("deepseek-v32", 500.0, 800.0),
    ("gpt-oss-120b", 300.0, 300.0),
    ("gpt-oss-20b", 100.0, 100.0),
    ("qwen3.6-35b", 200.0, 300.0),
]
