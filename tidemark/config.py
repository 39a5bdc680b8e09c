"""Fixed values of the data model, plainly and together, and the defaults of the operators."""

# Bucketing and scoring of rolling baselines.
BUCKET_HOURS = 1
SPLIT_WEEKEND = True
WINDOW_SAMPLES = 30
Z_THRESHOLD = 3.0
ROBUST_CONSTANT = 0.6745
MIN_SAMPLES = 5
STATE_PREFIX = "phase0:baseline"

# Event records and their encoding.
REQUIRED_FIELDS = ["entity_id", "timestamp", "cloud", "entity_type", "namespace", "metric_name", "value"]
METRIC_FIELDS = ["vm_id", "metric_name", "timestamp", "value"]
CATEGORICAL = ["cloud", "entity_type", "namespace", "metric_name"]
NUMERIC = ["value_norm", "hour_of_day", "day_of_week"]
VALUE_EPS = 1e-6

# Windows, profiles, search.
SEQUENCE, STRIDE = 32, 16
HISTORY, HISTORY_DAYS = 30, 90
CENTROID_ALPHA, DRIFT_ALARM_STD = 0.1, 3.0
TOP_K, N_LIST, N_PROBE = 10, 100, 20
BATCH_SECONDS, CACHE_SECONDS = 300, 1800

# The encoder's shape.
EMBED_DIM, FEATURE_DIM, GRU_HIDDEN, GRU_LAYERS, TIME2VEC = 128, 256, 128, 2, 8
TEMPERATURE = 0.07

# Graded alerts.
W_DEVIATION, W_DRIFT, W_SIMILARITY = 0.4, 0.4, 0.2
GLOBAL_THRESHOLD, LOCAL_THRESHOLD, DRIFT_THRESHOLD = 0.3, 0.25, 0.5
MEDIUM, HIGH, CRITICAL = 0.3, 0.6, 0.8

# Corpus synthesis.
NOISE_FRACTION = 0.05
SPIKE, DROP, ANOMALY_MINUTES = (3.0, 6.0), (0.05, 0.2), (15, 45)
BUSINESS_HOURS = [0.1, 0.1, 0.1, 0.1, 0.15, 0.2, 0.4, 0.7, 0.9, 1.0, 1.0, 1.0, 0.95, 1.0, 1.0, 0.95, 0.9, 0.85, 0.7, 0.5, 0.35, 0.25, 0.15, 0.1]
ALWAYS_ON = [0.7, 0.65, 0.6, 0.6, 0.65, 0.7, 0.8, 0.9, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 0.95, 0.9, 0.9, 0.85, 0.8, 0.8, 0.75, 0.75, 0.7]
ARCHETYPES = [
    ("Instances", "AWS", "AWS/EC2", "NetworkIn", 80000.0, "business_hours"),
    ("Instances", "AWS", "AWS/EC2", "CPUUtilization", 35.0, "business_hours"),
    ("Instances", "AWS", "AWS/EC2", "NetworkOut", 60000.0, "business_hours"),
    ("Virtual_Machines", "Azure", "Microsoft.Compute", "Network In", 50000.0, "business_hours"),
    ("Virtual_Machines", "Azure", "Microsoft.Compute", "Percentage CPU", 40.0, "business_hours"),
    ("Private_Endpoint", "Azure", "Microsoft.Network", "PEBytesIn", 5000.0, "always_on"),
    ("oci_connector", "OCI", "oci_service_connector_hub", "BytesReadFromSource", 200.0, "always_on"),
    ("oci_connector", "OCI", "oci_service_connector_hub", "BytesWrittenToTarget", 180.0, "always_on"),
    ("Security_Groups", "AWS", "AWS/EC2", "NetworkPackets", 1000.0, "always_on"),
]
CORPUS_COLUMNS = [
    "entity_id", "entity_type", "cloud", "namespace", "metric_name", "timestamp", "value", "hour_anchor", "is_anomaly", "anomaly_type",
    "day_of_week", "hour_of_day", "minute_of_hour", "account_id", "unit",
]

# Augmentation of wide records.
JITTER_MINUTES, MASK_RATIO, MASK_FILL = (1.0, 5.0), (0.10, 0.30), 0.0
WIDE_NUMERIC = ["cpu_usage", "memory_usage", "disk_io_read", "disk_io_write", "net_throughput_in", "net_throughput_out"]
WIDE_PROTECTED = ["vm_role", "region", "os_type"]
