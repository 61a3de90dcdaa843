"""Constants shared by all modules: column sets, label taxonomy, privacy grid."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Names, label maps and parameter grids that results depend on.
# ---------------------------------------------------------------------------

METADATA_COLUMNS = (
    "label_raw", "label_binary", "label_multiclass", "dataset_source", "split", "row_id",
)

# The 49 official column names of the headerless UNSW-NB15 CSV files.
UNSW_COLUMNS = (
    "srcip", "sport", "dstip", "dsport", "proto", "state", "dur",
    "sbytes", "dbytes", "sttl", "dttl", "sloss", "dloss", "service",
    "Sload", "Dload", "Spkts", "Dpkts", "swin", "dwin", "stcpb",
    "dtcpb", "smeansz", "dmeansz", "trans_depth", "res_bdy_len", "Sjit", "Djit",
    "Stime", "Ltime", "Sintpkt", "Dintpkt", "tcprtt", "synack", "ackdat",
    "is_sm_ips_ports", "ct_state_ttl", "ct_flw_http_mthd", "is_ftp_login", "ct_ftp_cmd", "ct_srv_src", "ct_srv_dst",
    "ct_dst_ltm", "ct_src_ltm", "ct_src_dport_ltm", "ct_dst_sport_ltm", "ct_dst_src_ltm", "attack_cat", "label",
)

BENIGN = "BENIGN"
UNKNOWN = "Unknown"

# Raw label (trimmed, lower case) -> class, CIC-IDS2018. "infilteration" is the spelling in the data.
CIC_LABELS = {
    "benign": BENIGN,
    "dos attacks-hulk": "DoS",
    "dos attacks-slowhttptest": "DoS",
    "dos attacks-slowloris": "DoS",
    "dos attacks-goldeneye": "DoS",
    "ddos attack-hoic": "DDoS",
    "ddos attack-loic-udp": "DDoS",
    "ddos attacks-loic-http": "DDoS",
    "ssh-bruteforce": "BruteForce",
    "ftp-bruteforce": "BruteForce",
    "bot": "Botnet",
    "infilteration": "Infiltration",
    "sql injection": "WebAttack",
    "brute force -web": "WebAttack",
    "brute force -xss": "WebAttack",
}

# attack_cat (trimmed, lower case) -> class, UNSW-NB15. An empty category is normal traffic.
UNSW_LABELS = {
    "": BENIGN,
    "normal": BENIGN,
    "dos": "DoS",
    "fuzzers": "Fuzzing",
    "reconnaissance": "Reconnaissance",
    "exploits": "Exploits",
    "backdoors": "Malware",
    "shellcode": "Malware",
    "worms": "Malware",
    "analysis": "Other",
    "generic": "Other",
}

DISPLAY_NAMES = {
    "logistic_regression": "Logistic Regression",
    "random_forest": "Random Forest",
    "xgboost": "XGBoost",
    "dp_logistic_regression": "DP-LR",
    "dp_random_forest": "DP-RF",
    "dp_sgd": "DP-SGD",
}

BASELINE_MODELS = ("logistic_regression", "random_forest", "xgboost")
DP_MODELS = ("dp_logistic_regression", "dp_random_forest", "dp_sgd")
MODEL_ORDER = BASELINE_MODELS + DP_MODELS

EPSILON_GRID = (0.01, 0.05, 0.1, 0.2, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0, 5.0, 7.0, 10.0)

COMPARISON_METRICS = (
    "accuracy", "f1_macro", "f1_weighted", "precision_macro", "recall_macro",
    "roc_auc", "mcc", "false_positive_rate", "detection_rate",
)

HEAT_METRICS = ("f1_macro", "f1_weighted", "precision_macro", "recall_macro", "roc_auc", "mcc",
                "detection_rate", "false_positive_rate")
DEGRADATION_METRICS = ("f1_macro", "roc_auc", "mcc", "detection_rate")

ATTACK_METRICS = (
    "attack_accuracy", "attack_precision", "attack_recall", "attack_f1",
    "attack_roc_auc", "attack_advantage", "tpr_at_fpr_0_01", "tpr_at_fpr_0_10",
)

TARGET_METRICS = (
    "target_accuracy", "target_f1_macro", "target_roc_auc",
    "target_false_positive_rate", "target_detection_rate",
)


LABEL_TYPES = ("binary", "multiclass")


def check_label_type(label_type: str) -> None:
    """Two classes, or all of them."""
    if label_type not in LABEL_TYPES:
        raise ValueError(f"unknown kind of label '{label_type}'; known are {', '.join(LABEL_TYPES)}")


@dataclass(frozen=True)
class Dialect:
    """How the raw CSV files of one data set are read."""

    name: str
    encoding: str = "UTF-8"
    sep: str = ","
    header: bool = True
    label_column: str = "label"
    columns: tuple[str, ...] = ()


DIALECTS = {
    "cic_ids2018": Dialect("cic_ids2018", encoding="ISO-8859-1"),
    "unsw_nb15": Dialect("unsw_nb15", header=False, columns=UNSW_COLUMNS),
}


@dataclass(frozen=True)
class Settings:
    """Defaults of the experiment; pass a changed copy to override."""

    subset_size: int = 300_000
    seed: int = 42
    test_size: float = 0.2
    null_threshold: float = 0.6
    epsilons: tuple[float, ...] = EPSILON_GRID
    n_trees: int = 100
    boosting_rounds: int = 100
    tree_depth: int = 10
    hidden_layers: tuple[int, ...] = (128, 64)
    epochs: int = 20
    max_grad_norm: float = 1.0
    delta: float = 1e-5
    attack_cap: int = 5000
    attack_test_ratio: float = 0.30
    prob_feature_cutoff: int = 20
    metadata: tuple[str, ...] = field(default=METADATA_COLUMNS)


DEFAULTS = Settings()

RESULT_SCHEMA = T.StructType([
    T.StructField("run_id", T.StringType()),
    T.StructField("dataset", T.StringType()),
    T.StructField("label_type", T.StringType()),
    T.StructField("model_name", T.StringType()),
    T.StructField("epsilon", T.DoubleType()),
    T.StructField("delta", T.DoubleType()),
    T.StructField("actual_epsilon", T.DoubleType()),
    T.StructField("train_time_s", T.DoubleType()),
    T.StructField("public_bounds", T.BooleanType()),
    T.StructField("split", T.StringType()),
    *[T.StructField(m, T.DoubleType()) for m in COMPARISON_METRICS],
    T.StructField("false_negative_rate", T.DoubleType()),
    T.StructField("version", T.LongType()),
])

ATTACK_SCHEMA = T.StructType([
    T.StructField("run_id", T.StringType()),
    T.StructField("dataset", T.StringType()),
    T.StructField("label_type", T.StringType()),
    T.StructField("target_model", T.StringType()),
    T.StructField("attack_type", T.StringType()),
    T.StructField("epsilon", T.DoubleType()),
    T.StructField("delta", T.DoubleType()),
    T.StructField("n_members", T.LongType()),
    T.StructField("n_non_members", T.LongType()),
    T.StructField("n_attack_train", T.LongType()),
    T.StructField("n_attack_test", T.LongType()),
    *[T.StructField(m, T.DoubleType()) for m in ATTACK_METRICS],
    *[T.StructField(m, T.DoubleType()) for m in TARGET_METRICS],
    T.StructField("version", T.LongType()),
])
