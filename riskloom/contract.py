"""Column contracts, event schemas and tunable defaults."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# The columns of the model input, in order.
VELOCITY_COLUMNS = ("card_txn_count_24h", "card_amt_sum_24h", "card_amt_mean_24h", "card_amt_max_24h", "seconds_since_prev_txn")
AMOUNT_COLUMNS = ("amt_to_card_mean_24h", "amt_log", "TransactionAmt")
NUMERIC_COLUMNS = (*(f"C{i}" for i in range(1, 15)), *(f"D{i}" for i in range(1, 16)), "dist1", "dist2", "addr1", "addr2")
CATEGORICAL_COLUMNS = (
    "ProductCD", "card4", "card6", "P_emaildomain", "R_emaildomain", *(f"M{i}" for i in range(1, 10)),
    "DeviceType", "DeviceInfo", "id_12", "id_15", "id_16", "id_28", "id_29", "id_30", "id_31",
)
CARD_KEY_COLUMNS = ("card1", "card2", "card3", "card5")
LABEL = "isFraud"
#: What a missing velocity value becomes.
VELOCITY_FILLS = {"card_txn_count_24h": 0.0, "card_amt_sum_24h": 0.0, "card_amt_mean_24h": 0.0, "card_amt_max_24h": 0.0, "seconds_since_prev_txn": -1.0}


def encoded_feature_names(columns: Sequence[str] = CATEGORICAL_COLUMNS) -> list[str]:
    """For each categorical, its frequency and its target column."""
    return [f"{c}_{kind}" for c in columns for kind in ("freq", "target")]


def feature_columns(v_columns: Sequence[str] = ()) -> list[str]:
    return [*VELOCITY_COLUMNS, *AMOUNT_COLUMNS, *NUMERIC_COLUMNS, *v_columns, *encoded_feature_names()]


def require_columns(df: DataFrame, columns: Sequence[str]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise KeyError(f"missing columns: {missing}")


def same_features(model: Sequence[str], contract: Sequence[str]) -> None:
    """The model's feature set must equal the contract's; ValueError names the differences."""
    lacking, extra = sorted(set(contract) - set(model)), sorted(set(model) - set(contract))
    if lacking or extra:
        raise ValueError(f"feature contract differs: model lacks {lacking}, has besides {extra}")


_doubles = [T.StructField(c, T.DoubleType()) for c in NUMERIC_COLUMNS]
RAW_ATTRIBUTES = T.StructType([*_doubles, T.StructField("v", T.MapType(T.StringType(), T.DoubleType())), T.StructField("categorical", T.MapType(T.StringType(), T.StringType()))])
TRANSACTION_EVENT = T.StructType([
    T.StructField("transaction_id", T.StringType()), T.StructField("card_id", T.StringType()), T.StructField("amount", T.DoubleType()),
    T.StructField("event_timestamp", T.StringType()), T.StructField("raw", RAW_ATTRIBUTES),
])
PREDICTION_EVENT = T.StructType([
    T.StructField("transaction_id", T.StringType()), T.StructField("card_id", T.StringType()), T.StructField("fraud_score", T.DoubleType()),
    T.StructField("decision", T.BooleanType()), T.StructField("threshold", T.DoubleType()), T.StructField("model_version", T.IntegerType()),
])
SCORED_FEATURES_EVENT = T.StructType([
    T.StructField("transaction_id", T.StringType()), T.StructField("model_version", T.IntegerType()), T.StructField("fraud_score", T.DoubleType()),
    T.StructField("decision", T.BooleanType()), T.StructField("features", T.MapType(T.StringType(), T.DoubleType())),
])
LABEL_EVENT = T.StructType([T.StructField("transaction_id", T.StringType()), T.StructField("is_fraud", T.IntegerType())])
DRIFT_ALERT = T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("metric", T.StringType()), T.StructField("value", T.DoubleType()),
    T.StructField("threshold", T.DoubleType()), T.StructField("detected_at", T.StringType()),
])


def _within(value: float, interval: str) -> bool:
    low, high = (float(x) for x in interval[1:-1].split(","))
    return (low <= value if interval[0] == "[" else low < value) and (value <= high if interval[-1] == "]" else value < high)


def _all_within(values: object, section: str, limits: dict[str, str]) -> None:
    for name, interval in limits.items():
        if not _within(getattr(values, name), interval):
            raise ValueError(f"{section}.{name} must lie in {interval}, not {getattr(values, name)}")


@dataclass(frozen=True)
class CostMatrix:
    false_negative: float = 100.0
    false_positive: float = 5.0

    def __post_init__(self) -> None:
        if self.false_negative < 0 or self.false_positive < 0:
            raise ValueError("costs must not be negative")


@dataclass(frozen=True)
class SplitParams:
    val: float = 0.15
    test: float = 0.15
    holdout: float = 0.15

    def __post_init__(self) -> None:
        _all_within(self, "split", {"val": "(0, 1)", "test": "(0, 1)", "holdout": "(0, 1)"})
        if self.val + self.test + self.holdout >= 1:
            raise ValueError("split leaves no training rows")


@dataclass(frozen=True)
class SelectionParams:
    max_missing: float = 0.9
    max_correlation: float = 0.85
    max_features: int = 30
    sample_rows: int = 100_000
    min_periods: int = 1000

    def __post_init__(self) -> None:
        _all_within(self, "selection", {"max_missing": "[0, 1)", "max_correlation": "[0, 1]", "max_features": "[1, inf)", "sample_rows": "[1, inf)", "min_periods": "[1, inf)"})


@dataclass(frozen=True)
class MonitorParams:
    psi: float = 0.2
    top_n: int = 15
    auprc_floor: float = 0.30
    debounce: int = 3
    window: int = 5000
    retention_s: float = 1800.0
    recompute_s: float = 15.0
    min_matched: int = 200
    min_current: int = 500
    clock_skew_s: float = 300.0
    max_ids: int = 200_000
    cooldown_s: float = 3600.0

    def __post_init__(self) -> None:
        limits = {"psi": "(0, inf)", "auprc_floor": "[0, 1]", "cooldown_s": "[0, inf)"} | dict.fromkeys(("top_n", "debounce", "window", "min_matched", "min_current", "max_ids"), "[1, inf)")
        _all_within(self, "monitor", limits | dict.fromkeys(("retention_s", "recompute_s", "clock_skew_s"), "(0, inf)"))


@dataclass(frozen=True)
class CanaryParams:
    steps: tuple[float, ...] = (0.05, 0.25, 1.0)
    max_p99_s: float = 0.05
    max_error_rate: float = 0.001
    min_auprc_ratio: float = 0.98
    min_agreement: float = 0.95
    min_samples: int = 500
    max_holds: int = 3

    def __post_init__(self) -> None:
        """Steps must be non-empty, strictly increasing and in (0, 1]."""
        _all_within(self, "canary", {"max_p99_s": "(0, inf)", "max_error_rate": "[0, 1]", "min_auprc_ratio": "(0, 1]", "min_agreement": "[0, 1]", "min_samples": "[1, inf)", "max_holds": "[0, inf)"})
        s = self.steps
        if not s or any(not 0 < x <= 1 for x in s) or any(a >= b for a, b in zip(s, s[1:], strict=False)):
            raise ValueError(f"bad canary steps {s}")


@dataclass(frozen=True)
class ReplayParams:
    warp: float = 2000.0
    max_wait_s: float = 2.0
    label_lag_days: float = 7.0
    jitter: float = 0.2

    def __post_init__(self) -> None:
        _all_within(self, "replay", {"warp": "(0, inf)", "max_wait_s": "[0, inf)", "label_lag_days": "[0, inf)", "jitter": "[0, 1)"})


@dataclass(frozen=True)
class Params:
    """All defaults. ``from_dict`` rejects unknown sections and keys and values out of range."""

    seed: int = 42
    smoothing: float = 20.0
    folds: int = 5
    recall_ks: tuple[float, ...] = (0.005, 0.01, 0.05)
    recall_floor: float = 0.1
    alert_budget: float = 0.1
    trials: int = 50
    timeout_s: float = 3600.0
    auprc_tolerance: float = 0.0
    cost_tolerance: float = 0.0
    split: SplitParams = field(default_factory=SplitParams)
    cost: CostMatrix = field(default_factory=CostMatrix)
    selection: SelectionParams = field(default_factory=SelectionParams)
    monitor: MonitorParams = field(default_factory=MonitorParams)
    canary: CanaryParams = field(default_factory=CanaryParams)
    replay: ReplayParams = field(default_factory=ReplayParams)

    def __post_init__(self) -> None:
        _all_within(self, "params", {"smoothing": "(0, inf)", "folds": "[2, inf)", "recall_floor": "[0, 1]", "alert_budget": "[0, 1]", "trials": "[1, inf)", "timeout_s": "(0, inf)", "auprc_tolerance": "[0, inf)", "cost_tolerance": "[0, inf)"})
        if not self.recall_ks or any(not 0 < k <= 1 for k in self.recall_ks):
            raise ValueError("recall_ks must lie in (0, 1]")

    @classmethod
    def from_dict(cls, values: dict) -> Params:
        parts = {"split": SplitParams, "cost": CostMatrix, "selection": SelectionParams, "monitor": MonitorParams, "canary": CanaryParams, "replay": ReplayParams}
        made = {k: parts[k](**{a: tuple(b) if isinstance(b, list) else b for a, b in v.items()}) if k in parts else tuple(v) if isinstance(v, list) else v for k, v in values.items()}
        return cls(**made)

    @classmethod
    def load(cls, path: str) -> Params:
        """From a JSON file, or a YAML file where a YAML library is installed."""
        from riskloom.sources.tables import read_text

        text = read_text(path)
        if path.endswith((".yaml", ".yml")):
            import yaml

            return cls.from_dict(yaml.safe_load(text) or {})
        import json

        return cls.from_dict(json.loads(text))
