"""Parameters of a run. Every operator takes them as arguments; nothing is read from globals."""

from __future__ import annotations

from dataclasses import dataclass, field

from faultline.functions.stopwords import ENGLISH_STOP_WORDS

# Weight of each data quality dimension in the composite score.
QUALITY_WEIGHTS = {
    "data_quality_frequency": 0.25,
    "data_quality_freshness": 0.30,
    "data_quality_completeness": 0.25,
    "data_quality_pertinence": 0.20,
}

# Names by cluster position; any other id is "Cluster <id>".
CLUSTER_NAMES = {
    -1: "Other / Unclassified",
    0: "Bearing Wear & Noise",
    1: "Vibration & Imbalance",
    2: "Mechanical Seal Leak",
    3: "Overheating",
    4: "Lubrication Issue",
    5: "Electrical Fault",
    6: "Corrosion & Erosion",
}

# Severity that each known failure label implies.
LABEL_SEVERITY = {
    "bearing_wear": "Medium",
    "seal_leak": "Medium",
    "overheating": "High",
    "vibration": "Medium",
    "electrical_fault": "High",
    "corrosion": "Low",
    "lubrication": "Low",
}


@dataclass(frozen=True)
class Config:
    """Settings of a taxonomy run, with the published defaults."""

    catalog: str | None = None
    schema: str = "maintenance"
    table_format: str = "parquet"

    quality_weights: dict[str, float] = field(default_factory=lambda: dict(QUALITY_WEIGHTS))
    quality_threshold: float = 0.50

    stop_words: tuple[str, ...] = ENGLISH_STOP_WORDS
    max_features: int = 3000
    min_df: int = 2
    embedding_dims: int = 64

    k_values: tuple[int, ...] = tuple(range(4, 14))
    sweep_restarts: int = 10
    sweep_max_iter: int = 300
    final_restarts: int = 20
    final_max_iter: int = 500
    tol: float = 1e-4
    silhouette_sample: int = 2000
    seed: int = 42

    min_cluster_size: int = 20
    cluster_names: dict[int, str] = field(default_factory=lambda: dict(CLUSTER_NAMES))
    top_terms: int = 8
    label_terms: int = 6
