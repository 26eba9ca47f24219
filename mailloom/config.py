"""Settings of the engine; strict_reference keeps the original system's quirks where a docstring names one."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class EngineConfig:
    strict_reference: bool = False
    seed: int = 42
    # deduplication
    duplicate_similarity: float = 0.95
    # features
    neighbours: int = 10
    after_hours: tuple[int, int] = (8, 17)
    text_length: int = 2000
    # splits
    test_share: float = 0.2
    folds: int = 4
    # weak labels
    semantic_threshold: float = 0.6
    label_threshold: float = 0.5
    label_epochs: int = 500
    label_trials: int = 10
    # lexicons
    lexicon_neighbours: int = 100
    lexicon_similarity: float = 0.7
    phrase_diversity: float = 0.3
    phrases: int = 5
    # classifier
    inverse_regularisation: float = 1.0
    iterations: int = 1000
    tolerance: float = 1e-4
    # monitoring
    label_drift: float = 0.15
    topic_drift: float = 0.20
    confidence_drift: float = 0.15
    uncertainty: float = 0.40
    review_confidence: float = 0.65
    review_topic: float = 0.2
    min_samples: int = 100
    review_items: int = 50

    @classmethod
    def load(cls, spark: SparkSession | None = None, **given: object) -> EngineConfig:
        """Settings given, else of the session (mailloom.<name>), else of the environment (MAILLOOM_<NAME>), else the defaults.

        Texts are read as the setting's own type; a text that isn't one raises ValueError.
        """
        out = dict(given)
        for f in fields(cls):
            said = spark.conf.get(f"mailloom.{f.name}", None) if spark else None
            said = os.environ.get(f"MAILLOOM_{f.name.upper()}") if said is None else said
            if f.name not in out and said is not None:
                out[f.name] = _read(said, f.default)
        return cls(**out)


def _read(said: str, default: object) -> object:
    if isinstance(default, bool):
        if said.strip().lower() not in ("true", "false", "1", "0"):
            raise ValueError(f"neither true nor false: {said!r}")
        return said.strip().lower() in ("true", "1")
    if isinstance(default, tuple):
        return tuple(type(default[0])(x) for x in said.split(","))
    return type(default)(said)
