"""Declared schemas, parameters and the session's settings."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, replace
from typing import Any

from pyspark.sql import SparkSession

EPOCH_LOG = "run string, epoch int, loss double, mean_pos_dist double, mean_neg_dist double, triplets_mined long, recall map<int,double>"
HEAD_WEIGHTS = "run string, tag string, layer string, row int, values array<double>"


@dataclass(frozen=True)
class EngineConfig:
    """Parameters of training and evaluation; ``from_mapping`` takes nested sections."""

    dataset_path: str = ""
    test_size: float = 0.3
    val_size: float = 0.2
    classes_per_batch: int = 16
    items_per_class: int = 4
    hidden_dim: int = 512
    output_dim: int = 128
    normalize: bool = True
    dropout: float = 0.0
    epochs: int = 10
    lr: float = 1e-4
    weight_decay: float = 1e-4
    margin: float = 0.2
    recall_k: tuple[int, ...] = (1, 3)
    seed: int = 42
    extra: dict[str, Any] = field(default_factory=dict)

    @classmethod
    def from_mapping(cls, tree: dict) -> EngineConfig:
        names = {"P": "classes_per_batch", "K": "items_per_class"}
        known, found, extra = {f.name for f in fields(cls)}, {}, {}

        def walk(node: dict) -> None:
            for key, value in node.items():
                if isinstance(value, dict):
                    walk(value)
                elif (name := names.get(key, key)) in known:
                    found[name] = tuple(value) if name == "recall_k" else value
                else:
                    extra[key] = value

        walk(tree)
        return replace(cls(), **found, extra=extra)


def session(name: str = "lodestar", **conf: str) -> SparkSession:
    """A session with the settings that the library relies on: UTC, ANSI, adaptive execution, Arrow."""
    builder = SparkSession.builder.appName(name)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in (defaults | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
