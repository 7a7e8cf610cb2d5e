"""Settings: defaults, a file's values over them, and the environment's over those."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field, fields, is_dataclass
from typing import Any

from paperloom.operators import chunking, retrieval
from paperloom.operators.evaluation import K_VALUES


# Names and defaults of the settings file's entries that something reads.
@dataclass
class Chunking:
    min_tokens: int = chunking.MIN_TOKENS
    max_tokens: int = chunking.MAX_TOKENS
    overlap_tokens: int = chunking.OVERLAP_TOKENS
    semantic_split_threshold: float = chunking.BREAK_THRESHOLD
    include_references: bool = False
    include_captions: bool = True


@dataclass
class Retrieval:
    score_threshold: float = retrieval.THRESHOLD
    min_dip_rate: float = retrieval.MIN_DIP
    min_k: int = retrieval.MIN_K
    max_k: int = retrieval.MAX_K
    bm25_weight: float = 0.35
    dense_weight: float = 0.45

    def weights(self) -> dict[str, float]:
        """Fusion weights: texts and questions share the dense one 6 to 4."""
        return {"dense": 0.6 * self.dense_weight, "hyde": 0.4 * self.dense_weight, "bm25": self.bm25_weight}

    def cutoff(self) -> dict:
        return {"max_k": self.max_k, "min_k": self.min_k, "threshold": self.score_threshold, "min_dip": self.min_dip_rate}


@dataclass
class Settings:
    pdf_dir: str = "./pdfs"
    output_dir: str = "./output"
    target_tokens: int = 400
    k_values: tuple = K_VALUES
    chunking: Chunking = field(default_factory=Chunking)
    retrieval: Retrieval = field(default_factory=Retrieval)


def _apply(target: Any, values: dict) -> None:
    """Known keys are set, unknown ones passed over."""
    known = {f.name for f in fields(target)}
    for key, value in (values or {}).items():
        if key in known:
            now = getattr(target, key)
            _apply(now, value) if is_dataclass(now) and isinstance(value, dict) else setattr(target, key, value)


def load(path: str | None = None) -> Settings:
    """Settings from a JSON file, or a YAML file where a reader is installed."""
    settings = Settings()
    if path and os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            raw = f.read()
        try:
            values = json.loads(raw)
        except ValueError:
            import yaml

            values = yaml.safe_load(raw)
        _apply(settings, values)
    for name in ("pdf_dir", "output_dir"):
        if value := os.environ.get(name.upper()):
            setattr(settings, name, value)
    return settings
