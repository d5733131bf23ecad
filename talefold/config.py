"""Engine settings: one frozen record, where only None means "use the default"."""

from __future__ import annotations

import copy
import json
import os
from dataclasses import dataclass, fields, replace
from pathlib import Path


@dataclass(frozen=True)
class EngineConfig:
    """What the operators take as defaults. Paths are folders that all executors share."""

    collection_path: str = "data/collections"
    collection: str = "stories"
    embed_model: str = "hashing-64"
    rerank_model: str | None = None
    max_chars: int = 1800
    overlap_chars: int = 200
    least_words: int = 20
    n_stories: int = 3
    chunks_per_story: int = 2
    pool_base: int = 20
    k_boost: float = 1.0
    bm25: bool = True
    bm25_weight: float = 0.3
    rrf_k: int = 60
    accept_score: float = 7.0
    min_faithfulness: float = 6.0
    min_facts: int = 3
    max_iterations: int = 3
    min_words: int = 250
    min_sentences: int = 3
    gate_truncate: bool = False
    gate_threshold: int = 8
    fast_max_tokens: int = 768
    thinking_max_tokens: int | None = None
    fast_temperature: float = 0.4
    thinking_temperature: float | None = None
    fast_top_p: float = 0.8
    thinking_top_p: float | None = None
    upsert_groups: int = 1

    def with_values(self, **values) -> "EngineConfig":
        return replace(self, **{k: v for k, v in values.items() if v is not None})


def resolve_path(argument: str | None = None, root: str = ".") -> Path | None:
    """The settings file: TALEFOLD_CONFIG, else the argument, else setup.json, else setup.example.json under root."""
    for name in (os.environ.get("TALEFOLD_CONFIG"), argument, f"{root}/setup.json", f"{root}/setup.example.json"):
        if name and Path(name).is_file():
            return Path(name)
    return None


def load(argument: str | None = None, root: str = ".") -> EngineConfig:
    path = resolve_path(argument, root)
    raw = json.loads(path.read_text("utf-8")) if path else {}
    known = {f.name for f in fields(EngineConfig)}
    values = {k: copy.deepcopy(v) for k, v in raw.items() if k in known and v is not None}
    if values.get("collection_path", "").startswith("${BASE}"):
        values["collection_path"] = values["collection_path"].replace("${BASE}", str(Path(root).resolve()), 1)
    return EngineConfig(**values)


def pool_size(base: int, n: int, c: int, boost: float = 1.0) -> int:
    """How many candidates a search takes before fusion and selection."""
    return round(max(base, n * max(1, c) * 4) * max(1.0, boost))


def generation_settings(cfg: EngineConfig, mode: str | None = None, max_tokens: int | None = None) -> tuple[int, float, float]:
    """Token budget, temperature and top-p of a mode; what thinking leaves open is that of fast."""
    slow = (mode or "").strip().lower() in ("thinking", "think", "slow", "medium")

    def of(thinking, fast):
        return (thinking or fast) if slow else fast

    return (
        max_tokens if max_tokens is not None else of(cfg.thinking_max_tokens, cfg.fast_max_tokens),
        of(cfg.thinking_temperature, cfg.fast_temperature),
        of(cfg.thinking_top_p, cfg.fast_top_p),
    )


def backoff(attempts: int = 6, first: float = 2.0) -> list[float]:
    """Seconds to wait after each failed attempt of a model call."""
    return [first * 2**k for k in range(attempts)]


STEPS = ("fetch", "extract", "prepare", "enrich", "reset", "ingest")


def check_steps(steps: list[str]) -> list[str]:
    unknown = [s for s in steps if s not in STEPS]
    if unknown:
        raise ValueError(f"unknown step: {', '.join(unknown)}; known: {', '.join(STEPS)}")
    return steps
