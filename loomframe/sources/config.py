"""Configuration with a closed set of keys."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field, fields
from pathlib import Path


class ConfigError(ValueError):
    """A key is unknown or missing, or a value is out of range."""


@dataclass(frozen=True)
class Motion:
    max_abs_dx: float = 400.0
    max_abs_dy: float = 16.0
    consistency_abs: float = 8.0
    consistency_rel: float = 0.2
    consistency_window: int = 15
    consistency_min_history: int = 5
    hold_frames: int = 5
    tau_r_min_pairs: int = 1000
    tau_r_steps: int = 100
    oracle_halfwidth: int = 15
    oracle_min_values: int = 5


@dataclass(frozen=True)
class Windows:
    k_initial: int = 10
    k_stopped: int = 25
    k_min: int = 3
    k_max: int = 25
    span_px: float = 800.0
    median_window: int = 15
    reliable_for_k: int = 5


@dataclass(frozen=True)
class Events:
    merge_gap: int = 2
    duration_cap: int = 25
    grace_max: int = 24


@dataclass(frozen=True)
class Bootstrap:
    replicates: int = 2000
    block_length: int = 1200
    phase_bin: int = 50
    ci_low_pct: float = 2.5
    ci_high_pct: float = 97.5
    seed: int = 20260924


@dataclass(frozen=True)
class Chance:
    n_shifts: int = 200
    collapse_k: int = 10
    seed_base: int = 20260925


@dataclass(frozen=True)
class Config:
    motion: Motion = field(default_factory=Motion)
    windows: Windows = field(default_factory=Windows)
    events: Events = field(default_factory=Events)
    bootstrap: Bootstrap = field(default_factory=Bootstrap)
    chance: Chance = field(default_factory=Chance)


def parse(data: dict) -> Config:
    """A configuration from nested maps; every key must be known and present."""
    kinds = {"motion": Motion, "windows": Windows, "events": Events, "bootstrap": Bootstrap, "chance": Chance}
    if set(data) != set(kinds):
        raise ConfigError(f"sections must be {sorted(kinds)}")
    parts = {}
    for name, kind in kinds.items():
        known = {f.name for f in fields(kind)}
        if set(data[name]) != known:
            raise ConfigError(f"{name}: unknown {sorted(set(data[name]) - known)}, missing {sorted(known - set(data[name]))}")
        parts[name] = kind(**data[name])
    return Config(**parts)


def load(path: str) -> tuple[Config, str]:
    """The configuration of a YAML file and the file's SHA-256."""
    import yaml

    content = Path(path).read_bytes()
    return parse(yaml.safe_load(content)), hashlib.sha256(content).hexdigest()
