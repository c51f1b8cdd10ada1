"""Options of an installation, from YAML where a parser is installed, else from JSON."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields
from pathlib import Path

from .functions import fixed


@dataclass(frozen=True)
class Detection:
    chunk_size: int = 900
    chunk_overlap: int = 150
    timeout_s: float = 300.0
    zero_shot_model: str | None = None
    prompted_model: str | None = None
    residue: dict[str, str] = field(default_factory=lambda: dict(fixed.POLICY))


@dataclass(frozen=True)
class Runtime:
    root: str = "/memory"
    allow_real_documents: bool = False


@dataclass(frozen=True)
class Config:
    runtime: Runtime = field(default_factory=Runtime)
    detection: Detection = field(default_factory=Detection)


def _section(kind, given: dict | None):
    """An unknown option is an error, lest a misspelt one be ignored."""
    given = given or {}
    if unknown := set(given) - {f.name for f in fields(kind)}:
        raise ValueError(f"unknown options: {', '.join(sorted(unknown))}")
    return kind(**given)


def validated(data: dict | None) -> Config:
    data = data or {}
    if unknown := set(data) - {"runtime", "detection"}:
        raise ValueError(f"unknown sections: {', '.join(sorted(unknown))}")
    return Config(_section(Runtime, data.get("runtime")), _section(Detection, data.get("detection")))


def load(path: str) -> Config:
    text = Path(path).read_text(encoding="utf-8")
    try:
        import yaml
    except ImportError:
        return validated(json.loads(text))
    return validated(yaml.safe_load(text))
