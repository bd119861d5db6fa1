"""Settings, errors and logging of a job; all of it on the driver."""

from __future__ import annotations

import json
import logging
import os
from collections.abc import Mapping
from pathlib import Path
from typing import Any


class VeilError(Exception):
    """Base of what this package raises on purpose."""


class ConfigError(VeilError):
    pass


class EngineError(VeilError):
    pass


class FusionError(VeilError):
    pass


class TransformError(VeilError):
    pass


class TokenError(VeilError):
    pass


class DatasetError(VeilError):
    pass


PREFIX = "VEILSPARK__"
DEFAULTS: dict[str, Any] = {
    "fusion": {"mode": "weighted_consensus", "iou": 0.5}, "detect": {"min_confidence": 0.5}, "transform": {"mode": "redact"}, "segment": {"max_tokens": 512, "overlap": 32},
    "router": {"ensemble_threshold": 0.70, "accuracy_threshold": 0.88, "balanced_threshold": 0.80, "segment_tokens": 2000},
}


def coerced(raw: str) -> Any:
    """A setting's text as bool, None, number or JSON, else as it is."""
    word = raw.strip().lower()
    if word in ("true", "false"):
        return word == "true"
    if word in ("null", "none", ""):
        return None
    for kind in (int, float):
        try:
            return kind(raw)
        except ValueError:
            pass
    if raw.strip()[:1] in "[{":
        try:
            return json.loads(raw)
        except ValueError:
            return raw
    return raw


def merged(a: Mapping[str, Any], b: Mapping[str, Any]) -> dict[str, Any]:
    """b over a, at every depth."""
    out = dict(a)
    for k, v in b.items():
        out[k] = merged(out[k], v) if isinstance(v, Mapping) and isinstance(out.get(k), Mapping) else v
    return out


def load(path: str | None = None, environ: Mapping[str, str] | None = None, spark=None) -> dict[str, Any]:
    """Defaults, then a JSON (or, with its package, YAML) file, then spark.veilspark.a.b settings, then VEILSPARK__a__b."""
    found: dict[str, Any] = dict(DEFAULTS)
    if path:
        text = Path(path).read_text(encoding="utf-8")
        if path.endswith((".yaml", ".yml")):
            try:
                import yaml
            except ImportError as e:
                raise ConfigError("YAML settings need the package pyyaml") from e
            made = yaml.safe_load(text)
        else:
            try:
                made = json.loads(text)
            except ValueError as e:
                raise ConfigError(f"{path} isn't JSON") from e
        if not isinstance(made, Mapping):
            raise ConfigError(f"{path} holds no table of settings")
        found = merged(found, made)
    pairs = [(k.removeprefix("spark.veilspark.").split("."), v) for k, v in (spark.sparkContext.getConf().getAll() if spark else []) if k.startswith("spark.veilspark.")]
    pairs += [(k.removeprefix(PREFIX).lower().split("__"), v) for k, v in sorted((os.environ if environ is None else environ).items()) if k.startswith(PREFIX)]
    for keys, raw in pairs:
        value: Any = coerced(raw)
        for key in reversed(keys):
            value = {key: value}
        found = merged(found, value)
    return found


def load_state(path: str, fields: tuple[str, ...], version: str = "1.") -> dict[str, Any] | None:
    """The known fields of a JSON state; None where there is no file."""
    if not Path(path).exists():
        return None
    state = json.loads(Path(path).read_text(encoding="utf-8"))
    if not str(state.get("schema_version", "")).startswith(version):
        raise ConfigError(f"{path} is of another version")
    return {k: state[k] for k in fields if k in state}


def save_state(path: str, state: Mapping[str, Any], version: str = "1.0") -> None:
    """Write JSON beside the old file and then in its place."""
    held = Path(path).with_suffix(".new")
    held.parent.mkdir(parents=True, exist_ok=True)
    held.write_text(json.dumps({"schema_version": version, **state}, ensure_ascii=False, sort_keys=True), encoding="utf-8")
    held.replace(path)


def load_manifest(path: str) -> dict[str, Any]:
    """An expert's manifest: id, name and numeric strengths by type."""
    state = load_state(path, ("expert_id", "name", "strengths", "default"))
    if state is None or not state.get("expert_id") or not isinstance(state.get("strengths"), Mapping):
        raise ConfigError(f"{path} is no expert's manifest")
    if not all(isinstance(v, int | float) and 0 <= v <= 1 for v in state["strengths"].values()):
        raise ConfigError(f"{path}: strengths are numbers from 0 to 1")
    return {"name": state["expert_id"], "default": 0.5, **state}


class _Json(logging.Formatter):
    def format(self, record: logging.LogRecord) -> str:
        return json.dumps({"level": record.levelname, "logger": record.name, "message": record.getMessage(), **getattr(record, "payload", {})}, ensure_ascii=False)


def logger(name: str, level: int = logging.INFO, structured: bool = True) -> logging.Logger:
    """A logger that writes a JSON object a line."""
    out = logging.getLogger(name)
    out.setLevel(level)
    if not out.handlers:
        handler = logging.StreamHandler()
        handler.setFormatter(_Json() if structured else logging.Formatter("%(levelname)s %(name)s %(message)s"))
        out.addHandler(handler)
    return out
