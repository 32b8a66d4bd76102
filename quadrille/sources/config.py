"""Configuration: sources, precedence, panel options, providers; and the driver registry."""

from __future__ import annotations

import importlib
import os
from collections.abc import Callable
from dataclasses import dataclass, field
from importlib.metadata import entry_points

import yaml

from ..errors import PanelError
from .base import DataSource
from .builtin import BUILTIN

SOURCES_GROUP, PROVIDERS_GROUP = "quadrille.sources", "quadrille.providers"


@dataclass(frozen=True)
class Spec:
    driver: str
    options: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Config:
    sources: dict[str, Spec]
    precedence: dict[str, list[str]]
    periods: tuple[int, int] | None = None
    strict: bool = False
    pit: str = "auto"
    providers: dict[str, Spec] = field(default_factory=dict)
    path: str | None = None


def _specs(raw: dict | None, code: str) -> dict[str, Spec]:
    out = {}
    for name, body in (raw or {}).items():
        if not isinstance(name, str) or not name.isidentifier():
            raise PanelError(code, f"bad name {name!r}: use letters, digits and underscores")
        body = {"driver": body} if isinstance(body, str) else dict(body or {})
        out[name] = Spec(body.get("driver", name), dict(body.get("options") or {}))
    return out


def config_of(raw: dict, path: str | None = None) -> Config:
    sources = _specs(raw.get("sources"), "E-SOURCE-NAME")
    precedence = {k: [v] if isinstance(v, str) else list(v) for k, v in (raw.get("precedence") or {}).items()}
    if "default" not in precedence:
        raise PanelError("E-CONFIG", "precedence.default is required")
    for chain in precedence.values():
        for name in chain:
            if name not in sources:
                raise PanelError("E-SOURCE-UNKNOWN", f"precedence names undeclared source {name!r}; declared are {sorted(sources)}")
    panel = raw.get("panel") or {}
    periods = panel.get("periods")
    return Config(sources, precedence, tuple(periods) if periods else None, bool(panel.get("strict", False)), panel.get("pit", "auto"), _specs(raw.get("providers"), "E-PROVIDER-NAME"), path)


def read_config(path: str) -> Config:
    with open(path, encoding="utf-8") as f:
        return config_of(yaml.safe_load(f) or {}, os.path.abspath(path))


def resolve(driver: str, group: str, builtin: dict[str, Callable], code: str) -> Callable:
    """A driver by registered name, then built-in name, then dotted path."""
    for e in entry_points(group=group):
        if e.name == driver:
            return e.load()
    if driver in builtin:
        return builtin[driver]
    module, _, name = driver.replace(":", ".").rpartition(".")
    if not module:
        raise PanelError(code, f"unknown driver {driver!r}")
    try:
        return getattr(importlib.import_module(module), name)
    except (ImportError, AttributeError) as e:
        raise PanelError(code, f"cannot load driver {driver!r}: {e}") from e


def source_class(driver: str) -> type[DataSource]:
    return resolve(driver, SOURCES_GROUP, BUILTIN, "E-SOURCE-DRIVER")
