"""Named transforms and losses of window tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from inspect import signature

from pyspark.sql import DataFrame

from seriata.operators import features


@dataclass(frozen=True)
class Plugin:
    """kind is transform (changes the windows) or loss (a figure per window)."""

    name: str
    kind: str
    apply: Callable[..., DataFrame]


def _identity(df: DataFrame) -> DataFrame:
    return df


def _root_loss(df: DataFrame, key: list[str], alpha: float = 0.5) -> DataFrame:
    return features.frequency_loss(df, key, alpha, root_h=True)


_PLUGINS = {p.name: p for p in (Plugin("none", "transform", _identity), Plugin("revin", "transform", features.revin), Plugin("san_lite", "transform", features.slice_statistics), Plugin("fredf", "loss", features.frequency_loss), Plugin("fredf_sqrth", "loss", _root_loss))}


def available(kind: str | None = None) -> list[str]:
    return sorted(n for n, p in _PLUGINS.items() if kind in (None, p.kind))


def kind_of(name: str) -> str:
    return plugin(name).kind


def plugin(name: str) -> Plugin:
    if name not in _PLUGINS:
        raise KeyError(f"no plugin {name!r}; there are {available()}")
    return _PLUGINS[name]


def register(p: Plugin) -> None:
    if p.name in _PLUGINS:
        raise ValueError(f"plugin {p.name!r} exists")
    _PLUGINS[p.name] = p


def wrap(df: DataFrame, name: str, **options) -> DataFrame:
    """Apply a plugin; an option that it does not know is an error, never dropped."""
    p = plugin(name)
    unknown = set(options) - set(signature(p.apply).parameters)
    if unknown:
        raise TypeError(f"{name} does not take {sorted(unknown)}")
    return p.apply(df, **options)
