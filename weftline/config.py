"""Settings in layers of priority, with typed reads; read only once frozen."""

from __future__ import annotations

import configparser
import importlib
import json
import os
import sys
from collections.abc import Iterator, Mapping
from typing import Any

LAYERS = {"default": 0, "command": 10, "project": 20, "spider": 30, "cmdline": 40}
DEFAULTS = {
    "CONCURRENT_REQUESTS": 16, "CONCURRENT_REQUESTS_PER_DOMAIN": 8, "DEPTH_LIMIT": 0, "DEPTH_PRIORITY": 0, "DOWNLOAD_DELAY": 0, "DOWNLOAD_TIMEOUT": 180, "RETRY_TIMES": 2, "RETRY_PRIORITY_ADJUST": -1,
    "URLLENGTH_LIMIT": 2083, "VISIBILITY_TIMEOUT": 600, "SAVE_CACHE_NUM": 500, "SAVE_CACHE_INTERVAL": 10, "REDIRECT_ENABLED": True,
}


def project_file(start: str = ".", name: str = "weftline.cfg") -> str | None:
    """The nearest project file, from a folder upwards."""
    folder = os.path.abspath(start)
    while True:
        path = os.path.join(folder, name)
        if os.path.isfile(path):
            return path
        above = os.path.dirname(folder)
        if above == folder:
            return None
        folder = above


def project_settings(start: str = ".", project: str = "default", variable: str = "WEFTLINE_SETTINGS") -> dict[str, Any]:
    """The upper-case names of the project's settings module, which the variable or the project file names; empty without either."""
    module = os.environ.get(variable)
    path = project_file(start)
    if module is None and path is not None:
        parser = configparser.ConfigParser()
        parser.read(path)
        module = parser.get("settings", project, fallback=None)
    if module is None:
        return {}
    if path is not None and os.path.dirname(path) not in sys.path:
        sys.path.insert(0, os.path.dirname(path))
    return {k: v for k, v in vars(importlib.import_module(module)).items() if k.isupper()}


class Settings(Mapping):
    """A later write wins if its layer is at least as high as that of the value that is there."""

    def __init__(self, values: Mapping[str, Any] | None = None, layer: str = "project", environment: str = "WEFTLINE_"):
        self._values: dict[str, tuple[Any, int]] = {k: (v, 0) for k, v in DEFAULTS.items()}
        self._frozen = False
        self.update(values or {}, layer)
        self.update({k.removeprefix(environment): v for k, v in os.environ.items() if k.startswith(environment)}, "command")

    def set(self, name: str, value: Any, layer: str | int = "project") -> None:
        if self._frozen:
            raise TypeError("settings are frozen")
        weight = LAYERS[layer] if isinstance(layer, str) else layer
        if name not in self._values or weight >= self._values[name][1]:
            self._values[name] = (value, weight)

    def update(self, values: Mapping[str, Any], layer: str | int = "project") -> None:
        for k, v in values.items():
            self.set(k, v, layer)

    def freeze(self) -> Settings:
        self._frozen = True
        return self

    def layer(self, name: str) -> int | None:
        return self._values[name][1] if name in self._values else None

    def __getitem__(self, name: str) -> Any:
        return self._values[name][0] if name in self._values else None

    def __iter__(self) -> Iterator[str]:
        return iter(self._values)

    def __len__(self) -> int:
        return len(self._values)

    def _read(self, name: str, default: Any) -> Any:
        value = self[name]
        return default if value is None else value

    def getbool(self, name: str, default: bool = False) -> bool:
        value = self._read(name, default)
        if isinstance(value, str):
            low = value.strip().lower()
            if low not in ("1", "true", "0", "false", ""):
                raise ValueError(f"not a boolean: {value!r}")
            return low in ("1", "true")
        return bool(int(value))

    def getint(self, name: str, default: int = 0) -> int:
        return int(self._read(name, default))

    def getfloat(self, name: str, default: float = 0.0) -> float:
        return float(self._read(name, default))

    def getlist(self, name: str, default: list | None = None) -> list:
        value = self._read(name, default or [])
        return value.split(",") if isinstance(value, str) else list(value)

    def getdict(self, name: str, default: dict | None = None) -> dict:
        value = self._read(name, default or {})
        return json.loads(value) if isinstance(value, str) else dict(value)
