"""Registries of readers, encoders and detectors by lower-cased name."""

from __future__ import annotations

from collections.abc import Callable

from requestlab.operators import kernel_svm  # noqa: F401 - registers its detector
from requestlab.operators.detectors import DETECTORS
from requestlab.operators.encoders import ENCODERS as _ENCODERS
from requestlab.sources import requests


class Registry:
    """Name -> factory; names are compared in lower case, a second registration is an error."""

    def __init__(self, kind: str):
        self.kind, self._items = kind, {}

    def register(self, name: str, item: Callable) -> Callable:
        key = name.lower()
        if key in self._items:
            raise ValueError(f"{self.kind} already registered: {name}")
        self._items[key] = item
        return item

    def get(self, name: str) -> Callable:
        try:
            return self._items[name.lower()]
        except KeyError:
            raise KeyError(f"unknown {self.kind}: {name}; known: {', '.join(sorted(self._items))}") from None

    def names(self) -> list[str]:
        return sorted(self._items)


READERS, ENCODERS, MODELS = Registry("reader"), Registry("encoder"), Registry("detector")
READERS.register("jsonl", requests.read_requests)
READERS.register("csv", requests.read_request_log)
READERS.register("embeddings", requests.read_embeddings)
for _name, _cls in DETECTORS.items():
    MODELS.register(_name, _cls)
for _name, _cls in _ENCODERS.items():
    ENCODERS.register(_name, _cls)
