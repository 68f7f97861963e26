"""Weights from a file, and the folders of a project."""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path

from ..functions.scores import normalize_weights


def load_weights(path: str) -> dict[str, float]:
    """Weights by name that sum to 1, from a YAML file of names and numbers, under ``weights:`` or bare."""
    found = {}
    for line in Path(path).read_text(encoding="utf-8").splitlines():
        name, sep, value = line.split("#")[0].partition(":")
        if sep and value.strip():
            found[name.strip().strip("\"'")] = float(value)
        elif name.strip() not in ("", "weights"):
            raise ValueError(f"not a weight: {line!r}")
    return normalize_weights(found)


@dataclass(frozen=True)
class Paths:
    """The folders of a project, all below ``root``; a URI of shared storage will do."""

    root: str

    def at(self, *parts: str) -> str:
        return "/".join((self.root.rstrip("/"), *parts))

    @property
    def raw(self) -> str:
        return self.at("datasets", "raw")

    @property
    def generated(self) -> str:
        return self.at("datasets", "generated")

    @property
    def results(self) -> str:
        return self.at("datasets", "results")

    @property
    def labelled(self) -> str:
        return self.at("data", "labelled")

    @property
    def reports(self) -> str:
        return self.at("reports")
