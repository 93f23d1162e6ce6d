"""Recipes: the definition from which a dataset can be made again, and its hash."""

from __future__ import annotations

import hashlib
import json
from pathlib import Path
from typing import Any

from pyspark.sql import functions as F

from almanack.operators.dataset import Dataset
from almanack.plans.vocabulary import read_table

# The keys that decide which data a recipe stands for, with their defaults; they are what is hashed.
DEFINITION: dict[str, Any] = {"geographies": [], "series": [], "start_year": None, "end_year": None, "frequency": "annual", "output_shape": "wide", "preferred_sources": [], "transformations": [], "recipe_version": "1.0"}


class Recipe:
    """A definition, in normal form, and notes (name, request, outputs, titles) that change nothing in the data.

    In normal form lists without order are sorted, series are (provider, code, alias), and the first
    step, building the dataset, is left out of the transformations.
    """

    def __init__(self, name: str, notes: dict | None = None, **definition: Any) -> None:
        if unknown := sorted(set(definition) - set(DEFINITION)):
            raise ValueError(f"not part of a definition: {unknown}")
        made = DEFINITION | definition
        self.notes = {"name": name} | (notes or {})
        self.definition = made | {
            "geographies": sorted(made["geographies"]),
            "preferred_sources": sorted(made["preferred_sources"]),
            "series": sorted([s["provider"], s["series_id"], s["alias"]] if isinstance(s, dict) else list(s) for s in made["series"]),
            "transformations": [{k: t.get(k) for k in ("operation", "parameters")} for t in made["transformations"] if t.get("operation") != "build_dataset"],
        }

    @classmethod
    def of(cls, dataset: Dataset, name: str, notes: dict | None = None, **definition: Any) -> Recipe:
        """The recipe of a dataset: its series, places, steps and shape, read from it (a row a series and a place)."""
        series = [[r.provider, r.series_id, r.alias] for r in dataset.variables.select("provider", "series_id", "alias").collect()]
        places = [r[0] for r in dataset.observations.select(F.coalesce(F.nullif("iso3", F.lit("")), "geography")).distinct().collect()]
        return cls(name, notes, **({"series": series, "geographies": places, "output_shape": dataset.shape, "transformations": list(dataset.transformations)} | definition))

    def hash(self) -> str:
        """The first 16 hex digits of the definition's SHA-256, as compact JSON with sorted keys."""
        text = json.dumps(self.definition, sort_keys=True, separators=(",", ":"), default=str)
        return hashlib.sha256(text.encode()).hexdigest()[:16]

    def text(self) -> str:
        """Definition, notes and hash as JSON, which is YAML too."""
        return json.dumps({"definition": self.definition, "notes": self.notes, "recipe_hash": self.hash()}, indent=2, ensure_ascii=False)

    def save(self, path: str) -> None:
        Path(path).write_text(self.text(), encoding="utf-8")

    @classmethod
    def load(cls, path: str) -> Recipe:
        """From JSON, or from YAML where a library for it is installed; a hash that does not fit is an error."""
        raw = read_table(path)
        notes = dict(raw.get("notes", {}))
        made = cls(notes.pop("name", ""), notes, **raw["definition"])
        if raw.get("recipe_hash") not in (None, made.hash()):
            raise ValueError("the recipe's hash does not fit its definition")
        return made

    def problems(self) -> list[str]:
        """Why the recipe cannot be built; empty when it can."""
        d = self.definition
        names = [s[2] for s in d["series"]]
        found = {"no series": not d["series"], "no geographies": not d["geographies"], "start after end": bool(d["start_year"] and d["end_year"] and d["start_year"] > d["end_year"])}
        return [what for what, wrong in found.items() if wrong] + [f"alias used twice: {n}" for n in sorted({n for n in names if names.count(n) > 1})]


def cache_key(provider: str, parameters: dict) -> str:
    """A key for results of equal parameters, whatever their order."""
    return hashlib.md5(json.dumps({"provider": provider, "params": parameters}, sort_keys=True, default=str).encode()).hexdigest()
