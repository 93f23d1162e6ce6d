"""Names that requests use, as data: a vocabulary is read from JSON or YAML, or made from tables, and passed as a parameter.

None is built in: which concepts, countries and regions there are is the caller's to say.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LANGUAGES = ("en", "fr", "ar")


@dataclass(frozen=True, eq=False)
class Vocabulary:
    """``concepts``: names by language; ``regions``: names and members; all others: names by key."""

    concepts: dict[str, list[list[str]]]
    countries: dict[str, list[str]]
    regions: dict[str, tuple[list[str], list[str]]]
    frequencies: dict[str, list[str]]
    providers: dict[str, list[str]]
    formats: dict[str, list[str]]
    long_shape: list[str]
    ambiguous: list[str]


def read_table(path: str) -> dict:
    """A mapping from JSON or, where a YAML library is installed, from YAML."""
    text = Path(path).read_text(encoding="utf-8")
    if path.endswith(".json"):
        return json.loads(text)
    try:
        import yaml
    except ModuleNotFoundError as e:
        raise RuntimeError("reading YAML needs a YAML library; JSON does not") from e
    return yaml.safe_load(text)


def load(path: str) -> Vocabulary:
    """A vocabulary from a file; tables that it lacks are empty.

    Concepts are ``{key: [[english], [french], [arabic]]}`` or ``{key: {en: [...], fr: [...], ar: [...]}}``.
    """
    raw = read_table(path)
    concepts = {k: ([v.get(g, []) for g in LANGUAGES] if isinstance(v, dict) else v) for k, v in raw.get("concepts", {}).items()}
    named = {n: raw.get(n, {}) for n in ("countries", "regions", "frequencies", "providers", "formats")}
    return Vocabulary(concepts, **named, long_shape=raw.get("long_shape", []), ambiguous=raw.get("ambiguous", []))


def from_tables(concepts: DataFrame, countries: DataFrame, regions: DataFrame, **other) -> Vocabulary:
    """A vocabulary from tables ``concepts(key, language, name)``, ``countries(code, name)`` and ``regions(code, name, member)``.

    Names stand in the order of the texts; vocabularies are collected, as each request is read against all of one.
    ``other`` holds the remaining fields.
    """
    named, places, areas = {}, {}, {}
    for r in concepts.distinct().orderBy("key", "language", "name").collect():
        named.setdefault(r.key, [[], [], []])[LANGUAGES.index(r.language)].append(r.name)
    for r in countries.distinct().orderBy("code", "name").collect():
        places.setdefault(r.code, []).append(r.name)
    for r in regions.groupBy("code").agg(F.array_sort(F.collect_set("name")).alias("names"), F.array_sort(F.collect_set("member")).alias("members")).orderBy("code").collect():
        areas[r.code] = (r.names, r.members)
    rest = {"frequencies": {}, "providers": {}, "formats": {}, "long_shape": [], "ambiguous": []} | other
    return Vocabulary(named, places, areas, **rest)
