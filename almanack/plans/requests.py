"""Requests: from a sentence in Arabic, English or French to a typed specification, and on to a dataset."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cache

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from almanack.functions.text import detect_language, fold, smart_alias
from almanack.operators.dataset import Dataset, alias_numbers, union_all
from almanack.operators.validate import validate, verdict
from almanack.plans.vocabulary import LANGUAGES, Vocabulary
from almanack.schema import VARIABLES
from almanack.sources.readers import fetch_all


@dataclass(frozen=True)
class Spec:
    text: str
    language: str
    concepts: tuple[str, ...] = ()
    geographies: tuple[str, ...] = ()
    start: int | None = None
    end: int | None = None
    frequency: str = "annual"
    providers: tuple[str, ...] = ()
    shape: str = "wide"
    formats: tuple[str, ...] = ()
    ambiguous: tuple[str, ...] = field(default=())


def consume(text: str, names: dict[str, str]) -> list[str]:
    """Targets whose names stand in the text, in the order of their places. The longest name wins and
    blanks its place, so a part of it cannot match again."""
    left, found = f" {text} ", []
    for name in sorted(names, key=lambda n: (-len(n.split()), -len(n), n)):
        at = left.find(f" {name} ")
        while name and at >= 0:
            found.append((at, names[name]))
            left = left[: at + 1] + "\u0000" * len(name) + left[at + 1 + len(name) :]
            at = left.find(f" {name} ")
    return list(dict.fromkeys(target for _, target in sorted(found)))


class Names:
    """Names and their targets with an automaton over all of them, which each process makes once."""

    def __init__(self, names: dict[str, str]) -> None:
        self.names = names
        self.found: ahocorasick.Automaton | None = None

    def __getstate__(self) -> dict:
        return {"names": self.names, "found": None}

    def present(self, text: str) -> dict[str, str]:
        """The names that stand in a text, at any place; the time depends on the text and not on how many names there are."""
        if self.found is None:
            self.found = ahocorasick.Automaton()
            for n in filter(None, self.names):
                self.found.add_word(f" {n} ", n)
            self.found.make_automaton()
        return {n: self.names[n] for _, n in self.found.iter(f" {text} ")} if len(self.found) else {}

    def consume(self, text: str) -> list[str]:
        """As ``consume`` over all names: those that are not in the text change nothing."""
        return consume(text, self.present(text))


def mentions(text: Column, names: dict[str, str]) -> Column:
    """``consume`` for a column of texts: ``array<string>``. ``names`` is a vocabulary, sent to every task once."""
    every = SparkSession.active().sparkContext.broadcast(Names(names))

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def find(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else every.value.consume(t))

    return find(text)


def folded(texts: list[str], language: str) -> list[str]:
    """The search form of some texts (a request, a vocabulary), by the same expression as for columns."""
    rows = SparkSession.active().createDataFrame(list(enumerate(texts)), "n int, t string")
    return [r.t for r in rows.select("n", fold(F.col("t"), F.lit(language)).alias("t")).orderBy("n").collect()]


@cache
def _names(vocabulary: Vocabulary, language: str) -> dict[str, dict[str, str]]:
    """For each table of a vocabulary, what its names fold to in a language, and their keys."""
    tables = {
        "concepts": [(n, k) for k, by_language in vocabulary.concepts.items() for names in by_language for n in names],
        "places": [(n, k) for k, names in vocabulary.countries.items() for n in names] + [(n, f"*{k}") for k, (names, _) in vocabulary.regions.items() for n in names],
        "shape": [(n, "long") for n in vocabulary.long_shape],
    } | {t: [(n, k) for k, names in getattr(vocabulary, t).items() for n in names] for t in ("frequencies", "providers", "formats")}
    every = sorted({n for rows in tables.values() for n, _ in rows})
    plain = dict(zip(every, folded(every, language), strict=True)) if every else {}
    return {t: {plain[n]: k for n, k in reversed(rows) if plain[n]} for t, rows in tables.items()}


#: What follows a number of years back, in folded texts.
_LAST = r"\b(?:last|past|dernieres?|derniers?|derniere?|اخر)\s+(\d{1,3})\s*(?:years?|ans?|annees?|سنوات|سنه)\b"
_FOUND = "concepts array<string>, places array<string>, frequency string, providers array<string>, long boolean, formats array<string>"


def parse_requests(rows: DataFrame, vocabulary: Vocabulary, text: str = "text", current_year: int | None = None) -> DataFrame:
    """All columns, and what each request asks for: language, concepts, geographies (codes; regions stand as their members),
    start, end, frequency, providers, shape, formats, and which of the concepts are ambiguous.

    Nothing is guessed: what is not named stays empty. Of several frequencies named, the one with the
    longest name counts. A null text is an empty one.
    """
    tables = {g: {t: Names(n) for t, n in _names(vocabulary, g).items()} for g in LANGUAGES}
    sent = rows.sparkSession.sparkContext.broadcast((tables, {k: m for k, (_, m) in vocabulary.regions.items()}))

    @F.pandas_udf(_FOUND)
    def find(plain: pd.Series, language: pd.Series) -> pd.DataFrame:
        every, regions = sent.value
        out = []
        for t, g in zip(plain, language, strict=True):
            got = {k: names.consume(t) for k, names in every[g].items()}
            places = [m for p in got["places"] for m in (regions[p[1:]] if p.startswith("*") else (p,))]
            hint = max(every[g]["frequencies"].present(t).items(), key=lambda x: (len(x[0]), x[0]), default=("", "annual"))[1]
            out.append((got["concepts"], list(dict.fromkeys(places)), hint, got["providers"], bool(got["shape"]), got["formats"] or ["xlsx"]))
        return pd.DataFrame(out, columns=[c.split()[0] for c in _FOUND.split(", ")])

    said = F.coalesce(F.col(text), F.lit(""))
    language = detect_language(said)
    named = F.array_sort(F.array_distinct(F.regexp_extract_all(said, F.lit(r"\b((?:19|20)\d{2})\b"), 1).cast("array<int>")))
    out = rows.withColumn("_l", language).withColumn("_p", fold(said, F.col("_l"))).withColumn("_f", find("_p", "_l")).withColumn("_y", named)
    back = F.nullif(F.regexp_extract("_p", _LAST, 1), F.lit("")).cast("int")
    ago = F.when((F.size("_y") == 0) & F.lit(current_year is not None), F.lit(current_year) - back + 1)
    return out.select(
        *(F.col(f"`{c}`") for c in rows.columns),
        F.col("_l").alias("language"),
        F.col("_f.concepts").alias("concepts"),
        F.col("_f.places").alias("geographies"),
        F.coalesce(F.get("_y", F.lit(0)), ago).alias("start"),
        F.when(F.size("_y") > 1, F.element_at("_y", -1)).when(ago.isNotNull(), F.lit(current_year)).alias("end"),
        F.col("_f.frequency").alias("frequency"),
        F.col("_f.providers").alias("providers"),
        F.when(F.col("_f.long"), "long").otherwise("wide").alias("shape"),
        F.col("_f.formats").alias("formats"),
        F.filter("_f.concepts", lambda c: c.isin(vocabulary.ambiguous)).alias("ambiguous"),
    )


def parse(text: str, vocabulary: Vocabulary, current_year: int | None = None) -> Spec:
    """What one sentence asks for (see ``parse_requests``)."""
    row = parse_requests(SparkSession.active().createDataFrame([(text,)], "text string"), vocabulary, "text", current_year).first()
    return Spec(text, row.language, tuple(row.concepts), tuple(row.geographies), row.start, row.end, row.frequency, tuple(row.providers), row["shape"], tuple(row.formats), tuple(row.ambiguous))


def concepts(words: Vocabulary) -> DataFrame:
    """(key, language, name, place) of every name of every concept."""
    rows = [(k, g, n, i) for k, by_language in words.concepts.items() for g, names in zip(LANGUAGES, by_language, strict=False) for i, n in enumerate(names)]
    return SparkSession.active().createDataFrame(rows, "key string, language string, name string, place int")


def geographies(words: Vocabulary) -> DataFrame:
    """(code, kind, names, members): countries, which are their own members, and regions."""
    rows = [(k, "country", list(names), [k]) for k, names in words.countries.items()] + [(k, "region", list(names), list(members)) for k, (names, members) in words.regions.items()]
    return SparkSession.active().createDataFrame(rows, "code string, kind string, names array<string>, members array<string>")


def top_count(text: str) -> int:
    """How many ranks a text asks for: its number (1 to 100), 1 for a superlative, else 10."""
    m = re.search(r"\b(?:top|bottom|first|last)\s+(\d{1,4})\b|\b(\d{1,4})\s+(?:highest|lowest|largest|smallest|best|worst)\b", text.lower())
    if m:
        return min(max(int(m[1] or m[2]), 1), 100)
    return 1 if re.search(r"\b(?:highest|lowest|largest|smallest|best|worst|biggest)\b", text.lower()) else 10


def target_year(text: str) -> int | None:
    found = re.findall(r"\b((?:19|20)\d{2})\b", text)
    return max(map(int, found)) if found else None


def default_window(provider: Column, today: Column) -> Column:
    """``struct<first, last>`` as texts: ten years of trade, thirty days of crypto; nothing elsewhere."""
    day, year = today.cast("date"), F.year(today.cast("date"))
    window = lambda first, last: F.struct(first.cast("string").alias("first"), last.cast("string").alias("last"))
    return F.when(provider == "comtrade", window(year - 10, year)).when(provider == "coingecko", window(F.date_sub(day, 30), day)).otherwise(window(F.lit(None), F.lit(None)))


def fallback_order(primary: Column, related: dict[str, list[str]], covers: Column) -> Column:
    """Providers to try after the primary one: its relatives, once each, that are among ``covers`` (``array<string>``)."""
    names = F.create_map(*(x for k, v in related.items() for x in (F.lit(k), F.array(*map(F.lit, v)).cast("array<string>")))) if related else F.lit(None).cast("map<string,array<string>>")
    tried = F.coalesce(F.try_element_at(names, primary), F.array().cast("array<string>"))
    return F.filter(F.array_distinct(tried), lambda p: (p != primary) & F.array_contains(covers, p))


def choose_provider(offers: list[dict], countries: Column) -> Column:
    """The provider of the best of a few offers {provider, confidence, scope, countries} for an array of countries; null if none fits.

    An offer must cover every country. Coverage adds to the confidence: .10 for a country list, .06 for the
    EU, .08 for a world-wide one when no country was named, -.08 for a single country then. The first wins ties.
    """
    asked = F.coalesce(countries, F.array().cast("array<string>"))
    scores = []
    for i, o in enumerate(offers):
        bonus = {"list": 0.10, "eu": 0.06}.get(o["scope"], 0.0)
        alone = {"global": 0.08, "single": -0.08}.get(o["scope"], bonus)
        score = F.when(F.size(asked) == 0, o["confidence"] + alone).otherwise(o["confidence"] + bonus)
        inside = F.lit(True) if o["scope"] == "global" else F.size(F.array_except(asked, F.array(*map(F.lit, o.get("countries", ()))).cast("array<string>"))) == 0
        scores.append(F.when(inside, F.struct(score.alias("score"), F.lit(-i).alias("place"), F.lit(o["provider"]).alias("provider"))))
    return F.array_max(F.array(*scores))["provider"] if scores else F.lit(None).cast("string")


def build(parts: list[tuple[dict, DataFrame]], spec: Spec | None = None) -> Dataset:
    """A dataset of resolved series: (metadata, observations) in order."""
    spark = parts[0][1].sparkSession
    rows = [(m["provider"], m["series_id"], m["title"], m.get("unit"), m.get("frequency"), m.get("concept"), m.get("coverage_end"), i) for i, (m, _) in enumerate(parts)]
    raw = spark.createDataFrame(rows, "provider string, series_id string, title string, unit string, frequency string, concept string, coverage_end string, ordinal int")
    alias = smart_alias(F.col("title"), F.col("series_id"), F.col("unit"), F.col("concept"))
    made = alias_numbers(raw.select(alias.alias("alias"), *raw.columns)).orderBy("ordinal").collect()  # one row a series of the request
    variables = spark.createDataFrame(made, VARIABLES)
    names = [r.alias for r in made]
    return Dataset(union_all([o for _, o in parts]), variables, tuple(names), spec.shape if spec else "wide", ({"operation": "build_dataset", "parameters": {"series": names}},))


def from_selection(selection: list[dict], fetch: Callable[[dict, Spec], DataFrame], geographies: list[str], start: int | None = None, end: int | None = None, frequency: str = "annual", shape: str = "wide") -> dict:
    """A dataset of series that a user picked from the catalogue: {provider, series_id, title, ...}.

    Each is fetched and run on its own; failures are reported, and nothing takes their place.
    """
    if not selection:
        raise ValueError("no series selected")
    spec = Spec("", "en", (), tuple(geographies), start, end, frequency, shape=shape)
    rows, log = fetch_all([(f"{s['provider']}:{s['series_id']}", lambda s=s: _windowed(fetch(s, spec), spec)) for s in selection], apart=True)
    parts = [(s, df) for s, df in zip(selection, rows, strict=True) if df is not None]
    failures = [{"series": x["source"], "error": x["error"]} for x in log if not x["ok"]]
    return _finish(parts, spec, failures)


def _windowed(rows: DataFrame, spec: Spec) -> DataFrame:
    from almanack.operators.derive import in_years

    return in_years(rows, "period", spec.start, spec.end) if spec.start or spec.end else rows


def _finish(parts: list[tuple[dict, DataFrame]], spec: Spec, failures: list[dict]) -> dict:
    if not parts:
        return {"spec": spec, "dataset": None, "failures": failures, "warning": "no series"}
    made = build(parts, spec).stored()
    issues = validate(made.observations, made.variables, spec.frequency, spec.end)
    return {"spec": spec, "dataset": made, "issues": issues, "verdict": verdict(issues), "failures": failures, "warning": None}


def instant(text: str, resolve: Callable[[str, Spec], list[dict]], fetch: Callable[[dict, Spec], DataFrame], vocabulary: Vocabulary, current_year: int | None = None) -> dict:
    """Sentence to dataset: parse, resolve each concept, fetch the first series that works, build, validate.

    ``resolve`` ranks series for a concept; ``fetch`` gives a series' observations or raises. Each is run
    by a small action of its own, so errors in its data are its own too. What could not be had is
    reported under ``failures`` and never made up.
    """
    spec = parse(text, vocabulary, current_year)
    if not spec.concepts or not spec.geographies:
        return {"spec": spec, "dataset": None, "failures": [], "warning": "no concept" if not spec.concepts else "no geography"}
    parts, failures = [], []
    for concept in spec.concepts:
        for series in resolve(concept, spec):
            (rows,), (log,) = fetch_all([(series.get("series_id"), lambda s=series: fetch(s, spec))], apart=True)
            if log["ok"]:
                parts.append((series | {"concept": concept}, rows))
                break
            failures.append({"concept": concept, "series": log["source"], "error": log["error"]})
    return _finish(parts, spec, failures)
