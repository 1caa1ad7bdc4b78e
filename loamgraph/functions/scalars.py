"""Numbers, places, times and identifiers, Column to Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_METRES = 6_371_000.0
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
NAMESPACES = {
    "foaf": "http://xmlns.com/foaf/0.1/",
    "owl": "http://www.w3.org/2002/07/owl#",
    "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#",
    "rdfs": "http://www.w3.org/2000/01/rdf-schema#",
    "schema": "https://schema.org/",
    "xsd": "http://www.w3.org/2001/XMLSchema#",
}


def parse_number(text: Column) -> Column:
    """DOUBLE of a decimal number with white space around it, else null."""
    clean = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    return F.when(clean.rlike(NUMBER), clean.try_cast("double"))


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres between two places in degrees."""
    rad = lambda x: F.radians(x)
    half = lambda x: F.sin(x / 2) * F.sin(x / 2)
    a = half(rad(lat2) - rad(lat1)) + F.cos(rad(lat1)) * F.cos(rad(lat2)) * half(rad(lon2) - rad(lon1))
    return 2 * F.atan2(F.sqrt(a), F.sqrt(1 - a)) * EARTH_METRES


def recency(updated: Column, created: Column, now: Column, half_life_hours: float = 168.0) -> Column:
    """1 / (1 + age / half-life); a time in the future has age 0, no time at all scores 0."""
    when = F.coalesce(updated, created)
    hours = F.greatest(F.lit(0.0), (now.cast("double") - when.cast("double")) / 3600.0)
    return F.coalesce(1 / (1 + hours / F.lit(half_life_hours if half_life_hours > 0 else 168.0)), F.lit(0.0))


DEFAULT_WEIGHTS = (0.60, 0.25, 0.10, 0.05)


def weighted(semantic: Column, lexical: Column, importance: Column, recent: Column, weights: tuple[float, float, float, float] = (0, 0, 0, 0)) -> Column:
    """Weighted sum; the defaults where all weights are 0."""
    w = weights if any(weights) else DEFAULT_WEIGHTS
    return semantic * w[0] + lexical * w[1] + importance * w[2] + recent * w[3]


def reciprocal_rank(rank: Column, weight: float = 1.0, k: int = 60) -> Column:
    return F.lit(float(weight)) / (F.lit(k) + rank)


def triple_id(s: Column, p: Column, o: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", s, p, o), 256), 1, 16)


def expand_prefix(name: Column) -> Column:
    """A name with a known prefix in full; any other as it is."""
    table = F.create_map(*[F.lit(x) for pair in NAMESPACES.items() for x in pair])
    base = F.try_element_at(table, F.substring_index(name, ":", 1))
    return F.when(name.contains(":") & base.isNotNull(), F.concat(base, F.regexp_replace(name, "^[^:]*:", ""))).otherwise(name)
