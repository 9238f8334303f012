"""Scores of evidence and the weakest link."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The score of each origin of evidence.
SCORES = {
    "exif": 0.95,
    "gps": 0.95,
    "geocoding_offline": 0.85,
    "geocoding_externo": 0.75,
    "pasta": 0.60,
    "vizinhanca_temporal": 0.75,
    "vizinhanca": 0.55,
    "album_externo": 0.55,
    "curadoria": 0.55,
    "agrupamento": 0.70,
    "llm": 0.55,
    "lexico": 0.58,
    "arquivo": 0.70,
    "nome_arquivo": 0.65,
    "fs": 0.40,
    "visao": 0.30,
    "usuario": 1.00,
}
HIGH, MEDIUM = 0.8, 0.5
LEVELS = ("low", "medium", "high")


def score_of(origin: Column) -> Column:
    return F.element_at(F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in SCORES.items())), origin)


def level_of(score: Column) -> Column:
    return F.when(score >= HIGH, "high").when(score >= MEDIUM, "medium").otherwise("low")


def weakest(scores: Column) -> Column:
    """The least of an array of scores, 0 of none."""
    return F.coalesce(F.array_min(scores), F.lit(0.0))


def level_rank(level: Column) -> Column:
    return F.when(level == "low", 0).when(level == "medium", 1).when(level == "high", 2)
