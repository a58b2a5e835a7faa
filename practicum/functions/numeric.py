"""Scalar functions: column expressions for Spark and small parsing rules."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def sigmoid(z: Column) -> Column:
    """Logistic function without overflow on either side."""
    return F.when(z >= 0, 1 / (1 + F.exp(-z))).otherwise(F.exp(z) / (1 + F.exp(z)))


def log_loss(z: Column, y: Column) -> Column:
    """Negative log likelihood of one response given its linear predictor."""
    return F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z))) - y * z


def strip_lower(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"^\s+|\s+$", ""))


_SEED = re.compile(r"(-?\d+)(?::(-?\d+))?")


def parse_seeds(spec: str | None) -> list[int] | None:
    """Numbers and half-open ranges ``lo:hi``, parted by commas or blanks; None where nothing is named."""
    seeds: list[int] = []
    for word in re.split(r"[,\s]+", spec or ""):
        if not word:
            continue
        if not (m := _SEED.fullmatch(word)):
            raise ValueError(f"{word!r} is neither a seed nor a range of seeds")
        seeds.extend([int(m[1])] if m[2] is None else range(int(m[1]), int(m[2])))
    return seeds or None


def file_name(name: str) -> str:
    return name.replace("/", "_")
