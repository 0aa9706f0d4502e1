"""Predicates put together at run time."""

from __future__ import annotations

import re
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Where:
    """Conditions that all must hold; each may be negated. Without conditions everything passes."""

    def __init__(self):
        self.conditions: list[Column] = []

    def add(self, condition: Column, negate: bool = False) -> Where:
        self.conditions.append(~condition if negate else condition)
        return self

    def option(self, value, make, negate: bool = False) -> Where:
        """Adds make(value) if a value is given."""
        return self if value is None else self.add(make(value), negate)

    def apply(self, df: DataFrame) -> DataFrame:
        return df.where(reduce(and_, self.conditions)) if self.conditions else df


def tagged(column: str, tag: str) -> Column:
    """A condition on a comma-separated list; a tag with a leading minus must be absent."""
    has = F.array_contains(F.split(F.coalesce(F.col(column), F.lit("")), ","), tag.removeprefix("-"))
    return ~has if tag.startswith("-") else has


def any_like(column: str, titles: list[str], suffixes: list[str] = ()) -> Column:
    """Whether a column starts with any of some titles, with or without an article, or ends with any of some suffixes; % and _ in these stand for themselves."""

    def escaped(t: str) -> str:
        return re.sub(r"([\\%_])", r"\\\1", t)

    patterns = [f"{article}{escaped(t)}%" for t in titles for article in ("", "The ")] + [f"%{escaped(t)}" for t in suffixes]
    out = F.lit(False)
    for p in patterns:
        out = out | F.col(column).like(p)
    return out


def oversized(size: Column, width: Column, height: Column, kind: Column, bits: Column, channels: Column) -> Column:
    """Files with many more bytes than their pixels need, which may hold something else: over ten megabytes beyond three bytes a pixel for jpeg and xcf; for png over a tenth more than raw pixels and ten megabytes."""
    spare = 10 * 1024 * 1024
    pixels = width.cast("bigint") * height
    return F.coalesce(F.when(kind.isin("jpeg", "x-xcf"), size > 3 * pixels + spare).when(kind == "png", size > 1.10 * (spare + pixels * bits / 8 * channels)), F.lit(False))
