"""Cleaning of names, as column expressions and for column names."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_markers_names(c: Column) -> Column:
    """``/ : - .`` become ``_``."""
    return F.translate(c.cast("string"), "/:-.", "____")


def clean_ind_names(c: Column) -> Column:
    """``_`` and ``:`` become ``-``; white space and commas go."""
    return F.regexp_replace(F.translate(c.cast("string"), "_:", "--"), r"[\s,]", "")


def clean_pop_names(c: Column) -> Column:
    """White space becomes ``_``."""
    return F.regexp_replace(c.cast("string"), r"\s", "_")


def replace_by_na(c: Column, what: str = ".") -> Column:
    return F.nullif(c, F.lit(what))


def snake_upper(name: str) -> str:
    """UPPER_SNAKE_CASE of a column name."""
    s = re.sub(r"[^0-9A-Za-z]+", "_", name.strip())
    s = re.sub(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", "_", s)
    return re.sub(r"_+", "_", s).strip("_").upper()


def clean_ind(name: str) -> str:
    """``clean_ind_names`` of one name."""
    return re.sub(r"[\s,]", "", name.translate(str.maketrans("_:", "--")))
