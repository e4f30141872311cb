"""Column-list helpers: names only, no job."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_UNSAFE = re.compile(r"[^0-9A-Za-z_]")  # fixed value: everything else becomes "_"


def safe_name(name: str) -> str:
    return _UNSAFE.sub("_", name)


def safe_names(names: Sequence[str]) -> list[str]:
    """Sanitised names; two columns that would become one are an error."""
    out = [safe_name(n) for n in names]
    twice = sorted({n for n in out if out.count(n) > 1})
    if twice:
        raise ValueError(f"columns collide after renaming: {twice}")
    return out


def with_safe_names(df: DataFrame) -> DataFrame:
    return df.toDF(*safe_names(df.columns))


def family(columns: Iterable[str], prefixes: Sequence[str] = ("A", "B", "X")) -> list[str]:
    """Columns whose first underscore-separated part is one of the prefixes."""
    return [c for c in columns if c.split("_")[0] in prefixes]


def starting_with(columns: Iterable[str], prefixes: Sequence[str]) -> list[str]:
    return [c for c in columns if c.startswith(tuple(prefixes))]


def feature_scopes(features: Sequence[str], families: Mapping[str, Callable[[str], bool]]) -> dict[str, list[str]]:
    """Nested column sets: each scope has the columns of the scope before and, of those left, the ones of its own family."""
    scopes: dict[str, list[str]] = {}
    held: list[str] = []
    for scope, belongs in families.items():
        held = held + [c for c in features if belongs(c) and c not in held]
        scopes[scope] = held
    return scopes


def fill_constants(df: DataFrame, fills: Mapping[str, object]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in fills.items()})


def ordered_unique(names: Iterable[str]) -> list[str]:
    return list(dict.fromkeys(names))
