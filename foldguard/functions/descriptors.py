"""Ratio descriptors from share columns and a table of reference values."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Published effective ionic radii in Angstrom.
SITE_RADII = {
    "A": {"FA": 2.53, "MA": 2.17, "Cs": 1.88, "Rb": 1.72, "K": 1.64},
    "B": {"Pb": 1.19, "Sn": 1.10, "Ge": 0.73},
    "X": {"I": 2.20, "Br": 1.96, "Cl": 1.81},
}


def _total(terms: Sequence[Column]) -> Column:
    out = terms[0]
    for term in terms[1:]:
        out = out + term
    return out


def weighted_reference(prefix: str, values: Mapping[str, float], available: Sequence[str]) -> Column:
    """Share-weighted mean of the reference values over the known names; NULL if none occurs."""
    names = [n for n in values if f"{prefix}_{n}" in available]
    if not names:
        return F.lit(None).cast("double")
    share = {n: F.when(F.col(f"{prefix}_{n}") > 0, F.col(f"{prefix}_{n}")).otherwise(0.0) for n in names}
    return F.try_divide(_total([share[n] * values[n] for n in names]), _total([share[n] for n in names]))


def tolerance_factor(a: Column, b: Column, x: Column) -> Column:
    return F.try_divide(a + x, F.sqrt(F.lit(2.0)) * (b + x))


def octahedral_factor(b: Column, x: Column) -> Column:
    return F.try_divide(b, x)


def tau_factor(a: Column, b: Column, x: Column, oxidation: float = 1.0) -> Column:
    """NULL where ``a = b``, for which the logarithm is zero."""
    ratio = F.try_divide(a, b)
    n = F.lit(float(oxidation))
    return F.try_divide(x, b) - n * (n - F.try_divide(ratio, F.ln(ratio)))
