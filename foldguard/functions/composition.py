"""Parallel delimited lists ("a; b" next to "1; 2") to normalised share columns."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import NUMERIC_TEXT


@dataclass(frozen=True)
class Site:
    """One pair of parallel list columns and the names that get a share column of their own."""

    prefix: str
    names: str
    weights: str
    known: tuple[str, ...]

    @property
    def share_columns(self) -> list[str]:
        return [f"{self.prefix}_{name}" for name in self.known] + [f"{self.prefix}_other"]


def list_items(col: Column, sep: str = ";") -> Column:
    """Split, trim, drop empty items."""
    return F.filter(F.transform(F.split(col.cast("string"), sep), lambda x: F.trim(x)), lambda x: x != "")


def list_weights(col: Column, sep: str = ";") -> Column:
    """The items as doubles, NULL for each one that is not a number."""
    return F.transform(list_items(col, sep), lambda x: F.when(x.rlike(NUMERIC_TEXT), x.try_cast("double")))


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often ``body`` uses it."""
    return F.element_at(F.transform(F.array(value), lambda v: body(v)), 1)


# What can be wrong with a pair of lists, in the order in which it is tested.
LIST_MISSING = "missing_ion_or_coef"
LENGTH_MISMATCH = "ion_coef_count_mismatch"
WEIGHT_NOT_NUMERIC = "coef_not_numeric"


def parsed_site(site: Site) -> Column:
    """``struct<problem, total, pairs: array<struct<name, weight>>>`` of one pair of lists.

    ``problem`` is NULL for usable lists; a bad row can be seen but cannot stop the job.
    """
    names, weights = F.col(site.names), F.col(site.weights)

    def checked(lists: Column) -> Column:
        items, values = lists["items"], lists["values"]
        problem = (
            F.when(names.isNull() | weights.isNull(), F.lit(LIST_MISSING))
            .when((F.size(items) == 0) | (F.size(items) != F.size(values)), F.lit(LENGTH_MISMATCH))
            .when(F.exists(values, lambda w: w.isNull()), F.lit(WEIGHT_NOT_NUMERIC))
        )
        pairs = F.zip_with(items, values, lambda n, w: F.struct(n.alias("name"), w.alias("weight")))
        total = F.aggregate(values, F.lit(0.0), lambda acc, w: acc + w)
        return F.struct(problem.alias("problem"), total.alias("total"), pairs.alias("pairs"))

    return bind(F.struct(list_items(names).alias("items"), list_weights(weights).alias("values")), checked)


def parsed_column(site: Site) -> str:
    return f"_site_{site.prefix}"


def parse_sites(df: DataFrame, sites: Sequence[Site]) -> DataFrame:
    """Append one parsed struct per site.

    They come out of a generator of one row each, which the optimizer neither copies into
    later filters nor repeats per use: every list is parsed exactly once.
    """
    structs = [parsed_site(s).alias(parsed_column(s)) for s in sites]
    return df.select("*", F.inline_outer(F.array(F.struct(*structs))))


def known_share(site: Column, name: str) -> Column:
    """Share of one name; copies of a name in the list add up."""
    share = site["pairs"]
    return F.aggregate(
        share, F.lit(0.0), lambda acc, p: F.when(p["name"] == name, acc + p["weight"] / site["total"]).otherwise(acc)
    )


def other_share(site: Column, known: Sequence[str]) -> Column:
    return F.aggregate(
        site["pairs"], F.lit(0.0),
        lambda acc, p: F.when(p["name"].isin(*known), acc).otherwise(acc + p["weight"] / site["total"]),
    )


def add_shares(df: DataFrame, sites: Sequence[Site]) -> DataFrame:
    """Append the share columns of every site: weights over their total, unknown names in ``_other``.

    Shares are NULL where the lists are unusable or have no positive total.
    """
    if parsed_column(sites[0]) not in df.columns:
        df = parse_sites(df, sites)
    shares: dict[str, Column] = {}
    for s in sites:
        site = F.col(parsed_column(s))
        usable = site["problem"].isNull() & (site["total"] > 0)
        for name in s.known:
            shares[f"{s.prefix}_{name}"] = F.when(usable, known_share(site, name))
        shares[f"{s.prefix}_other"] = F.when(usable, other_share(site, s.known))
    return df.withColumns(shares).drop(*[parsed_column(s) for s in sites])


def composition_label(sites: Mapping[str, Sequence[str]], available: Sequence[str], floor: float = 0.01) -> Column:
    """Readable label such as ``FA0.80MA0.20 / Pb1.00 / -`` from share columns above ``floor``."""
    parts = []
    for prefix, names in sites.items():
        shown = [
            F.when(
                F.col(f"{prefix}_{n}") > floor,
                F.concat(F.lit(n), F.format_string("%.2f", F.bround(f"{prefix}_{n}", 2))),
            )
            for n in names
            if f"{prefix}_{n}" in available
        ]
        text = F.concat_ws("", *shown) if shown else F.lit("")
        parts.append(F.when(text == "", F.lit("-")).otherwise(text))
    return F.concat_ws(" / ", *parts)
