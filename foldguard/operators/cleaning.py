"""Row cleaning with one logged reason per rejected row."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.composition import Site, parse_sites, parsed_column
from ..functions.text import flag_text, numeric_or_null
from ..session import stage

# The reason texts; list problems have theirs in ``functions.composition``.
NOT_NUMERIC = "pce_not_numeric"
OUT_OF_RANGE = "pce_out_of_range"
FLAGGED = "module_record"
TOTAL_NOT_POSITIVE = "coef_total_not_positive"


@dataclass(frozen=True)
class CleaningRules:
    """What a valid row is.  ``lower`` and ``upper`` are themselves valid."""

    target: str
    lower: float
    upper: float
    flag: str | None = None
    sites: Sequence[Site] = field(default_factory=tuple)


def reject_reason(rules: CleaningRules) -> Column:
    """The first rule a row breaks, NULL for a valid row (sites must have been parsed)."""
    value = numeric_or_null(F.col(rules.target))
    sites = [F.col(parsed_column(s)) for s in rules.sites]
    tests = [
        F.when(value.isNull(), F.lit(NOT_NUMERIC)),
        F.when(~value.between(rules.lower, rules.upper), F.lit(OUT_OF_RANGE)),
    ]
    if rules.flag is not None:
        tests.append(F.when(flag_text(F.col(rules.flag)) == 1, F.lit(FLAGGED)))
    tests += [s["problem"] for s in sites]
    tests += [F.when(s["total"] <= 0, F.lit(TOTAL_NOT_POSITIVE)) for s in sites]
    return F.coalesce(*tests)


def tag_rejects(df: DataFrame, rules: CleaningRules, reason_col: str = "reason") -> DataFrame:
    """Append the reason and the parsed sites and cast the target; stateless, so it also runs on a stream."""
    parsed = parse_sites(df, rules.sites) if rules.sites else df
    return parsed.withColumns(
        {reason_col: reject_reason(rules), rules.target: numeric_or_null(F.col(rules.target))}
    )


def clean_rows(
    df: DataFrame, rules: CleaningRules, key: Sequence[str], keep_parsed: bool = False, staged: bool = False
) -> tuple[DataFrame, DataFrame]:
    """The valid rows, and (key, reason) of the others.

    ``keep_parsed`` leaves the parsed sites on the valid rows, for ``add_shares`` to use.
    ``staged`` writes the tagged rows once, for callers that go on with both results.
    """
    tagged = tag_rejects(df, rules)
    if staged:
        tagged = stage(tagged, "tagged")
    clean = tagged.filter(F.col("reason").isNull()).drop("reason")
    if not keep_parsed:
        clean = clean.drop(*[parsed_column(s) for s in rules.sites])
    rejected = tagged.filter(F.col("reason").isNotNull()).select(*key, "reason")
    return clean, rejected


def reason_counts(rejected: DataFrame) -> DataFrame:
    return rejected.groupBy("reason").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "reason")


def threshold_subsets(df: DataFrame, value: str, at_most: Sequence[float], above: Sequence[float]) -> dict:
    """Named row subsets: all rows with a value, those at most x, those above x."""
    column = F.col(value)
    subsets = {"all": df.filter(column.isNotNull())}
    subsets |= {f"le_{x:g}": df.filter(column <= x) for x in at_most}
    subsets |= {f"gt_{x:g}": df.filter(column > x) for x in above}
    return subsets
