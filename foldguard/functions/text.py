"""Numbers, flags and keys out of free text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and tokens that decide what counts as a number, a null or a key prefix.
NUMERIC_TEXT = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
NUMBER_IN_TEXT = r"(\d+\.?\d*)"
KEY_URL_PREFIX = r"^(https?://)?(dx\.)?doi\.org/"
KEY_SCHEME_PREFIX = r"^doi:\s*"
NULL_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


def numeric_or_null(col: Column) -> Column:
    """Lenient cast to double: bad text, nan and infinities become NULL, never an error."""
    text = F.trim(col.cast("string"))
    return F.when(text.rlike(NUMERIC_TEXT), text.try_cast("double"))


def max_number(col: Column) -> Column:
    """Largest unsigned number that occurs in a text; NULL where there is none."""
    found = F.regexp_extract_all(col.cast("string"), F.lit(NUMBER_IN_TEXT), F.lit(1))
    return F.array_max(F.transform(found, lambda x: x.try_cast("double")))


def flag_text(col: Column) -> Column:
    """Boolean text to 0/1; NULL and anything but 'true' (in any case) is 0."""
    return F.coalesce((F.lower(col.cast("string")) == "true").cast("int"), F.lit(0))


def null_tokens_to_null(col: Column, tokens: Sequence[str] = NULL_TOKENS) -> Column:
    return F.when(~F.trim(col).isin(*tokens), col)


def strip_space(col: Column) -> Column:
    """Strip surrounding white space and a leading byte order mark."""
    return F.regexp_replace(F.regexp_replace(col, r"^\s*\x{FEFF}*\s*", ""), r"\s+$", "")


def normalize_key(
    col: Column, url_prefix: str = KEY_URL_PREFIX, scheme_prefix: str = KEY_SCHEME_PREFIX
) -> Column:
    """One spelling per key: trimmed, lower case, without address prefix and end marks."""
    bare = F.lower(strip_space(col))
    bare = F.regexp_replace(bare, url_prefix, "")
    bare = F.regexp_replace(bare, scheme_prefix, "")
    return F.regexp_replace(bare, r"[/.]+$", "")


def key_or_sentinel(col: Column, sentinel: str = "unknown") -> Column:
    """Group key with all NULLs in one named group, so that they stay together."""
    return F.coalesce(col.cast("string"), F.lit(sentinel))


def keyword_hits(col: Column, keywords: Sequence[str]) -> Column:
    """The keywords that occur in the lower-cased text, in the given order."""
    text = F.lower(col)
    words = F.array(*[F.lit(k) for k in keywords])
    return F.filter(words, lambda word: text.contains(word))


def substring_count(col: Column, needle: str) -> Column:
    """Non-overlapping occurrences of a literal in the lower-cased text."""
    text = F.lower(col)
    freed = F.length(F.replace(text, F.lit(needle), F.lit("")))
    return ((F.length(text) - freed) / F.lit(len(needle))).cast("int")


def composite_key(*cols: Column, sep: str = "|") -> Column:
    return F.concat_ws(sep, *cols)


def strip_prefix(col: Column, prefix: str) -> Column:
    return F.when(F.startswith(col, F.lit(prefix)), F.substring(col, len(prefix) + 1, 1 << 30)).otherwise(col)
