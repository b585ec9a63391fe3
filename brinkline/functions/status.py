"""Pass rates from a status field that is a list, a string or anything else."""

from __future__ import annotations

import ast

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def passes(item: Column) -> Column:
    return F.coalesce(F.contains(F.lower(item), F.lit("pass")), F.lit(False))


def list_pass_rate(items: Column) -> Column:
    """Share of the items of an ``array<string>`` that hold "pass"; others count in the denominator."""
    n = F.size(items)
    return F.when(items.isNotNull() & (n > 0), F.size(F.filter(items, passes)) / n).otherwise(0.0)


def literal_pass_rate(text: str | None) -> float:
    """The rule for strings: a Python literal if it is one, else a substring test; 0 for none."""
    if not text:
        return 0.0
    try:
        value = ast.literal_eval(text)
    except (ValueError, SyntaxError, MemoryError, RecursionError):
        return float("pass" in text.lower())
    if not isinstance(value, list) or not value:
        return 0.0
    return sum(isinstance(x, str) and "pass" in x.lower() for x in value) / len(value)


#: A string literal without prefix, with escapes that stand for no letter; possessive, so long ones do not recurse.
ITEM = r"(?:'[^'\\\n\r\x00]*+(?:\\['\"\\nrt][^'\\\n\r\x00]*+)*+'|\"[^\"\\\n\r\x00]*+(?:\\['\"\\nrt][^\"\\\n\r\x00]*+)*+\")"
LIST = rf"\A[ \t]*+\[\s*+(?:{ITEM}\s*+(?:,\s*+{ITEM}\s*+)*+(?:,\s*+)?+)?+\][ \t\n]*+\z".replace(r"\s", r"[ \t\n]")
ESCAPED = r"\\['\"\\nrt]"
WORDS = r"\A[A-Za-z_ ]*+\z"


def plain_pass_rate(text: Column) -> Column:
    """The rule for strings by built-in functions where they can tell: lists of plain string literals, and
    words alone, which are no list whatever they stand for; null else, and 0 for null.

    No escape that is taken here stands for a letter, so they are blanked before the test.
    """
    items = F.regexp_extract_all(text, F.lit(ITEM), F.lit(0))
    listed = F.transform(items, lambda x: F.regexp_replace(x, ESCAPED, " "))
    return F.when(text.isNull(), 0.0).when(text.rlike(LIST), list_pass_rate(listed)).when(text.rlike(WORDS), passes(text).cast("double"))


def string_pass_rate(text: Column | str) -> Column:
    """The rule for strings; only what :func:`plain_pass_rate` leaves open goes to Python."""
    text = F.col(text) if isinstance(text, str) else text
    plain = plain_pass_rate(text)
    return F.coalesce(plain, _literal_rates(F.when(plain.isNull(), text)))


def _literal_rates(text: Column) -> Column:
    def rate(values: pd.Series) -> pd.Series:
        return values.map(lambda x: literal_pass_rate(x if isinstance(x, str) else None)).astype("float64")

    rate.__annotations__ = {"values": pd.Series, "return": pd.Series}
    return F.pandas_udf(rate, "double")(text)


def variant_list_rate(status: Column) -> Column:
    items = F.try_variant_get(status, "$", "array<variant>")
    is_pass = lambda x: (F.schema_of_variant(x) == "STRING") & passes(F.try_variant_get(x, "$", "string"))
    return F.when(items.isNotNull() & (F.size(items) > 0), F.size(F.filter(items, is_pass)) / F.size(items))


def variant_pass_rate(status: Column, mode: str = "extract", stored: Column | None = None) -> Column:
    """Pass rate of a ``VARIANT`` status.

    ``extract``: lists by share, strings by the literal rule, all else 0.
    ``load``: a stored rate if there is one, else lists only.
    ``figure``: lists only, whatever is stored.
    """
    listed = variant_list_rate(status)
    if mode == "extract":
        text = F.when(F.schema_of_variant(status) == "STRING", F.try_variant_get(status, "$", "string"))
        return F.coalesce(listed, string_pass_rate(text))
    if mode == "load" and stored is not None:
        return F.coalesce(stored, listed, F.lit(0.0))
    if mode in ("load", "figure"):
        return F.coalesce(listed, F.lit(0.0))
    raise ValueError(f"unknown mode {mode!r}")


def success(rate: Column, at: float = 0.8) -> Column:
    return (rate >= at).cast("int")
