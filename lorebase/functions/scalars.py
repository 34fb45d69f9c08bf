"""Scalar functions that Spark has no built-in for."""

from __future__ import annotations

from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Multipliers of quantity suffixes.
SUFFIXES = {"n": 1e-9, "u": 1e-6, "m": 1e-3, "": 1.0, "k": 1e3, "M": 1e6, "G": 1e9, "T": 1e12, "P": 1e15, "E": 1e18, "Ki": 2.0**10, "Mi": 2.0**20, "Gi": 2.0**30, "Ti": 2.0**40, "Pi": 2.0**50, "Ei": 2.0**60}


def quantity_to_double(quantity: Column) -> Column:
    """500m, 16380048Ki, 1e3 as numbers; null where it isn't a quantity."""
    shape = r"^([+-]?[0-9]*\.?[0-9]+(?:[eE][+-]?[0-9]+)?)([a-zA-Z]*)$"
    by = F.create_map(*(F.lit(x) for kv in SUFFIXES.items() for x in kv))
    return F.regexp_extract(quantity, shape, 1).try_cast("double") * F.try_element_at(by, F.regexp_extract(quantity, shape, 2))


def glob_to_regex(pattern: str) -> str:
    """A shell glob (*, ?, [...]) as an anchored regex. ValueError where a bracket isn't closed."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "[":
            end = pattern.find("]", i + 2)
            if end < 0:
                raise ValueError(f"bracket not closed in {pattern!r}")
            inner = pattern[i + 1 : end]
            inner = "^" + inner[1:] if inner[0] in "!^" else inner
            out += "[" + inner.replace("\\", "\\\\").replace("[", "\\[") + "]"
            i = end + 1
            continue
        out += ".*" if c == "*" else "." if c == "?" else "\\" + c if not c.isalnum() and c not in "_ /" else c
        i += 1
    return f"^{out}$"


def glob_match(value: Column, pattern: str) -> Column:
    return value.rlike(glob_to_regex(pattern))


def fnv1a64_text(text: str) -> str:
    h = 0xCBF29CE484222325
    for b in text.encode():
        h = (h ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return f"{h:x}"


@F.pandas_udf(StringType())
def fnv1a64(text: pd.Series) -> pd.Series:
    """FNV-1a, 64 bits, as hex without padding."""
    return text.map(fnv1a64_text, na_action="ignore")


def readable_size(n: Column) -> Column:
    step = F.least(F.floor(F.log(F.greatest(n.cast("double"), F.lit(1.0))) / F.log(F.lit(1024.0))), F.lit(4)).cast("int")
    return F.concat(F.format_number(n / F.pow(F.lit(1024.0), step), 2), F.lit(" "), F.element_at(F.array(*map(F.lit, ("B", "KiB", "MiB", "GiB", "TiB"))), step + 1))


def clamp(value: int | None, default: int, most: int) -> int:
    """A limit: the default where none or a bad one is asked for, never above most."""
    return min(value, most) if value and value > 0 else default


def moment(df: DataFrame, column: str, value: datetime) -> Column:
    """A point in time as a literal of the column's own type (with or without a time zone)."""
    return F.lit(value.isoformat(sep=" ")).cast(df.schema[column].dataType)
