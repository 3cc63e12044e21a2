"""Types from text: one aggregate decides for all columns, one projection casts them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates
from ..functions.text import parse_currency, rename_columns, to_number
from ..functions.validate import strip
from .profile import missing, ref, text_columns, tidy

# Fixed values.
TRUE, FALSE = ["true", "yes", "1", "t", "y"], ["false", "no", "0", "f", "n"]


def to_boolean(c: Column) -> Column:
    low = F.lower(strip(c))
    return F.when(low.isin(TRUE), True).when(low.isin(FALSE), False)


def percent(c: Column) -> Column:
    return to_number(F.regexp_replace(strip(c), r"\s*%$", "")) / 100


def decide(df: DataFrame, columns: list[str] | None = None, guided: bool = False) -> dict[str, str]:
    """column -> timestamp (over half of all rows parse), bigint or double (over 90 %),
    boolean (over 80 %, two values at most), or with guided, percentage and currency (over
    70 % of values). Others stay text."""
    cols = text_columns(df, columns)
    rows = F.count(F.lit(1))
    out = {}
    for c in cols:
        v = strip(ref(c))
        number = to_number(v)
        out[c] = {
            "rows": rows, "n": F.count(v), "date": F.count(dates.parse(v)), "number": F.count(number), "fraction": F.count_if(number % 1 != 0), "bool": F.count(to_boolean(v)),
            "kinds": F.approx_count_distinct(v), "pct": F.count_if(v.rlike(r"^\d+[.\d]*\s?%$")), "money": F.count_if(v.rlike(r"^\(?[$€£¥₹]\s?\d+[\d,.]*\)?$")),
        }
    decided = {}
    for r in tidy(df, out).collect() if out else []:
        if guided and r.n and r.pct > 0.7 * r.n:
            decided[r.column_name] = "percentage"
        elif guided and r.n and r.money > 0.7 * r.n:
            decided[r.column_name] = "currency"
        elif r.date > 0.5 * r.rows:
            decided[r.column_name] = "timestamp"
        elif r.number > 0.9 * r.rows:
            decided[r.column_name] = "double" if r.fraction else "bigint"
        elif r.kinds <= 2 and r.bool > 0.8 * r.rows:
            decided[r.column_name] = "boolean"
    return decided


CASTS = {"timestamp": dates.parse, "double": to_number, "bigint": lambda c: to_number(c).cast("long"), "boolean": to_boolean, "percentage": percent, "currency": parse_currency}


def cast_columns(df: DataFrame, decided: dict[str, str]) -> DataFrame:
    return df.select(*[CASTS[decided[c]](ref(c)).alias(c) if c in decided else ref(c) for c in df.columns])


def auto_cast(df: DataFrame, columns: list[str] | None = None, guided: bool = False) -> DataFrame:
    return cast_columns(df, decide(df, columns, guided))


def empty_to_null(df: DataFrame) -> DataFrame:
    texts = text_columns(df)
    return df.select(*[(F.when(~missing(df, c) & (ref(c) != ""), ref(c)) if c in texts else F.when(~missing(df, c), ref(c))).alias(c) for c in df.columns])


def prepare(df: DataFrame, standardize: bool = True, cast: bool = True, handle_nulls: bool = True) -> DataFrame:
    out = auto_cast(df) if cast else df
    out = rename_columns(out) if standardize else out
    return empty_to_null(out) if handle_nulls else out
