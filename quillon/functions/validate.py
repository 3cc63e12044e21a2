"""Predicates and fixes for single values, as Column expressions.

Every predicate trims white space first and gives false, never null, for a null.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
EMAIL = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
EMAIL_DOMAIN_FIXES = {
    "gmial.com": "gmail.com",
    "gmai.com": "gmail.com",
    "gmil.com": "gmail.com",
    "yahooo.com": "yahoo.com",
    "yaho.com": "yahoo.com",
    "hotmial.com": "hotmail.com",
    "hotmai.com": "hotmail.com",
    "outlok.com": "outlook.com",
}
US_PHONE = r"^(?:\+?1[-.\s]?)?\(?([0-9]{3})\)?[-.\s]?([0-9]{3})[-.\s]?([0-9]{4})$"
INTERNATIONAL_PHONE = r"^\+[1-9]\d{6,14}$"
US_ZIP = r"^\d{5}(-\d{4})?$"
POSTAL_CODES = {
    "US": r"^\d{5}(?:-\d{4})?$",
    "UK": r"^[A-Z]{1,2}\d[A-Z\d]?\s?\d[A-Z]{2}$",
    "CA": r"^[A-Z]\d[A-Z]\s?\d[A-Z]\d$",
}
URL = r"^https?://(?:(?:[A-Z0-9](?:[A-Z0-9-]{0,61}[A-Z0-9])?\.)+[A-Z]{2,6}\.?|localhost|\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})(?::\d+)?(?:/?|[/?]\S+)$"
IPV4 = r"^(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)$"
SSN = r"^\d{3}-?\d{2}-?\d{4}$"
CARD_TYPES = {"visa": r"^4", "mastercard": r"^5[1-5]", "amex": r"^3[47]", "discover": r"^6(?:011|5)"}


def strip(c: Column) -> Column:
    """Without white space at either end (trim() takes off blanks alone)."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def digits(c: Column) -> Column:
    return F.regexp_replace(c, r"\D", "")


def matches(c: Column, pattern: str) -> Column:
    return F.coalesce(strip(c).rlike(pattern), F.lit(False))


def valid_email(c: Column) -> Column:
    return matches(c, EMAIL)


def fix_email(c: Column, fix_common_typos: bool = True) -> Column:
    """Trimmed, in lower case, and with known misspelt domains put right."""
    low = F.lower(strip(c))
    if not fix_common_typos:
        return low
    fixes = F.create_map(*[F.lit(x) for pair in EMAIL_DOMAIN_FIXES.items() for x in pair])
    at = F.regexp_extract(low, r"@([^@]*)$", 1)  # behind the last @
    return F.when(fixes[at].isNotNull(), F.concat(F.regexp_extract(low, r"^(.*@)[^@]*$", 1), fixes[at])).otherwise(low)


def valid_us_phone(c: Column) -> Column:
    return matches(c, US_PHONE)


def format_us_phone(c: Column, style: str = "dash") -> Column:
    """Ten digits, or eleven that begin with 1, in one style; others as they are."""
    styles = {"dash": "%s-%s-%s", "dot": "%s.%s.%s", "paren": "(%s) %s-%s", "plain": "%s%s%s"}
    if style not in styles:
        raise ValueError(f"style is one of {list(styles)}")
    d = digits(c)
    ten = F.when((F.length(d) == 11) & d.startswith("1"), F.substring(d, 2, 10)).otherwise(d)
    parts = [F.substring(ten, 1, 3), F.substring(ten, 4, 3), F.substring(ten, 7, 4)]
    return F.when(F.length(ten) == 10, F.format_string(styles[style], *parts)).otherwise(c)


def valid_international_phone(c: Column) -> Column:
    return matches(F.regexp_replace(c, r"[-.\s()]", ""), INTERNATIONAL_PHONE)


def valid_us_zip(c: Column) -> Column:
    return matches(c, US_ZIP)


def format_us_zip(c: Column, include_plus4: bool = False) -> Column:
    d = digits(c)
    five, nine = F.substring(d, 1, 5), F.concat(F.substring(d, 1, 5), F.lit("-"), F.substring(d, 6, 4))
    return F.when(F.length(d) == 5, d).when(F.length(d) == 9, nine if include_plus4 else five).otherwise(c)


def valid_postal_code(c: Column, country: str = "US") -> Column:
    if country not in POSTAL_CODES:
        raise ValueError(f"country is one of {list(POSTAL_CODES)}")
    return matches(F.upper(c), POSTAL_CODES[country])


def valid_url(c: Column) -> Column:
    return matches(c, "(?i)" + URL)


def fix_url(c: Column) -> Column:
    """With http:// before it if it names no scheme."""
    s = strip(c)
    return F.when(s.rlike(r"^https?://"), s).otherwise(F.concat(F.lit("http://"), s))


def valid_ipv4(c: Column) -> Column:
    return matches(c, IPV4)


def valid_credit_card(c: Column) -> Column:
    d = F.regexp_replace(c, r"[\s-]", "")
    return F.coalesce(d.rlike(r"^\d{13,19}$") & F.call_function("luhn_check", d), F.lit(False))


def credit_card_type(c: Column) -> Column:
    """By the first digits alone; null for other text and other issuers."""
    d = F.regexp_replace(strip(c), r"[\s-]", "")
    known = reduce(lambda acc, kv: acc.when(d.rlike(kv[1]), kv[0]), CARD_TYPES.items(), F.when(~d.rlike(r"^\d+$"), None))
    return known.otherwise(None)


def valid_ssn(c: Column) -> Column:
    d = digits(c)
    area = F.substring(d, 1, 3)
    never = area.isin("000", "666") | d.startswith("9") | (F.substring(d, 4, 2) == "00") | (F.substring(d, 6, 4) == "0000")
    return matches(c, SSN) & F.coalesce(~never, F.lit(False))


def mask_ssn(c: Column) -> Column:
    d = digits(c)
    return F.when(F.length(d) == 9, F.concat(F.lit("XXX-XX-"), F.substring(d, 6, 4))).otherwise(c)


def regex_rule(pattern: str, ignore_case: bool = False):
    """A validator: the value begins with a match."""
    return lambda c: F.coalesce(c.rlike(("(?i)" if ignore_case else "") + f"^(?:{pattern})"), F.lit(False))


def range_rule(least: float | None = None, most: float | None = None, inclusive: bool = True):
    def rule(c: Column) -> Column:
        x = c.try_cast("double")
        ok = x.isNotNull() & ~F.isnan(x)
        if least is not None:
            ok &= (x >= least) if inclusive else (x > least)
        if most is not None:
            ok &= (x <= most) if inclusive else (x < most)
        return F.coalesce(ok, F.lit(False))

    return rule


def length_rule(least: int | None = None, most: int | None = None):
    def rule(c: Column) -> Column:
        n, ok = F.length(c), c.isNotNull()
        if least is not None:
            ok &= n >= least
        if most is not None:
            ok &= n <= most
        return F.coalesce(ok, F.lit(False))

    return rule


def enum_rule(values: Iterable, case_sensitive: bool = True):
    kept = list(values)
    if case_sensitive:
        return lambda c: F.coalesce(c.isin(kept), F.lit(False))
    low = [v.lower() for v in kept]
    return lambda c: F.coalesce(F.lower(c).isin(low), F.lit(False))


def all_of(*rules):
    return lambda c: reduce(lambda a, b: a & b, [r(c) for r in rules])


def summarise(df: DataFrame, column: str, rule) -> DataFrame:
    """One row: valid, invalid, total, valid_pct."""
    ok = rule(F.col(column))
    n = F.count(F.lit(1))
    return df.agg(F.count_if(ok).alias("valid"), F.count_if(~ok).alias("invalid"), n.alias("total"), F.when(n > 0, F.count_if(ok) * 100.0 / n).otherwise(0.0).alias("valid_pct"))


def invalid_rows(df: DataFrame, column: str, rule) -> DataFrame:
    return df.filter(~rule(F.col(column)))


def out_of_range(df: DataFrame, column: str, least: float | None = None, most: float | None = None) -> DataFrame:
    """below and above: how many values lie outside; nulls count as neither."""
    c, none = F.col(column), F.lit(0).cast("long")
    return df.agg((F.count_if(c < least) if least is not None else none).alias("below"), (F.count_if(c > most) if most is not None else none).alias("above"))


def with_flag(df: DataFrame, column: str, rule, name: str | None = None) -> DataFrame:
    """df with a boolean column, {column}_valid unless named."""
    return df.withColumn(name or f"{column}_valid", rule(F.col(column)))


def custom_rule(function):
    """A validator from a Python function of one value, run in batches as a Pandas UDF;
    prefer Column predicates, which stay in the JVM."""
    import pandas as pd
    from pyspark.sql.types import BooleanType

    def batch(values: pd.Series) -> pd.Series:
        return values.map(lambda v: bool(function(v)))

    batch.__annotations__ = {"values": pd.Series, "return": pd.Series}
    return F.pandas_udf(batch, BooleanType())


def loose_phone(c: Column) -> Column:
    """Ten digits or more."""
    return F.coalesce(F.length(digits(c)) >= 10, F.lit(False))
