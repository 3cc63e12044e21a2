"""Cleaning of text, money, phones and column names."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .validate import digits, strip

NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def clean_space(c: Column, strategy: str = "trim") -> Column:
    """trim: at both ends. normalize: runs inside become one blank as well."""
    if strategy not in ("trim", "normalize"):
        raise ValueError("strategy is trim or normalize")
    return strip(F.regexp_replace(c, r"\s+", " ")) if strategy == "normalize" else strip(c)


def change_case(c: Column, case: str = "lower") -> Column:
    if case == "title":  # each run of letters, also after a hyphen or an apostrophe
        return F.array_join(F.transform(F.regexp_extract_all(c, F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1)), F.initcap), "")
    kinds = {"lower": F.lower, "upper": F.upper, "sentence": lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substring(x, 2, 2**31 - 1)))}
    if case not in kinds:
        raise ValueError("case is lower, upper, title or sentence")
    return kinds[case](c)


def remove_special(c: Column, keep: str = "", replace_with: str = "") -> Column:
    """Without what is neither letter, digit, underscore, white space nor in keep."""
    kept = re.sub(r"([\\\]\[\^\-&])", r"\\\1", keep)
    return F.regexp_replace(c, rf"[^\p{{L}}\p{{N}}_\s{kept}]", replace_with)


def normalize_text(c: Column) -> Column:
    return remove_special(F.lower(clean_space(c, "normalize")))


def to_number(c: Column) -> Column:
    """A double, null where the text isn't a plain number."""
    s = strip(c)
    return F.when(s.rlike(NUMBER), s.try_cast("double"))


def parse_currency(c: Column) -> Column:
    """An amount without its signs; in parentheses it is negative."""
    s = F.regexp_replace(c, r"[$€£¥₹,\s]", "")
    inner = F.regexp_extract(s, r"^\((.*)\)$", 1)
    return F.when(inner != "", -to_number(inner)).otherwise(to_number(s))


def format_phone(c: Column) -> Column:
    d = digits(c)
    ten = F.format_string("(%s) %s-%s", F.substring(d, -10, 3), F.substring(d, -7, 3), F.substring(d, -4, 4))
    return F.when(F.length(d) == 10, ten).when((F.length(d) == 11) & d.startswith("1"), F.concat(F.lit("+1 "), ten)).otherwise(d)


def phone_as(c: Column, style: str = "E164") -> Column:
    """A North American number in E164, INTERNATIONAL, NATIONAL or RFC3966 form; others null.
    Area and exchange codes begin with 2 to 9."""
    d = digits(c)
    ten = F.when((F.length(d) == 11) & d.startswith("1"), F.substring(d, 2, 10)).otherwise(d)
    a, b, e = F.substring(ten, 1, 3), F.substring(ten, 4, 3), F.substring(ten, 7, 4)
    forms = {"E164": "+1%s%s%s", "INTERNATIONAL": "+1 %s-%s-%s", "NATIONAL": "(%s) %s-%s", "RFC3966": "tel:+1-%s-%s-%s"}
    if style not in forms:
        raise ValueError(f"style is one of {list(forms)}")
    return F.when(ten.rlike(r"^[2-9]\d{2}[2-9]\d{6}$"), F.format_string(forms[style], a, b, e))


def standard_name(name: object) -> str:
    """A column name of lower-case letters, digits and underscores."""
    out = "_".join(p for p in re.split(r"[\W_]+", str(name).strip().lower()) if p)
    if not out:
        return "unnamed_column"
    return f"_{out}" if out[0].isdigit() else out


def _words(name: str) -> list[str]:
    return re.split(r"[^\w]+", name)


def snake(name: str) -> str:
    split = re.sub(r"(?<=[A-Z])(?=[A-Z][a-z])|(?<=[a-z0-9])(?=[A-Z])", "_", name)
    return "_".join(p for p in re.split(r"[\W_]+", split) if p).lower()


def camel(name: str) -> str:
    first, *rest = _words(name)
    return first.lower() + "".join(w.capitalize() for w in rest)


def pascal(name: str) -> str:
    return "".join(w.capitalize() for w in _words(name))


CONVENTIONS = {"sql": standard_name, "snake_case": snake, "camelCase": camel, "PascalCase": pascal}


def rename_columns(df: DataFrame, convention: str = "sql") -> DataFrame:
    """Names that become equal get _2, _3 ... in column order."""
    if convention not in CONVENTIONS:
        raise ValueError(f"convention is one of {list(CONVENTIONS)}")
    names, seen = [], set()
    for c in df.columns:
        base = name = CONVENTIONS[convention](c)
        k = 2
        while name.lower() in seen:
            name, k = f"{base}_{k}", k + 1
        seen.add(name.lower())
        names.append(name)
    return df.toDF(*names)
