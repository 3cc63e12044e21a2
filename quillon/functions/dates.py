"""Dates in text: strptime formats are turned into those of Spark."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .validate import strip

# Formats tried in this order, and named targets.
COMMON_FORMATS = ["%Y-%m-%d", "%m/%d/%Y", "%d/%m/%Y", "%Y/%m/%d", "%m-%d-%Y", "%d-%m-%Y"]
WITH_TIME = ["%Y-%m-%d %H:%M:%S", "%Y-%m-%dT%H:%M:%S"]
TARGETS = {"ISO8601": "%Y-%m-%d", "US": "%m/%d/%Y", "EU": "%d/%m/%Y"}
READ = {"Y": "yyyy", "m": "M", "d": "d", "H": "H", "M": "m", "S": "s", "y": "yy", "b": "MMM", "B": "MMMM", "p": "a", "I": "h", "f": "SSSSSS"}
WRITE = READ | {"m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "I": "hh"}


def java_format(fmt: str, table: dict[str, str]) -> str:
    out, i = [], 0
    while i < len(fmt):
        if fmt[i] == "%" and i + 1 < len(fmt):
            if fmt[i + 1] not in table:
                raise ValueError(f"no Spark form of %{fmt[i + 1]}")
            out.append(table[fmt[i + 1]])
            i += 2
        else:
            out.append(f"'{fmt[i]}'" if fmt[i].isalpha() else fmt[i])
            i += 1
    return "".join(out)


SHAPES = {"Y": r"\d{4}", "b": r"\p{L}+\.?", "B": r"\p{L}+", "p": r"\p{L}+", "f": r"\d{1,6}"}


def shape(fmt: str) -> str:
    """A regular expression of what the format can read, so that other text costs no exception."""
    return "^" + "".join(SHAPES.get(p[1], r"\d{1,2}") if len(p) == 2 and p[0] == "%" else re.escape(p) for p in re.findall(r"%.|[^%]+|%", fmt)) + "$"


def parse(c: Column, formats: list[str] | None = None) -> Column:
    """A timestamp without time zone by the first format that fits, else null."""
    s = strip(c)
    tries = [F.when(s.rlike(shape(f)), F.try_to_timestamp(s, F.lit(java_format(f, READ)))) for f in formats or [*COMMON_FORMATS, *WITH_TIME]]
    return F.coalesce(*tries).cast("timestamp_ntz")


def valid_date(c: Column, fmt: str = "%Y-%m-%d") -> Column:
    return parse(c, [fmt]).isNotNull()


def format_date(c: Column, output: str = "ISO8601", input_format: str | None = None) -> Column:
    """In the output format, a named one or strptime's; values that no format fits stay."""
    at = parse(c, [input_format] if input_format else COMMON_FORMATS)
    return F.coalesce(F.date_format(at, java_format(TARGETS.get(output, output), WRITE)), c)
