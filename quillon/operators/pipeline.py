"""Cleaning steps in a chain: each step is a lazy projection or filter, and a log tells
what was asked for. The source stays reachable, so reset() costs nothing."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame

from ..functions import dates, text
from ..functions import validate as V
from . import casts, dedup, encode, impute
from .profile import ref, text_columns

log = logging.getLogger(__name__)
#: Other names of steps.
ALIASES = {"standardize_columns": "rename", "standardize_column_names": "rename", "fix_types": "cast_types", "handle_missing": "handle_missing_values", "deduplicate": "remove_duplicates"}


class Pipeline:
    def __init__(self, df: DataFrame, schema=None):
        self.source = self.df = df
        self.schema, self.log = schema, []

    def _done(self, step: str, df: DataFrame, **details) -> Pipeline:
        self.df = df
        self.log.append({"operation": step, "details": details})
        return self

    def _texts(self, columns):
        return columns or text_columns(self.df)

    def _each(self, step: str, columns, f, **details) -> Pipeline:
        cols = self._texts(columns)
        return self._done(step, self.df.withColumns({c: f(ref(c)) for c in cols}) if cols else self.df, columns=cols, **details)

    def fix_whitespace(self, columns=None, strategy="trim", fix_column_names=False):
        out = self._each("fix_whitespace", columns, lambda c: text.clean_space(c, strategy), strategy=strategy)
        if fix_column_names:
            out.df = out.df.toDF(*[" ".join(c.split()) if strategy == "normalize" else c.strip() for c in out.df.columns])
        return out

    def fix_case(self, columns=None, case="lower"):
        return self._each("fix_case", columns, lambda c: text.change_case(c, case), case=case)

    def remove_special_characters(self, columns=None, keep="", replace_with=""):
        return self._each("remove_special_characters", columns, lambda c: text.remove_special(c, keep, replace_with))

    def normalize_text(self, columns=None):
        return self._each("normalize_text", columns, text.normalize_text)

    def standardize_dates(self, columns, input_format=None, target_format="ISO8601"):
        return self._each("standardize_dates", columns, lambda c: dates.format_date(c, target_format, input_format))

    def apply_schema_formats(self):
        """Temporal columns with a date_format are read by it and written in it."""
        for c in self.schema.columns if self.schema else []:
            if c.date_format and c.name in text_columns(self.df):
                self.df = self.df.withColumn(c.name, dates.format_date(ref(c.name), c.date_format, c.date_format))
        return self._done("apply_schema_formats", self.df)

    def standardize_phone_numbers(self, columns, style=None):
        return self._each("standardize_phone_numbers", columns, (lambda c: text.phone_as(c, style)) if style else text.format_phone)

    def standardize_currency(self, columns):
        return self._each("standardize_currency", columns, text.parse_currency)

    def validate_emails(self, column, fix=False):
        d = self.df.withColumn(column, V.fix_email(ref(column))) if fix else self.df
        return self._done("validate_emails", V.with_flag(d, column, V.valid_email), column=column)

    def validate_phone_numbers(self, column, country="US"):
        return self._done("validate_phone_numbers", V.with_flag(self.df, column, V.valid_us_phone if country == "US" else V.loose_phone), column=column)

    def validate_custom(self, column, rule):
        """rule: a Column predicate, or a Python function of a value."""
        try:
            flag = rule(ref(column))
            ok = hasattr(flag, "cast")
        except Exception:  # a function of plain values
            ok = False
        return self._done("validate_custom", V.with_flag(self.df, column, rule if ok else V.custom_rule(rule)), column=column)

    def rename(self, convention="snake_case"):
        return self._done("rename", text.rename_columns(self.df, convention), convention=convention)

    def apply_sql_naming_rules(self):
        return self._done("apply_sql_naming_rules", text.rename_columns(self.df, "sql"))

    def cast_types(self):
        return self._done("cast_types", casts.auto_cast(self.df))

    def remove_duplicates(self, subset=None, keep="first", order_by=None):
        return self._done("remove_duplicates", dedup.drop_duplicates(self.df, subset, keep, order_by), subset=subset)

    def deduplicate_fuzzy(self, column, threshold=0.85, keep="first", order_by=None):
        return self._done("deduplicate_fuzzy", dedup.fuzzy_duplicates(self.df, column, threshold, keep, order_by), column=column)

    def handle_missing_values(self, strategy="auto", columns=None, fill_value=0, order_by=None):
        return self._done("handle_missing_values", impute.fill_missing(self.df, strategy, columns, fill_value, order_by), strategy=strategy)

    def impute_with_knn(self, columns, n_neighbors=5):
        return self._done("impute_with_knn", impute.knn_impute(self.df, columns, n_neighbors))

    def one_hot_encode(self, columns, drop_first=False, prefix=None, drop_original=True):
        return self._done("one_hot_encode", encode.one_hot(self.df, columns, drop_first, prefix, drop_original), columns=columns)

    def label_encode(self, columns, order_by):
        return self._done("label_encode", encode.label_encode(self.df, columns, order_by), columns=columns)

    def ordinal_encode(self, column, ordering):
        return self._done("ordinal_encode", encode.ordinal_encode(self.df, column, ordering), column=column)

    def auto_encode_categorical(self, **how):
        return self._done("auto_encode_categorical", encode.auto_encode(self.df, **how))

    def run(self, steps: list[str]) -> Pipeline:
        """Steps by name, without arguments; an unknown one is warned of and left out."""
        for s in steps:
            step = getattr(self, ALIASES.get(s, s), None)
            if s.startswith("_") or not callable(step):
                log.warning("no such step: %s", s)
                continue
            step()
        return self

    def reset(self) -> Pipeline:
        self.df, self.log = self.source, []
        return self
